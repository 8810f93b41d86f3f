"""Corpus operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import bpe_stream, components, cross_parse, decontaminate, interpolated_lm, pii, range_coder, scaled_sketch, suffix_merge, token_group_join, url_trie

KIND = "doc_id bigint, text string, lang string, score double, lang_pred string"


def rows():
    r = random.Random(3)
    words = [w + e for w in ("the", "of", "ré", "zu", "an", "tion", "her") for e in ("", "an", "er", "ing", "é")]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = text(120)
    edited = base.split(" ")
    edited[60] = "changed"
    out = [base, " ".join(edited), base, None, "", "   \n\t", "word", "a b c", text(40), text(5000), "x" * 3000, "1234 567 !!", text(90) + base[:200] + text(50), "mail a.b@c.example.com or +49 (30) 1234567 and 10.0.0.1, 4111 1111 1111 1111."]
    out += [text(30) for _ in range(20)]
    return [(i, t, "en" if i % 2 else None, 1.0, "clash") for i, t in enumerate(out)] + [(2, base, None, 0.0, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), KIND)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def test_language_model(docs, none):
    train = F.col("doc_id") % 5 != 1
    got = [tuple(x) for x in interpolated_lm.scored(docs, train).collect()]
    count = collections.Counter()
    tokens = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b""]
    for i, t, *_ in rows():
        if i % 5 != 1:
            count.update(tokens(t))
    n = sum(count.values())
    assert len(got) == len(rows())
    want = {i: (len(tokens(t)), sum(count[w] > 0 for w in tokens(t))) for i, t, *_ in rows()}
    for i, held, size, known, total, base, score in got:
        assert (size, known) == want[i] and total == n and held == (i % 5 == 1) and base < 0 and score <= 0
    assert interpolated_lm.scored(none, train).collect() == []


def test_em_recovers_the_better_estimate():
    w = interpolated_lm.learn_weights([(3, 2, 40, 1000), (3, 0, 40, 10)], 10**6)
    assert w[3][0] > 0.9 and abs(w[3].sum() - 1) < 1e-9


def test_id_blocks_round_trip():
    import numpy as np

    r = np.random.default_rng(1)
    for ids in (np.zeros(0), np.zeros(1), r.integers(0, 50257, 5000), np.repeat(r.integers(0, 65536, 50), 100), r.geometric(0.01, 9000)):
        ids = ids.astype("<u4")
        blocks = range_coder.encode_blocks(ids, 1000)
        assert (range_coder.decode_blocks(blocks) == ids).all()
        for i, b in enumerate(blocks):  # each block alone
            assert (range_coder.decode_blocks([b]) == ids[1000 * i : 1000 * i + 1000]).all()
    bad = bytearray(blocks[0])
    bad[40] ^= 1
    with pytest.raises(ValueError):
        range_coder.decode_blocks([bytes(bad)])


def test_id_files(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = [tuple(x) for x in range_coder.read_ids(range_coder.write_ids(docs, path, lanes=4, block=256)).orderBy("start").collect()]
    start, want = 0, []
    for i, t, *_ in sorted(rows(), key=lambda x: (x[0], x[1] or "")):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    assert got == want
    assert range_coder.read_ids(range_coder.write_ids(none, path)).collect() == []


def test_myers_and_pigeonhole(spark, docs, none):
    r = random.Random(2)
    for _ in range(200):
        p, t = ("".join(r.choice("abc") for _ in range(r.randrange(1, n))) for n in (12, 30))
        best = list(range(len(t) + 1)) and [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(best[j] + 1, new[-1] + 1, best[j - 1] + (c != d)))
            best = new
        assert decontaminate.myers(p, t)[0] == min(best)
    item = rows()[8][1]
    items = spark.createDataFrame([(7, item.upper().replace(" ", "!! ")), (8, None), (9, ""), (10, "not anywhere in these texts at all, really")], "item_id bigint, text string")
    assert [(x.doc_id, x.item_id, x.distance, x.start, x.end) for x in decontaminate.contaminated(docs, items).collect()] == [(8, 7, 0, 0, len(item))]
    assert decontaminate.clean(docs, items).count() == len(rows()) - 1
    assert decontaminate.contaminated(none, items).collect() == []


def test_personal_data(docs, none):
    got = {x.doc_id: x for x in pii.detect(docs).collect()}
    assert [got[13][f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1]
    assert got[13].redacted == "mail <EMAIL> or <PHONE> and <IP>, <CARD>."
    assert got[3].redacted is None and got[4].spans == ""
    assert pii.detect(none).collect() == []
    found = pii.find_spans(["call (017) 555-7713 now", "mail foo [at] bar [dot] com", "host 10[.]0[.]0[.]7 x", "order 2024-01-02 item", None], pii.model())
    assert [[k for k, _, _ in s] for _, s in found] == [["phone"], ["email"], ["ip"], [], []]


def test_bpe_like_the_library(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    w = bpe_stream.WordBpe(open(path, encoding="utf-8").read())
    r = random.Random(5)
    texts = [t or "" for _, t, *_ in rows()] + ["<|endoftext|>x <|startoftext|>", "İΣς é ﬁ 1½²\x1c\x85 don't I'LL"] + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x600), r.randrange(0x2000, 0x2100)])) for _ in range(40)) for _ in range(200)]
    for t in texts:
        assert w.encode(t) == lib.encode(t, add_special_tokens=False).ids
        assert w.decode(w.encode(t)) == lib.decode(w.encode(t), skip_special_tokens=False)
    assert w.text(w.encode("Ünï 日本 x")) == "ünï 日本 x "
    t = bpe_stream.Transducer(w.merges)
    for c in "ab" * 5000:
        t.feed(c)
    assert t.held <= bpe_stream.STRIDE + w.merges.lookahead
    got = {x.doc_id: x for x in bpe_stream.round_trip(docs, path).collect()}
    assert got[3].n_tokens == 0 and got[3].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe_stream.round_trip(none, path).collect() == []


def test_incremental_decoder():
    data = "aé日😀".encode() + b"\xff\xe6\x97" + b"z\xf0\x9f"
    d = bpe_stream.Decoder()
    assert "".join(d.feed(bytes([b])) for b in data) + d.finish() == data.decode(errors="replace")


def test_fingerprints(docs, none):
    got = [tuple(x)[:7] for x in scaled_sketch.sketched(docs).collect()]
    order = sorted(rows(), key=lambda x: (x[0], x[1] or ""))
    want = set()
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        want.add((i, len(t), hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()))
    assert {x[:3] for x in got} == want and len(got) == len(order)
    by = {x[0]: x for x in got}
    assert by[0][3] == by[2][3] and by[0][3] != by[1][3]
    assert all(0 <= x[5] <= 1 and 0 <= x[6] <= 1 for x in got)
    assert scaled_sketch.sketched(none).collect() == []


def brute_components(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_jaccard_join(spark, docs, none):
    r = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    texts = [(i, t) for i, t, *_ in rows()]
    for i in range(60):  # a family of near copies on both sides of the threshold
        w = list(base)
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(60)] = f"e{r.randrange(1000)}"
        texts.append((100 + i, " ".join(w)))
    table = spark.createDataFrame(texts, "doc_id bigint, text string")
    for size, percent in ((4, 85), (5, 80)):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in token_group_join.jaccard_components(table, size, percent).collect()}
        assert got == brute_components(dict(texts).items(), size, percent)
    assert token_group_join.jaccard_components(none).collect() == []


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {x.node: x.component for x in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_suffix_dedup(docs, none):
    got = {x.doc_id: tuple(x) for x in suffix_merge.deduplicated(docs).collect()}
    seen = set()
    for i, t in sorted({(i, t or "") for i, t, *_ in rows()}):
        b = t.encode()
        cover = bytearray(len(b))
        own = [b[k : k + 50] for k in range(len(b) - 49)]
        for k, w in enumerate(own):
            if w in seen:
                cover[k : k + 50] = b"\1" * 50
        seen.update(own)
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        spans = sum(cover[k] and (k == 0 or not cover[k - 1]) for k in range(len(b)))
        assert got[i] == (i, len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest())
    assert suffix_merge.deduplicated(none).collect() == []


def test_loser_tree_sorts():
    r = random.Random(4)
    runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randrange(8))) for _ in range(r.randrange(30))) for _ in range(7)]
    coded = [suffix_merge.front_decode(suffix_merge.front_code(x)) for x in runs]
    assert [x for x, _ in coded] == runs
    out, last = [], b""
    for k, i, shared in suffix_merge.merge_runs(coded):
        s = runs[k][i]
        assert not out or shared == suffix_merge.common(last, s, 0)
        out.append(s)
        last = s
    assert out == sorted(x for run in runs for x in run)


def test_url_trie(spark):
    t = url_trie.UrlTrie([("block", "com", "/en/"), ("allow", "example.com", "/en/7")])
    pages = [(1, "https://A.Example.com/en/77?x"), (2, "http://x.com/en/"), (3, None), (4, "no scheme"), (5, "http://com/en/7"), (6, "http://notexample.com#/en/")]
    got = {x.page_id: tuple(x)[1:] for x in url_trie.judge_urls(spark.createDataFrame(pages, "page_id bigint, url string"), t).collect()}
    assert got == {1: ("a.example.com", "/en/77", "example.com/en/7", "allow"), 2: ("x.com", "/en/", "com/en/", "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("com", "/en/7", "com/en/", "block"), 6: ("notexample.com", "", None, "allow")}


def test_language_id(spark, docs, none):
    p = cross_parse.CrossParser({"a": ["the thing and other things there"] * 2, "b": ["zug und schnell gegen zwei"]})
    assert [x for x, _ in p.predict(["other thing", "gegen zug", "12 !", None, ""])] == ["a", "b", "und", "und", "und"]
    assert cross_parse.identify(docs, {}).where("lang_pred != 'und'").count() == 0
    assert cross_parse.identify(none, {"a": ["x"]}).collect() == []
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    right = cross_parse.identify(table.where(held), cross_parse.sample_texts(table.where(~held)), F.col("lang")).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95


def test_pipeline(spark):
    import corpus_pipeline

    got = {x.doc_id: x for x in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()}
    table = {x.doc_id: x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    table = {i: t for i, t in table.items() if t and any(c.isalpha() for c in t)}
    table = {i: table[i] for i, (_, c) in brute_components(table.items(), 5, 80).items() if i == c}
    items = [decontaminate.normal(x.text) for x in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    clean = {i for i, t in table.items() if not any(x in decontaminate.normal(t) for x in items)}
    assert set(got) <= clean and len(clean - set(got)) <= 2  # brute force finds exact occurrences only
    for i, x in got.items():
        assert not pii.base_spans(x.text) or x.text == table[i]
        assert x.n_tokens > 0


def brute_phrases(sample, text):
    """Phrases of the text in the sample's normalised texts, block by block."""
    plain = lambda t: re.sub(r"[\W\d_]+", " ", "".join(c.lower()[0] if c.isalpha() else " " for c in t))
    known, text, n = [plain(t) for t in sample], plain(text), 0
    for at in range(0, len(text), cross_parse.BLOCK):
        phrase = ""
        for c in text[at : at + cross_parse.BLOCK]:
            if any(phrase + c in t for t in known):
                phrase += c
            else:
                n += 1
                phrase = c if any(c in t for t in known) else ""
        n += phrase != ""
    return n


def test_language_id_of_large_and_many_scripts():
    r = random.Random(8)
    scripts = {
        "zh": [*range(0x4E00, 0x5600), *range(0x20000, 0x20010)], "ja": [*range(0x3041, 0x3097), *range(0x4E00, 0x4F00)], "ko": [*range(0xAC00, 0xB000)], "got": [*range(0x10330, 0x1034B)],
        "el": [*range(0x3B1, 0x3C2), *range(0x3C3, 0x3CA)], "ru": [*range(0x430, 0x450)], "bg": [*range(0x430, 0x448)], "ar": [*range(0x627, 0x63B)], "en": [*range(97, 123)], "vi": [*range(97, 123), *range(0x1EA1, 0x1EF9, 2)],
    }
    words = {k: ["".join(chr(r.choice(v)) for _ in range(r.randrange(2, 6))) for _ in range(900)] for k, v in scripts.items()}
    text = lambda k, n: "".join(r.choice(words[k]) + r.choice(["", " ", ", "]) for _ in range(n))
    samples = {k: [text(k, 250) for _ in range(8)] for k in words}
    p = cross_parse.CrossParser(samples)
    truth = [k for k in words for _ in range(4)]
    docs = [text(k, 60).upper() for k in truth]
    assert [k for k, _ in p.predict(docs)] == truth
    docs += ["", "1 2", "Ω日𠀀 x" * 300, text("zh", 200) + text("ru", 200), "İ ı ς ǅ ß"]
    assert p.phrases(docs)[0].tolist() == [[brute_phrases(samples[k], t) for k in p.langs] for t in docs]
    kinds = {k: type(t) for k, t in zip(p.langs, p.tables, strict=True)}
    assert kinds["zh"] is cross_parse.Hashed and kinds["en"] is cross_parse.Flat


def test_language_stage_without_labels(spark, docs):
    import corpus_pipeline

    want = sorted((i, t) for i, t, *_ in rows() if t and any(c.isalpha() for c in t))
    blank = [(1, "", "en", 1.0, None), (2, None, "de", 1.0, None)]  # labels that teach nothing
    for table in (docs, docs.withColumn("lang", F.lit(None).cast("string")), docs.withColumn("lang", F.lit(None).cast("string")).unionByName(spark.createDataFrame(blank, KIND))):
        got = corpus_pipeline.language_id(spark, table, "")
        assert got.columns == docs.columns and sorted((x.doc_id, x.text) for x in got.collect()) == want


def test_bpe_round_trip_by_the_library(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    w = bpe_stream.WordBpe(open(path, encoding="utf-8").read())
    more = [(900, "Ünï 日本😀 don't <|endoftext|>x <|startoftext|>", None, 1.0, None), (901, "ab" * 5000 + "é" * 300, None, 1.0, None), (902, " Σ\x1c\u2003z ", None, 1.0, None)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    back = {s: b for b, s in enumerate(bpe_stream.byte_symbols())}
    want = collections.Counter()
    for i, t, *_ in rows() + more:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)), sha(w.text(ids))] += 1
        if not any(x in (t or "") for x in w.special):
            plain = "".join(bytes(back[c] for c in x).decode() + " " for x, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(t or "")))
            assert w.text(ids) == plain
    got = bpe_stream.round_trip(docs.unionByName(spark.createDataFrame(more, KIND)), path)
    assert collections.Counter((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256, x.text_sha256) for x in got.collect()) == want


def test_language_model_scores_by_plain_counts(docs, monkeypatch):
    learnt, learn = [], interpolated_lm.learn_weights
    monkeypatch.setattr(interpolated_lm, "learn_weights", lambda *a: learnt.append(learn(*a)) or learnt[-1])
    got = interpolated_lm.scored(docs, F.col("doc_id") % 5 != 1).collect()
    tokens = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b""]
    one, two = collections.Counter(), collections.Counter()
    for i, t, *_ in rows():
        if i % 5 != 1:
            one.update(tokens(t))
            two.update(zip([b"", *tokens(t)], tokens(t)))
    n, v, w = sum(one.values()), len(one), learnt[0]
    want = []
    for i, t, *_ in rows():
        base = sum(math.log10((one[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens(t))
        weights = lambda c: w[min(c.bit_length(), interpolated_lm.BUCKETS - 1)]
        p = [(weights(one[a]), two[a, b] / max(1, one[a]), one[b] / n) for a, b in zip([b"", *tokens(t)], tokens(t))]
        want.append((i, base, sum(math.log10(x[0] * c + x[1] * d + x[2] / (v + 1)) for x, c, d in p)))
    for g, x in zip(sorted((r.doc_id, r.base_score, r.score) for r in got), sorted(want), strict=True):
        assert g == pytest.approx(x, rel=1e-9)


def test_fingerprint_likeness_by_plain_sets(docs):
    def kept(t):
        w, out = [x for x in re.split(r"[ \t\n\x0b\f\r]+", t.lower()) if x], set()
        for k in range(max(1, len(w) - 4) if w else 0):
            h = 42
            for x in w[k : k + 5]:
                h = xxhash.xxh64_intdigest(x.encode(), seed=h)
            if 1 << 63 <= h < (1 << 63) + (1 << 62):  # the lowest quarter of the signed numbers
                out.add((h & ((1 << 62) - 1)) >> 30)
        return out

    like = lambda a, b: len(kept(a) & kept(b)) / len(kept(a) | kept(b)) if kept(a) | kept(b) else float(a == b)
    order = [(i, t or "") for i, t, *_ in sorted(rows(), key=lambda x: (x[0], x[1] or ""))]
    want = []
    for k, (i, t) in enumerate(order):
        after, q = order[(k + 1) % len(order)][1], len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        want.append((i, len(t), like(t, edited), like(t, after)))
    got = sorted((x.doc_id, x.n_chars, x.near_edited, x.near_next) for x in scaled_sketch.sketched(docs).collect())
    for g, x in zip(got, sorted(want), strict=True):
        assert g == pytest.approx(x)


def test_pipeline_texts_and_digests(spark):
    import corpus_pipeline

    got = {x.doc_id: x for x in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()}
    table = {x.doc_id: x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    table = {i: t for i, t in table.items() if t and any(c.isalpha() for c in t)}
    table = {i: table[i] for i, (_, c) in brute_components(table.items(), 5, 80).items() if i == c}
    items = [decontaminate.normal(x.text) for x in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    near = lambda t: any(decontaminate.myers(x, t)[0] <= len(x) // decontaminate.CHARS_PER_EDIT for x in items if x)
    assert set(got) <= set(table)
    for i in set(table) - set(got):
        assert near(decontaminate.normal(table[i])), i
    for i in got:
        assert not any(x and x in decontaminate.normal(table[i]) for x in items), i
    w = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    keys = sorted(got)
    changed = 0
    for i, (_, spans) in zip(keys, pii.find_spans([table[i] for i in keys], pii.model()), strict=True):
        text = table[i]
        for kind, a, b in sorted(spans, key=lambda s: -s[1]):
            text = text[:a] + f"<{kind.upper()}>" + text[b:]
        changed += text != table[i]
        ids = w.encode(text, add_special_tokens=False).ids
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        x = got[i]
        assert (x.text, x.n_tokens, x.ids_sha256, x.decoded_sha256) == (text, len(ids), sha(" ".join(map(str, ids))), sha(w.decode(ids, skip_special_tokens=False)))
    assert changed
