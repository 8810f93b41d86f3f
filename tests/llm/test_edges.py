"""Edge cases of the corpus operators: null and clashing keys, long texts, large rule lists, large ids."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import bpe_stream, cross_parse, decontaminate, pii, range_coder, token_group_join, url_trie

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("block,lanes", [(64, 4), (1000, 3), (4096, 1536)])
def test_ids_of_any_size(block, lanes):
    r = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 300, 9000):
        ids = np.where(r.random(n) < 0.3, r.integers(0, 1 << 32, n), r.geometric(0.02, n)).astype("<u4")
        blocks = range_coder.encode_blocks(ids, block, lanes)
        assert (range_coder.decode_blocks(blocks, lanes) == ids).all()


def test_text_longer_than_a_segment(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    r = random.Random(1)
    texts = ["a", " ".join(r.choice(["lorem", "x1", "\n\n", "dolor,", "é"]) for _ in range(20_000)), None, "b"]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens string")
    got = range_coder.read_ids(range_coder.write_ids(docs, path, lanes=3, block=128)).orderBy("start").collect()
    lib = Tokenizer.from_file(path)
    want = [lib.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert [(x.doc_id, x.n_tokens, x.ids_crc32) for x in got] == [(i, len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for i, w in enumerate(want)]


def test_units_are_the_librarys_words():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        u = range_coder.Units(f.read())
    import pyarrow as pa

    r = random.Random(5)
    texts = ["", " a", "a  b", "x <|endoftext|> y<|endoftext|>", "日本 語。", "\0a b", "a　 c", "it's we'll \x1c x\x85 y"]
    texts += ["".join(r.choice("ab \n'sé1²日 ̀.\t<|>\0") for _ in range(r.randrange(30))) for _ in range(3000)]
    ids, lens = u.encode(pa.array([*texts, None]), 2)
    want = [u.lib.encode(t, add_special_tokens=False).ids + [2] for t in [*texts, ""]]
    assert lens.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_transducer_holds_the_lookahead_only():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    w, lib = bpe_stream.WordBpe(spec), Tokenizer.from_str(spec)
    r = random.Random(2)
    word = "".join(r.choice("etaoinshrdlu") for _ in range(20_000))
    t, out = bpe_stream.Transducer(w.merges), []
    for c in word:
        out += t.feed(c)
    out += t.finish()
    assert [w.merges.vocab[x] for x in out] == lib.encode(word, add_special_tokens=False).ids
    assert t.held <= w.merges.lookahead + w.merges.longest + bpe_stream.STRIDE
    text = f"a {word} b,c " + "été. " * 40_000 + "é" * 5_000
    import hashlib

    want = lib.encode(text, add_special_tokens=False)
    n, ids, decoded, _ = w.digest(text)
    assert n == len(want.ids) and ids == hashlib.sha256(" ".join(map(str, want.ids)).encode()).hexdigest()
    assert decoded == hashlib.sha256(lib.decode(want.ids, skip_special_tokens=False).encode()).hexdigest()


def test_items_with_null_and_text_keys_and_edits(spark):
    r = random.Random(4)
    items = [(k, " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(12))) for k in (None, "b", "a", "b")]
    texts = []
    for k, (_, t) in enumerate(items):
        cut = list(t)
        for _ in range(3):
            cut[r.randrange(len(cut))] = "z"
        texts.append((f"d{k}", "some words before " + "".join(cut) + " and after", 1))
    texts += [("far", "nothing of it " * 50, 1), (None, None, 1), ("empty", "", 1)]
    docs = spark.createDataFrame(texts, "doc_id string, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {(x.doc_id, x.item_id): x.distance for x in decontaminate.contaminated(docs, bench).collect()}
    for k, (ident, t) in enumerate(items):
        p = decontaminate.normal(t)
        best = decontaminate.myers(p, decontaminate.normal(texts[k][1]))[0]
        assert best <= len(p) // 16 and got[(f"d{k}", ident)] == best
    assert len(got) == 4
    assert {x.doc_id for x in decontaminate.clean(docs, bench).collect()} == {"far", None, "empty"}
    assert {(x.doc_id, x.item_id): x.distance for x in decontaminate.contaminated(docs, bench, max_items_chars=80).collect()} == got


def test_repeated_pieces_take_linear_time():
    known = decontaminate.Items([(1, "abcd " * 40)])
    import time

    took = []
    for n in (20_000, 80_000):
        start = time.process_time()
        assert known.find(("abcd " * n).strip())
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0] + 1


def test_base_spans_against_the_patterns():
    """The contract's patterns, tried from each place."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": all(int(p) <= 255 for p in s.split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]

    r = random.Random(6)
    parts = ["a", "@", ".", "12", "255", "256", "0", " ", "-", "+4", "4111 1111 1111 1111", "b.c", "(", "1.2.3.4", "x@y.z", "é", "00000000000000000001.1.1.1", "4111111111111112"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        want = sorted(((k, *m.span()) for k, p in patterns.items() for m in re.finditer(p, t) if valid(k, m[0])), key=lambda s: (s[1], pii.KINDS.index(s[0])))
        assert pii.base_spans(t) == want, t
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [("ip", 0, 5006)]
    assert pii.find_spans(["card 4111 1111 1111 1112"], pii.model()) == [([], [])]


def test_keyless_rows_come_back(spark):
    rows = [(None, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, None, "x"), (2, "  ", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_shingles string")
    got = sorted((tuple(x) for x in token_group_join.jaccard_components(docs, 4, 85).collect()), key=str)
    assert got == sorted([(None, 3, None), (None, 0, None), (1, 3, 1), (2, 0, 2)], key=str)


def test_joined_rules_are_the_tries(spark):
    r = random.Random(7)
    hosts = ["com", "a.com", "b.a.com", "org", "x.org", "c.org"]
    rules = [(r.choice(["allow", "block"]), r.choice(hosts), r.choice(["", "/", "/en/", "/en/7", "/en", "/de/a/b"])) for _ in range(25)]
    urls = [f"http://{r.choice(['', 'W.'])}{r.choice(hosts)}{r.choice(['', '/', '/en/71', '/en?x', '/de/a/bc#f', '/x'])}" for _ in range(200)] + [None, "no scheme", "://", "http://a.com"]
    pages = spark.createDataFrame([(i % 190, u, "p") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    of = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert of(url_trie.judge_urls(pages, url_trie.UrlTrie(rules))) == of(url_trie.judge_joined(pages, table))
    none = pages.where("false")
    assert url_trie.judge_urls(none, url_trie.UrlTrie(rules)).collect() == url_trie.judge_joined(none, table).collect() == []
    tie = url_trie.UrlTrie([("allow", "t.com", "/a"), ("block", "t.com", "/a")])
    assert tie.match("t.com", "/a/" + "b" * 100_000) == ("t.com/a", "block")


def test_more_rules_than_the_trie_takes(spark):
    n = 300_000
    rules = spark.range(n).select(F.when(F.col("id") % 2 == 0, "block").otherwise("allow").alias("verdict"), F.concat(F.lit("h"), F.col("id"), F.lit(".com")).alias("host"), F.lit("/a").alias("path"))
    pages = spark.createDataFrame([(1, "http://x.h299998.com/ab"), (2, "http://h299999.com/a"), (3, "http://h5.com/b")], "page_id bigint, url string")
    got = {x.page_id: (x.rule, x.verdict) for x in url_trie.judge_joined(pages, rules).collect()}
    assert got == {1: ("h299998.com/a", "block"), 2: ("h299999.com/a", "allow"), 3: (None, "allow")}


def test_samples_are_whole_texts_of_bounded_number(spark):
    rows = [(i, "word " * (2000 if i % 2 else 3), "en" if i % 3 else "xx", "s", 0) for i in range(60)] + [(1, "twice", "en", "s", 0), (None, "none", "en", "s", 0), (None, None, "en", "s", 0)]
    got = cross_parse.sample_texts(spark.createDataFrame(rows, DOCS), docs_per_lang=30)
    assert {len(v) for v in got.values()} == {20, 30}
    assert set(map(len, got["xx"])) == {15, 10_000} and "none" in got["en"]


def test_pipeline_with_clashing_columns_and_empty_tables(spark, tmp_path):
    text = " ".join(f"word{i} und so weiter" for i in range(30))
    rows = [(1, text, "de", "s", len(text), 7, "x"), (2, text, "de", "s", len(text), 7, "x"), (None, text + " mail a@b.cd", "de", "s", 0, 7, None), (3, None, "de", "s", 0, 7, "x"), (4, "", None, "s", 0, 7, "x"), (5, "z" * 200_000, None, "s", 200_000, 7, "x")]
    docs = spark.createDataFrame(rows, DOCS + ", n_tokens int, IDS_SHA256 string")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.where("false").write.parquet(f"{tmp_path}/b/documents.parquet")
    bench = spark.createDataFrame([(1, "no such words anywhere at all")], "item_id bigint, text string")
    for d in "ab":
        bench.write.parquet(f"{tmp_path}/{d}/benchmark.parquet")
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, f"{tmp_path}/a").collect()}
    assert set(got) == {1, None, 5} and got[None].text.endswith("mail <EMAIL>") and got[1].n_tokens > 7 and got[5].n_chars == 200_000
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").collect() == []
