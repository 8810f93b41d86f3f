"""What the operators hold, ask and write stays within what their limits allow."""

from __future__ import annotations

import os
import random
import tracemalloc
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import bpe_stream, cross_parse, interpolated_lm, packing, range_coder


@cache
def spec() -> str:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def words(n: int) -> list[str]:
    r = random.Random(7)
    syllables = ["th", "an", "er", "tion", "ou", "é", "ß", "ing", "wh", "ş", "q", "on"]
    return ["".join(r.choices(syllables, k=r.randint(2, 8))) + r.choice(["", "", ",", "."]) for _ in range(n)]


def test_bpe_asks_few_substrings():
    class Asked(set):
        n = 0

        def __contains__(self, x):
            self.n += 1
            return super().__contains__(x)

    w, lib = bpe_stream.WordBpe(spec()), Tokenizer.from_str(spec())
    w.merges.whole = Asked(w.merges.whole)
    text = " ".join(words(2000))
    assert w.encode(text) == lib.encode(text, add_special_tokens=False).ids
    assert w.merges.whole.n < 2.5 * len(text)


def test_bpe_steps_back():
    """Where the longest token leads nowhere, shorter ones are taken, as the transducer does symbol by symbol."""
    w = bpe_stream.WordBpe(spec())
    r = random.Random(3)
    for _ in range(3000):
        word = "".join(bpe_stream.byte_symbols()[b] for b in "".join(r.choices("abcdeinorstéşж", k=r.randint(1, 24))).encode())
        t = bpe_stream.Transducer(w.merges)
        assert bpe_stream.at_once(w.merges, word) == [x for c in word for x in t.feed(c)] + t.finish(), word
    few = bpe_stream.MergeList({c: i for i, c in enumerate("abcd")}, [("b", "c"), ("a", "b"), ("bc", "d")])
    for word in ("abcd", "abab", "aabbccdd", "dcba", "abcabcd"):
        assert bpe_stream.at_once(few, word) == few.merge(list(word))[0]


def test_bpe_caches_are_small(monkeypatch):
    w, text = bpe_stream.WordBpe(spec()), " ".join(dict.fromkeys(words(20000)))
    w.digest("warm up")
    tracemalloc.start()
    w.digest(text)
    held = tracemalloc.get_traced_memory()[0] / len(text.split())
    tracemalloc.stop()
    assert 2 * bpe_stream.CACHED * held < 300e6  # two kept sets a worker, two workers an executor of 3 GB
    lib, expected = Tokenizer.from_str(spec()), w.digest(text)
    monkeypatch.setattr(bpe_stream, "CACHED", 100)
    w = bpe_stream.WordBpe(spec())
    assert w.digest(text) == expected and expected[0] == len(lib.encode(text, add_special_tokens=False).ids)
    assert len(w._known) + len(w._older) <= 200


@pytest.mark.parametrize("text", ["\U0001fae9 naïve\U0001fae9é x", "a\U00010d50b über \U0001fae9\U0001fae9"])
def test_bpe_words_from_the_library(text):
    """Characters newer than Python's tables, beside words of several bytes a character."""
    w, lib = bpe_stream.WordBpe(spec()), Tokenizer.from_str(spec())
    assert w.encode(text) == lib.encode(text, add_special_tokens=False).ids


def test_lm_keeps_no_hashes_twice(spark, monkeypatch):
    """Chunks with their counts take no more than chunks alone, as the words' hashes are left out; frequent words have short numbers."""
    sizes, tables, saved = {}, {}, interpolated_lm.saved

    def measured(df, name, **options):
        tables[name] = saved(df, name, **options)
        sizes[name] = sum(os.path.getsize(f.removeprefix("file://")) for f in tables[name].inputFiles())
        return tables[name]

    monkeypatch.setattr(interpolated_lm, "saved", measured)
    some = words(60000)
    docs = spark.createDataFrame([(i, " ".join(["x", "of", *some[100 * i : 100 * i + 100], "of"])) for i in range(600)], "doc_id bigint, text string").coalesce(1)
    got = interpolated_lm.scored(docs, F.col("doc_id") % 5 != 1).agg(F.sum("n_tokens")).first()[0]
    assert got == 600 * 104
    assert sizes["counted"] < sizes["chunks"] and "words" not in tables["counted"].columns
    r = tables["chunks"].first()
    assert sorted(interpolated_lm.Chunk(r.tokens, r.lens, r.train).tokens)[: 600 * 3] == [0] * 600 + [1] * 1200


@pytest.mark.parametrize("kind", ["uint32", "int64", "uint64"])
def test_planes(kind):
    for a in ([], [5], [0, 2**31, 3, 1, 2**32 - 1]):
        a = np.array(a, kind)
        assert (packing.unpack_planes(packing.pack_planes(a)) == a).all() and packing.unpack_planes(packing.pack_planes(a)).dtype == a.dtype


def test_language_workers_hold_little(spark):
    """workers get the automata's moves and do not build the automata; what they hold beside the tables follows LANES."""
    r = random.Random(4)
    text = lambda letters, n: "".join(r.choices(letters + "  ", k=n))
    samples = {k: [text(v, 4000) for _ in range(12)] for k, v in {"a": "abcdefghij", "b": "klmnopqrst", "c": "uvwxyzabcd"}.items()}
    docs, sent = spark.createDataFrame([(1, samples["a"][0])], "doc_id long, text string"), []
    put = type(spark.sparkContext).broadcast
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(spark.sparkContext), "broadcast", lambda self, x: sent.append(x) or put(self, x))
        assert cross_parse.identify(docs, samples).first().lang_pred == "a"
    texts = [text("abcdefghijklm", 4000) for _ in range(600)]
    want = cross_parse.CrossParser(samples).predict(texts)
    tracemalloc.start()
    try:
        p = cross_parse.CrossParser(sent[0])
        built = tracemalloc.get_traced_memory()[1]
        tables = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        assert p.predict(texts) == want
        used = tracemalloc.get_traced_memory()[1] - tables
    finally:
        tracemalloc.stop()
    assert built < 30e6, built
    assert used < 70e6, used


def test_bpe_words_leave_room():
    """the words that two workers keep, two sets each, leave the executor's room to its JVM."""
    w, text = bpe_stream.WordBpe(spec()), " ".join(dict.fromkeys(words(20000)))
    tracemalloc.start()
    try:
        w.digest(text)
        held = tracemalloc.get_traced_memory()[0] / len(w._known)
    finally:
        tracemalloc.stop()
    assert 4 * bpe_stream.CACHED * held < 300e6


def test_id_files_ask_once_for_each_piece():
    """a word alone, before a comma, at a line's end: the library's model is asked once for it, and the ids are the library's."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        whole = f.read()
    u, lib = range_coder.Units(whole), Tokenizer.from_str(whole)
    asked, model, r = [], u.model, random.Random(6)

    class Model:
        def tokenize(self, x):
            asked.append(x)
            return model.tokenize(x)

    u.model = Model()
    some = ["".join(r.choices("abcdeinorsté", k=7)) for _ in range(300)]
    texts = [f"Of {w} and {w}, not {w}.\nThe {w}'s {w}\n" for w in some]
    texts += ["".join(r.choices("abZ01 '\n.,_é", k=60)) for _ in range(300)] + [f"a {w}\n \nb 'll{w} <|endoftext|>{w} łα{w}" for w in some[:20]]
    ids, lens = u.encode(pa.array(texts), 2)
    assert ids.tolist() == [i for t in texts for i in [*lib.encode(t, add_special_tokens=False).ids, 2]] and lens.sum() == len(ids)
    assert max(map(asked.count, (u.blank + w.encode().decode("latin-1").translate(u.symbols) for w in some[20:]))) == 1
