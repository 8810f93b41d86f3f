"""What must not grow faster than the corpus: texts compared, rows of one task, bytes exchanged."""

import random

import numpy as np

from sparkloom.llm import store, suffix_merge, token_group_join


def test_jaccard_pairs_of_shared_passages(spark, monkeypatch):
    """Documents that share a passage but do not link are told apart before their texts travel, and links stay."""
    r = random.Random(5)
    own = lambda i, n: " ".join(f"d{i}x{k}" for k in range(n))
    texts = [(i, f"{own(i, 100)} the same few words stand in all of them as notices do and {own(i + 1000, 40)}") for i in range(60)]
    texts += [(500 + i, t.replace(f"d{i}x50", "edited", 1)) for i, t in texts[:5]]
    r.shuffle(texts)
    asked = []
    verified = token_group_join._verified
    monkeypatch.setattr(token_group_join, "SLOT_BITS", 6)  # no shingle looks rare
    monkeypatch.setattr(token_group_join, "_BLOCKS", 4)
    monkeypatch.setattr(token_group_join, "_verified", lambda pairs, *a: (asked.append(pairs.count()), verified(pairs, *a))[1])
    got = {x.doc_id: x.component_id for x in token_group_join.jaccard_components(spark.createDataFrame(texts, "doc_id bigint, text string"), 4, 85).collect()}
    assert got == {i: i - 500 if i >= 500 else i for i, _ in texts}
    assert sum(asked) <= 20


def test_parity_bitmaps_reject_no_link():
    r = np.random.default_rng(1)
    for percent in (80, 85, 100):
        told = 0
        for _ in range(400):
            base = r.integers(0, 1 << 63, int(r.integers(1, 300))).astype(np.uint64)
            a, b = (np.unique(np.concatenate([base[r.random(len(base)) < 0.96], r.integers(0, 1 << 63, int(r.integers(0, 9))).astype(np.uint64)])) for _ in range(2))
            if len(a) and len(b):
                may = token_group_join.may_link(len(a), len(b), token_group_join.parity(a), token_group_join.parity(b), percent)
                assert may or not token_group_join.linked(len(np.intersect1d(a, b)), len(a), len(b), percent)
                other = r.integers(0, 1 << 63, len(a)).astype(np.uint64)
                told += not token_group_join.may_link(len(a), len(a), token_group_join.parity(a), token_group_join.parity(np.unique(other)), percent)
        assert told > 330


def test_texts_of_ids(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "cast(id as string) as text")
    ids = spark.range(0, 5000, 50).selectExpr("id as doc_id")
    got = {x.doc_id for x in store.texts_of(docs, ids).collect()}
    assert set(range(0, 5000, 50)) <= got and len(got) < 1500
    assert store.texts_of(docs, ids.where("doc_id < 0")).count() == 0


def test_suffix_ranges_are_even():
    """The keys of many texts fall into all hash ranges alike, however many ranges there are."""
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randrange(2, 9))) for _ in range(3000)]
    keys = np.concatenate([suffix_merge.anchors(" ".join(r.choices(words, k=400)).encode())[1] for _ in range(200)])
    for n in (12, 51, 600):
        met = np.bincount(suffix_merge._bucket(keys, n), minlength=n)
        assert met.min() > 0 and met.max() < 2.5 * met.mean()
