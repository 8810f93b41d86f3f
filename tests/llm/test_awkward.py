"""All ten queries on a table with null keys, empty, null and very long texts, repeated rows and clashing columns, and on empty tables."""

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import queries

EXTRA = {"n_tokens": "x", "score": "x", "fingerprint": "x", "bucket": "x", "component_id": "x", "lang_pred": "x", "held_out": "x", "cuts": "x", "spans": "x", "rep": "x", "cur": "x", "__text": "x"}
LONG = "Der schnelle braune Fuchs springt. call (555) 123-4567 " * 4000 + "z" * 300_000
TEXTS = [(1, "the quick brown fox jumps over the lazy dog " * 9), (1, "the quick brown fox jumps over the lazy dog " * 9), (None, "mail a.b@c.de now"), (None, None), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, LONG), (7, "12 34 !"), (-8, "the quick brown fox jumps over the lazy dog " * 9 + "end"), (9, "É́ 日本 \U0001f600 \x00 \x1c tail")]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("awkward")
    docs = spark.createDataFrame([(i, t, "en" if k % 2 else None, "s", 0) for k, (i, t) in enumerate(TEXTS)], "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({k: F.lit(v) for k, v in EXTRA.items()})
    bench = spark.createDataFrame([(None, "quick brown fox jumps over the lazy dog the quick"), (1, None), (1, ""), (2, "no such item")], "item_id bigint, text string").withColumn("distance", F.lit("x"))
    pages = spark.createDataFrame([(1, "http://a.example.com/en/7x"), (1, "http://a.example.com/en/7x"), (None, None), (2, "http://h/" + "y" * 500_000)], "page_id bigint, url string").withColumns({"host": F.lit("x"), "rule": F.lit("x")})
    for name, df in (("documents", docs), ("benchmark", bench), ("pages", pages)):
        df.write.parquet(f"{root}/full/{name}.parquet")
        df.where("false").write.parquet(f"{root}/none/{name}.parquet")
    return f"{root}/full", f"{root}/none"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_awkward_rows(spark, folders, name):
    got = queries.QUERIES[name](spark, folders[0]).collect()
    if name.startswith("op3"):
        assert {(r.doc_id, r.item_id) for r in got} == {(1, None), (-8, None)}
        return
    if name.startswith("op9"):
        assert sorted((str(r.page_id), r.verdict) for r in got) == [("1", "allow"), ("1", "allow"), ("2", "allow"), ("None", "allow")]
        return
    assert sorted((str(r.doc_id) for r in got)) == sorted(str(i) for i, _ in TEXTS)
    if name.startswith("op7"):
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {1: -8, -8: -8, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 9: 9}
    if name.startswith("op8"):
        gone = {r.doc_id: r.n_removed for r in got if r.doc_id is not None}
        assert gone[6] == len(LONG.encode()) and gone[5] == 0 and gone[1] > 0 and gone[-8] == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, folders, name):
    assert queries.QUERIES[name](spark, folders[1]).collect() == []
