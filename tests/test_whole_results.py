"""Governance and graph operators beyond what the registered queries show."""

import inspect

import pytest

from sparkloom.operators import governance, graph


def test_row_count_anomaly(spark):
    assets = "abcdefg"
    old = spark.createDataFrame([(x, "k", "int") for x in assets], "asset string, column_name string, type string")
    new = spark.createDataFrame([(x, "k", "INT") for x in assets[:-1] + "z"], "asset string, column_name string, type string")
    kind = "asset string, row_count bigint"
    was = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 100), ("d", 0), ("e", None), ("f", 10), ("g", 100), ("z", 1)], kind)
    now = spark.createDataFrame([("a", 400), ("b", 200), ("c", 150), ("d", 9), ("e", 9), ("f", None), ("g", 1), ("z", 9)], kind)
    got = governance.drift(old, new, was, now)
    odd = [(x, None, "row_count_anomaly", "warning") for x in "ab"]
    assert sorted(map(tuple, got.collect())) == [*odd, ("g", None, "table_dropped", "error")]
    modes = spark.createDataFrame([("a", "enforce"), ("g", "enforce")], "asset string, mode string")
    assert sorted(map(tuple, governance.enforced(got, modes).collect())) == [("a", "enforce", 1, False), ("b", "shadow", 1, False), ("g", "enforce", 1, True)]


def test_every_schema_match(spark):
    kind = "object string, row_count bigint, columns array<struct<name:string,type:string>>"
    cols = [("id", "int"), ("amount", "numeric")]
    a = spark.createDataFrame([("orders", None, cols), ("empty", 5, [])], kind)
    b = spark.createDataFrame([("orders", None, [("other", "int")]), ("orders_v2", None, cols), ("alone", None, [("z", "int")]), ("half", 7, [("ID", "numeric"), ("q", "text")])], kind)
    got = [tuple(x) for x in graph.match_scores(a, b, every=True).orderBy("rank").collect()]
    want = [("orders", 0.5 / 0.9), ("orders_v2", 0.4 / 0.9), ("half", (0.3 / 3 + 0.05) / 0.9)]
    assert got == [("orders", t, round(s, 6), n, False) for n, (t, s) in enumerate(want, 1)]
    counted = spark.createDataFrame([("x", 10, [("p", "int")])], kind)  # alike in their row counts only
    assert [tuple(x) for x in graph.match_scores(counted, b, every=True).collect()] == [("x", "half", 0.07, 1, False)]
    assert [x.target_object for x in graph.match_scores(a, b).collect()] == ["orders"]


@pytest.mark.parametrize("on_driver", [100_000, 0])
def test_reach_has_no_silent_end(spark, monkeypatch, on_driver):
    monkeypatch.setattr(graph, "DRIVER_EDGES", on_driver)
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(8)] + [("8", "5")], "source string, target string")
    assert inspect.signature(graph.reach).parameters["limit"].default is None
    monkeypatch.setattr(graph, "CUT_LEVELS", 3, raising=False)
    assert sorted(map(tuple, graph.reach(edges, "0").collect())) == [(str(i), i) for i in range(1, 9)]
    assert graph.reach(edges, "0", limit=8).count() == 8 and graph.reach(edges, "0", depth=2, limit=1).count() == 2
    with pytest.raises(RuntimeError):
        graph.reach(edges, "0", limit=7)


def test_long_chain(spark):
    edges = spark.range(1500).selectExpr("cast(id as string) as source", "cast(id + 1 as string) as target")
    assert graph.reach(edges, "0").count() == 1500
    assert graph.reach(edges, "1500", down=False).count() == 1500
    assert graph.reach(edges, "0", depth=0).count() == 0
