"""The SQL front end, the prover and folding, against hand-made cases and brute force."""

import itertools
import random

import pytest

from sparkloom.functions import sqltext
from sparkloom.plans import builder, folding, ir, parser, proof, rewrites
from sparkloom.plans import expr as X
from sparkloom.plans.expr import SqlError


@pytest.mark.parametrize(
    "text",
    ["a + b * c - 1", "a - (b - c)", "NOT (a = 1 OR b < 2) AND c >= 1", "x IN (1, 2, 'a''b') AND NOT y LIKE '%x'", "CASE a WHEN 1 THEN 'x' END", "CASE WHEN a > 1 THEN 'x' ELSE y END", "sum(x) OVER (PARTITION BY a, b ORDER BY c DESC ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)", "CAST(a AS decimal(10,2))", "extract(year FROM d) = 2020", "count(DISTINCT a)", "-a * 2", "t.`Col x` = 3", "NOT a IS NULL", "EXISTS (SELECT 1 FROM t)", "x IN (SELECT y FROM t)", "string_agg(a, ',') WITHIN GROUP (ORDER BY b)", "(a OR b) AND c", "a % 2 = 0", "a || 'x' || b", "DATE '2020-01-01' < d"],
)
def test_print_and_parse(text):
    e = X.parse(text)
    assert X.parse(X.to_text(e)) == e


def test_bad_text_raises():
    for t in ("a +", "SELECT", "a AND", "f(", "a = = b", "'open"):
        with pytest.raises(SqlError):
            X.parse(t)


@pytest.mark.parametrize(
    "sql,tables",
    [
        ("SELECT EXTRACT(year FROM ts) FROM a", ["a"]),
        ("SELECT 'copied from box' FROM c, d", ["c", "d"]),
        ('WITH c AS (SELECT * FROM x) SELECT * FROM c JOIN "My".tbl t ON 1 = 1', ["x", "my.tbl"]),
        ("INSERT INTO s SELECT * FROM o a, (SELECT * FROM z, y) q LEFT JOIN w ON true", ["o", "z", "y", "w"]),
        ("SELECT * FROM `proj-a.ds.tab` JOIN information_schema.x ON 1 = 1", ["proj-a.ds.tab"]),
        ("SELECT * FROM proj-a.ds.tab", ["proj-a.ds.tab"]),
        ("SELECT * FROM t -- FROM u\n WHERE a IN (SELECT b FROM v) /* JOIN w */", ["t", "v"]),
        ("SELECT a FROM t, LATERAL unnest(t.xs) AS x", ["t"]),
        ("SELECT trim(both FROM a) FROM t ORDER BY x, y", ["t"]),
        ("SELECT a IS DISTINCT FROM b FROM t", ["t"]),
        ("", []),
    ],
)
def test_table_references(sql, tables):
    assert parser.table_refs(sql) == tables


def test_statements():
    of = lambda s: (parser.inspect(s).kind, parser.inspect(s).target, parser.inspect(s).sources)
    assert of("MERGE INTO t USING s ON t.a = s.a WHEN MATCHED THEN UPDATE SET x = 1") == ("merge", "t", ("s",))
    assert of("UPDATE c SET x = 1") == ("update", "c", ())
    assert of("DELETE FROM c WHERE a IN (SELECT b FROM d)") == ("delete", "c", ("d",))
    assert of("CREATE TABLE IF NOT EXISTS a.b AS SELECT * FROM c") == ("create", "a.b", ("c",))
    assert of("INSERT INTO t (a, b) SELECT 1, 2 FROM u") == ("insert", "t", ("u",))
    assert of("WITH x AS (SELECT * FROM y) INSERT INTO t SELECT * FROM x") == ("insert", "t", ("y",))
    assert of("BEGIN") == ("transaction", None, ())
    assert parser.inspect("SELECT 'a--b' AS x, z FROM t1").query == "SELECT 'a--b' AS x, z FROM t1"
    assert parser.normalized("SELECT 'a--b' AS x, z FROM t1 -- hi\n WHERE a=1.5") == "SELECT ? AS x, z FROM t1 WHERE a=?"


def test_normalized_and_names(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("SELECT 'a--b' AS x, z FROM t1",), ("select /* 'q' */ 1 -- it's",), ("select 'it''s' , 2.5",)], "s string")
    assert [r[0] for r in rows.select(sqltext.normalized(F.col("s"))).collect()] == ["select ? as x, z from t1", "select ?", "select ? , ?"]
    names = {"backoffice-local": "backoffice", "api-sandbox": "api", "api-testing": "api", "app-2.5": "app", "svc:8080": "svc:8080", "team-qa": "team-qa", "appv2": "appv2", "Backoffice-v2:production": "backoffice", "-prod": "-prod"}
    got = spark.createDataFrame([(n,) for n in names], "s string").select("s", sqltext.consumer_name(F.col("s"))).collect()
    assert dict(map(tuple, got)) == names


def _random_condition(r, depth=2):
    if depth == 0 or r.random() < 0.4:
        c = X.col(r.choice("xy"))
        k = r.random()
        if k < 0.6:
            return X.E(r.choice(X.COMPARISONS), (c, X.lit(r.randrange(4))))
        if k < 0.7:
            return X.E("in", (c, *(X.lit(v) for v in r.sample(range(4), 2))))
        if k < 0.8:
            return X.E("is null", (c,))
        if k < 0.9:
            return X.E(r.choice(("<", "=", ">=")), (X.E("+", (X.col("x"), X.col("y"))), X.lit(r.randrange(6))))
        return X.E("not", (_random_condition(r, 0),))
    return X.E(r.choice(("and", "or")), tuple(_random_condition(r, depth - 1) for _ in range(2)))


def test_implication_is_sound():
    r = random.Random(11)
    values = [None, *(v / 2 for v in range(-2, 12))]
    grid = [{(None, "x"): a, (None, "y"): b} for a, b in itertools.product(values, values)]
    seen = {proof.PROVED: 0, proof.REFUTED: 0, proof.UNKNOWN: 0}
    for _ in range(1500):
        p, q = _random_condition(r), _random_condition(r)
        verdict = proof.implication(p, q)
        against = any(proof.evaluate(p, g) is True and proof.evaluate(q, g) is not True for g in grid)
        seen[verdict] += 1
        assert not (verdict == proof.PROVED and against), (str(p), str(q))
        seen[proof.UNKNOWN, against] = seen.get((proof.UNKNOWN, against), 0) + (verdict == proof.UNKNOWN)
    assert seen[proof.PROVED] > 100 and seen[proof.REFUTED] > 500 and seen[proof.UNKNOWN, True] < 15, seen


def test_relaxation_holds_both():
    r = random.Random(12)
    for _ in range(300):
        a, b = ([_random_condition(r, 0) for _ in range(2)] for _ in range(2))
        out = X.all_of(proof.relaxed(a, b))
        for side in (a, b):
            assert proof.implication(X.all_of(side), out) != proof.REFUTED, (list(map(str, a)), list(map(str, b)), str(out))


def test_negations_and_nulls():
    assert proof.implies("x > 3", "x IS NOT NULL") and not proof.implies("x > 3 OR x IS NULL", "x IS NOT NULL")
    assert proof.implies("NOT (x <= 5 OR y IS NULL)", "x > 4") and proof.implies("x > 5 AND x < 3", "z = 1")
    assert proof.implication(X.parse("f(x) > 1"), X.parse("f(x) > 0")) == proof.UNKNOWN


def test_containment_needs_the_reverse_map():
    cq = lambda s: proof.conjunctive(parser.to_algebra(s))
    small, large = cq("SELECT a.x FROM t a JOIN u b ON a.k = b.k"), cq("SELECT a.x FROM t a")
    assert proof.contained(small, large) and not proof.contained(large, small)
    with pytest.raises(proof.NotConjunctive):
        cq("SELECT count(*) AS n FROM t")


def test_folding_refuses_what_the_view_lacks():
    view = parser.to_algebra("SELECT o.k, o.price FROM orders o WHERE o.price > 10")
    of = lambda q: folding.fold(parser.to_algebra(q), view, "v")
    assert of("SELECT o.k FROM orders o WHERE o.price > 20").coverage == folding.FULL
    assert of("SELECT o.k FROM orders o WHERE o.price > 5").plan is None
    assert of("SELECT o.other FROM orders o WHERE o.price > 20").plan is None
    assert of("SELECT n.a FROM nation n").coverage == folding.NONE
    left = of("SELECT o.k FROM orders o LEFT JOIN nation n ON o.k = n.k WHERE o.price > 20")
    assert left.plan is None
    grouped = folding.fold(parser.to_algebra("SELECT k, sum(price) AS s FROM orders WHERE price > 20 GROUP BY k"), view, "v")
    assert grouped.plan is not None
    assert folding.best_fold(parser.to_algebra("SELECT o.k FROM orders o WHERE o.price > 20"), {"v": view, "n": parser.to_algebra("SELECT n.a FROM nation n")})[0] == "v"


def test_decorrelation_refuses_correlated_aggregates():
    with pytest.raises(rewrites.NotDecorrelated):
        rewrites.decorrelate(parser.to_algebra("SELECT a FROM t WHERE a > (SELECT max(b) FROM u WHERE u.k = t.k)"))


def test_roll_up_over_nothing_counts_zero(spark):
    fine = ir.Aggregate(ir.Scan("t"), (("k", "k"),), (("count(*)", "n"),))
    coarse = ir.Aggregate(ir.Scan("t"), (), (("count(*)", "n"),))
    node = ir.roll_up(coarse, fine, ir.Scan("fine"))
    empty = spark.createDataFrame([], "k int, n bigint")
    assert ir.to_dataframe(node, lambda t: empty).collect()[0][0] == 0


def test_builder_and_errors():
    q = builder.from_("t").where("a > 1 AND b = 2").select("a", c="b + 1").order_by("a DESC").limit(3, 1)
    assert q.sql() == "SELECT a AS a, b + 1 AS c FROM t WHERE (a > 1) AND (b = 2) ORDER BY a DESC NULLS LAST LIMIT 3 OFFSET 1"
    with pytest.raises(ValueError):
        q.sql("cobol")
    assert ir.to_sql(parser.to_algebra("SELECT a FROM t LEFT ANTI JOIN u ON t.a = u.a"), "postgres").count("NOT EXISTS") == 1
