"""Queries of the SQL front end, the rewrites, the prover, folding and workload learning. Facts about plans come as rows; plans are run against the same SQL in DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import workload
from .plans import builder, folding, ir, parser, proof, rewrites
from .plans import expr as X
from .queries import ORACLES, QUERIES, _query, run_sql

CATALOG = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"),
}


def _values(rows: list[tuple], *names: str) -> str:
    """VALUES of Python rows for DuckDB."""
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v}::BIGINT" if isinstance(v, int) else f"{v}::DOUBLE"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


def _facts(name: str, schema: str, found, expected: list[tuple]) -> None:
    """Rows that plain Python finds out about plans."""
    QUERIES[name] = lambda s, d: s.createDataFrame(found(), schema)
    ORACLES[name] = _values(expected, *(c.strip().split()[0] for c in schema.split(",")))


def _run(name: str, node: ir.Node, oracle: str) -> None:
    QUERIES[name] = lambda s, d: ir.to_dataframe(node, ir.tables_of(s, d))
    ORACLES[name] = oracle


# ---- SQL text

_Q3 = "WITH big AS (SELECT * FROM customer WHERE c_acctbal > 0) SELECT c.c_mktsegment AS segment, round(sum(o.o_totalprice) / count(*), 2) AS mean, count(DISTINCT o.o_custkey) AS buyers FROM big c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus IN ('F', 'O') AND NOT o.o_totalprice BETWEEN 1000 AND 2000 GROUP BY c.c_mktsegment HAVING count(*) > 3 ORDER BY segment"
_run("T01_sql_to_algebra", parser.to_algebra(_Q3), _Q3)
_USING = "SELECT n.n_name, k.total FROM nation n JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS total FROM customer GROUP BY 1) k USING (n_nationkey) WHERE n.n_regionkey = 1 OR n.n_name LIKE 'NATION_1%'"
_run("T01_using_and_subquery", parser.to_algebra(_USING), _USING)

# single features of the language, through the same front end
for _name, _text in {
    "P06_column_reference": "SELECT o.o_orderkey, o_custkey FROM orders o WHERE o.o_custkey < 50",
    "A04_count": "SELECT count(*) AS n, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f FROM orders",
    "A06_sum": "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_orderstatus",
    "W01_window": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders",
    "W02_partition_and_order": "SELECT o_orderkey, max(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) AS top FROM orders",
    "W10_window_in_expression": "SELECT c_custkey, round(c_acctbal - min(c_acctbal) OVER (PARTITION BY c_nationkey), 2) AS above FROM customer",
    "O02_sort_direction": "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 25",
    "O04_limit": "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 9",
    "F02_modulo": "SELECT o_orderkey, o_custkey % 7 AS r FROM orders",
    "F05_function_call": "SELECT n_nationkey, concat(upper(substr(n_name, 1, 3)), lpad(CAST(n_regionkey AS VARCHAR(3)), 3, '0')) AS code FROM nation",
    "F13_nullif": "SELECT n_nationkey, nullif(n_regionkey, 2) AS r FROM nation",
}.items():
    _run(_name, parser.to_algebra(_text), _text)

_WIDE = parser.to_algebra("SELECT DISTINCT ON (o.o_custkey) o.o_custkey, o.o_orderkey FROM orders o LEFT SEMI JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 5000 ORDER BY o.o_custkey, o.o_totalprice DESC, o.o_orderkey")


@_query("T04_emit_spark", ir.to_sql(_WIDE, "duckdb"))
def _t04(spark, d):
    """The Spark text of a plan; DuckDB runs the plan's text in its own dialect."""
    return run_sql(spark, d, ir.to_sql(_WIDE, "spark"))


_LIST = parser.to_algebra("SELECT n_regionkey, string_agg(CAST(n_nationkey AS STRING), ',' ORDER BY n_nationkey) AS ks, substring(max(n_name), 1, 4) AS head FROM nation GROUP BY n_regionkey")


@_query("T05_dialects", "SELECT n_regionkey, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS ks, substr(max(n_name), 1, 4) AS head FROM nation GROUP BY n_regionkey")
def _t05(spark, d):
    return run_sql(spark, d, ir.to_sql(_LIST, "spark"))


_BUILT = builder.from_("customer", "c").join("orders", "c.c_custkey = o.o_custkey", "o").where("o.o_totalprice > 1000 AND c.c_acctbal > 0").group_by(segment="c.c_mktsegment").agg(n="count(*)", top="max(o.o_totalprice)").having("n > 2").order_by("n DESC", "segment").limit(3)
_run("T06_builder", _BUILT.plan(), _BUILT.sql("duckdb"))
_OUTER = builder.from_("nation", "n").left_join("supplier", "s.s_nationkey = n.n_nationkey AND s.s_acctbal > 9000", "s").select("n.n_name", "s.s_suppkey")
_run("J14_builder_joins", _OUTER.plan(), "SELECT n.n_name, s.s_suppkey FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 9000")

_BOUND = "SELECT x.seg, x.n, c_name FROM (SELECT c.c_mktsegment AS seg, count(o.o_orderkey) AS n FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment) x JOIN customer k ON k.c_mktsegment = x.seg WHERE EXISTS (SELECT 1 FROM orders z WHERE z.o_custkey = k.c_custkey)"
_facts("T02_bind", "output string, source string", lambda: [(b.name, f"{t}.{c}") for b in parser.bind(parser.to_algebra(_BOUND), CATALOG) for t, c in b.sources], [("seg", "customer.c_mktsegment"), ("n", "orders.o_orderkey"), ("c_name", "customer.c_name")])


def _errors(*texts: str) -> list[tuple[str, str]]:
    out = []
    for t in texts:
        try:
            parser.bind(parser.to_algebra(t), CATALOG)
            out.append((t, "bound"))
        except X.SqlError as e:
            out.append((t, str(e)))
    return out


_facts(
    "T03_scopes", "query string, answer string",
    lambda: _errors("SELECT n_name FROM nation", "SELECT nope FROM nation", "SELECT c_custkey FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey", "SELECT x FROM a", "WITH a AS (SELECT n_name AS x FROM nation) SELECT x FROM a", "SELECT n.n_name FROM nation n WHERE n.n_regionkey IN (SELECT r_regionkey FROM region r WHERE r.r_name = n.n_name)"),
    [("SELECT n_name FROM nation", "bound"), ("SELECT nope FROM nation", "no column nope"), ("SELECT c_custkey FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey", "column c_custkey is ambiguous"), ("SELECT x FROM a", "no table a"), ("WITH a AS (SELECT n_name AS x FROM nation) SELECT x FROM a", "bound"), ("SELECT n.n_name FROM nation n WHERE n.n_regionkey IN (SELECT r_regionkey FROM region r WHERE r.r_name = n.n_name)", "bound")],
)

_LINE = "SELECT o.o_custkey AS who, sum(o.o_totalprice * 2) AS paid, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY o.o_custkey, c.c_name"
_edges = lambda sql: [(e.source_table, e.source_column, e.target_column, parser.lineage_method(sql)) for e in parser.column_edges(sql)]
_facts("T11_column_lineage", "source string, source_column string, target string, method string", lambda: _edges(_LINE), [("orders", "o_custkey", "who", "column"), ("orders", "o_totalprice", "paid", "column"), ("customer", "c_name", "c_name", "column")])
_facts("T12_column_edges", "query string, edges bigint", lambda: [(q, len(parser.column_edges(q))) for q in ("SELECT * FROM orders", "SELECT a, b + c AS d FROM t", "SELECT a FROM t, u", "WITH x AS (SELECT 1 AS a) SELECT x.a FROM x", "SELECT count(*) AS n, max(t.a) AS m FROM t")], [("SELECT * FROM orders", 0), ("SELECT a, b + c AS d FROM t", 3), ("SELECT a FROM t, u", 0), ("WITH x AS (SELECT 1 AS a) SELECT x.a FROM x", 0), ("SELECT count(*) AS n, max(t.a) AS m FROM t", 1)])
_facts("T13_names", "raw string, schema_name string, bare string", lambda: [(n, parser.qualified(n)[1], parser.bare(n)) for n in ("a", "s.T", '"My Db"."S"."T.x"', "`p.q`.r")], [("a", None, "a"), ("s.T", "s", "t"), ('"My Db"."S"."T.x"', "S", "t.x"), ("`p.q`.r", "p.q", "r")])
_facts("T14_quoting", "dialect string, text string", lambda: [(k, parser.quoted("s.T x", k)) for k in ("spark", "postgres")] + [("spark", parser.quoted("a`b"))], [("spark", "`s`.`T x`"), ("postgres", '"s"."T x"'), ("spark", "`a``b`")])

# ---- predicates and plans

_facts("P19_atoms", "condition string, atom string", lambda: [(t, str(a)) for t in ("a > 1 AND (b = 2 OR c = 3) AND NOT d = 4 AND e IN (1, 2)",) for a in X.atoms(X.parse(t))], [("a > 1 AND (b = 2 OR c = 3) AND NOT d = 4 AND e IN (1, 2)", "a > 1"), ("a > 1 AND (b = 2 OR c = 3) AND NOT d = 4 AND e IN (1, 2)", "e IN (1, 2)")])
_facts("P20_fingerprint", "pair string, same boolean", lambda: [(f"{a} | {b}", X.fingerprint(X.parse(a)) == X.fingerprint(X.parse(b))) for a, b in (("a = 1 AND b > 2", "2 < B AND A = 1"), ("x IN (2, 1)", "x in (1, 2, 1)"), ("a < b", "a <= b"))], [("a = 1 AND b > 2 | 2 < B AND A = 1", True), ("x IN (2, 1) | x in (1, 2, 1)", True), ("a < b | a <= b", False)])
_BOUND_PREDICATES = "SELECT count(*) AS n FROM orders o WHERE (o.o_totalprice > 1000 OR o.o_orderstatus LIKE 'F%') AND o.o_custkey IS NOT NULL AND o.o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT o.o_totalprice BETWEEN 5000 AND 6000"
_run("P18_bound_predicates", parser.to_algebra(_BOUND_PREDICATES), _BOUND_PREDICATES)
_JOINED = parser.to_algebra("SELECT 1 AS one FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_quantity > 5 WHERE c.c_nationkey = 3")
_facts("J12_join_graph", "a string, ac string, b string, bc string, how string", lambda: [(e.left, e.left_column, e.right, e.right_column, e.how) for e in rewrites.join_graph(_JOINED)], [("c", "c_custkey", "o", "o_custkey", "inner"), ("l", "l_orderkey", "o", "o_orderkey", "left")])
_facts("J13_simple_join_graph", "a string, b string, predicate string", lambda: rewrites.simple_join_graph(_JOINED), [("c", "o", "c.c_custkey = o.o_custkey"), ("l", "o", "l.l_orderkey = o.o_orderkey")])
_facts("A15_grain", "query string, grain string", lambda: [(q, ",".join(ir.grain(parser.to_algebra(q)))) for q in ("SELECT a, b, count(*) AS n FROM t GROUP BY a, b ORDER BY n", "SELECT a FROM t")], [("SELECT a, b, count(*) AS n FROM t GROUP BY a, b ORDER BY n", "a,b"), ("SELECT a FROM t", "")])
_TOP = "SELECT o_custkey, sum(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey ORDER BY s DESC, o_custkey LIMIT 7"
_layers, _core = builder.peeled(parser.to_algebra(_TOP))
_run("O07_peel_and_wrap", builder.wrapped(_layers, rewrites.flatten_inner(_core)), _TOP)
_facts("X01_visitor", "kind string, n bigint", lambda: sorted({k: v.count(k) for v in [builder.Collector(lambda n: [type(n).__name__]).visit(_JOINED)] for k in v}.items()), [("Filter", 1), ("Join", 2), ("Project", 1), ("Scan", 3)])

_NESTED = ir.Filter(ir.Filter(ir.Scan("orders"), ("o_totalprice > 1000", "o_orderstatus = 'F'")), ("o_custkey < 100", "o_orderstatus = 'F'"))
_run("R01_merge_filters", ir.merge_filters(_NESTED), "SELECT * FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F' AND o_custkey < 100")
_CHAIN = "SELECT c.c_name, o.o_orderkey, n.n_name FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE o.o_totalprice > 200000 AND n.n_regionkey = 2"
_run("R02_flatten_joins", rewrites.flatten_inner(parser.to_algebra(_CHAIN)), _CHAIN)
_run("R03_canonical_order", rewrites.canonical_joins(parser.to_algebra(_CHAIN)), _CHAIN)
_facts("R04_predicates", "joins boolean, predicate string", lambda: [(j, str(p)) for j in (False, True) for p in rewrites.predicates(_JOINED, j)], [(False, "c.c_nationkey = 3"), (True, "c.c_nationkey = 3"), (True, "c.c_custkey = o.o_custkey")])
_facts("R05_quick_implication", "p string, q string, yes boolean", lambda: [(p, q, rewrites.implies_quickly(X.parse(p), X.parse(q))) for p, q in (("a = 1 AND b = 2", "b = 2"), ("a = 1", "a = 1 OR c = 3"), ("a = 2", "a > 1"))], [("a = 1 AND b = 2", "b = 2", True), ("a = 1", "a = 1 OR c = 3", True), ("a = 2", "a > 1", False)])
_CORRELATED = "SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P') AND c.c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) AND c.c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9900) AND c.c_acctbal > (SELECT avg(c_acctbal) / 2 FROM customer)"
_run("R06_decorrelate", parser.to_algebra(_CORRELATED), _CORRELATED)
_facts("R07_correlation_split", "side string, conjunct string", lambda: [(s, c) for s, cs in zip(("outer", "own"), rewrites.split_correlated(("o.o_custkey = c.c_custkey", "o.o_totalprice > 5", "c.x = 1"), {"o"}), strict=True) for c in cs], [("outer", "o.o_custkey = c.c_custkey"), ("outer", "c.x = 1"), ("own", "o.o_totalprice > 5")])

# ---- proofs: the verdict, and how many rows of orders stand against it


def _implications(name: str, pairs: list[tuple[str, str, str]]) -> None:
    def found(spark, d):
        rows = run_sql(spark, d, "SELECT * FROM orders")
        against = rows.agg(*(F.count_if(F.coalesce(F.expr(p), F.lit(False)) & ~F.coalesce(F.expr(q), F.lit(False))).alias(f"n{i}") for i, (p, q, _) in enumerate(pairs)))
        cells = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), F.lit(proof.implication(X.parse(p), X.parse(q))).alias("verdict"), F.col(f"n{i}").alias("against")) for i, (p, q, _) in enumerate(pairs)))
        return against.select(F.explode(cells).alias("x")).select("x.*")

    quote = lambda t: "'" + t.replace("'", "''") + "'"
    QUERIES[name] = found
    ORACLES[name] = " UNION ALL ".join(f"SELECT {quote(p)} AS p, {quote(q)} AS q, '{v}' AS verdict, count(*) FILTER (coalesce({p}, false) AND NOT coalesce({q}, false)) AS against FROM orders" for p, q, v in pairs)


_implications("C01_implication", [("o_totalprice > 5000 AND o_orderstatus = 'F'", "o_totalprice > 4000", "proved"), ("o_totalprice > 1000", "o_totalprice > 200000", "refuted"), ("o_orderstatus = 'F' OR o_orderstatus = 'O'", "o_orderstatus IN ('F', 'O', 'P')", "proved"), ("o_orderpriority LIKE '1-U%'", "o_orderpriority LIKE '1%'", "proved"), ("o_totalprice > 5", "o_totalprice IS NOT NULL", "proved"), ("length(o_orderstatus) > 0", "length(o_orderstatus) > 1", "unknown")])
_implications("C02_ranges_and_lists", [("o_custkey BETWEEN 10 AND 20", "o_custkey >= 10 AND o_custkey < 21", "proved"), ("o_custkey IN (3, 4)", "o_custkey IN (4, 3, 9)", "proved"), ("o_custkey IN (3, 4)", "o_custkey BETWEEN 3 AND 4", "proved"), ("NOT o_custkey > 7", "o_custkey <= 7", "proved"), ("o_custkey NOT IN (1, 2)", "o_custkey <> 2", "proved")])
_implications("C03_linear_arithmetic", [("o_totalprice + o_custkey > 500 AND o_custkey < 100", "o_totalprice > 400", "proved"), ("2 * o_custkey < 20", "o_custkey < 10", "proved"), ("o_totalprice > 7", "o_totalprice + o_custkey > 9000", "refuted")])
_implications("C04_patterns_and_nulls", [("o_orderpriority = '5-LOW'", "o_orderpriority LIKE '%LOW'", "proved"), ("o_orderpriority LIKE '%LOW'", "o_orderpriority LIKE '%OW'", "proved"), ("o_custkey IS NULL", "o_custkey > 1", "refuted"), ("o_custkey <> 1", "o_custkey IS NOT NULL", "proved")])

_SPJ = "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 150000 AND c.c_acctbal > 0"
_run("C05_conjunctive", proof.algebra(proof.conjunctive(parser.to_algebra(_SPJ))), _SPJ)
_PAIRS = [("SELECT o.o_custkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 200000", "SELECT x.o_custkey FROM orders x WHERE x.o_totalprice > 100000"), ("SELECT x.o_custkey FROM orders x WHERE x.o_totalprice > 100000", "SELECT x.o_custkey FROM orders x WHERE x.o_orderstatus = 'F'"), ("SELECT a.o_custkey FROM orders a, orders b WHERE a.o_orderkey = b.o_orderkey AND b.o_orderstatus = 'F'", "SELECT x.o_custkey FROM orders x")]
_CONTAINED = [True, False, True]


@_query("C06_containment", " UNION ALL ".join(f"SELECT {i}::BIGINT AS pair, {str(v).lower()} AS contained, (SELECT count(*) FROM (({a}) EXCEPT ({b}))) AS missing" for i, ((a, b), v) in enumerate(zip(_PAIRS, _CONTAINED, strict=True))))
def _c06(spark, d):
    """Verdicts, and the rows of the first query that the second lacks."""
    q = lambda t: parser.to_algebra(t)
    out = None
    for i, (a, b) in enumerate(_PAIRS):
        lost = ir.to_dataframe(ir.SetOp(q(a), q(b), "except"), ir.tables_of(spark, d)).agg(F.count("*").alias("missing"))
        part = lost.select(F.lit(i).cast("bigint").alias("pair"), F.lit(proof.contained(proof.conjunctive(q(a)), proof.conjunctive(q(b)))).alias("contained"), "missing")
        out = part if out is None else out.unionByName(part)
    return out


_ONE, _TWO = "SELECT o.o_orderkey, o.o_custkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 200000 AND c.c_acctbal > 100 AND o.o_orderstatus = 'F'", "SELECT z.o_orderkey, z.o_custkey FROM orders z JOIN customer k ON z.o_custkey = k.c_custkey WHERE z.o_totalprice BETWEEN 150000 AND 300000 AND z.o_orderstatus = 'O'"
_cq = lambda t: proof.conjunctive(parser.to_algebra(t))
_run("C07_common_part", proof.algebra(proof.common_part(_cq(_ONE), _cq(_TWO))), "SELECT o.o_orderkey, o.o_custkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice >= 150000 AND o.o_orderstatus IN ('F', 'O')")
_run("C07_meet", proof.algebra(proof.meet(_cq(_ONE), _cq(_TWO.replace("'O'", "'F'")))), _ONE + " AND o.o_totalprice <= 300000")
_facts("C08_relaxation", "a string, b string, hull string", lambda: [(a, b, str(X.all_of(proof.relaxed(X.conjuncts(X.parse(a)), X.conjuncts(X.parse(b)))))) for a, b in (("x > 5 AND y = 1", "x >= 3 AND y = 2"), ("x BETWEEN 1 AND 4", "x BETWEEN 3 AND 9"), ("x = 1", "z = 1"))], [("x > 5 AND y = 1", "x >= 3 AND y = 2", "x >= 3 AND y IN (1, 2)"), ("x BETWEEN 1 AND 4", "x BETWEEN 3 AND 9", "x >= 1 AND x <= 9"), ("x = 1", "z = 1", "TRUE")])
_facts("C09_equivalence", "pair bigint, how string", lambda: [(i, proof.equivalent(parser.to_algebra(a), parser.to_algebra(b))) for i, (a, b) in enumerate([("SELECT o.o_custkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", "SELECT o.o_custkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey"), ("SELECT o.o_custkey FROM orders o WHERE o.o_totalprice > 5 AND o.o_totalprice > 3", "SELECT x.o_custkey FROM orders x WHERE x.o_totalprice > 5"), (_PAIRS[1][0], _PAIRS[1][1])])], [(0, "structural"), (1, "containment"), (2, "no")])

# ---- folding

_VIEW = "SELECT cu.c_custkey AS ck, cu.c_mktsegment AS seg, ord.o_totalprice AS price, cu.c_nationkey AS nk, ord.o_orderkey AS ok FROM customer cu JOIN orders ord ON cu.c_custkey = ord.o_custkey WHERE ord.o_totalprice > 500"
_FULL = "SELECT c.c_mktsegment, round(sum(o.o_totalprice), 2) AS s, count(*) AS n FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 100000 GROUP BY c.c_mktsegment"
_PART = "SELECT c.c_custkey, o.o_orderkey, n.n_name FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE o.o_totalprice > 250000 AND n.n_regionkey = 1"


def _folded(name: str, sql: str) -> None:
    def found(spark, d):
        base = ir.tables_of(spark, d)
        view = parser.to_algebra(_VIEW)
        got = folding.fold(parser.to_algebra(sql), view, "v")
        return ir.to_dataframe(got.plan, lambda t: ir.to_dataframe(view, base) if t == "v" else base(t))

    QUERIES[name] = found
    ORACLES[name] = sql


_folded("V01_fold_full", _FULL)
_folded("V05_fold_partial", _PART)
_alg = parser.to_algebra
_facts("V02_coverage", "query string, coverage string", lambda: [(n, folding.coverage(_alg(q), _alg(_VIEW))[0]) for n, q in (("full", _FULL), ("none", "SELECT n_name FROM nation"), ("partial", _PART))], [("full", "full"), ("none", "none"), ("partial", "partial")])
_facts(
    "V03_conditions", "query string, coverage string, reason string",
    lambda: [(n, f.coverage, "; ".join(f.reasons)) for n, q in (("weaker", "SELECT o.o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 100"), ("lacks", "SELECT c.c_name FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 900"), ("full", _FULL), ("partial", _PART)) for f in [folding.fold(_alg(q), _alg(_VIEW), "v")]],
    [("weaker", "none", "relations of the view are not all in the query; the query does not imply o.o_totalprice > 500"), ("lacks", "none", "relations of the view are not all in the query; the view lacks c.c_name"), ("full", "full", ""), ("partial", "partial", "")],
)
_facts("V04_spj", "query string, reasons string", lambda: [(n, ",".join(folding.spj_reasons(_alg(q)))) for n, q in (("view", _VIEW), ("grouped", _FULL), ("distinct", "SELECT DISTINCT a FROM t"), ("window", "SELECT row_number() OVER (ORDER BY a) AS r FROM t"), ("sub", "SELECT a FROM t WHERE EXISTS (SELECT 1 FROM u)"))], [("view", ""), ("grouped", "aggregation"), ("distinct", "distinct"), ("window", "window"), ("sub", "subquery")])
_facts("V05_boundary", "a string, b string", lambda: [(f"{e.left}.{e.left_column}", f"{e.right}.{e.right_column}") for e in folding.fold(_alg(_PART), _alg(_VIEW), "v").boundary], [("c.c_nationkey", "n.n_nationkey")])
_facts("V06_outer_safety", "covered string, safe boolean", lambda: [(",".join(sorted(c)), rewrites.outer_join_safe(_JOINED, c)) for c in ({"c", "o"}, {"l"}, {"c"}, {"o", "l"})], [("c,o", True), ("l", False), ("c", True), ("l,o", False)])
_KEYS = folding.Constraints({"orders": ("o_orderkey",), "customer": ("c_custkey",)}, {("lineitem", "l_orderkey"): ("orders", "o_orderkey"), ("orders", "o_custkey"): ("customer", "c_custkey")}, frozenset({("lineitem", "l_orderkey")}))
_LEFT = "SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_quantity > 45"
_run("V07_outer_to_inner", folding.outer_to_inner(_alg(_LEFT), _KEYS), _LEFT)
_facts("V07_when_nullable", "query string, how string", lambda: [(n, next(x.how for x in folding.outer_to_inner(_alg(q), _KEYS).walk() if isinstance(x, ir.Join))) for n, q in (("not null", _LEFT), ("may be null", "SELECT o.o_orderkey FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey"))], [("not null", "inner"), ("may be null", "left")])
_SELF = "SELECT a.o_orderkey FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey"
_facts("V08_self_join", "view string, safe boolean", lambda: [(v, folding.self_join_safe(_alg(_SELF), _alg(v), _KEYS)) for v in ("SELECT o_orderkey, o_custkey FROM orders", "SELECT o_custkey FROM orders")], [("SELECT o_orderkey, o_custkey FROM orders", True), ("SELECT o_custkey FROM orders", False)])
_facts("V09_keep_or_drop", "side string, predicate string", lambda: [(s, str(p)) for s, ps in zip(("keep", "drop"), rewrites.keep_over_view([X.parse(t) for t in ("a > 5", "b = 1", "c = 2")], [X.parse(t) for t in ("a > 3", "1 = b")]), strict=True) for p in ps], [("keep", "a > 5"), ("keep", "c = 2"), ("drop", "b = 1")])
_facts("V10_column_map", "expression string, over_view string", lambda: [(t, str(r) if r else None) for t in ("o.price * 2 > c.k", "o.gone > 1") for r in [rewrites.renamed_columns(X.parse(t), {("o", "price"): "p", ("c", "k"): "key"}, "v")]], [("o.price * 2 > c.k", "v.p * 2 > v.key"), ("o.gone > 1", None)])
_facts("V11_correlated_safety", "covered string, safe boolean", lambda: [(c, folding.correlated_safe(("EXISTS (SELECT 1 FROM t x WHERE x.a = o.b)",), {c})) for c in ("o", "n")], [("o", False), ("n", True)])
_facts("V12_capabilities", "query string, capability string, has boolean", lambda: [(n, k, v) for n, q in (("view", _VIEW), ("grouped", _FULL), ("random", "SELECT a FROM t WHERE random() > 0.5")) for k, v in rewrites.capabilities(_alg(q)).items()], [("view", "spj", True), ("view", "spjg", True), ("view", "provable", True), ("view", "algebraic", True), ("grouped", "spj", False), ("grouped", "spjg", True), ("grouped", "provable", False), ("grouped", "algebraic", True), ("random", "spj", True), ("random", "spjg", True), ("random", "provable", False), ("random", "algebraic", False)])
_facts("F14_volatile", "expression string, volatile boolean", lambda: [(t, X.is_volatile(X.parse(t))) for t in ("now() > a", "random() * 2", "upper(a)", "current_date")], [("now() > a", True), ("random() * 2", True), ("upper(a)", False), ("current_date", True)])

# ---- workload

_WORK = {
    "q1": ("SELECT o.o_custkey, sum(o.o_totalprice) AS s FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 100 GROUP BY o.o_custkey", 5.0),
    "q2": ("SELECT o.o_custkey, max(o.o_totalprice) AS s FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 900 GROUP BY o.o_custkey", 3.0),
    "q3": ("SELECT c.c_name, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey", 2.0),
    "q4": ("SELECT l.l_quantity FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_discount > 0.05", 4.0),
    "q5": ("SELECT l.l_quantity, o.o_orderkey FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_discount > 0.01", 1.0),
    "q6": ("SELECT n_name FROM nation", 1.0),
}
_FEATS = [(q, k, f) for q, (sql, _) in _WORK.items() for k, f in sorted(workload.pattern(sql).features)]
_FV = _values(_FEATS, "query", "kind", "feature")
_QV = _values([(q, w) for q, (_, w) in _WORK.items()], "query", "weight")
_CV = _values([("q1", "a", 5.0), ("q2", "a", 3.0), ("q3", "a", 2.0), ("q4", "b", 4.0), ("q5", "b", 1.0), ("q6", "c", 1.0)], "query", "cluster", "weight")


def _work(spark):
    return spark.createDataFrame([(q, sql, w) for q, (sql, w) in _WORK.items()], "query string, sql string, weight double")


def _clustered(spark):
    return _work(spark).select("query", F.when(F.col("query") < "q4", "a").when(F.col("query") < "q6", "b").otherwise("c").alias("cluster"), "weight")


_BY_HAND = [("q1", "relation", "customer"), ("q1", "relation", "orders"), ("q1", "join", "customer.c_custkey=orders.o_custkey"), ("q1", "predicate", "orders.o_totalprice > ?"), ("q1", "column", "orders.o_custkey"), ("q1", "column", "orders.o_totalprice"), ("q1", "group", "orders.o_custkey"), ("q6", "relation", "nation"), ("q6", "column", "nation.n_name")]


@_query("L01_patterns", _values(_BY_HAND, "query", "kind", "feature"))
def _l01(spark, d):
    return workload.features(_work(spark).where("query in ('q1', 'q6')"))


_W = "CASE kind WHEN 'relation' THEN 1.0 WHEN 'join' THEN 2.0 WHEN 'predicate' THEN 1.5 WHEN 'column' THEN 1.0 ELSE 2.0 END"
_SIM = f"WITH f AS (SELECT query, kind || ':' || feature AS x, {_W} AS w FROM ({_FV})), n AS (SELECT query, sum(w) AS s FROM f GROUP BY 1), b AS (SELECT p.query AS a, q.query AS b, sum(p.w) AS shared FROM f p JOIN f q ON p.x = q.x AND p.query < q.query GROUP BY 1, 2) SELECT b.a, b.b, CAST(round(shared / (m.s + o.s - shared), 6) AS DOUBLE) AS similarity FROM b JOIN n m ON m.query = b.a JOIN n o ON o.query = b.b"


@_query("L02_similarity", _SIM)
def _l02(spark, d):
    return workload.similarities(workload.features(_work(spark)))


@_query("L03_clusters", f"WITH RECURSIVE e AS (SELECT a, b FROM ({_SIM}) WHERE similarity >= 0.3), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(query, top) AS (SELECT query, query FROM ({_QV}) UNION SELECT g.b, r.top FROM r JOIN g ON g.a = r.query) SELECT query, min(top) AS cluster FROM r GROUP BY 1")
def _l03(spark, d):
    w = _work(spark)
    return workload.clusters(w, _l02(spark, d))


@_query("L06_candidate_keys", f"WITH u AS (SELECT query, feature AS c, 1 AS g, 0 AS j FROM ({_FV}) WHERE kind = 'group' UNION ALL SELECT query, unnest(string_split(feature, '=')), 0, 1 FROM ({_FV}) WHERE kind = 'join'), p AS (SELECT query, c, max(g) AS g, max(j) AS j FROM u GROUP BY 1, 2) SELECT c AS column, CAST(round(sum(weight * (2.0 * g + 1.5 * j)) / (SELECT sum(weight) FROM ({_QV})), 6) AS DOUBLE) AS score FROM p JOIN ({_QV}) q ON p.query = q.query GROUP BY 1 HAVING score >= 0.7")
def _l06(spark, d):
    w = _work(spark)
    return workload.candidate_keys(w, workload.features(w))


for _kind, _slug in (("join", "join"), ("predicate", "filter"), ("group", "grain")):
    QUERIES[f"L07_{_slug}_evidence"] = lambda s, d, k=_kind: workload.evidence(_work(s), workload.features(_work(s)), k)
    ORACLES[f"L07_{_slug}_evidence"] = f"SELECT feature, count(*) AS n, sum(weight) AS weight FROM ({_FV}) f JOIN ({_QV}) q ON f.query = q.query WHERE kind = '{_kind}' GROUP BY 1"

_GLOBAL = f"SELECT feature, CAST(round(sum(weight) / (SELECT sum(weight) FROM ({_CV})), 6) AS DOUBLE) AS support, count(DISTINCT cluster) AS clusters, CAST(round(count(DISTINCT cluster) / 3, 6) AS DOUBLE) AS coverage, CAST(round(sum(weight) / (SELECT sum(weight) FROM ({_CV})) * (count(DISTINCT cluster) / 3), 6) AS DOUBLE) AS score FROM (SELECT DISTINCT query, feature FROM ({_FV})) f JOIN ({_CV}) c ON f.query = c.query GROUP BY 1"


@_query("L08_global_support", _GLOBAL)
def _l08(spark, d):
    return workload.global_support(_clustered(spark), workload.features(_work(spark)))


@_query("L09_base_and_special", f"WITH g AS ({_GLOBAL}), l AS (SELECT cluster, feature, sum(weight) AS w FROM (SELECT DISTINCT query, feature FROM ({_FV})) f JOIN ({_CV}) c ON f.query = c.query GROUP BY 1, 2), t AS (SELECT cluster, sum(weight) AS total FROM ({_CV}) GROUP BY 1) SELECT 'base' AS cluster, feature FROM g WHERE support >= 0.7 AND clusters >= 2 UNION ALL SELECT l.cluster, l.feature FROM l JOIN t ON l.cluster = t.cluster JOIN g ON g.feature = l.feature WHERE l.w / t.total >= 0.7 AND g.support < 0.3")
def _l09(spark, d):
    c, f = _clustered(spark), workload.features(_work(spark))
    overall = workload.global_support(c, f)
    local = workload.feature_support(c, f.select("query", "feature"))
    return workload.base_features(overall, clusters=2).select(F.lit("base").alias("cluster"), "feature").unionByName(workload.special_features(overall, local))


@_query("L10_feature_overlap", f"WITH o AS (SELECT DISTINCT cluster, feature FROM ({_FV}) f JOIN ({_CV}) c ON f.query = c.query) SELECT a.cluster AS a, b.cluster AS b, count(*) AS shared FROM o a JOIN o b ON a.feature = b.feature AND a.cluster < b.cluster GROUP BY 1, 2")
def _l10(spark, d):
    return workload.overlap(workload.features(_work(spark)).select("query", "feature"), _clustered(spark).select("query", "cluster"))


_SHAPE = [("orders", "customer", 10.0), ("orders", "lineitem", 30.0), ("orders", "calendar", 5.0), ("lineitem", "part", 8.0), ("part", "brand", 2.0), ("customer", "nation", 4.0), ("nation", "region", 3.0)]
_shape = workload.JoinShape(_SHAPE)
_STAR = "SELECT concat('dim', CAST(l_linenumber AS STRING_)) AS a, 'fact' AS b FROM lineitem"


@_query("L12_star_schema", f"WITH e AS (SELECT DISTINCT a, b FROM ({_STAR.replace('STRING_', 'VARCHAR')})) SELECT 'fact' AS centre, count(*) AS degree, 1.0::DOUBLE AS share FROM e")
def _l12(spark, d):
    return workload.star(run_sql(spark, d, _STAR.replace("STRING_", "STRING")))


_path = lambda found: [(" > ".join(p), w) for p, w in found]
_facts("L13a_chains", "chain string, weight double", lambda: _path(_shape.chains(["orders"])), [("brand > part > lineitem > orders", 2.0), ("orders > customer > nation > region", 3.0)])
_facts("L13b_boundaries", "tables string, score double", lambda: [(",".join(t), round(s, 6)) for t, s in _shape.boundaries(["orders", "nation"])], [("brand,calendar,customer,lineitem,orders,part", round(5 / 6, 6)), ("nation,region", 0.5)])


@_query("L13c_centrality", f"WITH e AS ({_values(_SHAPE, 'a', 'b', 'w')}), n AS (SELECT a AS node, w FROM e UNION ALL SELECT b, w FROM e) SELECT node, CAST(round(sum(w) / (SELECT sum(w) FROM n), 6) AS DOUBLE) AS centrality FROM n GROUP BY 1")
def _l13c(spark, d):
    return spark.createDataFrame([(n, round(c, 6)) for n, c in _shape.centrality().items()], "node string, centrality double")


_facts("L13d_canonical_paths", "path string, weight double", lambda: _path(_shape.canonical_paths([], ("brand", "orders"))), [("brand > part > lineitem > orders", 2.0)])
_facts("L13e_suggestions", "kind string, tables string", lambda: [(k, ",".join(t)) for k, t in _shape.suggestions()], [("hub", "calendar,customer,lineitem,orders"), ("connected", "brand,calendar,customer,lineitem,nation,orders,part,region"), ("pair", "lineitem,orders")])


@_query("L14_derived_views", f"WITH t AS (SELECT cluster, sum(weight) AS total FROM ({_CV}) GROUP BY 1), p AS (SELECT c.cluster, f.kind, f.feature, sum(c.weight) AS part FROM ({_FV}) f JOIN ({_CV}) c ON f.query = c.query GROUP BY 1, 2, 3) SELECT p.cluster, kind, feature, CAST(round(part / total, 6) AS DOUBLE) AS support FROM p JOIN t ON p.cluster = t.cluster WHERE part / total >= CASE kind WHEN 'relation' THEN 0.5 WHEN 'join' THEN 0.5 WHEN 'predicate' THEN 0.8 ELSE 0.3 END")
def _l14(spark, d):
    return workload.derived_features(_clustered(spark), workload.features(_work(spark)))


_two = {n: workload.pattern(_WORK[n][0]).features for n in ("q3", "q4")}
_facts("L15_hierarchy", "view string, parent string, own bigint", lambda: [(n, p, len(f)) for n, p, f in workload.hierarchy(_two, _two["q3"] & _two["q4"])], [("base", None, 1), ("q3", "base", 4), ("q4", "base", 4)])
_SIMILAR = ["SELECT c.c_custkey, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 300000", "SELECT c.c_custkey, o.o_orderkey, c.c_name FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 200000 AND c.c_nationkey = 1", "SELECT c.c_custkey, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 250000"]
_run("L16_greatest_common", proof.algebra(proof.greatest_common([_cq(s) for s in _SIMILAR])), "SELECT c.c_custkey, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 200000")
_TOPS = {n: workload.topology(s) for n, s in (("a", "SELECT 1 AS x FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey"), ("b", "SELECT 1 AS x FROM customer k JOIN orders z ON k.c_custkey = z.o_custkey"), ("c", "SELECT 1 AS x FROM orders p JOIN orders q ON p.o_custkey = q.o_orderkey"))}
_facts("L17_topologies", "query string, relations string, edges string", lambda: [(n, ",".join(sorted(t.relations)), ",".join(sorted(t.edges))) for n, t in _TOPS.items()], [("a", "customer,lineitem,orders", "customer.c_custkey=orders.o_custkey,lineitem.l_orderkey=orders.o_orderkey"), ("b", "customer,orders", "customer.c_custkey=orders.o_custkey"), ("c", "orders,orders#2", "orders#2.o_orderkey=orders.o_custkey")])
_facts("L18_topology_likeness", "a string, b string, similarity double, within boolean", lambda: [(a, b, round(workload.topology_similarity(_TOPS[a], _TOPS[b]), 6), workload.is_subtopology(_TOPS[a], _TOPS[b])) for a, b in (("b", "a"), ("a", "a"), ("c", "a"))], [("b", "a", round(0.4 * 2 / 3 + 0.6 / 2, 6), True), ("a", "a", 1.0, True), ("c", "a", round(0.4 / 4, 6), False)])
_facts("X04_self_join_canonical", "pair string, same boolean", lambda: [(n, workload.topology(a) == workload.topology(b)) for n, a, b in (("aliases", "SELECT 1 AS x FROM orders p JOIN orders q ON p.o_custkey = q.o_orderkey", "SELECT 1 AS x FROM orders z JOIN orders a ON a.o_orderkey = z.o_custkey"), ("columns", "SELECT 1 AS x FROM orders p JOIN orders q ON p.o_custkey = q.o_orderkey", "SELECT 1 AS x FROM orders p JOIN orders q ON p.o_custkey = q.o_custkey"))], [("aliases", True), ("columns", False)])
_run("L19_topology_to_plan", ir.Project(workload.topology_plan(_TOPS["a"]), (("orders.o_orderkey", "ok"), ("lineitem.l_linenumber", "ln"), ("customer.c_name", "cn"))), "SELECT o.o_orderkey AS ok, l.l_linenumber AS ln, c.c_name AS cn FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey")
_facts("L20_topology_learner", "name string, members string, weight double", lambda: [(n, ",".join(m), round(w, 6)) for n, m, _, w in workload.learned_topologies({q: s for q, (s, _) in _WORK.items()})], [("customer_orders", "q1,q2,q3", 1.0), ("lineitem_orders", "q4,q5", 1.0), ("nation", "q6", 1.0)])


@_query("L21_hybrid_learner", "SELECT c.c_custkey, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 200000")
def _l21(spark, d):
    """The view learned from a cluster, run; it is only given a plan once it is shown to hold every member."""
    view = workload.learned_view({f"q{i}": s for i, s in enumerate(_SIMILAR)})
    return ir.to_dataframe(view.plan, ir.tables_of(spark, d))


@_query("L22_workload_statistics", f"SELECT count(*) AS queries, sum(weight) AS weight, (SELECT count(DISTINCT feature) FROM ({_FV}) WHERE kind = 'relation') AS relations, (SELECT count(DISTINCT feature) FROM ({_FV}) WHERE kind = 'join') AS joins, (SELECT count(DISTINCT feature) FROM ({_FV}) WHERE kind = 'predicate') AS predicates FROM ({_QV})")
def _l22(spark, d):
    w = _work(spark)
    return workload.statistics(w, workload.features(w))
