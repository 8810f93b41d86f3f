"""The engine's queries on the test tables, each with the SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import sqltext
from .operators import governance, graph, traffic, workload
from .plans import ir

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


def _sql(name: str, spark_sql: str, oracle: str | None = None) -> None:
    QUERIES[name] = lambda s, d: run_sql(s, d, spark_sql)
    ORACLES[name] = oracle or spark_sql


def _plan(name: str, node: ir.Node, oracle: str) -> None:
    QUERIES[name] = lambda s, d: ir.to_dataframe(node, ir.tables_of(s, d))
    ORACLES[name] = oracle


def _query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


# Scans, filters, projections
_plan("S01_scan", ir.Scan("nation"), "SELECT * FROM nation")
_sql("S02_dual", "SELECT 1 AS one, 'x' AS x")
_sql("S03_unnest", "SELECT o_orderpriority, count(*) AS n FROM (SELECT o_orderpriority, explode(sequence(1, o_custkey % 3 + 1)) AS k FROM orders) GROUP BY o_orderpriority", "SELECT o_orderpriority, count(*) AS n FROM (SELECT o_orderpriority, unnest(range(1, o_custkey % 3 + 2)) AS k FROM orders) GROUP BY o_orderpriority")
_sql("S04_from_subquery", "SELECT t.n_regionkey, t.n FROM (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey) AS t WHERE t.n > 1")
_sql("S05_cte_reference", "WITH big AS (SELECT * FROM customer WHERE c_acctbal > 5000) SELECT c_mktsegment, count(*) AS n FROM big GROUP BY c_mktsegment")


@_query("S13_execute_limited", "SELECT * FROM (SELECT o_orderkey, (SELECT count(*) FROM orders) > 100 AS truncated FROM orders ORDER BY o_orderkey LIMIT 100)")
def _limited(spark, d, most: int = 100):
    """Read-only SQL with a row limit; one row more is fetched to tell whether something was cut off."""
    rows = run_sql(spark, d, "SELECT o_orderkey FROM orders ORDER BY o_orderkey").limit(most + 1)
    cut = rows.agg((F.count("*") > most).alias("truncated"))
    return rows.orderBy("o_orderkey").limit(most).crossJoin(F.broadcast(cut))  # one row


_plan("P01_selection", ir.Filter(ir.Scan("orders"), ("o_totalprice > 300000", "o_orderstatus = 'F'")), "SELECT * FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'")
_plan("P02_projection", ir.Project(ir.Scan("customer"), (("c_custkey", "k"), ("upper(c_mktsegment)", "segment"))), "SELECT c_custkey AS k, upper(c_mktsegment) AS segment FROM customer")
_plan("P03_distinct", ir.Project(ir.Scan("lineitem"), (("l_returnflag", "l_returnflag"), ("l_linestatus", "l_linestatus")), True), "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_plan("P04_distinct_on", ir.Project(ir.DistinctOn(ir.Scan("orders"), ("o_custkey",), ("o_totalprice DESC", "o_orderkey")), (("o_custkey", "o_custkey"), ("o_orderkey", "o_orderkey"))), "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
_sql("P05_star", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
_sql("P07_literal", "SELECT n_name, 7 AS seven, 'a' AS a FROM nation")
_sql("P08_comparison", "SELECT count(*) AS n FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_linenumber <> 3 AND l_discount <= 0.05 AND l_tax > 0.01")
_sql("P09_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%l%_et'")
_sql("P10_ilike", "SELECT count(*) AS n FROM customer WHERE c_mktsegment ILIKE 'bUILD%'")
_sql("P11_in_list", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey NOT IN (2, 4)")
_sql("P12_is_null", "SELECT count(*) AS n FROM (SELECT CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey END AS k FROM orders) AS t WHERE k IS NULL")
_sql("P13_between", "SELECT count(*) AS n FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000")
_sql("P14_and_or_not", "SELECT count(*) AS n FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 100000) AND NOT (o_orderpriority = '5-LOW')")
_sql("P15_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
_sql("P16_in_subquery", "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
_sql("P17_scalar_subquery", "SELECT count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")

# Joins
_nation, _region = ir.Scan("nation", "n"), ir.Scan("region", "r")
_on = ("n.n_regionkey = r.r_regionkey",)
_pick = (("n.n_name", "n_name"), ("r.r_name", "r_name"))
_asia = ir.Filter(_region, ("r.r_regionkey > 1",))
_plan("J02_inner", ir.Project(ir.Join(_nation, _region, "inner", _on), _pick), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
_plan("J03_left", ir.Project(ir.Join(_nation, _asia, "left", _on), _pick), "SELECT n_name, r_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey > 1) ON n_regionkey = r_regionkey")
_few = ir.Filter(_nation, ("n.n_nationkey < 5",))
_plan("J04_right", ir.Project(ir.Join(_few, _region, "right", _on), _pick), "SELECT n_name, r_name FROM (SELECT * FROM nation WHERE n_nationkey < 5) RIGHT JOIN region ON n_regionkey = r_regionkey")
_plan("J05_full", ir.Project(ir.Join(_few, _asia, "full", _on), _pick), "SELECT n_name, r_name FROM (SELECT * FROM nation WHERE n_nationkey < 5) FULL JOIN (SELECT * FROM region WHERE r_regionkey > 1) ON n_regionkey = r_regionkey")
_plan("J06_cross", ir.Project(ir.Join(_nation, _region, "cross"), _pick), "SELECT n_name, r_name FROM nation CROSS JOIN region")
_rich = ir.Filter(ir.Scan("orders", "o"), ("o.o_totalprice > 250000",))
_plan("J07_left_semi", ir.Project(ir.Join(ir.Scan("customer", "c"), _rich, "left_semi", ("c.c_custkey = o.o_custkey",)), (("c.c_custkey", "c_custkey"),)), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
_plan("J08_left_anti", ir.Project(ir.Join(ir.Scan("customer", "c"), _rich, "left_anti", ("c.c_custkey = o.o_custkey",)), (("c.c_custkey", "c_custkey"),)), "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_totalprice > 250000)")
_plan("J09_theta", ir.Project(ir.Join(_nation, _region, "inner", ("n.n_regionkey < r.r_regionkey",)), _pick), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey")
_sql("J10_lateral", "SELECT r.r_name, t.n FROM region r, LATERAL (SELECT count(*) AS n FROM nation WHERE n_regionkey = r.r_regionkey) AS t")
_sql("J11_self_join", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")

# Aggregates
_plan("A01_group_by", ir.Aggregate(ir.Scan("orders"), (("o_orderstatus", "s"),), (("count(*)", "n"), ("round(sum(o_totalprice), 2)", "total"))), "SELECT o_orderstatus AS s, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
_sql("A02_global", "SELECT count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
_plan("A03_having", ir.Aggregate(ir.Scan("orders"), (("o_custkey", "k"),), (("count(*)", "n"),), "n > 15"), "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
_sql("A05_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag")
_sql("A07_avg", "SELECT c_mktsegment, round(avg(c_acctbal), 4) AS a FROM customer GROUP BY c_mktsegment")
_sql("A08_min_max", "SELECT n_regionkey, min(n_name) AS lo, max(n_name) AS hi FROM nation GROUP BY n_regionkey")
_sql("A09_array_agg", "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), '|') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(array_agg(n_name)), '|') AS names FROM nation GROUP BY n_regionkey")
_sql("A10_string_agg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
_sql("A11_bool", "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS every, bool_or(o_totalprice > 400000) AS some FROM orders GROUP BY o_orderstatus")
_sql("A12_sum_distinct", "SELECT CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem")
_sql("A13_statistics", "SELECT round(stddev_samp(o_totalprice), 2) AS sd, round(var_pop(o_totalprice), 0) AS v, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice), 4) AS med FROM orders")
_fine = ir.Aggregate(ir.Scan("orders"), (("o_custkey", "k"), ("o_orderstatus", "s")), (("count(*)", "n"), ("max(o_totalprice)", "high")))
_coarse = ir.Aggregate(ir.Scan("orders"), (("o_orderstatus", "s"),), (("count(*)", "n"), ("max(o_totalprice)", "high")))


@_query("A14_roll_up", "SELECT o_orderstatus AS s, count(*) AS n, max(o_totalprice) AS high FROM orders GROUP BY o_orderstatus")
def _rolled(spark, d):
    """The coarse aggregate answered from the finer one."""
    base = ir.tables_of(spark, d)
    node = ir.roll_up(_coarse, _fine, ir.Scan("fine"))
    return ir.to_dataframe(node, lambda t: ir.to_dataframe(_fine, base) if t == "fine" else base(t))


# Windows
_w = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
_sql("W03_rows_frame", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({_w} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS s FROM orders")
_sql("W04_range_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS n FROM orders")
_sql("W05_groups_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY g RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM (SELECT *, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS g FROM orders)", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM orders")
_sql("W06_bounds", f"SELECT o_orderkey, min(o_totalprice) OVER ({_w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, max(o_totalprice) OVER ({_w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM orders")
_rank = ", ".join(f"CAST({f} OVER ({_w}) AS DOUBLE) AS {n}" for f, n in (("row_number()", "rn"), ("rank()", "rk"), ("dense_rank()", "dr"), ("ntile(3)", "nt")))
_sql("W07_ranking", f"SELECT o_orderkey, {_rank}, round(percent_rank() OVER ({_w}), 6) AS pr, round(cume_dist() OVER ({_w}), 6) AS cd FROM orders")
_sql("W08_offset", f"SELECT o_orderkey, lag(o_orderkey) OVER ({_w}) AS a, lead(o_orderkey, 2) OVER ({_w}) AS b, first_value(o_orderkey) OVER ({_w}) AS c, nth_value(o_orderkey, 2) OVER ({_w}) AS d FROM orders")
_sql("W09_aggregate_over", "SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_mktsegment), 1) AS d FROM customer")

# Sort, limit, sets, recursion
_plan("O01_sort_limit", ir.Limit(ir.Sort(ir.Project(ir.Scan("orders"), (("o_orderkey", "k"), ("o_totalprice", "p"))), ("p DESC", "k")), 20), "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 20")
_sql("O03_nulls_order", "SELECT k, v FROM (SELECT o_orderkey AS k, CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders) AS t ORDER BY v ASC NULLS LAST, k LIMIT 10")
_plan("O05_offset", ir.Limit(ir.Sort(ir.Project(ir.Scan("part"), (("p_partkey", "k"),)), ("k",)), 10, 5), "SELECT p_partkey AS k FROM part ORDER BY k LIMIT 10 OFFSET 5")
_a = ir.Project(ir.Scan("customer"), (("c_nationkey", "k"),))
_b = ir.Project(ir.Filter(ir.Scan("supplier"), ("s_acctbal > 3000",)), (("s_nationkey", "k"),))
for _name, _kind, _all in (("U01_union", "union", False), ("U02_union_all", "union", True), ("U03_except", "except", False), ("U04_intersect", "intersect", False), ("U05_intersect_all", "intersect", True), ("U06_except_all", "except", True)):
    _plan(_name, ir.SetOp(_a, _b, _kind, _all), f"SELECT c_nationkey AS k FROM customer {_kind.upper()}{' ALL' * _all} SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 3000")
_sql("U07_with", "WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT n, count(*) AS m FROM a GROUP BY n) SELECT n, m FROM b")
_sql("U08_cte_columns", "WITH a(x, y) AS (SELECT n_regionkey, count(*) FROM nation GROUP BY n_regionkey) SELECT x, y FROM a")
_sql("U09_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")

# Scalar functions
_sql("F01_arithmetic", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + l_tax, 4) AS x, round(l_quantity / 7, 6) AS q, l_orderkey % 5 AS m FROM lineitem")
_sql("F03_concat", "SELECT n_name || '-' || CAST(n_regionkey AS VARCHAR(5)) AS x FROM nation", "SELECT n_name || '-' || CAST(n_regionkey AS VARCHAR) AS x FROM nation")
_sql("F04_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS s FROM orders")
_sql("F06_coalesce_nullif", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 0), 99) AS x FROM nation")
_sql("F07_strings", "SELECT lower(c_mktsegment) AS l, upper(c_name) AS u, trim(c_name) AS t, length(c_name) AS n, substring(c_name, 2, 4) AS s FROM customer")
_sql("F08_numeric", "SELECT o_orderkey, abs(o_totalprice - 100000) AS a, CAST(floor(o_totalprice) AS BIGINT) AS f, CAST(ceil(o_totalprice) AS BIGINT) AS c FROM orders")
_sql("F10_date_trunc", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, count(*) AS n FROM orders GROUP BY 1")
_sql("F11_extract", "SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(extract(month FROM o_orderdate) AS BIGINT) AS m, count(*) AS n FROM orders GROUP BY 1, 2")
_sql("F12_cast", "SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) AS d, CAST(o_orderdate AS DATE) AS t FROM orders")
_sql("F15_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
_sql("F18_fingerprint", "SELECT p_partkey, substr(sha2(p_name, 256), 1, 16) AS f FROM part", "SELECT p_partkey, substr(sha256(p_name), 1, 16) AS f FROM part")
_sql("F20_violation_id", "SELECT n_nationkey, regexp_replace(substr(sha2(concat(n_name, ':type_changed'), 256), 1, 32), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '$1-$2-$3-$4-$5') AS id FROM nation", "SELECT n_nationkey, regexp_replace(substr(sha256(concat(n_name, ':type_changed')), 1, 32), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS id FROM nation")

# Query events derived from the events table
_EVENTS = """
    SELECT event_id, ts AS captured_at, value AS duration_ms,
      CASE event_type WHEN 'view' THEN 'SELECT * FROM orders JOIN customer ON 1 = 1 WHERE k = ' || CAST(user_id AS STRING_)
                      WHEN 'click' THEN 'select  *  from lineitem where x = ''' || event_type || ''''
                      WHEN 'purchase' THEN 'INSERT INTO sales SELECT * FROM orders'
                      WHEN 'signup' THEN 'UPDATE customer SET x = 1' ELSE 'SELECT EXTRACT(year FROM ts) -- it''s fine' || chr(10) || ' FROM part AS p, "nation" WHERE a = ''x--y'' ' END AS sql,
      CASE event_type WHEN 'purchase' THEN 'INSERT' WHEN 'signup' THEN 'UPDATE' ELSE 'SELECT' END AS query_type,
      CASE WHEN user_id % 7 = 0 THEN 'etl-worker' WHEN user_id % 7 = 1 THEN 'svc_api' ELSE 'console' END AS source_name,
      CASE WHEN user_id % 11 = 0 THEN NULL ELSE 'u' || CAST(user_id AS STRING_) END AS database_user,
      CASE WHEN user_id % 13 = 0 THEN 'dag' END AS dag_id, CASE WHEN user_id % 5 = 0 THEN 'application' END AS consumer,
      CAST(floor(value * 100) AS BIGINT) AS bytes, CASE WHEN user_id % 17 = 0 THEN 'nightly' END AS label_dag
    FROM events"""
_DUCK = _EVENTS.replace("STRING_", "VARCHAR")
_HIT = " OR ".join(f"regexp_matches(lower(coalesce({c}, '')), '{{p}}')" for c in ("source_name", "database_user"))
_CLASS = f"CASE WHEN coalesce(dag_id, '') <> '' OR coalesce(label_dag, '') <> '' OR consumer = 'airflow' THEN 'scheduled' WHEN {_HIT.format(p=sqltext.BATCH)} THEN 'batch' WHEN consumer = 'application' OR {_HIT.format(p=sqltext.SERVICE)} THEN 'service_account' ELSE 'ad_hoc' END"
_NORM = "lower(trim(regexp_replace(regexp_replace(regexp_replace(replace(sql, '-- it''s fine', ' '), '''(?:[^'']|'''')*''', '?', 'g'), '\\b[0-9]+(\\.[0-9]+)?\\b', '?', 'g'), '\\s+', ' ', 'g')))"
_REFS = "CASE WHEN starts_with(sql, 'SELECT EXTRACT') THEN ['nation', 'part'] ELSE list_sort(list_distinct(list_transform(regexp_extract_all(sql, '(?i)\\b(?:from|join)\\s+([A-Za-z_][A-Za-z0-9_.]*)', 1), lambda x: lower(x)))) END"


def query_events(spark: SparkSession, d: str) -> DataFrame:
    e = run_sql(spark, d, _EVENTS.replace("STRING_", "STRING"))
    return e.withColumn("labels", F.create_map(F.lit("airflow_dag"), F.col("label_dag"))).withColumn("tables", sqltext.table_refs(F.col("sql")))


@_query("B01_source_type", f"SELECT event_id, {_CLASS} AS source_type FROM ({_DUCK})")
def _b01(spark, d):
    return traffic.classified(query_events(spark, d)).select("event_id", "source_type")


@_query("B02_source_breakdown", f"SELECT source_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM (SELECT {_CLASS} AS source_type FROM ({_DUCK})) GROUP BY 1")
def _b02(spark, d):
    return traffic.breakdown(query_events(spark, d))


@_query("B03_normalized_hash", f"SELECT event_id, substr(sha256({_NORM}), 1, 16) AS query_hash FROM ({_DUCK})")
def _b03(spark, d):
    return query_events(spark, d).select("event_id", sqltext.fingerprint(sqltext.normalized(F.col("sql"))).alias("query_hash"))


@_query("B04_frequent_queries", f"SELECT substr(sha256({_NORM}), 1, 16) AS query_hash, count(*) AS n, arg_min(sql, (captured_at, sql)) AS sample, round(avg(duration_ms), 6) AS avg_ms, round(avg(bytes), 6) AS avg_bytes, array_to_string(list_sort(list(DISTINCT {_CLASS})), ',') AS source_types FROM ({_DUCK}) GROUP BY 1")
def _b04(spark, d):
    return traffic.frequent(query_events(spark, d))


@_query("B06_table_access", f"SELECT table_name, count(*) AS n, count(DISTINCT database_user) AS users, array_to_string(list_sort(list(DISTINCT lower(query_type))), ',') AS kinds FROM (SELECT unnest({_REFS}) AS table_name, database_user, query_type FROM ({_DUCK})) GROUP BY 1")
def _b06(spark, d):
    return traffic.table_access(query_events(spark, d))


@_query("B07_user_activity", f"SELECT coalesce(database_user, '<unknown>') AS database_user, count(*) AS total, count(*) FILTER (query_type = 'SELECT') AS selects, count(*) FILTER (query_type IN ('INSERT', 'UPDATE', 'DELETE')) AS dml, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes FROM ({_DUCK}) GROUP BY 1")
def _b07(spark, d):
    return traffic.user_activity(query_events(spark, d))


@_query("B10_pg_consumer", f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN source_name WHEN database_user IS NOT NULL THEN 'user:' || database_user WHEN event_id % 2 = 0 THEN 'client:10.0.0.1' ELSE 'unknown' END AS name, CAST(CASE WHEN event_id % 3 = 0 THEN 0.9 WHEN database_user IS NOT NULL THEN 0.7 WHEN event_id % 2 = 0 THEN 0.3 ELSE 0.0 END AS DOUBLE) AS confidence FROM ({_DUCK})")
def _b10(spark, d):
    e = query_events(spark, d)
    who = sqltext.pg_consumer(F.when(F.col("event_id") % 3 == 0, F.col("source_name")), F.col("database_user"), F.when(F.col("event_id") % 2 == 0, "10.0.0.1"))
    return e.select("event_id", who.alias("w")).select("event_id", F.col("w.name").alias("name"), F.col("w.confidence").alias("confidence"))


_NAMES = "SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'Backoffice-v2:production' WHEN 1 THEN 'api-staging' WHEN 2 THEN 'worker' WHEN 3 THEN 'web-v1.2-prod' WHEN 4 THEN 'svc:8080' WHEN 5 THEN 'team-qa' WHEN 6 THEN 'appv2' WHEN 7 THEN 'app-2.5' ELSE 'x-sandbox:local' END || CASE WHEN c_custkey % 2 = 0 THEN '-testing' ELSE '' END AS raw FROM customer"
_ENDS = "|".join(sqltext.ENVIRONMENTS)
_STEP = f"trim(regexp_replace(regexp_replace(regexp_replace({{x}}, ':({_ENDS})$', ''), '-({_ENDS})$', ''), '-v?[0-9]+([.][0-9]+)*$', ''))"


@_query("B12_consumer_name", f"SELECT c_custkey, {_STEP.format(x=_STEP.format(x=_STEP.format(x='lower(raw)')))} AS name FROM ({_NAMES})")
def _b12(spark, d):
    """Three passes of the oracle reach the fixed point of these names."""
    return run_sql(spark, d, _NAMES).select("c_custkey", sqltext.consumer_name(F.col("raw")).alias("name"))


@_query("T10_statement_target", f"SELECT event_id, lower(regexp_extract(sql, '(?i)(?:insert\\s+into|create\\s+table|^update|^delete\\s+from)\\s+([A-Za-z_][A-Za-z0-9_.]*)', 1)) AS target FROM ({_DUCK})")
def _t10(spark, d):
    return query_events(spark, d).select("event_id", sqltext.write_target(F.col("sql")).alias("target"))


@_query("I03_incremental_pull", f"SELECT count(*) AS n FROM ({_DUCK}) WHERE captured_at > TIMESTAMP '2024-01-15 00:00:00'")
def _i03(spark, d):
    return traffic.since(query_events(spark, d), "2024-01-15 00:00:00").agg(F.count("*").alias("n"))


# Lineage
_EDGES = "SELECT * FROM (VALUES ('region', 'nation'), ('nation', 'customer'), ('nation', 'supplier'), ('customer', 'orders'), ('orders', 'lineitem'), ('part', 'lineitem'), ('supplier', 'lineitem'), ('lineitem', 'sales'), ('sales', 'orders')) AS e(source, target)"
_REACH = f"WITH RECURSIVE e AS ({_EDGES}), walk(node, depth) AS (SELECT 'nation', 0 UNION SELECT e.target, walk.depth + 1 FROM walk JOIN e ON e.source = walk.node WHERE walk.depth < 9) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk WHERE node <> 'nation' GROUP BY node"
_SEEN = "SELECT 'p' || CAST(l_partkey % 50 AS STRING_) AS source, 's' || CAST(l_suppkey % 20 AS STRING_) AS target, l_linenumber = 1 AS by_column, l_shipdate AS seen_at FROM lineitem"


@_query("G02_inferred_edges", f"""WITH g AS (SELECT source, target, count(*) AS n, bool_or(by_column) AS c, max(seen_at) AS last FROM ({_SEEN.replace('STRING_', 'VARCHAR')}) GROUP BY 1, 2)
  SELECT source, target, n, round(least((CASE WHEN c THEN 0.9 ELSE 0.7 END + CASE WHEN max(n) OVER () <= 1 THEN 0.1 ELSE ln(n) / ln(max(n) OVER ()) * 0.1 END) * CASE WHEN date_diff('day', CAST(last AS DATE), DATE '1998-12-01') > 90 THEN 0.7 WHEN date_diff('day', CAST(last AS DATE), DATE '1998-12-01') > 30 THEN 0.9 ELSE 1.0 END, 1.0), 6) AS confidence FROM g""")
def _g02(spark, d):
    return graph.inferred(run_sql(spark, d, _SEEN.replace("STRING_", "STRING")), "1998-12-01")


_TWO_SYSTEMS = "SELECT 'pg' AS system, 'main.' || lower(p_brand) AS name FROM part UNION ALL SELECT 'bq', 'ds.' || p_brand FROM part WHERE p_size > 10 UNION ALL SELECT 'dbt', p_brand || '_' || CAST(p_size AS STRING_) FROM part"


@_query("G03_cross_system", f"WITH t AS (SELECT DISTINCT system, name, lower(split_part(name, '.', -1)) AS bare FROM ({_TWO_SYSTEMS.replace('STRING_', 'VARCHAR')})), f AS (SELECT bare, system, min(name) AS name FROM t GROUP BY 1, 2) SELECT a.system || '::' || a.name AS source, b.system || '::' || b.name AS target, 0.5::DOUBLE AS confidence FROM f a JOIN f b ON a.bare = b.bare AND a.system <> b.system")
def _g03(spark, d):
    return graph.cross_system(run_sql(spark, d, _TWO_SYSTEMS.replace("STRING_", "STRING")))


@_query("G04_declared_first", f"WITH e AS ({_EDGES}) SELECT source, target, 1.0::DOUBLE AS confidence FROM e WHERE source < 'p' UNION ALL SELECT source, target, 0.5::DOUBLE FROM e WHERE NOT source < 'p'")
def _g04(spark, d):
    e = spark.sql(_EDGES)
    return graph.declared_first(e.where("source < 'p'").withColumn("confidence", F.lit(1.0)), e.withColumn("confidence", F.lit(0.5)))


@_query("G06_reachable", _REACH)
def _g06(spark, d):
    return graph.reach(spark.sql(_EDGES), "nation")


@_query("G09_impact", f"SELECT r.node, r.depth, CAST(coalesce(q.n, 0) AS BIGINT) AS executions FROM ({_REACH}) r LEFT JOIN (SELECT t AS node, count(*) AS n FROM (SELECT unnest({_REFS}) AS t FROM ({_DUCK})) GROUP BY 1) q ON r.node = q.node")
def _g09(spark, d):
    return graph.impact(spark.sql(_EDGES), query_events(spark, d).select("tables", F.lit(1).cast("bigint").alias("executions")), "nation")


@_query("G11_graph_status", "SELECT 'assets' AS what, '' AS key, count(*) AS n FROM part UNION ALL SELECT 'edges', '', count(*) FROM lineitem UNION ALL SELECT 'queries', '', count(*) FROM orders UNION ALL SELECT 'kind', p_type, count(*) FROM part GROUP BY 2 UNION ALL SELECT 'source', p_brand, count(*) FROM part GROUP BY 2")
def _g11(spark, d):
    return graph.status(run_sql(spark, d, "SELECT p_type AS kind, p_brand AS source FROM part"), run_sql(spark, d, "SELECT l_orderkey FROM lineitem"), run_sql(spark, d, "SELECT o_orderkey FROM orders"))


def _objects(spark, d, **o):
    """Objects of a system, made from the keys of a table."""
    sql = "SELECT concat('{p}', k) AS object, CASE WHEN k % 5 = 0 THEN NULL ELSE k * {m} END AS row_count, array(named_struct('name', 'id', 'type', '{t}'), named_struct('name', concat('c', k % 3), 'type', 'text'), named_struct('name', 'v{n}', 'type', 'numeric')) AS columns FROM (SELECT DISTINCT {c} % 60 AS k FROM {table})"
    return run_sql(spark, d, sql.format(**o))


_LEFT = {"p": "T", "m": 10, "t": "int", "n": 1, "c": "c_custkey", "table": "customer"}
_RIGHT = {"p": "t", "m": 7, "t": "bigint", "n": 2, "c": "s_suppkey", "table": "supplier"}
# of these columns id and one of c0 to c2 are shared, of four names in all, and both have one type
_MATCH = "SELECT 'T' || CAST(a.k AS VARCHAR) AS source_object, 't' || CAST(b.k AS VARCHAR) AS target_object, CAST(round(CASE WHEN a.k % 5 = 0 THEN (0.5 + 0.3 * 2 / 4 + 0.1) / 0.9 ELSE 0.5 + 0.3 * 2 / 4 + 0.1 + 0.1 * (1 - abs(a.k * 10 - b.k * 7) / greatest(a.k * 10, b.k * 7, 1)) END, 6) AS DOUBLE) AS score, 1::INTEGER AS rank, true AS primary_match FROM (SELECT DISTINCT c_custkey % 60 AS k FROM customer) a JOIN (SELECT DISTINCT s_suppkey % 60 AS k FROM supplier) b ON a.k = b.k"


@_query("G14_schema_match", _MATCH)
def _g14(spark, d):
    return graph.match_scores(_objects(spark, d, **_LEFT), _objects(spark, d, **_RIGHT))


_TYPES = "SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'varchar(10)' WHEN 1 THEN 'BIGINT' WHEN 2 THEN 'double precision' WHEN 3 THEN 'timestamptz' WHEN 4 THEN 'jsonb' WHEN 5 THEN '_geo' WHEN 6 THEN '' WHEN 7 THEN 'decimal(3,1)' ELSE 'Odd' END AS raw FROM part"


@_query("G15_type_family", f"SELECT p_partkey, CASE raw WHEN 'varchar(10)' THEN 'string' WHEN 'BIGINT' THEN 'integer' WHEN 'double precision' THEN 'float' WHEN 'timestamptz' THEN 'timestamp' WHEN 'jsonb' THEN 'json' WHEN '_geo' THEN 'array' WHEN '' THEN 'unknown' WHEN 'decimal(3,1)' THEN 'numeric' ELSE 'odd' END AS family FROM ({_TYPES})")
def _g15(spark, d):
    return run_sql(spark, d, _TYPES).select("p_partkey", sqltext.type_family(F.col("raw")).alias("family"))


# Profiles, drift, contracts, store
_PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, count(*) FILTER ({c} IS NULL) AS n_null, CAST(round(count(*) FILTER ({c} IS NULL) / count(*), 6) AS DOUBLE) AS null_fraction, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


@_query("Q01_profile", _PROFILE)
def _q01(spark, d):
    return governance.profile(run_sql(spark, d, "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer"))


@_query("Q02_top_values", "SELECT c_mktsegment AS value, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 50")
def _q02(spark, d):
    return governance.top_values(run_sql(spark, d, "SELECT * FROM customer"), "c_mktsegment")


# column snapshots of two scans, made from parts: assets are brands, columns their part types
_SCAN = "SELECT DISTINCT p_brand AS asset, {name} AS column_name, CASE WHEN {third} THEN '{t}' ELSE 'text' END AS type FROM (SELECT p_brand, p_type, min(p_size) AS p_size FROM part GROUP BY 1, 2) AS p WHERE {keep}"
_OLD = _SCAN.format(name="p_type", t="int", keep="p_size % 7 <> 0", third="p_size % 3 = 0")
_NEW = _SCAN.format(name="upper(p_type)", t="INT", keep="p_size % 5 <> 0 AND p_brand <> 'Brand#5'", third="p_size % 2 = 0")
_ROWS = "SELECT p_brand AS asset, {n} AS row_count FROM part GROUP BY 1"
_WAS, _IS = _ROWS.format(n="count(*)"), _ROWS.format(n="count(CASE WHEN p_size > 35 THEN 1 END)")
_DRIFT = f"""WITH o AS (SELECT asset, lower(column_name) AS c, type AS was FROM ({_OLD})), n AS (SELECT asset, lower(column_name) AS c, type AS now FROM ({_NEW})),
  gone AS (SELECT DISTINCT asset FROM o WHERE asset NOT IN (SELECT asset FROM n)), j AS (SELECT coalesce(o.asset, n.asset) AS asset, coalesce(o.c, n.c) AS column_name, was, now FROM o FULL JOIN n ON o.asset = n.asset AND o.c = n.c),
  v AS (SELECT asset, column_name, CASE WHEN was IS NULL THEN 'added_column' WHEN now IS NULL THEN 'removed_column' WHEN lower(was) <> lower(now) THEN 'type_changed' END AS violation FROM j WHERE asset IN (SELECT asset FROM o) AND asset NOT IN (SELECT asset FROM gone)
    UNION ALL SELECT asset, NULL, 'table_dropped' FROM gone
    UNION ALL SELECT a.asset, NULL, 'row_count_anomaly' FROM ({_WAS}) a JOIN ({_IS}) b ON a.asset = b.asset WHERE a.asset IN (SELECT asset FROM o) AND a.asset NOT IN (SELECT asset FROM gone) AND a.row_count > 0 AND abs(b.row_count - a.row_count) / a.row_count > 0.5)
  SELECT asset, column_name, violation, CASE violation WHEN 'added_column' THEN 'info' WHEN 'removed_column' THEN 'warning' WHEN 'row_count_anomaly' THEN 'warning' ELSE 'error' END AS severity FROM v WHERE violation IS NOT NULL"""
_MODES = "SELECT DISTINCT p_brand AS asset, CASE WHEN p_brand LIKE '%1%' THEN 'enforce' WHEN p_brand LIKE '%2%' THEN 'warn' ELSE 'strange' END AS mode FROM part"


@_query("Q04_drift", _DRIFT)
def _q04(spark, d):
    return governance.drift(run_sql(spark, d, _OLD), run_sql(spark, d, _NEW), run_sql(spark, d, _WAS), run_sql(spark, d, _IS))


@_query("Q05_enforcement", f"SELECT v.asset, CASE WHEN m.mode IN ('warn', 'enforce') THEN m.mode ELSE 'shadow' END AS mode, count(*) AS n, bool_or(severity = 'error') AND max(m.mode) = 'enforce' AS blocked FROM ({_DRIFT}) v LEFT JOIN ({_MODES}) m ON v.asset = m.asset GROUP BY 1, 2")
def _q05(spark, d):
    return governance.enforced(_q04(spark, d), run_sql(spark, d, _MODES))


_SPEC = "SELECT p_brand AS asset, CASE WHEN size % 6 = 0 THEN ' ' ELSE ' ' || p_type END AS column_name, CASE WHEN size % 4 = 0 THEN '' ELSE 'Text' END AS type, size % 2 = 0 AS nullable FROM (SELECT p_brand, p_type, max(p_size) AS size FROM part GROUP BY 1, 2) AS p"
_HAVE = "SELECT p_brand AS asset, lower(p_type) AS column_name, CASE WHEN size % 3 = 0 THEN 'int' ELSE 'TEXT' END AS type, size % 5 = 0 AS nullable FROM (SELECT p_brand, p_type, min(p_size) AS size FROM part GROUP BY 1, 2) AS p WHERE p_brand <> 'Brand#5' AND size % 4 <> 1"


@_query("Q06_contract_issues", f"""WITH s AS (SELECT asset, trim(column_name) AS name, lower(trim(type)) AS want, nullable AS may FROM ({_SPEC})), a AS (SELECT asset, column_name AS key, lower(type) AS has, nullable AS can FROM ({_HAVE})),
  j AS (SELECT s.*, a.has, a.can, s.asset IN (SELECT asset FROM a) AS known FROM s LEFT JOIN a ON s.asset = a.asset AND lower(s.name) = a.key)
  SELECT asset, name AS column_name, unnest(CASE WHEN NOT known THEN ['missing_snapshot'] WHEN name = '' THEN ['invalid_column'] WHEN has IS NULL THEN ['missing_column'] ELSE list_filter([CASE WHEN want <> '' AND want <> has THEN 'type_mismatch' END, CASE WHEN NOT may AND can THEN 'nullability_mismatch' END], lambda x: x IS NOT NULL) END) AS code FROM j""")
def _q06(spark, d):
    return governance.contract_issues(run_sql(spark, d, _SPEC), run_sql(spark, d, _HAVE))


@_query("D01_upsert", "SELECT o_custkey AS id, arg_max(o_totalprice, o_orderkey) AS v, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen, max(o_orderkey) AS version FROM orders GROUP BY 1")
def _d01(spark, d):
    rows = run_sql(spark, d, "SELECT o_custkey AS id, o_totalprice AS v, o_orderdate AS first_seen, o_orderdate AS last_seen, o_orderkey AS version FROM orders")
    return governance.upserted(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"), ["id"], "version")


@_query("Q21_same_result", "SELECT (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS rows_a, (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS rows_b, true AS same")
def _q21(spark, d):
    """EXISTS and its semi-join form give the same bag."""
    a = run_sql(spark, d, "SELECT c_custkey, c_acctbal FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
    b = run_sql(spark, d, "SELECT c_custkey, c_acctbal FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey")
    return governance.compared(a, b)


_WORK = "SELECT o_orderpriority AS cluster, o_orderkey AS query, o_custkey % 5 + 1 AS weight FROM orders"
_SUPPORT = f"SELECT p.cluster, p.feature, p.part / t.total AS support FROM (SELECT cluster, feature, sum(weight)::DOUBLE AS part FROM ({_WORK}) q JOIN (SELECT DISTINCT l_orderkey AS query, l_returnflag AS feature FROM lineitem) f ON q.query = f.query GROUP BY 1, 2) p JOIN (SELECT cluster, sum(weight) AS total FROM ({_WORK}) GROUP BY 1) t ON p.cluster = t.cluster"


@_query("L04_feature_support", _SUPPORT)
def _l04(spark, d):
    return workload.feature_support(run_sql(spark, d, _WORK), run_sql(spark, d, "SELECT l_orderkey AS query, l_returnflag AS feature FROM lineitem"))


@_query("L05_invariants", f"SELECT cluster, feature, support >= 0.8 AS invariant FROM ({_SUPPORT})")
def _l05(spark, d):
    return workload.invariants(_l04(spark, d))


_TOUCH = "SELECT concat('s', l_suppkey % 20) AS a, concat('p', l_partkey % 30) AS b, CAST(l_linenumber AS BIGINT) AS weight FROM lineitem"


@_query("L11_join_graph", f"WITH one AS (SELECT least(a, b) AS a, greatest(a, b) AS b, sum(weight) AS w FROM ({_TOUCH}) WHERE a != b GROUP BY 1, 2), n AS (SELECT node, count(*) AS degree, CAST(sum(w) AS BIGINT) AS weighted_degree FROM (SELECT a AS node, w FROM one UNION ALL SELECT b, w FROM one) GROUP BY 1) SELECT node, degree, weighted_degree, weighted_degree / (SELECT sum(weighted_degree)::DOUBLE FROM n) AS centrality FROM n")
def _l11(spark, d):
    return workload.join_graph(run_sql(spark, d, _TOUCH))


_minimum = ir.Limit(ir.Sort(ir.Aggregate(ir.Filter(ir.Join(ir.Join(ir.Scan("customer", "c"), ir.Scan("orders", "o"), "inner", ("c.c_custkey = o.o_custkey",)), ir.Scan("lineitem", "l"), "inner", ("l.l_orderkey = o.o_orderkey",)), ("c.c_mktsegment = 'BUILDING'",)), (("o.o_orderkey", "o_orderkey"),), (("round(sum(l.l_extendedprice * (1 - l.l_discount)), 2)", "revenue"),)), ("revenue DESC", "o_orderkey")), 10)
_plan("J01_end_to_end", _minimum, "SELECT o.o_orderkey, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE c.c_mktsegment = 'BUILDING' GROUP BY o.o_orderkey ORDER BY revenue DESC, o.o_orderkey LIMIT 10")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downstream impact of a table, by the executions recorded in the query events."""
    return _g09(spark, sf_dir)
