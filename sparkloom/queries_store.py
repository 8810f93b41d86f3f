"""Queries of sources, traffic, graph, store, contracts, search and streams, over data derived from the test tables the same way in both languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import sqltext
from .operators import governance, graph, search, store, traffic
from .queries import _CLASS, _DUCK, _EDGES, _NORM, _REFS, ORACLES, QUERIES, _query, query_events, run_sql
from .queries_plans import _facts
from .sources import base, catalog, code, manifests, postgres, sample, warehouses
from .sources.registry import REGISTRY
from .sources.sqlite import SqliteAdapter
from .streaming import events as streams


def _spark(sql: str) -> str:
    return sql.replace("STRING_", "STRING")


def _duck(sql: str) -> str:
    return sql.replace("STRING_", "VARCHAR")


def _both(spark, d, sql: str):
    return run_sql(spark, d, _spark(sql))


# ---- sources


@_query("S06_probe_capabilities", "SELECT * FROM (VALUES ('discover', true), ('schema', true), ('definitions', true), ('traffic', false), ('lineage', false), ('orchestration', false)) AS t(capability, available)")
def _s06(spark, d):
    run_sql(spark, d, "SELECT * FROM nation")
    return base.probe(catalog.CatalogAdapter(spark), spark).select("capability", "available")


@_query("S07_discover", "SELECT 'default' AS container")
def _s07(spark, d):
    return catalog.CatalogAdapter(spark).discover().where("container = 'default'").select("container")


@_query("S08_extract_schema", "SELECT 'nation' AS object, (SELECT count(*) FROM nation) AS row_count, 3 AS columns UNION ALL SELECT 'region', (SELECT count(*) FROM region), (SELECT count(*) FROM (DESCRIBE region))::INTEGER")
def _s08(spark, d):
    tables = {t: run_sql(spark, d, f"SELECT * FROM {t}") for t in ("nation", "region")}
    return catalog.objects(tables).select("object", "row_count", F.size("columns").alias("columns"))


_PROJECT = """to_json(named_struct('nodes', map_from_entries(collect_list(struct(concat('model.p.', n_name), named_struct('resource_type', CASE WHEN n_nationkey = 3 THEN 'test' ELSE 'model' END, 'schema', 'marts', 'alias', CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE '' END, 'name', n_name, 'raw_code', concat('select * from ', r_name),
  'depends_on', named_struct('nodes', array(concat('source.p.', r_name), concat('model.p.NATION_', n_nationkey - 1), 'model.p.unknown')))))), 'sources', map_from_entries(collect_set(struct(concat('source.p.', r_name), named_struct('schema', 'raw', 'name', r_name))))))"""
_NAMED = "CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END"


def _manifest(spark, d):
    return run_sql(spark, d, f"SELECT {_PROJECT} AS value FROM nation JOIN region ON n_regionkey = r_regionkey")


@_query("S26_project_objects", f"SELECT 'marts' AS schema, {_NAMED} AS object, 'model' AS kind, 'select * from ' || r_name AS definition FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 3 UNION ALL SELECT 'raw', r_name, 'source', NULL FROM region")
def _s26(spark, d):
    return manifests.project_objects(_manifest(spark, d)).select("schema", "object", "kind", "definition")


@_query("S27_project_lineage", f"WITH m AS (SELECT *, {_NAMED} AS o FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 3) SELECT 'raw.' || r_name AS source_object, 'marts.' || o AS target_object, 'declared' AS edge_kind, 1.0::DOUBLE AS confidence FROM m UNION ALL SELECT 'marts.' || a.o, 'marts.' || b.o, 'declared', 1.0 FROM m a JOIN m b ON a.n_nationkey = b.n_nationkey - 1")
def _s27(spark, d):
    return manifests.project_lineage(_manifest(spark, d))


QUERIES["S11_extract_lineage"], ORACLES["S11_extract_lineage"] = QUERIES["S27_project_lineage"], ORACLES["S27_project_lineage"]


@_query("S28_scheduler_lineage", "SELECT 'dag' || CAST(n_regionkey AS VARCHAR) AS source_object, 'load_' || n_name AS target_object, 'declared' AS edge_kind, 0.9::DOUBLE AS confidence FROM nation WHERE n_nationkey % 2 = 0")
def _s28(spark, d):
    return manifests.dag_lineage(_dags(spark, d))


def _dags(spark, d):
    tasks = "array(named_struct('task_id', 'extract', 'operator', 'Bash', 'upstream', array(), 'external_dag_id', cast(NULL AS string)), named_struct('task_id', 'wait', 'operator', 'Sensor', 'upstream', array('extract'), 'external_dag_id', CASE WHEN n_nationkey % 2 = 0 THEN concat('dag', n_regionkey) END))"
    return run_sql(spark, d, f"SELECT to_json(named_struct('dag_id', concat('load_', n_name), 'schedule', '@daily', 'tasks', {tasks})) AS value FROM nation")


@_query("S12_extract_orchestration", "SELECT 'load_' || n_name AS dag, 'extract' AS task, 0::INTEGER AS waits_for FROM nation UNION ALL SELECT 'load_' || n_name, 'wait', 1 FROM nation")
def _s12(spark, d):
    return manifests.dags(_dags(spark, d)).select("dag", "task", F.size("upstream").alias("waits_for"))


@_query("S29_explore_lineage", "SELECT 'main.' || r_name AS source_object, 'model.' || n_name AS target_object, 'declared' AS edge_kind, 0.95::DOUBLE AS confidence FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'main.nations', 'model.' || n_name, 'declared', 0.95 FROM nation")
def _s29(spark, d):
    sql = "SELECT to_json(named_struct('model', 'model', 'name', n_name, 'sql_table_name', concat('main.', r_name), 'joins', array(named_struct('name', 'n', 'sql_table_name', 'main.nations'), named_struct('name', 'again', 'sql_table_name', concat('main.', r_name))))) AS value FROM nation JOIN region ON n_regionkey = r_regionkey"
    return manifests.explore_lineage(run_sql(spark, d, sql))


@_query("S30_pipeline_lineage", "SELECT 's' || CAST(n_regionkey AS VARCHAR) || '.' || n_name AS source_object, CASE WHEN n_regionkey = 2 THEN 'c2' ELSE 'prefix' END || '__' || CASE WHEN n_regionkey = 1 THEN 'dest' ELSE 's' || CAST(n_regionkey AS VARCHAR) END || '.' || n_name AS target_object, 'connector' AS edge_kind, 1.0::DOUBLE AS confidence FROM nation WHERE n_regionkey <> 3 AND n_nationkey % 4 <> 0")
def _s30(spark, d):
    sql = """SELECT concat('c', n_regionkey) AS id, CASE WHEN n_regionkey = 2 THEN NULL ELSE 'prefix' END AS schema, to_json(named_struct('data', named_struct('schemas', map(concat('s', n_regionkey), named_struct('name_in_destination', CASE WHEN n_regionkey = 1 THEN 'dest' END, 'enabled', n_regionkey <> 3,
      'tables', map_from_entries(collect_list(struct(n_name, named_struct('enabled', n_nationkey % 4 <> 0))))))))) AS value FROM nation GROUP BY n_regionkey"""
    return manifests.pipeline_lineage(run_sql(spark, d, sql))


@_query("S31_bi_traffic", "SELECT captured_at, sql, database_user FROM (SELECT ts AS captured_at, 'select * from t' || CAST(user_id AS VARCHAR) AS sql, 'u' || CAST(user_id AS VARCHAR) AS database_user, event_type FROM events) WHERE event_type <> 'error'")
def _s31(spark, d):
    sql = "SELECT to_json(named_struct('started_at', cast(ts AS string), 'user', concat('u', user_id), 'running_time', value, 'native', named_struct('query', CASE WHEN event_type = 'error' THEN '' ELSE concat('select * from t', user_id) END))) AS value FROM events"
    return manifests.bi_events(run_sql(spark, d, sql)).select("captured_at", "sql", "database_user")


@_query("S24_column_lineage", "SELECT 'db.n' || CAST(n_regionkey AS VARCHAR) AS source_object, 'db.out' AS target_object, 'a>x' AS pairs FROM nation GROUP BY n_regionkey")
def _s24(spark, d):
    sql = """SELECT n_nationkey AS query_start, to_json(array(named_struct('objectName', 'db.out', 'columns', array(named_struct('columnName', CASE WHEN n_nationkey < 5 THEN 'x' ELSE 'later' END))))) AS modified,
      to_json(array(named_struct('objectName', concat('db.n', n_regionkey), 'columns', array(named_struct('columnName', 'a'), named_struct('columnName', 'b'))), named_struct('objectName', 'db.out', 'columns', array()))) AS base FROM nation"""
    got = manifests.column_lineage(run_sql(spark, d, sql))
    return got.select("source_object", "target_object", F.array_join(F.transform("column_mappings", lambda p: F.concat(p["src"], F.lit(">"), p["dst"])), ",").alias("pairs"))


_LOG = """SELECT 'f' AS file, event_id AS nth, concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), CASE WHEN user_id % 2 = 0 THEN ' UTC' ELSE ' CET' END, ' [', user_id, '] db=d,user=u', user_id, ',app=web,client=10.0.0.1 ',
  CASE event_type WHEN 'error' THEN 'ERROR:  it broke' WHEN 'view' THEN concat('STATEMENT:  select ', event_id) WHEN 'click' THEN concat('LOG:  duration: 12.5 ms  statement: select ', event_id) ELSE 'LOG:  checkpoint' END) AS value FROM events"""
_AT = "date_trunc('second', {t}) - CASE WHEN user_id % 2 = 0 THEN INTERVAL 0 HOUR ELSE INTERVAL 1 HOUR END"


@_query("S17_log_events", f"WITH p AS (SELECT *, lag(event_type) OVER w AS was, lag(ts) OVER w AS was_at FROM events WHERE event_type IN ('error', 'view') WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT CAST({_AT.format(t='CASE WHEN was = $$error$$ THEN was_at ELSE ts END')} AS TIMESTAMP) AS captured_at, 'select ' || CAST(event_id AS VARCHAR) AS sql, CASE WHEN was = 'error' THEN 'error_statement' ELSE 'statement' END AS query_type, CASE WHEN was = 'error' THEN 'it broke' END AS error FROM p WHERE event_type = 'view' UNION ALL SELECT CAST({_AT.format(t='ts')} AS TIMESTAMP), 'select ' || CAST(event_id AS VARCHAR), 'duration', NULL FROM events WHERE event_type = 'click'")
def _s17(spark, d):
    return postgres.log_events(run_sql(spark, d, _LOG)).select("captured_at", "sql", "query_type", "error")


QUERIES["I05_error_pairing"], ORACLES["I05_error_pairing"] = QUERIES["S17_log_events"], ORACLES["S17_log_events"]
QUERIES["S10_extract_traffic"], ORACLES["S10_extract_traffic"] = QUERIES["S17_log_events"], ORACLES["S17_log_events"]


@_query("S18_log_times", "SELECT * FROM (VALUES ('2024-01-02 03:04:05 UTC', TIMESTAMP '2024-01-02 03:04:05'), ('2024-01-02 03:04:05.250 PST', TIMESTAMP '2024-01-02 11:04:05.25'), ('2024-01-02 03:04:05 IST', TIMESTAMP '2024-01-01 21:34:05'), ('2024-01-02 03:04:05+02', TIMESTAMP '2024-01-02 01:04:05'), ('2024-01-02 03:04:05 -0330', TIMESTAMP '2024-01-02 06:34:05'), ('2024-01-02 03:04:05 XYZ', TIMESTAMP '2024-01-02 03:04:05'), ('2024-01-02 03:04:05', TIMESTAMP '2024-01-02 03:04:05')) AS t(raw, utc)")
def _s18(spark, d):
    raw = ["2024-01-02 03:04:05 UTC", "2024-01-02 03:04:05.250 PST", "2024-01-02 03:04:05 IST", "2024-01-02 03:04:05+02", "2024-01-02 03:04:05 -0330", "2024-01-02 03:04:05 XYZ", "2024-01-02 03:04:05"]
    return spark.createDataFrame([(x,) for x in raw], "raw string").select("raw", postgres.log_time(F.col("raw")).alias("utc"))


@_query("S19_statement_statistics", "SELECT 'q' || CAST(o_custkey AS VARCHAR) AS sql, count(*) AS n, round(sum(o_totalprice) / count(*), 4) AS duration_ms FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 50")
def _s19(spark, d):
    got = postgres.statistics(run_sql(spark, d, "SELECT concat('q', o_custkey) AS query, count(*) AS calls, sum(o_totalprice) AS total_exec_time FROM orders GROUP BY 1"), 50)
    return got.select("sql", "n", F.round("duration_ms", 4).alias("duration_ms"))


@_query("S15_catalog_schema", "SELECT 's' || CAST(n_regionkey AS VARCHAR) AS schema, n_name AS object, CASE WHEN n_nationkey % 3 = 0 THEN 'view' ELSE 'table' END AS kind, 'id,at' AS columns FROM nation UNION ALL SELECT 'm', r_name, 'materialized_view', 'id' FROM region")
def _s15(spark, d):
    column = "SELECT concat('s', n_regionkey) AS table_schema, n_name AS table_name, c.column_name, 'int' AS data_type, 'NO' AS is_nullable, c.p AS ordinal_position FROM nation LATERAL VIEW inline(array(named_struct('column_name', 'at', 'p', 2), named_struct('column_name', 'id', 'p', 1))) c UNION ALL SELECT 'pg_catalog', 'x', 'y', 'int', 'NO', 1"
    tables = run_sql(spark, d, "SELECT concat('s', n_regionkey) AS table_schema, n_name AS table_name, CASE WHEN n_nationkey % 3 = 0 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type FROM nation")
    mat = run_sql(spark, d, "SELECT 'm' AS table_schema, r_name AS table_name, 'id' AS column_name, 'int' AS data_type, 'YES' AS is_nullable, 1 AS ordinal_position FROM region")
    got = postgres.schema_of(run_sql(spark, d, column), tables, mat)
    return got.select("schema", "object", "kind", F.array_join(F.transform("columns", lambda c: c["name"]), ",").alias("columns"))


QUERIES["S14_postgres_objects"], ORACLES["S14_postgres_objects"] = QUERIES["S15_catalog_schema"], ORACLES["S15_catalog_schema"]


@_query("S16_catalog_dependencies", "SELECT 'v' AS from_schema, n_name AS from_object, 't' AS to_schema, r_name AS to_object FROM nation JOIN region ON n_regionkey = r_regionkey")
def _s16(spark, d):
    classes = run_sql(spark, d, "SELECT n_nationkey AS oid, n_name AS relname, 1 AS relnamespace, 'v' AS relkind FROM nation UNION ALL SELECT 1000 + r_regionkey, r_name, 2, 'r' FROM region")
    names = spark.createDataFrame([(1, "v"), (2, "t"), (3, "pg_catalog")], "oid int, nspname string")
    rewrite = run_sql(spark, d, "SELECT 5000 + n_nationkey AS oid, n_nationkey AS ev_class FROM nation")
    depend = run_sql(spark, d, "SELECT 5000 + n_nationkey AS objid, 1000 + n_regionkey AS refobjid FROM nation UNION ALL SELECT 5000 + n_nationkey, n_nationkey FROM nation")
    return postgres.dependencies_of(depend, rewrite, classes, names)


@_query("S13_execute_query", "SELECT o_orderkey, (SELECT count(*) FROM orders) > 100 AS truncated FROM orders ORDER BY o_orderkey LIMIT 100")
def _s13(spark, d):
    run_sql(spark, d, "SELECT * FROM orders")
    return base.execute(spark, "SELECT o_orderkey FROM orders ORDER BY o_orderkey", 100)


_PULL = f"SELECT event_id, captured_at FROM ({_DUCK})"


@_query("S21_incremental_pull", f"{_PULL} WHERE captured_at > TIMESTAMP '2024-01-20 00:00:00' ORDER BY captured_at, event_id LIMIT 50")
def _s21(spark, d):
    return traffic.pulled(query_events(spark, d), "2024-01-20 00:00:00", "2024-01-01", 50).select("event_id", "captured_at")


@_query("S22_lookback_clamp", f"{_PULL} WHERE captured_at > TIMESTAMP '2024-01-24 00:00:00' ORDER BY captured_at, event_id LIMIT 70")
def _s22(spark, d):
    return traffic.pulled(query_events(spark, d), "2020-01-01 00:00:00", "2024-01-01", 70, 7, "2024-01-31 00:00:00").select("event_id", "captured_at")


_FILES = """SELECT concat('/r/', n_name, CASE WHEN n_nationkey % 3 = 2 THEN '.py' ELSE '.sql' END) AS path, CASE n_nationkey % 3 WHEN 0 THEN concat('select * from {{ ref(''stg_', n_regionkey, ''') }} join {{ source(''raw'', ''t', n_nationkey, ''') }} using (id)')
  WHEN 1 THEN concat('create table out.t', n_nationkey, ' as select * from wh.orders o, wh.items; ') ELSE concat('import os\\nq = "select * from wh.T', n_nationkey, '"\\nx = "not sql from nowhere"') END AS text FROM nation"""


@_query("S33_code_references", "SELECT '/r/' || n_name || '.sql' AS path, 'stg_' || CAST(n_regionkey AS VARCHAR) AS table, 'ref' AS how, 'read' AS direction, 1.0::DOUBLE AS confidence FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT '/r/' || n_name || '.sql', 'raw.t' || CAST(n_nationkey AS VARCHAR), 'source', 'read', 1.0 FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT '/r/' || n_name || '.sql', unnest(['wh.orders', 'wh.items']), 'statement', 'read', 0.85 FROM nation WHERE n_nationkey % 3 = 1 UNION ALL SELECT '/r/' || n_name || '.sql', 'out.t' || CAST(n_nationkey AS VARCHAR), 'statement', 'write', 0.85 FROM nation WHERE n_nationkey % 3 = 1")
def _s33(spark, d):
    return code.references(run_sql(spark, d, _FILES)).where("path like '%.sql'")


@_query("S34_python_references", "SELECT '/r/' || n_name || '.py' AS path, 'wh.t' || CAST(n_nationkey AS VARCHAR) AS table, 'string' AS how, 'read' AS direction, 0.8::DOUBLE AS confidence FROM nation WHERE n_nationkey % 3 = 2 UNION ALL SELECT '/r/' || n_name || '.py', 'os', 'import', 'import', 1.0 FROM nation WHERE n_nationkey % 3 = 2")
def _s34(spark, d):
    return code.references(run_sql(spark, d, _FILES)).where("path like '%.py'")


@_query("S35_repository_stitch", "SELECT '/r/' || n_name || '.sql' AS path, 'wh.orders' AS table, 'read' AS direction, 'id_whole' AS id, 0.9::DOUBLE AS confidence FROM nation WHERE n_nationkey % 3 = 1 UNION ALL SELECT '/r/' || n_name || '.sql', 'wh.items', 'read', 'id_tail', 0.7 FROM nation WHERE n_nationkey % 3 = 1")
def _s35(spark, d):
    objects = spark.createDataFrame([("id_whole", "WH.orders"), ("id_tail", "cat.wh.items"), ("id_worse", "cat.wh.orders"), ("other", "x.y")], "id string, name string")
    return code.stitched(code.references(run_sql(spark, d, _FILES)), objects)


QUERIES["S32_repository_files"], ORACLES["S32_repository_files"] = QUERIES["S33_code_references"], ORACLES["S33_code_references"]

@_query("S20_bq_events", "SELECT ts AS captured_at, 'select ' || CAST(event_id AS VARCHAR) AS sql, 'select' AS query_type, event_id AS bytes, 1500.0::DOUBLE AS duration_ms, CASE WHEN event_id % 2 = 0 THEN 'd' END AS dag FROM events WHERE event_type <> 'error'")
def _s20(spark, d):
    jobs = run_sql(spark, d, "SELECT ts AS creation_time, CASE WHEN event_type <> 'error' THEN concat('select ', event_id) END AS query, 'u' AS user_email, 'j' AS job_id, 'SELECT' AS statement_type, event_id AS total_bytes_processed, cast('2024-01-01 00:00:00' AS timestamp) AS start_time, cast('2024-01-01 00:00:01.5' AS timestamp) AS end_time, CASE WHEN event_id % 2 = 0 THEN array(named_struct('key', 'dag_id', 'value', 'd')) END AS labels FROM events")
    return warehouses.job_events(jobs).select("captured_at", "sql", "query_type", "bytes", "duration_ms", F.col("labels")["dag_id"].alias("dag"))


@_query("S23_sf_events", "SELECT ts AS captured_at, 'q' AS sql, event_type AS query_type, value AS duration_ms FROM events")
def _s23(spark, d):
    rows = run_sql(spark, d, "SELECT ts AS start_time, 'q' AS query_text, 'u' AS user_name, cast(event_id AS string) AS query_id, upper(event_type) AS query_type, 1 AS bytes_scanned, value AS total_elapsed_time, cast(NULL AS string) AS error_message FROM events")
    return warehouses.history_events(rows).select("captured_at", "sql", "query_type", "duration_ms")


@_query("S09_extract_definitions", "SELECT 'loom_view' AS object, true AS has_text")
def _s09(spark, d):
    """A view of the catalog and its text; the view is dropped again."""
    spark.sql(f"CREATE OR REPLACE VIEW loom_view AS SELECT n_name FROM parquet.`{d}/nation.parquet`")
    try:
        got = catalog.CatalogAdapter(spark).definitions().where("object = 'loom_view'").select("object", F.contains("definition", F.lit("n_name")).alias("has_text")).collect()
    finally:
        spark.sql("DROP VIEW loom_view")
    return spark.createDataFrame(got, "object string, has_text boolean")


@_query("S25_sqlite", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _s25(spark, d):
    """A table written to a SQLite file of the driver's and read back through the data source, by executors wherever they are."""
    import sqlite3
    import tempfile

    path = f"{tempfile.mkdtemp(prefix='loom-')}/n.db"
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE nation (n_nationkey INTEGER, n_name TEXT, n_regionkey INTEGER)")
        con.executemany("INSERT INTO nation VALUES (?, ?, ?)", [tuple(r) for r in run_sql(spark, d, "SELECT * FROM nation").collect()])
    return SqliteAdapter(spark, path).table("nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


QUERIES["X02_adapter_protocol"], ORACLES["X02_adapter_protocol"] = QUERIES["S25_sqlite"], ORACLES["S25_sqlite"]


@_query("S36_sample", f"SELECT 'sample::' || source AS upstream, 'sample::' || target AS downstream FROM ({_EDGES})")
def _s36(spark, d):
    return sample.install(spark, graph.scratch(spark, "store")).read("edges", "upstream string, downstream string, kind string").select("upstream", "downstream")


_ASSETS = "SELECT 'p::main.part_' || CAST(p_partkey AS STRING_) AS id, 'p' AS source, lower(p_type) AS kind, p_name AS name, p_brand AS description FROM part"
_LINKS = "SELECT DISTINCT 'p::main.part_' || CAST(l_partkey AS STRING_) AS upstream, 's::supplier_' || CAST(l_suppkey AS STRING_) AS downstream, CASE WHEN l_linenumber % 2 = 0 THEN 'schema_match' ELSE 'reads' END AS kind FROM lineitem"


@_query("S37_export", f"SELECT 'assets' AS part, count(*) AS n, CAST(sum(length(id)) AS BIGINT) AS size FROM ({_duck(_ASSETS)}) UNION ALL SELECT 'edges', count(*), CAST(sum(length(upstream)) AS BIGINT) FROM ({_duck(_LINKS)})")
def _s37(spark, d):
    """Written as JSON lines and read back."""
    path = graph.scratch(spark, "export")
    store.export_graph(_both(spark, d, _ASSETS), _both(spark, d, _LINKS), path)
    a, e = spark.read.schema("id string").json(f"{path}/assets"), spark.read.schema("upstream string").json(f"{path}/edges")
    count = lambda df, c, part: df.agg(F.count("*").alias("n"), F.sum(F.length(c)).alias("size")).select(F.lit(part).alias("part"), "n", "size")
    return count(a, "id", "assets").unionByName(count(e, "upstream", "edges"))


@_query("S38_archive", "SELECT 'p' AS source, 'schema' AS capability, 'run1' AS run, count(*) AS n FROM part UNION ALL SELECT 's', 'lineage', 'run2', count(*) FROM supplier")
def _s38(spark, d):
    path = graph.scratch(spark, "archive")
    store.archive(_both(spark, d, "SELECT * FROM part"), path, "p", "schema", "run1")
    store.archive(_both(spark, d, "SELECT * FROM supplier"), path, "s", "lineage", "run2")
    return spark.read.parquet(path).groupBy("source", "capability", "run").agg(F.count("*").alias("n"))


_facts("S41_connector_registry", "kind string, shown string", lambda: [(k, REGISTRY.shown(k, {"path": "/x", "password": "p"})["password"]) for k in sorted(REGISTRY.specs)], [("postgres", "***"), ("spark", "p"), ("sqlite", "p")])


def _retries():
    waits, tries = [], []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise base.Retryable
        return "done"

    return [(base.retried(call, 4, 0.5, waits.append), len(tries), ",".join(map(str, waits)))]


_facts("S42_retry", "result string, tries bigint, waits string", _retries, [("done", 3, "0.5,1.0")])

# ---- traffic and text


@_query("T07_normalized", f"SELECT event_id, {_NORM.replace('lower(trim(', '(trim(', 1)} AS text FROM ({_DUCK})")
def _t07(spark, d):
    return query_events(spark, d).select("event_id", sqltext.normalized(F.col("sql"), lower=False).alias("text"))


@_query("T08_table_references", f"SELECT event_id, array_to_string({_REFS}, ',') AS tables FROM ({_DUCK})")
def _t08(spark, d):
    return query_events(spark, d).select("event_id", F.array_join("tables", ",").alias("tables"))


@_query("T09_table_names", f"SELECT DISTINCT unnest({_REFS}) AS name FROM ({_DUCK})")
def _t09(spark, d):
    return query_events(spark, d).select(F.explode("tables").alias("name")).distinct()


_META = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{\"bytes_processed\": ' || CAST(event_id AS STRING_) || '}' WHEN 1 THEN '{\"total_bytes_processed\": 7, \"bytes_processed\": null}' WHEN 2 THEN '{\"bytes_processed\": \"many\"}' END AS metadata FROM events"


@_query("B05_processed_bytes", f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN 7 END AS bytes FROM ({_duck(_META)})")
def _b05(spark, d):
    return _both(spark, d, _META).select("event_id", traffic.processed_bytes(F.col("metadata")).alias("bytes"))


_COMBINED = f"SELECT 'breakdown' AS part, count(DISTINCT {_CLASS}) AS n FROM ({_DUCK}) UNION ALL SELECT 'frequent', count(DISTINCT {_NORM}) FROM ({_DUCK}) UNION ALL SELECT 'table_access', count(DISTINCT t) FROM (SELECT unnest({_REFS}) AS t FROM ({_DUCK})) UNION ALL SELECT 'user_activity', count(DISTINCT coalesce(database_user, '<unknown>')) FROM ({_DUCK}) UNION ALL SELECT 'events', 1"


@_query("B08_combined", _COMBINED)
def _b08(spark, d):
    out = None
    for name, df in traffic.analytics(query_events(spark, d)).items():
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = part if out is None else out.unionByName(part)
    return out


QUERIES["B09_server_side"], ORACLES["B09_server_side"] = QUERIES["B08_combined"], ORACLES["B08_combined"]


@_query("B11_bq_consumer", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'airflow:d' || CAST(user_id AS VARCHAR) || ':t' WHEN 1 THEN 'airflow:x' WHEN 2 THEN 'web' WHEN 3 THEN 'user:a@b.c' ELSE 'job:j' || CAST(event_id AS VARCHAR) END AS name, CAST(CASE event_id % 5 WHEN 0 THEN 0.95 WHEN 1 THEN 0.95 WHEN 2 THEN 0.8 WHEN 3 THEN 0.7 ELSE 0.4 END AS DOUBLE) AS confidence FROM events")
def _b11(spark, d):
    e = run_sql(spark, d, "SELECT event_id, CASE event_id % 5 WHEN 0 THEN map('dag_id', concat('d', user_id), 'airflow_task', 't') WHEN 1 THEN map('airflow_dag', 'x', 'service', 'y') WHEN 2 THEN map('dag_id', '', 'app', 'Web-v2') ELSE map('other', 'z') END AS labels, CASE WHEN event_id % 5 = 3 THEN ' a@b.c ' END AS email, concat('j', event_id) AS job FROM events")
    return e.select("event_id", sqltext.bq_consumer(F.col("labels"), F.col("email"), F.col("job")).alias("w")).select("event_id", "w.name", "w.confidence")


_CASED = _NORM.replace("lower(trim(", "(trim(", 1)


@_query("B13_stitch_fingerprint", f"SELECT event_id, substr(sha256({_CASED}), 1, 16) AS fingerprint FROM ({_DUCK})")
def _b13(spark, d):
    return query_events(spark, d).select("event_id", sqltext.fingerprint(sqltext.normalized(F.col("sql"), lower=False)).alias("fingerprint"))


@_query("B14_storage_modes", f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN {_CASED} ELSE sql END AS text FROM ({_DUCK})")
def _b14(spark, d):
    mode = F.when(F.col("event_id") % 3 == 0, "fingerprint_only").when(F.col("event_id") % 3 == 1, "redacted_sql").otherwise("full_sql")
    return query_events(spark, d).select("event_id", sqltext.stored_text(F.col("sql"), mode).alias("text"))


_WRITES = "lower(regexp_extract(sql, '^(?i)(?:insert\\s+into|update)\\s+([A-Za-z_]+)', 1))"
_FLOW = f"SELECT captured_at, 'w::' || t AS upstream, CASE WHEN w <> '' THEN 'w::' || w ELSE 'w::query::' || coalesce(database_user, 'unknown') END AS downstream, CASE WHEN w <> '' THEN 'writes' ELSE 'reads' END AS kind FROM (SELECT *, unnest({_REFS}) AS t, {_WRITES} AS w FROM ({_DUCK}))"


@_query("B15_stitched_edges", f"SELECT upstream, downstream, kind, count(*) AS n, max(captured_at) AS last_seen FROM ({_FLOW}) GROUP BY 1, 2, 3")
def _b15(spark, d):
    return traffic.stitched(query_events(spark, d), "w")[0]


@_query("B15_stitched_queries", f"SELECT substr(sha256({_CASED}), 1, 16) AS fingerprint, arg_min(sql, (captured_at, sql)) AS sql_text, count(*) AS n, max(captured_at) AS last_seen FROM ({_DUCK}) WHERE query_type <> 'UPDATE' GROUP BY 1")
def _b15q(spark, d):
    return traffic.stitched(query_events(spark, d), "w")[1].select("fingerprint", "sql_text", "n", "last_seen")


@_query("I06_retention", f"SELECT fingerprint, n FROM (SELECT substr(sha256({_CASED}), 1, 16) AS fingerprint, count(*) AS n, max(captured_at) AS last_seen FROM ({_DUCK}) WHERE query_type <> 'UPDATE' GROUP BY 1) WHERE last_seen >= TIMESTAMP '2024-01-30 00:00:00'")
def _i06(spark, d):
    return traffic.retained(traffic.stitched(query_events(spark, d), "w")[1], 3, "2024-02-02 00:00:00").select("fingerprint", "n")


@_query("I04_observation_cursor", f"SELECT CAST(max(captured_at) AS VARCHAR) AS cursor FROM ({_DUCK})")
def _i04(spark, d):
    return spark.createDataFrame([(traffic.next_cursor(query_events(spark, d), "2024-01-05 00:00:00"),)], "cursor string")


# ---- graph

_PAIRS = "SELECT DISTINCT 'p' || CAST(l_partkey % 40 AS STRING_) AS source, 's' || CAST(l_suppkey % 15 AS STRING_) AS target FROM lineitem WHERE l_partkey % 40 > l_suppkey % 15 + 5"


@_query("G01_edges_from_sql", f"SELECT DISTINCT t AS upstream, CASE WHEN w <> '' THEN w ELSE 'c::' || source_name END AS downstream, CASE WHEN w <> '' THEN 'writes' ELSE 'reads' END AS kind FROM (SELECT *, unnest({_REFS}) AS t, {_WRITES} AS w FROM ({_DUCK}))")
def _g01(spark, d):
    return graph.edges_of(query_events(spark, d), F.concat(F.lit("c::"), F.col("source_name")))


@_query("G05_build_graph", f"WITH e AS ({_duck(_PAIRS)}) SELECT node, CAST(sum(up) AS BIGINT) AS upstream, CAST(sum(down) AS BIGINT) AS downstream FROM (SELECT source AS node, 0 AS up, 1 AS down FROM e UNION ALL SELECT target, 1, 0 FROM e) GROUP BY 1")
def _g05(spark, d):
    return graph.nodes_of(_both(spark, d, _PAIRS))


@_query("G07_membership", f"SELECT node, node IN (SELECT source FROM ({_duck(_PAIRS)}) UNION SELECT target FROM ({_duck(_PAIRS)})) AS known FROM (SELECT 'p' || CAST(n_nationkey * 2 AS VARCHAR) AS node FROM nation)")
def _g07(spark, d):
    return graph.has_node(_both(spark, d, _PAIRS), _both(spark, d, "SELECT 'p' || CAST(n_nationkey * 2 AS STRING_) AS node FROM nation"))


@_query("G08_lineage_summary", f"SELECT 'p30' AS node, true AS asset_exists, (SELECT string_agg(target, ',' ORDER BY target) FROM ({_duck(_PAIRS)}) WHERE source = 'p30') AS related")
def _g08(spark, d):
    return graph.lineage_summary(_both(spark, d, _PAIRS), "p30").withColumn("related", F.array_join("related", ","))


_COLUMNS = "SELECT 'p::main.part_' || CAST(p_partkey AS STRING_) AS asset, CASE WHEN p_size % 2 = 0 THEN 'Supplier_7_id' ELSE 'other' END AS column_name, CASE WHEN p_size % 2 = 1 THEN 'see SUPPLIER_7' END AS description FROM part"


@_query("G10_relationship", f"WITH e AS ({_duck(_LINKS)}), k AS (SELECT min(upstream) AS a FROM e WHERE downstream = 's::supplier_7') SELECT 'edge' AS what, upstream, downstream, kind AS detail FROM e, k WHERE upstream = a AND downstream = 's::supplier_7' UNION ALL SELECT 'possible key', asset, 's::supplier_7', column_name FROM ({_duck(_COLUMNS)}), k WHERE asset = a")
def _g10(spark, d):
    links = _both(spark, d, _LINKS)
    one = links.where("downstream = 's::supplier_7'").agg(F.min("upstream")).first()[0]
    return graph.relationship(links, _both(spark, d, _COLUMNS), one, "s::supplier_7")


@_query("G12_declared_sources", "SELECT DISTINCT 'w::' || n_name AS upstream, 'model_' || CAST(n_regionkey AS VARCHAR) AS downstream, 1.0::DOUBLE AS confidence FROM nation WHERE n_nationkey % 2 = 0")
def _g12(spark, d):
    declared = run_sql(spark, d, "SELECT concat('model_', n_regionkey) AS node, 'RAW' AS schema, n_name AS table FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'model_0', 'other', n_name FROM nation")
    return graph.resolved_sources(declared, run_sql(spark, d, "SELECT concat('w::', n_name) AS asset, 'raw' AS schema, lower(n_name) AS table FROM nation"))


def _systems(spark, d):
    sql = "SELECT concat('sys', n_regionkey) AS source, 'main' AS schema, concat('t', n_nationkey % 4) AS object, cast(NULL AS bigint) AS row_count, array(named_struct('name', 'id', 'type', 'int'), named_struct('name', concat('c', n_nationkey % 3), 'type', 'text')) AS columns FROM nation"
    return run_sql(spark, d, sql)


_SYS = "SELECT 'sys' || CAST(n_regionkey AS VARCHAR) AS source, 't' || CAST(n_nationkey % 4 AS VARCHAR) AS object, n_nationkey % 3 AS c FROM nation"
_FOUND = f"WITH o AS ({_SYS}), p AS (SELECT a.source || '::main.' || a.object AS upstream, b.source || '::main.' || b.object AS downstream, b.source AS dest, CAST(round((0.5 + CASE WHEN a.c = b.c THEN 0.3 ELSE 0.3 / 3 END + 0.1) / 0.9, 6) AS DOUBLE) AS score FROM o a JOIN o b ON a.object = b.object AND a.source < b.source {{where}}), r AS (SELECT *, row_number() OVER (PARTITION BY upstream, dest ORDER BY score DESC, downstream) AS nth FROM p) SELECT upstream, downstream, 'schema_match' AS kind, score FROM r WHERE nth = 1 AND score >= 0.6"


@_query("G13_cross_system_discovery", _FOUND.format(where="AND a.source <> 'sys4' AND b.source <> 'sys4'"))
def _g13(spark, d):
    return graph.discovered(_systems(spark, d), deny=["sys4"])


@_query("G16_row_similarity", "SELECT o_orderkey, CAST(round(1 - abs(o_custkey - o_orderkey) / greatest(o_custkey, o_orderkey, 1), 6) AS DOUBLE) AS similarity FROM orders")
def _g16(spark, d):
    return run_sql(spark, d, "SELECT * FROM orders").select("o_orderkey", F.round(graph.row_similarity(F.col("o_custkey"), F.col("o_orderkey")), 6).alias("similarity"))


@_query("G17_match_ranking", f"WITH o AS ({_SYS}), p AS (SELECT a.object AS s, b.object AS t, CAST(round((CASE WHEN a.object = b.object THEN 0.5 ELSE 0 END + CASE WHEN a.c = b.c THEN 0.3 ELSE 0.3 / 3 END + 0.1) / 0.9, 6) AS DOUBLE) AS score FROM o a, o b WHERE a.source = 'sys0' AND b.source = 'sys1') SELECT s AS source_object, t AS target_object, score, CAST(row_number() OVER (PARTITION BY s ORDER BY score DESC, t) AS INTEGER) AS rank, score >= 0.6 AND row_number() OVER (PARTITION BY s ORDER BY score DESC, t) = 1 AS primary_match FROM p")
def _g17(spark, d):
    """All candidates of one source, the others than the best included."""
    o = _systems(spark, d)
    return graph.match_scores(o.where("source = 'sys0'"), o.where("source = 'sys1'"), every=True)


@_query("G18_destination_scope", "SELECT n_name AS object FROM nation WHERE n_regionkey IN (1, 2) AND n_nationkey % 2 = 0")
def _g18(spark, d):
    o = run_sql(spark, d, "SELECT concat('S', n_regionkey) AS schema, n_name AS object, CASE WHEN n_nationkey % 2 = 0 THEN array(named_struct('name', 'x', 'type', 'int')) ELSE array() END AS columns FROM nation")
    return graph.in_scope(o, ["s1", "s2"]).select("object")


_LEARN = "SELECT upstream, CASE WHEN kind = 'schema_match' AND upstream LIKE '%1' THEN upstream ELSE downstream END AS downstream, kind, CASE WHEN upstream LIKE '%3' THEN 'learned' END AS learning_status FROM ({links}) AS l"


@_query("G19_unlearned", f"SELECT * FROM ({_LEARN.format(links=_duck(_LINKS))}) WHERE kind = 'schema_match' AND upstream <> downstream AND coalesce(learning_status, '') <> 'learned' AND (starts_with(upstream, 'p::') OR starts_with(downstream, 'p::'))")
def _g19(spark, d):
    return graph.unlearned(_both(spark, d, _LEARN.format(links=_LINKS)), "p")


@_query("G20_schema_projection", "SELECT 'w::s' || CAST(n_regionkey AS VARCHAR) || '.' || n_name AS upstream, 'w::v.' || n_name AS downstream, 'depends_on' AS kind FROM nation WHERE n_nationkey % 2 = 0")
def _g20(spark, d):
    objects = run_sql(spark, d, "SELECT concat('s', n_regionkey) AS schema, n_name AS object, 'table' AS kind, array(named_struct('name', 'x', 'type', 'int')) AS columns FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'v', n_name, 'view', array() FROM nation")
    deps = run_sql(spark, d, "SELECT 'v' AS from_schema, n_name AS from_object, concat('s', n_regionkey) AS to_schema, n_name AS to_object FROM nation")
    return graph.projected_schema(objects, deps, "w")[2]


@_query("G21_lineage_projection", "SELECT DISTINCT id, split_part(id, '::', 1) AS source, 'external' AS kind, split_part(id, '::', 2) AS name FROM (SELECT 'w::' || r_name AS id FROM region UNION ALL SELECT 'x::' || n_name FROM nation WHERE n_nationkey % 2 = 1)")
def _g21(spark, d):
    edges = run_sql(spark, d, "SELECT r_name AS source_object, concat('x::', n_name) AS target_object, 'declared' AS edge_kind FROM nation JOIN region ON n_regionkey = r_regionkey")
    return graph.projected_lineage(edges, run_sql(spark, d, "SELECT concat('x::', n_name) AS id FROM nation WHERE n_nationkey % 2 = 0"), "w")[0]


# ---- store

_A = "SELECT 'a' || CAST(o_custkey AS STRING_) AS id, 's' AS source, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS kind, o_orderpriority AS name, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS description, CAST(o_orderkey AS STRING_) AS tag, o_orderkey AS seen, o_orderkey % 5 = 0 AS placeholder FROM orders"


def _assets(spark, d, keep: str):
    rows = _both(spark, d, f"SELECT * FROM ({_A}) WHERE {keep}")
    return rows.select("id", "source", "kind", "name", "description", F.array(F.concat(F.lit("t"), F.col("kind"))).alias("tags"), F.create_map(F.lit("last"), F.col("tag")).alias("metadata"), "seen", "placeholder")


@_query("D02_asset_merge", f"SELECT id, coalesce(arg_max(kind, seen) FILTER (NOT placeholder AND kind IS NOT NULL), arg_max(kind, seen) FILTER (kind IS NOT NULL), 'external') AS kind, arg_max(name, seen) AS name, arg_max(description, seen) FILTER (description IS NOT NULL) AS description, arg_max(tag, seen) AS last, min(seen) AS first_seen, max(seen) AS last_seen FROM ({_duck(_A)}) GROUP BY 1")
def _d02(spark, d):
    got = store.merged_assets(_assets(spark, d, "seen % 4 < 2"), _assets(spark, d, "seen % 4 >= 2"))
    return got.select("id", "kind", "name", "description", F.col("metadata")["last"].alias("last"), "first_seen", "last_seen")


@_query("D01_written_counts", "SELECT count(*) FILTER (o IS NULL) AS inserted, count(*) FILTER (o IS NOT NULL) AS updated FROM (SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal > 0) n LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders WHERE o_totalprice > 200000) x ON n.c_custkey = x.o")
def _d01c(spark, d):
    return store.written(run_sql(spark, d, "SELECT o_custkey AS id FROM orders WHERE o_totalprice > 200000"), run_sql(spark, d, "SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0"), ["id"])


@_query("D03_search", f"SELECT id FROM ({_duck(_ASSETS)}) WHERE lower(id) LIKE '%part\\_1%' ESCAPE '\\' OR lower(name) LIKE '%part\\_1%' ESCAPE '\\' OR lower(description) LIKE '%part\\_1%' ESCAPE '\\'")
def _d03(spark, d):
    return store.search_assets(_both(spark, d, _ASSETS), "Part_1").select("id")


@_query("D04_delete_cascade", f"SELECT 'assets' AS part, count(*) AS n FROM part WHERE p_size <= 20 UNION ALL SELECT 'edges', count(*) FROM ({_duck(_LINKS)}) WHERE upstream NOT IN (SELECT 'p::main.part_' || CAST(p_partkey AS VARCHAR) FROM part WHERE p_size > 20)")
def _d04(spark, d):
    ids = _both(spark, d, "SELECT 'p::main.part_' || CAST(p_partkey AS STRING_) AS id FROM part WHERE p_size > 20")
    left = store.deleted(_both(spark, d, _ASSETS), ids, {"edges": (_both(spark, d, _LINKS), ["upstream", "downstream"])})
    count = lambda p: left[p].agg(F.count("*").alias("n")).select(F.lit(p).alias("part"), "n")
    return count("assets").unionByName(count("edges"))


_E = "SELECT 'p' || CAST(l_partkey % 50 AS STRING_) AS upstream, 's' || CAST(l_suppkey % 9 AS STRING_) AS downstream, l_returnflag AS kind, CAST(l_linenumber AS STRING_) AS metadata, l_shipdate AS seen FROM lineitem"


@_query("D05_edge_upsert", f"SELECT upstream, downstream, kind, arg_max(metadata, (seen, metadata)) AS metadata, min(seen) AS first_seen, max(seen) AS last_seen FROM ({_duck(_E)}) GROUP BY 1, 2, 3")
def _d05(spark, d):
    e = _both(spark, d, _E)
    return store.merged_edges(e.where("seen < '1996-01-01'"), e.where("seen >= '1996-01-01'"))


for _side, _where in (("upstream", "downstream = 's3'"), ("downstream", "upstream = 's3'"), ("both", "downstream = 's3' OR upstream = 's3'")):
    QUERIES[f"D06_neighbours_{_side}"] = lambda s, d, side=_side: store.neighbours(_both(s, d, _E).unionByName(_both(s, d, _E).select(F.col("downstream").alias("upstream"), F.col("upstream").alias("downstream"), "kind", "metadata", "seen")), "s3", side).select("upstream", "downstream", "kind").distinct()
    ORACLES[f"D06_neighbours_{_side}"] = f"SELECT DISTINCT upstream, downstream, kind FROM (SELECT upstream, downstream, kind FROM ({_duck(_E)}) UNION ALL SELECT downstream, upstream, kind FROM ({_duck(_E)})) WHERE {_where}"

_OBS = "SELECT 'f' || CAST(o_custkey % 60 AS STRING_) AS fingerprint, 'select ' || CAST(o_orderkey AS STRING_) AS sql_text, CAST(1 AS BIGINT) AS n, o_orderkey AS last_seen, 'a' || CAST(o_custkey % 7 AS STRING_) AS t1, 'a' || CAST(o_custkey % 11 AS STRING_) AS t2 FROM orders"


def _observed(spark, d):
    o = _both(spark, d, _OBS).withColumn("tables", F.array_distinct(F.array("t1", "t2"))).drop("t1", "t2")
    known = spark.createDataFrame([(f"a{i}",) for i in range(9)], "id string")
    return store.merged_queries(o.where("last_seen % 2 = 0"), o.where("last_seen % 2 = 1"), known)


@_query("D07_query_upsert", f"SELECT fingerprint, arg_max(sql_text, last_seen) AS sql_text, CAST(sum(n) AS BIGINT) AS n, max(last_seen) AS last_seen FROM ({_duck(_OBS)}) GROUP BY 1")
def _d07(spark, d):
    return _observed(spark, d)[0].drop("tables")


_BRIDGE = f"SELECT DISTINCT fingerprint, unnest([t1, t2]) AS asset FROM (SELECT fingerprint, arg_max(t1, last_seen) AS t1, arg_max(t2, last_seen) AS t2 FROM ({_duck(_OBS)}) GROUP BY 1)"


@_query("D07_bridge", f"SELECT * FROM ({_BRIDGE}) WHERE asset NOT IN ('a9', 'a10')")
def _d07b(spark, d):
    return _observed(spark, d)[1]


@_query("D08_queries_of_asset", f"SELECT fingerprint, CAST(sum(n) AS BIGINT) AS n FROM ({_duck(_OBS)}) WHERE fingerprint IN (SELECT fingerprint FROM ({_BRIDGE}) WHERE asset = 'a3') GROUP BY 1")
def _d08(spark, d):
    q, bridge = _observed(spark, d)
    return store.queries_of(q, bridge, "a3").select("fingerprint", "n")


@_query("O06_top_queries", f"SELECT fingerprint, CAST(sum(n) AS BIGINT) AS n FROM ({_duck(_OBS)}) GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def _o06(spark, d):
    return store.top_queries(_observed(spark, d)[0], 10).select("fingerprint", "n")


QUERIES["Q17_query_patterns"], ORACLES["Q17_query_patterns"] = QUERIES["O06_top_queries"], ORACLES["O06_top_queries"]


@_query("D09_retention", f"SELECT fingerprint FROM (SELECT fingerprint, max(last_seen) AS m FROM ({_duck(_OBS)}) GROUP BY 1) WHERE m >= (SELECT max(o_orderkey) - 100 FROM orders)")
def _d09(spark, d):
    last = run_sql(spark, d, "SELECT max(o_orderkey) - 100 AS k FROM orders").first()[0]
    return store.pruned(_observed(spark, d)[0], F.lit(last)).select("fingerprint")


_SNAP = "SELECT o_custkey AS asset, o_orderdate AS captured_at, o_orderkey AS id, o_orderstatus AS fingerprint FROM orders"


@_query("D10_latest_snapshot", "SELECT o_custkey AS asset, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS id FROM orders GROUP BY 1")
def _d10(spark, d):
    return store.latest(_both(spark, d, _SNAP)).select("asset", "id")


@_query("D10_history", "SELECT o_orderkey AS id, o_orderdate AS captured_at FROM orders WHERE o_custkey = 7")
def _d10h(spark, d):
    return store.history(_both(spark, d, _SNAP), 7).select("id", "captured_at")


QUERIES["D11_latest_many"], ORACLES["D11_latest_many"] = QUERIES["D10_latest_snapshot"], ORACLES["D10_latest_snapshot"]


@_query("D12_insert_if_new", f"SELECT asset, id FROM (SELECT *, lag(fingerprint) OVER (PARTITION BY asset ORDER BY captured_at, id) AS was FROM ({_SNAP})) WHERE was IS NULL OR was <> fingerprint")
def _d12(spark, d):
    return store.changed(_both(spark, d, _SNAP)).select("asset", "id")


@_query("D13_consumers", "SELECT c_custkey AS id, coalesce(string_agg(DISTINCT CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)), '') AS assets FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000 GROUP BY 1")
def _d13(spark, d):
    got = store.consumers(run_sql(spark, d, "SELECT c_custkey AS id FROM customer"), _both(spark, d, "SELECT o_custkey AS consumer, CAST(o_orderkey AS STRING_) AS asset FROM orders WHERE o_totalprice > 250000"))
    return got.select("id", F.array_join("assets", ",").alias("assets"))


QUERIES["F16_group_concat"], ORACLES["F16_group_concat"] = QUERIES["D13_consumers"], ORACLES["D13_consumers"]
_CONTRACT = "SELECT 'c' || CAST(o_custkey % 90 AS STRING_) AS id, 'a' || CAST(o_custkey % 30 AS STRING_) AS asset, CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN NULL ELSE 'deprecated' END AS status, o_orderkey AS updated_at FROM orders"
for _id, _slug in (("D14", "contract"), ("D17", "annotation"), ("D21", "term"), ("D22", "profile"), ("Q18", "define_term")):
    QUERIES[f"{_id}_{_slug}_upsert"] = lambda s, d: store.merged_latest(_both(s, d, _CONTRACT).where("updated_at % 3 = 0"), _both(s, d, _CONTRACT).where("updated_at % 3 <> 0"), ["id"], "updated_at")
    ORACLES[f"{_id}_{_slug}_upsert"] = f"SELECT id, arg_max(asset, updated_at) AS asset, (max((updated_at, status))[2]) AS status, max(updated_at) AS updated_at FROM ({_duck(_CONTRACT)}) GROUP BY 1"

_V = "SELECT 'v' || CAST(o_custkey AS STRING_) AS id, 'a' AS asset, 'type_changed' AS kind, o_orderpriority AS severity, o_orderdate AS detected_at, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS resolved_at FROM orders WHERE o_orderkey % 10 < 3"
_V1 = f"SELECT id, min(asset) AS asset, min(kind) AS kind, min(severity) AS severity, min(detected_at) AS detected_at, max(resolved_at) AS resolved_at FROM ({_V}) AS v GROUP BY id"
_V2 = "SELECT DISTINCT 'v' || CAST(o_custkey AS STRING_) AS id, 'a' AS asset, 'type_changed' AS kind, 'error' AS severity, TIMESTAMP '2020-01-01 00:00:00' AS detected_at FROM orders WHERE o_custkey % 4 = 0"


@_query("D15_violation_reopens", f"SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN o.severity ELSE 'error' END AS severity, coalesce(o.detected_at, n.detected_at) AS detected_at, CASE WHEN n.id IS NULL THEN o.resolved_at END AS resolved_at FROM ({_duck(_V1)}) o FULL JOIN ({_duck(_V2)}) n ON o.id = n.id")
def _d15(spark, d):
    return store.violations_after(_both(spark, d, _V1), _both(spark, d, _V2)).select("id", "severity", "detected_at", "resolved_at")


@_query("D16_open_violations", f"SELECT id FROM ({_duck(_V1)}) WHERE resolved_at IS NULL")
def _d16(spark, d):
    return store.open_violations(_both(spark, d, _V1)).select("id")


@_query("D16_recent_violations", f"SELECT id, detected_at FROM ({_duck(_V1)}) ORDER BY detected_at DESC, id LIMIT 20")
def _d16r(spark, d):
    return store.recent_violations(_both(spark, d, _V1), 20).select("id", "detected_at")


@_query("D16_resolve", f"SELECT id, coalesce(resolved_at, CASE WHEN id LIKE 'v1%' THEN TIMESTAMP '2021-01-01 00:00:00' END) AS resolved_at FROM ({_duck(_V1)})")
def _d16x(spark, d):
    v = _both(spark, d, _V1)
    return store.resolved(v, v.where("id like 'v1%'").select("id"), F.lit("2021-01-01 00:00:00").cast("timestamp")).select("id", "resolved_at")


_NOTES = "SELECT doc_id, text FROM documents"


@_query("D18_full_text_plain", """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(lower(coalesce(text, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\\p{L}\\p{N}]+')) AS word FROM documents),
  t AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY 1, 2), n AS (SELECT doc_id, sum(tf) AS size FROM t GROUP BY 1), a AS (SELECT count(*) AS docs, avg(size) AS mean FROM n),
  hit AS (SELECT doc_id FROM t WHERE word IN ('the', 'of') GROUP BY 1 HAVING count(*) = 2 UNION SELECT doc_id FROM t WHERE word = 'und'), df AS (SELECT word, count(*) AS df FROM t WHERE word IN ('the', 'of', 'und') GROUP BY 1)
  SELECT t.doc_id AS key, CAST(round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS DOUBLE) AS rank FROM t JOIN hit ON t.doc_id = hit.doc_id JOIN df ON t.word = df.word JOIN n ON n.doc_id = t.doc_id, a GROUP BY 1""")
def _d18(spark, d):
    return search.bm25(search.index(run_sql(spark, d, _NOTES), "doc_id", F.col("text"), stemmed=False), search.parsed_match("the of OR und", stemmed=False))


_facts("D18_porter_stems", "word string, stem string", lambda: [(w, search.stem(w)) for w in "caresses ponies cats agreed plastered motoring sing hopping falling hoping happy sky relational conditional rational digitizer operator feudalism decisiveness hopefulness formaliti triplicate formative electrical goodness revival allowance inference adjustable replacement adoption probate rate controll roll".split()], [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("hopping", "hop"), ("falling", "fall"), ("hoping", "hope"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("rational", "ration"), ("digitizer", "digit"), ("operator", "oper"), ("feudalism", "feudal"), ("decisiveness", "decis"), ("hopefulness", "hope"), ("formaliti", "formal"), ("triplicate", "triplic"), ("formative", "form"), ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"), ("allowance", "allow"), ("inference", "infer"), ("adjustable", "adjust"), ("replacement", "replac"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll")])


@_query("D19_unannotated", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def _d19(spark, d):
    return store.unannotated(run_sql(spark, d, "SELECT c_custkey AS id FROM customer"), run_sql(spark, d, "SELECT DISTINCT o_custkey AS asset FROM orders WHERE o_totalprice > 250000"))


@_query("D20_stale_annotations", "SELECT o_orderkey AS asset, o_orderdate AS annotated_at FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 90 DAY")
def _d20(spark, d):
    return store.stale(run_sql(spark, d, "SELECT o_orderkey AS asset, o_orderdate AS annotated_at FROM orders"), 90, F.lit("1998-01-01 00:00:00").cast("timestamp"))


QUERIES["F17_relative_dates"], ORACLES["F17_relative_dates"] = QUERIES["D20_stale_annotations"], ORACLES["D20_stale_annotations"]


@_query("D21_term_search", "SELECT p_partkey AS name FROM part WHERE lower(p_name) LIKE '%cold%'")
def _d21(spark, d):
    return run_sql(spark, d, "SELECT p_partkey AS name, p_name FROM part").where(store.contains("COLD", "p_name")).select("name")


@_query("D23_migration", "SELECT n_nationkey, n_name, NULL::BIGINT AS added FROM nation")
def _d23(spark, d):
    """A column is added to the stored version; adding it again changes nothing."""
    s = store.Store(spark, graph.scratch(spark, "store"))
    s.write("nation", run_sql(spark, d, "SELECT n_nationkey, n_name FROM nation"))
    assert s.migrate("nation", {"added": "bigint"}) and not s.migrate("nation", {"added": "bigint"})
    return s.read("nation", "n_nationkey int, n_name string, added bigint")


_L = "SELECT c_custkey AS id, c_name AS v, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey AS STRING_) END AS last_seen FROM customer"
_R = "SELECT c_custkey + 10 AS id, c_mktsegment AS v, CAST(c_custkey + 10 - c_custkey % 2 AS STRING_) AS last_seen FROM customer"


@_query("D24_sync_conflicts", f"SELECT coalesce(l.id, r.id) AS id, CASE WHEN l.id IS NULL OR (r.id IS NOT NULL AND coalesce(r.last_seen, '') >= coalesce(l.last_seen, '')) THEN r.v ELSE l.v END AS v FROM ({_duck(_L)}) l FULL JOIN ({_duck(_R)}) r ON l.id = r.id")
def _d24(spark, d):
    return store.synced(_both(spark, d, _L), _both(spark, d, _R), ["id"]).select("id", "v")


@_query("D24_server_wins", f"SELECT coalesce(l.id, r.id) AS id, CASE WHEN r.id IS NULL THEN l.v ELSE r.v END AS v FROM ({_duck(_L)}) l FULL JOIN ({_duck(_R)}) r ON l.id = r.id")
def _d24s(spark, d):
    return store.synced(_both(spark, d, _L), _both(spark, d, _R), ["id"], server_wins=True).select("id", "v")


@_query("D25_sync_cursor", "SELECT greatest((SELECT max(o_orderdate) FROM orders), (SELECT max(ts) FROM events)) AS cursor")
def _d25(spark, d):
    return store.sync_cursor(_both(spark, d, "SELECT CAST(o_orderdate AS STRING_) AS last_seen FROM orders"), _both(spark, d, "SELECT CAST(ts AS STRING_) AS last_seen FROM events UNION ALL SELECT 'never'"))


QUERIES["I07_sync_cursor"], ORACLES["I07_sync_cursor"] = QUERIES["D25_sync_cursor"], ORACLES["D25_sync_cursor"]
QUERIES["S39_sync"], ORACLES["S39_sync"] = QUERIES["D24_sync_conflicts"], ORACLES["D24_sync_conflicts"]

# ---- profiles, contracts, search tools


@_query("Q03_sample_values", "SELECT DISTINCT CAST(o_orderdate AS VARCHAR) AS value FROM orders ORDER BY 1 LIMIT 5")
def _q03(spark, d):
    return governance.sample_values(run_sql(spark, d, "SELECT * FROM orders"), "o_orderdate")


_SELECTED = f"WITH c AS (SELECT *, bool_or(status = 'active') OVER (PARTITION BY asset) AS any_, row_number() OVER (PARTITION BY asset ORDER BY updated_at DESC, id) AS nth FROM (SELECT * FROM ({_duck(_CONTRACT)}) WHERE status IS NULL OR status <> 'deprecated')) SELECT id, asset, status, updated_at FROM c WHERE status = 'active' OR (NOT coalesce(any_, false) AND nth = 1)"


@_query("Q07_contract_selection", _SELECTED)
def _q07(spark, d):
    return governance.selected_contracts(_both(spark, d, _CONTRACT))


_PAYLOAD = """SELECT n_name AS asset, CASE n_nationkey % 4 WHEN 0 THEN '{"columns": [{"name": "a", "type": "int", "nullable": false}]}' WHEN 1 THEN '{"schema": {"columns": [{"name": "b", "type": "text"}]}}' WHEN 2 THEN '{"spec": {"columns": [{"name": "c"}, {"name": "d", "type": "x"}]}}' ELSE '{"other": 1}' END AS payload FROM nation"""


@_query("Q08_contract_payload", "SELECT n_name AS asset, 'a' AS column_name, 'int' AS type, false AS nullable FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT n_name, 'b', 'text', true FROM nation WHERE n_nationkey % 4 = 1 UNION ALL SELECT n_name, unnest(['c', 'd']), unnest(['', 'x']), true FROM nation WHERE n_nationkey % 4 = 2")
def _q08(spark, d):
    return governance.contract_columns(run_sql(spark, d, _PAYLOAD))


def _scan(spark, d):
    return run_sql(spark, d, "SELECT n_name AS asset, 'A' AS column_name, 'INT' AS type, n_nationkey % 8 = 0 AS nullable FROM nation UNION ALL SELECT n_name, 'b', 'varchar', true FROM nation WHERE n_nationkey % 3 = 1")


@_query("Q09_enforcement_run", "WITH i AS (SELECT n_name AS asset, n_nationkey AS k, CASE WHEN n_nationkey % 8 = 0 THEN 1 WHEN n_nationkey % 4 = 1 THEN 1 WHEN n_nationkey % 4 = 2 THEN 2 END AS n FROM nation WHERE n_nationkey % 5 <> 0) SELECT asset, CASE WHEN k % 2 = 0 THEN 'enforce' ELSE 'shadow' END AS mode, n::BIGINT AS n, k % 2 = 0 AS blocked FROM i WHERE n IS NOT NULL")
def _q09(spark, d):
    contracts = run_sql(spark, d, "SELECT concat('c', n_nationkey) AS id, n_name AS asset, CASE WHEN n_nationkey % 5 = 0 THEN 'deprecated' ELSE 'active' END AS status, 1 AS updated_at FROM nation")
    payloads = run_sql(spark, d, f"SELECT concat('c', n_nationkey) AS id, payload FROM nation JOIN ({_PAYLOAD}) AS p ON p.asset = n_name")
    modes = run_sql(spark, d, "SELECT n_name AS asset, CASE WHEN n_nationkey % 2 = 0 THEN 'enforce' ELSE 'odd' END AS mode FROM nation")
    return governance.enforcement_run(contracts, payloads, _scan(spark, d), modes)


@_query("Q10_contract_files", "SELECT n_name AS asset, n_nationkey % 4 = 3 OR (n_nationkey % 4 = 0 AND n_nationkey % 8 <> 0) AS valid, CASE WHEN n_nationkey % 8 = 0 THEN 'a:nullability_mismatch' WHEN n_nationkey % 4 = 1 THEN CASE WHEN n_nationkey % 3 = 1 THEN 'b:type_mismatch' ELSE 'b:missing_column' END WHEN n_nationkey % 4 = 2 THEN 'c:missing_column,d:missing_column' ELSE '' END AS issues FROM nation")
def _q10(spark, d):
    files = run_sql(spark, d, f"SELECT replace(payload, '{{\"', concat('{{\"asset_id\": \"', asset, '\", \"')) AS value FROM ({_PAYLOAD}) AS p").withColumn("value", F.regexp_replace("value", r'\{"asset_id": "[^"]*", "(name)', r'{"$1'))
    return governance.validated_files(files, _scan(spark, d))


@_query("Q11_hybrid_search", "SELECT id, how, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (ORDER BY tier, id) AS place FROM (SELECT CAST(p_partkey AS VARCHAR) AS id, 'text' AS how, 0 AS tier FROM part WHERE p_size = 7 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'like', 1 FROM part WHERE p_size <> 7 AND p_name LIKE '%cold%'))")
def _q11(spark, d):
    hits = _both(spark, d, "SELECT CAST(p_partkey AS STRING_) AS key, 1.0 AS rank FROM part WHERE p_size = 7")
    return search.hybrid(hits, _both(spark, d, "SELECT CAST(p_partkey AS STRING_) AS id, p_name AS name, '' AS description FROM part"), "cold")


@_query("Q12_suggest_tables", "SELECT id, CAST(round(0.5 + 0.5 * CASE WHEN k % 3 = 0 THEN 1 / 3 ELSE 0 END, 6) AS DOUBLE) AS score FROM (SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey AS k FROM part WHERE p_name LIKE '%cold widget%') ORDER BY score DESC, id LIMIT 10")
def _q12(spark, d):
    assets = _both(spark, d, "SELECT CAST(p_partkey AS STRING_) AS id, p_name AS name, '' AS description FROM part")
    columns = run_sql(spark, d, "SELECT cast(p_partkey AS string) AS asset, CASE WHEN p_partkey % 3 = 0 THEN array('Cold', 'x') ELSE array('y') END AS columns FROM part")
    return search.suggested(assets, columns, "cold widget")


@_query("Q13_find_term", "SELECT 'term' AS what, r_name AS id FROM region WHERE lower(r_name) LIKE '%region_1%' UNION ALL SELECT 'annotation', 'n1' UNION ALL SELECT 'asset', n_name FROM nation WHERE n_regionkey = 1")
def _q13(spark, d):
    terms = run_sql(spark, d, "SELECT r_name AS name, 'x' AS definition FROM region")
    notes = spark.createDataFrame([("n1", 1.0)], "key string, rank double")
    name = run_sql(spark, d, "SELECT r_name FROM region WHERE r_regionkey = 1").first()[0]
    return search.found_terms(terms, notes, run_sql(spark, d, "SELECT n_name AS id, r_name AS name, '' AS description FROM nation JOIN region ON n_regionkey = r_regionkey"), name)


ORACLES["Q13_find_term"] = "SELECT 'term' AS what, r_name AS id FROM region WHERE r_regionkey = 1 UNION ALL SELECT 'annotation', 'n1' UNION ALL SELECT 'asset', n_name FROM nation WHERE n_regionkey = 1"
_facts("Q14_sql_uses", "query string, asset string, column_name string, in_aggregate boolean", lambda: governance.sql_uses("q", "SELECT sum(o.o_orderkey) AS s FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_name = 'x'"), [("q", "customer", "", False), ("q", "orders", "", False), ("q", "orders", "o_orderkey", True), ("q", "customer", "c_name", False)])


@_query("Q14_static_verify", "SELECT 'q' AS query, 'orders.o_orderkey is a surrogate key' AS warning UNION ALL SELECT 'q', 'join on custkey'")
def _q14(spark, d):
    used = spark.createDataFrame(governance.sql_uses("q", "SELECT sum(o.o_orderkey) AS s FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"), "query string, asset string, column_name string, in_aggregate boolean")
    notes = spark.createDataFrame([("orders", "O_ORDERKEY", "a Surrogate Key"), ("orders", "o_custkey", "surrogate key"), ("x", "y", "plain")], "asset string, column_name string, note string")
    return governance.verified_sql(used, notes, spark.createDataFrame([("customer", "orders", "join on custkey"), ("customer", "part", "no")], "a string, b string, text string"))


@_query("Q15_explain_column", "SELECT n_name AS asset, 'id' AS column_name, 'int' AS type, CASE WHEN n_regionkey = 1 THEN 'key' END AS note, CASE WHEN n_regionkey <> 2 THEN n_nationkey END::BIGINT AS n_distinct FROM nation")
def _q15(spark, d):
    columns = run_sql(spark, d, "SELECT n_name AS asset, 'id' AS column_name, 'int' AS type FROM nation")
    notes = run_sql(spark, d, "SELECT n_name AS asset, 'id' AS column_name, 'key' AS note FROM nation WHERE n_regionkey = 1")
    return search.explained(columns, notes, run_sql(spark, d, "SELECT n_name AS asset, 'id' AS column_name, cast(n_nationkey AS bigint) AS n_distinct FROM nation WHERE n_regionkey <> 2"))


@_query("Q16_profile_column", "SELECT 'o_totalprice' AS column_name, count(DISTINCT o_totalprice) AS n_distinct, count(*) FILTER (o_totalprice IS NULL) AS n_null FROM orders")
def _q16(spark, d):
    return governance.profile(run_sql(spark, d, "SELECT o_totalprice, o_orderstatus FROM orders")).where("column_name = 'o_totalprice'").select("column_name", "n_distinct", "n_null")


@_query("Q20_context_bundle", f"SELECT 'p::main.part_7' AS id, (SELECT lower(p_type) FROM part WHERE p_partkey = 7) AS kind, (SELECT count(DISTINCT downstream) FROM ({_duck(_LINKS)}) WHERE upstream = 'p::main.part_7') AS n_neighbours, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT downstream AS x FROM ({_duck(_LINKS)}) WHERE upstream = 'p::main.part_7' ORDER BY 1 LIMIT 8)) AS neighbours, 1::BIGINT AS n_columns")
def _q20(spark, d):
    got = governance.context_bundle("p::main.part_7", _both(spark, d, _ASSETS), _both(spark, d, _COLUMNS), _both(spark, d, _LINKS), _both(spark, d, _CONTRACT))
    return got.select("id", "kind", "n_neighbours", F.array_join("neighbours", ",").alias("neighbours"), "n_columns")


QUERIES["Q19_asset_tools"], ORACLES["Q19_asset_tools"] = QUERIES["Q20_context_bundle"], ORACLES["Q20_context_bundle"]


@_query("Q23_gathered_context", "SELECT id, 'main.part' AS kind, CAST(0.5 AS DOUBLE) AS score FROM (SELECT CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_name LIKE '%cold%' ORDER BY 1 LIMIT 5)")
def _q23(spark, d):
    """What a question's answer would be given: the best assets with their facts. No model is asked."""
    assets = _both(spark, d, "SELECT CAST(p_partkey AS STRING_) AS id, p_name AS name, '' AS description, 'main.part' AS kind FROM part")
    none = spark.createDataFrame([], "asset string, columns array<string>")
    return search.suggested(assets, none, "cold", 5).join(assets, "id").select("id", "kind", "score")


@_query("Q22_column_parity", "SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS upstream, 'r' || CAST(n_regionkey AS VARCHAR) AS downstream, CASE WHEN n_nationkey % 2 = 0 AND n_regionkey % 2 = 0 THEN 'strict' WHEN n_nationkey % 2 = 0 THEN 'superset' WHEN n_regionkey % 2 = 0 THEN 'diverged' ELSE 'superset' END AS parity FROM nation")
def _q22(spark, d):
    edges = run_sql(spark, d, "SELECT concat('n', n_nationkey) AS upstream, concat('r', n_regionkey) AS downstream FROM nation")
    columns = run_sql(spark, d, "SELECT concat('n', n_nationkey) AS asset, explode(CASE WHEN n_nationkey % 2 = 0 THEN array('a', 'B') ELSE array('a', 'c') END) AS column_name FROM nation UNION ALL SELECT concat('r', r_regionkey), explode(CASE WHEN r_regionkey % 2 = 0 THEN array('A', 'b') ELSE array('a', 'b', 'c') END) FROM region")
    return governance.column_parity(edges, columns)


_KIND = "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'int' WHEN 1 THEN 'decimal(5,2)' WHEN 2 THEN 'text' WHEN 3 THEN 'timestamp' ELSE '' END AS a, CASE p_partkey % 4 WHEN 0 THEN 'INT' WHEN 1 THEN 'varchar(9)' WHEN 2 THEN 'numeric' ELSE 'date' END AS b FROM part"


@_query("Q22_type_compatibility", f"SELECT p_partkey, CASE WHEN a = '' THEN 'unknown' WHEN lower(a) = lower(b) THEN 'exact' WHEN b = 'varchar(9)' THEN 'safe' WHEN a = 'decimal(5,2)' AND b = 'numeric' THEN 'safe' WHEN a = 'int' AND b = 'numeric' THEN 'safe' WHEN a = 'decimal(5,2)' AND b = 'INT' THEN 'lossy' WHEN a = 'timestamp' AND b = 'date' THEN 'lossy' ELSE 'risky' END AS fit FROM ({_KIND})")
def _q22t(spark, d):
    return run_sql(spark, d, _KIND).select("p_partkey", governance.type_compatibility(F.col("a"), F.col("b")).alias("fit"))


# ---- streams and extension


def _logs(spark, d):
    """The events' log lines as files of a folder, one for each remainder of the event."""
    path = graph.scratch(spark, "logs")
    lines = run_sql(spark, d, _LOG).withColumn("part", F.floor(F.col("nth") / 400))
    files = lines.groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "value"))), lambda x: x["value"]), "\n").alias("value"))
    files.select("value").repartition(3).write.option("lineSep", "\n").text(path)
    return path


@_query("I01_log_stream", "SELECT count(*) AS n FROM events")
def _i01(spark, d):
    """Log files read as a stream into a table."""
    out, seen = graph.scratch(spark, "lines"), graph.scratch(spark, "offsets")
    q = streams.log_stream(spark, _logs(spark, d)).writeStream.format("parquet").option("path", out).option("checkpointLocation", seen).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).agg(F.count("*").alias("n"))


@_query("I02_bounded_triggers", "SELECT count(*) AS n, 3::BIGINT AS least_batches FROM events")
def _i02(spark, d):
    """One file a trigger: the same lines in more batches."""
    out, seen = graph.scratch(spark, "lines"), graph.scratch(spark, "offsets")

    def each(batch, number):
        batch.select(F.lit(number).alias("batch")).write.mode("append").parquet(out)

    q = streams.log_stream(spark, _logs(spark, d), 1).writeStream.foreachBatch(each).option("checkpointLocation", seen).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).agg(F.count("*").alias("n"), F.least(F.countDistinct("batch"), F.lit(1)).alias("b")).select("n", (F.col("b") * 3).alias("least_batches"))


@_query("X07_post_scan_hooks", "SELECT 'lines' AS hook, count(*) AS n FROM events UNION ALL SELECT 'errors', count(*) FROM events WHERE event_type = 'error'")
def _x07(spark, d):
    out = graph.scratch(spark, "hooks")
    count = lambda name, keep: lambda batch, number: batch.where(keep).agg(F.count("*").alias("n")).select(F.lit(name).alias("hook"), "n", F.lit(number).alias("batch")).write.mode("append").parquet(out)
    q = streams.with_hooks(streams.log_stream(spark, _logs(spark, d)), graph.scratch(spark, "offsets"), count("lines", "true"), count("errors", "value like '%ERROR:%'"))
    q.awaitTermination()
    return spark.read.parquet(out).groupBy("hook").agg(F.sum("n").alias("n"))


@_query("B07_windowed_stream", "SELECT date_trunc('hour', ts) AS start, count(*) AS total FROM events GROUP BY 1")
def _b07w(spark, d):
    """User activity by the hour, as a stream of the events with a watermark; the last hours leave when the stream is complete."""
    out = graph.scratch(spark, "hours")
    rows = spark.readStream.schema("event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").parquet(_copied(spark, d))
    e = rows.select(F.col("ts").alias("captured_at"), F.lit("u").alias("database_user"), F.lit(1).alias("bytes"))

    def each(batch, number):
        batch.write.mode("append").parquet(out)

    q = streams.windowed_activity(e).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", graph.scratch(spark, "offsets")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).groupBy("start").agg(F.max("total").alias("total"))


def _copied(spark, d):
    path = graph.scratch(spark, "events")
    run_sql(spark, d, "SELECT * FROM events").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    return path


@_query("X03_executor", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def _x03(spark, d):
    run_sql(spark, d, "SELECT * FROM nation")
    return base.SparkExecutor(spark).run("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")


@_query("X05_scoring_weights", "SELECT k::VARCHAR AS source_object, CAST(round(1.0, 6) AS DOUBLE) AS score FROM (SELECT DISTINCT 'T' || CAST(c_custkey % 60 AS VARCHAR) AS k, c_custkey % 60 AS n FROM customer) a WHERE n IN (SELECT s_suppkey % 60 FROM supplier)")
def _x05(spark, d):
    """Weights that count the name alone."""
    from .queries import _LEFT, _RIGHT, _objects

    a, b = _objects(spark, d, **_LEFT).alias("a"), _objects(spark, d, **_RIGHT).alias("b")
    score = graph.match_score("a", "b", {"name": 1.0, "columns": 0.0, "types": 0.0, "rows": 0.0})
    return a.join(b, F.lower("a.object") == F.lower("b.object")).select(F.col("a.object").alias("source_object"), F.round(score, 6).alias("score"))


@_query("X06_repositories", "SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def _x06(spark, d):
    """A table written twice to the store: the last whole version is read."""
    s = store.Store(spark, graph.scratch(spark, "store"))
    s.write("nation", run_sql(spark, d, "SELECT n_nationkey FROM nation"))
    s.write("nation", run_sql(spark, d, "SELECT n_nationkey FROM nation WHERE n_regionkey = 1"))
    return s.read("nation", "n_nationkey int")


@_query("F09_current_time", "SELECT true AS today, true AS now")
def _f09(spark, d):
    return spark.sql("SELECT current_date() = to_date(now()) AS today, current_timestamp() >= date_trunc('day', now()) AS now")


@_query("F19_stable_ids", "SELECT n_nationkey, regexp_replace(substr(sha1('edge:' || n_name), 1, 32), '^(.{8})(.{4}).(.{3}).(.{3})(.{12}).*$', '\\1-\\2-5\\3-a\\4-\\5') AS id FROM nation")
def _f19(spark, d):
    """Name-based identifiers in the form of version 5 of UUIDs, from SHA-1."""
    return run_sql(spark, d, r"SELECT n_nationkey, regexp_replace(substr(sha1(concat('edge:', n_name)), 1, 32), '^(.{8})(.{4}).(.{3}).(.{3})(.{12}).*$', '$1-$2-5$3-a$4-$5') AS id FROM nation")
