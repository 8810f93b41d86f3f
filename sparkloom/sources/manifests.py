"""JSON that tools write about themselves: transformation projects, pipelines, dashboards and schedulers. Input is always a DataFrame with a text column `value`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of project nodes that stand for tables.
MODEL_KINDS = ("model", "snapshot", "seed")
_NODE = "struct<resource_type:string,schema:string,alias:string,name:string,raw_code:string,compiled_code:string,description:string,columns:map<string,struct<name:string,data_type:string,description:string>>,depends_on:struct<nodes:array<string>>>"


def _nodes(manifest: DataFrame, key: str) -> DataFrame:
    part = F.from_json(F.get_json_object("value", f"$.{key}"), f"map<string,{_NODE}>")
    rows = manifest.select(F.explode(part).alias("uid", "n")).select("uid", "n.*")
    return rows.withColumn("table", F.coalesce(F.when(F.col("alias") != "", F.col("alias")), F.col("name"))).where((F.coalesce("schema", F.lit("")) != "") & (F.coalesce("table", F.lit("")) != ""))


def project_objects(manifest: DataFrame) -> DataFrame:
    """uid, schema, object, kind, columns and source text of a project's models and declared sources."""
    models = _nodes(manifest, "nodes").where(F.col("resource_type").isin(*MODEL_KINDS))
    both = models.unionByName(_nodes(manifest, "sources").withColumn("resource_type", F.lit("source")))
    columns = F.transform(F.map_values(F.coalesce("columns", F.expr("cast(map() as map<string,struct<name:string,data_type:string,description:string>>)"))), lambda c: F.struct(c["name"].alias("name"), c["data_type"].alias("type")))
    return both.select("uid", "schema", F.col("table").alias("object"), F.col("resource_type").alias("kind"), F.array_sort(columns).alias("columns"), F.coalesce("raw_code", "compiled_code").alias("definition"))


def project_lineage(manifest: DataFrame) -> DataFrame:
    """Declared edges from what a model depends on; unknown dependencies give none."""
    known = project_objects(manifest).select(F.col("uid").alias("dep"), F.concat_ws(".", "schema", "object").alias("source_object"))
    models = _nodes(manifest, "nodes").where(F.col("resource_type").isin(*MODEL_KINDS))
    needs = models.select(F.concat_ws(".", "schema", "table").alias("target_object"), F.explode("depends_on.nodes").alias("dep"))
    return needs.join(known, "dep").select("source_object", "target_object", F.lit("declared").alias("edge_kind"), F.lit(1.0).alias("confidence"))


def project_runs(results: DataFrame) -> DataFrame:
    """node, status, seconds of a run's results."""
    rows = F.from_json(F.get_json_object("value", "$.results"), "array<struct<unique_id:string,status:string,execution_time:double>>")
    return results.select(F.explode(rows).alias("r")).select(F.col("r.unique_id").alias("node"), F.col("r.status").alias("status"), F.col("r.execution_time").alias("seconds"))


_ENABLED = "struct<name_in_destination:string,enabled:boolean,tables:map<string,struct<name_in_destination:string,enabled:boolean>>>"


def pipeline_lineage(connectors: DataFrame) -> DataFrame:
    """Edges of replication connectors (id, schema: prefix or null, value: their schemas' JSON): each enabled table of an enabled schema to `prefix__schema.table`."""
    schemas = F.from_json(F.get_json_object("value", "$.data.schemas"), f"map<string,{_ENABLED}>")
    s = connectors.select(F.coalesce(F.when(F.col("schema") != "", F.col("schema")), F.col("id")).alias("prefix"), F.explode(schemas).alias("from_schema", "s")).where(F.coalesce("s.enabled", F.lit(True)))
    t = s.select("prefix", "from_schema", F.coalesce("s.name_in_destination", "from_schema").alias("to_schema"), F.explode("s.tables").alias("from_table", "t")).where(F.coalesce("t.enabled", F.lit(True)))
    return t.select(F.concat_ws(".", "from_schema", "from_table").alias("source_object"), F.concat("prefix", F.lit("__"), "to_schema", F.lit("."), F.coalesce("t.name_in_destination", "from_table")).alias("target_object"), F.lit("connector").alias("edge_kind"), F.lit(1.0).alias("confidence"))


def explore_lineage(explores: DataFrame) -> DataFrame:
    """Edges of a BI model's explores (value: model, name, sql_table_name, joins[].sql_table_name) from their tables, 0.95."""
    kind = "struct<model:string,name:string,sql_table_name:string,joins:array<struct<name:string,sql_table_name:string>>>"
    e = explores.select(F.from_json("value", kind).alias("e")).select("e.*")
    tables = F.array_distinct(F.array_compact(F.concat(F.array("sql_table_name"), F.transform(F.coalesce("joins", F.expr("cast(array() as array<struct<name:string,sql_table_name:string>>)")), lambda j: j["sql_table_name"]))))
    return e.select(F.explode(tables).alias("source_object"), F.concat_ws(".", "model", "name").alias("target_object"), F.lit("declared").alias("edge_kind"), F.lit(0.95).alias("confidence"))


_DAG = "struct<dag_id:string,schedule:string,tasks:array<struct<task_id:string,operator:string,upstream:array<string>,external_dag_id:string>>>"


def dags(files: DataFrame) -> DataFrame:
    """dag, task, operator, upstream of schedulers' DAGs (value: JSON with dag_id and tasks)."""
    return files.select(F.from_json("value", _DAG).alias("d")).select(F.col("d.dag_id").alias("dag"), F.explode("d.tasks").alias("t")).select("dag", F.col("t.task_id").alias("task"), F.col("t.operator").alias("operator"), F.coalesce("t.upstream", F.array().cast("array<string>")).alias("upstream"), F.col("t.external_dag_id").alias("external_dag"))


def dag_lineage(files: DataFrame) -> DataFrame:
    """Edges between DAGs from tasks that wait for another DAG, 0.9."""
    return dags(files).where(F.col("external_dag").isNotNull()).select(F.col("external_dag").alias("source_object"), F.col("dag").alias("target_object"), F.lit("declared").alias("edge_kind"), F.lit(0.9).alias("confidence")).distinct()


def dag_events(runs: DataFrame) -> DataFrame:
    """Task instances (value: dag_id, task_id, start_date, duration, sql) as query events."""
    kind = "struct<dag_id:string,task_id:string,start_date:string,duration:double,sql:string>"
    r = runs.select(F.from_json("value", kind).alias("r")).select("r.*")
    return r.select(F.col("start_date").cast("timestamp").alias("captured_at"), "sql", F.concat(F.lit("airflow:"), "dag_id", F.lit(":"), "task_id").alias("source_name"), F.lit("task").alias("query_type"), (F.col("duration") * 1000).alias("duration_ms"), "dag_id")


def bi_objects(tables: DataFrame) -> DataFrame:
    """Objects of a BI tool's table metadata (value: schema, name, entity_type, fields[])."""
    kind = "struct<schema:string,name:string,entity_type:string,fields:array<struct<name:string,base_type:string>>>"
    t = tables.select(F.from_json("value", kind).alias("t")).select("t.*")
    return t.select("schema", F.col("name").alias("object"), F.coalesce("entity_type", F.lit("table")).alias("kind"), F.transform("fields", lambda f: F.struct(f["name"].alias("name"), f["base_type"].alias("type"))).alias("columns"))


def bi_events(audit: DataFrame) -> DataFrame:
    """A BI tool's audit rows (value: started_at, user, running_time, native.query) as query events; rows without a text are none."""
    kind = "struct<started_at:string,user:string,running_time:double,native:struct<query:string>>"
    a = audit.select(F.from_json("value", kind).alias("a")).select("a.*")
    return a.where(F.coalesce("native.query", F.lit("")) != "").select(F.col("started_at").cast("timestamp").alias("captured_at"), F.col("native.query").alias("sql"), F.lit("metabase").alias("source_name"), F.col("user").alias("database_user"), F.col("running_time").alias("duration_ms"))


def column_lineage(history: DataFrame) -> DataFrame:
    """Edges with column pairs of a warehouse's access history (base, modified: arrays of objectName and columns[]).

    Each modified object is paired with each base object of its statement, columns in order of place; of a pair of objects the first statement's columns count.
    """
    kind = "array<struct<objectName:string,columns:array<struct<columnName:string>>>>"
    as_json = lambda c: F.from_json(c, kind) if history.schema[c].dataType.typeName() == "string" else F.col(c)
    both = history.select("query_start", F.explode(as_json("modified")).alias("m"), as_json("base").alias("base")).select("query_start", "m", F.explode("base").alias("b"))
    names = lambda x: F.transform(F.coalesce(F.col(f"{x}.columns"), F.expr("cast(array() as array<struct<columnName:string>>)")), lambda c: c["columnName"])
    pairs = F.filter(F.zip_with(names("b"), names("m"), lambda s, d: F.struct(s.alias("src"), d.alias("dst"))), lambda p: p["src"].isNotNull() & p["dst"].isNotNull())
    rows = both.where("b.objectName != m.objectName").select(F.col("b.objectName").alias("source_object"), F.col("m.objectName").alias("target_object"), pairs.alias("column_mappings"), "query_start")
    return rows.groupBy("source_object", "target_object").agg(F.min_by("column_mappings", F.struct("query_start", F.to_json("column_mappings"))).alias("column_mappings"))


def value_lines(df: DataFrame, column: Column) -> DataFrame:
    """A DataFrame of texts in the form these functions read."""
    return df.select(column.alias("value"))
