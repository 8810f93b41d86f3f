"""Cloud warehouses: their job and query histories as query events, their information schema as objects. Rows come from Spark's connectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import OBJECTS
from .manifests import column_lineage


def job_events(jobs: DataFrame) -> DataFrame:
    """Rows of JOBS (creation_time, query, user_email, job_id, statement_type, total_bytes_processed, start_time, end_time, labels array<struct<key,value>>) as query events; jobs without text are none."""
    ms = (F.unix_millis("end_time") - F.unix_millis("start_time")).cast("double")
    return jobs.where(F.coalesce("query", F.lit("")) != "").select(F.col("creation_time").alias("captured_at"), F.col("query").alias("sql"), F.col("user_email").alias("database_user"), F.col("job_id").alias("event_id"), F.lower("statement_type").alias("query_type"), F.col("total_bytes_processed").alias("bytes"), ms.alias("duration_ms"), F.map_from_entries(F.coalesce("labels", F.expr("cast(array() as array<struct<key:string,value:string>>)"))).alias("labels"))


def history_events(history: DataFrame) -> DataFrame:
    """Rows of QUERY_HISTORY (start_time, query_text, user_name, query_id, query_type, bytes_scanned, total_elapsed_time, error_message) as query events."""
    return history.where(F.coalesce("query_text", F.lit("")) != "").select(F.col("start_time").alias("captured_at"), F.col("query_text").alias("sql"), F.col("user_name").alias("database_user"), F.col("query_id").alias("event_id"), F.lower("query_type").alias("query_type"), F.col("bytes_scanned").alias("bytes"), F.col("total_elapsed_time").cast("double").alias("duration_ms"), F.col("error_message").alias("error"))


def schema_of(columns: DataFrame, sizes: DataFrame) -> DataFrame:
    """Objects from INFORMATION_SCHEMA.COLUMNS (table_schema, table_name, column_name, ordinal_position, data_type, is_nullable) and tables' sizes (table_schema, table_name, row_count)."""
    c = F.struct("ordinal_position", F.col("column_name").alias("name"), F.col("data_type").alias("type"), (F.col("is_nullable") == "YES").alias("nullable"))
    lists = columns.groupBy("table_schema", "table_name").agg(F.array_sort(F.collect_list(c)).alias("c"))
    out = lists.join(sizes, ["table_schema", "table_name"], "left")
    return out.select(F.col("table_schema").alias("schema"), F.col("table_name").alias("object"), F.lit("table").alias("kind"), F.col("row_count").cast("bigint").alias("row_count"), F.transform("c", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["nullable"].alias("nullable"))).alias("columns"))


class WarehouseAdapter:
    """Reads through a connector whose `query` option takes SQL; the connector and its credentials are the session's."""

    def __init__(self, spark: SparkSession, kind: str, region: str = "region-us", **options: str):
        if kind not in ("bigquery", "snowflake"):
            raise ValueError(kind)
        self.spark, self.kind, self.region, self.options = spark, kind, region, options

    def _read(self, query: str) -> DataFrame:
        return self.spark.read.format(self.kind).options(**self.options).option("query", query).load()

    def schema(self) -> DataFrame:
        at = f"`{self.region}`." if self.kind == "bigquery" else ""
        sizes = f"SELECT table_schema, table_name, {'total_rows' if self.kind == 'bigquery' else 'row_count'} AS row_count FROM {at}INFORMATION_SCHEMA.{'TABLE_STORAGE' if self.kind == 'bigquery' else 'TABLES'}"
        return schema_of(self._read(f"SELECT * FROM {at}INFORMATION_SCHEMA.COLUMNS"), self._read(sizes)).to(self.spark.createDataFrame([], OBJECTS).schema)

    def traffic(self) -> DataFrame:
        if self.kind == "bigquery":
            return job_events(self._read(f"SELECT * FROM `{self.region}`.INFORMATION_SCHEMA.JOBS"))
        return history_events(self._read("SELECT * FROM SNOWFLAKE.ACCOUNT_USAGE.QUERY_HISTORY"))

    def lineage(self) -> DataFrame:
        if self.kind == "bigquery":
            raise NotImplementedError("jobs carry no column lineage")
        return column_lineage(self._read("SELECT query_start_time AS query_start, objects_modified AS modified, base_objects_accessed AS base FROM SNOWFLAKE.ACCOUNT_USAGE.ACCESS_HISTORY"))
