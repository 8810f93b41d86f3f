"""The session's own catalog as a source, and tables given as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import OBJECTS


def objects(tables: Mapping[str, DataFrame], schema: str = "main", count: bool = True) -> DataFrame:
    """Objects of tables by name: their columns from the schema, their rows counted if asked for, all in one job."""
    spark = next(iter(tables.values())).sparkSession
    parts = []
    for name, df in sorted(tables.items()):
        columns = F.array(*(F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(f.nullable).alias("nullable")) for f in df.schema))
        rows = df.agg(F.count("*").alias("n")) if count else spark.range(1).select(F.lit(None).cast("bigint").alias("n"))
        parts.append(rows.select(F.lit(schema).alias("schema"), F.lit(name).alias("object"), F.lit("table").alias("kind"), F.col("n").alias("row_count"), columns.alias("columns")))
    return reduce(DataFrame.unionByName, parts)


class CatalogAdapter:
    """Databases, tables, views and their DDL text as the session knows them."""

    kind = "spark"

    def __init__(self, spark: SparkSession, database: str | None = None):
        self.spark, self.database = spark, database

    def discover(self) -> DataFrame:
        return self.spark.createDataFrame([(d.name, d.locationUri or "") for d in self.spark.catalog.listDatabases()], "container string, location string")

    def _tables(self):
        return [t for t in self.spark.catalog.listTables(self.database) if t.name]

    def schema(self) -> DataFrame:
        found = self._tables()
        if not found:
            return self.spark.createDataFrame([], OBJECTS)
        name = lambda t: t.name if t.isTemporary or not t.namespace else f"{'.'.join(t.namespace)}.{t.name}"
        return objects({t.name: self.spark.table(name(t)) for t in found}, self.database or "default")

    def definitions(self) -> DataFrame:
        """Text of views; temporary ones have none that the catalog shows."""
        rows = [(t.name, self.spark.sql(f"SHOW CREATE TABLE {'.'.join([*t.namespace, t.name])}").first()[0]) for t in self._tables() if not t.isTemporary]
        return self.spark.createDataFrame(rows, "object string, definition string")
