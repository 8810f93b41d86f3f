"""SQLite files as a data source of Spark, one task a table. The adapter sends executors on other machines a copy of the file; the bare source needs a file that they can open."""

from __future__ import annotations

import os
import sqlite3
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.governance import profile
from .base import OBJECTS


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


# Declared types by affinity, as the file's own rules have them; the first part that a type holds counts.
AFFINITIES = [("int", "bigint"), ("char", "string"), ("clob", "string"), ("text", "string"), ("blob", "binary"), ("real", "double"), ("floa", "double"), ("doub", "double")]


def spark_type(declared: str) -> str:
    return next((t for part, t in AFFINITIES if part in declared.lower()), "string")


class _Table(InputPartition):
    def __init__(self, table: str):
        self.table = table


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, shipped: str | None = None):
        self.path, self.table, self.schema, self.shipped = path, table, schema, shipped

    def partitions(self) -> list[InputPartition]:
        return [_Table(self.table)]

    def read(self, partition: _Table) -> Iterator[tuple]:
        cast = {"bigint": int, "double": float, "string": str, "binary": bytes}
        kinds = [cast[f.dataType.simpleString()] for f in self.schema]
        with _open(SparkFiles.get(self.shipped) if self.shipped else self.path) as con:
            for row in con.execute(f"SELECT {', '.join(_quoted(f.name) for f in self.schema)} FROM {_quoted(partition.table)}"):
                yield tuple(None if v is None else v if isinstance(v, k) else k(str(v).encode()) if k is bytes else k(v) for v, k in zip(row, kinds, strict=True))


class SqliteSource(DataSource):
    """spark.read.format("sqlite").option("path", file).option("table", name); option shipped: name under which executors were sent the file."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with _open(self.options["path"]) as con:
            return ", ".join(f"`{c[1]}` {spark_type(c[2])}" for c in con.execute(f"PRAGMA table_info({_quoted(self.options['table'])})"))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["table"], schema, self.options.get("shipped"))


class SqliteAdapter:
    kind = "sqlite"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._sent = spark, path, None
        spark.dataSource.register(SqliteSource)

    def _names(self) -> list[tuple[str, str]]:
        with _open(self.path) as con:
            return con.execute("SELECT name, type FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name").fetchall()

    def _shipped(self) -> tuple[str, str]:
        """Path and name of a copy that executors get, made anew after the file or its log has changed."""
        state = [(s.st_mtime_ns, s.st_size) if os.path.exists(f) and (s := os.stat(f)) else None for f in (self.path, f"{self.path}-wal")]
        if self._sent is None or self._sent[0] != state:
            name = f"loom-{uuid.uuid4().hex}.db"
            copy = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="loom-")), name)
            with _open(self.path) as con, sqlite3.connect(copy) as to:
                con.backup(to)
            self.spark.sparkContext.addFile(copy)
            self._sent = state, copy, name
        return self._sent[1:]

    def table(self, name: str) -> DataFrame:
        read = self.spark.read.format("sqlite").option("table", name)
        if self.spark.sparkContext.master.split("[")[0] == "local":
            return read.option("path", self.path).load()
        path, shipped = self._shipped()
        return read.option("path", path).option("shipped", shipped).load()

    def discover(self) -> DataFrame:
        return self.spark.createDataFrame([("main",)], "container string")

    def schema(self) -> DataFrame:
        rows = []
        with _open(self.path) as con:
            for name, kind in self._names():
                n = con.execute(f"SELECT count(*) FROM {_quoted(name)}").fetchone()[0]
                rows.append(("main", name, kind, n, [(c[1], c[2], not c[3] and not c[5]) for c in con.execute(f"PRAGMA table_info({_quoted(name)})")]))
        return self.spark.createDataFrame(rows, OBJECTS)

    def lineage(self) -> DataFrame:
        """Foreign keys: from_object to the table it refers to."""
        with _open(self.path) as con:
            rows = [(name, r[3], r[2], r[4]) for name, kind in self._names() if kind == "table" for r in con.execute(f"PRAGMA foreign_key_list({_quoted(name)})")]
        return self.spark.createDataFrame(rows, "from_object string, from_column string, to_object string, to_column string")

    def definitions(self) -> DataFrame:
        with _open(self.path) as con:
            return self.spark.createDataFrame(con.execute("SELECT name, sql FROM sqlite_master WHERE sql IS NOT NULL ORDER BY name").fetchall(), "object string, definition string")

    def profiles(self) -> DataFrame:
        """Profiles of every table's columns."""
        out = None
        for name, kind in self._names():
            if kind == "table":
                part = profile(self.table(name)).withColumn("object", F.lit(name))
                out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], "column_name string, n_distinct bigint, n_null bigint, null_fraction double, min_value string, max_value string, object string")
