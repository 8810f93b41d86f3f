"""The store: assets, edges, queries, snapshots, contracts, violations, annotations, terms and profiles as DataFrames with merge semantics.

A write is old rows and new rows in, merged rows out; `Store` keeps each table as Parquet versions under one folder, and points to the last whole one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def contains(text: str, *columns: str) -> Column:
    """Whether a column holds the text, without regard to ASCII case; % and _ are plain characters."""
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text.lower()))
    return out


# ---- assets


def merged_assets(old: DataFrame, new: DataFrame) -> DataFrame:
    """Assets (id, source, kind, name, description, tags, metadata map, seen, placeholder) by id, later writes over earlier ones.

    Tags are joined in order of first mention, metadata overlaid key by key, empty fields keep the old value, a placeholder keeps the kind; first_seen and last_seen
    span all writes. Equal times of writing are ordered by old before new, then by the rows' content.
    """
    order = F.struct("seen", "__new", F.xxhash64("source", "kind", "name", "description"))
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    all_ = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(order.alias("at"), "source", "kind", "name", "description", "tags", "metadata", F.coalesce("placeholder", F.lit(False)).alias("placeholder"))), lambda x, y: F.when(x["at"] < y["at"], -1).when(x["at"] > y["at"], 1).otherwise(0)).alias("w"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))
    last = lambda keep, field: F.try_element_at(F.filter("w", keep), F.lit(-1))[field]
    filled = lambda c: F.coalesce(last(lambda x: F.coalesce(x[c], F.lit("")) != "", c), F.lit(None).cast("string"))
    firm = last(lambda x: ~x["placeholder"] & (F.coalesce(x["kind"], F.lit("")) != ""), "kind")
    return all_.select(
        "id", filled("source").alias("source"), F.coalesce(firm, filled("kind"), F.lit("external")).alias("kind"), F.coalesce(filled("name"), F.col("id")).alias("name"), filled("description").alias("description"),
        F.array_distinct(F.flatten(F.transform("w", lambda x: F.coalesce(x["tags"], F.array().cast("array<string>"))))).alias("tags"),
        F.aggregate("w", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: ~F.map_contains_key(F.coalesce(x["metadata"], F.create_map().cast("map<string,string>")), k)), F.coalesce(x["metadata"], F.create_map().cast("map<string,string>")))).alias("metadata"),
        "first_seen", "last_seen",
    )


def written(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys that a write inserts and keys that it updates."""
    both = new.select(*keys).distinct().join(old.select(*keys).distinct().withColumn("__old", F.lit(True)), keys, "left")
    return both.agg(F.count_if(F.col("__old").isNull()).alias("inserted"), F.count_if(F.col("__old").isNotNull()).alias("updated"))


def search_assets(assets: DataFrame, text: str) -> DataFrame:
    return assets.where(contains(text, "id", "name", "description"))


def deleted(assets: DataFrame, ids: DataFrame, children: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, DataFrame]:
    """Assets less those of ids (id), and each child table less the rows that refer to them by any of its columns."""
    out = {"assets": assets.join(ids, "id", "left_anti")}
    for name, (rows, columns) in children.items():
        for c in columns:
            rows = rows.join(ids.withColumnRenamed("id", c), c, "left_anti")
        out[name] = rows
    return out


# ---- edges, queries


def merged_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges (upstream, downstream, kind, metadata, seen): the last metadata of each triple, its first and last time."""
    both = old.unionByName(new)
    return both.groupBy("upstream", "downstream", "kind").agg(F.max_by("metadata", F.struct("seen", "metadata")).alias("metadata"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))


def neighbours(edges: DataFrame, asset: str, side: str = "both") -> DataFrame:
    up, down = F.col("downstream") == asset, F.col("upstream") == asset
    return edges.where({"upstream": up, "downstream": down, "both": up | down}[side])


def merged_queries(old: DataFrame, new: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries (fingerprint, sql_text, tables, n, last_seen) with their counts added up, and the bridge (fingerprint, asset) to assets (id) that exist.

    Text and tables are those of the last observation.
    """
    last = F.struct("last_seen", "sql_text")
    q = old.unionByName(new).groupBy("fingerprint").agg(F.max_by("sql_text", last).alias("sql_text"), F.max_by("tables", last).alias("tables"), F.sum("n").alias("n"), F.max("last_seen").alias("last_seen"))
    bridge = q.select("fingerprint", F.explode("tables").alias("asset")).distinct()
    return q, bridge.join(assets.select(F.col("id").alias("asset")), "asset", "left_semi")


def queries_of(queries: DataFrame, bridge: DataFrame, asset: str) -> DataFrame:
    """An asset's queries, the most executed first."""
    return queries.join(bridge.where(F.col("asset") == asset), "fingerprint", "left_semi").orderBy(F.desc("n"), "fingerprint")


def top_queries(queries: DataFrame, most: int) -> DataFrame:
    """The `most` most executed queries (a report)."""
    return queries.orderBy(F.desc("n"), "fingerprint").limit(most)


def pruned(queries: DataFrame, cutoff: Column) -> DataFrame:
    return queries.where(F.col("last_seen") >= cutoff)


# ---- snapshots


def latest(snapshots: DataFrame, key: str = "asset", time: str = "captured_at", tie: str = "id") -> DataFrame:
    """The last snapshot of each key, for all keys at once."""
    w = Window.partitionBy(key).orderBy(F.desc(time), F.desc(tie))
    return snapshots.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")


def history(snapshots: DataFrame, asset: str) -> DataFrame:
    return snapshots.where(F.col("asset") == asset).orderBy(F.desc("captured_at"), F.desc("id"))


def changed(snapshots: DataFrame) -> DataFrame:
    """Snapshots (asset, captured_at, id, fingerprint) that differ from the one before: what an append-if-new keeps, A, B, A included."""
    w = Window.partitionBy("asset").orderBy("captured_at", "id")
    return snapshots.withColumn("__last", F.lag("fingerprint").over(w)).where(F.col("__last").isNull() | (F.col("__last") != F.col("fingerprint"))).drop("__last")


# ---- consumers, contracts, violations


def consumers(rows: DataFrame, bridge: DataFrame) -> DataFrame:
    """Consumers (id, ...) with the sorted list of their assets, empty where they have none."""
    lists = bridge.groupBy("consumer").agg(F.array_sort(F.collect_set("asset")).alias("assets"))
    return rows.join(lists, rows["id"] == lists["consumer"], "left").drop("consumer").withColumn("assets", F.coalesce("assets", F.array().cast("array<string>")))


def merged_latest(old: DataFrame, new: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Old and new rows by key, the later wins; at equal times the new one does."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in old.columns if c not in (*keys, time)]
    return both.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(time), F.desc("__new"), *(F.desc(c) for c in rest if old.schema[c].dataType.typeName() not in ("map", "variant"))))).where("__nth = 1").drop("__nth", "__new")


def violations_after(old: DataFrame, found: DataFrame) -> DataFrame:
    """Violations (id, asset, kind, severity, detected_at, resolved_at): one found again is open again, its first detection stays; others stay as they are."""
    new = found.select("id", "asset", "kind", "severity", "detected_at", F.lit(None).cast("timestamp").alias("resolved_at"), F.lit(True).alias("again"))
    both = old.withColumn("again", F.lit(False)).unionByName(new)
    order = F.struct("again", "detected_at", "severity")
    return both.groupBy("id").agg(F.max_by("asset", order).alias("asset"), F.max_by("kind", order).alias("kind"), F.max_by("severity", order).alias("severity"), F.min("detected_at").alias("detected_at"), F.when(F.bool_or("again"), F.lit(None)).otherwise(F.max("resolved_at")).alias("resolved_at"))


def open_violations(violations: DataFrame) -> DataFrame:
    return violations.where(F.col("resolved_at").isNull())


def recent_violations(violations: DataFrame, most: int = 50) -> DataFrame:
    """The last `most` detected (a report)."""
    return violations.orderBy(F.desc("detected_at"), "id").limit(most)


def resolved(violations: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    hit = ids.select("id", F.lit(True).alias("__hit"))
    return violations.join(hit, "id", "left").withColumn("resolved_at", F.when(F.col("__hit") & F.col("resolved_at").isNull(), at).otherwise(F.col("resolved_at"))).drop("__hit")


# ---- annotations


def unannotated(assets: DataFrame, annotations: DataFrame) -> DataFrame:
    return assets.join(annotations.select(F.col("asset").alias("id")), "id", "left_anti")


def stale(annotations: DataFrame, days: int, now: Column) -> DataFrame:
    """Annotations older than `days`, the oldest first."""
    return annotations.where(F.col("annotated_at") < now - F.make_interval(days=F.lit(days))).orderBy("annotated_at", "asset")


# ---- sync


def synced(local: DataFrame, remote: DataFrame, keys: list[str], server_wins: bool = False) -> DataFrame:
    """Both sides' rows by key: the later last_seen wins, the remote at equal times; with `server_wins` the remote always does."""
    both = local.withColumn("__side", F.lit(0)).unionByName(remote.withColumn("__side", F.lit(1)))
    order = [F.desc("__side")] if server_wins else [F.desc_nulls_last("last_seen"), F.desc("__side")]
    return both.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__nth = 1").drop("__nth", "__side")


def sync_cursor(*tables: DataFrame) -> DataFrame:
    """One row: the latest time of all tables' last_seen texts that can be read as one."""
    times = [t.select(F.try_to_timestamp(F.col("last_seen").cast("string")).alias("t")) for t in tables]
    out = times[0]
    for t in times[1:]:
        out = out.unionByName(t)
    return out.agg(F.max("t").alias("cursor"))


# ---- files


class Store:
    """Tables as versions of Parquet under a folder; a version counts once its writer has finished, so a failed write leaves the last one in force."""

    def __init__(self, spark: SparkSession, path: str, migrations: list[dict[str, str]] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.migrations = migrations or []

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self, table: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{table}")
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if self._whole(f"{self.path}/{table}/{s.getPath().getName()}"))

    def _whole(self, path: str) -> bool:
        fs, p = self._fs(f"{path}/_SUCCESS")
        return fs.exists(p)

    def read(self, table: str, schema: StructType | str) -> DataFrame:
        """The last version in this schema, columns that it lacks as NULL; empty where nothing was written."""
        empty = self.spark.createDataFrame([], schema)
        found = self.versions(table)
        if not found:
            return empty
        rows = self.spark.read.parquet(f"{self.path}/{table}/{found[-1]}")
        return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema))

    def write(self, table: str, rows: DataFrame, keep: int = 3) -> None:
        """A new version; older ones beyond `keep` go."""
        found = self.versions(table)
        nth = int(found[-1].split("-")[0]) + 1 if found else 0
        rows.write.parquet(f"{self.path}/{table}/{nth:09d}-{uuid.uuid4().hex[:8]}")
        for old in found[: max(0, len(found) + 1 - keep)]:
            fs, p = self._fs(f"{self.path}/{table}/{old}")
            fs.delete(p, True)

    def migrate(self, table: str, columns: dict[str, str]) -> bool:
        """Adds columns that the last version lacks; those it has are left alone. Whether anything was added."""
        found = self.versions(table)
        if not found:
            return False
        rows = self.spark.read.parquet(f"{self.path}/{table}/{found[-1]}")
        new = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in rows.columns}
        if new:
            self.write(table, rows.withColumns(new))
        return bool(new)


def export_graph(assets: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as JSON lines: assets and edges in two folders."""
    assets.write.mode("overwrite").json(f"{path}/assets")
    edges.write.mode("overwrite").json(f"{path}/edges")


def exported(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (part, json) of the graph."""
    line = lambda df, part: df.select(F.lit(part).alias("part"), F.to_json(F.struct(*df.columns)).alias("json"))
    return line(assets, "assets").unionByName(line(edges, "edges"))


def archive(payload: DataFrame, path: str, source: str, capability: str, run: str) -> None:
    """Appends what a capability extracted, by source, capability and run."""
    payload.select(F.to_json(F.struct(*payload.columns)).alias("payload"), F.lit(source).alias("source"), F.lit(capability).alias("capability"), F.lit(run).alias("run")).write.mode("append").partitionBy("source", "capability", "run").parquet(path)
