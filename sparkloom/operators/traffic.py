"""Traffic analytics over query events: captured_at, sql, source_name, query_type, database_user, duration_ms, dag_id, consumer, bytes, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sqltext

# Statements that change rows.
DML = ("insert", "update", "delete", "merge", "truncate")


def classified(events: DataFrame) -> DataFrame:
    """source_type of each event; a map column `labels` may name a DAG too."""
    labels = F.col("labels") if "labels" in events.columns else None
    return events.withColumn("source_type", sqltext.source_type(F.col("source_name"), F.col("database_user"), F.col("dag_id"), F.col("consumer"), labels))


def processed_bytes(metadata: Column) -> Column:
    """bytes_processed of a JSON text, else total_bytes_processed; null where neither is a whole number."""
    of = lambda k: F.get_json_object(metadata, f"$.{k}").try_cast("bigint")
    return F.coalesce(of("bytes_processed"), of("total_bytes_processed"))


def breakdown(events: DataFrame) -> DataFrame:
    counts = classified(events).groupBy("source_type").agg(F.count("*").alias("n"))
    return counts.withColumn("fraction", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # four rows


def frequent(events: DataFrame) -> DataFrame:
    """One row for each normalised query."""
    e = classified(events).withColumn("query_hash", sqltext.fingerprint(sqltext.normalized(F.col("sql"))))
    return e.groupBy("query_hash").agg(F.count("*").alias("n"), F.min_by("sql", F.struct("captured_at", "sql")).alias("sample"), F.round(F.avg("duration_ms"), 6).alias("avg_ms"), F.round(F.avg("bytes"), 6).alias("avg_bytes"), F.array_join(F.array_sort(F.collect_set("source_type")), ",").alias("source_types"))


def table_access(events: DataFrame) -> DataFrame:
    e = events.select(F.explode("tables").alias("table_name"), "database_user", F.lower("query_type").alias("kind"))
    return e.groupBy("table_name").agg(F.count("*").alias("n"), F.countDistinct("database_user").alias("users"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def user_activity(events: DataFrame) -> DataFrame:
    kind = F.lower("query_type")
    return events.groupBy(F.coalesce("database_user", F.lit("<unknown>")).alias("database_user")).agg(
        F.count("*").alias("total"), F.count_if(kind == "select").alias("selects"), F.count_if(kind.isin(*DML)).alias("dml"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes")
    )


def analytics(events: DataFrame) -> dict[str, DataFrame]:
    """All four results and the number of events. The frames share their input; persist it where it is dear to read."""
    return {"breakdown": breakdown(events), "frequent": frequent(events), "table_access": table_access(events), "user_activity": user_activity(events), "events": events.agg(F.count("*").alias("n"))}


def since(events: DataFrame, cursor: str | None) -> DataFrame:
    """Events after the cursor; all where there is none."""
    return events.where(F.col("captured_at") > F.lit(cursor).cast("timestamp")) if cursor else events


def next_cursor(events: DataFrame, cursor: str | None) -> str | None:
    """The cursor for the next pull: the last event's time, or the old one where nothing is new."""
    return since(events, cursor).agg(F.max("captured_at").cast("string")).first()[0] or cursor


def pulled(events: DataFrame, cursor: str | None, start: str, most: int, keep_days: int | None = None, now: str | None = None) -> DataFrame:
    """One pull: oldest first after a cursor, else latest first from `start`; a cursor older than the source keeps is moved up. At most `most` rows (a feature)."""
    if cursor is None:
        return events.where(F.col("captured_at") >= F.lit(start).cast("timestamp")).orderBy(F.desc("captured_at"), "event_id").limit(most)
    low = F.lit(cursor).cast("timestamp")
    if keep_days is not None:
        low = F.greatest(low, F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(keep_days)))
    return events.where(F.col("captured_at") > low).orderBy("captured_at", "event_id").limit(most)


SYSTEM_TABLE = "INFORMATION_SCHEMA"


def stitched(events: DataFrame, source: str, mode: str = "full_sql") -> tuple[DataFrame, DataFrame]:
    """Edges and query observations of query events (captured_at, sql, database_user).

    A statement that writes gives edges from its sources to the written table, a reading one edges to its user's query asset; system tables give none. Edges are
    (upstream, downstream, kind, n, last_seen), observations (fingerprint, sql_text, tables, n, first_seen, last_seen), one for each normalised text.
    """
    e = events.where(F.trim("sql") != "").withColumn("i", sqltext.inspected(F.col("sql")))
    plain = lambda c: ~F.upper(c).contains(SYSTEM_TABLE)
    own = lambda c: F.concat(F.lit(f"{source}::"), c)
    reads = F.when(F.col("i.target").isNotNull(), F.col("i.sources")).otherwise(F.col("i.tables"))
    e = e.withColumn("reads", F.filter(reads, plain)).where(F.size("reads") > 0).where(F.col("i.target").isNull() | plain(F.col("i.target")))
    down = F.when(F.col("i.target").isNotNull(), own(F.col("i.target"))).otherwise(F.concat(F.lit(f"{source}::query::"), F.coalesce("database_user", F.lit("unknown"))))
    kind = F.when(F.col("i.target").isNotNull(), "writes").otherwise("reads")
    edges = e.select(F.explode("reads").alias("up"), down.alias("downstream"), kind.alias("kind"), "captured_at").groupBy(own(F.col("up")).alias("upstream"), "downstream", "kind").agg(F.count("*").alias("n"), F.max("captured_at").alias("last_seen"))
    q = e.withColumn("fingerprint", sqltext.fingerprint(sqltext.normalized(F.col("sql"), lower=False)))
    seen = q.groupBy("fingerprint").agg(F.min_by("sql", F.struct("captured_at", "sql")).alias("sql"), F.array_sort(F.flatten(F.collect_set(F.transform("reads", own)))).alias("tables"), F.count("*").alias("n"), F.min("captured_at").alias("first_seen"), F.max("captured_at").alias("last_seen"))
    return edges, seen.select("fingerprint", sqltext.stored_text(F.col("sql"), F.lit(mode)).alias("sql_text"), F.array_distinct("tables").alias("tables"), "n", "first_seen", "last_seen")


def retained(observations: DataFrame, days: int, now: str) -> DataFrame:
    """Observations seen within the last `days`; the others are pruned."""
    return observations.where(F.col("last_seen") >= F.lit(now).cast("timestamp") - F.make_interval(days=F.lit(days)))
