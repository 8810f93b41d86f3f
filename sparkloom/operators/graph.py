"""Lineage graphs as edge tables: inference with confidence, merging, traversal, impact."""

from __future__ import annotations

import atexit
import uuid
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Edges up to which a traversal runs on the driver; more are joined level by level.
DRIVER_EDGES = 100_000
#: Levels of a traversal after which all that was seen is written again, so that long chains keep short plans.
CUT_LEVELS = 32


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # stopped before: nothing can be deleted any more
        return
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own where none is set and all runs in one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="loom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back, so that loops keep short plans."""
    spark: SparkSession = df.sparkSession
    path = scratch(spark, "graph")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def inferred(observed: DataFrame, now: str) -> DataFrame:
    """observed (source, target, by_column, seen_at) -> confidence from method, frequency and age."""
    g = observed.groupBy("source", "target").agg(F.count("*").alias("n"), F.max(F.col("by_column").cast("int")).alias("c"), F.max("seen_at").alias("last"))
    top = g.agg(F.max("n").alias("top"))  # one row
    days = F.datediff(F.lit(now).cast("date"), F.col("last").cast("date"))
    base = F.when(F.col("c") == 1, 0.9).otherwise(0.7)
    boost = F.when(F.col("top") <= 1, 0.1).otherwise(F.log(F.col("n")) / F.log(F.col("top")) * 0.1)
    fresh = F.when(days > 90, 0.7).when(days > 30, 0.9).otherwise(1.0)
    return g.crossJoin(F.broadcast(top)).select("source", "target", "n", F.round(F.least((base + boost) * fresh, F.lit(1.0)), 6).alias("confidence"))


def declared_first(declared: DataFrame, guessed: DataFrame) -> DataFrame:
    return declared.unionByName(guessed.join(declared, ["source", "target"], "left_anti"))


def reach(edges: DataFrame, start: str, down: bool = True, depth: int | None = None, limit: int | None = None) -> DataFrame:
    """node, depth of all nodes reachable from start, which is left out; cycles end.

    Without a depth it goes on until no node is new; more than `limit` levels, if given, are an error. A lineage graph of at most DRIVER_EDGES edges is walked on the
    driver; a larger one takes one join for each level, cut each time.
    """
    a, b = ("source", "target") if down else ("target", "source")
    step = edges.select(F.col(a).cast("string").alias("here"), F.col(b).cast("string").alias("there"))
    few = step.limit(DRIVER_EDGES + 1).collect()
    if len(few) <= DRIVER_EDGES:
        return _walked(edges.sparkSession, few, start, depth, limit)
    return _joined_levels(step, start, depth, limit)


def _walked(spark: SparkSession, edges: list, start: str, depth: int | None, limit: int | None) -> DataFrame:
    near: dict[str, list[str]] = {}
    for here, there in edges:
        near.setdefault(here, []).append(there)
    seen, front, level = {start: 0}, [start], 0
    while front and level != depth:
        level += 1
        front = list(dict.fromkeys(n for f in front for n in near.get(f, ()) if n is not None and n not in seen))
        if front and depth is None and limit is not None and level > limit:
            raise RuntimeError(f"nodes beyond {limit} levels")
        seen.update(dict.fromkeys(front, level))
    return spark.createDataFrame([(n, k) for n, k in seen.items() if k], "node string, depth int")


def _joined_levels(step: DataFrame, start: str, depth: int | None, limit: int | None) -> DataFrame:
    seen = cut(step.sparkSession.createDataFrame([(start, 0)], "node string, depth int"))
    for level in range(1, depth + 1) if depth is not None else count(1):
        new = cut(step.join(seen.where(F.col("depth") == level - 1), F.col("here") == F.col("node")).select(F.col("there").alias("node")).where("node is not null").distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(level)))
        if new.isEmpty():
            break
        if depth is None and limit is not None and level > limit:
            raise RuntimeError(f"nodes beyond {limit} levels")
        seen = seen.unionByName(new)
        if level % CUT_LEVELS == 0:
            seen = cut(seen)
    return seen.where(F.col("depth") > 0)


def impact(edges: DataFrame, queries: DataFrame, start: str) -> DataFrame:
    """Downstream nodes with the executions of the queries (tables, executions) that read them."""
    use = queries.select(F.explode("tables").alias("node"), "executions").groupBy("node").agg(F.sum("executions").alias("executions"))
    return reach(edges, start).join(use, "node", "left").select("node", "depth", F.coalesce("executions", F.lit(0)).alias("executions"))


# Weights of name, columns, types and row counts.
WEIGHTS = {"name": 0.5, "columns": 0.3, "types": 0.1, "rows": 0.1}


def row_similarity(a: Column, b: Column) -> Column:
    """1 less the difference over the larger count; null where one is missing."""
    return 1 - F.abs(a - b) / F.greatest(a, b, F.lit(1))


def match_score(a: str, b: str, weights: dict[str, float] = WEIGHTS) -> Column:
    """How alike two objects (object, row_count, columns) under these aliases are; without row counts the other weights count for all."""
    from ..functions.sqltext import type_match

    same = F.lower(F.trim(F.col(f"{a}.object"))) == F.lower(F.trim(F.col(f"{b}.object")))
    names = lambda x: F.array_distinct(F.transform(F.col(f"{x}.columns"), lambda c: F.lower(c["name"])))
    both, either = F.array_intersect(names(a), names(b)), F.array_union(names(a), names(b))
    kind = lambda x, n: F.element_at(F.filter(F.col(f"{x}.columns"), lambda c: F.lower(c["name"]) == n), 1)["type"]
    types = F.aggregate(both, F.lit(0.0), lambda s, n: s + type_match(kind(a, n), kind(b, n))) / F.greatest(F.size(both), F.lit(1))
    rows = row_similarity(F.col(f"{a}.row_count"), F.col(f"{b}.row_count"))
    known = weights["name"] * same.cast("int") + weights["columns"] * F.size(both) / F.greatest(F.size(either), F.lit(1)) + weights["types"] * types
    return (known + weights["rows"] * F.coalesce(rows, F.lit(0.0))) / F.when(rows.isNull(), 1 - weights["rows"]).otherwise(1.0)


def match_scores(sources: DataFrame, targets: DataFrame, threshold: float = 0.6, every: bool = False) -> DataFrame:
    """Objects (object, row_count, columns array<struct<name,type>>; schema if there) of two systems that look alike, ranked by score, schema, object.

    A pair with other names scores under `threshold` by default, so only equal names can match: the join is on the name. With `every`, all pairs of objects that
    have columns and a score above 0 come; those below the threshold are candidates. Objects are a catalog's, not its data.
    """
    if threshold <= 0.5 / 0.9 and not every:
        raise ValueError("below this, pairs with different names match too")
    a, b = sources.alias("a"), targets.alias("b")
    pairs = a.where(F.size("columns") > 0).crossJoin(b.where(F.size("columns") > 0)) if every else a.join(b, F.lower(F.trim("a.object")) == F.lower(F.trim("b.object")))
    schema = F.col("b.schema") if "schema" in targets.columns else F.lit("")
    out = pairs.select(F.col("a.object").alias("source_object"), F.col("b.object").alias("target_object"), schema.alias("__schema"), F.round(match_score("a", "b"), 6).alias("score"))
    out = out.where("score > 0") if every else out
    best = Window.partitionBy("source_object").orderBy(F.desc("score"), "__schema", "target_object")
    return out.withColumn("rank", F.row_number().over(best)).withColumn("primary_match", (F.col("rank") == 1) & (F.col("score") >= threshold)).drop("__schema")


def edges_of(statements: DataFrame, consumer: Column) -> DataFrame:
    """statements (sql, ...) -> upstream, downstream, kind: sources to the written table, else read tables to the consumer; CTEs are no tables."""
    from ..functions import sqltext

    e = statements.select(sqltext.inspected(F.col("sql")).alias("i"), consumer.alias("who"))
    writes = F.col("i.target").isNotNull()
    return e.select(F.explode(F.when(writes, F.col("i.sources")).otherwise(F.col("i.tables"))).alias("upstream"), F.when(writes, F.col("i.target")).otherwise(F.col("who")).alias("downstream"), F.when(writes, "writes").otherwise("reads").alias("kind")).distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    """All nodes with their numbers of neighbours each way."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")), F.struct(F.col("target").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("up").alias("upstream"), F.sum("down").alias("downstream"))


def has_node(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (node) -> node, known."""
    return asked.join(nodes_of(edges).select("node", F.lit(True).alias("known")), "node", "left").select("node", F.coalesce("known", F.lit(False)).alias("known"))


def lineage_summary(edges: DataFrame, start: str, down: bool = True, depth: int | None = None) -> DataFrame:
    """One row: whether the node exists, and its related nodes by depth then name."""
    found = reach(edges, start, down, depth).agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("found"))
    known = has_node(edges, edges.sparkSession.createDataFrame([(start,)], "node string"))
    return known.crossJoin(found).select("node", F.col("known").alias("asset_exists"), F.transform("found", lambda x: x["node"]).alias("related"))  # one row each


def relationship(edges: DataFrame, columns: DataFrame, a: str, b: str) -> DataFrame:
    """Direct edges (upstream, downstream, kind) either way, and columns (asset, column_name, description) of one that name the other's table."""
    direct = edges.where(((F.col("upstream") == a) & (F.col("downstream") == b)) | ((F.col("upstream") == b) & (F.col("downstream") == a))).select(F.lit("edge").alias("what"), "upstream", "downstream", F.col("kind").alias("detail"))
    bare = lambda x: x.split("::")[-1].split(".")[-1].lower()
    names = lambda c, other: F.lower(F.coalesce(F.col(c), F.lit(""))).contains(bare(other))
    hints = [columns.where((F.col("asset") == x) & (names("column_name", y) | names("description", y))).select(F.lit("possible key").alias("what"), F.lit(x).alias("upstream"), F.lit(y).alias("downstream"), F.col("column_name").alias("detail")) for x, y in ((a, b), (b, a))]
    return direct.unionByName(hints[0]).unionByName(hints[1])


def status(assets: DataFrame, edges: DataFrame, queries: DataFrame) -> DataFrame:
    """what, key, n: numbers of assets, edges and queries, and of assets by kind and by source."""
    total = lambda df, w: df.agg(F.count("*").alias("n")).select(F.lit(w).alias("what"), F.lit("").alias("key"), "n")
    by = lambda c: assets.groupBy(F.col(c).alias("key")).agg(F.count("*").alias("n")).select(F.lit(c).alias("what"), "key", "n")
    return total(assets, "assets").unionByName(total(edges, "edges")).unionByName(total(queries, "queries")).unionByName(by("kind")).unionByName(by("source"))


def cross_system(tables: DataFrame, confidence: float = 0.5) -> DataFrame:
    """tables (system, name) -> source, target, confidence for every ordered pair of systems that have a table of one bare name, its first full name in each.

    A name's systems are paired, not its tables; systems are few.
    """
    bare = F.lower(F.element_at(F.split("name", r"\."), -1))
    first = tables.groupBy(bare.alias("bare"), "system").agg(F.min("name").alias("name"))
    a, b = first.alias("a"), first.alias("b")
    full = lambda x: F.concat(f"{x}.system", F.lit("::"), f"{x}.name")
    return a.join(b, (F.col("a.bare") == F.col("b.bare")) & (F.col("a.system") != F.col("b.system"))).select(full("a").alias("source"), full("b").alias("target"), F.lit(confidence).alias("confidence"))


def resolved_sources(declared: DataFrame, assets: DataFrame) -> DataFrame:
    """declared (node, schema, table) joined to assets (asset, schema, table) of warehouses, without regard to case -> upstream, downstream, confidence 1."""
    key = lambda df: F.lower(F.concat_ws(".", df["schema"], df["table"]))
    left, right = declared.select("node", key(declared).alias("key")), assets.select("asset", key(assets).alias("key"))
    return left.join(right, "key").select(F.col("asset").alias("upstream"), F.col("node").alias("downstream"), F.lit(1.0).alias("confidence")).distinct()


def discovered(objects: DataFrame, allow: list[str] | None = None, deny: list[str] | None = None, max_pairs: int | None = None, schemas: list[str] | None = None, threshold: float = 0.6) -> DataFrame:
    """Edges between the objects (source, schema, object, row_count, columns) of every unordered pair of sources whose best match reaches the threshold.

    Pairs of sources are those of the lists, the first `max_pairs` in order; only objects with columns, and of the listed schemas, are destinations. All pairs of sources are one join on the name.
    """
    systems = sorted(r[0] for r in objects.select("source").distinct().collect() if (not allow or r[0] in allow) and r[0] not in (deny or []))
    pairs = [(x, y) for i, x in enumerate(systems) for y in systems[i + 1 :]][:max_pairs]
    chosen = F.broadcast(objects.sparkSession.createDataFrame(pairs, "x string, y string"))
    a = objects.where(F.size("columns") > 0).alias("a")
    b = in_scope(objects, schemas).alias("b")
    both = a.join(b, F.lower("a.object") == F.lower("b.object")).join(chosen, (F.col("a.source") == F.col("x")) & (F.col("b.source") == F.col("y")))
    score = match_score("a", "b")
    own = lambda t: F.concat(f"{t}.source", F.lit("::"), f"{t}.schema", F.lit("."), f"{t}.object")
    rows = both.select(own("a").alias("upstream"), own("b").alias("downstream"), F.col("b.schema").alias("schema"), F.col("b.object").alias("object"), F.col("b.source").alias("to"), F.round(score, 6).alias("score"))
    best = Window.partitionBy("upstream", "to").orderBy(F.desc("score"), "schema", "object")
    return rows.withColumn("rank", F.row_number().over(best)).where((F.col("rank") == 1) & (F.col("score") >= threshold)).select("upstream", "downstream", F.lit("schema_match").alias("kind"), "score")


def in_scope(objects: DataFrame, schemas: list[str] | None) -> DataFrame:
    """Objects that may be destinations: with columns, and of the listed schemas where some are listed."""
    out = objects.where(F.size("columns") > 0)
    return out.where(F.lower("schema").isin([s.lower() for s in schemas])) if schemas else out


# Kinds of edges whose transport can be learned.
LEARNABLE = ("schema_match", "dbt_source_ref", "depends_on")


def unlearned(edges: DataFrame, prefix: str | None = None) -> DataFrame:
    """Edges (upstream, downstream, kind, learning_status) of a learnable kind, not within one object of one source, not learned yet, touching the source if one is given."""
    out = edges.where(F.col("kind").isin(*LEARNABLE) & (F.col("upstream") != F.col("downstream")) & (F.coalesce("learning_status", F.lit("")) != "learned"))
    return out.where(F.col("upstream").startswith(f"{prefix}::") | F.col("downstream").startswith(f"{prefix}::")) if prefix else out


def projected_schema(objects: DataFrame, dependencies: DataFrame, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Assets, snapshots and depends_on edges of extracted objects (schema, object, kind, columns) and dependencies (from_schema, from_object, to_schema, to_object)."""
    key = lambda s, o: F.concat(F.lit(f"{source}::"), F.col(s), F.lit("."), F.col(o))
    assets = objects.select(key("schema", "object").alias("id"), F.lit(source).alias("source"), "kind", F.concat_ws(".", "schema", "object").alias("name"))
    snaps = objects.where(F.size("columns") > 0).select(key("schema", "object").alias("asset"), "columns", F.substring(F.sha2(F.to_json("columns"), 256), 1, 16).alias("fingerprint"))
    ids = assets.select("id")
    edges = dependencies.select(key("to_schema", "to_object").alias("upstream"), key("from_schema", "from_object").alias("downstream"), F.lit("depends_on").alias("kind"))
    return assets, snaps, edges.join(ids, edges["upstream"] == ids["id"], "left_semi").join(ids, edges["downstream"] == ids["id"], "left_semi").distinct()


def projected_lineage(edges: DataFrame, known: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Placeholder assets for ends (source_object, target_object, edge_kind) that are no known asset (id), and the edges between ids; own ids stay as they are."""
    own = lambda c: F.when(F.col(c).contains("::"), F.col(c)).otherwise(F.concat(F.lit(f"{source}::"), F.col(c)))
    kind = F.when(F.col("edge_kind") == "declared", "depends_on").when(F.col("edge_kind").startswith("inferred"), "inferred").otherwise(F.col("edge_kind"))
    links = edges.select(own("source_object").alias("upstream"), own("target_object").alias("downstream"), kind.alias("kind")).distinct()
    ends = links.select(F.explode(F.array("upstream", "downstream")).alias("id")).distinct().join(known, "id", "left_anti")
    return ends.select("id", F.element_at(F.split("id", "::"), 1).alias("source"), F.lit("external").alias("kind"), F.element_at(F.split("id", "::"), -1).alias("name")), links
