"""Profiles, schema drift, contracts, enforcement, and merge semantics of the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How grave each violation is.
SEVERITY = {"added_column": "info", "removed_column": "warning", "type_changed": "error", "table_dropped": "error", "row_count_anomaly": "warning"}


def profile(df: DataFrame) -> DataFrame:
    """column_name, n_distinct, n_null, null_fraction, min_value, max_value of every column.

    Cells are (column, value) pairs, counted by value before they are counted by column: two shuffles of partial sums, whatever the number of columns. Extremes are
    those of the column's own type.
    """
    plain = df.agg(F.count("*").alias("rows"), *(f(df[c]).cast("string").alias(f"{k}{i}") for i, c in enumerate(df.columns) for k, f in (("a", F.min), ("z", F.max))))
    ends = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"a{i}").alias("min_value"), F.col(f"z{i}").alias("max_value"), "rows") for i, c in enumerate(df.columns)))
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), df[c].cast("string").alias("value")) for c in df.columns))).alias("x")).select("x.*")
    values = cells.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    counts = values.groupBy("column_name").agg(F.count("value").alias("n_distinct"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"))
    share = F.round(F.when(F.col("rows") > 0, F.coalesce("n_null", F.lit(0)) / F.col("rows")).otherwise(0.0), 6)
    one = plain.select(F.explode(ends).alias("e")).select("e.*").join(F.broadcast(counts), "column_name", "left")  # a row for each column
    return one.select("column_name", F.coalesce("n_distinct", F.lit(0)).cast("bigint").alias("n_distinct"), F.coalesce("n_null", F.lit(0)).cast("bigint").alias("n_null"), share.alias("null_fraction"), "min_value", "max_value")


# A column of more distinct values has no top values; how many samples a date-like column shows.
MOST_DISTINCT, SAMPLES = 200, 5


def top_values(df: DataFrame, column: str, most: int = 50, most_distinct: int = MOST_DISTINCT) -> DataFrame:
    """The `most` frequent values (a report), none where the column has more than `most_distinct`."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    few = counts.agg((F.count("*") <= most_distinct).alias("few"))
    return counts.orderBy(F.desc("n"), "value").limit(most).join(F.broadcast(few.where("few")), how="cross").select("value", "n")  # one row


def sample_values(df: DataFrame, column: str, most: int = SAMPLES) -> DataFrame:
    """The first `most` values of a date-like column (by type or by name); none of others."""
    kind = df.schema[column].dataType.typeName()
    like = kind in ("date", "timestamp", "timestamp_ntz") or any(x in column.lower() for x in ("date", "time", "_at"))
    rows = df.where(F.col(column).isNotNull() if like else F.lit(False)).select(F.col(column).cast("string").alias("value"))
    return rows.distinct().orderBy("value").limit(most)


def drift(old: DataFrame, new: DataFrame, old_counts: DataFrame | None = None, new_counts: DataFrame | None = None) -> DataFrame:
    """old, new (asset, column_name, type) -> asset, column_name, violation, severity.

    With row counts of both scans (asset, row_count), a change by more than half of an old count above 0 is an anomaly of an asset that both have.
    """
    o = old.select("asset", F.lower("column_name").alias("column_name"), F.col("type").alias("was"))
    n = new.select("asset", F.lower("column_name").alias("column_name"), F.col("type").alias("now"))
    gone = o.select("asset").distinct().join(n.select("asset").distinct(), "asset", "left_anti")
    known = o.select("asset").distinct()
    cols = o.join(n, ["asset", "column_name"], "full").join(gone, "asset", "left_anti").join(known, "asset", "left_semi")
    kind = F.when(F.col("was").isNull(), "added_column").when(F.col("now").isNull(), "removed_column").when(F.lower("was") != F.lower("now"), "type_changed")
    out = cols.select("asset", "column_name", kind.alias("violation")).where("violation is not null").unionByName(gone.select("asset", F.lit(None).cast("string").alias("column_name"), F.lit("table_dropped").alias("violation")))
    if old_counts is not None and new_counts is not None:
        counts = old_counts.select("asset", F.col("row_count").alias("was")).join(new_counts.select("asset", F.col("row_count").alias("now")), "asset").join(known, "asset", "left_semi").join(gone, "asset", "left_anti")
        odd = counts.where((F.col("was") > 0) & (F.abs(F.col("now") - F.col("was")) / F.col("was") > 0.5))
        out = out.unionByName(odd.select("asset", F.lit(None).cast("string").alias("column_name"), F.lit("row_count_anomaly").alias("violation")))
    level = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    return out.withColumn("severity", level[F.col("violation")])


def enforced(violations: DataFrame, modes: DataFrame) -> DataFrame:
    """asset, mode, n, blocked: only enforce mode with an error blocks; unknown modes count as shadow."""
    mode = F.when(F.col("mode").isin("warn", "enforce"), F.col("mode")).otherwise("shadow")
    return violations.join(modes, "asset", "left").groupBy("asset", mode.alias("mode")).agg(F.count("*").alias("n"), (F.bool_or(F.col("severity") == "error") & (F.first(mode) == "enforce")).alias("blocked"))


def contract_issues(spec: DataFrame, snapshot: DataFrame) -> DataFrame:
    """spec (asset, column_name, type, nullable), snapshot (asset, column_name, type, nullable) -> asset, column_name, code."""
    s = spec.select("asset", F.trim("column_name").alias("name"), F.lower(F.trim("type")).alias("want"), F.col("nullable").alias("may"))
    a = snapshot.select("asset", F.lower("column_name").alias("key"), F.lower("type").alias("is"), F.col("nullable").alias("can"))
    have = snapshot.select("asset").distinct().withColumn("known", F.lit(True))
    j = s.join(have, "asset", "left").withColumn("key", F.lower("name")).join(a, ["asset", "key"], "left")
    codes = F.when(F.col("known").isNull(), F.array(F.lit("missing_snapshot"))).when(F.coalesce("name", F.lit("")) == "", F.array(F.lit("invalid_column"))).when(F.col("is").isNull(), F.array(F.lit("missing_column"))).otherwise(
        F.array_compact(F.array(F.when((F.col("want") != "") & (F.col("want") != F.col("is")), "type_mismatch"), F.when((F.col("may") == F.lit(False)) & F.col("can"), "nullability_mismatch")))
    )
    return j.select("asset", F.col("name").alias("column_name"), F.explode(codes).alias("code"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write wins on `keys`; first_seen is the least and last_seen the largest of all versions."""
    both = old.unionByName(new)
    w = Window.partitionBy(*keys)
    latest = F.row_number().over(w.orderBy(F.desc(order)))
    return both.withColumns({"first_seen": F.min("first_seen").over(w), "last_seen": F.max("last_seen").over(w), "__nth": latest}).where("__nth = 1").drop("__nth")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as bags."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def selected_contracts(contracts: DataFrame) -> DataFrame:
    """Contracts (id, asset, status, updated_at) to check: all active ones of an asset, else its latest that is not deprecated."""
    w = Window.partitionBy("asset")
    active = F.max((F.col("status") == "active").cast("int")).over(w)
    rows = contracts.where("status is null or status != 'deprecated'").withColumn("__any", active)
    nth = F.row_number().over(w.orderBy(F.desc("updated_at"), "id"))
    return rows.withColumn("__nth", nth).where((F.col("status") == "active") | (F.col("__any").isNull() | (F.col("__any") == 0)) & (F.col("__nth") == 1)).drop("__any", "__nth")


COLUMN_LIST = "array<struct<name:string,type:string,nullable:boolean>>"


def contract_columns(payload: DataFrame) -> DataFrame:
    """asset, column_name, type, nullable of contracts (asset, payload JSON): the first list of columns, schema or spec, or the columns within it."""
    of = lambda path: F.from_json(F.get_json_object("payload", path), COLUMN_LIST)
    is_list = lambda path: F.get_json_object("payload", path).startswith("[")
    paths = [p for k in ("columns", "schema", "spec") for p in (f"$.{k}", f"$.{k}.columns")]
    found = F.coalesce(*(F.when(is_list(p), of(p)) for p in paths))
    return payload.select("asset", F.explode(found).alias("c")).select("asset", F.coalesce("c.name", F.lit("")).alias("column_name"), F.coalesce("c.type", F.lit("")).alias("type"), F.coalesce("c.nullable", F.lit(True)).alias("nullable"))


# How grave each issue of a contract is.
ISSUE_SEVERITY = {"missing_column": "error", "type_mismatch": "error", "nullability_mismatch": "error", "invalid_column": "error", "missing_snapshot": "error"}


def enforcement_run(contracts: DataFrame, payloads: DataFrame, snapshot: DataFrame, modes: DataFrame) -> DataFrame:
    """Outcome by asset of checking a scan's snapshot (asset, column_name, type, nullable) against its selected contracts (id, asset, status, updated_at; payloads id, payload)."""
    chosen = selected_contracts(contracts).join(payloads, "id").select("asset", "payload")
    issues = contract_issues(contract_columns(chosen), snapshot)
    level = F.create_map(*(F.lit(x) for kv in ISSUE_SEVERITY.items() for x in kv))
    return enforced(issues.withColumn("severity", level[F.col("code")]), modes)


def validated_files(files: DataFrame, snapshot: DataFrame) -> DataFrame:
    """asset, valid, issues for contract files (value: JSON text with asset_id): what a check before a merge reports."""
    payload = files.select(F.get_json_object("value", "$.asset_id").alias("asset"), F.col("value").alias("payload"))
    issues = contract_issues(contract_columns(payload), snapshot).groupBy("asset").agg(F.array_sort(F.collect_list(F.concat_ws(":", "column_name", "code"))).alias("issues"))
    return payload.select("asset").distinct().join(issues, "asset", "left").select("asset", F.col("issues").isNull().alias("valid"), F.array_join(F.coalesce("issues", F.array().cast("array<string>")), ",").alias("issues"))


def verified_sql(used: DataFrame, notes: DataFrame, guidance: DataFrame) -> DataFrame:
    """Warnings: used (query, asset, column_name, in_aggregate) against notes (asset, column_name, note) of surrogate keys, and join guidance (a, b, text) of asset pairs in one query."""
    keys = notes.where(F.lower("note").contains("surrogate key"))
    sums = used.where("in_aggregate").join(keys, (F.lower(used["column_name"]) == F.lower(keys["column_name"])) & (used["asset"] == keys["asset"])).select("query", F.concat(used["asset"], F.lit("."), used["column_name"], F.lit(" is a surrogate key")).alias("warning"))
    mine = used.select("query", "asset").distinct()
    x, y = mine.alias("x"), mine.alias("y")
    g = guidance.alias("g")
    pairs = x.join(g, F.col("x.asset") == F.col("g.a")).join(y, (F.col("y.asset") == F.col("g.b")) & (F.col("y.query") == F.col("x.query"))).select(F.col("x.query").alias("query"), F.col("g.text").alias("warning"))
    return sums.unionByName(pairs).distinct()


def sql_uses(query: str, sql: str) -> list[tuple[str, str, str, bool]]:
    """(query, asset, column, whether in SUM or AVG) of a statement: its tables' columns as far as the text tells them apart."""
    from ..plans import expr as X
    from ..plans import ir, parser, rewrites

    node = parser.to_algebra(sql)
    table = {rewrites.alias_of(s).lower(): s.table.lower() for s in rewrites.scans(node)}
    out = {(query, t, "", False) for t in table.values()}
    summed: set[tuple[str | None, str]] = set()
    named: set[tuple[str | None, str]] = set()
    for n in node.walk():
        texts = [e for e, _ in n.items if e != "*"] if isinstance(n, ir.Project) and not isinstance(n.child, ir.Aggregate) else [e for e, _ in n.keys + n.measures] if isinstance(n, ir.Aggregate) else list(n.conjuncts) if isinstance(n, ir.Filter) else []
        for e in map(X.parse, texts):
            named.update(e.columns())
            summed.update(c for x in e.walk() if x.op == "call" and x.value[0] in ("sum", "avg") for c in x.columns())
    for c in named:
        owners = [table.get(c[0].lower())] if c[0] else list(dict.fromkeys(table.values()))
        out |= {(query, o, c[1].lower(), c in summed) for o in owners if o}
    return sorted(out)


def context_bundle(asset: str, assets: DataFrame, columns: DataFrame, edges: DataFrame, contracts: DataFrame, caps: tuple[int, int, int] = (12, 8, 8)) -> DataFrame:
    """One row about an asset: kind, its first columns, neighbours and contracts, as many as are shown (a display), and how many there are."""
    a = assets.where(F.col("id") == asset).select("id", "kind")
    listed = lambda df, c, cap, name: df.agg(F.slice(F.array_sort(F.collect_set(c)), 1, cap).alias(name), F.count_distinct(c).alias(f"n_{name}"))
    near = edges.where((F.col("upstream") == asset) | (F.col("downstream") == asset)).select(F.when(F.col("upstream") == asset, F.col("downstream")).otherwise(F.col("upstream")).alias("other"))
    parts = [listed(columns.where(F.col("asset") == asset), "column_name", caps[0], "columns"), listed(near, "other", caps[1], "neighbours"), listed(contracts.where(F.col("asset") == asset), "id", caps[2], "contracts")]
    for p in parts:
        a = a.crossJoin(p)  # one row each
    return a


def column_parity(edges: DataFrame, columns: DataFrame) -> DataFrame:
    """upstream, downstream, parity of edges by the names of the columns (asset, column_name) on both sides: strict, superset, subset or diverged as seen from downstream."""
    lists = columns.groupBy("asset").agg(F.collect_set(F.lower("column_name")).alias("names"))
    j = edges.select("upstream", "downstream").distinct().join(lists.select(F.col("asset").alias("upstream"), F.col("names").alias("u")), "upstream").join(lists.select(F.col("asset").alias("downstream"), F.col("names").alias("d")), "downstream")
    more, less = F.size(F.array_except("d", "u")) > 0, F.size(F.array_except("u", "d")) > 0
    return j.select("upstream", "downstream", F.when(more & less, "diverged").when(more, "superset").when(less, "subset").otherwise("strict").alias("parity"))


def type_compatibility(source: Column, target: Column) -> Column:
    """exact, safe, lossy, risky or unknown for a value of the source type read as the target's: by family, then by whether every value fits."""
    from ..functions.sqltext import type_family

    a, b = type_family(source), type_family(target)
    wider = {"integer": ("numeric", "float"), "timestamp": ("datetime",), "datetime": ("timestamp",), "date": ("timestamp", "datetime")}
    narrower = {"numeric": ("integer", "float"), "float": ("integer", "numeric"), "timestamp": ("date",), "datetime": ("date",)}
    safe = lossy = F.lit(False)
    for k, v in wider.items():
        safe = safe | ((a == k) & b.isin(*v))
    for k, v in narrower.items():
        lossy = lossy | ((a == k) & b.isin(*v))
    return F.when((a == "unknown") | (b == "unknown"), "unknown").when(F.lower(F.trim(source)) == F.lower(F.trim(target)), "exact").when((a == b) | safe | (b == "string"), "safe").when(lossy, "lossy").otherwise("risky")


def normalized_hash(df: DataFrame) -> DataFrame:
    """One row: number of rows and an order-free hash of their content, doubles rounded, so that equal bags have equal rows."""
    plain = [F.round(df[c], 6).cast("string") if df.schema[c].dataType.typeName() in ("double", "float") else df[c].cast("string") for c in sorted(df.columns)]
    return df.select(F.xxhash64(*plain).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("content"))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: both numbers of rows and whether the bags are the same."""
    x, y = normalized_hash(a), normalized_hash(b)
    return x.toDF("rows_a", "ha").crossJoin(y.toDF("rows_b", "hb")).select("rows_a", "rows_b", ((F.col("rows_a") == F.col("rows_b")) & (F.col("ha") == F.col("hb"))).alias("same"))  # one row each
