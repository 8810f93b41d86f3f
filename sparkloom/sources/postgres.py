"""PostgreSQL: catalog queries over JDBC, statement statistics, and query events out of server logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Zone abbreviations of log times, as offsets from UTC.
ZONES = {
    "UTC": "+00:00", "GMT": "+00:00", "PST": "-08:00", "PDT": "-07:00", "MST": "-07:00", "MDT": "-06:00", "CST": "-06:00", "CDT": "-05:00", "EST": "-05:00", "EDT": "-04:00", "BRT": "-03:00", "ART": "-03:00", "CLT": "-04:00", "CLST": "-03:00",
    "WET": "+00:00", "WEST": "+01:00", "CET": "+01:00", "CEST": "+02:00", "EET": "+02:00", "EEST": "+03:00", "MSK": "+03:00", "IST": "+05:30", "PKT": "+05:00", "HKT": "+08:00", "SGT": "+08:00", "JST": "+09:00", "KST": "+09:00",
    "ACST": "+09:30", "AEST": "+10:00", "AEDT": "+11:00", "NZST": "+12:00", "NZDT": "+13:00",
}
# The format of a line, prefix '%t [%p] db=%d,user=%u,app=%a,client=%h ' and message, and of a message with its duration.
LINE = r"^([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9:.]+(?: [A-Z]+|[+-][0-9:]+| [+-][0-9:]+)?) \[([0-9]+)\] db=([^,]*),user=([^,]*),app=([^,]*),client=(\S+) (LOG|ERROR|STATEMENT):\s+(.*)$"
DURATION = r"^duration:\s+([0-9.]+)\s+ms\s+statement:\s+(.+)$"


def log_time(raw: Column) -> Column:
    """A log's time in UTC: by abbreviation or offset, UTC where none is written or known."""
    body = F.regexp_extract(raw, r"^([0-9-]+ [0-9:.]+)", 1)
    zone = F.trim(F.regexp_extract(raw, r"^[0-9-]+ [0-9:.]+\s*([A-Z]+|[+-][0-9:]+)?$", 1))
    named = F.create_map(*(F.lit(x) for kv in ZONES.items() for x in kv))[zone]
    digits = F.regexp_replace(zone, ":", "")
    offset = F.when(zone.rlike(r"^[+-][0-9]{2}$"), F.concat(zone, F.lit(":00"))).when(digits.rlike(r"^[+-][0-9]{4}$"), F.concat(F.substring(digits, 1, 3), F.lit(":"), F.substring(digits, 4, 2)))
    return F.try_to_timestamp(F.concat(body, F.coalesce(named, offset, F.lit("+00:00"))))


def log_lines(lines: DataFrame) -> DataFrame:
    """Parsed lines of (file, nth, value); others give none."""
    part = lambda k: F.regexp_extract("value", LINE, k)
    names = ("time", "pid", "database", "user", "app", "client", "level", "body")
    return lines.where(F.col("value").rlike(LINE)).select("file", "nth", *(part(k + 1).alias(n) for k, n in enumerate(names)))


def log_events(lines: DataFrame) -> DataFrame:
    """Query events: statements with their duration, and statements as such or with the error that the same process reported before.

    An ERROR belongs to the next STATEMENT line of its process; it is found by a window over the lines of a file's process, not by keeping state.
    """
    rows = log_lines(lines)
    # duration lines do not end a pending error
    pair = rows.where("level in ('ERROR', 'STATEMENT')")
    w = Window.partitionBy("file", "pid").orderBy("nth")
    before = F.lag(F.struct("level", "time", "user", "app", "database", "body")).over(w)
    pair = pair.withColumn("e", before).where("level = 'STATEMENT'")
    hit = F.col("e.level") == "ERROR"
    pick = lambda c: F.when(hit, F.col(f"e.{c}")).otherwise(F.col(c))
    said = pair.select("file", "nth", log_time(pick("time")).alias("captured_at"), F.col("body").alias("sql"), F.trim(pick("app")).alias("source_name"), F.when(hit, "error_statement").otherwise("statement").alias("query_type"), F.trim(pick("user")).alias("database_user"), F.lit(None).cast("double").alias("duration_ms"), F.when(hit, F.trim("e.body")).alias("error"), "pid")
    timed = rows.where((F.col("level") == "LOG") & F.col("body").rlike(DURATION)).select("file", "nth", log_time(F.col("time")).alias("captured_at"), F.regexp_extract("body", DURATION, 2).alias("sql"), F.trim("app").alias("source_name"), F.lit("duration").alias("query_type"), F.trim("user").alias("database_user"), F.regexp_extract("body", DURATION, 1).cast("double").alias("duration_ms"), F.lit(None).cast("string").alias("error"), "pid")
    return said.unionByName(timed)


def read_logs(spark: SparkSession, path: str, after: str | None = None) -> DataFrame:
    """Lines (file, nth, value) of log files; with `after`, of files changed since. Lines are numbered by their place within a file, which is one task each."""
    reader = spark.read.option("modifiedAfter", after) if after else spark.read
    files = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\n").alias("ls"))
    return files.select("file", F.posexplode("ls").alias("nth", "value")).where("value != ''")


def log_cursor(lines: DataFrame) -> DataFrame:
    """file, nth of the last line seen of each file; a file that has become shorter starts anew."""
    return lines.groupBy("file").agg(F.max("nth").alias("nth"))


def lines_after(lines: DataFrame, cursor: DataFrame) -> DataFrame:
    """Lines beyond the cursor (file, nth); all of a new file, and of one that is shorter than its cursor (rotated)."""
    size = log_cursor(lines).withColumnRenamed("nth", "last")
    at = size.join(cursor, "file", "left").select("file", F.when(F.col("last") < F.col("nth"), -1).otherwise(F.coalesce("nth", F.lit(-1))).alias("seen"))
    return lines.join(F.broadcast(at), "file").where("nth > seen").drop("seen")  # one row for each file


def statistics(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """The `most` dearest statements of pg_stat_statements rows (query, calls, total_exec_time): the view keeps no more by default."""
    return rows.orderBy(F.desc("total_exec_time"), "query").limit(most).select(F.col("query").alias("sql"), F.col("calls").alias("n"), (F.col("total_exec_time") / F.col("calls")).alias("duration_ms"))


# Catalog schemas that are not the user's.
SYSTEM = ("pg_catalog", "information_schema", "pg_toast")


def schema_of(columns: DataFrame, tables: DataFrame, matview_columns: DataFrame) -> DataFrame:
    """Objects from information_schema.columns (table_schema, table_name, column_name, data_type, is_nullable, ordinal_position), .tables (table_schema, table_name, table_type) and materialised views' columns (same as columns)."""
    keys = ["table_schema", "table_name"]
    mat = matview_columns.withColumn("table_type", F.lit("MATERIALIZED VIEW"))
    rows = columns.join(tables, keys, "left").unionByName(mat).where(~F.col("table_schema").isin(*SYSTEM))
    kind = F.when(F.col("table_type") == "VIEW", "view").when(F.col("table_type") == "MATERIALIZED VIEW", "materialized_view").otherwise("table")
    column = F.struct("ordinal_position", F.col("column_name").alias("name"), F.col("data_type").alias("type"), (F.col("is_nullable") == "YES").alias("nullable"))
    out = rows.groupBy(F.col("table_schema").alias("schema"), F.col("table_name").alias("object"), kind.alias("kind")).agg(F.array_sort(F.collect_list(column)).alias("c"))
    return out.select("schema", "object", "kind", F.transform("c", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["nullable"].alias("nullable"))).alias("columns"))


def dependencies_of(depend: DataFrame, rewrite: DataFrame, classes: DataFrame, namespaces: DataFrame) -> DataFrame:
    """View -> table edges from pg_depend (objid, refobjid), pg_rewrite (oid, ev_class), pg_class (oid, relname, relnamespace, relkind) and pg_namespace (oid, nspname)."""
    named = classes.join(namespaces.select(F.col("oid").alias("relnamespace"), "nspname"), "relnamespace").where(~F.col("nspname").isin(*SYSTEM))
    view = named.where(F.col("relkind").isin("v", "m")).select(F.col("oid").alias("ev_class"), F.col("nspname").alias("from_schema"), F.col("relname").alias("from_object"))
    table = named.select(F.col("oid").alias("refobjid"), F.col("nspname").alias("to_schema"), F.col("relname").alias("to_object"))
    rule = rewrite.select(F.col("oid").alias("objid"), "ev_class")
    return depend.join(rule, "objid").join(view, "ev_class").join(table, "refobjid").where("ev_class != refobjid").select("from_schema", "from_object", "to_schema", "to_object").distinct()


class PostgresAdapter:
    """Catalog tables by JDBC; the driver jar is the session's."""

    kind = "postgres"

    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str]):
        self.spark, self.url, self.properties = spark, url, properties

    def _read(self, query: str) -> DataFrame:
        return self.spark.read.format("jdbc").option("url", self.url).option("query", query).options(**self.properties).load()

    def discover(self) -> DataFrame:
        return self._read("SELECT nspname AS container FROM pg_namespace").where(~F.col("container").isin(*SYSTEM))

    def schema(self) -> DataFrame:
        mat = "SELECT n.nspname AS table_schema, c.relname AS table_name, a.attname AS column_name, format_type(a.atttypid, a.atttypmod) AS data_type, CASE WHEN a.attnotnull THEN 'NO' ELSE 'YES' END AS is_nullable, CAST(a.attnum AS int) AS ordinal_position FROM pg_attribute a JOIN pg_class c ON c.oid = a.attrelid JOIN pg_namespace n ON n.oid = c.relnamespace WHERE c.relkind = 'm' AND a.attnum > 0 AND NOT a.attisdropped"
        return schema_of(self._read("SELECT table_schema, table_name, column_name, data_type, is_nullable, CAST(ordinal_position AS int) AS ordinal_position FROM information_schema.columns"), self._read("SELECT table_schema, table_name, table_type FROM information_schema.tables"), self._read(mat))

    def lineage(self) -> DataFrame:
        return dependencies_of(self._read("SELECT objid, refobjid FROM pg_depend"), self._read("SELECT oid, ev_class FROM pg_rewrite"), self._read("SELECT oid, relname, relnamespace, relkind FROM pg_class"), self._read("SELECT oid, nspname FROM pg_namespace"))

    def traffic(self) -> DataFrame:
        return statistics(self._read("SELECT query, calls, total_exec_time FROM pg_stat_statements"))
