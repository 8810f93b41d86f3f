"""Structured Streaming front ends. Offsets of files and state are the checkpoint's; limits bound a trigger, not the data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import postgres

#: Files of a trigger at most: the bound that a scan of logs has in one go.
FILES_PER_TRIGGER = 100


def log_stream(spark: SparkSession, path: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Lines (file, nth, value) of log files as they arrive; what was read is kept in the query's checkpoint, so a file is read once."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("nth", "value")).where("value != ''")


PAIRED = "pid string, captured_at timestamp, sql string, query_type string, error string"


def _pair(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The error that a process reported last waits in the state for the process' next statement."""
    waiting = state.get if state.exists else (None, None)
    out = []
    for f in frames:
        for r in f.sort_values(["file", "nth"]).itertuples():
            if r.level == "ERROR":
                waiting = (r.at, r.body.strip())
            else:
                out.append((key[0], waiting[0] if waiting[1] is not None else r.at, r.body, "error_statement" if waiting[1] is not None else "statement", waiting[1]))
                waiting = (None, None)
    if waiting[1] is None:
        if state.exists:
            state.remove()
    else:
        state.update(waiting)
    if out:
        yield pd.DataFrame(out, columns=["pid", "captured_at", "sql", "query_type", "error"])


def paired_errors(lines: DataFrame) -> DataFrame:
    """Statements of a stream of lines, each with the error that its process reported before, also where that came in an earlier batch."""
    rows = postgres.log_lines(lines).where("level in ('ERROR', 'STATEMENT')").select("pid", "file", "nth", "level", "body", postgres.log_time(F.col("time")).alias("at"))
    return rows.groupBy("pid").applyInPandasWithState(_pair, PAIRED, "at timestamp, error string", "append", GroupStateTimeout.NoTimeout)


def windowed_activity(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and user; events later than `late` are not waited for."""
    return events.withWatermark("captured_at", late).groupBy(F.window("captured_at", width).alias("w"), F.coalesce("database_user", F.lit("<unknown>")).alias("database_user")).agg(F.count("*").alias("total"), F.sum("bytes").alias("bytes")).select(F.col("w.start").alias("start"), "database_user", "total", "bytes")


Hook = Callable[[DataFrame, int], None]


def with_hooks(events: DataFrame, checkpoint: str, *hooks: Hook):
    """Runs hooks on each batch, in order; the query, started. A batch that is tried again after a failure has the same number, by which hooks can tell."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for hook in hooks:
                hook(batch, number)
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def webhook(url: str, secret: str | None = None, tries: int = 3, wait: float = 0.5) -> Hook:
    """A hook that posts each row of a batch as JSON, signed with SHA-256 where a secret is given. It runs on the driver: for findings of a scan, not for its data."""
    import hashlib
    import hmac
    import urllib.error
    import urllib.request

    from ..sources.base import Retryable, retried

    def post(body: bytes, number: int) -> None:
        headers = {"Content-Type": "application/json", "X-Batch": str(number)}
        if secret:
            headers["X-Signature"] = hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()

        def call() -> None:
            try:
                urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=10).close()
            except urllib.error.HTTPError as e:
                if e.code < 500:
                    raise
                raise Retryable(str(e)) from e
            except urllib.error.URLError as e:
                raise Retryable(str(e)) from e

        retried(call, tries, wait)

    def hook(batch: DataFrame, number: int) -> None:
        for row in batch.toJSON().toLocalIterator():
            post(row.encode(), number)

    return hook
