"""Shared-folder tables that cut lineage, and small helpers for the operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_WORDS = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs in one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def _drop(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def saved(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes df as Parquet under the shared folder and reads it back; removed when the driver exits.

    Shuffle files of the finished write go with their last reference in the driver's JVM, so it is asked to look for those.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loom/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    atexit.register(_drop, spark, path)
    released(spark)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Shuffle files go with the last reference to their plan in the driver's JVM; Python holds references too, and those of the latest query last until another has run."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Batches to Python workers end at a number of bytes as well as rows, as texts differ in length; a limit already set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.conf.get(key, None):
        spark.conf.set(key, size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of all documents among ids (doc_id, cheap to read), and of few others: the rest is left out before it is exchanged, by a bitmap of hashes."""
    bits = 64 * min(MOST_WORDS, ids.count() // 8 + 1)
    words = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("p")).groupBy(F.expr("p div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("met"))
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    return text.withColumn("p", place).join(F.broadcast(words), F.expr("p div 64 = word and getbit(met, cast(p % 64 as int)) = 1"), "left_semi").select("doc_id", "text")


_STATE: dict[str, object] = {}


def trimmed() -> None:
    """Gives what a worker has freed back to the machine, as the executor's other workers and its JVM need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def worker_state[T](key: str, build: Callable[[], T]) -> T:
    """What an operator keeps in a worker from task to task. A worker keeps that of one operator at a time, as later stages run in the same workers."""
    if key not in _STATE:
        _STATE.clear()
        trimmed()
        _STATE[key] = build()
    return _STATE[key]
