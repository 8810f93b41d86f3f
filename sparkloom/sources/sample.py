"""A small graph to try things on: the tables of an order system, and how they feed each other."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.store import Store

EDGES = [("region", "nation"), ("nation", "customer"), ("nation", "supplier"), ("customer", "orders"), ("orders", "lineitem"), ("part", "lineitem"), ("supplier", "lineitem"), ("lineitem", "sales"), ("sales", "orders")]


def install(spark: SparkSession, path: str) -> Store:
    """Writes the sample's assets and edges as the store's next versions."""
    store = Store(spark, path)
    names = sorted({n for e in EDGES for n in e})
    store.write("assets", spark.createDataFrame([(f"sample::{n}", "sample", "table", n) for n in names], "id string, source string, kind string, name string"))
    store.write("edges", spark.createDataFrame([(f"sample::{a}", f"sample::{b}", "feeds") for a, b in EDGES], "upstream string, downstream string, kind string"))
    return store
