"""What all adapters share: capabilities, the registry of kinds, bounded retries, and read-only queries."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import parser

# What an adapter may be able to do.
CAPABILITIES = ("discover", "schema", "definitions", "traffic", "lineage", "orchestration")

OBJECTS = "schema string, object string, kind string, row_count bigint, columns array<struct<name:string,type:string,nullable:boolean>>"
EDGES = "source_object string, target_object string, edge_kind string, confidence double"


class Adapter(Protocol):
    """Each capability is a method of its name that gives a DataFrame; one that is left out is not available."""

    kind: str


def probe(adapter: Adapter, spark: SparkSession) -> DataFrame:
    """capability, available, message: each is tried for its first row."""
    rows = []
    for c in CAPABILITIES:
        method = getattr(adapter, c, None)
        if method is None:
            rows.append((c, False, "not supported"))
            continue
        try:
            method().limit(1).collect()
            rows.append((c, True, ""))
        except Exception as e:  # noqa: BLE001  whatever the system answers is the finding
            rows.append((c, False, str(e).splitlines()[0][:200]))
    return spark.createDataFrame(rows, "capability string, available boolean, message string")


@dataclass(frozen=True)
class Spec:
    """A kind of source: how to build its adapter from a configuration, and which fields of that are secrets."""

    kind: str
    build: Callable[[SparkSession, Mapping[str, str]], Adapter]
    required: tuple[str, ...] = ()
    secrets: tuple[str, ...] = ()


@dataclass
class Registry:
    specs: dict[str, Spec] = field(default_factory=dict)

    def register(self, spec: Spec) -> None:
        if spec.kind in self.specs:
            raise ValueError(f"{spec.kind} is registered")
        self.specs[spec.kind] = spec

    def build(self, spark: SparkSession, kind: str, config: Mapping[str, str]) -> Adapter:
        spec = self.specs.get(kind)
        if spec is None:
            raise ValueError(f"no source of kind {kind}; known: {', '.join(sorted(self.specs))}")
        if missing := [k for k in spec.required if not config.get(k)]:
            raise ValueError(f"{kind} needs {', '.join(missing)}")
        return spec.build(spark, config)

    def shown(self, kind: str, config: Mapping[str, str]) -> dict[str, str]:
        """The configuration with secrets masked."""
        return {k: "***" if k in self.specs[kind].secrets else v for k, v in config.items()}


class Retryable(Exception):
    """A failure that may pass."""


def retried[T](call: Callable[[], T], tries: int = 3, wait: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> T:
    """The call's result; a Retryable failure is tried again after waits that double."""
    for nth in range(tries):
        try:
            return call()
        except Retryable:
            if nth + 1 == tries:
                raise
            sleep(wait * 2**nth)
    raise AssertionError


READS = ("select",)


def execute(spark: SparkSession, sql: str, most: int) -> DataFrame:
    """A reading statement's first `most` rows, each with `truncated`: whether there were more (one row more is asked for). Anything else is refused."""
    if parser.inspect(sql).kind not in READS:
        raise ValueError("only reading statements are run")
    rows = spark.sql(sql).limit(most + 1)
    cut = rows.agg((F.count("*") > most).alias("truncated"))
    return rows.limit(most).crossJoin(F.broadcast(cut))  # one row


class SparkExecutor:
    """Runs statements for the checks that compare results."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def run(self, sql: str) -> DataFrame:
        return self.spark.sql(sql)
