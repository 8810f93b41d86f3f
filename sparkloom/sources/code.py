"""Repositories of code as a source: which tables SQL and Python files read and write, and what warehouse objects these are."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sqltext import _inspected

_REF = re.compile(r"\{\{\s*ref\(\s*['\"]([\w.]+)['\"](?:\s*,\s*['\"]([\w.]+)['\"])?\s*\)\s*\}\}")
_SOURCE = re.compile(r"\{\{\s*source\(\s*['\"]([\w.]+)['\"]\s*,\s*['\"]([\w.]+)['\"]\s*\)\s*\}\}")
_STATEMENT = re.compile(r"(?is)^\s*(?:with|select|insert|create|merge|update|delete)\b")
REFS = "array<struct<table:string,how:string,direction:string,confidence:double>>"


def sql_refs(text: str) -> list[tuple[str, str, str, float]]:
    """Tables of a SQL file: template references surely, tables read and written by its statements nearly so, names a pattern finds less."""
    out = {((m[2] or m[1]).lower(), "ref", "read", 1.0) for m in _REF.finditer(text)} | {(f"{m[1]}.{m[2]}".lower(), "source", "read", 1.0) for m in _SOURCE.finditer(text)}
    plain = re.sub(r"\{\{.*?\}\}", "template__", re.sub(r"(?s)\{%.*?%\}", " ", text))
    for statement in plain.split(";"):
        kind, target, tables, sources = _inspected(statement)
        how, sure = ("statement", 0.85) if kind != "other" else ("pattern", 0.8)
        out |= {(t, how, "read", sure) for t in {*tables, *sources} if "template__" not in t}
        if target and "template__" not in target:
            out.add((target, how, "write", sure))
    return sorted(out)


def python_refs(text: str) -> list[tuple[str, str, str, float]]:
    """Tables in the SQL strings of a Python file, and the modules it imports; text that is no Python gives none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    out = set()
    for n in ast.walk(tree):
        if isinstance(n, ast.Constant) and isinstance(n.value, str) and _STATEMENT.match(n.value):
            out |= {(t, "string", d, 0.8) for t, _, d, _ in sql_refs(n.value)}
        elif isinstance(n, ast.Import):
            out |= {(a.name, "import", "import", 1.0) for a in n.names}
        elif isinstance(n, ast.ImportFrom) and n.module:
            out.add((n.module, "import", "import", 1.0))
    return sorted(out)


def _refs(path: pd.Series, text: pd.Series) -> pd.Series:
    of = lambda p, t: python_refs(t) if p.endswith(".py") else sql_refs(t)
    return pd.Series([[dict(zip(("table", "how", "direction", "confidence"), r, strict=True)) for r in of(p or "", t or "")] for p, t in zip(path, text, strict=True)])


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, text of the SQL and Python files below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return rows.where(F.col("path").rlike(r"\.(sql|py)$")).select("path", F.decode("content", "UTF-8").alias("text"))


def references(code: DataFrame) -> DataFrame:
    """path, table, how, direction, confidence for files (path, text)."""
    return code.select("path", F.explode(F.pandas_udf(_refs, REFS)("path", "text")).alias("r")).select("path", "r.*")


def stitched(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """References (path, table, direction) joined to warehouse objects (id, name): by the whole name 0.9, else by the last two parts 0.7; the better counts."""
    key = lambda c: F.lower(F.col(c))
    tail = lambda c: F.array_join(F.slice(F.split(key(c), r"\."), F.greatest(F.size(F.split(key(c), r"\.")) - 1, F.lit(1)), 2), ".")
    r = refs.where("direction != 'import'").select("path", "table", "direction", key("table").alias("k"), tail("table").alias("t")).distinct()
    o = objects.select("id", key("name").alias("ok"), tail("name").alias("ot"))
    whole = r.join(o, r["k"] == o["ok"]).select("path", "table", "direction", "id", F.lit(0.9).alias("confidence"))
    part = r.join(o, (r["t"] == o["ot"]) & r["t"].contains(".")).select("path", "table", "direction", "id", F.lit(0.7).alias("confidence"))
    best = Window.partitionBy("path", "table", "direction").orderBy(F.desc("confidence"), "id")
    return whole.unionByName(part).withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")
