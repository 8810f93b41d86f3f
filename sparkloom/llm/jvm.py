"""Java sources of this package as functions of columns: compiled on the driver by Spark's own compiler (Janino), sent to executors as a jar."""

from __future__ import annotations

import os
import tempfile
import zipfile
import zlib
from collections.abc import Callable
from importlib.resources import files

from pyspark.sql import SparkSession
from pyspark.sql.classic.column import Column, _to_java_column, _to_seq

_LOADERS: dict[tuple[str, str], tuple] = {}


def _loader(spark: SparkSession, name: str):
    """The class loader of a compiled source; its jar is added to the application once."""
    sc = spark.sparkContext
    key = sc.applicationId, name
    if key not in _LOADERS:
        source = files(__package__).joinpath(f"{name}.java").read_text(encoding="utf-8")
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(sc._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(source)
        folder = tempfile.TemporaryDirectory(prefix="loom-")  # goes when the driver exits
        jar = os.path.join(folder.name, f"{name}-{zlib.crc32(source.encode())}.jar")
        with zipfile.ZipFile(jar, "w") as z:
            for n, code in compiler.getBytecodes().items():
                z.writestr(n.replace(".", "/") + ".class", bytes(code))
        sc._jsc.addJar(jar)
        _LOADERS[key] = compiler.getClassLoader(), folder
    return _LOADERS[key][0]


def function(spark: SparkSession, name: str, inner: str, returns: str) -> Callable[..., Column]:
    """The class `inner` of the source `name` as a function of columns; its method `function` makes it one of Spark's."""
    sc = spark.sparkContext
    made = _loader(spark, name).loadClass(f"sparkloom.llm.{name}${inner}").newInstance().function(sc._jvm.org.apache.spark.sql.types.DataType.fromDDL(returns))
    return lambda *columns: Column(made.apply(_to_seq(sc, columns, _to_java_column)))
