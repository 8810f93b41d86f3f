"""SQLite files of the driver's, read by executors in other processes with folders of their own."""

import os
import subprocess
import sys

CODE = """
import sqlite3, tempfile
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "600m").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
import __spark_entry__ as entry
from sparkloom.sources.sqlite import SqliteAdapter
for name in ("S25_sqlite", "X02_adapter_protocol"):
    print("rows", entry.queries()[name](spark, "/root/testdata/sf0.001").count())
path = tempfile.mkdtemp() + "/w.db"
con = sqlite3.connect(path, isolation_level=None)
con.execute("PRAGMA journal_mode = WAL")
con.execute("CREATE TABLE t (k INTEGER)")
adapter = SqliteAdapter(spark, path)
for k in (1, 2):  # in the log, not yet in the file
    con.execute("INSERT INTO t VALUES (?)", (k,))
    print("log", [r.k for r in adapter.table("t").orderBy("k").collect()])
spark.stop()
"""


def test_executors_apart(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))} | {"PYTHONPATH": repo, "PYSPARK_PYTHON": sys.executable, "TMPDIR": "/proc/self/cwd/own", "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_DIRS": str(tmp_path)}
    import pyspark

    home = tmp_path / "home"  # executors keep their logs under work
    home.mkdir()
    for f in os.listdir(os.path.dirname(pyspark.__file__)):
        if f != "work":
            (home / f).symlink_to(os.path.join(os.path.dirname(pyspark.__file__), f))
    (tmp_path / "own").mkdir()
    got = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env | {"SPARK_HOME": str(home), "SPARK_LOCAL_IP": "127.0.0.1"}, capture_output=True, text=True, timeout=150)
    assert [x for x in got.stdout.splitlines() if x.startswith(("rows", "log"))] == ["rows 25", "rows 25", "log [1]", "log [1, 2]"], got.stderr[-3000:]
