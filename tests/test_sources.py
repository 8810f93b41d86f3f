"""Sources, the store's files and streams, on small files of their own."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import search, store, traffic
from sparkloom.sources import base, postgres
from sparkloom.sources.registry import REGISTRY
from sparkloom.streaming import events as streams


def test_sqlite_adapter(spark, tmp_path):
    path = f"{tmp_path}/a.db"
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE p (id INTEGER PRIMARY KEY, name TEXT, price REAL, blob BLOB)")
        con.execute("CREATE TABLE c (pid INT REFERENCES p(id), at TEXT NOT NULL)")
        con.execute("CREATE VIEW v AS SELECT name FROM p")
        con.executemany("INSERT INTO p VALUES (?, ?, ?, ?)", [(1, "Widget", 9.99, b"x"), (2, None, None, None), (3, "Widget", 4, "text")])
    a = REGISTRY.build(spark, "sqlite", {"path": path})
    assert {(r.object, r.kind, r.row_count) for r in a.schema().collect()} == {("p", "table", 3), ("c", "table", 0), ("v", "view", 3)}
    assert [tuple(r) for r in a.lineage().collect()] == [("c", "pid", "p", "id")]
    assert sorted(map(tuple, a.table("p").select("id", "name", "price").collect())) == [(1, "Widget", 9.99), (2, None, None), (3, "Widget", 4.0)]
    got = {(r.object, r.column_name): (r.n_distinct, r.n_null) for r in a.profiles().collect()}
    assert got["p", "name"] == (1, 1) and got["p", "id"] == (3, 0) and got["c", "at"] == (0, 0)
    assert a.definitions().count() == 3
    caps = {r.capability: r.available for r in base.probe(a, spark).collect()}
    assert caps["schema"] and caps["lineage"] and not caps["traffic"]


def test_registry_and_execute(spark):
    with pytest.raises(ValueError):
        REGISTRY.build(spark, "sqlite", {})
    with pytest.raises(ValueError):
        REGISTRY.build(spark, "fax", {})
    with pytest.raises(ValueError):
        base.execute(spark, "DROP TABLE t", 3)
    assert [tuple(r) for r in base.execute(spark, "SELECT id FROM range(5)", 5).collect()][0][1] is False
    assert base.execute(spark, "SELECT id FROM range(6)", 5).first()[1] is True
    with pytest.raises(base.Retryable):
        base.retried(lambda: (_ for _ in ()).throw(base.Retryable()), 2, 0, lambda s: None)


LINE = "2024-01-01 00:00:0{n} UTC [{pid}] db=d,user=u,app=,client=h {text}"


def test_logs_cursor_and_pairing(spark, tmp_path):
    lines = [LINE.format(n=0, pid=1, text="ERROR:  bad"), LINE.format(n=1, pid=2, text="STATEMENT:  select 2"), "noise", LINE.format(n=2, pid=1, text="LOG:  duration: 3 ms  statement: select 9"), LINE.format(n=3, pid=1, text="STATEMENT:  select 1"), LINE.format(n=4, pid=1, text="STATEMENT:  select 1")]
    (tmp_path / "a.log").write_text("\n".join(lines))
    read = postgres.read_logs(spark, f"file://{tmp_path}")
    got = sorted((r.sql, r.query_type, r.error) for r in postgres.log_events(read).collect())
    assert got == [("select 1", "error_statement", "bad"), ("select 1", "statement", None), ("select 2", "statement", None), ("select 9", "duration", None)]
    cursor = postgres.log_cursor(read)
    seen = spark.createDataFrame(cursor.collect(), cursor.schema)
    assert postgres.lines_after(read, seen).count() == 0
    (tmp_path / "a.log").write_text("\n".join([*lines, "more"]))
    assert [r.value for r in postgres.lines_after(postgres.read_logs(spark, f"file://{tmp_path}"), seen).collect()] == ["more"]
    (tmp_path / "a.log").write_text("new")  # rotated: shorter than the cursor
    assert [r.value for r in postgres.lines_after(postgres.read_logs(spark, f"file://{tmp_path}"), seen).collect()] == ["new"]


def test_errors_are_paired_across_batches(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()

    def run():
        q = streams.paired_errors(streams.log_stream(spark, f"file://{src}")).writeStream.format("parquet").option("path", f"file://{out}").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()

    (src / "1").write_text(LINE.format(n=0, pid=7, text="ERROR:  late") + "\n" + LINE.format(n=1, pid=8, text="STATEMENT:  select 8"))
    run()
    (src / "2").write_text(LINE.format(n=2, pid=7, text="STATEMENT:  select 7") + "\n" + LINE.format(n=3, pid=7, text="STATEMENT:  select 77"))
    run()
    got = sorted(((r.sql, r.query_type, r.error) for r in spark.read.parquet(f"file://{out}").collect()), key=str)
    assert got[0] == ("select 7", "error_statement", "late") and {g[0] for g in got} == {"select 7", "select 77", "select 8"} and sum(g[2] is not None for g in got) == 1


def test_store_versions(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}")
    assert s.read("t", "a int").count() == 0
    for n in range(5):
        s.write("t", spark.range(n + 1).select(F.col("id").cast("int").alias("a")), keep=2)
    assert len(s.versions("t")) == 2 and s.read("t", "a int, b string").count() == 5
    (tmp_path / "t" / "000000099-broken").mkdir()  # a write that never finished
    assert s.read("t", "a int").count() == 5


def test_asset_merge_keeps_tags_metadata_and_kind(spark):
    kind = "id string, source string, kind string, name string, description string, tags array<string>, metadata map<string,string>, seen int, placeholder boolean"
    old = spark.createDataFrame([("a", "s", "table", "A", "text", ["x", "y"], {"k": "1", "l": "1"}, 1, False)], kind)
    new = spark.createDataFrame([("a", "s", "external", "", None, ["y", "z"], {"k": "2"}, 2, True), ("b", "s", "external", None, None, None, None, 3, True)], kind)
    got = {r.id: r for r in store.merged_assets(old, new).collect()}
    a = got["a"]
    assert (a.kind, a.name, a.description, a.tags, a.metadata, a.first_seen, a.last_seen) == ("table", "A", "text", ["x", "y", "z"], {"l": "1", "k": "2"}, 1, 2)
    assert (got["b"].kind, got["b"].name, got["b"].tags, got["b"].metadata) == ("external", "b", [], {})


def test_full_text_with_stems(spark):
    docs = spark.createDataFrame([(1, "Revenue of paying customers"), (2, "customer payments, revenues"), (3, "nothing here"), (4, None)], "id int, text string")
    found = search.bm25(search.index(docs, "id", F.col("text")), search.parsed_match('"revenue" customer'))
    assert {r.key for r in found.collect()} == {1, 2}
    assert search.bm25(search.index(docs, "id", F.col("text")), search.parsed_match("nothing OR payment")).count() == 2
    assert docs.select(search.snippet(F.col("text"), "paying")).first()[0] == "Revenue of [paying] customers"


def test_pull_and_cursor(spark):
    e = spark.createDataFrame([(i, f"2024-01-0{i + 1} 00:00:00") for i in range(5)], "event_id int, captured_at string").withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    assert traffic.next_cursor(e, "2024-01-09 00:00:00") == "2024-01-09 00:00:00" and traffic.next_cursor(e, None).startswith("2024-01-05")
    assert [r.event_id for r in traffic.pulled(e, None, "2024-01-03 00:00:00", 2).collect()] == [4, 3]


def test_webhook_posts_signed_rows_and_retries(spark):
    import hashlib
    import hmac
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    got = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            got.append((body, self.headers["X-Signature"]))
            self.send_response(500 if len(got) == 1 else 200)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    streams.webhook(f"http://127.0.0.1:{server.server_port}/", "key", wait=0)(spark.createDataFrame([(1,), (2,)], "a int").coalesce(1), 0)
    server.shutdown()
    assert [b for b, _ in got] == [b'{"a":1}', b'{"a":1}', b'{"a":2}']
    assert got[0][1] == hmac.new(b"key", got[0][0], hashlib.sha256).hexdigest()
