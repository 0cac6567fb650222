import json

from pyspark.sql import functions as F

from folioforge import schemas
from folioforge.sources import files as S
from folioforge.streaming import logs as L


def test_bundles(spark, tmp_path):
    for doc, name, rows in (("d1", "text", [{"id": "a", "content": "old"}]), ("d1", "text_clean", [{"id": "a", "content": "new"}]), ("d2", "text", [{"id": "b", "doc_id": "own", "content": "x"}]), ("d1", "metadata", {"doc_id": "d1"})):
        (tmp_path / doc).mkdir(exist_ok=True)
        (tmp_path / doc / f"{name}.json").write_text(json.dumps(rows))
    got = {(r.doc_id, r.content) for r in S.read_bundles(spark, str(tmp_path), "text").collect()}
    assert got == {("d1", "new"), ("own", "x")}
    assert S.read_bundles(spark, str(tmp_path), "image").count() == 0
    assert {(r.doc_id, r.name) for r in S.file_listing(spark, str(tmp_path)).collect()} >= {("d1", "metadata.json"), ("d2", "text.json")}


def test_logs_and_store(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text('{"ts": "2024-01-01T10:00:00Z", "endpoint": "Ask", "cost_usd": 1.5}\n\n{"broken\n{"ts": "2024-01-01T11:00:00Z", "endpoint": "ask"}\n')
    assert S.read_jsonl(spark, str(tmp_path / "log"), schemas.COST).where("ts is not null").count() == 2
    q = L.daily_costs(L.log_stream(spark, str(tmp_path / "log"), schemas.COST).where("ts is not null")).writeStream.outputMode("complete").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.endpoint, r.calls, r.cost) for r in spark.sql("select * from daily").collect()] == [("ask", 2, 1.5)]
    S.append_log(spark.createDataFrame([("e", "2024-01-01 00:00:00"), ("f", "2024-01-03 00:00:00")], "endpoint string, ts string").withColumn("ts", F.to_timestamp("ts")), str(tmp_path / "days"))
    assert S.read_log_days(spark, str(tmp_path / "days"), "endpoint string, ts timestamp", "2024-01-02", "2024-01-04").select("endpoint").collect()[0][0] == "f"
    sink = L.upsert_sink(str(tmp_path / "store"))
    batch = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    for _ in range(2):
        sink(batch, 0)
    sink(spark.createDataFrame([("b", 9)], "id string, v int"), 1)
    assert sorted(map(tuple, S.read_store(spark, str(tmp_path / "store")).collect())) == [("a", 1), ("b", 9)]


def test_page_ranges(spark):
    got = [r.x for r in spark.createDataFrame([("all",), ("2-9",), ("1, 3",)], "s string").select(S.page_range(F.col("s"), F.lit(4)).alias("x")).collect()]
    assert got == [[1, 2, 3, 4], [2, 3, 4], [1, 3]]


def test_sessions_and_first_seen(spark, tmp_path):
    """Sessions end after their gap; a chunk seen before is dropped; daily costs in update mode."""
    (tmp_path / "in").mkdir()
    lines = [("2024-01-01T10:00:00Z", "u", 1.0), ("2024-01-01T10:10:00Z", "u", 2.0), ("2024-01-01T12:00:00Z", "u", 4.0), ("2024-01-09T12:00:00Z", None, 8.0)]
    (tmp_path / "in" / "a.json").write_text("".join(json.dumps({"ts": t, "user_id": u, "cost_usd": c, "endpoint": "ask", "id": u or "z"}) + "\n" for t, u, c in [*lines, lines[-1]]))
    log = L.log_stream(spark, str(tmp_path / "in"), schemas.COST + ", id string", files_per_trigger=1)

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        return spark.sql(f"select * from {name}").collect()

    assert sorted((r.user_id, r.calls, r.cost) for r in run(L.sessions(log), "append", "ended")) == [("u", 1, 4.0), ("u", 2, 3.0)]
    assert sorted((str(r.day), r.calls, r.cost) for r in run(L.daily_costs(log), "update", "daily_updates")) == [("2024-01-01", 3, 7.0), ("2024-01-09", 2, 16.0)]
    assert sorted(r.id for r in run(L.first_seen(log.select("ts", "id")), "append", "firsts")) == ["u", "z"]


def test_sinks_and_rebuilds(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    for k in range(4):
        S.upsert_parquet(spark, str(tmp_path / "s"), spark.createDataFrame([("a", k), ("a", k)], "id string, v int"))
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["v3", "v4"]
    assert [tuple(r) for r in S.read_store(spark, str(tmp_path / "s")).collect()] == [("a", 3)]
    S.rebuild_parquet(str(tmp_path / "s"), rows)
    assert sorted(map(tuple, S.read_store(spark, str(tmp_path / "s")).collect())) == [("a", 1), ("b", 2)]
    S.write_bundle({"text": rows}, str(tmp_path / "b"))
    assert S.read_json_if_exists(spark, str(tmp_path / "b" / "none"), "id string").count() == 0 and S.read_jsonl(spark, str(tmp_path / "b" / "text"), "id string, v int").count() == 2
    S.write_markdown(spark.createDataFrame([("d", 2, "two"), ("d", 1, "one")], "doc_id string, page int, markdown string"), str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["one", "two"]
    log = spark.createDataFrame([(k,) for k in (3, 1, 2)], "ts int")
    assert [r.ts for r in S.tail(log, 2).collect()] == [2, 3]
