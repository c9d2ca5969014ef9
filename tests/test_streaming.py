import threading
from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from keelson.streaming import idle

T0 = datetime(2024, 1, 1)


def events(rows):
    return [(p, f, T0 + timedelta(seconds=s), op) for p, f, s, op in rows]


ROWS = [("p", "a.env", 0, "write"), ("p", "b.env", 100, "create"), ("q", "a.env", 5, "write"), ("p", "a.env", 50, "write"), ("q", "c.txt", 20, "write"), ("p", "b.env", 400, "delete"), ("q", "z.env", 900, "write")]
SCHEMA = "project string, path string, ts timestamp, op string"


def test_batch(spark):
    df = spark.createDataFrame(events(ROWS), SCHEMA)
    kept = idle.changes(df, ("*.env",), ("z*",))
    assert kept.count() == 4
    got = {(r.project, r.path) for r in idle.idle_batch(df, 300).collect()}
    assert got == {("p", "a.env"), ("q", "a.env"), ("q", "c.txt"), ("p", "b.env")}
    config = spark.createDataFrame([("p", True, None), ("q", False, 60)], "project string, enabled boolean, idle_seconds int")
    assert {r.idle_seconds for r in idle.configured(df, config).collect()} == {300}
    done = spark.createDataFrame([("p", "a.env", "encrypted"), ("q", "a.env", "failed")], "project string, path string, outcome string")
    assert idle.survivors(df.select("project", "path").distinct(), done).count() == 4
    assert idle.fan_in(df, df).count() == 2 * len(ROWS)


def test_bursts(spark):
    rows = [(f, T0 + timedelta(milliseconds=m)) for f, m in (("a", 0), ("a", 50), ("a", 149), ("a", 400), ("b", 10))]
    got = sorted((r.path, r.n) for r in idle.bursts(spark.createDataFrame(rows, "path string, ts timestamp")).collect())
    assert got == [("a", 1), ("a", 3), ("b", 1)]


def test_stream_like_its_batch_twin(spark, tmp_path):
    spark.createDataFrame(events(ROWS), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    spark.createDataFrame(events([("r", "n.env", 2000, "write")]), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    run = idle.idle_stream(stream, 300).writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r.project, r.path, r["last"]) for r in spark.table("idle").collect()}
    batch = spark.read.schema(SCHEMA).parquet(str(tmp_path / "in" / "*"))
    want = {(r.project, r.path, r["last"]) for r in idle.idle_batch(batch, 300, F.lit(T0 + timedelta(seconds=2000))).collect()}
    assert got == want and len(got) == 5


def test_registry_is_read_anew_for_each_batch(spark, tmp_path):
    for k, row in enumerate(ROWS[:4]):
        spark.createDataFrame(events([row]), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    enabled = [{"p": 60}, {}, {"p": 60, "q": None}, {"q": 5}]
    seen = []

    def registry():
        now = enabled[len(seen)]
        return spark.createDataFrame([(p, True, s) for p, s in now.items()] + [("x", False, 1)], "project string, enabled boolean, idle_seconds int")

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    run = idle.follow(stream, registry, lambda df: seen.append(sorted((r.project, r.path, r.idle_seconds) for r in df.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert run.exception() is None and len(seen) == 4
    files = [spark.read.schema(SCHEMA).parquet(str(tmp_path / "in" / str(k))).first() for k in range(4)]
    want = [[(r.project, r.path, now[r.project] or 300)] if r.project in now else [] for r, now in zip(files, enabled, strict=True)]
    assert sorted(map(str, seen)) == sorted(map(str, want))


def test_rounds_are_skipped_while_one_runs():
    go, done = threading.Event(), []
    rounds = idle.Rounds(lambda n: (go.wait(10), done.append(n)))
    assert rounds(1) and not rounds(2) and not rounds(3) and done == []
    go.set()
    rounds.wait()
    assert done == [1] and rounds(4)
    rounds.wait()
    assert done == [1, 4]
    bad = idle.Rounds(lambda: 1 / 0)
    assert bad()
    with pytest.raises(ZeroDivisionError):
        bad.wait()
    assert bad()


def test_stream_with_late_and_finished_keys(spark, tmp_path):
    def run(batches, delay):
        for k, rows in enumerate(batches):
            spark.createDataFrame(events(rows), SCHEMA).coalesce(1).write.parquet(str(tmp_path / delay / "in" / str(k)))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / delay / "in" / "*"))
        name = f"idle_{len(delay)}_{delay[0]}"
        query = idle.idle_stream(stream, 300, delay).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / delay / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted((r.project, r.path, int((r["last"] - T0).total_seconds())) for r in spark.table(name).collect())

    # an older change of a key doesn't move its last one back, and a key that is done is forgotten
    batches = [[("p", "a", 100, "write"), ("p", "b", 0, "write")], [("p", "a", 50, "write"), ("p", "b", 110, "done")], [("p", "c", 500, "write")], [("p", "c", 1000, "write")]]
    assert run(batches, "100 seconds") == [("p", "a", 100)]
