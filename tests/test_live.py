"""Live streams: ordered state with timers, two streams side by side, the monitor."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from beatframe.streaming import frames as streaming

T0 = datetime(2024, 1, 1)
FRAME = "session string, frame_no long, ts timestamp, v array<double>"
VALUE = "session string, frame_no long, ts timestamp, value double"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


class Feed:
    """A folder that a stream reads a file at a time."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, str(folder), schema, 0
        folder.mkdir()

    def put(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.folder}/{self.n:03}")

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/*")


def run(df, tmp_path, name=None):
    """Everything that has been put so far; goes on from where it stopped."""
    w = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
    q = (w.queryName(name) if name else w).start()
    q.awaitTermination(180)
    return df.sparkSession.read.parquet(str(tmp_path / "out"))


def state(spark, tmp_path, name):
    return spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("operatorId", 0).option("stateVarName", name).load().collect()


def test_late_repeated_and_ended_sessions(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", FRAME)
    frame = lambda s, n: (s, n, at(n), [float(n)])
    job = lambda: streaming.buffers(feed.stream().withWatermark("ts", "10 seconds"), size=4)
    feed.put([frame("a", n) for n in (0, 2, 1, 1)])
    assert run(job(), tmp_path).count() == 0
    assert len(state(spark, tmp_path, "waiting")) == 3  # a frame that came twice waits once
    feed.put([frame("a", n) for n in (5, 4, 2)])
    feed.put([frame("a", 3), frame("b", 8)])  # late, but inside the watermark
    run(job(), tmp_path)
    feed.put([frame("b", n) for n in range(16, 20)])
    feed.put([frame("b", n) for n in range(20, 22)])
    out = run(job(), tmp_path)
    assert [(r.session, r.buffer, list(r.numbers)) for r in out.collect()] == [("a", 0, [0, 1, 2, 3])]
    left = state(spark, tmp_path, "waiting")
    assert sorted(r.key.session for r in left) == ["b"] * 6 and len(state(spark, tmp_path, "held")) == 2
    feed.put([frame("c", 200)])  # long after: a and b have ended
    feed.put([frame("c", 201)])
    feed.put([frame("c", 202)])
    out = run(job(), tmp_path)
    got = {(r.session, r.buffer): list(r.numbers) for r in out.collect()}
    assert got == {("a", 0): [0, 1, 2, 3], ("a", 1): [4, 5], ("b", 0): [8, 16, 17, 18], ("b", 1): [19, 20, 21]}
    assert {r.key.session for r in state(spark, tmp_path, "waiting")} == {"c"} and state(spark, tmp_path, "held") == [] and {r.key.session for r in state(spark, tmp_path, "ends")} == {"c"}


def test_two_streams_with_one_late_and_one_missing(spark, tmp_path):
    a, b = Feed(spark, tmp_path / "a", VALUE), Feed(spark, tmp_path / "b", VALUE)
    row = lambda n, x, late=0.0: ("s", n, at(n + late), float(x))
    a.put([row(n, n) for n in range(0, 10)])
    b.put([row(n, 10 * n, 2.0) for n in range(0, 6) if n != 3])
    a.put([row(n, n) for n in range(10, 15) if n != 12])
    b.put([row(n, 10 * n, 3.5) for n in range(6, 15)])  # late
    for n in (100, 101, 102, 103):
        a.put([row(n, n)])
        b.put([row(n, 10 * n)])
    out = run(streaming.live_pairs(a.stream(), b.stream()), tmp_path).filter("frame_no < 100")
    got = {r.frame_no: (r.value_a, r.value_b, r.missing) for r in out.collect()}
    want = {n: (float(n), 10.0 * n, None) for n in range(15) if n not in (3, 12)} | {3: (3.0, None, "b"), 12: (None, 120.0, "a")}
    assert got == want
    table = lambda f: spark.read.schema(VALUE).parquet(f"{f.folder}/*")
    batch = streaming.live_pairs(table(a), table(b)).filter("frame_no < 100")
    assert {r.frame_no: (r.value_a, r.value_b, r.missing) for r in batch.collect()} == want


def test_pairs_too_far_apart_are_both_missing(spark):
    a = spark.createDataFrame([("s", 1, at(0), 1.0), ("s", 2, at(0), 2.0), (None, 3, at(0), 3.0)], VALUE)
    b = spark.createDataFrame([("s", 1, at(9), 10.0), ("s", 2, at(4), 20.0), ("s", 2, at(-4), 21.0), (None, 3, at(0), 30.0)], VALUE)
    got = sorted((r.frame_no, r.missing or "", r.value_a or 0, r.value_b or 0) for r in streaming.live_pairs(a, b).collect())
    assert got == [(1, "a", 0, 10.0), (1, "b", 1.0, 0), (2, "", 2.0, 20.0), (2, "", 2.0, 21.0), (3, "a", 0, 30.0), (3, "b", 3.0, 0)]


def test_monitor_of_a_live_stream(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", FRAME)
    sizes = [50, 20, 30, 50]
    n = 0
    for size in sizes:
        feed.put([("s", n + i, at((n + i) / 50), [1.0, 2.0]) for i in range(size)])
        n += size
    monitor = streaming.LiveMonitor()
    spark.streams.addListener(monitor)
    try:
        out = run(streaming.watched(feed.stream()), tmp_path, "monitored")
        until = time.time() + 30
        while len(monitor.rows) < len(sizes) and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(monitor)
    assert out.count() == n
    t = monitor.timings(spark)
    rows = t.orderBy("batch").collect()
    assert [r.frames for r in rows] == sizes and [r.batch for r in rows] == [0, 1, 2, 3] and all(r.compute_s > 0 for r in rows)
    assert rows[0].first_ts == at(0) and rows[-1].last_ts == at((n - 1) / 50)
    live = streaming.buffer_monitor(t).first()
    assert live.session == "monitored" and live.first_output_s == pytest.approx(sum(r.frames / 50 + r.compute_s for r in rows) / 4) and live.worst_s == max(r.compute_s for r in rows)
    assert live.keeps_up == all(r.compute_s <= r.frames / 50 for r in rows)
    # the same rows from a table of the frames: batches of the same sizes
    table = spark.read.schema(FRAME).parquet(f"{feed.folder}/*").withColumn("batch", F.expr("CASE WHEN frame_no < 50 THEN 0 WHEN frame_no < 70 THEN 1 WHEN frame_no < 100 THEN 2 ELSE 3 END"))
    batch = table.groupBy("batch").agg(F.count("*").alias("frames"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).orderBy("batch").collect()
    assert [(r.batch, r.frames, r.first_ts, r.last_ts) for r in batch] == [(r.batch, r.frames, r.first_ts, r.last_ts) for r in rows]
