import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from runqc.operators import ranking, timeline
from runqc.streaming import monitor

SCHEMA = "run string, ts timestamp, length bigint, qscore double, passes boolean"


@pytest.fixture
def reads(spark, tmp_path):
    random.seed(2)
    start = datetime.datetime(2024, 1, 1)
    data = [(f"run{i % 2}", start + datetime.timedelta(seconds=random.randint(0, 5000)), random.randint(100, 900),
             float(random.randint(3, 20)), i % 3 > 0) for i in range(600)]
    df = spark.createDataFrame(data, SCHEMA)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    return df, monitor.read_stream(spark, str(tmp_path / "in"), SCHEMA, maxFilesPerTrigger="1"), tmp_path


def drain(stream, sink, path, mode="complete"):
    monitor.start(stream, sink, str(path / "cp"), mode, refresh=None).awaitTermination()


def test_stream_equals_batch(spark, reads):
    batch, stream, path = reads
    drain(monitor.length_state(stream, ["run"]), lambda df, _: df.write.mode("overwrite").parquet(str(path / "out")), path)
    got = {r.run: r for r in monitor.statistics_from_state(spark.read.parquet(str(path / "out")), ["run"]).collect()}
    n50 = {r.run: r.n50 for r in ranking.nx(batch, ["run"]).collect()}
    for r in batch.groupBy("run").agg(F.count("*").alias("n"), F.sum("length").alias("b"), F.count_if("passes").alias("p"),
                                      F.min("length").alias("lo"), F.max("length").alias("hi")).collect():
        g = got[r.run]
        assert (g.total_reads, g.total_bases, g.passed_reads, g.min_length, g.max_length, g.n50) == (r.n, r.b, r.p, r.lo, r.hi, n50[r.run])


def test_series_equals_batch(spark, reads):
    batch, stream, path = reads
    drain(monitor.bucket_series(stream, ["run"]), lambda df, _: df.write.mode("overwrite").parquet(str(path / "out")), path)
    got = monitor.cumulative(spark.read.parquet(str(path / "out")), ["run"])
    start = F.lit("2024-01-01").cast("timestamp")
    seconds = batch.withColumn("start_time", F.unix_timestamp("ts") - F.unix_timestamp(start))
    want = timeline.monitor_series(seconds, ["run"])
    joined = got.withColumn("bucket", F.unix_timestamp("bucket") - F.unix_timestamp(start)).alias("g").join(want.alias("w"), ["run", "bucket"])
    assert joined.count() == want.count() == got.count()
    same = (F.col("g.cumulative_reads") == F.col("w.cumulative_reads")) & (F.abs(F.col("g.mean_qscore") - F.col("w.mean_qscore")) < 1e-9)
    assert joined.where(~same).count() == 0


def test_running_series_in_append_mode(spark, tmp_path):
    """Buckets come once and in order; a row of a finished bucket is dropped and counted; finished state goes."""
    at = lambda minutes: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)
    batches = [[("a", at(1), 100), ("a", at(2), 50), ("b", at(7), 10)], [("a", at(8), 30), ("a", at(40), 5)], [("b", at(41), 20)], [("a", at(3), 999), ("b", at(90), 1)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame([(*r, 10.0, True) for r in rows], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
        time.sleep(0.05)
    stream = monitor.read_stream(spark, str(tmp_path / "in" / "*"), SCHEMA, maxFilesPerTrigger="1")
    seen = []
    query = monitor.start(
        monitor.running_series(stream, ["run"], late="10 minutes"), lambda df, _: seen.extend(tuple(r)[:6] for r in df.orderBy("bucket").collect()), str(tmp_path / "cp"), "append", refresh=None)
    query.awaitTermination()
    want = [("a", at(0), 2, 150, 2, 150), ("b", at(5), 1, 10, 1, 10), ("a", at(5), 1, 30, 3, 180), ("a", at(40), 1, 5, 4, 185), ("b", at(40), 1, 20, 2, 30)]
    assert sorted(seen) == sorted(want)
    assert [r for r in seen if r[0] == "a"] == [r for r in want if r[0] == "a"]
    assert monitor.late_rows(query) == 1
    windows = [p["stateOperators"][-1]["numRowsTotal"] for p in query.recentProgress]
    assert max(windows) > windows[-1]


def test_alerts_per_batch(spark, reads):
    _, stream, path = reads
    drain(monitor.length_state(stream, ["run"]), monitor.alert_sink(["run"], str(path / "alerts")), path)
    got = spark.read.option("basePath", str(path / "alerts")).parquet(str(path / "alerts"))
    assert got.where("metric = 'n50'").select("run").distinct().count() == 2
    assert got.select("batch").distinct().count() == 3


def test_activity_per_run(spark, reads):
    """Each run is active while rows arrive and turns silent when its timer expires."""
    _, stream, path = reads
    seen = []
    query = monitor.start(
        monitor.activity(stream, "run", limit=1), lambda df, _: seen.extend(tuple(r) for r in df.collect()),
        str(path / "cp"), "update", refresh="1 second",
    )
    try:
        deadline = time.time() + 45
        silent = {("run0", 300, False), ("run1", 300, False)}
        while not silent <= set(seen) and query.isActive and time.time() < deadline:
            time.sleep(0.5)
    finally:
        query.stop()
    assert silent <= set(seen)
    assert {run for run, _, active in seen if active} == {"run0", "run1"}


def test_batch_activity_and_pores(spark, rows):
    t = datetime.datetime(2024, 1, 1, 12)
    df = rows([("a", t), ("b", t - datetime.timedelta(seconds=301))], "run string, ts timestamp")
    got = timeline.run_activity(df, ["run"], "ts", F.lit(t))
    assert {r.run: r.is_active for r in got.collect()} == {"a": True, "b": False}
    duty = rows([("a", 1, 10, 5), ("a", 2, 256, 128), ("b", 1, 0, 0)], "run string, time int, active_pores int, sequencing int")
    assert {r.run: (r.active_pores_pct, r.occupancy) for r in timeline.pore_activity(duty, ["run"]).collect()} == {"a": (50.0, 0.5), "b": (0.0, 0.0)}
