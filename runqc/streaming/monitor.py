"""Live run monitoring with Structured Streaming.

The stream source is a folder that receives complete files; a running instrument's writer drops
them there. State is a length histogram and five-minute buckets, never the reads themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from runqc.functions import phred
from runqc.functions.common import count_where
from runqc.operators import ranking, timeline

LATE = "24 hours"
REFRESH = "30 seconds"


def read_stream(spark: SparkSession, path: str, schema: StructType | str, form: str = "parquet", **options) -> DataFrame:
    """Only new complete files enter each trigger; the schema is explicit."""
    return spark.readStream.format(form).schema(schema).options(**options).load(path)


def length_state(reads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Running (keys, length) counts with the sums every statistic needs; complete or update mode."""
    return reads.groupBy(*keys, "length").agg(
        F.count("*").alias("n"),
        count_where(F.col("passes")).alias("passed"),
        F.sum(phred.error_prob("qscore")).alias("p_sum"),
    )


def statistics_from_state(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Read statistics out of the state table: batch code over one row per distinct length."""
    hist = state.select(*keys, "length", "n", (F.col("n") * F.col("length")).alias("total"))
    n50 = ranking.running(hist, keys, "length", ["n", "total"], ranking.LENGTH_WIDTH).groupBy(*keys).agg(
        ranking.nx_value("length", 0.5).alias("n50")
    )
    base = state.groupBy(*keys).agg(
        F.sum("n").alias("total_reads"),
        F.sum(F.col("n") * F.col("length")).alias("total_bases"),
        F.sum("passed").alias("passed_reads"),
        (F.sum("n") - F.sum("passed")).alias("failed_reads"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
        phred.to_qscore(F.sum("p_sum") / F.sum("n")).alias("mean_qscore"),
    )
    return base.join(n50, list(keys))


def bucket_series(reads: DataFrame, keys: Sequence[str], ts: str = "ts", late: str = LATE) -> DataFrame:
    """Five-minute tumbling buckets; in append mode each is put out once, when it is ``late`` past, and its state goes.

    Rows of buckets that have been put out are dropped; ``late_rows`` counts them.
    """
    return (
        reads.withWatermark(ts, late)
        .groupBy(*keys, F.window(ts, f"{timeline.BUCKET_SECONDS} seconds").alias("w"))
        .agg(
            F.count("*").alias("n"),
            F.sum("length").alias("bases"),
            F.sum(phred.error_prob("qscore")).alias("p_sum"),
        )
        .select(*keys, F.col("w.start").alias("bucket"), "n", "bases", "p_sum")
    )


def cumulative(buckets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cumulative columns over finished buckets (a batch window: one row per bucket)."""
    from pyspark.sql import Window

    so_far = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return buckets.select(
        *keys, "bucket", "n", "bases",
        F.sum("n").over(so_far).alias("cumulative_reads"),
        F.sum("bases").over(so_far).alias("cumulative_bases"),
        phred.to_qscore(F.col("p_sum") / F.col("n")).alias("mean_qscore"),
    )


class RunningTotals(StatefulProcessor):
    """Carries reads and bases of a key over finished buckets; its state is two numbers."""

    def __init__(self, keys: Sequence[str]):
        self.keys = list(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "n bigint, bases bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, bases = self.totals.get() if self.totals.exists() else (0, 0)
        buckets = pd.concat(list(rows)).sort_values("bucket")
        buckets = buckets.assign(cumulative_reads=buckets["n"].cumsum() + n, cumulative_bases=buckets["bases"].cumsum() + bases)
        self.totals.update((int(buckets["cumulative_reads"].iloc[-1]), int(buckets["cumulative_bases"].iloc[-1])))
        yield buckets[[*self.keys, "bucket", "n", "bases", "cumulative_reads", "cumulative_bases", "mean_qscore"]]

    def close(self) -> None:
        pass


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def running_series(reads: DataFrame, keys: Sequence[str], ts: str = "ts", late: str = LATE) -> DataFrame:
    """The series with cumulative columns as an append-mode stream: every bucket once, when it is finished.

    Buckets finish in order of time, so totals are carried from one to the next. Needs the RocksDB state store, which
    is set for the session.
    """
    reads.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    buckets = bucket_series(reads, keys, ts, late).withColumn("mean_qscore", phred.to_qscore(F.col("p_sum") / F.col("n"))).drop("p_sum")
    types = {f.name: f.dataType.simpleString() for f in buckets.schema}
    schema = ", ".join(f"`{k}` {types[k]}" for k in [*keys, "bucket", "n", "bases"]) + ", cumulative_reads bigint, cumulative_bases bigint, mean_qscore double"
    return buckets.groupBy(*keys).transformWithStateInPandas(RunningTotals(keys), schema, "append", "none")


def late_rows(query: StreamingQuery) -> int:
    """Groups of late rows (of one bucket and key in a batch) that the query has dropped, by its progress reports."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def start(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
    mode: str = "complete", refresh: str | None = REFRESH,
) -> StreamingQuery:
    """Run ``sink`` on every micro-batch; ``refresh=None`` drains what is there and stops."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    writer = writer.trigger(availableNow=True) if refresh is None else writer.trigger(processingTime=refresh)
    return writer.start()


def alert_sink(keys: Sequence[str], path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: current statistics against the thresholds, one folder per batch.

    The folder is named by the batch, so a batch replayed after a failure overwrites itself.
    """

    def sink(state: DataFrame, batch: int) -> None:
        stats = statistics_from_state(state, keys)
        metrics = stats.select(*keys, F.col("mean_qscore").cast("double").alias("mean_qscore"),
                               F.col("n50").cast("double").alias("n50"))
        rows = timeline.alerts(metrics.unpivot(list(keys), ["mean_qscore", "n50"], "metric", "value"))
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return sink


class ActivityTracker(StatefulProcessor):
    """A run turns inactive when nothing arrived for ``limit`` seconds of processing time."""

    def __init__(self, limit: int = 300):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "rows bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.seen.get()[0] if self.seen.exists() else 0
        total = before + sum(len(r) for r in rows)
        self.seen.update((total,))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.limit * 1000)
        yield pd.DataFrame({"run": [key[0]], "rows": [total], "is_active": [True]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        total = self.seen.get()[0] if self.seen.exists() else 0
        yield pd.DataFrame({"run": [key[0]], "rows": [total], "is_active": [False]})

    def close(self) -> None:
        pass


def activity(reads: DataFrame, run: Column | str, limit: int = 300) -> DataFrame:
    """Activity changes per run (needs the RocksDB state store)."""
    return (
        reads.select(F.col(run).cast("string").alias("run") if isinstance(run, str) else run.alias("run"))
        .groupBy("run")
        .transformWithStateInPandas(
            ActivityTracker(limit), "run string, rows bigint, is_active boolean", "update", "processingTime"
        )
    )
