"""Time-bucketed rollups, cumulative curves and threshold alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runqc.functions import phred
from runqc.functions.common import col_of, count_where, pct
from runqc.operators import ranking
from runqc.operators.joins import scalar_struct

BUCKET_SECONDS = 300

# Monitor thresholds as (metric, bound, category).
ALERT_RULES = [
    ("mean_qscore", 10.0, "quality"),
    ("n50", 1000.0, "quality"),
    ("active_pores_pct", 50.0, "pores"),
    ("reads_per_hour", 10000.0, "throughput"),
]


def bucket_start(seconds: Column | str, width: int = BUCKET_SECONDS) -> Column:
    return (F.floor(col_of(seconds) / width) * width).cast("long")


def hour_of(seconds: Column | str) -> Column:
    return F.floor(col_of(seconds) / 3600).cast("long")


def cumulative_by_bin(
    reads: DataFrame, keys: Sequence[str], width: int = 60, time: str = "start_time"
) -> DataFrame:
    """Cumulative reads and bases at bin resolution: the window sees bins, never reads."""
    bins = reads.groupBy(*keys, bucket_start(time, width).alias("bin_start")).agg(
        F.count("*").alias("n"), F.sum("length").alias("bases")
    )
    so_far = Window.partitionBy(*keys).orderBy("bin_start").rowsBetween(Window.unboundedPreceding, 0)
    return bins.select(
        *keys,
        "bin_start",
        F.sum("n").over(so_far).alias("cumulative_reads"),
        F.sum("bases").over(so_far).alias("cumulative_bases"),
    )


def cumulative_by_read(reads: DataFrame, keys: Sequence[str], time: str = "start_time") -> DataFrame:
    """Cumulative reads and bases after every single read."""
    return ranking.ordered_totals(reads, keys, time, "read_id", {"cumulative_bases": "length"}).withColumnRenamed(
        "rank", "cumulative_reads"
    )


def rolling_quality_length(
    reads: DataFrame, keys: Sequence[str], k: int | None = None, time: str = "start_time"
) -> DataFrame:
    """Centred rolling (arithmetic) means of quality and length over k = max(100, n // 100) reads."""
    rows = reads.count()
    if k is None:
        k = max(100, rows // 100)
    ranked = ranking.ordered_totals(
        reads.select(*keys, time, "read_id", "qscore", "length"), keys, time, "read_id",
        {"sum_q": "qscore", "sum_len": "length"},
    )
    return ranking.rolling_means(ranked, keys, time, {"sum_q": "rolling_q", "sum_len": "rolling_length"}, k, rows)


def monitor_series(reads: DataFrame, keys: Sequence[str], time: str = "start_time") -> DataFrame:
    """Five-minute series: cumulative totals, hourly rates, bucket mean quality and bucket N50."""
    by = [*keys, "bucket"]
    timed = reads.withColumn("bucket", bucket_start(time))
    base = timed.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum("length").alias("bases"),
        phred.mean_q(F.when(F.col("qscore") > 0, F.col("qscore"))).alias("mean_qscore"),
    )
    so_far = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    hours = (F.col("bucket") + BUCKET_SECONDS) / F.lit(3600.0)
    series = base.select(
        *by,
        F.sum("n").over(so_far).alias("cumulative_reads"),
        F.sum("bases").over(so_far).alias("cumulative_bases"),
        "mean_qscore",
    ).select(
        "*",
        (F.col("cumulative_reads") / hours).alias("reads_per_hour"),
        (F.col("cumulative_bases") / hours).alias("bases_per_hour"),
    )
    return series.join(ranking.nx(timed, by), by)


def hourly_by_reason(reads: DataFrame, keys: Sequence[str] = (), reason: str = "end_reason") -> DataFrame:
    """Per hour and reason: reads, yield, and the means where n > 10 and N50 where n > 50."""
    by = [*keys, "hour", reason]
    timed = reads.withColumn("hour", hour_of("start_time"))
    base = timed.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum("length").alias("bases"),
        phred.mean_q("qscore").alias("_q"),
        F.avg("length").alias("_l"),
    )
    joined = base.join(ranking.nx(timed, by), by)
    return joined.select(
        *by,
        "n",
        "bases",
        F.when(F.col("n") > 10, F.col("_q")).alias("mean_qscore"),
        F.when(F.col("n") > 10, F.col("_l")).alias("mean_length"),
        F.when(F.col("n") > 50, F.col("n50")).alias("n50"),
    )


def hour_totals(reads: DataFrame) -> DataFrame:
    """Every hour from 0 to the last, 0 where nothing happened; one row per hour."""
    hours = reads.groupBy(hour_of("start_time").alias("hour")).agg(
        F.count("*").alias("n"),
        F.sum("length").alias("bases"),
        *[count_where(F.col("qscore") >= q).alias(f"q{q}") for q in (10, 15, 20)],
        count_where(F.col("end_reason") == "signal_positive").alias("sp"),
        phred.mean_q("qscore").alias("mean_qscore"),
    )
    spine = hours.agg(F.max("hour").alias("last")).select(F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("hour"))
    return spine.join(hours, "hour", "left").na.fill(0)


def hourly_quality(reads: DataFrame) -> DataFrame:
    hours = hour_totals(reads)
    return hours.select(
        "hour",
        "n",
        *[pct(F.col(f"q{q}"), F.col("n")).alias(f"q{q}_pct") for q in (10, 15, 20)],
        pct(F.col("sp"), F.col("n")).alias("signal_positive_pct"),
    )


def hourly_cumulative(reads: DataFrame) -> DataFrame:
    so_far = Window.partitionBy(F.lit(0)).orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    return hour_totals(reads).select(
        "hour",
        F.sum("n").over(so_far).alias("cumulative_reads"),
        F.sum("bases").over(so_far).alias("cumulative_bases"),
    )


def best_hours(reads: DataFrame) -> DataFrame:
    """First hour with the best quality, first with the best yield, and the peak rate."""
    hours = hour_totals(reads)
    first_best = lambda m: F.struct(m, -F.col("hour"))
    return hours.agg(
        (F.max("hour") + 1).alias("duration_hours"),
        F.max_by("hour", first_best(F.col("mean_qscore"))).alias("best_quality_hour"),
        F.max("mean_qscore").alias("best_quality"),
        F.max_by("hour", first_best(F.col("bases"))).alias("best_yield_hour"),
        F.max("bases").alias("best_yield"),
        F.max("n").alias("peak_reads_per_hour"),
    )


def active_channels(reads: DataFrame, edges: int = 30) -> DataFrame:
    """Distinct channels per even time bin from 0 to the last read (the last bin is closed)."""
    s = scalar_struct(reads.agg(F.max("start_time").cast("double").alias("hi")))
    bin_ = F.floor(F.try_divide(F.col("start_time") * F.lit(float(edges - 1)), s["hi"])).cast("long")
    return (
        reads.select(F.least(bin_, F.lit(edges - 2)).alias("bin"), "channel").where("bin is not null").distinct()
        .groupBy("bin").agg(F.count("*").alias("active_channels"))
    )


def reason_share_over_time(reads: DataFrame, edges: int = 50) -> DataFrame:
    """Percentage of each end reason per even time bin from 0 to the last read."""
    s = scalar_struct(reads.agg(F.max("start_time").cast("double").alias("hi")))
    bin_ = F.floor(F.try_divide(F.col("start_time") * F.lit(float(edges - 1)), s["hi"])).cast("long")
    counts = (
        reads.select(F.least(bin_, F.lit(edges - 2)).alias("bin"), "end_reason").where("bin is not null")
        .groupBy("bin", "end_reason").agg(F.count("*").alias("n"))
    )
    return counts.withColumn("pct", pct(F.col("n"), F.sum("n").over(Window.partitionBy("bin"))))


def read_rate(reads: DataFrame, bins: int = 30, min_reads: int = 10) -> DataFrame:
    """Reads per minute in even bins between first and last read of each reason (last bin closed).

    The rate is NULL for reasons of up to ``min_reads`` reads or of one instant; their rows stay.
    """
    seconds = reads.groupBy("end_reason", "start_time").agg(F.count("*").alias("n"))
    span = seconds.groupBy("end_reason").agg(
        F.min("start_time").alias("lo"), F.max("start_time").alias("hi"), F.sum("n").alias("n_all")
    )
    width = F.when((F.col("n_all") > min_reads) & (F.col("hi") > F.col("lo")), (F.col("hi") - F.col("lo")) / F.lit(float(bins)))
    place = F.coalesce(F.floor(F.try_divide((F.col("start_time") - F.col("lo")) * F.lit(float(bins)), F.col("hi") - F.col("lo"))), F.lit(0))
    return (
        seconds.join(span, "end_reason")
        .groupBy("end_reason", F.least(place, F.lit(bins - 1)).cast("long").alias("bin"))
        .agg(F.sum("n").alias("n"), (F.sum("n") / F.max(width) * 60).alias("reads_per_minute"))
    )


def alerts(metrics: DataFrame, rules: Sequence[tuple[str, float, str]] = ALERT_RULES) -> DataFrame:
    """Rows of (keys, metric, value) below their bound; an N50 of 0 means no data and stays silent."""
    table = metrics.sparkSession.createDataFrame(list(rules), "metric string, threshold double, category string")
    silent = (F.col("metric") == "n50") & (F.col("value") <= 0)
    # The rule table is the argument of this call, so its size is known here.
    return (
        metrics.join(F.broadcast(table), "metric")
        .where((F.col("value") < F.col("threshold")) & ~silent)
        .withColumn("level", F.lit("warning"))
        .withColumn(
            "message", F.concat(F.col("metric"), F.lit(" ("), F.format_string("%.1f", "value"), F.lit(") below threshold"))
        )
    )


def pore_activity(duty: DataFrame, keys: Sequence[str], total_channels: int = 512) -> DataFrame:
    """Latest duty-time row per group: active share of all channels and strand occupancy."""
    latest = duty.groupBy(*keys).agg(
        F.max_by(F.struct("active_pores", "sequencing"), "time").alias("d")
    )
    active, strand = F.col("d.active_pores"), F.col("d.sequencing")
    return latest.select(
        *keys,
        pct(active, F.lit(total_channels)).alias("active_pores_pct"),
        F.coalesce(F.try_divide(strand.cast("double"), active), F.lit(0.0)).alias("occupancy"),
    )


def run_activity(events: DataFrame, keys: Sequence[str], time: str, now: Column, limit_seconds: int = 300) -> DataFrame:
    """A run is active while its last record is at most ``limit_seconds`` old."""
    last = events.groupBy(*keys).agg(F.max(time).alias("last_seen"))
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("last_seen").cast("timestamp"))
    return last.select(*keys, "last_seen", (age <= limit_seconds).alias("is_active"))
