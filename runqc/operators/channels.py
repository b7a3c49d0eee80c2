"""Per-channel rollups; a device may have any number of channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runqc.functions import endreason as er
from runqc.functions import phred
from runqc.functions.common import count_where, pct

#: Channels of the smallest device: the denominator of the efficiency unless another is given.
CHANNELS = 512
GROUP = 128


def channel_counts(reads: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Reads per channel and coarse category with the signal-positive share."""
    cat = er.coarse_category("end_reason")
    n = F.count("*")
    sp = count_where(cat == "signal_positive")
    return reads.groupBy(*keys, "channel").agg(
        n.alias("total"),
        sp.alias("signal_positive"),
        count_where(cat == "unblock").alias("unblock"),
        count_where(cat == "other").alias("other"),
        pct(sp, n).alias("signal_positive_pct"),
    )


def channel_performance(reads: DataFrame, channels: int = CHANNELS) -> DataFrame:
    """Spread of reads per channel, silent channels counted as 0 up to the last channel seen.

    ``channels`` is the device's number, the denominator of the efficiency; no channel is left out.
    """
    counts = reads.groupBy("channel").agg(F.count("*").alias("n"))
    last = F.max("channel").cast("long")
    spine = counts.agg(last.alias("last")).select(F.explode(F.sequence(F.lit(1).cast("long"), "last")).alias("channel"))
    dense = spine.join(counts.withColumn("channel", F.col("channel").cast("long")), "channel", "full").select(
        "channel", F.coalesce("n", F.lit(0)).alias("n")
    )
    per = F.col("n")
    # At most one row per channel from here on.
    stats = dense.agg(
        count_where(F.col("n") > 0).alias("active_channels"),
        F.avg(per).alias("mean_reads"),
        F.median(per).alias("median_reads"),
        F.stddev_pop(per).alias("std_reads"),
        F.collect_list(per).alias("_all"),
    )
    low = F.size(F.filter("_all", lambda x: x < F.col("mean_reads") / 2)).cast("long")
    high = F.size(F.filter("_all", lambda x: x > F.col("mean_reads") * 1.5)).cast("long")
    return stats.select(
        "active_channels", "mean_reads", "median_reads", "std_reads",
        low.alias("low_performers"),
        high.alias("high_performers"),
        (F.col("active_channels") * 100.0 / channels).alias("efficiency_pct"),
    )


def channel_groups(reads: DataFrame, keys: Sequence[str] = (), size: int = GROUP) -> DataFrame:
    """Groups of ``size`` channels: share, Phred mean and mean length per end reason."""
    group = F.floor((F.col("channel") - 1) / size).cast("long")
    per = (
        reads.where(F.col("channel") >= 1)
        .groupBy(*keys, group.alias("channel_group"), "end_reason")
        .agg(F.count("*").alias("n"), phred.mean_q("qscore").alias("mean_qscore"), F.avg("length").alias("mean_length"))
    )
    totals = per.groupBy(*keys, "channel_group").agg(F.sum("n").alias("_t"))
    return per.join(totals, [*keys, "channel_group"]).withColumn("pct", pct(F.col("n"), F.col("_t"))).drop("_t")


def channel_grid(reads: DataFrame, keys: Sequence[str] = (), columns: int = GROUP) -> DataFrame:
    """Signal-positive rate in rows of 128 channels, long form."""
    row = F.floor((F.col("channel") - 1) / columns).cast("long")
    col = ((F.col("channel") - 1) % columns).cast("long")
    return (
        reads.where(F.col("channel") >= 1)
        .groupBy(*keys, row.alias("row"), col.alias("col"))
        .agg(pct(count_where(F.col("end_reason") == "signal_positive"), F.count("*")).alias("signal_positive_rate"))
    )
