"""End-reason distributions, verdicts, blocks and rate columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runqc.functions import endreason as er
from runqc.functions.common import col_of, count_where, pct
from runqc.operators import distributions, ranking

SP = "signal_positive"


def distribution(reads: DataFrame, keys: Sequence[str], reason: str = "end_reason", places: int = 2) -> DataFrame:
    """Count and percentage per reason; the window sees one row per reason, not per read."""
    counts = reads.groupBy(*keys, reason).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return counts.withColumn("pct", F.round(pct(F.col("n"), F.sum("n").over(whole)), places))


def counts_wide(reads: DataFrame, keys: Sequence[str], reason: str = "end_reason") -> DataFrame:
    """total_reads plus one count column per canonical end reason."""
    value = F.col(reason)
    return reads.groupBy(*keys).agg(
        F.count("*").alias("total_reads"), *[count_where(value == r).alias(r) for r in er.END_REASONS]
    )


def verdicts(reads: DataFrame, keys: Sequence[str], reason: str = "end_reason") -> DataFrame:
    """QC verdict per group; thresholds apply to the rounded percentages."""
    wide = counts_wide(reads, keys, reason)
    share = lambda r: F.round(pct(F.col(r), F.col("total_reads")), 2)
    return wide.select(
        *keys,
        "total_reads",
        share(SP).alias("signal_positive_pct"),
        share("unblock_mux_change").alias("unblock_mux_pct"),
        share("data_service_unblock_mux_change").alias("data_service_pct"),
        share("signal_negative").alias("signal_negative_pct"),
    ).select(
        "*",
        er.verdict("signal_positive_pct", "signal_negative_pct").alias("quality_status"),
        er.verdict_issues("signal_positive_pct", "signal_negative_pct").alias("quality_issues"),
        er.adaptive_note("unblock_mux_pct", "data_service_pct").alias("adaptive_note"),
    )


def rate_columns(counts: DataFrame) -> DataFrame:
    """Derived percentages over per-experiment reason counts; rejection is unblock + data service."""
    total = F.col("total_reads")
    unblock, service = F.col("unblock_mux_change"), F.col("data_service_unblock_mux_change")
    return (
        counts.withColumn("signal_positive_pct", pct(F.col(SP), total))
        .withColumn("unblock_pct", pct(unblock, total))
        .withColumn("data_service_pct", pct(service, total))
        .withColumn("rejection_rate", F.col("unblock_pct") + F.col("data_service_pct"))
        .withColumn("is_adaptive", F.col("rejection_rate") > 1.0)
    )


def totals(per_experiment: DataFrame) -> DataFrame:
    """Sum a (end_reason, n) table over all experiments with overall percentages."""
    sums = per_experiment.groupBy("end_reason").agg(F.sum("n").alias("total"))
    return sums.withColumn("pct", pct(F.col("total"), F.sum("total").over(Window.partitionBy(F.lit(0)))))


def consolidate_small(shares: DataFrame, keys: Sequence[str], min_pct: float = 1.0) -> DataFrame:
    """Fold categories under ``min_pct`` percent into ``other``."""
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    share = pct(F.col("n"), F.sum("n").over(whole))
    label = F.when(share < min_pct, F.lit("other")).otherwise(F.col("end_reason"))
    return (
        shares.withColumn("category", label)
        .groupBy(*keys, "category").agg(F.sum("n").alias("n"))
        .withColumn("pct", pct(F.col("n"), F.sum("n").over(whole)))
    )


def wide_table(reads: DataFrame, key: str, reasons: Sequence[str] | None = None) -> DataFrame:
    """One row per experiment with ``<reason>_count`` and ``<reason>_pct`` columns, 0-filled.

    The union of reasons is a handful of names; pass it to save the distinct scan.
    """
    if reasons is None:
        reasons = sorted(r[0] for r in reads.select("end_reason").distinct().collect())
    counts = reads.groupBy(key).agg(
        F.count("*").alias("total_reads"),
        *[count_where(F.col("end_reason") == r).alias(f"{r}_count") for r in reasons],
    )
    return counts.select("*", *[pct(F.col(f"{r}_count"), F.col("total_reads")).alias(f"{r}_pct") for r in reasons])


def blocks(reads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per category: count, share, N50, median and mean length; group-wide short and dimer shares."""
    named = reads.withColumn("category", er.category("end_reason")).withColumn(
        "category", F.when(F.col("category").isin(SP, "unblock"), F.col("category")).otherwise("other")
    )
    by = [*keys, "category"]
    run = ranking.running(
        ranking.value_histogram(named, by, "length"), by, "length", ["n", "total"], ranking.LENGTH_WIDTH
    )
    summary = run.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("total").alias("bases"),
        ranking.nx_value("length", 0.5).alias("n50"),
        F.floor(ranking.interpolated("length", 0.5)).alias("median"),
        F.sum(F.when(F.col("length") < 200, F.col("n")).otherwise(0)).alias("short"),
        F.sum(F.when(F.col("length") < 100, F.col("n")).otherwise(0)).alias("dimer"),
    )
    whole = Window.partitionBy(*keys)
    n_all = F.sum("n").over(whole)
    return summary.select(
        *by,
        "n",
        pct(F.col("n"), n_all).alias("pct"),
        "n50",
        "median",
        (F.col("bases") / F.col("n")).alias("mean"),
        pct(F.sum("short").over(whole), n_all).alias("short_read_pct"),
        pct(F.sum("dimer").over(whole), n_all).alias("adapter_dimer_pct"),
    )


def concatemers(reads: DataFrame, key: str, ratio: float = 1.8) -> DataFrame:
    """Detected target (peak of the signal-positive histogram) and the share of reads beyond it."""
    positive = reads.where(er.category("end_reason") == SP)
    target = distributions.main_peak(distributions.smoothed_histogram(positive, [key]), [key]).where(
        F.col("peak_center") > 0
    )
    lengths = reads.groupBy(key, "length").agg(F.count("*").alias("n"))
    return (
        lengths.join(target.select(key, "peak_center"), key)
        .groupBy(key)
        .agg(
            F.first("peak_center").alias("detected_target"),
            pct(
                F.sum(F.when(F.col("length") > F.col("peak_center") * ratio, F.col("n")).otherwise(0)), F.sum("n")
            ).alias("concatemer_pct"),
        )
    )


def reason_share(counts: DataFrame, by: Sequence[str], n: Column | str = "n") -> DataFrame:
    """Share of each row's count in its ``by`` group."""
    return counts.withColumn("pct", pct(col_of(n), F.sum(col_of(n)).over(Window.partitionBy(*by))))
