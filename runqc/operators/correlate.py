"""Length-quality relations and identity bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runqc.functions import phred
from runqc.functions.common import count_where, first_match
from runqc.operators import ranking


def length_quality_correlation(reads: DataFrame, by: str = "end_reason", min_reads: int = 100) -> DataFrame:
    """Pearson r and least-squares line overall and per reason, in one scan; NULL up to ``min_reads`` reads."""
    key = F.col(by)
    out = reads.groupingSets([[], [key]], key).agg(
        F.grouping(by).alias("_all"),
        F.count("*").alias("n"),
        F.corr("length", "qscore").alias("r"),
        F.regr_slope("qscore", "length").alias("slope"),
        F.regr_intercept("qscore", "length").alias("intercept"),
    )
    enough = (F.col("_all") == 1) | (F.col("n") > min_reads)
    return out.select(
        F.when(F.col("_all") == 1, F.lit("all")).otherwise(key).alias(by), "n",
        *[F.when(enough, F.col(c)).alias(c) for c in ("r", "slope", "intercept")],
    )


def n50_by_reason(reads: DataFrame, by: str = "end_reason", min_reads: int = 100) -> DataFrame:
    base = reads.groupBy(by).agg(F.count("*").alias("n"), phred.mean_q("qscore").alias("mean_qscore"))
    """N50 and Phred mean per reason; NULL up to ``min_reads`` reads."""
    enough = F.col("n") > min_reads
    joined = base.join(ranking.nx(reads, [by]), by)
    return joined.select(by, "n", *[F.when(enough, F.col(c)).alias(c) for c in joined.columns if c not in (by, "n")])


def decile_edges(reads: DataFrame) -> DataFrame:
    """One row holding the eleven decile edges of length."""
    qs = {f"e{i}": i / 10 for i in range(11)}
    return ranking.quantiles(reads, [], "length", qs, ranking.LENGTH_WIDTH).select(
        F.array(*[F.col(f"e{i}") for i in range(11)]).alias("edges")
    )


def with_decile(reads: DataFrame) -> DataFrame:
    """Half-open length decile 0..9; the last one is closed."""
    at = F.col("decile")
    return (
        reads.withColumn("_edges", decile_edges(reads).scalar())
        .withColumn("decile", F.least(F.size(F.filter("_edges", lambda e: e <= F.col("length"))) - 1, F.lit(9)))
        .where(at >= 0)
        .withColumn("bin_center", (F.get("_edges", at) + F.get("_edges", at + 1)) / 2)
        .drop("_edges")
    )


def quality_by_length_decile(reads: DataFrame, by: str = "end_reason", min_group: int = 100, min_bin: int = 10) -> DataFrame:
    """Phred mean per reason and length decile; NULL in small groups and bins, whose rows stay."""
    binned = with_decile(reads).groupBy(by, "decile").agg(
        F.count("*").alias("n"),
        F.max("bin_center").alias("bin_center"),
        phred.mean_q("qscore").alias("mean_qscore"),
    )
    of_group = F.sum("n").over(Window.partitionBy(by))  # at most ten rows each
    return binned.withColumn("mean_qscore", F.when((F.col("n") > min_bin) & (of_group > min_group), F.col("mean_qscore")))


def quality_percentiles_by_decile(reads: DataFrame, percents: Sequence[int] = (25, 50, 75, 90), min_bin: int = 10) -> DataFrame:
    binned = with_decile(reads)
    run = ranking.running(
        ranking.value_histogram(binned, ["decile"], "qscore"), ["decile"], "qscore", ["n"], ranking.QUALITY_WIDTH
    )
    return run.groupBy("decile").agg(
        F.sum("n").alias("n"), *[F.when(F.sum("n") > min_bin, ranking.interpolated("qscore", p / 100)).alias(f"p{p}") for p in percents]
    )


# Quality bands (low inclusive, high exclusive; the top one is open).
Q_BANDS = [("Q0-10", 0, 10), ("Q10-15", 10, 15), ("Q15-20", 15, 20), ("Q20+", 20, float("inf"))]


def quality_bands(reads: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    q = F.col("qscore")
    band = first_match([((q >= lo) & (q < hi), name) for name, lo, hi in Q_BANDS])
    return (
        reads.withColumn("band", band).where(F.col("band").isNotNull())
        .groupBy(*keys, "band").agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))
    )


# Identity bands (lower bound, name) and the identity of a perfect read.
IDENTITY_BANDS = [(0.99, "perfect"), (0.95, "high"), (0.90, "medium")]
PERFECT_IDENTITY = 0.9999


def quality_by_identity(reads: DataFrame) -> DataFrame:
    """Phred mean per alignment-identity band; reads without an identity are left out."""
    identity = F.col("identity")
    band = first_match([(identity >= lo, name) for lo, name in IDENTITY_BANDS], "low")
    return (
        reads.where(identity.isNotNull()).groupBy(band.alias("band"))
        .agg(F.count("*").alias("n"), phred.mean_q("qscore").alias("mean_qscore"))
    )


def per_target_stats(reads: DataFrame, target: str = "alias") -> DataFrame:
    """Per assigned target: count, Phred mean of scored reads, mean length, identity, perfect reads."""
    usable = F.coalesce(F.col(target), F.lit(""))
    return (
        reads.where(~usable.isin("", "unclassified", "mixed"))
        .groupBy(target)
        .agg(
            F.count("*").alias("n"),
            phred.mean_q(F.when(F.col("qscore") > 0, F.col("qscore"))).alias("mean_qscore"),
            F.avg("length").alias("mean_length"),
            F.avg("identity").alias("mean_identity"),
            count_where(F.col("identity") >= PERFECT_IDENTITY).alias("perfect_count"),
        )
    )
