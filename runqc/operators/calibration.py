"""Calibration of predicted error probabilities and recalibration models."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runqc.functions import phred
from runqc.operators import ranking
from runqc.session import cut_lineage, written

CELLS = 6000
"""Probabilities are placed in cells of a hundredth of a Phred unit, from 0 to 60."""

NEWTON_STEPS = 25
MERGE = 16


def point_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, p) -> reads and errors; every metric below is a function of these counts."""
    return rows.groupBy(*keys, "p").agg(F.count("*").alias("n"), F.sum("err").alias("errors"))


def _cell(p: Column) -> Column:
    """Number of the cell, 0 for the highest probabilities; spread evenly over qualities, not over probabilities."""
    q = F.floor(F.log10(p) * -1000.0)
    return F.when(p > 0, F.least(F.greatest(q, F.lit(0)), F.lit(CELLS))).otherwise(CELLS).cast("int")


def _quantile_edges(points: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    run = ranking.running(points, keys, "p", ["n"], -_cell(F.col("p")))
    names = [f"e{i}" for i in range(bins + 1)]
    edges = run.groupBy(*keys).agg(*[ranking.interpolated("p", i / bins).alias(n) for i, n in enumerate(names)])
    return edges.select(*keys, F.array_sort(F.array_distinct(F.array(*names))).alias("edges"))


def _uniform_edges(points: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    span = points.groupBy(*keys).agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    at = lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * F.lit(i / bins)
    return span.select(*keys, F.array(*[at(i) for i in range(bins + 1)]).alias("edges"))


def bin_stats(rows: DataFrame, keys: Sequence[str], bins: int = 20, strategy: str = "quantile") -> DataFrame:
    """Per-bin means and counts. Bins are right-closed, the first includes the lowest value."""
    points = point_counts(rows, keys)
    make = {"quantile": _quantile_edges, "uniform": _uniform_edges}[strategy]
    edges = make(points, keys, bins)
    binned = points.join(edges, list(keys)) if keys else points.withColumn(
        "edges", edges.select("edges").scalar()
    )
    below = F.size(F.filter("edges", lambda e: e < F.col("p")))
    last = F.size("edges") - 1
    bin_ = F.least(F.greatest(below, F.lit(1)), F.greatest(last, F.lit(1)))
    return binned.groupBy(*keys, bin_.alias("bin")).agg(
        F.sum("n").alias("n_bases"),
        (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("p_pred_mean"),
        (F.sum("errors") / F.sum("n")).alias("p_obs_mean"),
        F.min("p").alias("p_pred_min"),
        F.max("p").alias("p_pred_max"),
    )


def calibration_error(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ECE and MCE from bin statistics."""
    dev = F.abs(F.col("p_obs_mean") - F.col("p_pred_mean"))
    return stats.groupBy(*keys).agg(
        F.sum("n_bases").alias("n"),
        F.count("*").alias("bins"),
        (F.sum(dev * F.col("n_bases")) / F.sum("n_bases")).alias("ece"),
        F.max(dev).alias("mce"),
    )


def brier(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.pow(F.col("p") - F.col("err"), 2)).alias("brier")
    )


def by_stratum(rows: DataFrame, stratum: str, bins: int = 20, min_rows: int = 100) -> DataFrame:
    """ECE, MCE and Brier per stratum, all at once; NULL under ``min_rows`` rows, whose strata stay."""
    errors = calibration_error(bin_stats(rows, [stratum], bins), [stratum])
    joined = errors.join(brier(rows, [stratum]).withColumnRenamed("n", "_rows"), stratum)
    enough = F.col("_rows") >= min_rows
    return joined.select(*[F.when(enough, F.col(c)).alias(c) if c in ("ece", "mce", "brier") else c for c in joined.columns if c != "_rows"])


BLOCK = "lo double, hi double, n bigint, errors bigint"


def _pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pools adjacent blocks, which come in order of ``lo``, until their error rates rise strictly."""
    done: list[list] = []
    for batch in batches:
        for lo, hi, n, errors in batch.itertuples(index=False, name=None):
            while done and done[-1][3] * n >= errors * done[-1][2]:
                lo, _, more, wrong = done.pop()
                n, errors = n + more, errors + wrong
            done.append([lo, hi, n, errors])
    yield pd.DataFrame(done, columns=["lo", "hi", "n", "errors"])


def _with_next(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pooled blocks of one last partition, each with where it starts to count and what follows it."""
    for blocks in _pool(batches):
        rate = blocks["errors"] / blocks["n"]
        start = blocks["lo"].where(blocks.index > 0, -math.inf)
        yield blocks.assign(p_cal=rate, start=start, next_lo=blocks["lo"].shift(-1, fill_value=math.inf), next_cal=rate.shift(-1).fillna(rate))


def isotonic_fit(rows: DataFrame) -> DataFrame:
    """The rising fit of the 0/1 flag ``err`` on ``p``, as a table of blocks (lo, hi, n, errors, p_cal, start, next_lo, next_cal).

    Pooling is associative over neighbouring ranges of p: each range is pooled by itself, and the pooled blocks of
    ``MERGE`` ranges again, until one range is left. A task holds the blocks of its range, never its points. Rows without
    p or flag take no part; of no rows there are no blocks.
    """
    points = point_counts(rows.where(F.col("p").isNotNull() & ~F.isnan("p") & F.col("err").isNotNull()), [])
    blocks = written(points.select(F.col("p").alias("lo"), F.col("p").alias("hi"), "n", F.col("errors").cast("long")), "isotonic-points")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while parts > 1:
        blocks = written(blocks.repartitionByRange(parts, "lo").sortWithinPartitions("lo").mapInPandas(_pool, BLOCK), "isotonic-blocks")
        parts //= MERGE
    last = blocks.repartition(1).sortWithinPartitions("lo")
    return written(last.mapInPandas(_with_next, f"{BLOCK}, p_cal double, start double, next_lo double, next_cal double"), "isotonic-fit")


def isotonic_apply(rows: DataFrame, fit: DataFrame, max_q: float = phred.MAX_Q) -> DataFrame:
    """``rows`` with ``p_cal`` and ``q_cal`` by the blocks of ``isotonic_fit``; p need not have been seen by the fit.

    Inside a block p_cal is its rate, between two blocks it is interpolated, outside all it is that of the nearest.
    Blocks are looked up by range: each cell of p lists the blocks that reach into it, so the table has a row per cell
    and the join is on the cell. NULL and NaN have no calibrated value.
    """
    span = F.explode(F.sequence(_cell(F.col("next_lo")), _cell(F.col("start"))))
    table = fit.select(span.alias("_cell"), F.struct("start", "hi", "p_cal", "next_lo", "next_cal").alias("s"))
    table = table.groupBy("_cell").agg(F.array_sort(F.collect_list("s")).alias("_blocks"))
    p = F.col("p")
    placed = rows.withColumn("_cell", F.when(~F.isnan("p"), _cell(p))).join(table, "_cell", "left")
    found = placed.withColumn("_at", F.try_element_at(F.filter("_blocks", lambda s: s["start"] <= p), F.lit(-1)))
    at = F.col("_at")
    share = F.when(p > at["hi"], (p - at["hi"]) / (at["next_lo"] - at["hi"])).otherwise(0.0)
    p_cal = F.when(p.isNotNull(), at["p_cal"] + (at["next_cal"] - at["p_cal"]) * share)
    return found.withColumn("p_cal", p_cal).drop("_cell", "_blocks", "_at").withColumn("q_cal", phred.to_qscore("p_cal", max_q))


def isotonic_recalibrate(rows: DataFrame, max_q: float = phred.MAX_Q) -> DataFrame:
    """Monotone fit of observed error on predicted probability, applied to the rows it was made from."""
    return isotonic_apply(rows, isotonic_fit(rows), max_q)


def platt_recalibrate(rows: DataFrame, max_q: float = phred.MAX_Q, steps: int = NEWTON_STEPS) -> DataFrame:
    """Logistic fit without penalty of the error flag on the predicted probability.

    Newton steps on two parameters; each is one aggregate over a row per distinct probability. A step that lowers the
    likelihood is halved; steps end when they change nothing, or after ``steps`` aggregates (flags that p separates have
    no finite fit).
    """
    points = cut_lineage(point_counts(rows, []).select("p", F.col("n").cast("double"), F.col("errors").cast("double").alias("e")))
    at = slope = step0 = step1 = 0.0
    best = -math.inf
    for _ in range(steps):
        z = F.lit(at) + F.lit(slope) * F.col("p")
        m = 1 / (1 + F.exp(-z))
        rest, weight = F.col("e") - F.col("n") * m, F.col("n") * m * (1 - m)
        likely = F.col("e") * z - F.col("n") * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))))
        like, g0, g1, s0, sx, sxx = points.agg(
            F.sum(likely), F.sum(rest), F.sum(rest * F.col("p")), F.sum(weight), F.sum(weight * F.col("p")), F.sum(weight * F.col("p") * F.col("p"))
        ).first()
        if like is None:
            break
        if like < best - 1e-12 * abs(best):  # too far: half the step
            step0, step1 = step0 / 2, step1 / 2
            at, slope = at - step0, slope - step1
            continue
        best = like
        det = s0 * sxx - sx * sx
        if not det > 1e-14 * s0 * sxx:  # a single probability, or flags that p separates: no further slope can be told
            break
        step0, step1 = (sxx * g0 - sx * g1) / det, (s0 * g1 - sx * g0) / det
        at, slope = at + step0, slope + step1
        if abs(step0) <= 1e-11 * (1 + abs(at)) and abs(step1) <= 1e-11 * (1 + abs(slope)):
            break
    p_cal = 1 / (1 + F.exp(-(F.lit(at) + F.lit(slope) * F.col("p"))))
    return rows.withColumn("p_cal", p_cal).withColumn("q_cal", phred.to_qscore("p_cal", max_q))
