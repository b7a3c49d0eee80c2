"""Histograms, smoothing, kernel densities and peaks, all over pre-aggregated counts."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runqc.operators.joins import balanced, scalar_struct

# Fixed values of the length histogram and its smoothing.
BIN = 10
SIGMA = 3.0
TRUNCATE = 4.0
FWHM = 2.355


def length_histogram(reads: DataFrame, keys: Sequence[str], width: int = BIN) -> DataFrame:
    """Counts per bin; only bins that occur."""
    low = (F.floor(F.col("length") / width) * width).alias("bin")
    return reads.select(*keys, low).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def dense_histogram(hist: DataFrame, keys: Sequence[str], width: int = BIN) -> DataFrame:
    """Every bin of every group from 0 to its last, 0 where no read fell."""
    spine = hist.groupBy(*keys).agg(F.max("bin").alias("_last")).where("_last is not null")
    spine = spine.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), "_last", F.lit(width).cast("bigint"))).alias("bin"))
    return spine.join(hist, [*keys, "bin"], "left").select(
        *keys, "bin", F.coalesce("n", F.lit(0)).alias("n")
    )


def kernel_weights(sigma: float = SIGMA, truncate: float = TRUNCATE) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def smoothed_histogram(
    reads: DataFrame, keys: Sequence[str], width: int = BIN, sigma: float = SIGMA
) -> DataFrame:
    """Gaussian-smoothed histogram scaled to a maximum of 100, mirrored at length 0.

    Each occupied bin spreads its count over the kernel; a mirrored bin is the same count at a
    position below 0. Work is occupied bins x kernel width; bins out of reach of reads are absent. Occupied bins are
    shuffled by group, so that neither what they spread nor the curve is.
    """
    weights = kernel_weights(sigma)
    radius = len(weights) // 2
    hist = length_histogram(reads, keys, width).withColumn("i", (F.col("bin") / width).cast("long"))
    if keys:
        hist = balanced(hist, *keys, times=4)
    positions = F.array(F.col("i"), -F.col("i") - 1)
    spread = (
        hist.select(*keys, "n", F.explode(positions).alias("p"))
        .where(F.col("p") >= -radius)
        .select(*keys, "n", "p", F.posexplode(F.array(*[F.lit(w) for w in weights])).alias("o", "w"))
        .select(*keys, (F.col("p") + F.col("o") - radius).alias("i"), (F.col("n") * F.col("w")).alias("y"))
        .where(F.col("i") >= 0)
        .groupBy(*keys, "i").agg(F.sum("y").alias("y"))
    )
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return spread.select(
        *keys,
        (F.col("i") * width).alias("bin"),
        F.round(F.col("y") / F.max("y").over(whole) * 100, 9).alias("density"),
    )


def main_peak(smoothed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Highest bin (leftmost on a tie) and sigma from the full width at half maximum."""
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    curve = smoothed.withColumn("_top", F.max("density").over(whole))
    above = F.when(F.col("density") > F.col("_top") / 2, F.col("bin"))
    return curve.groupBy(*keys).agg(
        F.min(F.when(F.col("density") == F.col("_top"), F.col("bin"))).alias("peak_center"),
        ((F.max(above) - F.min(above)) / F.lit(FWHM)).alias("peak_sigma"),
    )


def kde(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    low: Column,
    high: Column,
    points: int,
    factor: float,
    min_reads: int = 1,
) -> DataFrame:
    """Gaussian kernel density on an even grid from ``low`` to ``high``.

    ``counts`` holds (keys, value, n), so the cost is distinct values x grid points however many
    reads there are. Those products are summed by numpy inside the tasks (measured 20 times faster
    than exploding them into rows) and only grid points are shuffled. Bandwidth is ``factor`` times
    the sample standard deviation of the group.
    """
    x, n = F.col(value).cast("double"), F.col("n")
    moments = counts.groupBy(*keys).agg(
        F.sum("n").alias("_n"), F.sum(x * n).alias("_s1")
    ).withColumn("_mean", F.col("_s1") / F.col("_n"))
    on = list(keys)
    centred = counts.join(moments, on) if on else counts.withColumn("_n", _total(counts)).withColumn(
        "_mean", scalar_struct(moments)["_mean"]
    )
    var = centred.groupBy(*keys).agg(
        F.max("_n").alias("_n"), F.sum(n * F.pow(x - F.col("_mean"), 2)).alias("_s2")
    ).where((F.col("_n") > min_reads) & (F.col("_s2") > 0))
    band = var.select(*keys, "_n", (F.sqrt(F.col("_s2") / (F.col("_n") - 1)) * F.lit(factor)).alias("_h"))
    if on:
        weighted = counts.join(band, on)
    else:
        s = scalar_struct(band)
        weighted = counts.withColumn("_n", s["_n"]).withColumn("_h", s["_h"])
    step = (high - low) / F.lit(float(points - 1))
    rows = balanced(weighted.select(
        *keys, x.alias("_x"), n.cast("double").alias("_w"), F.col("_h"), F.col("_n"),
        low.cast("double").alias("_lo"), step.cast("double").alias("_step"),
    ))

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Kernel sums of a batch on the whole grid; one row per group and grid point."""
        index = np.arange(points)
        for pdf in frames:
            for _, part in pdf.groupby([*keys, "_lo"], sort=False, dropna=False):
                one = part.iloc[0]
                grid = one["_lo"] + index * one["_step"]
                total = np.zeros(points)
                for lo in range(0, len(part), 1024):
                    z = (grid - part["_x"].to_numpy()[lo: lo + 1024, None]) / one["_h"]
                    total += part["_w"].to_numpy()[lo: lo + 1024] @ np.exp(-0.5 * z * z)
                named = {k: one[k] for k in keys}
                yield pd.DataFrame({**named, "point": index, "x": grid, "s": total, "scale": one["_n"] * one["_h"]})

    names = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in counts.schema if f.name in keys)
    sums = rows.mapInPandas(partial, f"{names}point int, x double, s double, scale double")
    return sums.groupBy(*keys, "point").agg(
        F.max("x").alias("x"), (F.sum("s") / F.max(F.col("scale") * F.lit(math.sqrt(2 * math.pi)))).alias("density")
    )


def _total(counts: DataFrame) -> Column:
    return scalar_struct(counts.agg(F.sum("n").alias("_n")))["_n"]


def local_maxima(curve: DataFrame, keys: Sequence[str], order: str, y: str, height: float = 0.05) -> DataFrame:
    """Points above both neighbours and above ``height`` of the curve's maximum (curves are short)."""
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    w = part.orderBy(order)
    flagged = curve.select(
        "*",
        F.lag(y).over(w).alias("_l"),
        F.lead(y).over(w).alias("_r"),
        F.max(y).over(part).alias("_m"),
    )
    return flagged.where(
        (F.col(y) > F.col("_l")) & (F.col(y) > F.col("_r")) & (F.col(y) >= F.col("_m") * height)
    ).drop("_l", "_r", "_m")


def savgol(y: np.ndarray, window: int, order: int = 3) -> np.ndarray:
    """Least-squares polynomial smoothing; the edges use the fit of the first and last window."""
    half = window // 2
    t = np.arange(-half, half + 1)
    fit = np.linalg.pinv(np.vander(t, order + 1, increasing=True))
    out = np.convolve(y, fit[0][::-1], mode="same")
    powers = lambda at: np.vander(at, order + 1, increasing=True)
    out[:half] = powers(t[:half]) @ (fit @ y[:window])
    out[-half:] = powers(t[half + 1:]) @ (fit @ y[-window:])
    return out


def prominent_peaks(y: np.ndarray, height: float, distance: int, prominence: float) -> np.ndarray:
    """Indices of peaks filtered by height, spacing (higher ones first) and prominence."""
    n = len(y)
    found, i = [], 1
    while i < n - 1:
        j = i
        while j < n - 1 and y[j + 1] == y[i]:
            j += 1
        if y[i - 1] < y[i] and j < n - 1 and y[j + 1] < y[i]:
            found.append((i + j) // 2)
        i = j + 1
    peaks = np.array([p for p in found if y[p] >= height], dtype=int)
    keep = np.ones(len(peaks), dtype=bool)
    for k in np.argsort(y[peaks], kind="stable")[::-1]:
        if keep[k]:
            close = np.abs(peaks - peaks[k]) < distance
            close[k] = False
            keep &= ~close
    result = []
    for p in peaks[keep]:
        higher_left = np.flatnonzero(y[:p] > y[p])
        higher_right = np.flatnonzero(y[p + 1:] > y[p])
        left = y[(higher_left[-1] if len(higher_left) else 0): p + 1].min()
        right = y[p: (p + 1 + higher_right[0] if len(higher_right) else n - 1) + 1].min()
        if y[p] - max(left, right) >= prominence:
            result.append(p)
    return np.array(result, dtype=int)


def curve_peaks(
    curve: DataFrame, keys: Sequence[str], order: str, x: str, y: str,
    height: float = 0.05, distance: int = 50, prominence: float = 0.02,
) -> DataFrame:
    """Prominent peaks of each smoothed curve; a group is one curve of at most ~1000 points."""

    def peaks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        values = pdf[y].to_numpy(dtype=float)
        window = min(51, max(5, len(values) // 4 * 2 + 1))
        if len(values) < window:
            return pdf.iloc[0:0][[*keys]].assign(peak_x=[], peak_y=[])
        smooth = savgol(values, window)
        top = smooth.max()
        at = prominent_peaks(smooth, top * height, distance, top * prominence)
        return pdf.iloc[at][[*keys]].assign(peak_x=pdf[x].to_numpy(dtype=float)[at], peak_y=smooth[at])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in curve.schema if f.name in keys)
    schema = f"{schema}, peak_x double, peak_y double" if schema else "peak_x double, peak_y double"
    return curve.groupBy(*keys).applyInPandas(peaks, schema)


def density_2d(reads: DataFrame, keys: Sequence[str], dx: float, dy: float) -> DataFrame:
    """Rectangular length x quality counts."""
    return reads.groupBy(
        *keys,
        (F.floor(F.col("length") / F.lit(dx)) * F.lit(dx)).alias("length_bin"),
        (F.floor(F.col("qscore") / F.lit(dy)) * F.lit(dy)).alias("q_bin"),
    ).agg(F.count("*").alias("n"))


def log_histogram(reads: DataFrame, edges: int = 50) -> DataFrame:
    """Counts in log-spaced length bins between max(1, min) and max; the last bin is closed."""
    counts = reads.where(F.col("length") > 0).groupBy("length").agg(F.count("*").alias("n"))
    s = scalar_struct(counts.agg(
        F.log10(F.greatest(F.min("length"), F.lit(1)).cast("double")).alias("lo"),
        F.log10(F.max("length").cast("double")).alias("hi"),
    ))
    bins = edges - 1
    place = F.floor(
        F.coalesce(F.try_divide(F.log10(F.col("length").cast("double")) - s["lo"], s["hi"] - s["lo"]), F.lit(0.0)) * bins
    )
    return counts.groupBy(F.least(place, F.lit(bins - 1)).alias("bin")).agg(F.sum("n").alias("n"))
