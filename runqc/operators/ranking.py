"""Exact order statistics that never sort one group in one task.

Values are pre-aggregated to (group, value, weight) first. A running total is then built on two
levels: per-bucket totals (bounded by value range / bucket width) and inside each bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


LENGTH_WIDTH = 1000
QUALITY_WIDTH = 0.25


def value_histogram(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (keys, value): count ``n`` and mass ``total`` (= n * value)."""
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return hist.withColumn("total", F.col("n") * F.col(value))


def running(
    hist: DataFrame,
    keys: Sequence[str],
    value: str,
    weights: Sequence[str],
    width: float | Column,
) -> DataFrame:
    """Add ``<w>_before`` (weight strictly below the value) and ``<w>_all`` per group.

    ``width`` is that of the buckets, or an expression that gives a bucket number which never falls as the value rises.
    """
    # The explicit filter is the one the join below would infer for one branch only; stated for
    # both, the two branches stay identical and share one scan and one shuffle.
    bucket = width if isinstance(width, Column) else F.floor(F.col(value) / F.lit(width))
    spread = hist.withColumn("_b", bucket.cast("long")).where(F.col("_b").isNotNull())
    if not keys:
        spread = spread.withColumn("_all", F.lit(0))
    group = list(keys) or ["_all"]
    buckets = spread.groupBy(*group, "_b").agg(*[F.sum(w).alias(f"_t_{w}") for w in weights])
    over_buckets = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = buckets.select(
        *group,
        "_b",
        *[F.coalesce(F.sum(f"_t_{w}").over(over_buckets), F.lit(0)).alias(f"_o_{w}") for w in weights],
        *[F.sum(f"_t_{w}").over(whole).alias(f"{w}_all") for w in weights],
    )
    inside = Window.partitionBy(*group, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = spread
    for w in weights:
        out = out.withColumn(f"_i_{w}", F.coalesce(F.sum(w).over(inside), F.lit(0)))
    out = out.join(offsets, [*group, "_b"])
    for w in weights:
        out = out.withColumn(f"{w}_before", F.col(f"_o_{w}") + F.col(f"_i_{w}"))
    drop = ["_b", "_all"] + [f"_o_{w}" for w in weights] + [f"_i_{w}" for w in weights]
    return out.drop(*drop)


def holds(index: Column) -> Column:
    """Does this histogram row hold the sorted element with that 0-based index?"""
    return (F.col("n_before") <= index) & (index < F.col("n_before") + F.col("n"))


def upper_median(value: str) -> Column:
    """Aggregate over ``running`` rows: element n//2 of the ascending order."""
    return F.max(F.when(holds(F.floor(F.col("n_all") / 2)), F.col(value)))


def lower_median(value: str) -> Column:
    """Element n//2 of the descending order."""
    return F.max(F.when(holds(F.col("n_all") - 1 - F.floor(F.col("n_all") / 2)), F.col(value)))


def interpolated(value: str, q: float) -> Column:
    """Linear-interpolation quantile."""
    pos = (F.col("n_all") - 1) * F.lit(float(q))
    low = F.max(F.when(holds(F.floor(pos)), F.col(value)))
    high = F.max(F.when(holds(F.ceil(pos)), F.col(value)))
    part = F.max(pos - F.floor(pos))
    return low + (high - low) * part


def nx_value(value: str, fraction: float) -> Column:
    """Longest value such that values at least as long hold ``fraction`` of the mass."""
    rest = F.col("total_all") - F.col("total_before")
    return F.max(F.when(rest >= F.col("total_all") * F.lit(float(fraction)), F.col(value)))


def nx(
    df: DataFrame,
    keys: Sequence[str],
    value: str = "length",
    fractions: Mapping[str, float] | None = None,
    width: float = LENGTH_WIDTH,
) -> DataFrame:
    """N50 and friends per group: ``fractions`` maps output name to fraction."""
    fractions = fractions or {"n50": 0.5}
    run = running(value_histogram(df, keys, value), keys, value, ["total"], width)
    aggs = [F.coalesce(nx_value(value, f), F.lit(0)).alias(name) for name, f in fractions.items()]
    return run.groupBy(*keys).agg(*aggs)


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    qs: Mapping[str, float],
    width: float,
    approx: bool = False,
) -> DataFrame:
    """Interpolated quantiles per group; ``approx`` trades exactness for one sketch pass."""
    if approx:
        return df.groupBy(*keys).agg(
            *[F.percentile_approx(value, q, 10_000).alias(name) for name, q in qs.items()]
        )
    run = running(value_histogram(df, keys, value), keys, value, ["n"], width)
    return run.groupBy(*keys).agg(*[interpolated(value, q).alias(name) for name, q in qs.items()])


def medians(df: DataFrame, keys: Sequence[str], value: str, width: float) -> DataFrame:
    """The three medians in use: upper, lower and interpolated."""
    run = running(value_histogram(df, keys, value), keys, value, ["n"], width)
    return run.groupBy(*keys).agg(
        upper_median(value).alias("upper_median"),
        lower_median(value).alias("lower_median"),
        interpolated(value, 0.5).alias("median"),
    )


#: Parts of a group that meet its row apart.
GROUP_PARTS = 32


def _beside(rows: DataFrame, groups: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Rows joined with the one row of their group; a group of very many rows is dealt over parts by a hash of ``by``."""
    parts = groups.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(GROUP_PARTS - 1).cast("long"))))
    return rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(GROUP_PARTS).cast("long"))).join(parts, [*keys, "_part"]).drop("_part")


def hash_sample(
    df: DataFrame,
    keys: Sequence[str],
    quota: DataFrame,
    id_col: str,
    seed: int = 42,
    digits: int = 4,
) -> DataFrame:
    """Exactly ``quota.n_keep`` rows per group, the ones with the smallest keyed hash.

    ``quota`` has one row per group. Rows are counted per hash prefix, which gives each group the
    prefix at which its quota is reached: rows below it are all in, only rows with that prefix are
    ranked. A group that holds most rows costs no more than others.
    """
    hashed = df.withColumn("_h", F.md5(F.concat(F.col(id_col), F.lit(str(seed))))).withColumn(
        "_p", F.substring("_h", 1, digits)
    )
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        hashed.groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .join(quota.select(*keys, "n_keep"), list(keys))
        .where(F.col("_before") < F.col("n_keep"))
        .groupBy(*keys)
        .agg(
            F.max("_p").alias("_cut"),
            (F.max("n_keep") - F.max("_before")).cast("long").alias("_left"),
        )
    )
    kept = _beside(hashed, cuts, list(keys), "_h").where(F.col("_p") <= F.col("_cut"))
    whole = kept.where(F.col("_p") < F.col("_cut"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_p").orderBy("_h", id_col))
    edge = kept.where(F.col("_p") == F.col("_cut")).withColumn("_r", rank).where("_r <= _left").drop("_r")
    return whole.unionByName(edge).select(*df.columns)


#: Rows of a block, and of a task that orders or sums them; more rows make more tasks, not larger ones.
ROWS_PER_TASK = 250_000


def _by_task(df: DataFrame, rows: int, *keys: Column | str) -> DataFrame:
    """Dealt by ``keys`` over as many tasks as ``rows`` ask for, if the session's number of partitions is too small."""
    tasks = -(-rows // ROWS_PER_TASK)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def ordered_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tie: str,
    sums: Mapping[str, str],
    rows_per_block: int = ROWS_PER_TASK,
) -> DataFrame:
    """Running totals over a total order of the rows: ``rank`` (1-based) and one column per sum.

    The order is (``order``, md5(``tie``), ``tie``). Blocks are cut at quantiles of ``order``; a
    value so frequent that it fills several blocks is cut further by the hash. Windows therefore
    see one block each, and only block totals are accumulated across blocks.
    """
    total = df.count()
    n_blocks = int(min(max(total // rows_per_block, 8), 10_000))
    probs = [i / n_blocks for i in range(n_blocks + 1)]
    cuts = df.approxQuantile(order, probs, 1 / (4 * n_blocks))
    edges = sorted(set(cuts))
    hot = sorted({c for c in edges if cuts.count(c) > 1})
    splits = [float("-inf"), *edges, float("inf")]
    blocked = Bucketizer(splits=splits, inputCol="_o", outputCol="_blk", handleInvalid="keep").transform(
        df.withColumn("_o", F.col(order).cast("double"))
    )
    blocked = blocked.withColumn("_m", F.md5(F.col(tie).cast("string"))).withColumn(
        "_sub", F.when(F.col("_o").isin(hot), F.substring("_m", 1, 2)).otherwise(F.lit("~"))
    )
    block = [*keys, "_blk", "_sub"]
    totals = blocked.groupBy(*block).agg(
        F.count("*").alias("_n"), *[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()]
    )
    group = list(keys) or [F.lit(0)]
    earlier = Window.partitionBy(*group).orderBy("_blk", "_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *block,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_o_rank"),
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    inside = Window.partitionBy(*block).orderBy(order, "_m", tie).rowsBetween(Window.unboundedPreceding, 0)
    out = _by_task(blocked, total, *block).withColumn("rank", F.count("*").over(inside))
    for name, c in sums.items():
        out = out.withColumn(name, F.sum(c).over(inside))
    out = out.join(offsets, block).withColumn("rank", F.col("rank") + F.col("_o_rank"))
    for name in sums:
        out = out.withColumn(name, F.col(name) + F.col(f"_o_{name}"))
    return out.select(*df.columns, "rank", *sums)


def rolling_means(
    ranked: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, str],
    k: int,
    rows: int = 0,
) -> DataFrame:
    """Mean over every full window of ``k`` consecutive rows, labelled at window index k//2.

    ``ranked`` comes from ``ordered_totals``; ``sums`` maps its running-sum columns to output
    names. A window sum is a difference of two running sums, so each row is sent to the window
    it closes, the window it has just left and the window it labels: one shuffle, any ``k``.
    ``rows``, the number of rows if it is known, sets the number of tasks.
    """
    rank = F.col("rank")
    role = lambda end, sign, label: F.struct(
        end.alias("end"), F.lit(sign).alias("sign"), F.lit(label).alias("is_label")
    )
    roles = F.array(
        role(rank, 1, False), role(rank + k, -1, False), role(rank + (k - 1 - k // 2), 0, True)
    )
    sent = ranked.select(*keys, order, *sums, F.explode(roles).alias("r"))
    per_window = _by_task(sent, 3 * rows, *keys, F.col("r.end")).groupBy(*keys, F.col("r.end").alias("end")).agg(
        F.max(F.when(F.col("r.is_label"), F.col(order))).alias(order),
        F.max(F.when(F.col("r.sign") == 1, F.lit(1))).alias("_closed"),
        *[(F.sum(F.col(c) * F.col("r.sign")) / F.lit(float(k))).alias(out) for c, out in sums.items()],
    )
    return (
        per_window.where((F.col("end") >= k) & (F.col("_closed") == 1))
        .withColumn("window", F.col("end") - k + 1)
        .drop("end", "_closed")
    )
