"""Join helpers: even partitions and a range join that stays an equi join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def spread(df: DataFrame, *keys: str) -> DataFrame:
    """At least one partition per core ahead of CPU-heavy work.

    Shuffles only an input that has fewer partitions than the cluster has cores, so a large table
    with many splits is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def balanced(df: DataFrame, *keys: str, times: int = 1) -> DataFrame:
    """Even partitions ahead of work that costs far more than its bytes suggest, by ``keys`` if there are any.

    Adaptive execution merges small shuffle partitions by size; a fixed count keeps all cores busy.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n * times, *keys)


#: A key is hot if it holds more than one row in so many; there are fewer hot keys than that. Each is dealt over the salts.
HOT_SHARE, SALTS = 1000, 64


def range_join(
    left: DataFrame,
    right: DataFrame,
    value: str,
    low: str,
    high: str,
    extra: list[str] | None = None,
) -> DataFrame:
    """Inner join on ``low <= value <= high`` (integers), plus equality on ``extra``.

    Ranges are held against the distinct values only. Every range is registered in at most two cells of a grid whose
    step is the power of two that covers its width, and a value looks into one cell for each step in use, so that is an
    equi join at any size of ``right``. What is found for a value goes back to its rows by an equi join in which the
    values of very many rows, known from the counts of the distinct values, are salted.
    """
    extra = list(extra or [])
    keys = [*extra, value]
    counts = left.groupBy(*keys).agg(F.count("*").alias("_n"))
    step = F.ceil(F.log2((F.col(high) - F.col(low) + 1).cast("double"))).cast("int")
    ranged = right.where(F.col(low) <= F.col(high)).withColumn("_step", step)
    # At most 63 distinct powers of two, whatever the size of ``right``.
    steps = ranged.agg(F.collect_set("_step").alias("s")).scalar()
    cell = lambda c: F.expr(f"shiftright(cast({c} as bigint), _step)")
    ranged = ranged.withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    probe = counts.select(*keys, F.explode(steps).alias("_step")).withColumn("_cell", cell(value))
    found = probe.join(ranged, [*extra, "_step", "_cell"]).where(F.col(value).between(F.col(low), F.col(high))).drop("_step", "_cell")
    # Fewer than HOT_SHARE keys can hold more than one row in HOT_SHARE each.
    key = F.struct(*keys)
    hot = counts.where(F.col("_n") * HOT_SHARE > left.agg(F.count("*").alias("n")).scalar()).agg(F.collect_set(key).alias("k")).scalar()
    is_hot = F.array_contains(hot, key)
    salted = left.withColumn("_salt", F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int"))
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(found.withColumn("_salt", F.explode(every)), [*keys, "_salt"]).drop("_salt")


def scalar_struct(one_row: DataFrame) -> Column:
    """The columns of a one-row frame as a struct Column usable in any other frame."""
    return one_row.select(F.struct(*one_row.columns).alias("_s")).scalar()
