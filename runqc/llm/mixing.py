"""Mixing sources to target weights by systematic sampling; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runqc.llm.common import word_count
from runqc.session import written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
#: Rows of sources and their partitions up to which they are sent to the documents; more are joined by a shuffle of both.
BROADCAST_ROWS = 100_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) with ``target``: the words the mix should take from each source.

    Sources in code point order, NULL last, weigh ``weights`` in turn and share the total. A target stops at
    ``max_repeat`` times the source's size; its excess goes to the others by weight until none is above. That ends at
    one water level: target = least(cap, level * weight), where the level is found on the sources sorted by cap/weight.
    One row per source goes through these windows, never a document.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    none = F.lit(0.0)
    return (
        sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", max_repeat * F.col("source_size").cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("level", (F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(earlier), none))
                    / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(earlier), none)))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(every)["level"])
        .select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))
    )


def _offset(source: Column) -> Column:
    """The one random start of a source, in [0, 1): 16 bits of its md5, so that reruns agree and sums stay exact."""
    return F.conv(F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 4), 16, 10).cast("double") / 65536


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, source: str = "source", text: str = "text",
        doc_id: str = "doc_id", keep: bool = False) -> DataFrame:
    """Per document ``doc_id, size, source_size, target, copies, taken``; with ``keep`` all its columns (struct ``doc``).

    Every document of a source has the same expected copies, target / source_size. Documents are laid out by source and
    falling size, so the prefix sum of expected copies is rank x rate; a document is emitted once per integer that its
    stretch of the sum, shifted by the source's offset, crosses. Neighbours in the order have like sizes, so the words
    taken miss the target by about the largest document at most. The rank comes from the position in a range-partitioned
    table plus the rows of the partitions before it: a hot source spreads over as many tasks as it needs.

    NULL text has size 0; NULL is a source of its own; repeated rows are laid out one after another; a source without
    words has target 0 and takes nothing. An empty table gives an empty result.
    """
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if keep else []
    table = written(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), *carried)
        .repartitionByRange(F.col("source"), F.col("size").desc(), F.col("doc_id"))
        .sortWithinPartitions(F.col("source"), F.col("size").desc(), F.col("doc_id"))
        .withColumn("place", F.monotonically_increasing_id()),
        "mix",
    ).withColumn("part", F.shiftright("place", 33))
    parts = table.groupBy("source", "part").agg(F.count("*").alias("rows"), F.min("place").alias("first"), F.sum("size").alias("words"))
    by_source = Window.partitionBy("source")
    parts = parts.withColumn("before", F.sum("rows").over(by_source.orderBy("part")) - F.col("rows")).withColumn("source_size", F.sum("words").over(by_source))
    targets = source_targets(table.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat)
    parts = (
        parts.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
        .select("p.source", "p.part", "p.first", "p.before", "p.source_size", "t.target",
                F.coalesce(F.try_divide(F.col("t.target"), F.col("p.source_size")), F.lit(0.0)).alias("rate"), _offset(F.col("p.source")).alias("start"))
    )
    parts = written(parts, "mix-parts")
    parts = F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts
    rank = F.col("p.before") + F.col("d.place") - F.col("p.first")
    crossed = F.floor(F.col("p.start") + (rank + 1) * F.col("p.rate")) - F.floor(F.col("p.start") + rank * F.col("p.rate"))
    return (
        table.alias("d").join(parts.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.part") == F.col("p.part")))
        .select("d.doc_id", "d.size", "p.source_size", "p.target", crossed.alias("copies"), *(["d.doc"] if keep else []))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    taken = mix(docs, keep=True, **how).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("doc.*")
