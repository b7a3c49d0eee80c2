"""What the operators of this subpackage share: word rules, fold rule, column helpers, components."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runqc.session import cut_lineage, in_tasks

LIBC = ctypes.CDLL(None)
#: A word is a longest run of characters other than these six.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def held_out(doc_id: Column, folds: int) -> Column:
    """True in the fold that nothing learns from: crc32 of the id as text, modulo ``folds``, is 0. NULL counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 with A-Z lowered; ``bytes.split`` cuts at exactly the six separators."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def give_back() -> None:
    """Returns freed memory to the system: a worker process is kept for later stages, and sits beside the executor's."""
    pa.default_memory_pool().release_unused()
    if hasattr(LIBC, "malloc_trim"):
        LIBC.malloc_trim(0)


ROOT = 0x2545F4914F6CDD1D
_powers: list[np.ndarray] = []


def rolling(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers, from the first on, of a 64-bit root and of its inverse, for hashes of stretches."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, n - 1).bit_length()
        _powers[:] = [np.multiply.accumulate(np.full(size, r, np.uint64)) for r in (ROOT, pow(ROOT, -1, 1 << 64))]
    return _powers[0], _powers[1]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each connected component, for nodes of ``edges(a, b)``, ids unsigned-free longs.

    Alternates two steps until nothing changes: every node links its larger neighbours to the least neighbour
    (large star), then its smaller neighbours to it (small star). Each step is one shuffle by node and shrinks to a
    star per component after about log(n) rounds; a hub's neighbours are joined, never collected. Tasks are as many as
    the edges are worth.
    """
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, n = None, now.count()
    for _ in range(rounds):
        both = in_tasks(now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), 2 * n)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = in_tasks(both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), n)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        now = cut_lineage(in_tasks(small.select("e.a", F.col("e.m").alias("b")).where("a <> b").distinct(), n))
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, n = state, state[0]
    raise RuntimeError(f"components did not settle in {rounds} rounds")
