"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP = 10
#: Distinct codes of one index and queries of one task. Both bound what a task holds; every code and query is in some.
BLOCK_CODES, BLOCK_QUERIES = 100_000, 4_096
SALTS = 64


def binary_codes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, code): one bit per component, set if it is above 0. NULL vectors, and vectors with NULLs, have no code."""
    schema = pa.schema([("id", pa.int64()), ("code", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for v in batch.column(1):
                x = None if not v.is_valid else v.values
                codes.append(None if x is None or not len(x) or x.null_count else np.packbits(x.to_numpy() > 0).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.binary())], schema=schema)

    return vectors.select(F.col(vec_id).cast("long"), F.col(embedding).cast("array<double>")).mapInArrow(run, "id long, code binary").where("code is not null")


@lru_cache(None)
def _masks(width: int, radius: int) -> np.ndarray:
    """Segment values with exactly ``radius`` of ``width`` bits set."""
    return np.array([sum(1 << b for b in at) for at in combinations(range(width), radius)], np.int64)


class SegmentTables:
    """One table per segment of the codes: segment value -> codes that have it."""

    def __init__(self, codes: np.ndarray):
        """``codes``: (n, bytes) uint8."""
        self.codes = codes
        bits = np.unpackbits(codes, axis=1)
        parts = max(1, min(bits.shape[1], round(bits.shape[1] / max(4.0, math.log2(max(2, len(codes)))))))
        cuts = np.linspace(0, bits.shape[1], max(parts, -(-bits.shape[1] // 16)) + 1).astype(int)
        self.spans = list(zip(cuts[:-1], cuts[1:]))
        self.tables = []
        for a, b in self.spans:
            value = self._value(bits[:, a:b])
            first = np.r_[0, np.cumsum(np.bincount(value, minlength=1 << (b - a)))]
            self.tables.append((first, np.argsort(value, kind="stable")))

    @staticmethod
    def _value(bits: np.ndarray) -> np.ndarray:
        return bits.astype(np.int64) @ (1 << np.arange(bits.shape[-1], dtype=np.int64))

    def nearest(self, code: np.ndarray, k: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k codes least by (distance, ``order``), with distances.

        Radius r in all m segments covers every code within m(r + 1) - 1 bits: a code missed in each segment differs in
        r + 1 bits of each. The radii grow until the kth verified distance is within what is covered.
        """
        bits, m = np.unpackbits(code), len(self.spans)
        values = [int(self._value(bits[a:b])) for a, b in self.spans]
        seen, found, distance = np.zeros(len(self.codes), bool), [], []
        for radius in range(max(b - a for a, b in self.spans) + 1):
            for value, (a, b), (first, members) in zip(values, self.spans, self.tables):
                if radius > b - a:
                    continue
                keys = value ^ _masks(b - a, radius)
                lo, n = first[keys], first[keys + 1] - first[keys]
                hit = members[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
                hit = hit[~seen[hit]]
                if len(hit):
                    seen[hit] = True
                    found.append(hit)
                    distance.append(np.bitwise_count(self.codes[hit] ^ code).sum(1, dtype=np.int64))
            if found:
                d = np.concatenate(distance)
                if len(d) >= k and np.partition(d, k - 1)[k - 1] <= m * (radius + 1) - 1:
                    break
        at, d = np.concatenate(found), np.concatenate(distance)
        best = np.lexsort((order[at], d))[:k]
        return at[best], d[best]


def _search(k: int):
    out = pa.schema([("query_id", pa.int64()), ("neighbor_id", pa.int64()), ("distance", pa.int64())])

    def run(table: pa.Table, queries: pa.Table) -> pa.Table:
        rows: list[list[np.ndarray]] = [[], [], []]
        if table.num_rows and queries.num_rows:
            matrix = lambda t: np.stack([np.frombuffer(c, np.uint8) for c in t.column("code").to_pylist()])
            ids = [np.sort(np.array(i, np.int64)) for i in table.column("ids").to_pylist()]
            least, index = np.array([i[0] for i in ids]), SegmentTables(matrix(table))
            for query, code in zip(queries.column("id").to_pylist(), matrix(queries)):
                at, d = index.nearest(code, k, least)
                near = np.concatenate([ids[i] for i in at])
                far = np.repeat(d, [len(ids[i]) for i in at])
                best = np.lexsort((near, far))[:k]
                for column, value in zip(rows, (np.full(len(best), query), near[best], far[best])):
                    column.append(value)
        return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in rows], schema=out)

    return run


def top_k(vectors: DataFrame, k: int = TOP, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, neighbor_id, distance, rank``: for each row whose id is divisible by ``every``, its ``k`` nearest rows.

    All rows with a code are candidates, the query included; order is by Hamming distance, then id. Rows with one code
    are one entry with its least k ids, found in salted steps, so a code that a third of the rows share is one entry as
    well. Distinct codes go to blocks of a bounded size, queries to chunks of a bounded size; each pair of block and
    chunk is one index searched exactly, and the best k of a query's blocks are merged. Codes of other lengths are not
    compared. NULL vectors and ids are left out; repeated rows count each; an empty table gives an empty result.
    """
    codes = binary_codes(vectors, vec_id, embedding).where("id is not null")
    salted = Window.partitionBy("code", "salt").orderBy("id")
    members = codes.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k)
    members = members.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id", "salt"))).where(F.col("n") <= k)
    table = members.groupBy("code").agg(F.collect_list("id").alias("ids"))
    queries = codes.where(F.col("id") % every == 0)
    blocks = max(1, -(-table.count() // BLOCK_CODES))
    chunks = max(1, -(-queries.count() // BLOCK_QUERIES))
    pick = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    width, key = F.length("code").alias("width"), ["width", "block", "chunk"]
    table = table.select("code", "ids", width, pick("code", blocks).alias("block"), every_of(chunks).alias("chunk"))
    asked = queries.select("id", "code", width, pick("id", chunks).alias("chunk"), every_of(blocks).alias("block"))
    found = table.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_search(k), "query_id long, neighbor_id long, distance long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id")))
    return ranked.where(F.col("rank") <= k)
