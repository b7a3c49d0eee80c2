"""Hard-negative mining by a secondary-sort shuffle."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runqc.session import written

POSITIVES, NEGATIVES = 5, 3
#: A negative is hard if its score lies between these hundredths of the positive's.
LOW, HIGH = 50, 95
#: Anchors and rows that one task scores against each other. Both bound what a task holds; all anchors meet all rows.
CHUNK, BLOCK = 8_192, 8_192
TILE = 256
NO_ID, TOP = 2**63 - 1, 2**63 - 1
KEY = struct.Struct(">QQQ")
POSITIVE, NEGATIVE = 1, 0


def prepared(vectors: DataFrame, anchor: Column, scale: float, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(row, id, label, v, is_anchor): rows with a label and a finite vector, components as floor(scale * x)."""
    named = vectors.select(
        F.coalesce(F.col(vec_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("x"),
        F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return named.where(F.col("label").isNotNull() & F.col("x").isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("row"), "id", F.xxhash64("label").alias("label"), F.transform("x", lambda c: F.floor(c * scale)).alias("v"), "is_anchor")


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    """Components, a row a vector; short vectors are filled up with zeros."""
    v = table.column("v").combine_chunks()
    flat, n = v.flatten().to_numpy(zero_copy_only=False), np.diff(v.offsets.to_numpy())
    out = np.zeros((len(n), width), np.int64)
    at = np.arange(width) < n[:, None]
    out[at] = flat
    return out


def _width(*tables: pa.Table) -> int:
    return max([1, *(max(t.column("v").combine_chunks().value_lengths().to_pylist(), default=0) for t in tables)])


class _Scores:
    """Inner products of some anchors with the rows of a block, the rows in order of their ids."""

    def __init__(self, anchors: pa.Table, rows: pa.Table):
        rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])
        width = _width(anchors, rows)
        self.a, self.b = _matrix(anchors, width), _matrix(rows, width)
        # Exact in doubles while no sum reaches 2^53; integers of any length beyond.
        bound = float(np.abs(self.a).max(initial=0)) * float(np.abs(self.b).max(initial=0)) * width
        kind = np.float64 if bound < 2**53 else object
        self.a, self.b = self.a.astype(kind), self.b.astype(kind)
        self.ids, self.rows, self.labels = (rows.column(c).to_numpy() for c in ("id", "row", "label"))

    def of(self, which: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        s = self.a[which] @ self.b[at].T
        return s.astype(np.int64) if s.dtype == np.float64 else np.clip(s, -TOP, TOP).astype(np.int64)


def _best(scores: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """The first k of ``among`` by falling score; equal scores stay in their order."""
    s = scores[among]
    if len(s) > k:
        keep = s >= np.partition(s, -k)[-k]
        among, s = among[keep], s[keep]
    return among[np.argsort(-s, kind="stable")[:k]]


PACKED = pa.schema([("key", pa.binary()), ("kind", pa.int8()), ("anchor_id", pa.int64())])
PACKED_DDL = "key binary, kind byte, anchor_id long"


def _packed(rows: list[int], scores: list[int], ids: list[int], kind: int, anchor_ids: list[int]) -> pa.Table:
    """Keys that sort by anchor, then falling score, then id."""
    keys = [KEY.pack(r, TOP - s, i + 2**63) for r, s, i in zip(rows, scores, ids)]
    return pa.table([pa.array(keys, pa.binary()), pa.array([kind] * len(keys), pa.int8()), pa.array(anchor_ids, pa.int64())], schema=PACKED)


def _pick(choose: Callable, kind: int):
    """Scores a chunk of anchors against a block of rows and packs the rows that ``choose`` leaves for each anchor."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[int]] = [[], [], [], []]
        if anchors.num_rows and rows.num_rows:
            scores, whole = _Scores(anchors, rows), np.arange(rows.num_rows)
            own, ids, labels = (anchors.column(c).to_numpy() for c in ("row", "id", "label"))
            extra = anchors.column("scores").to_pylist() if "scores" in anchors.column_names else [None] * len(own)
            for label in np.unique(labels):
                among = whole[(scores.labels == label) == (kind == POSITIVE)]
                mine = np.flatnonzero(labels == label)
                for at in range(0, len(mine), TILE):
                    tile = mine[at:at + TILE]
                    for i, s in zip(tile, scores.of(tile, among)):
                        near = among[choose(s, scores.rows[among] != own[i], extra[i])]
                        for column, value in zip(out, (np.full(len(near), own[i]), s[np.searchsorted(among, near)], scores.ids[near], np.full(len(near), ids[i]))):
                            column.extend(value.tolist())
        return _packed(out[0], out[1], out[2], kind, out[3])

    return run


def _first_positives(k: int):
    return lambda s, other, _: _best(s, np.flatnonzero(other), k)


def _in_windows(k: int, low: int, high: int):
    """The first k of each positive's window: those that the whole order can have as its first k."""

    def choose(s: np.ndarray, other: np.ndarray, positives: list[int]) -> np.ndarray:
        found = [_best(s, np.flatnonzero((s >= -(-low * p // 100)) & (s <= high * p // 100)), k) for p in set(positives)]
        return np.unique(np.concatenate(found))

    return choose


def _as_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positives as keys again: (row, anchor_id, id, score)."""
    for b in batches:
        row, anchor_id, other, score = (c.to_pylist() for c in b.columns)
        yield from _packed(row, score, other, POSITIVE, anchor_id).to_batches()


def _meet(anchors: DataFrame, rows: DataFrame, chunks: int, blocks: int, run: Callable) -> DataFrame:
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select("*", deal(chunks).alias("chunk")).select("*", every(blocks).alias("block"))
    right = rows.toDF(*rows.columns).select("*", deal(blocks).alias("block")).select("*", every(chunks).alias("chunk"))
    return left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInArrow(run, PACKED_DDL)


def secondary_sorted(packed: DataFrame, stream: Callable[[Iterator], Iterator[tuple]], schema: str) -> DataFrame:
    """Runs ``stream`` over the packed keys of each partition in order; an anchor's keys are together in one partition.

    The shuffle spills to disk while it sorts, the iterator reads from it: no anchor's keys are held at once.
    """
    spark = packed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = packed.rdd.map(lambda r: (bytes(r[0]), (r[1], r[2])))
    deal = lambda key: (int.from_bytes(key[:8], "big") * 0x9E3779B97F4A7C15 >> 20) % (1 << 40)
    return spark.createDataFrame(keyed.repartitionAndSortWithinPartitions(parts, deal).mapPartitions(stream), schema, verifySchema=False)


def _unpacked(pairs: Iterator) -> Iterator[tuple[int, int, int, int, int]]:
    for key, (kind, anchor_id) in pairs:
        row, fall, up = KEY.unpack(key)
        yield row, TOP - fall, up - 2**63, kind, anchor_id


def _open_positives(k: int):
    def stream(pairs: Iterator) -> Iterator[tuple]:
        before, n = None, 0
        for row, score, other, _, anchor_id in _unpacked(pairs):
            n = n + 1 if row == before else 1
            before = row
            if n <= k:
                yield row, anchor_id, other, score

    return stream


def _open_windows(k: int, low: int, high: int):
    """Positives open a window of scores below their own; negatives are emitted as they pass through open windows.

    A window is (positive, score, emitted). Windows are as many as positives and each emits k rows. At score 0 a
    positive's window is 0 itself, so negatives of score 0 that come before it (by their ids) are remembered, k of them.
    """

    def stream(pairs: Iterator) -> Iterator[tuple]:
        before, windows, zeros = None, [], []
        for row, score, other, kind, anchor_id in _unpacked(pairs):
            if row != before:
                before, windows, zeros = row, [], []
            if kind == POSITIVE:
                windows.append([other, score, 0])
                entering = [(windows[-1], z) for z in zeros] if score == 0 else []
            else:
                windows = [w for w in windows if w[2] < k and 100 * score >= low * w[1]]
                entering = [(w, other) for w in windows if 100 * score <= high * w[1]]
                if score == 0 and len(zeros) < k:
                    zeros.append(other)
            for w, negative in entering:
                w[2] += 1
                yield anchor_id, w[0], w[2], negative, w[1], score

    return stream


def hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``anchor`` holds.

    A row's score is the integer inner product of the vectors' floor(scale * x) with the anchor's. An anchor's positives
    are its first ``positives`` other rows of its label, by falling score, then id. For each, the first ``negatives``
    rows of other labels whose score lies within ``low`` and ``high`` hundredths of the positive's are returned.

    Anchors in chunks meet all rows in blocks; both are dealt by row, so a label or id that a third of the rows share is
    spread evenly. A block passes on only what can be among the first: per anchor its first positives, and, once the
    positives are known, the first negatives of each window. Both passes end in a secondary sort of packed (anchor,
    falling score, id) keys, whose iterator opens the windows and emits.

    Rows with a NULL label, a NULL vector, or a NULL or non-finite component take no part. Missing components count as
    0, so an empty vector scores 0. A NULL id comes last among equals and is returned as NULL; repeated rows count each,
    rows other than the anchor's own may share its id. Scores beyond 64 bits are held at the limit. Other columns are
    ignored. An empty table gives an empty result.
    """
    rows = written(prepared(vectors, anchor, scale, vec_id, embedding, label), "negatives-rows")
    anchors = rows.where("is_anchor").select("row", "id", "label", "v")
    rows = rows.select("row", "id", "label", "v")
    blocks = max(1, -(-rows.count() // BLOCK))
    chunks = max(1, -(-anchors.count() // CHUNK))
    near = _meet(anchors, rows, chunks, blocks, _pick(_first_positives(positives), POSITIVE))
    first = secondary_sorted(near, _open_positives(positives), "row long, anchor_id long, id long, score long")
    first = written(first, "negatives-positives")
    asked = anchors.join(first.groupBy("row").agg(F.collect_list("score").alias("scores")), "row")
    hard = _meet(asked, rows, chunks, blocks, _pick(_in_windows(negatives, low, high), NEGATIVE))
    opening = first.mapInArrow(_as_packed, PACKED_DDL)
    found = secondary_sorted(opening.unionAll(hard), _open_windows(negatives, low, high), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    known = lambda c: F.nullif(c, F.lit(NO_ID)).alias(c)
    return found.select(known("anchor_id"), known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")
