"""Near-duplicate lines across documents by a deletion-neighbourhood join; the earliest of each stays."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runqc.llm.common import give_back, rolling
from runqc.session import written

#: Lines of at least so many characters are near-duplicates at one edit; shorter ones only if equal.
LEAST_LENGTH = 16
#: Lines under one variant up to which pairs are compared; with more, their cut-out stretches are cut again.
CROWDED = 16
#: Lines under one variant up to which one task cuts them again in memory; with more, the finer variants become rows.
GROUP = 4096
#: Lines of this number at most are sent to every task as a list to fetch texts by; more are joined.
LISTED = 1_000_000


def lines_of(text: str | None) -> list[str]:
    """Lines between line feeds. A NULL text has none."""
    return [] if text is None else text.split("\n")


def line_hash(line: str) -> tuple[int, int]:
    """128 bits as two signed longs."""
    h = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
    return tuple(x - (1 << 64) if x >> 63 else x for x in (h & ((1 << 64) - 1), h >> 64))


def _mix(*parts: np.ndarray) -> np.ndarray:
    out = np.uint64(0x9E3779B97F4A7C15)
    for p in parts:
        out = (out ^ np.asarray(p).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        out = out ^ out >> np.uint64(32)
    return out


class Hashed:
    """Lines as one array of code points in which any stretch can be hashed in a few operations."""

    def __init__(self, lines: list[str]):
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        self.size = np.array([len(t) for t in lines], np.int64)
        self.start = np.cumsum(self.size) - self.size
        power, self.inverse = rolling(len(codes) + 1)
        self.sums = np.r_[np.uint64(0), np.cumsum(codes * power[:len(codes)], dtype=np.uint64)]

    def stretch(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the code points from a to b, places in the whole array."""
        return (self.sums[b] - self.sums[a]) * self.inverse[a]


def grains(size: np.ndarray) -> list[np.ndarray]:
    """Powers of two g that cut a line of this size into 4 to 8 stretches; near a limit of two, both."""
    of = lambda n: 1 << np.maximum(0, np.floor(np.log2(np.maximum(n, 4) / 4))).astype(np.int64)
    return [of(size - 1), of(size + 1)]


def variants(lines: list[str], least: int = LEAST_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, kept before, kept after, grain): every line with each stretch cut out in which one edit may lie.

    With grain g, an edit at place x leaves the g * (x // g) characters before and g * (m // g) of the m characters
    after it as they are, in both lines that it joins. So a line of size L, q = L // g, is filed under j stretches from
    its start with q - j or q - j - 1 from its end: at most 2q + 1 variants, and two lines at one edit share one. Their
    grains are equal but at limits of two, where lines are filed under both. At grain 1 at most one character is cut out,
    so lines that share a variant are at one edit.
    """
    hashed = Hashed(lines)
    ask = np.flatnonzero(hashed.size >= least)
    low, high = grains(hashed.size[ask])
    line = np.r_[ask, ask[low != high]]
    grain = np.r_[low, high[low != high]]
    q = hashed.size[line] // grain
    n = 2 * q + 1
    at = np.repeat(np.arange(len(line)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    before, after = step // 2, q[at] - (step + 1) // 2
    line, grain = line[at], grain[at]
    start, end = hashed.start[line], hashed.start[line] + hashed.size[line]
    kept_before, kept_after = before * grain, after * grain
    key = _mix(grain, before, after, hashed.stretch(start, start + kept_before), hashed.stretch(end - kept_after, end))
    return line, key.view(np.int64), kept_before, kept_after, grain


def finer(parents: np.ndarray, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``variants`` of cut-out stretches; equal keys also mean equal ``parents``, the keys they were cut out under."""
    of, key, before, after, grain = variants(stretches, 0)
    return of, _mix(parents[of], key).view(np.int64), before, after, grain


def near_in_group(stretches: list[str], rank: np.ndarray) -> np.ndarray:
    """Which stretches have one of a smaller ``rank`` within one edit: cut again and again, as long as several share a key."""
    near, owner, parents = np.zeros(len(stretches), bool), np.arange(len(stretches)), np.zeros(len(stretches), np.int64)
    while len(owner):
        of, key, before, after, grain = finer(parents, stretches)
        _, key_of, n = np.unique(key, return_inverse=True, return_counts=True)
        first = np.full(len(n), len(rank))
        np.minimum.at(first, key_of, rank[owner[of]])
        near[owner[of[(grain == 1) & (first[key_of] < rank[owner[of]])]]] = True
        on = np.flatnonzero((grain > 1) & (n[key_of] > 1))
        stretches = [stretches[o][b:len(stretches[o]) - a] for o, b, a in zip(of[on].tolist(), before[on].tolist(), after[on].tolist())]
        owner, parents = owner[of[on]], key[on]
    return near


def _line_table(docs: DataFrame, doc_id: str, text: str, keep: bool) -> DataFrame:
    """One row per document: ``row, doc_id, lines`` (hashes, NULL for blank lines), and ``doc`` with ``keep``."""
    kind = "array<struct<h: bigint, h2: bigint>>"
    element = pa.struct([("h", pa.int64()), ("h2", pa.int64())])

    @F.arrow_udf(kind)
    def hashes(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            found = [line_hash(x) if x.strip() else None for x in lines_of(t.as_py())]
            rows.append([None if f is None else {"h": f[0], "h2": f[1]} for f in found])
        found = pa.array(rows, pa.list_(element))
        give_back()
        return found

    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if keep else []
    table = docs.select(F.col(doc_id).cast("long").alias("doc_id"), hashes(F.col(text).cast("string")).alias("lines"), *carried)
    return written(table.withColumn("row", F.monotonically_increasing_id()), "lines")


def _variant_rows(docs: DataFrame, text: str) -> DataFrame:
    """(key, h): the variants of every line; a task files a line that it has just filed only once."""
    schema = pa.schema([("key", pa.int64()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                fresh = {}
                for t in batch.column(0).slice(at, 500):
                    for line in lines_of(t.as_py()):
                        if len(line) >= LEAST_LENGTH and line.strip() and (h := line_hash(line)[0]) not in seen:
                            seen.add(h)
                            fresh[h] = line
                if len(seen) > 500_000:
                    seen.clear()
                if fresh:
                    line, key, *_ = variants(list(fresh.values()))
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.fromiter(fresh, np.int64, len(fresh))[line])], schema=schema)

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "key long, h long")


def _texts(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(h, line) of the wanted lines, read from the documents again."""
    schema = pa.schema([("h", pa.int64()), ("line", pa.string())])
    listed = wanted.limit(LISTED + 1).toArrow().column("h").to_numpy()
    short = len(listed) <= LISTED
    shared = docs.sparkSession.sparkContext.broadcast(set(listed.tolist()) if short else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {}
            for t in batch.column(0):
                for line in lines_of(t.as_py()):
                    if len(line) >= LEAST_LENGTH and line.strip():
                        h = line_hash(line)[0]
                        if shared.value is None or h in shared.value:
                            found[h] = line
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())], schema=schema)

    lines = docs.select(F.col(text).cast("string")).mapInArrow(run, "h long, line string")
    return written((lines if short else lines.join(wanted, "h", "left_semi")).groupBy("h").agg(F.min("line").alias("line")), "line-texts")


def _near_earlier(docs: DataFrame, text: str, first: DataFrame) -> DataFrame:
    """(h) of lines that have an earlier line within one edit; ``first``: (h, place), the first place of each line."""
    rows = written(_variant_rows(docs, text), "line-variants")
    shared = rows.groupBy("key").agg(F.min("h").alias("least"), F.max("h").alias("most")).where("least < most")
    members = written(rows.join(shared.select("key"), "key").distinct(), "line-members")
    sizes = members.groupBy("key").count()
    some, full = (members.join(sizes.where(c).select("key"), "key") for c in (f"count <= {CROWDED}", f"count > {CROWDED}"))
    texts = _texts(docs, text, members.select("h").distinct())
    pairs = some.alias("a").join(some.select("key", F.col("h").alias("other")).alias("b"), "key").where("h < other").select("h", "other").distinct()
    near = (
        pairs.join(texts, "h").join(texts.select(F.col("h").alias("other"), F.col("line").alias("other_line")), "other")
        .where(F.levenshtein("line", "other_line", 1) >= 0).select("h", "other")
        .join(first, "h").join(first.select(F.col("h").alias("other"), F.col("place").alias("other_place")), "other")
        .select(F.when(F.col("place") < F.col("other_place"), F.col("other")).otherwise(F.col("h")).alias("h"))
    )
    return near.unionAll(_near_crowded(full.select("key", "h"), texts, first)).distinct()


def _cut_out(key: int, line: str, before: int, after: int) -> tuple[int, int]:
    """Characters kept under a key; those of a line's own variants (before = -1) are found again."""
    if before >= 0:
        return before, after
    _, keys, kept_before, kept_after, _ = variants([line])
    at = int(np.flatnonzero(keys == key)[0])
    return int(kept_before[at]), int(kept_after[at])


def _near_crowded(spans: DataFrame, texts: DataFrame, first: DataFrame) -> DataFrame:
    """(h) of lines that have an earlier one within one edit under a key of ``spans(key, h)``, which many lines share.

    Lines under one key differ in their cut-out stretches only. These are cut again, into finer variants, until at most
    one character is cut out. A task does so for all lines of a key, up to ``GROUP``; the finer variants of larger groups
    become rows, about a dozen for a line, and go on under their own keys.
    """
    spark, found = texts.sparkSession, None
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    answer = pa.schema([("h", pa.int64())])
    kept = [("before", pa.int32()), ("after", pa.int32()), ("exact", pa.bool_())]
    made = pa.schema([("key", pa.int64()), ("h", pa.int64()), *kept])

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        for key, group in groupby(rows, itemgetter(0)):
            _, names, lines, before, after, *place = zip(*group)
            b, a = _cut_out(key, lines[0], before[0], after[0])
            rank = np.empty(len(names), np.int64)
            rank[np.lexsort(place[::-1])] = np.arange(len(names))
            near = near_in_group([t[b:len(t) - a] for t in lines], rank)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(names, np.int64)[near])], schema=answer)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, h, line, b, a in zip(*(c.to_pylist() for c in batch.columns)):
                b, a = _cut_out(key, line, b, a)
                _, keys, before, after, grain = finer(np.array([key], np.int64), [line[b:len(line) - a]])
                columns = [keys, np.full(len(keys), h), before + b, after + a, grain == 1]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, made)], schema=made)

    spans = spans.select("key", "h", F.lit(-1).alias("before"), F.lit(-1).alias("after"))
    while True:
        counted = spans.join(spans.groupBy("key").count().where("count > 1"), "key")
        lines = counted.where(F.col("count") <= GROUP).drop("count").join(texts, "h").join(first, "h").select("key", "h", "line", "before", "after", "place.*")
        near = written(lines.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(solved, "h long").distinct(), "line-near")
        found = near if found is None else found.unionAll(near)
        large = counted.where(F.col("count") > GROUP).drop("count")
        if large.isEmpty():
            return found
        rows = large.join(texts, "h").select("key", "h", "line", "before", "after").repartition(tasks)
        rows = written(rows.mapInArrow(cut, "key long, h long, before int, after int, exact boolean"), "line-finer")
        # At most one character is cut out: all lines of a key are at one edit, and the earliest stays.
        exact = rows.where("exact").select("key", "h").join(first, "h")
        earliest = exact.groupBy("key").agg(F.min("place").alias("earliest"))
        found = found.unionAll(exact.join(earliest, "key").where("earliest < place").select("h"))
        spans = rows.where("not exact").select("key", "h", "before", "after")


def line_decisions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """Per row ``doc_id, n_lines, n_kept, dropped`` (line numbers from 0, ascending); with ``keep`` the row as ``doc``.

    A line goes if an earlier one is equal to it or, both having 16 characters or more, one edit away (a character
    inserted, deleted or replaced). Earlier means a smaller doc_id, then a smaller line number; NULL ids come last,
    rows of equal ids in the order they are stored. Blank lines always stay. NULL texts have no lines, an empty text
    one blank line; repeated rows lose the lines that an earlier one has; other columns are ignored; an empty table
    gives an empty result.
    """
    table = _line_table(docs, doc_id, text, keep)
    lines = table.select("row", "doc_id", F.posexplode("lines").alias("number", "line")).where("line is not null").select("row", "doc_id", "number", "line.*")
    place = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "row", "number")
    first = written(lines.groupBy("h", "h2").agg(F.min(place).alias("place")), "line-firsts")
    places = first.groupBy("h").agg(F.min("place").alias("place"))
    near = _near_earlier(docs, text, places).withColumn("near", F.lit(True))
    stays = first.join(near, "h", "left").where("near is null").select("place.row", "place.number")
    kept = stays.groupBy("row").agg(F.array_sort(F.collect_list("number")).alias("kept"))
    out = table.join(kept, "row", "left").withColumn("filled", F.expr("filter(transform(lines, (x, i) -> if(x is null, -1, i)), i -> i >= 0)"))
    out = out.withColumn("dropped", F.array_except("filled", F.coalesce("kept", F.array().cast("array<int>"))))
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("dropped")).cast("long").alias("n_kept"), "dropped", *(["doc"] if keep else []))


def without_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with the lines taken out of their texts that an earlier line makes needless."""
    decided = line_decisions(docs, doc_id, text, keep=True)
    cut = F.split(F.col("doc")[text], "\n", -1)
    left = F.array_join(F.transform(F.filter(F.arrays_zip(cut.alias("line"), F.sequence(F.lit(0), F.greatest(F.size(cut) - 1, F.lit(0))).alias("i")), lambda z: ~F.array_contains("dropped", z["i"])), lambda z: z["line"]), "\n")
    return decided.select("doc", left.alias("left")).select(*[F.col("left").alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns])
