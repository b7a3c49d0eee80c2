"""Near-duplicates by HyperMinHash registers: banded, estimated with correction for collisions, verified on full sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runqc.llm.common import components, give_back
from runqc.llm.simhash import shingle_set
from runqc.session import in_tasks, written

WORDS, SIMILAR = 5, (85, 100)
#: Buckets of a sketch, and bits of mantissa beside the leading-zero count in a register.
BUCKETS, MANTISSA = 256, 10
#: (bands, registers in a band): a pair of similarity s shares a band with probability 1 - (1 - s^registers)^bands, which
#: is 0.99996 at 0.85. Members of keys that more than so many nodes share meet under their rarest shingles instead.
SHAPE = (32, 8)
CROWDED = 16
#: Nodes whose names are sent to all tasks to pick their texts, 8 bytes each; more are picked by a shuffle.
SENT = 2_000_000
#: A pair is verified unless its estimate is so many standard errors below the bound.
ERRORS = 4
#: Members of a key that are compared with all others in the first round; eight times as many in each further one.
LEADERS = 4
#: Pairs with their sketches or sets that a task compares at least.
PAIRS = 2_000
#: Words of 64 bits in a parity: bits of a set's hashes, each flipped once for each hash that falls on it.
PARITY = 8
NO_ID = 2**63 - 1
_draw = np.random.default_rng(12)
#: Where an empty bucket looks for a register: the first bucket of its row that is not empty.
BORROW = np.stack([_draw.permutation(BUCKETS) for _ in range(BUCKETS)])
PLACES = np.stack([_draw.permutation(BUCKETS)[:SHAPE[1]] for _ in range(SHAPE[0])])
ODD = _draw.integers(0, 2**63, BUCKETS, np.uint64) * np.uint64(2) + np.uint64(1)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of a sorted set of 64-bit hashes, not empty: per bucket (leading zeros, mantissa) of its least hash.

    A hash's first bits name its bucket; so a bucket's least hash is the first in order. Empty buckets borrow the register
    of another, the same one in all sets that have the same buckets filled.
    """
    width = 64 - (BUCKETS.bit_length() - 1)
    at = np.searchsorted(shingles, np.arange(BUCKETS, dtype=np.uint64) << np.uint64(width))
    held = np.diff(np.r_[at, len(shingles)]) > 0
    least = shingles[np.minimum(at, len(shingles) - 1)] & np.uint64(2**width - 1)
    length = np.frexp(least.astype(np.float64))[1].astype(np.int64)
    mantissa = least >> np.maximum(0, length - 1 - MANTISSA).astype(np.uint64) & np.uint64(2**MANTISSA - 1)
    packed = ((width - np.minimum(length, width)) << MANTISSA | mantissa.astype(np.int64)).astype(np.uint16)
    return packed if held.all() else packed[np.where(held, np.arange(BUCKETS), BORROW[np.arange(BUCKETS), held[BORROW].argmax(1)])]


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A key per band and sketch: equal if the band's registers are."""
    chosen = sketches[:, PLACES].astype(np.uint64) + np.uint64(1)
    key = (chosen * ODD[:SHAPE[1]]).sum(-1, dtype=np.uint64) ^ np.arange(1, SHAPE[0] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key = (key ^ key >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    return (key ^ key >> np.uint64(32)).view(np.int64)


def parities(shingles: np.ndarray) -> np.ndarray:
    """The parity of a set of 64-bit hashes. Two differ in no more bits than the sets have elements that are not shared."""
    flips = np.bincount((shingles & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view("<i8")


@lru_cache(None)
def _filled(step: int) -> np.ndarray:
    """Probability of each register of a bucket that holds 2^(step/2) hashes on average, and one at least."""
    load = 2.0 ** (step / 2)
    edges = np.r_[[2.0 ** -(e + 1) * (1 + np.arange(2**MANTISSA) / 2**MANTISSA) for e in range(40)]]
    low = np.sort(np.r_[edges.ravel(), 1.0])
    return -np.diff(np.exp(-load * low)) / -math.expm1(-load)


@lru_cache(None)
def _collision(one: int, two: int) -> float:
    return float(_filled(one) @ _filled(two))


def collision(n: int, m: int) -> float:
    """Probability that two different least hashes leave the same register in sets of n and m."""
    step = lambda x: round(2 * math.log2(max(x, 1) / BUCKETS))
    return _collision(*sorted((step(n), step(m))))


def estimated(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sketches: the share of equal registers less what collisions add to it."""
    chance = np.array([collision(x, y) for x, y in zip(n.tolist(), m.tolist())])
    return ((a == b).mean(1) - chance) / (1 - chance)


def _sketched(docs: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, of, key, n, sketch, bands) per row; ``of`` names the text, ``key`` its set. Empty sets have n = 0 and no bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("of", pa.binary()), ("key", pa.binary()), ("n", pa.int64()), ("sketch", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                names, sizes, sketches = [], [], []
                for whole in part.column(2):
                    shingles = shingle_set(whole.as_py(), words)
                    names.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    sizes.append(len(shingles))
                    sketches.append(registers(shingles) if len(shingles) else None)
                keys = iter(band_keys(np.stack([s for s in sketches if s is not None] or [np.zeros(BUCKETS, np.uint16)])).tolist())
                made = (names, sizes, [None if s is None else s.tobytes() for s in sketches], [[] if s is None else next(keys) for s in sketches])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, f.type) for x, f in zip(made, list(schema)[2:]))], schema=schema)
        give_back()

    return _named(docs, text, F.col(doc_id).cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, of binary, key binary, n long, sketch binary, bands array<long>")


def _named(docs: DataFrame, text: str, *columns: Column) -> DataFrame:
    whole = F.col(text).cast("string")
    return docs.select(*columns, F.unhex(F.md5(F.coalesce(whole, F.lit("")).cast("binary"))).alias("of"), whole.alias("text"))


def _only(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows whose node is in ``nodes(node)``, a written table without repetitions: few names go to the rows, not the rows to them."""
    return rows.join(F.broadcast(nodes) if nodes.count() <= SENT else nodes, "node", "left_semi")


def _beside(pairs: DataFrame, columns: DataFrame, one: list[str], two: list[str]) -> DataFrame:
    """Written ``pairs(a, b)`` with the ``columns`` of both nodes, named ``one`` and ``two``.

    Where the pairs are few, only rows of their nodes are shuffled: later rounds have few pairs, and the sets are large.
    """
    def of(side: str) -> DataFrame:
        return columns.join(F.broadcast(pairs.select(F.col(side).alias("node")).distinct()), "node", "left_semi") if few else columns

    n = pairs.count()
    few = n <= SENT
    beside = pairs.join(of("a").toDF("a", *one), "a")
    return in_tasks(beside, n, PAIRS).join(of("b").toDF("b", *two), "b").select("a", "b", *(x for both in zip(one, two) for x in both))


def _full_sets(docs: DataFrame, rows: DataFrame, members: DataFrame, words: int, text: str) -> DataFrame:
    """(node, n, sketch, shingles) of the nodes in ``members``, made again from one text of each."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                shingles = [shingle_set(t.as_py(), words).tobytes() for t in part.column(3)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(shingles, pa.binary())], schema=schema)
        give_back()

    wanted = written(_only(rows.select(F.col("row").alias("node"), "of", "n", "sketch"), members), "hyperminhash-wanted")
    texts = _named(docs, text)
    if wanted.count() <= SENT:
        texts = texts.withColumn("short", F.xxhash64("of")).join(F.broadcast(wanted.select(F.xxhash64("of").alias("short"))), "short", "left_semi")
    texts = texts.groupBy("of").agg(F.first("text").alias("text"))
    return wanted.join(texts, "of").select("node", "n", "sketch", "text").mapInArrow(run, "node long, n long, sketch binary, shingles binary")


def _stacked(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def _hopeful(similar: tuple[int, int]):
    """Pairs whose corrected estimates allow the similarity."""
    bound = similar[0] / similar[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                near = estimated(_stacked(batch.column(4)), _stacked(batch.column(5)), n, m)
                error = np.sqrt(bound * (1 - bound) / np.minimum(np.minimum(n, m), BUCKETS))
                keep = pa.array(near >= bound - ERRORS * error)
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], names=["a", "b"])

    return run


def _verified(similar: tuple[int, int]):
    """Pairs that are similar by their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in batches:
            keep = []
            for a, one, two in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if held[0] != a:
                    held = (a, np.frombuffer(one.as_py(), np.uint64))
                other = np.frombuffer(two.as_py(), np.uint64)
                both = len(np.intersect1d(held[1], other, assume_unique=True))
                keep.append(similar[1] * both >= similar[0] * (len(held[1]) + len(other) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])
        give_back()

    return run


def shared_slots(slots: DataFrame) -> DataFrame:
    """The rows of ``slots`` whose slot several nodes share, with their ``count``."""
    # Counted by n, which is never NULL: both sides then have the same columns, and share the shuffles beneath.
    return slots.join(slots.groupBy("slot").agg(F.count("n").alias("count")).where("count > 1"), "slot")


def rarest_slots(crowded: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """(slot, node, n, place): each node of ``crowded(node, n, shingles)`` under its rarest shingles.

    Sets that are similar enough share one of the first n - least overlap + 1 shingles of each, in one order of all. The
    order is by how many nodes have a shingle, so what near copies have in common comes last, and a copy that differs in
    more than the bound allows has shingles of its own only: nothing is lost, and few pairs meet that are not similar.
    ``place`` is the shingle's in that order; a pair that shares it is judged by the overlap that the two sizes ask for.
    """
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("list", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = pa.array([np.frombuffer(s, np.int64) for s in part.column(2).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], lists], schema=schema)

    each = written(crowded.mapInArrow(run, "node long, n long, list array<long>").select("node", "n", F.explode("list").alias("slot")), "hyperminhash-shingles")
    rows = each.count()
    counted = in_tasks(each.join(each.groupBy("slot").count(), "slot"), rows)
    least = F.ceil(F.col("n") * similar[0] / similar[1] - F.lit(1e-9))
    place = F.row_number().over(Window.partitionBy("node").orderBy("count", "slot"))
    early = counted.withColumn("place", place).where((F.col("place") <= F.col("n") - least + 1) & (F.col("count") > 1))
    return in_tasks(early.select("slot", "node", "n", "place"), rows)


def _parities(sets: DataFrame) -> DataFrame:
    """(node, bits) of ``sets``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [parities(np.frombuffer(s.as_py(), np.uint64)) for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.list_(pa.int64()))], names=["node", "bits"])
        give_back()

    return sets.select("node", "shingles").mapInArrow(run, "node long, bits array<long>")


def _met(members: DataFrame, first: DataFrame, bits: DataFrame, similar: tuple[int, int], rows: int) -> DataFrame:
    """(a, b), a < b: pairs of one of ``rows`` members and a leader of a slot that may be similar and are of different components.

    A slot's leaders go to its members as one list, and a member's lists of all slots are merged before pairs become
    rows: near copies share very many slots, and a row for each would be made only to be dropped as a repetition. Pairs whose
    parities differ in more bits than similar sets of their sizes may differ in elements are none: of short texts that is
    most of the pairs of a group of copies on both sides of the bound.
    """
    # The least overlap of a similar pair of these sizes; its shared shingles begin that early in both orders.
    m, overlap = F.col("n"), lambda x: F.ceil((F.col("n") + x["n"]) * similar[0] / (similar[0] + similar[1]) - F.lit(1e-9))
    asked = lambda x: (
        (F.col("root") != x["root"]) & (F.least(m, x["n"]) * similar[1] >= F.greatest(m, x["n"]) * similar[0])
        & (F.col("place") <= m - overlap(x) + 1) & (x["place"] <= x["n"] - overlap(x) + 1)
        & (sum(F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get(x["bits"], F.lit(i)))) for i in range(PARITY)) <= m + x["n"] - 2 * overlap(x)))
    members, first = (in_tasks(x.join(bits, "node"), rows) for x in (members, first))
    leaders = first.groupBy("slot").agg(F.collect_list(F.struct("node", "root", "n", "place", "bits")).alias("leaders"))
    lists = members.join(leaders, "slot").select("node", F.array_distinct(F.transform(F.filter("leaders", asked), lambda x: x["node"])).alias("others")).where(F.size("others") > 0)
    lists = in_tasks(lists, rows, PAIRS)
    merged = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    pairs = in_tasks(merged, rows, PAIRS).select("node", F.explode("others").alias("other"))
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _open(slots: DataFrame, roots: DataFrame | None, rows: int) -> DataFrame:
    """Members of the slots whose members are of several components, with their ``root`` and its ``share`` of the slot.

    ``rows`` is how many ``slots`` has.
    """
    slots = in_tasks(slots, rows)
    members = slots.withColumn("root", F.col("node")) if roots is None else \
        in_tasks(slots.join(roots, "node", "left"), rows).withColumn("root", F.coalesce("root", "node"))
    shares = in_tasks(members.groupBy("slot", "root").agg(F.count("*").alias("share")), rows)
    several = in_tasks(shares.groupBy("slot").agg(F.count("*").alias("roots")).where("roots > 1").select("slot"), rows)
    found = in_tasks(members.join(several, "slot"), rows).join(shares, ["slot", "root"])
    return in_tasks(found.select("slot", "node", "n", "place", "root", "share"), rows)


def links(met: DataFrame, sets: DataFrame, similar: tuple[int, int] = SIMILAR, crowded: int = CROWDED) -> DataFrame | None:
    """(node, root): components of the nodes in ``met(slot, node, n, count)`` linked by a similarity of similar[0] / similar[1] at least.

    ``sets(node, n, sketch, shingles)``. Only components matter, so a key with many members does not make all their
    pairs: in each round some members of a key, those of its rarest components first, are compared with all others of
    other components, verified links merge components, and the compared leave the key. A key is done when its members
    are of one component. After the first round the members of keys with more than ``crowded`` nodes that are not done
    meet under their rarest shingles instead of those keys. Each pair that shares a key and is not connected otherwise is
    compared: the rounds go on until all keys are done, and leave out none. None if no nodes share a slot.
    """
    if met.isEmpty():
        return None
    all_ = rows = met.count()
    bits = written(_parities(sets), "hyperminhash-parities")
    open_, roots, compared, n_compared, leaders = met.withColumn("place", F.lit(0)), None, None, 0, LEADERS
    while True:
        members = written(_open(open_, roots, rows), "hyperminhash-members")
        rows = members.count()
        if not rows:
            return roots
        order = Window.partitionBy("slot").orderBy("share", F.xxhash64("node"), "node")
        first = members.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= leaders)
        first = written(in_tasks(first.select("slot", "node", "n", "place", "root"), rows), "hyperminhash-leaders")
        pairs = _met(members, first, bits, similar, rows)
        if compared is not None:
            pairs = pairs.join(in_tasks(compared, n_compared), ["a", "b"], "left_anti")
        pairs = written(in_tasks(pairs, rows, PAIRS), "hyperminhash-candidates")
        n = pairs.count()
        n_compared += n
        compared = pairs if compared is None else compared.unionAll(pairs)
        pairs = _beside(pairs, sets.select("node", "n", "sketch"), ["n", "one"], ["m", "two"])
        pairs = written(in_tasks(pairs, n, PAIRS).mapInArrow(_hopeful(similar), "a long, b long"), "hyperminhash-pairs")
        found = in_tasks(_beside(pairs, sets.select("node", "shingles"), ["one"], ["two"]), n, PAIRS).mapInArrow(_verified(similar), "a long, b long")
        edges = written(found, "hyperminhash-links")
        known = roots
        roots = components(edges if known is None else edges.unionAll(known.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        open_ = members.join(first, ["slot", "node"], "left_anti").select("slot", "node", "n", "place")
        if known is None:
            full_ = met.where(F.col("count") > crowded).withColumn("place", F.lit(0))
            rest = written(in_tasks(_open(full_, roots, all_).select("node").distinct(), all_), "hyperminhash-crowded")
            rarest = shared_slots(rarest_slots(sets.select("node", "n", "shingles").join(rest, "node").select("node", "n", "shingles"), similar))
            few = open_.join(met.where(F.col("count") <= crowded).select("slot", "node"), ["slot", "node"], "left_semi")
            open_ = few.unionByName(rarest.drop("count"))
        open_ = written(in_tasks(open_, rows), "hyperminhash-open")
        rows = open_.count()
        leaders *= 8


def near_copies(docs: DataFrame, words: int = WORDS, similar: tuple[int, int] = SIMILAR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``.

    A row's set holds the distinct shingles of ``words`` lower-cased words of its whole text, or all its words as one if
    they are fewer. Rows are linked if their sets' intersection is at least similar[0] / similar[1] of the union;
    ``component_id`` is the least doc_id reachable. Equal sets are one node and are never paired. Sets without words are
    linked with nothing: their component is their own doc_id. A NULL doc_id counts as the largest and is never kept;
    rows that repeat a kept doc_id in its component are kept with it. Other columns are ignored; an empty table gives an
    empty result.
    """
    rows = written(_sketched(docs, words, doc_id, text).select(F.monotonically_increasing_id().alias("row"), "*"), "hyperminhash-sketches")
    classes = rows.where("n > 0").groupBy("key").agg(F.min("row").alias("node"), F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("first"))
    classes = written(classes, "hyperminhash-classes")
    banded = rows.select(F.col("row").alias("node"), "n", "bands").join(classes.select("node"), "node").select(F.explode("bands").alias("slot"), "node", "n")
    met = written(shared_slots(banded), "hyperminhash-bands")
    members = written(met.select("node").distinct(), "hyperminhash-nodes")
    sets = written(_full_sets(docs, rows, members, words, text), "hyperminhash-sets")
    roots = links(met, sets, similar, CROWDED)
    placed = classes.withColumn("root", F.col("node")) if roots is None else \
        classes.join(roots, "node", "left").select("key", "first", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("least"))
    component = F.nullif(F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least")), F.lit(NO_ID))
    found = rows.select("doc_id", "key", "n").join(placed.join(least, "root").select("key", "least"), "key", "left")
    found = found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
