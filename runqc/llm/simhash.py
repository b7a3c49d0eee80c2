"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runqc.llm.common import components, give_back, lower_words
from runqc.session import in_tasks, written

HASH_SEED = 42
#: Table entries under one segment value up to which pairs are compared; more are linked over shared midpoints instead.
CROWDED = 64
NO_ID = 2**63 - 1
#: Documents are similar if their sets of shingles of so many words have at least this Jaccard similarity.
WORDS, SIMILAR = 5, 0.8
#: Candidates share the minima of one band: at similarity s with probability 1 - (1 - s^3)^10, 0.9992 at 0.8.
BANDS, BAND_ROWS = 10, 3
FACTORS = np.random.default_rng(HASH_SEED).integers(0, 2**63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Texts under one band key up to which they meet there; more meet under their rarest shingles.
CROWDED_BAND = 32


def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit SimHash of the word shingles, repeats counted: a bit is 1 if set in over half the shingle hashes."""
    words = lower_words(text)
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    ones, n, hashed = np.zeros(64, np.int64), len(words) - shingle + 1, xxhash.xxh64_intdigest
    for at in range(0, n, 65536):
        h = [hashed(b" ".join(words[i:i + shingle]), HASH_SEED) for i in range(at, min(n, at + 65536))]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) per row; NULL, empty and blank texts have fingerprint 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], schema=schema)
        give_back()

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, fp long")


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    out = np.uint64(0x9E3779B97F4A7C15)
    for p in parts:
        out = (out ^ np.asarray(p, np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        out = out ^ out >> np.uint64(32)
    return out


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of a text of fewer words, of all its words."""
    found = lower_words(text)
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        found, words = [b" ".join(found)], 1
    known: dict[bytes, int] = {}
    for w in found:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w, HASH_SEED)
    h, n = np.fromiter((known[w] for w in found), np.uint64, len(found)), len(found) - words + 1
    return np.unique(_mixed(*(h[i:i + n] for i in range(words))))


def band_keys(shingles: np.ndarray) -> list[int]:
    """A key per band: equal in two sets if the band's minima are. None for an empty set."""
    if not len(shingles):
        return []
    least = np.full(len(FACTORS), 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[at:at + 4096, None] * FACTORS).min(0))
    rows = least.reshape(BANDS, BAND_ROWS)
    return _mixed(np.arange(BANDS), *rows.T).view(np.int64).tolist()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets that are not both empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _signatures(docs: DataFrame, shingle: int, words: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, key, fp, n, bands) per row; ``key`` is the hash of the text as it stands, ``n`` its distinct shingles."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, n, bands = [], [], []
            for t in batch.column(2):
                whole = t.as_py()
                shingles = shingle_set(whole, words)
                fp.append(fingerprint(whole, shingle))
                n.append(len(shingles))
                bands.append(band_keys(shingles))
            made = [pa.array(x, f.type) for x, f in zip((fp, n, bands), list(schema)[2:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], schema=schema)
        give_back()

    given = F.col(text).cast("string")
    return docs.select(F.col(doc_id).cast("long"), F.xxhash64(given), given).mapInArrow(run, "doc_id long, key long, fp long, n long, bands array<long>")


def _ball(value: Column, radius: int, width: int = 32) -> Column:
    """All (value, flips) within ``radius`` bits of a segment value."""
    masks = [(sum(1 << b for b in at), r) for r in range(radius + 1) for at in combinations(range(width), r)]
    return F.array(*[F.struct(value.bitwiseXOR(F.lit(m)).alias("key"), F.lit(r).alias("flips")) for m, r in masks])


def _halves(fp: Column) -> list[tuple[Column, Column]]:
    """(slot, the other half) for both 32-bit halves; a slot is the half's number and its value."""
    high, low = F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))
    return [(high, low), (low.bitwiseOR(F.lit(1 << 32)), high)]


def links(fps: DataFrame, bits: int = 2, crowded: int = CROWDED) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct ``fp`` at ``bits`` or fewer differing bits.

    Two halves of 32 bits: if the first differs in more than bits/2, the second differs in less than bits/2. So each
    fingerprint is filed under its exact half values and looks up every value in the ball of radius bits/2 around the
    first and bits/2 - 1 around the second; matches are verified on all 64 bits. Under a half value with more than
    ``crowded`` entries pairs would grow with the square of a group of near copies. There, the other half is enumerated
    too: entries file the ball of radius bits/2 around their other half, visitors that of the radius they have left.
    All that meet in one midpoint are within ``bits`` of each other, and all pairs within ``bits`` meet in one; so
    linking each to the least of the midpoint loses nothing and makes no pairs.
    """
    if bits < 2 or bits % 2:
        raise ValueError("midpoints need an even number of bits, 2 or more")
    radius, fp = bits // 2, F.col("fp")
    table = fps.select("fp", F.explode(F.array(*[slot for slot, _ in _halves(fp)])).alias("slot"))
    (first, _), (second, _) = _halves(fp)
    probe = fps.select("fp", F.explode(F.concat(_ball(first, radius), _ball(second, radius - 1))).alias("b")).select("fp", "b.key").withColumnRenamed("key", "slot")
    full = table.groupBy("slot").count().where(F.col("count") > crowded).select("slot")
    entries = table.join(full, "slot", "left_anti").select("slot", F.col("fp").alias("entry"), F.lit(False).alias("is_full"))
    met = probe.join(entries.unionAll(full.select("slot", F.lit(0).cast("long"), F.lit(True))), "slot")
    pairs = met.where(~F.col("is_full") & (fp < F.col("entry")) & (F.bit_count(fp.bitwiseXOR(F.col("entry"))) <= bits)).select(fp.alias("a"), F.col("entry").alias("b"))
    own = F.when(F.col("slot") < (1 << 32), _halves(fp)[0][0]).otherwise(_halves(fp)[1][0])
    rest = F.when(F.col("slot") < (1 << 32), _halves(fp)[0][1]).otherwise(_halves(fp)[1][1])
    around = F.array(*[_ball(F.col("rest"), radius - r) for r in range(radius + 1)])
    hubs = met.where("is_full").select("fp", "slot", F.bit_count(own.bitwiseXOR(F.col("slot"))).alias("flips"), rest.alias("rest")) \
        .select("fp", "slot", F.explode(F.element_at(around, F.col("flips") + 1)).alias("m")).select("fp", "slot", F.col("m.key").alias("mid"))
    least = hubs.groupBy("slot", "mid").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top")
    stars = hubs.join(least, ["slot", "mid"]).where("fp <> b").select(fp.alias("a"), "b")
    return pairs.unionAll(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row of ``docs``.

    ``component_id`` is the least doc_id reachable over links between fingerprints at ``bits`` or fewer differing bits.
    Copies share a fingerprint and are joined to it, never paired. NULL, empty and blank texts have fingerprint 0 and
    are linked like any other; a NULL doc_id counts as the largest; repeated rows are repeated in the result; other
    columns are ignored. An empty table gives an empty result.
    """
    rows = written(fingerprints(docs, shingle, doc_id, text), "simhash")
    fps = rows.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("first"))
    roots = components(links(fps.select("fp"), bits))
    placed = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = placed.join(least, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.nullif("component_id", F.lit(NO_ID)).alias("component_id"))


def _member_sets(docs: DataFrame, members: DataFrame, words: int, text: str) -> DataFrame:
    """(node, n, sketch, shingles) of the texts whose hashes are in ``members(node)``."""
    from runqc.llm.hyperminhash import SENT, registers

    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(t.as_py(), words) for t in part.column(1)]
                made = ([len(s) for s in sets], [registers(s).tobytes() for s in sets], [s.tobytes() for s in sets])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, f.type) for x, f in zip(made, list(schema)[1:]))], schema=schema)
        give_back()

    given = F.col(text).cast("string")
    texts = docs.select(F.xxhash64(given).alias("node"), given.alias("text"))
    few = members.count() <= SENT
    texts = texts.join(F.broadcast(members) if few else members, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    return texts.mapInArrow(run, "node long, n long, sketch binary, shingles binary")


def similar_links(docs: DataFrame, placed: DataFrame, words: int, similar: float, text: str) -> DataFrame:
    """Edges (a, b) between roots of ``placed`` (key, n, bands, root): texts of two roots with Jaccard >= ``similar``.

    Texts that share a band key are compared on their whole sets, in rounds that merge components, so that a group of
    near copies does not make all its pairs. Members of crowded keys meet under their rarest shingles instead, which
    similar sets share for certain: no text of such a group is left uncompared.
    """
    from runqc.llm.hyperminhash import links as merge
    from runqc.llm.hyperminhash import shared_slots

    bound = (round(similar * 1000), 1000)
    slots = placed.select(F.col("key").alias("node"), "n", F.explode("bands").alias("slot"))
    met = written(in_tasks(shared_slots(slots.select("slot", "node", "n")), BANDS * placed.count()), "similar-bands")
    members = written(in_tasks(met.select("node").distinct(), met.count()), "similar-members")
    sets = written(_member_sets(docs, members, words, text), "similar-sets")
    roots = merge(met, sets, bound, CROWDED_BAND)
    of = placed.select("key", F.col("root").alias("own"))
    if roots is None:
        return of.select(F.col("own").alias("a"), F.col("own").alias("b")).limit(0)
    pairs = in_tasks(roots.join(of.toDF("node", "a"), "node"), met.count()).join(of.toDF("root", "b"), "root")
    return pairs.select("a", "b").where("a <> b").distinct()


def keep_one(docs: DataFrame, shingle: int = 3, bits: int = 2, words: int = WORDS, similar: float = SIMILAR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when each group of near-duplicates keeps one: that of the least doc_id.

    Near-duplicates are linked by fingerprints as in ``near_duplicates``, and by a Jaccard similarity of at least
    ``similar`` between their sets of shingles of ``words`` words.

    Rows are told apart by doc_id and text together, so ids that are NULL (the largest) or repeated neither merge
    groups nor let copies stay; of rows equal in both one stays. Different texts that share a doc_id all stay if each is
    the first of its group.
    """
    rows = written(_signatures(docs, shingle, words, doc_id, text), "signatures")
    fps = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("first"))
    close = components(links(fps.select("fp"), bits))
    placed = rows.select("key", "fp", "n", "bands").dropDuplicates(["key"]).join(close.withColumnRenamed("node", "fp"), "fp", "left")
    placed = written(in_tasks(placed.select("key", "n", "bands", F.coalesce("root", "fp").alias("root")), rows.count()), "similar-placed")
    roots = components(close.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(similar_links(docs, placed, words, similar, text)))
    least = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("first", F.coalesce("root", "fp").alias("root"))
    least = least.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.key")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["key"] == b["key"])
    copies = rows.groupBy("doc_id", "key").count()
    kept = copies.join(least, same(copies, least), "left_semi")
    whole = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text).cast("string")).alias("of"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    found = whole.join(kept, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("of") == F.col("key"))).select("id", "of", "doc", "count")
    return found.where("count = 1").select("doc.*").unionAll(found.where("count > 1").dropDuplicates(["id", "of"]).select("doc.*"))
