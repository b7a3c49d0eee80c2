"""Read-to-reference operators: matching, classification, demultiplexing, error profiles."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runqc.functions import banded, kernels, phred
from runqc.functions import sequence as sq
from runqc.functions.common import col_of, first_match
from runqc.operators.joins import balanced, range_join
from runqc.session import written

def edit_distance(a: Column | str, b: Column | str, k: int | None = None) -> Column:
    """Global distance, case-insensitive; with ``k`` the answer beyond it is -1."""
    a, b = F.upper(col_of(a)), F.upper(col_of(b))
    return F.levenshtein(a, b) if k is None else F.levenshtein(a, b, k)


def normalised_distance(distance: Column | str, a: Column | str, b: Column | str) -> Column:
    d = col_of(distance)
    longest = F.greatest(F.length(col_of(a)), F.length(col_of(b)))
    return F.when(d >= 0, F.coalesce(F.try_divide(d.cast("double"), longest), F.lit(0.0)))


def locate_udf(mode: str):
    """Arrow UDF (query, target) -> struct(distance, start, end) for NW, SHW or HW."""

    @F.pandas_udf("distance int, start int, end int")
    def run(query: pd.Series, target: pd.Series) -> pd.DataFrame:
        return kernels.locate_pairs(query, target, mode).astype("int32")

    return run


def cigar_udf():
    """Arrow UDF (query, target, distance) -> extended CIGAR; a NULL distance is found out."""

    @F.pandas_udf("string")
    def run(query: pd.Series, target: pd.Series, distance: pd.Series) -> pd.Series:
        return pd.Series([banded.cigar(ops) for ops in banded.paths(query, target, distance)])

    return run


def alignment_totals(cigar: Column | str) -> Column:
    """Edits, and bases used of both sides, of an extended CIGAR."""
    runs = lambda ops: F.aggregate(
        F.regexp_extract_all(col_of(cigar), F.lit(f"(\\d+)[{ops}]"), F.lit(1)), F.lit(0).cast("long"), lambda n, x: n + x.cast("long"))
    return F.struct(runs("XID").alias("edits"), runs("=XI").alias("query_bases"), runs("=XD").alias("target_bases"))


def ratio_distance(seq: str, ref: str, ratio: float = 1.5) -> Column:
    """Global distance for reads up to ``ratio`` x reference, else the reference as an infix.

    The infix search is handed only the reads it answers for.
    """
    s, r = F.upper(F.col(seq)), F.upper(F.col(ref))
    n, m = F.length(seq), F.length(ref)
    long = n > m * F.lit(ratio)
    infix = locate_udf("HW")(F.when(long, r).otherwise(""), F.when(long, s).otherwise(""))["distance"]
    distance = F.when(long, infix).otherwise(F.levenshtein(s, r))
    return F.when(n == 0, m).otherwise(F.least(distance, F.greatest(n, m)))


def distance_columns(reads: DataFrame, panel: Mapping[str, str], seq: str = "seq") -> DataFrame:
    """Distance matrix as one row per read and one column per reference of ``panel`` (name -> sequence).

    The panel is the caller's own list of names. For a table of references take ``similarity_join``.
    """
    return reads.select("*", *[edit_distance(seq, F.lit(ref)).alias(name) for name, ref in panel.items()])


#: Bases of an unchanged piece. Twelve bases have 16.8 million spellings, so pieces are selective.
PIECE = 12
#: References of one block, and sequences of one chunk and their bases, that are held against each other.
BLOCK, CHUNK, CHUNK_BASES = 1024, 32768, 1 << 23
#: Chunks from which on each holds more, up to so many times as much: sequences of similar length are worked on together.
ENOUGH, MORE = 32, 4
#: Partitions for each chunk.
SPREAD = 8


def _named(seq: Column) -> Column:
    """Sixteen bytes that stand for a sequence where its text is not needed."""
    return F.unhex(F.md5(seq.cast("binary")))


def _sequences(reads: DataFrame, seq: str) -> DataFrame:
    u = reads.select(F.upper(F.col(seq)).alias("u")).where("u is not null").distinct()
    return u.select(_named(F.col("u")).alias("id"), "u", F.length("u").alias("n"))


def _within_pieces(u: DataFrame, r: DataFrame) -> DataFrame:
    """(id, d, ord, ref_id): pairs whose distance is below the reference's number of pieces, and equal texts.

    With fewer edits than a reference has pieces, one piece survives unchanged and is shifted by as many bases at most.
    Pieces and the windows of a sequence meet as hashes; texts are fetched once for each pair that is left.
    """
    pieces = F.floor(F.col("m") / PIECE).cast("int")
    ref_keys = r.where(F.col("m") >= 2 * PIECE).select(
        "ord", "ref_id", "m", (pieces - 1).alias("k"), F.explode(F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.struct(
            (i * PIECE).alias("at"), F.xxhash64(F.substring(F.col("s"), i * PIECE + 1, F.lit(PIECE))).alias("key")))).alias("p"))
    windows = F.transform(F.sequence(F.lit(1), F.col("n") - PIECE + 1), lambda i: F.struct(
        (i - 1).alias("from"), F.xxhash64(F.substring(F.col("u"), i, F.lit(PIECE))).alias("key")))
    read_keys = u.where(F.col("n") >= PIECE).select("id", "n", F.explode(windows).alias("w")).select("id", "n", "w.*")
    met = read_keys.join(ref_keys.select("ord", "ref_id", "m", "k", "p.*"), "key")
    near = met.where((F.abs(F.col("from") - F.col("at")) <= F.col("k")) & (F.abs(F.col("n") - F.col("m")) <= F.col("k")))
    pairs = near.select("id", "ord", "ref_id", "k").distinct()
    texts = balanced(pairs.join(u.select("id", "u"), "id").join(r.select("ord", "ref_id", "s"), ["ord", "ref_id"]))
    found = texts.select("id", F.call_function("levenshtein", F.col("u"), F.col("s"), F.col("k")).alias("d"), "ord", "ref_id").where("d >= 0")
    equal = u.join(r, F.col("u") == F.col("s")).select("id", F.lit(0).alias("d"), "ord", "ref_id")
    return found.unionAll(equal)


def _closest(refs: pa.Table, reads: pa.Table) -> pa.Table:
    """The nearest reference of a block for every sequence of a chunk, the first in order on ties."""
    refs = refs.sort_by([("ord", "ascending"), ("ref_id", "ascending")])
    which, d = np.empty(0, int), np.empty(0, int)
    if refs.num_rows and reads.num_rows:
        which, d = kernels.Panel(refs.column("s").to_pylist()).closest(reads.column("u").to_pylist())
    else:
        reads = reads.slice(0, 0)
    found = refs.take(pa.array(which, pa.int64()))
    return pa.table({"id": reads.column("id"), "d": pa.array(d, pa.int32()), "ord": found.column("ord"), "ref_id": found.column("ref_id")})


def _scanned(rest: DataFrame, r: DataFrame, u: DataFrame) -> DataFrame:
    """(id, d, ord, ref_id): for every sequence in ``rest(id, u)`` the nearest reference of every block.

    Blocks of references meet chunks of sequences, both of bounded size. ``u``, a table that is at hand, bounds the number
    of sequences and their bases. A chunk is few bytes and much work, so chunks are dealt over more partitions than there
    are of them, which are not joined by their bytes.
    """
    blocks = F.greatest(F.ceil(r.agg(F.count("*").alias("n")).scalar() / BLOCK).cast("long"), F.lit(1))
    least = math.ceil(u.agg(F.sum(F.lit(1 / CHUNK) + F.col("n") / CHUNK_BASES)).first()[0] or 0)
    chunks = max(1, min(least, ENOUGH), -(-least // MORE))
    left = r.withColumn("block", F.pmod(F.xxhash64("ord", "ref_id"), blocks)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = rest.select("id", "u", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    ddl = f"id binary, d int, ord {r.schema['ord'].dataType.simpleString()}, ref_id {r.schema['ref_id'].dataType.simpleString()}"
    left, right = (x.repartition(SPREAD * chunks, "block", "chunk").groupBy("block", "chunk") for x in (left, right))
    return left.cogroup(right).applyInArrow(_closest, ddl)


def best_reference(reads: DataFrame, refs: DataFrame, seq: str = "seq") -> DataFrame:
    """Closest reference (ref_id, ref_seq, ord) of every read by global distance, first in order on ties.

    Equal sequences are aligned once; they are worked out once, into a table, as several steps read them. Where references
    fill more than one block, candidates share an unchanged piece; the
    closest of them is the answer if its distance is covered, that is if every closer reference would have shared a piece
    as well. The remaining sequences are held against all references, block by block.
    """
    u = reads.select(F.upper(F.col(seq)).alias("u")).distinct().select(_named(F.col("u")).alias("id"), "u", F.length("u").alias("n"))
    u = written(u, "sequences").where("u is not null")
    r = refs.select("ord", "ref_id", F.upper("ref_seq").alias("s"), F.length("ref_seq").alias("m"))
    many = r.agg(F.count("*").alias("n")).scalar() > BLOCK
    least = lambda df: df.groupBy("id").agg(F.min(F.struct("d", "ord", "ref_id")).alias("b"))
    tried = u.where(many)
    tried = tried.join(least(_within_pieces(tried, r)), "id", "left").withColumn("limit", F.col("b.d"))
    # A closer reference has n - d bases at least.
    covered = F.coalesce((F.col("limit") == 0) | (F.col("limit") < F.floor((F.col("n") - F.col("limit")) / PIECE)), F.lit(False))
    rest = u.where(~many).select("id", "u").unionAll(tried.where(~covered).select("id", "u"))
    best = tried.where(covered).select("id", "b").unionAll(least(_scanned(rest, r, u)))
    hits = best.select(F.col("id").alias("_id"), F.col("b.ref_id").alias("ref_id"), F.col("b.d").alias("edit_distance"))
    # Never NULL, so that the reads are not filtered by it, which would work it out twice.
    name = F.coalesce(_named(F.upper(F.col(seq))), F.lit(b""))
    return reads.withColumn("_id", name).join(hits, "_id").drop("_id")


def similarity_join(reads: DataFrame, refs: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """Every (distinct sequence, reference) pair within ``k`` edits, exactly.

    A reference is cut into k+1 pieces. Within k edits one piece survives unchanged and is shifted by at most k, so
    candidates come from an equi join on a hash of (reference length, piece, text). Keys carry ids; the texts of a pair
    are fetched once, when it is verified.
    """
    u = _sequences(reads, seq)
    r = refs.select("ref_id", F.upper("ref_seq").alias("s"))
    pieces = k + 1
    cut = lambda n, i: F.floor(n * i / pieces).cast("int")
    every = F.sequence(F.lit(0), F.lit(k))
    key = lambda text, n, i, at: F.xxhash64(n, i, F.substring(text, at + 1, cut(n, i + 1) - cut(n, i)))
    ref_keys = r.select("ref_id", F.explode(F.transform(every, lambda i: key(F.col("s"), F.length("s"), i, cut(F.length("s"), i)))).alias("key"))
    offsets = F.sequence(F.lit(-k), F.lit(k))
    tried = u.select("id", "u", F.col("n"), F.explode(F.transform(offsets, lambda o: F.length("u") + o)).alias("m")).where("m >= 0")
    tried = tried.select("id", "u", "n", "m", F.explode(every).alias("i")).select("*", F.explode(offsets).alias("o"))
    at = cut(F.col("m"), F.col("i")) + F.col("o")
    fits = (at >= 0) & (at + cut(F.col("m"), F.col("i") + 1) - cut(F.col("m"), F.col("i")) <= F.col("n"))
    read_keys = tried.where(fits).select("id", key(F.col("u"), F.col("m"), F.col("i"), at).alias("key"))
    pairs = read_keys.join(ref_keys, "key").select("id", "ref_id").distinct()
    texts = pairs.join(u.select("id", "u"), "id").join(r, "ref_id")
    return texts.withColumn("edit_distance", F.levenshtein("u", "s", k)).where("edit_distance >= 0").select(
        F.col("u").alias("seq"), "ref_id", "edit_distance"
    )


def first_range_match(reads: DataFrame, targets: DataFrame, length: str = "length") -> DataFrame:
    """First target (by ``ord``) whose size range holds the read length; NULL when none does."""
    lengths = reads.select(length).distinct()
    hit = range_join(lengths, targets.select("target_id", "ord", "range_min", "range_max"), length, "range_min", "range_max")
    first = hit.groupBy(length).agg(F.min_by("target_id", "ord").alias("target_id"))
    return reads.join(first, length, "left")


def size_candidates(reads: DataFrame, targets: DataFrame, on: Sequence[str] = ("experiment",), length: str = "length") -> DataFrame:
    """All targets of the read's experiment whose range holds its length.

    The range join reads its reads three times; they are worked out once, into a table.
    """
    return range_join(written(reads, "sized-reads"), targets, length, "range_min", "range_max", list(on))


def experiment_targets(barcode_map: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct targets in use per experiment, with their sequence and range."""
    used = barcode_map.select("experiment", F.col("target").alias("target_id")).distinct()
    return used.join(targets, "target_id")


# Accepted read lengths and the margin of a clear winner.
MIN_READ, MAX_READ = 80, 200
CLEAR_MARGIN = 0.8


def classify_reads(
    reads: DataFrame, barcode_map: DataFrame, targets: DataFrame,
    min_length: int = MIN_READ, max_length: int = MAX_READ,
) -> DataFrame:
    """Assign reads (read_id, experiment, barcode, seq) to targets by size, then edit distance.

    Rules in order: unknown barcode, length out of bounds, no target of that size, one target of
    that size, closest of several. Distances are computed once per (experiment, sequence); sixteen bytes stand for the
    sequence wherever its text is not compared.
    """
    expected = barcode_map.select("experiment", "barcode", F.col("target").alias("expected_target"))
    sized = reads.select("read_id", "experiment", "barcode", F.length("seq").alias("length"), F.upper("seq").alias("seq")).withColumn("id", _named(F.col("seq")))
    # Sequences are read three times; they are worked out once, into a table.
    sized = written(sized.join(expected, ["experiment", "barcode"], "left"), "classified-reads")
    known = F.col("expected_target").isNotNull()
    in_bounds = F.col("length").between(min_length, max_length)
    asked = sized.where(known & in_bounds).select("experiment", "id", "length", "seq").distinct()
    pool = experiment_targets(barcode_map, targets).select(
        "experiment", "target_id", "target_seq", "expected_length", "range_min", "range_max"
    )
    # Sizes are few; the sequences are dealt evenly, as distances cost far more than bytes.
    sizes = sized.where(known & in_bounds).select("experiment", "length").distinct()
    fitting = size_candidates(sizes, pool)
    scored = balanced(asked).join(fitting, ["experiment", "length"]).select(
        "experiment", "id",
        F.struct(
            edit_distance("seq", "target_seq").alias("d"),
            F.col("expected_length").alias("len"),
            F.col("target_id").alias("id"),
        ).alias("c"),
    )
    # Only the three best candidates matter, so no list grows with the number of targets.
    order = Window.partitionBy("experiment", "id").orderBy("c")
    top = scored.withColumn("_r", F.row_number().over(order)).where("_r <= 3")
    ranked = top.groupBy("experiment", "id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    best, second = F.col("c")[0], F.get("c", F.lit(1))
    outcome = sized.drop("seq").join(ranked, ["experiment", "id"], "left")
    method = first_match(
        [
            (~known, "unknown_barcode"),
            (~in_bounds, "filtered"),
            (F.col("c").isNull(), "no_size_match"),
            (F.size("c") == 1, "size"),
        ],
        "edit_distance",
    )
    confidence = (
        F.when(F.col("method") == "size", F.when(best["id"] == F.col("expected_target"), "high").otherwise("mismatch"))
        .when(
            F.col("method") == "edit_distance",
            F.when(best["d"] < second["d"] * F.lit(CLEAR_MARGIN), "high")
            .when(best["d"] < second["d"], "medium")
            .otherwise("low"),
        )
    )
    decided = F.col("method").isin("size", "edit_distance")
    return outcome.withColumn("method", method).select(
        "read_id", "experiment", "barcode", "length", "method",
        F.when(decided, best["id"]).alias("target_id"),
        F.when(decided, best["d"]).alias("edit_distance"),
        F.when(decided, F.col("expected_target")).alias("expected_target"),
        confidence.alias("confidence"),
        F.when(F.col("method") == "edit_distance", F.transform(F.slice("c", 1, 3), lambda x: x["id"])).alias("candidates"),
        F.when(F.col("method") == "edit_distance", best["id"] == F.col("expected_target")).alias("matches_expected"),
    )


# Demultiplexing windows and edit limits.
SEARCH_WINDOW = 150
BARCODE_WINDOW = 30
TWO_ENDED_LENGTH = 200
MIN_DEMUX_LENGTH = 50
FLANK_EDITS = 2
BARCODE_EDITS = 5


def demultiplex(
    reads: DataFrame, barcodes: dict[str, str], flank: str, max_edits: int = BARCODE_EDITS, seq: str = "seq"
) -> DataFrame:
    """Barcode of each read by flank-anchored infix search in its first and last window.

    ``barcodes`` is a kit (name -> sequence) of any size; each read is searched for every entry.
    """
    kit = list(barcodes.items())

    def search(front: kernels.Panel, codes: kernels.Panel, regions: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Best (edits, barcode index) of each region; an earlier barcode wins ties."""
        edits, ends = (x[:, 0] for x in front.infixes(regions))
        windows = [
            r[e + 1: e + 1 + BARCODE_WINDOW] if d <= FLANK_EDITS else r for r, d, e in zip(regions, edits, ends)
        ]
        size = max(1, kernels.MAX_CELLS // len(kit))
        tables = [codes.infixes(windows[i: i + size])[0] for i in range(0, len(windows), size)]
        return np.concatenate([t.min(axis=1) for t in tables]), np.concatenate([t.argmin(axis=1) for t in tables])

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.array([name for name, _ in kit] + ["unclassified"], dtype=object)
        panels = kernels.Panel([flank]), kernels.Panel([code for _, code in kit])
        for pdf in frames:
            texts = pdf[seq].fillna("").tolist()
            best = np.full(len(texts), -1)
            which = np.full(len(texts), len(kit))
            long_enough = np.array([i for i, t in enumerate(texts) if len(t) >= MIN_DEMUX_LENGTH], dtype=int)
            if len(long_enough):
                best[long_enough], which[long_enough] = search(*panels, [texts[i][:SEARCH_WINDOW] for i in long_enough])
            two_ended = np.array([i for i in long_enough if len(texts[i]) > TWO_ENDED_LENGTH], dtype=int)
            if len(two_ended):
                d, w = search(*panels, [texts[i][-SEARCH_WINDOW:] for i in two_ended])
                closer = d < best[two_ended]
                best[two_ended[closer]], which[two_ended[closer]] = d[closer], w[closer]
            which[best > max_edits] = len(kit)
            yield pdf.assign(barcode=names[which], barcode_edits=best)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in reads.schema)
    return reads.mapInPandas(assign, f"{schema}, barcode string, barcode_edits int")


#: Read bases whose alignments are counted at once.
PROFILE_BASES = 1 << 21
#: What is counted for every position: aligned bases, gaps, and the quality of aligned bases that have one.
TALLIES = ["correct", "incorrect", "deleted", "inserted", "q_correct", "q_incorrect", "p_correct", "p_incorrect"]


def _tallied(reads: pd.DataFrame) -> pa.Table:
    """Tallies of the positions of the references that reads (seq, qual, ref_id, ref_seq, edit_distance) align to.

    Inserted bases have no reference position of their own and deletions no quality.
    """
    seq, unique = pd.factorize(reads["seq"].str.upper())
    at = np.zeros(len(unique), np.int64)
    at[seq] = np.arange(len(reads))
    ref, names = pd.factorize(reads["ref_id"])
    texts = np.empty(len(names), object)
    texts[ref] = reads["ref_seq"].str.upper()
    size = np.maximum(np.fromiter(map(len, texts), np.int64, len(texts)), 1)
    begin = np.r_[0, np.cumsum(size)]
    own = ref[at]
    ops = banded.paths(list(unique), list(texts[own]), reads["edit_distance"].to_numpy()[at])
    steps, flat = np.array([len(x) for x in ops]), np.concatenate([np.empty(0, np.int8), *ops])
    pair = np.repeat(np.arange(len(ops)), steps)
    used = np.cumsum(flat != banded.INSERT)
    used = used - np.r_[0, used][np.r_[0, np.cumsum(steps)]][pair]
    place = begin[own][pair] + np.maximum(used - 1, 0)
    times = np.bincount(seq, minlength=len(unique)).astype(float)[pair]
    total = lambda where, weight: np.bincount(where, weight, begin[-1])
    gaps = [total(place[flat == op], times[flat == op]) for op in (banded.DELETE, banded.INSERT)]
    # The bases of each distinct sequence, then those of each read.
    based = flat != banded.DELETE
    place, kind = place[based], flat[based]
    bases = np.bincount(pair[based], minlength=len(unique))
    n = bases[seq]
    base = banded.ragged(np.r_[0, np.cumsum(bases)][seq], n)
    quals = ["" if q is None else q[:k] for q, k in zip(reads["qual"], n.tolist())]
    given = np.fromiter(map(len, quals), np.int64, len(quals))
    q = np.full(len(base), np.nan)
    q[banded.ragged(np.r_[0, np.cumsum(n)[:-1]], given)] = np.frombuffer("".join(quals).encode("utf-32-le"), np.uint32)
    p = 10.0 ** (-(q - phred.PHRED_OFFSET) / 10.0)
    place, kind, has = place[base], kind[base], ~np.isnan(q)
    ok, wrong = kind == banded.SAME, kind == banded.OTHER
    tallies = [total(place[ok], None), total(place[wrong], None), *gaps, total(place[ok & has], None), total(place[wrong & has], None),
               total(place[ok & has], p[ok & has]), total(place[wrong & has], p[wrong & has])]
    seen = np.flatnonzero(sum(tallies[:4]))
    of = np.searchsorted(begin, seen, side="right") - 1
    counts = [pa.array(t[seen].astype(np.float64 if name.startswith("p_") else np.int64)) for name, t in zip(TALLIES, tallies)]
    return pa.table([pa.array(names.take(of)), pa.array((seen - begin[of]).astype(np.int32)), *counts], names=["ref_id", "ref_pos", *TALLIES])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Reads of up to PROFILE_BASES bases together, of several batches or of a part of one."""
    held, bases = [], 0
    for batch in batches:
        reads = batch.to_pandas()
        n = reads["seq"].str.len()
        for _, some in reads.groupby(n.cumsum() // PROFILE_BASES, sort=False):
            more = int(n[some.index].sum())
            if held and bases + more > PROFILE_BASES:
                yield pd.concat(held, ignore_index=True)
                held, bases = [], 0
            held.append(some)
            bases += more
    if held:
        yield pd.concat(held, ignore_index=True)


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for first in batches:
        schema = pa.schema([first.schema.field("ref_id"), ("ref_pos", pa.int32()), *((t, pa.float64() if t.startswith("p_") else pa.int64()) for t in TALLIES)])
        for reads in _gathered(chain([first], batches)):
            yield from _tallied(reads).cast(schema).to_batches()


def error_profile(reads: DataFrame, refs: DataFrame) -> DataFrame:
    """Mean quality, empirical and predicted error per position of each read's best reference.

    Reads: read_id, seq, qual. References: ref_id, ref_seq, ord. Reads come with equal sequences together, so that these
    are aligned once; they are counted before they leave their task, many batches at once. Deleted and inserted bases are counted
    at their positions, beside the rates of aligned bases.
    """
    matched = best_reference(reads.select("seq", "qual"), refs).join(refs.select("ref_id", "ref_seq"), "ref_id")
    ddl = ", ".join(["ref_id " + refs.schema["ref_id"].dataType.simpleString(), "ref_pos int", *(f"{t} {'double' if t.startswith('p_') else 'bigint'}" for t in TALLIES)])
    sums = matched.select("seq", "qual", "ref_id", "ref_seq", "edit_distance").mapInArrow(_profiled, ddl).groupBy("ref_id", "ref_pos").agg(
        *[F.sum(t).alias(t) for t in TALLIES])
    c = {t: F.col(t) for t in TALLIES}
    n = c["correct"] + c["incorrect"]
    mean = F.try_divide(c["p_correct"] + c["p_incorrect"], c["q_correct"] + c["q_incorrect"])
    return sums.select(
        "ref_id", "ref_pos", n.alias("n"),
        *[c[t].alias(f"count_{t}") for t in ("correct", "incorrect", "deleted", "inserted")],
        phred.to_qscore(mean).alias("mean_qscore_all"),
        phred.to_qscore(F.try_divide(c["p_correct"], c["q_correct"])).alias("mean_qscore_correct"),
        phred.to_qscore(F.try_divide(c["p_incorrect"], c["q_incorrect"])).alias("mean_qscore_incorrect"),
        F.try_divide(c["incorrect"].cast("double"), n).alias("empirical_error_rate"),
        mean.alias("predicted_error_rate"),
    )


def reference_sets(barcodes: DataFrame, targets: DataFrame, prefix: str, adapter: str, flank_front: str, flank_rear: str) -> DataFrame:
    """Full reference of every mapped (barcode, target) in both orientations.

    ``barcodes``: experiment, barcode, barcode_seq, target. ``targets``: target_id, target_seq.
    """
    parts = [F.lit(prefix), F.lit(adapter), F.lit(flank_front), F.col("barcode_seq"), F.lit(flank_rear)]
    joined = barcodes.join(targets, F.col("target") == F.col("target_id")).drop("target")
    both = joined.withColumn("strand", F.explode(F.array(F.lit("forward"), F.lit("reverse"))))
    insert = F.when(F.col("strand") == "forward", F.col("target_seq")).otherwise(sq.reverse_complement("target_seq"))
    return both.withColumn("reference", sq.assemble(*parts, insert)).withColumn(
        "expected_length", F.length("reference")
    ).withColumn("chimera_length", sq.chimera_length(*parts, "target_seq"))


def ingest_reads(
    reads: DataFrame, targets: DataFrame, end_reasons: DataFrame, exp_id: Column,
    tier: Column, version: Column, trim: Column, mods: Column,
) -> DataFrame:
    """Warehouse rows: read quality, size-matched reference, distance, end reason and stable id."""
    base = reads.where(F.col("seq").isNotNull()).withColumn("readlen", F.length("seq"))
    matched = first_range_match(base, targets, "readlen")
    refs = targets.select("target_id", "target_seq")
    with_ref = matched.join(refs, "target_id", "left").withColumn(
        "ed", F.levenshtein("seq", "target_seq")
    )
    sided = with_ref.join(end_reasons.select("read_id", "end_reason", "forced"), "read_id", "left")
    return sided.select(
        sq.unique_read_id(exp_id, tier, version, trim, mods, F.col("read_id")).alias("uniq_id"),
        exp_id.alias("exp_id"),
        F.col("target_id").alias("refseq_id"),
        "read_id", F.col("seq").alias("readseq"), "readlen",
        tier.alias("model_tier"), version.alias("model_ver"), trim.alias("trim"), mods.alias("mod_bitflag"),
        "ed",
        phred.string_mean_q("qual", 100.0).alias("q_bc"),
        phred.edit_quality("ed", F.length("target_seq")).alias("q_ld"),
        F.col("end_reason").alias("ER"), "forced",
    )


def barcode_summary(tagged: DataFrame, keys: Sequence[str] = ("barcode",)) -> DataFrame:
    """Per barcode: size mix, medians, quality and distance shares.

    Input columns: length, ed, qscore, size_class, end_reason. Distances and qualities are worked out once, into a table
    in the shared folder: counts and each median read it again.
    """
    from runqc.operators import ranking

    tagged = written(tagged.select(*keys, "length", "ed", "qscore", "size_class", "end_reason"), "barcode-summary")
    share = lambda c: (F.avg(c.cast("double")) * 100)
    base = tagged.groupBy(*keys).agg(
        F.count("*").alias("n"),
        share(F.col("size_class") == "in_range").alias("in_range_pct"),
        F.count_if(F.col("size_class") == "short").alias("short"),
        F.count_if(F.col("size_class") == "long").alias("long"),
        F.avg("ed").alias("mean_ed"),
        *[share(F.col("ed") < k).alias(f"ed_lt{k}_pct") for k in (20, 30, 50)],
        share(F.col("qscore") >= 10).alias("q10_pct"),
        share(F.col("end_reason") == "signal_positive").alias("signal_positive_pct"),
    )
    out = base
    for value, width in (("length", 100), ("ed", 10), ("qscore", ranking.QUALITY_WIDTH)):
        out = out.join(ranking.quantiles(tagged, list(keys), value, {f"median_{value}": 0.5}, width), list(keys))
    return out
