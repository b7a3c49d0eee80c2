"""Token ids as ORC: integer run-length encoding, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runqc.llm.common import give_back
from runqc.session import shared_path

END_ID = 1
#: Letter runs, mark runs and odd words that a task remembers with their ids; beyond it the memory starts anew. Speed only.
REMEMBERED = 300_000
#: Texts that a task encodes at once: what it holds beside the batch grows with their words.
AT_ONCE = 1000
STRIPE_BYTES = 64 << 20
INDEX_STRIDE = 10_000
#: Marks whose runs the tokenizer cuts off letters: printable ASCII without letters, digits and the apostrophe.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


def vocabulary_path(file: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(file)


def _symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


SYMBOLS = dict(enumerate(_symbols()))


class _Words:
    """Encodes texts by their distinct words: the tokenizer cuts at blanks, so a text's ids are those of its words in a row.

    Arrow cuts a batch at blanks and numbers its distinct words. A word of letters and then marks is two pieces for the
    tokenizer as well; for a letter run, composed and in lower case, only the merges are left to do. Other words go to
    the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}  # ids as little-endian 32-bit integers

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, text: str) -> bytes:
        low = text if text.isascii() else unicodedata.normalize("NFC", text).lower()
        if not low.isalpha() or "\u03c2" in low:  # the last sigma of a word has another lower case for str
            return self.direct(text)
        ids = [t.id for t in self.tokenizer.model.tokenize(low.encode().decode("latin-1").translate(SYMBOLS))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def atoms(self, pieces: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, found = self.known, []
        for text in pieces:
            ids = known.get(text)
            if ids is None:
                ids = known[text] = self.piece(text)
            found.append(ids)
        return found

    @staticmethod
    def tails(words: pa.Array, heads: pa.Array, wanted: np.ndarray) -> pa.Array:
        """What each word has after its head; nothing where it is not wanted."""
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
        head = pc.binary_length(heads).to_numpy()
        n = np.where(wanted, np.diff(offsets) - head, 0)
        at = np.cumsum(n) - n
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[np.repeat(offsets[:-1] + head - at, n) + np.arange(n.sum())]
        return pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(np.r_[0, np.cumsum(n)].astype(np.int64)), pa.py_buffer(data))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of each text."""
        whole = {i: self.direct(t) for i, t in enumerate(texts) if t and "<|" in t}  # special tokens may hold or touch anything
        cut = pc.ascii_split_whitespace(pa.array(["" if t is None or i in whole else t for i, t in enumerate(texts)], pa.large_string()))
        words = cut.values.dictionary_encode()
        bare = pc.utf8_rtrim(words.dictionary, MARKS)
        split = pc.utf8_is_alpha(bare)
        marks = self.tails(words.dictionary, bare, split.to_numpy(zero_copy_only=False))
        heads = pc.if_else(split, pc.ascii_lower(bare), words.dictionary)
        pieces = pa.concat_arrays([heads, marks]).dictionary_encode()
        atoms = self.atoms(pieces.dictionary.to_pylist())
        size = np.array([len(a) // 4 for a in atoms], np.int64)
        start, ids = np.cumsum(size) - size, np.frombuffer(b"".join(atoms), "<u4")
        of_word = pieces.indices.to_numpy().reshape(2, -1)
        used = of_word[:, words.indices.to_numpy()].T.ravel()
        n = size[used]
        at = np.cumsum(n) - n
        total = int(n.sum())
        place = np.arange(total, dtype=np.int32 if max(total, len(ids)) < 2**31 else np.int64)  # the largest arrays here
        place += np.repeat((start[used] - at).astype(place.dtype), n)
        row = ids[place]
        ends = np.r_[at, total][2 * cut.offsets.to_numpy()]
        counts = np.diff(ends)
        if whole:
            parts = [np.frombuffer(whole[i], "<u4") if i in whole else row[a:b] for i, (a, b) in enumerate(zip(ends[:-1], ends[1:]))]
            row, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return row, counts


@lru_cache(1)
def _words(path: str) -> _Words:
    return _Words(path)


TABLE = "doc_id long, part_start long, n_tokens long, ids array<int>"
STORED = pa.schema([("doc_id", pa.int64()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _encode(path: str, end_id: int):
    def encoded(words: _Words, some: pa.RecordBatch, start: int) -> pa.RecordBatch:
        ids, counts = words.encode(some.column(1).to_pylist())
        n = counts + 1
        ends = np.cumsum(n)
        row = np.full(int(n.sum()), end_id, np.int32)
        own = np.ones(len(row), bool)
        own[ends - 1] = False
        row[own] = ids
        lists = pa.ListArray.from_arrays(np.r_[0, ends].astype(np.int32), row)
        return pa.RecordBatch.from_arrays([some.column(0), pa.array(start + ends - n), pa.array(n), lists], schema=STORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, start = _words(path), 0
        for batch in batches:
            for cut in range(0, batch.num_rows, AT_ONCE):
                made = encoded(words, batch.slice(cut, AT_ONCE), start)
                start += pc.sum(made.column(2)).as_py()
                yield made
                del made
                give_back()
            del batch
        give_back()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes whole texts, appends ``end_id`` to each, and writes them to ``path`` in ascending document id order.

    Documents are range-partitioned by id (equal ids by content), so file k holds ids before those of file k + 1, each
    file's rows ascend, and every row stores its place among the ids of its file. Ids are integers in run-length
    encoding; each stripe has a row index every 10,000 rows and a Bloom filter on doc_id, so readers skip stripes.
    NULL and empty texts hold only the end id; NULL document ids come first; repeated rows are stored as often as they
    come; other columns are not stored. An empty table gives an empty dataset.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    conf, records = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(records)
    conf.set(records, AT_ONCE)  # a batch of texts lies in the executor and in its worker, often twice over
    try:
        (
            rows.repartitionByRange(*order).sortWithinPartitions(*order)
            .mapInArrow(_encode(tokenizer or vocabulary_path(), end_id), TABLE)
            .withColumn("part", F.spark_partition_id())
            .write.option("compression", "zstd").option("orc.create.index", "true").option("orc.row.index.stride", INDEX_STRIDE)
            .option("orc.stripe.size", STRIPE_BYTES).option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
            .orc(path)
        )
    finally:
        conf.set(records, before)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{TABLE}, part int").orc(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``part, docs, tokens, first_doc, last_doc, start``; reads the small columns only."""
    parts = _stored(spark, path).groupBy("part").agg(
        F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    return parts.withColumn("start", F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens"))


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of a written dataset; ``start`` counts the ids of all documents before it.

    ``doc_ids`` reaches the files as a pushed filter: row indexes and Bloom filters skip what cannot hold them.
    """
    rows = _stored(spark, path)
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    starts = F.broadcast(manifest(spark, path).select("part", "start"))  # a row per file, as the driver lists them
    return rows.join(starts, "part").select(
        "doc_id", (F.col("start") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def token_digests(rows: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: unsigned crc32 of the ids as little-endian 32-bit integers."""
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            at, flat = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy().view("<u4")).cast("B")
            crc = [zlib.crc32(flat[4 * a: 4 * b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(crc, pa.int64())], schema=out)
        give_back()

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored_digests(docs: DataFrame) -> DataFrame:
    """Writes ``docs`` to the shared folder in this format and digests what the files hold."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write_tokens(docs, path)
    return token_digests(read_tokens(spark, path))
