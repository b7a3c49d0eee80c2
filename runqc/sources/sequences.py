"""FASTA, FASTQ and SAM text as DataFrames."""

from __future__ import annotations

import gzip
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from runqc.functions import phred


def fasta(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """name (first word of the header) and sequence; records may span lines, files may be gzipped.

    Records are split at a ``>`` that begins a line, so a large file is scanned by many tasks and a
    header may hold further marks.
    """
    return fasta_records(spark.read.text(paths, lineSep="\n>"), [])


def fasta_text(texts: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Records of FASTA files held as text, one a row."""
    return fasta_records(texts.select(*keys, F.explode(F.split(text, "\n>")).alias("value")), keys)


def fasta_records(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, name, seq) of the stretches between marks in ``value``."""
    records = pieces.select(*keys, F.regexp_replace("value", r"^\s*>", "").alias("value")).where(F.trim("value") != "")
    lines = F.split("value", r"\r?\n", 2)
    return records.select(
        *keys,
        F.split(F.trim(lines[0]), r"\s+")[0].alias("name"),
        F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"\s", "").alias("seq"),
    )


RECORD = pa.schema([("file", pa.string()), ("name", pa.string()), ("seq", pa.string()), ("qual", pa.string())])
RECORD_DDL = "file string, name string, seq string, qual string"
#: Bytes of one task's range, and of one read from the file system.
RANGE_BYTES, READ_BYTES = 64 << 20, 8 << 20
BATCH_ROWS = 4096


def _record_lines(text: bytes, final: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line starts, line ends, lines that begin a record) of a stretch that begins at a line.

    A line begins a record if it starts with ``@`` and the next but one starts with ``+``. No other line does: a quality
    line may start with ``@``, but bases stand two lines after it. So records are known from four lines alone,
    wherever a stretch begins. A last line without its end counts only in the ``final`` stretch.
    """
    raw = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(raw == 10)
    if final and len(raw) and raw[-1] != 10:
        ends = np.r_[ends, len(raw)]
    starts = np.r_[0, ends[:-1] + 1].astype(np.int64)[:len(ends)]
    first = np.where(ends > starts, raw[np.minimum(starts, max(len(raw) - 1, 0))] if len(raw) else 0, 0)
    heads = np.flatnonzero((first[:-3] == ord("@")) & (first[2:-1] == ord("+"))) if len(ends) >= 4 else np.empty(0, np.int64)
    return starts, ends, heads


def range_records(read: Callable[[int, int], bytes], start: int, end: int | None, block: int = READ_BYTES) -> Iterator[tuple[str, str, str]]:
    """(name, bases, qualities) of the records whose first line begins in [start, end) of a file.

    ``read(position, size)`` gives bytes, fewer only at the file's end. Every record of a file is in exactly one of the
    ranges that cover it: a range begins at its first whole line and reads on past its end until its last record is whole.
    """
    at, held = max(start - 1, 0), b""
    skip = start > 0
    while True:
        more = read(at + len(held), block)
        held += more
        final = len(more) < block
        if skip:
            cut = held.find(b"\n") + 1
            if not cut and not final:
                at, held = at + len(held), b""
                continue
            at, held, skip = at + (cut or len(held)), held[cut or len(held):], False
        starts, ends, heads = _record_lines(held, final)
        line = lambda i: held[starts[i]:ends[i]].rstrip(b"\r").decode("utf-8", "replace")
        for i in heads:
            if end is not None and at + starts[i] >= end:
                return
            yield (line(i)[1:].split() or [""])[0], line(i + 1), line(i + 3)
        # The last three lines may begin records that go on in the next block.
        left = starts[len(starts) - 3] if len(starts) >= 3 else 0
        if final or end is not None and at + left >= end:
            return
        at, held = at + left, held[left:]


def _batches(file: str, records: Iterator[tuple[str, str, str]]) -> Iterator[pa.RecordBatch]:
    while some := list(islice(records, BATCH_ROWS)):
        columns = [[file] * len(some), *zip(*some)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], schema=RECORD)


def _file_system(path: str, default: str) -> tuple[pafs.FileSystem, str]:
    """The file system that a path names; one without a scheme is in the cluster's default."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    if default and not default.startswith("file:"):
        return pafs.FileSystem.from_uri(default.rstrip("/") + path)
    return pafs.LocalFileSystem(), path


@dataclass(frozen=True)
class _Range(InputPartition):
    path: str
    start: int
    end: int | None


class _FastqReader(DataSourceReader):
    def __init__(self, paths: list[str], range_bytes: int, default: str):
        self.paths, self.range_bytes, self.default = paths, range_bytes, default

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for path in self.paths:
            fs, inner = _file_system(path, self.default)
            info = fs.get_file_info(inner)
            found = fs.get_file_info(pafs.FileSelector(inner, recursive=True)) if info.type == pafs.FileType.Directory else [info]
            for f in found:
                if f.type == pafs.FileType.File and (f is info or re.search(r"\.f(ast)?q(\.gz)?$", f.path)):
                    name = path.rstrip("/") + f.path[len(inner.rstrip("/")):]
                    if name.endswith(".gz"):
                        out.append(_Range(name, 0, None))
                    else:
                        out += [_Range(name, a, a + self.range_bytes) for a in range(0, f.size, self.range_bytes)]
                elif f is info:
                    raise FileNotFoundError(path)
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        fs, inner = _file_system(partition.path, self.default)
        if partition.path.endswith(".gz"):
            with fs.open_input_stream(inner, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                yield from _batches(partition.path, range_records(lambda _, n: stream.read(n), 0, None))
        else:
            with fs.open_input_file(inner) as file:
                yield from _batches(partition.path, range_records(lambda at, n: file.read_at(n, at), partition.start, partition.end))


class FastqSource(DataSource):
    """``spark.read.format("fastq").option("paths", "a.fastq,folder,b.fastq.gz")``: a task per range of bytes.

    ``rangeBytes`` sets the size of a range; a gzipped file is one. ``defaultFS`` is where paths without a scheme are.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return RECORD_DDL

    def reader(self, schema) -> DataSourceReader:
        paths = [p for p in self.options["paths"].split(",") if p]
        return _FastqReader(paths, int(self.options.get("rangeBytes", RANGE_BYTES)), self.options.get("defaultFS", ""))


def fastq(spark: SparkSession, paths: Sequence[str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """FASTQ records of files and folders; the path decides pass or fail where it says so."""
    spark.dataSource.register(FastqSource)
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")
    rows = spark.read.format("fastq").options(paths=",".join(paths), rangeBytes=range_bytes, defaultFS=default).load()
    return fastq_columns(rows)


def fastq_columns(rows: DataFrame) -> DataFrame:
    """Adds pass or fail by the file's path, length and mean quality to (file, name, seq, qual)."""
    low = F.lower("file")
    passes = F.when(low.contains("fail"), False).when(low.contains("pass"), True)
    return rows.withColumn("passes", passes).withColumn("length", F.length("seq").cast("long")).withColumn(
        "qscore", phred.string_mean_q("qual")
    )


def fastq_text(texts: DataFrame, file: str = "file", text: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of FASTQ files held as text, one a row, read by ranges of bytes like files. NULL and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, whole, start in zip(*batch.columns):
                held = memoryview(whole.as_buffer())
                read = lambda at, n: bytes(held[at:at + n])  # noqa: B023, E731
                yield from _batches(name.as_py(), range_records(read, start.as_py(), start.as_py() + range_bytes, min(range_bytes, READ_BYTES)))

    held = texts.select(F.col(file).cast("string").alias("file"), F.col(text).cast("binary").alias("text"))
    size = F.octet_length("text")
    ranges = held.where(size > 0).withColumn("start", F.explode(F.sequence(F.lit(0), size - 1, F.lit(range_bytes))))
    return fastq_columns(ranges.mapInArrow(run, RECORD_DDL))


def sam(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Alignment rows of SAM text; header lines and rows with under 11 fields are dropped."""
    return sam_lines(spark.read.text(paths))


def sam_lines(lines: DataFrame) -> DataFrame:
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("@")).where(F.size(f) >= 11)
    nm = F.regexp_extract("value", r"\tNM:i:(\d+)", 1)
    parsed = rows.select(
        f[0].alias("name"),
        f[1].try_cast("int").alias("flag"),
        f[2].alias("ref"),
        f[4].try_cast("int").alias("mapq"),
        f[5].alias("cigar"),
        f[9].alias("seq"),
        f[10].alias("qual"),
        F.nullif(nm, F.lit("")).cast("int").alias("nm"),
    ).where(F.col("flag").isNotNull() & F.col("mapq").isNotNull())
    return parsed.select(
        "*",
        F.length("seq").cast("long").alias("length"),
        F.when(F.col("qual") != "*", phred.string_mean_q("qual")).alias("qscore"),
        (F.col("flag").bitwiseAND(4) != 0).alias("is_unmapped"),
    )
