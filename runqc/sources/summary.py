"""Sequencing-summary tables and other run text files as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runqc.functions import endreason as er

# Accepted column names, preferred first.
ALIASES = {
    "read_id": ["read_id"],
    "run_id": ["run_id"],
    "channel": ["channel"],
    "start_time": ["start_time", "time"],
    "duration": ["duration"],
    "length": ["sequence_length_template", "sequence_length", "read_length"],
    "qscore": ["mean_qscore_template", "mean_qscore", "qscore"],
    "passes": ["passes_filtering"],
    "end_reason": ["end_reason"],
    "sample_id": ["sample_id"],
    "flow_cell_id": ["flow_cell_id"],
    "barcode_arrangement": ["barcode_arrangement"],
    "barcode_kit": ["barcode_kit"],
    "alias": ["alias"],
    "duplex_parent_template": ["duplex_parent_template"],
    "duplex_parent_complement": ["duplex_parent_complement"],
    "alignment_identity": ["alignment_identity"],
    "alignment_accuracy": ["alignment_accuracy"],
    "alignment_genome": ["alignment_genome"],
}
NUMBERS = {
    "channel": "int", "start_time": "double", "duration": "double", "length": "bigint", "qscore": "double",
    "alignment_identity": "double", "alignment_accuracy": "double",
}

# Spellings of "no alignment".
NO_VALUE = ["", "-1", "-1.000000", "*"]


def sentinel_to_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.trim(c).isin(NO_VALUE), F.lit(None)).otherwise(c)


def number(c: Column, kind: str, default: float | None = None) -> Column:
    """Tolerant cast; ``default`` stands in for a bad number when given."""
    value = c.try_cast(kind)
    return value if default is None else F.coalesce(value, F.lit(default).cast(kind))


def raw_summary(spark: SparkSession, paths: str | Sequence[str], sep: str = "\t") -> DataFrame:
    """All-string rows of TSV files whose headers may differ.

    Header lines (one per file) are read first; files with the same header are scanned together
    with an explicit schema, and the scans are unioned by name.
    """
    lines = spark.read.text(paths, wholetext=False).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    # The first line of a file is the only one that starts with a known column name list.
    header = lines.where((F.col("block") == 0) & _looks_like_header(F.col("value"), sep)).groupBy("file").agg(
        F.first("value").alias("header")
    )
    groups = header.groupBy("header").agg(F.collect_list("file").alias("files")).collect()
    out = None
    for row in sorted(groups, key=lambda r: r["header"]):
        names = row["header"].strip().split(sep)
        schema = ", ".join(f"`{n}` string" for n in names) + ", `_bad` string"
        part = spark.read.csv(
            sorted(row["files"]), sep=sep, header=True, schema=schema, mode="PERMISSIVE",
            columnNameOfCorruptRecord="_bad", enforceSchema=True,
        )
        part = part.select(*[F.col(f"`{n}`") for n in names], "_bad", F.col("_metadata.file_path").alias("source_file"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no summary header found")
    return out


def _looks_like_header(line: Column, sep: str) -> Column:
    cells = F.split(line, sep)
    return F.exists(cells, lambda c: F.lower(F.trim(c)).contains("read_id"))


def resolve(columns: Sequence[str], name: str) -> list[str]:
    return [a for a in ALIASES[name] if a in columns]


def canonical_reads(raw: DataFrame, keep_malformed: bool = False, default_bad: float | None = None) -> DataFrame:
    """Canonical ``reads``: names resolved per row, numbers parsed, bad rows dropped.

    A row survives when it has all its fields and a parsable length; with ``default_bad`` a bad
    number becomes that value instead.
    """
    rows = raw
    if "_bad" in raw.columns and not keep_malformed:
        rows = raw.where(F.col("_bad").isNull())
    cols: list[Column] = []
    for name in ALIASES:
        have = resolve(rows.columns, name)
        value = F.coalesce(*[F.col(f"`{c}`") for c in have]) if have else F.lit(None).cast("string")
        if name.startswith("alignment_"):
            value = sentinel_to_null(value)
        if name in NUMBERS:
            value = number(value, NUMBERS[name], default_bad if name in ("length", "qscore", "duration") else None)
        if name == "passes":
            value = er.passes(value)
        if name == "end_reason":
            value = F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit("unknown"))
        cols.append(value.alias(name))
    extra = [c for c in ("source_file",) if c in rows.columns]
    return rows.select(*cols, *extra).where(F.col("length").isNotNull())


def end_reason_columns(raw: DataFrame) -> DataFrame:
    """read_id, channel, end_reason, duration found by substring of the column name."""
    def find(part: str) -> Column:
        hit = next((c for c in raw.columns if part in c.lower()), None)
        return F.col(f"`{hit}`") if hit else F.lit(None).cast("string")

    return raw.select(
        find("read_id").alias("read_id"),
        F.coalesce(find("channel").try_cast("int"), F.lit(0)).alias("channel"),
        er.canonical(find("end_reason"), integer_codes=False).alias("end_reason"),
        F.coalesce(find("duration").try_cast("double"), F.lit(0.0)).alias("duration"),
    )


def final_summary(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """key=value files to one map per file; a value may hold further equal signs."""
    return key_values(spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), "value",
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line"),
    ))


def key_values(lines: DataFrame) -> DataFrame:
    """(file, fields) of key=value lines (file, line, value). The last line of a key wins; others are no pairs."""
    pair = F.split("value", "=", 2)
    pairs = lines.where(F.col("value").contains("=")).select(
        "file", "line", F.trim(pair[0]).alias("k"), F.trim(pair[1]).alias("v")
    )
    unique = pairs.groupBy("file", "k").agg(F.max_by("v", "line").alias("v"))
    return unique.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("fields"))


def throughput_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Time points of throughput files, see ``throughput``."""
    return throughput(spark.read.csv(paths, header=True, inferSchema=False))


def throughput(raw: DataFrame) -> DataFrame:
    """(ts, cumulative_reads, cumulative_bases) of rows with timestamp, reads and bases as text.

    A missing column counts as 0; a row whose time or number cannot be read is left out.
    """
    number = lambda c: F.trim(c).try_cast("bigint") if c in raw.columns else F.lit(0).cast("bigint")
    points = raw.select(
        F.try_to_timestamp(F.trim("timestamp")).alias("ts"), number("reads").alias("cumulative_reads"), number("bases").alias("cumulative_bases"))
    return points.where("ts is not null and cumulative_reads is not null and cumulative_bases is not null")


def duty_time_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Channel-state rows of duty-time files, see ``duty_time``."""
    return duty_time(spark.read.csv(paths, header=True))


def duty_time(raw: DataFrame) -> DataFrame:
    """(state, minute, samples): columns by part of their name, the minute of the experiment, samples in that state."""
    find = lambda part: next(c for c in raw.columns if part in c.lower())
    return raw.select(
        F.col(f"`{find('channel')}`").alias("state"),
        F.col(f"`{find('time')}`").try_cast("double").alias("minute"),
        F.col(f"`{find('samples')}`").try_cast("bigint").alias("samples"),
    )


def side_table(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return side_rows(spark.read.csv(paths, sep="\t", header=True))


def side_rows(raw: DataFrame) -> DataFrame:
    """read_id, end_reason, forced (0 when absent or unreadable)."""
    forced = F.col("forced").try_cast("int") if "forced" in raw.columns else F.lit(None).cast("int")
    return raw.select("read_id", "end_reason", F.coalesce(forced, F.lit(0)).alias("forced"))


def result_documents(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """Per-experiment JSON result files, one document each; see ``result_texts``."""
    texts = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return result_texts(texts, schema)


def result_texts(texts: DataFrame, schema: str) -> DataFrame:
    """(file, the fields of ``schema``, status) of JSON documents (file, text); unreadable ones have status ``error``."""
    parsed = texts.select(F.regexp_extract("file", r"^(.*?)(?:\.json)?$", 1).alias("file"), F.from_json(
        "text", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("d"))
    fields = [f for f in parsed.schema["d"].dataType.names if f != "_corrupt"]
    ok = F.col("d").isNotNull() & F.col("d._corrupt").isNull()
    return parsed.select("file", *[F.when(ok, F.col(f"d.`{f}`")).alias(f) for f in fields], F.when(ok, "success").otherwise("error").alias("status"))


def log_statistics(lines: DataFrame, keys: Sequence[str], order: str = "line_no", text: str = "value") -> DataFrame:
    """Reads, bases and samples/s reported in basecaller logs; the last report of each wins."""
    low = F.lower(F.col(text))
    grab = lambda p, i=1: F.nullif(F.regexp_extract(low, p, i), F.lit(""))
    scale = F.coalesce(
        F.try_element_at(
            F.create_map(F.lit("g"), F.lit(1e9), F.lit("m"), F.lit(1e6), F.lit("k"), F.lit(1e3)),
            grab(r"(\d+(?:\.\d+)?)\s*(g|m|k)?bases", 2),
        ),
        F.lit(1.0),
    )
    rows = lines.select(
        *keys, order,
        grab(r"(\d+)\s+reads").cast("bigint").alias("r"),
        (grab(r"(\d+(?:\.\d+)?)\s*(?:g|m|k)?bases").cast("double") * scale).cast("bigint").alias("b"),
        grab(r"(\d+(?:\.\d+)?)\s*samples/s").cast("double").alias("s"),
    )
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    return rows.groupBy(*keys).agg(
        last("r").alias("total_reads"), last("b").alias("bases_called"), last("s").alias("samples_per_second")
    )
