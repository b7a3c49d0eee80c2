"""Run directories from a file listing, and configuration documents as dimension tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File kinds by name pattern, in order of precedence.
KINDS = [
    (r"sequencing_summary[^/]*\.txt$", "sequencing_summary"),
    (r"final_summary[^/]*\.txt$", "final_summary"),
    (r"\.pod5$", "pod5"),
    (r"\.fast5$", "fast5"),
    (r"\.(?:fastq|fq)(?:\.gz)?$", "fastq"),
    (r"\.bam$", "bam"),
    (r"report[^/]*\.(?:html|md|json)$", "report"),
]

# Data folders inside a run folder, and the one that is never a run of its own.
SUBFOLDERS = "pod5|pod5_pass|pod5_fail|pod5_skip|fast5|fast5_pass|fast5_fail|fastq_pass|fastq_fail|bam_pass|bam_fail"
EXCLUDED = "pod5_pass"

# Source preference.
PREFERENCE = ["sequencing_summary", "fastq", "bam", "pod5", "fast5"]


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, size, modified of every file below ``path``; content is never read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
        .load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    )


def with_kind(files: DataFrame) -> DataFrame:
    kind = None
    for pattern, name in KINDS:
        hit = F.lower("path").rlike(pattern)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    folder = F.regexp_replace(F.regexp_replace("path", r"/[^/]*$", ""), rf"/(?:{SUBFOLDERS})(?:/.*)?$", "")
    return files.withColumn("kind", kind).withColumn("run_dir", folder)


def run_inventory(files: DataFrame) -> DataFrame:
    """Per run folder: files and bytes per kind, presence flags and preferred read source."""
    named = with_kind(files)
    kinds = [k for _, k in KINDS]
    counted = named.where(F.col("kind").isNotNull()).groupBy("run_dir").agg(
        *[F.count_if(F.col("kind") == k).alias(f"{k}_files") for k in kinds],
        F.sum("size").alias("total_bytes"),
    )
    best = F.coalesce(*[F.when(F.col(f"{k}_files") > 0, F.lit(k)) for k in PREFERENCE])
    return counted.withColumn("preferred_source", best)


def experiments(files: DataFrame) -> DataFrame:
    """Run folders with a summary (not below the excluded folder) or with raw data only.

    A folder that merely contains two or more run folders is a container and is left out.
    """
    runs = run_inventory(files.where(~F.col("path").contains(f"/{EXCLUDED}/sequencing_summary")))
    parent = F.regexp_replace("run_dir", r"/[^/]*$", "")
    containers = runs.groupBy(parent.alias("run_dir")).agg(F.count("*").alias("c")).where("c > 1")
    has_summary = F.col("sequencing_summary_files") > 0
    raw = (F.col("pod5_files") > 0) | (F.col("fast5_files") > 0)
    kept = runs.where(has_summary | raw).join(containers, "run_dir", "left_anti")
    return kept.withColumn("discovery", F.when(has_summary, "summary").otherwise("raw_only"))


def preferred_stats(stats: DataFrame, keys: Sequence[str], source: str = "source") -> DataFrame:
    """Per experiment the statistics of its best available source."""
    order = F.array_position(F.array(*[F.lit(p) for p in PREFERENCE]), F.col(source))
    payload = [c for c in stats.columns if c not in keys]
    best = F.min_by(F.struct(*payload), order)
    return stats.where(order > 0).groupBy(*keys).agg(best.alias("s")).select(*keys, "s.*")


def targets_from_config(spark: SparkSession, config: Mapping) -> DataFrame:
    """``targets`` section: id, sequence, expected length and size range, in file order."""
    rows = [
        (name, t["sequence"], int(t["expected_length"]), int(t["size_range"]["min"]), int(t["size_range"]["max"]), i)
        for i, (name, t) in enumerate(config["targets"].items())
    ]
    return spark.createDataFrame(
        rows, "target_id string, target_seq string, expected_length int, range_min int, range_max int, ord int"
    )


def barcodes_from_config(spark: SparkSession, config: Mapping) -> DataFrame:
    rows = [
        (experiment, barcode, b["target"], b.get("alias"))
        for experiment, e in config["experiments"].items()
        for barcode, b in e.get("barcode_mapping", {}).items()
    ]
    return spark.createDataFrame(rows, "experiment string, barcode string, target string, alias string")


def registry_documents(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """JSON-lines registry with an explicit schema; convert YAML registries once with ``from_yaml``."""
    return spark.read.json(paths, schema=schema)


def from_yaml(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One-off loader for a registry document (a configuration-sized file)."""
    import yaml

    with open(path) as f:
        document = yaml.safe_load(f)
    rows = document["experiments"] if isinstance(document, dict) else document
    return spark.createDataFrame(rows, schema)
