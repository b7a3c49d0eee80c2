"""Sinks. Every writer is a plain DataFrameWriter call, so output is written by the tasks."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def per_read_csv(reads: DataFrame, path: str) -> None:
    reads.select("read_id", "channel", "end_reason", "duration").write.mode("overwrite").csv(path, header=True)


def summary_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def table(rows: DataFrame, path: str, form: str = "csv") -> None:
    """Comparison tables as csv, tsv or json."""
    writer = rows.write.mode("overwrite")
    if form == "json":
        writer.json(path)
    else:
        writer.csv(path, header=True, sep={"csv": ",", "tsv": "\t"}[form])


def distance_matrix(rows: DataFrame, path: str) -> None:
    table(rows, path, "tsv")


def position_table(rows: DataFrame, path: str) -> None:
    table(rows, path, "tsv")


def demultiplexed(reads: DataFrame, path: str, summary_path: str | None = None, columns: Sequence[str] = ()) -> None:
    """One folder per barcode, rows spread over tasks, plus the barcoding summary."""
    chosen = reads.select(*(columns or reads.columns))
    chosen.write.mode("overwrite").partitionBy("barcode").parquet(path)
    if summary_path:
        table(reads.select("read_id", "barcode", "barcode_edits"), summary_path, "tsv")


def fasta(records: DataFrame, path: str) -> None:
    records.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.mode("overwrite").text(path)


#: Folders of a warehouse, whatever the number of its partitions.
BUCKETS = 128


def warehouse(rows: DataFrame, path: str, key: str = "uniq_id", partition: str = "exp_id", order: str | None = None) -> None:
    """Upsert read rows: in the partitions present in ``rows``, rows of their keys are replaced.

    Partitions are dealt over a fixed number of folders, of which those with a partition of ``rows`` are rewritten; a
    store with a folder for each partition is brought into this form.

    Of rows with one key that of the greatest ``order`` wins (without an order, of the greatest values). The new
    folders go to a snapshot of their own; a manifest that names the snapshot of every folder is put in place last, by a rename. A job that fails before leaves the store as it was, and of two writers that began with the same
    manifest the second fails. Read with ``read_warehouse``.
    """
    spark = rows.sparkSession
    files = _Files(spark, path)
    version, folders = files.manifest()
    if not folders and files.fs.exists(files._at("")) and files.fs.listStatus(files._at("")):
        raise ValueError(f"{path} holds something else than a store")
    whole = F.struct(*([F.col(order)] if order else []), *[F.col(c).cast("string") for c in rows.columns])
    fresh = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), whole).alias("_row")).select("_row.*")
    # A text that is never taken for a number names the folder; the column itself stays in the files.
    value = F.coalesce(F.col(partition).cast("string"), F.lit(""))
    part = F.concat(F.lit("b_"), F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("string"))
    merged = fresh = fresh.withColumns({"_part": part, "_value": value})
    if folders:
        stored = _stored(spark, path, folders).withColumn("_value", value)
        if any(not re.fullmatch(r"_part=b_\d+", name) for name in folders):
            folders, touched = {}, stored.withColumn("_part", part)
        else:
            touched = stored.join(fresh.select("_part").distinct(), "_part", "left_semi")
        named = touched.join(fresh.select("_value", F.lit(True).alias("_named")).distinct(), "_value", "left")
        again = named.join(fresh.select(key, F.lit(True).alias("_again")), key, "left")
        merged = fresh.unionByName(again.where("_named is null or _again is null").select(*fresh.columns))
    snapshot = f"data/{uuid.uuid4().hex}"
    merged.drop("_value").hint("rebalance", "_part").write.partitionBy("_part").parquet(f"{path}/{snapshot}")
    new = {name: snapshot for name in files.folders(snapshot)}
    files.commit(version + 1, {**folders, **new})


def read_warehouse(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the store as its last manifest has them."""
    _, folders = _Files(spark, path).manifest()
    if not folders:
        raise FileNotFoundError(f"no store at {path}")
    return _stored(spark, path, folders).drop("_part")


def _stored(spark: SparkSession, path: str, folders: dict[str, str]) -> DataFrame:
    """Partitions of each snapshot that the manifest names, with the folder as ``_part``."""
    parts = []
    for snapshot in sorted(set(folders.values())):
        names = [f"{path}/{snapshot}/{n}" for n, s in folders.items() if s == snapshot]
        parts.append(spark.read.option("basePath", f"{path}/{snapshot}").parquet(*names))
    return reduce(DataFrame.unionByName, parts)


class _Files:
    """The store's manifests, through the file system of the cluster."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        return [f.getPath().getName() for f in self.fs.listStatus(self._at(folder))] if self.fs.exists(self._at(folder)) else []

    def folders(self, snapshot: str) -> list[str]:
        return [n for n in self._names(snapshot) if "=" in n]

    def manifest(self) -> tuple[int, dict[str, str]]:
        """(version, partition folder -> snapshot) of the last manifest; version 0 is an empty store."""
        versions = [int(n) for n in self._names("manifest") if n.isdigit()]
        if not versions:
            return 0, {}
        stream = self.fs.open(self._at(f"manifest/{max(versions)}"))
        try:
            return max(versions), json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, version: int, folders: dict[str, str]) -> None:
        draft = self._at(f"manifest/_{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(json.dumps(folders).encode()))
        stream.close()
        if self.fs.exists(self._at(f"manifest/{version}")) or not self.fs.rename(draft, self._at(f"manifest/{version}")):
            raise RuntimeError(f"another writer has put manifest {version} in place")
