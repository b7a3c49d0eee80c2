"""Read-level summaries: quality, length, thresholds and the full statistics block."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runqc.functions import phred
from runqc.functions.common import count_where, pct
from runqc.operators import ranking


def phred_mean(reads: DataFrame, keys: Sequence[str]) -> DataFrame:
    return reads.groupBy(*keys).agg(phred.mean_q("qscore").alias("mean_qscore"))


def phred_mean_weighted(reads: DataFrame, keys: Sequence[str], weight: str = "length") -> DataFrame:
    return reads.groupBy(*keys).agg(phred.weighted_mean_q("qscore", weight).alias("mean_qscore"))


def q_thresholds(reads: DataFrame, keys: Sequence[str], cuts: Sequence[int] = (10, 20, 30)) -> DataFrame:
    """Reads at or above each quality, as counts and percentages, plus the pass rate."""
    n = F.count("*")
    aggs = [n.alias("total_reads")]
    for cut in cuts:
        hit = count_where(F.col("qscore") >= cut)
        aggs += [hit.alias(f"q{cut}_reads"), pct(hit, n).alias(f"q{cut}_pct")]
    return reads.groupBy(*keys).agg(*aggs, pct(count_where(F.col("passes")), n).alias("pass_rate"))


def read_statistics(reads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, bases, length and quality summary and time on pore, one row per group.

    Sums and extremes are one partial aggregation; N50 and the medians share one length
    histogram and one quality histogram.
    """
    n = F.count("*")
    base = reads.groupBy(*keys).agg(
        n.alias("total_reads"),
        count_where(F.col("passes")).alias("passed_reads"),
        count_where(~F.col("passes")).alias("failed_reads"),
        F.sum("length").alias("total_bases"),
        F.coalesce(F.sum(F.when(F.col("passes"), F.col("length"))), F.lit(0)).alias("passed_bases"),
        F.avg("length").alias("mean_read_length"),
        F.min("length").alias("min_read_length"),
        F.max("length").alias("max_read_length"),
        phred.mean_q("qscore").alias("mean_qscore"),
        F.avg("duration").alias("mean_duration"),
        (F.sum("duration") / 3600).alias("total_duration_hours"),
    )
    lengths = ranking.running(
        ranking.value_histogram(reads, keys, "length"), keys, "length", ["n", "total"], ranking.LENGTH_WIDTH
    ).groupBy(*keys).agg(
        ranking.upper_median("length").alias("median_read_length"),
        ranking.nx_value("length", 0.5).alias("n50"),
    )
    quality = ranking.running(
        ranking.value_histogram(reads, keys, "qscore"), keys, "qscore", ["n"], ranking.QUALITY_WIDTH
    ).groupBy(*keys).agg(ranking.upper_median("qscore").alias("median_qscore"))
    return base.join(lengths, list(keys), "left").join(quality, list(keys), "left")


def barcode_kit_summary(reads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Barcodes seen ('-' and empty mean none), their number, first kit and duplex reads."""
    seen = F.nullif(F.nullif(F.col("barcode_arrangement"), F.lit("-")), F.lit(""))
    kit = F.nullif(F.nullif(F.col("barcode_kit"), F.lit("-")), F.lit(""))
    duplex = (F.coalesce(F.col("duplex_parent_template"), F.lit("")) != "") | (
        F.coalesce(F.col("duplex_parent_complement"), F.lit("")) != ""
    )
    return reads.groupBy(*keys).agg(
        F.array_sort(F.collect_set(seen)).alias("barcodes"),
        F.count_distinct(seen).alias("barcode_count"),
        F.min(kit).alias("barcode_kit"),
        count_where(duplex).alias("duplex_read_count"),
    )


def warehouse_summary(warehouse: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return warehouse.groupBy(*keys).agg(
        F.count("*").alias("total_reads"),
        F.count("refseq_id").alias("matched_reads"),
        F.avg("readlen").alias("avg_readlen"),
        F.avg("q_bc").alias("avg_q_bc"),
        F.avg("q_ld").alias("avg_q_ld"),
        F.avg("ed").alias("avg_ed"),
    )


def sequence_multiplicity(sequences: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """How often identical sequences recur; the first grouping is combined before the shuffle."""
    copies = sequences.groupBy(*keys, seq).agg(F.count("*").alias("c"))
    return copies.groupBy(*keys).agg(
        F.count("*").alias("unique_sequences"),
        count_where(F.col("c") == 1).alias("singleton_sequences"),
        count_where(F.col("c") > 1).alias("multi_occurrence_sequences"),
        F.max("c").alias("max_occurrence"),
        F.avg("c").alias("mean_occurrence"),
    )


def exact_accuracy(pairs: DataFrame, keys: Sequence[str], read: str = "seq", ref: str = "ref_seq") -> DataFrame:
    """Share of reads equal to their reference."""
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg((F.col(read) == F.col(ref)).cast("double")).alias("sma_exact")
    )


def fasta_stats(records: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    return records.groupBy(*keys).agg(
        F.sum(F.length(seq)).alias("total_bases"), F.count("*").alias("num_sequences")
    )


def alignment_statistics(aln: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flag mix, mapping quality and indels per primary mapped read.

    Input columns: flag, mapq, cigar, nm, length. Mismatches are edit distance minus indels.
    """
    flag = F.col("flag")
    bit = lambda b: flag.bitwiseAND(b) != 0
    op_total = lambda op: F.aggregate(
        F.regexp_extract_all("cigar", F.lit(rf"(\d+){op}"), F.lit(1)),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x.cast("long"),
    )
    rows = aln.withColumn("_mapped", ~bit(4)).withColumn("_primary", ~bit(4) & ~bit(256) & ~bit(2048))
    rows = rows.withColumn("_ins", op_total("I")).withColumn("_del", op_total("D"))
    primary = F.col("_primary")
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("total_records"),
        count_where(F.col("_mapped")).alias("mapped"),
        pct(count_where(F.col("_mapped")), F.count("*")).alias("mapped_pct"),
        count_where(primary).alias("primary"),
        count_where(bit(256)).alias("secondary"),
        count_where(bit(2048)).alias("supplementary"),
        F.avg(F.when(primary, F.col("mapq"))).alias("mean_mapq"),
        count_where(primary & (F.col("mapq") >= 60)).alias("mapq60_reads"),
        F.avg(F.when(primary, F.col("_ins"))).alias("insertions_per_read"),
        F.avg(F.when(primary, F.col("_del"))).alias("deletions_per_read"),
        F.avg(F.when(primary, F.greatest(F.col("nm") - F.col("_ins") - F.col("_del"), F.lit(0)))).alias(
            "mismatches_per_read"
        ),
    )
    mains = rows.where("_primary")
    mapq = ranking.quantiles(mains, keys, "mapq", {"median_mapq": 0.5}, 1.0)
    return base.join(mapq, list(keys), "left").join(ranking.nx(mains, keys), list(keys), "left")
