"""Grades, gates, pass criteria and scalar QC formulas from plain rule tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runqc.functions import phred
from runqc.functions.common import count_where, first_match, fixed1, messages, pct

# Grade thresholds, best grade first. A grade needs every bound.
READ_QC_GRADES = [  # signal positive at least, unblock at most, short reads at most
    ("A", 95, 2, 1),
    ("B", 85, 5, 5),
    ("C", 75, 10, 15),
]
RUN_GRADES = [  # mean Q at least, pass rate at least
    ("A", 12, 90),
    ("B", 10, 80),
    ("C", 8, 70),
    ("D", 6, 50),
]
END_REASON_GRADES = [("A", 95, 2), ("B", 85, 5), ("C", 75, 10)]  # signal positive, unblock
EFFICIENCY_GRADES = [("A", 95, 2), ("B", 85, 5), ("C", 75, 15)]  # signal positive, rejection
LIBRARY_GRADES = [  # signal positive, short, dimer, concatemer
    ("A", 95, 1, 0.5, 2),
    ("B", 85, 5, 2, 5),
    ("C", 75, 15, 5, 15),
]

# Gates as (gate, metric, operator, threshold, warn threshold).
QC_GATES = [
    ("qc_sma_minimum", "sma_exact", ">=", 0.85, None),
    ("qc_signal_positive", "f_signal_positive", ">=", 0.70, 0.50),
    ("qc_q20_fraction", "f_q20", ">=", 0.90, None),
    ("qc_mapping_rate", "mapping_rate", ">=", 0.95, None),
    ("qc_identity", "identity", ">=", 0.99, None),
    ("qc_calibration_error", "ece", "<", 0.02, None),
    ("qc_maqd", "maqd", "<", 2.0, None),
    ("qc_brier_score", "brier", "<", 0.01, None),
]


def read_qc_grade(sp: str = "signal_positive_pct", unblock: str = "unblock_pct", short: str = "short_read_pct") -> Column:
    return first_match(
        [
            ((F.col(sp) >= a) & (F.col(unblock) <= b) & (F.col(short) <= c), g)
            for g, a, b, c in READ_QC_GRADES
        ],
        "D",
    )


def end_reason_grade(sp: str = "signal_positive_pct", unblock: str = "unblock_pct") -> Column:
    return first_match([((F.col(sp) >= a) & (F.col(unblock) <= b), g) for g, a, b in END_REASON_GRADES], "D")


def efficiency_grade(sp: str = "signal_positive_pct", rejection: str = "rejection_rate") -> Column:
    return first_match([((F.col(sp) >= a) & (F.col(rejection) <= b), g) for g, a, b in EFFICIENCY_GRADES], "D")


def library_grade() -> Column:
    """NULL when a library metric is missing; nothing is assumed in its place."""
    known = (
        F.col("short_read_pct").isNotNull()
        & F.col("adapter_dimer_pct").isNotNull()
        & F.col("concatemer_pct").isNotNull()
    )
    graded = first_match(
        [
            (
                (F.col("signal_positive_pct") >= sp)
                & (F.col("short_read_pct") <= short)
                & (F.col("adapter_dimer_pct") <= dimer)
                & (F.col("concatemer_pct") <= cat),
                g,
            )
            for g, sp, short, dimer, cat in LIBRARY_GRADES
        ],
        "D",
    )
    return F.when(known, graded)


def completeness_pct() -> Column:
    """Five presence checks over a run row, 0-100."""
    checks = [
        F.col("has_final_summary"),
        F.col("has_sequencing_summary") | F.col("has_report"),
        F.col("has_pod5") | F.col("has_fast5"),
        F.coalesce(F.col("total_reads") > 0, F.lit(False)),
        F.col("mean_qscore").isNotNull(),
    ]
    return (sum((c.cast("int") for c in checks), F.lit(0)) * 100 / len(checks)).cast("int")


def run_grade(runs: DataFrame) -> DataFrame:
    """Grade A-F, S (signal only) or ? (undetermined) with the issues behind it."""
    q, rate = F.coalesce("mean_qscore", F.lit(0.0)), F.coalesce("pass_rate", F.lit(0.0))
    no_files = ~(F.col("has_pod5") | F.col("has_fast5") | F.col("has_bam") | F.col("has_fastq"))
    no_reads = F.col("total_reads").isNull() | (F.col("total_reads") == 0)
    signal_only = F.col("mean_qscore").isNull()
    level = first_match([((q >= a) & (rate >= b), g) for g, a, b in RUN_GRADES], "F")
    graded = runs.withColumn("completeness_score", completeness_pct()).withColumn("_level", level)
    grade = first_match(
        [
            (no_files, "F"),
            (no_reads, "?"),
            (signal_only, "S"),
            ((F.col("_level") == "A") & (F.col("completeness_score") < 80), "B"),
        ],
        F.col("_level"),
    )
    below = lambda g, floor_q, floor_rate: [
        F.when(
            (F.col("_level") == g) & (q < floor_q),
            F.concat(F.lit("Q-score "), fixed1(q), F.lit(f" < {floor_q}")),
        ),
        F.when(
            (F.col("_level") == g) & (rate < floor_rate),
            F.concat(F.lit("Pass rate "), fixed1(rate), F.lit(f"% < {floor_rate}%")),
        ),
    ]
    low = lambda g, word: [
        F.when(F.col("_level") == g, F.concat(F.lit(f"{word} Q-score: "), fixed1(q))),
        F.when(F.col("_level") == g, F.concat(F.lit(f"{word} pass rate: "), fixed1(rate), F.lit("%"))),
    ]
    by_level = messages(
        F.when((F.col("_level") == "A") & ~F.col("has_final_summary"), F.lit("Missing final_summary.txt")),
        *below("B", 12, 90),
        *below("C", 10, 80),
        *low("D", "Low"),
        *low("F", "Very low"),
    )
    signal_issues = messages(
        F.lit("Q-score not available (basecalling required)"),
        F.when(
            F.col("n50") > 1000,
            F.concat(F.lit("Estimated N50: "), F.format_number(F.col("n50"), 0), F.lit(" bp")),
        ),
    )
    issues = (
        F.when(no_files, F.array(F.lit("No data files found")))
        .when(no_reads, F.array(F.lit("No read statistics available")))
        .when(signal_only, signal_issues)
        .otherwise(by_level)
    )
    return graded.withColumn("quality_grade", grade).withColumn("issues", issues).drop("_level")


def aggregate_runs(graded: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Totals over runs, Phred mean of run means, mean N50 and grade counts."""
    return graded.groupBy(*keys).agg(
        F.count("*").alias("experiment_count"),
        F.coalesce(F.sum("total_reads"), F.lit(0)).alias("total_reads"),
        F.coalesce(F.sum("total_bases"), F.lit(0)).alias("total_bases"),
        F.when(F.count("mean_qscore") > 0, phred.mean_q("mean_qscore")).alias("avg_qscore"),
        F.avg("n50").alias("avg_n50"),
        *[count_where(F.col("quality_grade") == g).alias(f"grade_{g.lower()}_count") for g in "ABCDF"],
        count_where(F.size("issues") > 0).alias("issues_count"),
    )


# Scalar formulas: name -> (inputs, expression, value when the denominator is not positive).
def _formulas() -> dict[str, tuple[list[str], Column]]:
    c = F.col
    reads, bases = c("total_reads").cast("double"), c("total_bases").cast("double")
    p_err = phred.error_prob("mean_qscore")
    pass_pct = F.try_divide(c("pass_reads") * F.lit(100.0), reads)
    sp = c("signal_positive_pct") / 100
    guard = lambda ok, value, other: F.when(ok, value).otherwise(F.lit(float(other)))
    return {
        "pass_rate": (["pass_reads", "total_reads"], guard(reads > 0, pass_pct, 0)),
        "signal_positive": (["signal_positive_pct"], c("signal_positive_pct")),
        "error_probability": (["mean_qscore"], p_err),
        "throughput_gb": (["total_bases"], bases / F.lit(1e9)),
        "mean_length": (["total_bases", "total_reads"], guard(reads > 0, F.try_divide(bases, reads), 0)),
        "accuracy": (["mean_qscore"], F.lit(1.0) - p_err),
        "reads_per_gb": (["total_reads", "total_bases"], guard(bases > 0, F.try_divide(reads * F.lit(1e9), bases), 0)),
        "errors_per_read": (
            ["total_bases", "total_reads", "mean_qscore"],
            guard(reads > 0, F.try_divide(bases, reads) * p_err, 0),
        ),
        "unblock_ratio": (
            ["unblock_pct", "signal_positive_pct"],
            guard(c("signal_positive_pct") > 0, F.try_divide(c("unblock_pct"), c("signal_positive_pct")), 0),
        ),
        "q20_equivalent_bases": (
            ["total_bases", "mean_qscore"],
            guard(c("mean_qscore") > 0, bases * (F.lit(1.0) - p_err) / F.lit(0.99), 0),
        ),
        "fail_rate": (["pass_reads", "total_reads"], guard(reads > 0, F.lit(100.0) - pass_pct, 100)),
        "log10_reads": (["total_reads"], guard(reads > 0, F.log10(reads), 0)),
        "proportion_se": (
            ["signal_positive_pct", "total_reads"],
            guard(reads > 0, F.sqrt(F.try_divide(sp * (F.lit(1.0) - sp), reads)) * 100, 0),
        ),
        "count_cv": (["total_reads"], guard(reads > 0, F.try_divide(F.lit(1.0), F.sqrt(reads)), 1)),
    }


def qc_equations(runs: DataFrame, keys: Sequence[str], user: Mapping[str, str] | None = None) -> DataFrame:
    """All formulas as columns; a formula with a missing input is NULL and named in ``missing``.

    ``user`` adds formulas as SQL expressions over the same row.
    """
    formulas = _formulas()
    values, gaps = [], []
    for name, (inputs, expr) in formulas.items():
        absent = [i for i in inputs if i not in runs.columns]
        if absent:
            values.append(F.lit(None).cast("double").alias(name))
            gaps.append(F.lit(name))
            continue
        known = F.lit(True)
        for i in inputs:
            known = known & F.col(i).isNotNull()
        values.append(F.when(known, expr).alias(name))
        gaps.append(F.when(~known, F.lit(name)))
    extra = [F.expr(text).alias(name) for name, text in (user or {}).items()]
    return runs.select(*keys, *values, *extra, messages(*gaps).alias("missing"))


def metric_rows(runs: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long form (keys, metric, value) of numeric metric columns."""
    typed = runs.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    return typed.unpivot(list(keys), list(metrics), "metric", "value")


def compare(value: Column, op: Column, threshold: Column) -> Column:
    return (
        F.when(op == ">=", value >= threshold)
        .when(op == "<=", value <= threshold)
        .when(op == ">", value > threshold)
        .when(op == "<", value < threshold)
        .when(op == "==", value == threshold)
    )


def gates(metrics: DataFrame, rules: Sequence[tuple] = QC_GATES) -> DataFrame:
    """pass / warn / fail of every gate that has its metric; ``metrics`` is the long form."""
    spark = metrics.sparkSession
    table = spark.createDataFrame(
        list(rules), "gate string, metric string, op string, threshold double, warn_threshold double"
    )
    passed = compare(F.col("value"), F.col("op"), F.col("threshold"))
    warned = compare(F.col("value"), F.col("op"), F.col("warn_threshold"))
    status = F.when(passed, "pass").when(F.coalesce(warned, F.lit(False)), "warn").otherwise("fail")
    # The rule table is the argument of this call, so its size is known here.
    return metrics.where(F.col("value").isNotNull()).join(F.broadcast(table), "metric").withColumn("status", status)


def pass_criteria(metrics: DataFrame, keys: Sequence[str], criteria: Mapping[str, str]) -> DataFrame:
    """All textual criteria (``>=0.8``, ``<5``, ``==OK``) hold; a missing metric fails.

    ``metrics`` is the long form with a string ``value``.
    """
    spark = metrics.sparkSession
    table = F.broadcast(spark.createDataFrame(list(criteria.items()), "metric string, rule string"))
    parsed = table.select(
        "metric",
        F.regexp_extract("rule", r"^(>=|<=|==|>|<)", 1).alias("op"),
        F.regexp_extract("rule", r"^(?:>=|<=|==|>|<)(.*)$", 1).alias("bound"),
    )
    number = compare(F.col("value").try_cast("double"), F.col("op"), F.col("bound").try_cast("double"))
    ok = F.when(F.col("op") == "==", F.col("value") == F.col("bound")).otherwise(number)
    checked = metrics.join(parsed, "metric").groupBy(*keys).agg(
        F.count_distinct(F.when(ok, F.col("metric"))).alias("met")
    )
    everyone = metrics.select(*keys).distinct()
    return everyone.join(checked, list(keys), "left").select(
        *keys,
        F.coalesce("met", F.lit(0)).alias("criteria_met"),
        (F.coalesce("met", F.lit(0)) == len(criteria)).alias("passed"),
    )


def normalise_metrics(metrics: DataFrame, lower_is_better: Sequence[str] = ()) -> DataFrame:
    """Min-max per metric to 0..1, inverted where lower is better, 0.5 if constant, NULL kept."""
    span = metrics.groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    scaled = F.when(
        F.col("hi") > F.col("lo"), F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo"))
    )
    scaled = F.when(F.col("metric").isin(list(lower_is_better)), F.lit(1.0) - scaled).otherwise(scaled) if lower_is_better else scaled
    value = F.when(F.col("value").isNotNull(), F.coalesce(scaled, F.lit(0.5)))
    return metrics.join(span, "metric").select(
        *[c for c in metrics.columns], value.alias("normalised")
    )


def library_rollup(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Read-weighted library metrics; a metric that no run has stays NULL."""
    reads = F.col("total_reads")
    weighted = lambda m: pct(
        F.sum(F.floor(reads * F.col(m) / 100)), F.sum("total_reads")
    )
    share = lambda m: F.when(F.count(m) > 0, weighted(m)).alias(m)
    return runs.groupBy(*keys).agg(
        F.sum("total_reads").alias("total_reads"),
        pct(F.sum("signal_positive"), F.sum("total_reads")).alias("signal_positive_pct"),
        share("short_read_pct"),
        share("adapter_dimer_pct"),
        share("concatemer_pct"),
    )


def comparison_matrix(runs: DataFrame) -> DataFrame:
    """Overall, by source and by adaptive status in one scan (grouping sets)."""
    dims = [F.col("source"), F.col("is_adaptive")]
    grouped = runs.groupingSets([[], [dims[0]], [dims[1]]], *dims).agg(
        F.grouping_id().alias("gid"),
        F.count("*").alias("n"),
        F.avg("signal_positive_pct").alias("mean_signal_positive_pct"),
        F.avg("unblock_pct").alias("mean_unblock_pct"),
        F.avg("rejection_rate").alias("mean_rejection_rate"),
    )
    level = F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, "source").otherwise("adaptive")
    group = (
        F.when(F.col("gid") == 3, F.lit("all"))
        .when(F.col("gid") == 1, F.col("source"))
        .otherwise(F.when(F.col("is_adaptive"), "adaptive").otherwise("non_adaptive"))
    )
    return grouped.select(
        level.alias("level"), group.alias("group"), "n",
        "mean_signal_positive_pct", "mean_unblock_pct", "mean_rejection_rate",
    )


def adaptive_summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("is_adaptive").agg(
        F.count("*").alias("n"),
        F.avg("signal_positive_pct").alias("mean_signal_positive"),
        F.stddev_pop("signal_positive_pct").alias("std_signal_positive"),
        F.avg("rejection_rate").alias("mean_rejection"),
        F.stddev_pop("rejection_rate").alias("std_rejection"),
    )


def breakdown_totals(runs: DataFrame, reasons: Sequence[str], grade: Column) -> DataFrame:
    """Totals and shares per reason, adaptive runs and grade counts over all experiments."""
    total = F.sum("total_reads")
    return runs.withColumn("_g", grade).agg(
        F.count("*").alias("n_experiments"),
        total.alias("total_reads"),
        *[F.sum(r).alias(r) for r in reasons],
        *[pct(F.sum(r), total).alias(f"{r}_pct") for r in reasons],
        count_where(F.col("is_adaptive")).alias("n_adaptive"),
        *[count_where(F.col("_g") == g).alias(f"grade_{g.lower()}") for g in "ABCD"],
    )


def mean_by_condition(runs: DataFrame, conditions: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean metrics per value of each condition column, unknown left out, in one scan."""
    cols = [F.col(c) for c in conditions]
    known = runs.select(
        *[F.when(F.lower(c) != "unknown", c).alias(n) for n, c in zip(conditions, cols)], *metrics
    )
    grouped = known.groupingSets([[c] for c in cols], *cols).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("n"), *[F.avg(m).alias(f"mean_{m}") for m in metrics]
    )
    last = len(conditions) - 1
    all_bits = 2 ** len(conditions) - 1
    name = first_match([(F.col("gid") == all_bits - 2 ** (last - i), c) for i, c in enumerate(conditions)])
    value = first_match([(F.col("gid") == all_bits - 2 ** (last - i), F.col(c)) for i, c in enumerate(conditions)])
    return grouped.select(
        name.alias("condition"), value.alias("value"), "n", *[f"mean_{m}" for m in metrics]
    ).where(F.col("value").isNotNull())


def dataset_rollup(runs: DataFrame) -> DataFrame:
    """Per dataset: experiments, totals, mean N50 and Phred mean over the positive ones."""
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    return runs.groupBy(F.coalesce("dataset", F.lit("unknown")).alias("dataset")).agg(
        F.count("*").alias("experiments"),
        F.sum("total_reads").alias("total_reads"),
        F.sum("total_bases").alias("total_bases"),
        F.avg(positive("n50")).alias("mean_n50"),
        F.when(F.count(positive("mean_qscore")) > 0, phred.mean_q(positive("mean_qscore"))).alias("mean_qscore"),
    )
