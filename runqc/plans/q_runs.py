"""Grades, gates, formulas and cross-experiment tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from runqc.operators import grades as G
from runqc.operators import registry as X
from runqc.plans.catalog import query
from runqc.plans.q_reads import r, rounded

METRICS = ["signal_positive_pct", "mean_qscore", "n50", "pass_rate", "total_reads"]

# Grade text shared by oracles.
G1 = "case when sp >= 95 and ub <= 2 and sr <= 1 then 'A' when sp >= 85 and ub <= 5 and sr <= 5 then 'B' when sp >= 75 and ub <= 10 and sr <= 15 then 'C' else 'D' end"
SHIFTED = """x as (select exp_id, total_reads, 60 + signal_positive_pct as sp, unblock_pct / 12 as ub, short_read_pct as sr,
  adapter_dimer_pct as ad, concatemer_pct as cc, rejection_rate / 12 as rr from runs)"""


def shifted(v):
    """Run rates moved into the range the grade thresholds separate."""
    return v.runs.select(
        "exp_id", "total_reads",
        (F.col("signal_positive_pct") + 60).alias("signal_positive_pct"),
        (F.col("unblock_pct") / 12).alias("unblock_pct"),
        (F.col("rejection_rate") / 12).alias("rejection_rate"),
        "short_read_pct", "adapter_dimer_pct", "concatemer_pct",
    )


@query("grade_g1", f"with {SHIFTED} select exp_id, {G1} as grade from x", ("runs",))
def grade_g1(v):
    return shifted(v).select("exp_id", G.read_qc_grade().alias("grade"))


FLAGGED = """f as (select exp_id,
  case when exp_id % 13 = 5 then null else total_reads end as total_reads, total_bases, n50,
  case when exp_id % 11 = 3 then null else mean_qscore + exp_id % 9 end as mean_qscore,
  pass_rate + exp_id % 50 as pass_rate, exp_id % 2 = 0 as has_final_summary, exp_id % 3 != 0 as has_sequencing_summary,
  false as has_report, exp_id % 17 != 4 as has_pod5, false as has_fast5, exp_id % 17 != 4 as has_bam, false as has_fastq from runs),
lv as (select *, coalesce(mean_qscore, 0) as q, coalesce(pass_rate, 0) as pr,
  cast((cast(has_final_summary as int) + cast(has_sequencing_summary or has_report as int) + cast(has_pod5 or has_fast5 as int)
    + cast(coalesce(total_reads > 0, false) as int) + cast(mean_qscore is not null as int)) * 100 / 5 as int) as completeness_score,
  case when coalesce(mean_qscore, 0) >= 12 and coalesce(pass_rate, 0) >= 90 then 'A' when coalesce(mean_qscore, 0) >= 10 and coalesce(pass_rate, 0) >= 80 then 'B'
    when coalesce(mean_qscore, 0) >= 8 and coalesce(pass_rate, 0) >= 70 then 'C' when coalesce(mean_qscore, 0) >= 6 and coalesce(pass_rate, 0) >= 50 then 'D' else 'F' end as lvl from f),
g as (select *, case when not (has_pod5 or has_fast5 or has_bam or has_fastq) then 'F' when total_reads is null or total_reads = 0 then '?'
    when mean_qscore is null then 'S' when lvl = 'A' and completeness_score < 80 then 'B' else lvl end as quality_grade,
  case when not (has_pod5 or has_fast5 or has_bam or has_fastq) then 'No data files found'
    when total_reads is null or total_reads = 0 then 'No read statistics available'
    when mean_qscore is null then concat_ws('; ', 'Q-score not available (basecalling required)',
      case when n50 > 1000 then 'Estimated N50: ' || format('{:,}', n50) || ' bp' end)
    else concat_ws('; ',
      case when lvl = 'A' and not has_final_summary then 'Missing final_summary.txt' end,
      case when lvl = 'B' and q < 12 then 'Q-score ' || printf('%.1f', q) || ' < 12' end,
      case when lvl = 'B' and pr < 90 then 'Pass rate ' || printf('%.1f', pr) || '% < 90%' end,
      case when lvl = 'C' and q < 10 then 'Q-score ' || printf('%.1f', q) || ' < 10' end,
      case when lvl = 'C' and pr < 80 then 'Pass rate ' || printf('%.1f', pr) || '% < 80%' end,
      case when lvl = 'D' then 'Low Q-score: ' || printf('%.1f', q) end, case when lvl = 'D' then 'Low pass rate: ' || printf('%.1f', pr) || '%' end,
      case when lvl = 'F' then 'Very low Q-score: ' || printf('%.1f', q) end, case when lvl = 'F' then 'Very low pass rate: ' || printf('%.1f', pr) || '%' end)
  end as issues from lv)"""


def flagged(v):
    k = F.col("exp_id")
    return v.runs.select(
        "exp_id",
        F.when(k % 13 != 5, F.col("total_reads")).alias("total_reads"),
        "total_bases", "n50",
        F.when(k % 11 != 3, F.col("mean_qscore") + k % 9).alias("mean_qscore"),
        (F.col("pass_rate") + k % 50).alias("pass_rate"),
        (k % 2 == 0).alias("has_final_summary"),
        (k % 3 != 0).alias("has_sequencing_summary"),
        F.lit(False).alias("has_report"),
        (k % 17 != 4).alias("has_pod5"),
        F.lit(False).alias("has_fast5"),
        (k % 17 != 4).alias("has_bam"),
        F.lit(False).alias("has_fastq"),
    )


@query("grade_g2", f"with {FLAGGED} select exp_id, quality_grade, completeness_score, issues from g", ("runs",))
def grade_g2(v):
    out = G.run_grade(flagged(v))
    return out.select("exp_id", "quality_grade", "completeness_score", F.array_join("issues", "; ").alias("issues"))


@query("grade_g3", f"""with {SHIFTED} select exp_id, case when sp >= 95 and ub <= 2 then 'A' when sp >= 85 and ub <= 5 then 'B'
  when sp >= 75 and ub <= 10 then 'C' else 'D' end as grade from x""", ("runs",))
def grade_g3(v):
    return shifted(v).select("exp_id", G.end_reason_grade().alias("grade"))


@query("grade_g4", f"""with {SHIFTED} select exp_id, case when sp >= 95 and rr <= 2 then 'A' when sp >= 85 and rr <= 5 then 'B'
  when sp >= 75 and rr <= 15 then 'C' else 'D' end as grade from x""", ("runs",))
def grade_g4(v):
    return shifted(v).select("exp_id", G.efficiency_grade().alias("grade"))


@query("grade_g5", f"""with {SHIFTED} select exp_id, case when sp >= 95 and sr <= 1 and ad <= 0.5 and cc <= 2 then 'A'
  when sp >= 85 and sr <= 5 and ad <= 2 and cc <= 5 then 'B' when sp >= 75 and sr <= 15 and ad <= 5 and cc <= 15 then 'C' else 'D' end as grade from x""", ("runs",))
def grade_g5(v):
    return shifted(v).select("exp_id", G.library_grade().alias("grade"))


@query("aggregate_summaries", f"""with {FLAGGED} select exp_id % 4 as pool, count(*) as experiment_count,
  cast(coalesce(sum(total_reads), 0) as bigint) as total_reads, cast(coalesce(sum(total_bases), 0) as bigint) as total_bases,
  round(-10 * log10(avg(pow(10, -mean_qscore / 10))), 6) as avg_qscore, round(avg(n50), 6) as avg_n50,
  count(*) filter (quality_grade = 'A') as grade_a_count, count(*) filter (quality_grade = 'B') as grade_b_count,
  count(*) filter (quality_grade = 'C') as grade_c_count, count(*) filter (quality_grade = 'D') as grade_d_count,
  count(*) filter (quality_grade = 'F') as grade_f_count, count(*) filter (issues != '') as issues_count
from g group by 1""", ("runs",))
def aggregate_summaries(v):
    graded = G.run_grade(flagged(v)).withColumn("pool", F.col("exp_id") % 4)
    return rounded(G.aggregate_runs(graded, ["pool"]), "avg_qscore", "avg_n50")


def sourced(v):
    return v.runs.join(v.experiments.select("exp_id", "source", "flowcell", "sample", "device"), "exp_id").withColumn(
        "is_adaptive", F.col("rejection_rate") > 66.7
    )


SOURCED = """s as (select r.* exclude (is_adaptive), rejection_rate > 66.7 as is_adaptive, e.source, e.flowcell, e.sample, e.device
  from runs r join experiments e using (exp_id))"""


@query("comparison_matrix", f"""with {SOURCED},
u as (select 'all' as level, 'all' as "group", * from s union all select 'source', source, * from s
  union all select 'adaptive', case when is_adaptive then 'adaptive' else 'non_adaptive' end, * from s)
select level, "group", count(*) as n, round(avg(signal_positive_pct), 6) as mean_signal_positive_pct,
  round(avg(unblock_pct), 6) as mean_unblock_pct, round(avg(rejection_rate), 6) as mean_rejection_rate from u group by all""", ("runs", "experiments"))
def comparison_matrix(v):
    return rounded(G.comparison_matrix(sourced(v)), "mean_signal_positive_pct", "mean_unblock_pct", "mean_rejection_rate")


@query("adaptive_summary", f"""with {SOURCED} select is_adaptive, count(*) as n, round(avg(signal_positive_pct), 6) as mean_signal_positive,
  round(stddev_pop(signal_positive_pct), 6) as std_signal_positive, round(avg(rejection_rate), 6) as mean_rejection,
  round(stddev_pop(rejection_rate), 6) as std_rejection from s group by 1""", ("runs", "experiments"))
def adaptive_summary(v):
    out = G.adaptive_summary(sourced(v))
    return rounded(out, *[c for c in out.columns if c.startswith(("mean", "std"))])


@query("sp_mean_std", """select round(avg(signal_positive_pct), 6) as mean_sp, round(stddev_pop(signal_positive_pct), 6) as std_sp, count(*) as n from runs""", ("runs",))
def sp_mean_std(v):
    return v.runs.agg(
        r(F.avg("signal_positive_pct")).alias("mean_sp"), r(F.stddev_pop("signal_positive_pct")).alias("std_sp"),
        F.count("*").alias("n"),
    )


@query("breakdown_totals", f"""with {SOURCED}, g as (select *, case when signal_positive_pct >= 34 and unblock_pct <= 33 then 'A' else 'D' end as gr from s)
select count(*) as n_experiments, cast(sum(total_reads) as bigint) as total_reads, cast(sum(signal_positive) as bigint) as signal_positive,
  cast(sum(unblock_mux_change) as bigint) as unblock_mux_change, cast(sum(data_service_unblock_mux_change) as bigint) as data_service_unblock_mux_change,
  round(sum(signal_positive) * 100.0 / sum(total_reads), 6) as signal_positive_pct, round(sum(unblock_mux_change) * 100.0 / sum(total_reads), 6) as unblock_mux_change_pct,
  round(sum(data_service_unblock_mux_change) * 100.0 / sum(total_reads), 6) as data_service_unblock_mux_change_pct,
  count(*) filter (is_adaptive) as n_adaptive, count(*) filter (gr = 'A') as grade_a, count(*) filter (gr = 'B') as grade_b,
  count(*) filter (gr = 'C') as grade_c, count(*) filter (gr = 'D') as grade_d from g""", ("runs", "experiments"))
def breakdown_totals(v):
    reasons = ["signal_positive", "unblock_mux_change", "data_service_unblock_mux_change"]
    grade = F.when((F.col("signal_positive_pct") >= 34) & (F.col("unblock_pct") <= 33), "A").otherwise("D")
    runs = sourced(v).drop("signal_positive_pct_", "unblock_mux_change_pct")
    return rounded(G.breakdown_totals(runs, reasons, grade), *[f"{x}_pct" for x in reasons])


@query("mean_pct_by_condition", f"""with {SOURCED}, u as (
  select 'flowcell' as condition, flowcell as value, * from s union all select 'source', source, * from s union all select 'sample', sample, * from s)
select condition, value, count(*) as n, round(avg(signal_positive_pct), 6) as mean_signal_positive_pct, round(avg(unblock_pct), 6) as mean_unblock_pct
from u where lower(value) != 'unknown' group by all""", ("runs", "experiments"))
def mean_pct_by_condition(v):
    out = G.mean_by_condition(sourced(v), ["flowcell", "source", "sample"], ["signal_positive_pct", "unblock_pct"])
    return rounded(out, "mean_signal_positive_pct", "mean_unblock_pct")


@query("qc_equations", """with e as (select exp_id, case when exp_id % 7 = 2 then null else mean_qscore end as q, total_reads * 1.0 as n, total_bases * 1.0 as b,
  passed_reads as p, signal_positive_pct as sp, unblock_pct as ub from runs)
select exp_id, round(p * 100.0 / n, 6) as pass_rate, round(sp, 6) as signal_positive, round(pow(10, -q / 10), 9) as error_probability, round(b / 1e9, 9) as throughput_gb,
  round(b / n, 6) as mean_length, round(1 - pow(10, -q / 10), 9) as accuracy, round(n * 1e9 / b, 6) as reads_per_gb, round(b / n * pow(10, -q / 10), 6) as errors_per_read,
  round(ub / sp, 6) as unblock_ratio, round(case when q > 0 then b * (1 - pow(10, -q / 10)) / 0.99 when q is not null then 0 end, 3) as q20_equivalent_bases,
  round(100 - p * 100.0 / n, 6) as fail_rate, round(log10(n), 9) as log10_reads, round(sqrt(sp / 100 * (1 - sp / 100) / n) * 100, 9) as proportion_se,
  round(1 / sqrt(n), 9) as count_cv, case when q is null then 'error_probability,accuracy,errors_per_read,q20_equivalent_bases' else '' end as missing,
  round(n * 2, 6) as user_metric from e""", ("runs",))
def qc_equations(v):
    runs = v.runs.withColumnRenamed("passed_reads", "pass_reads").withColumn(
        "mean_qscore", F.when(F.col("exp_id") % 7 != 2, F.col("mean_qscore"))
    )
    out = G.qc_equations(runs, ["exp_id"], {"user_metric": "total_reads * 2"})
    nine = ["error_probability", "throughput_gb", "accuracy", "log10_reads", "proportion_se", "count_cv"]
    six = ["pass_rate", "signal_positive", "mean_length", "reads_per_gb", "errors_per_read", "unblock_ratio", "fail_rate"]
    out = rounded(rounded(rounded(out, *nine, places=9), *six), "q20_equivalent_bases", places=3)
    return out.withColumn("missing", F.array_join("missing", ","))


GATE_SQL = """m as (select exp_id, unnest(['f_signal_positive', 'f_q20', 'mapping_rate']) as metric,
  unnest([case when exp_id % 5 = 1 then null else (40 + signal_positive_pct) / 100 end, mean_qscore / 15, pass_rate / 51]) as value from runs)"""


def gate_metrics(v):
    runs = v.runs.select(
        "exp_id",
        F.when(F.col("exp_id") % 5 != 1, (F.col("signal_positive_pct") + 40) / 100).alias("f_signal_positive"),
        (F.col("mean_qscore") / 15).alias("f_q20"),
        (F.col("pass_rate") / 51).alias("mapping_rate"),
    )
    return G.metric_rows(runs, ["exp_id"], ["f_signal_positive", "f_q20", "mapping_rate"])


@query("qc_gates", f"""with {GATE_SQL} select exp_id, metric, round(value, 6) as value,
  case metric when 'f_signal_positive' then case when value >= 0.70 then 'pass' when value >= 0.50 then 'warn' else 'fail' end
    when 'f_q20' then case when value >= 0.90 then 'pass' else 'fail' end else case when value >= 0.95 then 'pass' else 'fail' end end as status
from m where value is not null""", ("runs",))
def qc_gates(v):
    return rounded(G.gates(gate_metrics(v)).select("exp_id", "metric", "value", "status"), "value")


@query("pass_criteria", f"""with {GATE_SQL}, t as (
  select exp_id, cast(max(coalesce((value >= 0.7)::int, 0)) filter (metric = 'f_signal_positive') + max((value < 0.9)::int) filter (metric = 'f_q20') as bigint) as met from m group by exp_id)
select exp_id, met as criteria_met, met = 2 as passed from t""", ("runs",))
def pass_criteria(v):
    rows = gate_metrics(v).withColumn("value", F.col("value").cast("string"))
    return G.pass_criteria(rows, ["exp_id"], {"f_signal_positive": ">=0.7", "f_q20": "<0.9"})


@query("metrics_normalised", """
with u as (unpivot (select exp_id, cast(signal_positive_pct as double) as signal_positive_pct, cast(mean_qscore as double) as mean_qscore,
    cast(n50 as double) as n50, cast(rejection_rate as double) as rejection_rate, cast(1 as double) as constant from runs)
  on signal_positive_pct, mean_qscore, n50, rejection_rate, constant into name metric value value),
s as (select *, min(value) over (partition by metric) as lo, max(value) over (partition by metric) as hi from u)
select exp_id, metric, round(value, 6) as value, round(case when hi > lo then case when metric = 'rejection_rate' then 1 - (value - lo) / (hi - lo)
  else (value - lo) / (hi - lo) end else 0.5 end, 6) as normalised from s""", ("runs",))
def metrics_normalised(v):
    names = ["signal_positive_pct", "mean_qscore", "n50", "rejection_rate", "constant"]
    rows = G.metric_rows(v.runs.withColumn("constant", F.lit(1.0)), ["exp_id"], names)
    return rounded(G.normalise_metrics(rows, ["rejection_rate"]), "value", "normalised")


@query("comparison_table", """
select metric, round(max(value) filter (device = 'AFRICA'), 6) as "AFRICA", round(max(value) filter (device = 'AMERICA'), 6) as "AMERICA",
  round(max(value) filter (device = 'ASIA'), 6) as "ASIA", round(max(value) filter (device = 'EUROPE'), 6) as "EUROPE", round(max(value) filter (device = 'MIDDLE EAST'), 6) as "MIDDLE EAST"
from (unpivot (select device, avg(signal_positive_pct) as signal_positive_pct, avg(mean_qscore) as mean_qscore, avg(n50) as n50
  from runs join experiments using (exp_id) group by device) on signal_positive_pct, mean_qscore, n50 into name metric value value) group by metric""", ("runs", "experiments"))
def comparison_table(v):
    names = ["signal_positive_pct", "mean_qscore", "n50"]
    per = sourced(v).groupBy("device").agg(*[F.avg(n).alias(n) for n in names])
    devices = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    wide = G.metric_rows(per, ["device"], names).groupBy("metric").pivot("device", devices).agg(F.max("value"))
    return rounded(wide, *devices)


@query("library_rollup", """select exp_id % 5 as pool, cast(sum(total_reads) as bigint) as total_reads, round(sum(signal_positive) * 100.0 / sum(total_reads), 6) as signal_positive_pct,
  case when exp_id % 5 != 4 then round(sum(floor(total_reads * short_read_pct / 100)) * 100.0 / sum(total_reads), 6) end as short_read_pct,
  round(sum(floor(total_reads * adapter_dimer_pct / 100)) * 100.0 / sum(total_reads), 6) as adapter_dimer_pct,
  round(sum(floor(total_reads * concatemer_pct / 100)) * 100.0 / sum(total_reads), 6) as concatemer_pct from runs group by exp_id % 5""", ("runs",))
def library_rollup(v):
    runs = v.runs.withColumn("pool", F.col("exp_id") % 5).withColumn(
        "short_read_pct", F.when(F.col("pool") != 4, F.col("short_read_pct"))
    )
    return rounded(G.library_rollup(runs, ["pool"]), "signal_positive_pct", "short_read_pct", "adapter_dimer_pct", "concatemer_pct")


@query("dataset_rollup", f"""with {SOURCED} select coalesce(case when source != 'unknown' then source end, 'unknown') as dataset, count(*) as experiments,
  cast(sum(total_reads) as bigint) as total_reads, cast(sum(total_bases) as bigint) as total_bases, round(avg(n50) filter (n50 > 0), 6) as mean_n50,
  round(-10 * log10(avg(pow(10, -mean_qscore / 10)) filter (mean_qscore > 0)), 6) as mean_qscore from s group by 1""", ("runs", "experiments"))
def dataset_rollup(v):
    runs = sourced(v).withColumn("dataset", F.when(F.col("source") != "unknown", F.col("source")))
    return rounded(G.dataset_rollup(runs), "mean_n50", "mean_qscore")


@query("n50_ranking", "select exp_id, n50 from runs order by n50 desc, exp_id", ("runs",))
def n50_ranking(v):
    return v.runs.select("exp_id", "n50").orderBy(F.desc("n50"), "exp_id")


@query("n50_extremes", """select arg_max(exp_id, (n50, -exp_id)) as best_exp, max(n50) as best_n50, round(avg(n50), 6) as mean_n50, min(n50) as worst_n50 from runs""", ("runs",))
def n50_extremes(v):
    return v.runs.agg(
        F.max_by("exp_id", F.struct("n50", -F.col("exp_id"))).alias("best_exp"), F.max("n50").alias("best_n50"),
        r(F.avg("n50")).alias("mean_n50"), F.min("n50").alias("worst_n50"),
    )


@query("mode_ranking", f"""with {SOURCED} select exp_id, case when is_adaptive then 'Adaptive' else 'Standard' end as mode, round(signal_positive_pct, 1) as sp
from s order by is_adaptive desc, signal_positive_pct desc, exp_id""", ("runs", "experiments"))
def mode_ranking(v):
    mode = F.when(F.col("is_adaptive"), "Adaptive").otherwise("Standard")
    ordered = sourced(v).orderBy(F.desc("is_adaptive"), F.desc("signal_positive_pct"), "exp_id")
    return ordered.select("exp_id", mode.alias("mode"), r(F.col("signal_positive_pct"), 1).alias("sp"))


@query("source_fallback", """
with s as (select exp_id, case end_reason when 'unblock_mux_change' then 'bam' when 'signal_positive' then (case when exp_id % 3 = 0 then 'pod5' else 'fastq' end) else 'pod5' end as source,
  count(*) as n, cast(sum(length) as bigint) as bases from reads group by all),
k as (select * from s)
select exp_id, arg_min(source, rank) as source, arg_min(n, rank) as n, arg_min(bases, rank) as bases
from (select *, case source when 'fastq' then 2 when 'bam' then 3 else 4 end as rank from k) group by exp_id""", ("reads",))
def source_fallback(v):
    from runqc.sources.inventory import preferred_stats

    kind = F.when(F.col("end_reason") == "unblock_mux_change", "bam").when(
        (F.col("end_reason") == "signal_positive") & (F.col("exp_id") % 3 != 0), "fastq").otherwise("pod5")
    stats = v.reads.groupBy("exp_id", kind.alias("source")).agg(F.count("*").alias("n"), F.sum("length").alias("bases"))
    return preferred_stats(stats, ["exp_id"])


DOC_SQL = """d as (select exp_id, case when exp_id % 10 = 3 then null else 'exp-' || substring(md5(cast(exp_id as varchar)), 1, case when exp_id % 4 = 0 then 5 else 8 end) end as id, name,
  case exp_id % 4 when 0 then 'local' when 1 then 'ont-open-data' when 2 then 'unknown' else 'other' end as source,
  case when exp_id % 3 = 0 then sample end as sample, case when exp_id % 2 = 0 then device end as device_type, flowcell as flowcell_id,
  case when exp_id % 5 != 0 then 'R10.4.1' end as chemistry, case when exp_id % 6 = 0 then '' else 'sup' end as basecall_model,
  case when exp_id % 4 = 0 then 'MinION' end as flowcell_type, case when exp_id % 3 = 1 then 0 else total_reads end as sampled,
  mean_qscore, n50, case when exp_id % 8 = 1 then 'https://x' end as https_url, case when exp_id % 12 = 1 then 'https://y' end as browser_url
  from runs join experiments using (exp_id))"""


def documents(v):
    k = F.col("exp_id")
    e = v.runs.join(v.experiments, "exp_id")
    return e.select(
        "exp_id",
        F.when(k % 10 != 3, F.concat(F.lit("exp-"), F.when(k % 4 == 0, F.substring(F.md5(k.cast("string")), 1, 5))
                                     .otherwise(F.substring(F.md5(k.cast("string")), 1, 8)))).alias("id"),
        "name",
        F.when(k % 4 == 0, "local").when(k % 4 == 1, "ont-open-data").when(k % 4 == 2, "unknown").otherwise("other").alias("source"),
        F.when(k % 3 == 0, F.col("sample")).alias("sample"),
        F.when(k % 2 == 0, F.col("device")).alias("device_type"),
        F.col("flowcell").alias("flowcell_id"),
        F.when(k % 5 != 0, "R10.4.1").alias("chemistry"),
        F.when(k % 6 == 0, "").otherwise("sup").alias("basecall_model"),
        F.when(k % 4 == 0, "MinION").alias("flowcell_type"),
        F.when(k % 3 == 1, 0).otherwise(F.col("total_reads")).alias("sampled"),
        "mean_qscore", "n50",
        F.when(k % 8 == 1, "https://x").alias("https_url"),
        F.when(k % 12 == 1, "https://y").alias("browser_url"),
    )


COMPLETE_SQL = DOC_SQL + """,
k as (select exp_id, [case when coalesce(id, '') != '' then 'id' end, case when coalesce(name, '') != '' then 'name' end, case when coalesce(source, '') != '' then 'source' end,
    case when coalesce(sample, '') != '' then 'sample' end, case when coalesce(device_type, '') != '' then 'device_type' end, case when coalesce(flowcell_type, '') != '' then 'flowcell_type' end,
    case when coalesce(chemistry, '') != '' then 'chemistry' end, case when coalesce(basecall_model, '') != '' then 'basecall_model' end, case when coalesce(flowcell_id, '') != '' then 'flowcell_id' end,
    case when coalesce(sampled, 0) != 0 then 'sampled' end, case when coalesce(mean_qscore, 0) != 0 then 'mean_qscore' end, case when coalesce(n50, 0) != 0 then 'n50' end] as p,
  ['id','name','source','sample','device_type','flowcell_type','chemistry','basecall_model','flowcell_id','sampled','mean_qscore','n50'] as f,
  [10,10,10,15,8,7,10,10,5,10,8,7] as w from d),
c as (select exp_id, cast(list_sum(list_transform(range(1, 13), lambda i: case when p[i] is not null then w[i] else 0 end)) as int) as score,
  list_filter(f, lambda x: not list_contains(p, x)) as missing, list_filter(p, lambda x: x is not null) as present from k),
s as (select *, cast(round(score * 100.0 / 110) as int) as percentage from c),
scored as (select *, case when percentage >= 80 then 'good' when percentage >= 50 then 'warning' else 'poor' end as status from s)"""


@query("completeness", f"""with {COMPLETE_SQL} select exp_id, score, percentage, status, array_to_string(missing, ',') as missing, array_to_string(present, ',') as present from scored""", ("runs", "experiments"))
def completeness(v):
    out = X.completeness(documents(v), ["exp_id"])
    return out.select("exp_id", "score", "percentage", "status", F.array_join("missing", ",").alias("missing"), F.array_join("present", ",").alias("present"))


VALID_SQL = DOC_SQL + """,
valid as (select exp_id, concat_ws('; ', case when id is null then 'id: absent' end, case when source = 'unknown' then 'source: absent or unknown' end) as errors,
  concat_ws('; ', case when id is not null and not regexp_matches(id, '^exp-[a-f0-9]{8}$') then 'id: other form: ' || id end,
    case when source = 'other' then 'source: not a listed one: other' end,
    case when source = 'ont-open-data' and https_url is null then 'https_url: absent though public' end,
    case when source = 'ont-open-data' and browser_url is null then 'browser_url: absent though public' end,
    case when sample is null and device_type is null then 'sample, device_type: both absent' end,
    case when exp_id % 2 = 1 then 'metrics: legacy numbers only' end,
    case when exp_id % 7 = 0 then 'schema_version: absent' end) as warnings from d)"""


def validated(v):
    rows = documents(v).select(
        "*", F.lit(0.0).alias("mean_quality"), F.lit(0).alias("total_reads"),
        F.when(F.col("exp_id") % 2 == 0, '{"mean_qscore": 12.5}').when(F.col("exp_id") % 3 == 0, " {}").alias("quality_metrics"),
        F.when(F.col("exp_id") % 7 != 0, F.lit("2")).alias("schema_version"),
    )
    return X.validate(rows, ["exp_id"])


@query("validate_experiments", f"with {VALID_SQL} select *, errors = '' as is_valid from valid", ("runs", "experiments"))
def validate_experiments(v):
    out = validated(v)
    return out.select("exp_id", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"), "is_valid")


AUDIT_SQL = COMPLETE_SQL + VALID_SQL[len(DOC_SQL):]


@query("audit_registry", f"""with {AUDIT_SQL}
select 'validity' as section, case when errors = '' then 'valid' else 'invalid' end as name, count(*) as n from valid group by all
union all select 'status', status, count(*) from scored group by all
union all select 'missing', m, count(*) from (select unnest(missing) as m from scored) group by all""", ("runs", "experiments"))
def audit_registry(v):
    return X.audit(validated(v), X.completeness(documents(v), ["exp_id"]), "exp_id")


@query("needing_attention", f"""with {COMPLETE_SQL} select exp_id, percentage, array_to_string(missing, ',') as missing from scored where percentage < 80""", ("runs", "experiments"))
def needing_attention(v):
    out = X.needing_attention(X.completeness(documents(v), ["exp_id"]))
    return out.select("exp_id", "percentage", F.array_join("missing", ",").alias("missing"))
