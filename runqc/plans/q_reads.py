"""Quality, length and end-reason queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from runqc.functions import endreason as er
from runqc.functions import phred
from runqc.functions import sequence as sq
from runqc.operators import distributions as D
from runqc.operators import endreasons as E
from runqc.operators import ranking
from runqc.operators import reads as R
from runqc.plans.catalog import query

EXP = ["exp_id"]
PHRED_SQL = "-10 * log10(avg(pow(10, -qscore / 10)))"


def r(c, places=6):
    return F.round(c, places)


def rounded(df, *names, places=6):
    return df.withColumns({n: F.round(F.col(n), places) for n in names})


@query("qscore_to_prob", "select read_id, round(pow(10, -qscore / 10), 9) as error_prob from reads", ("reads",))
def qscore_to_prob(v):
    return v.reads.select("read_id", r(phred.error_prob("qscore"), 9).alias("error_prob"))


@query("prob_to_qscore", """
select l_orderkey, l_linenumber, l_partkey, round(case when l_discount <= 0 then 60 else least(-10 * log10(l_discount), 60) end, 6) as q
from lineitem""")
def prob_to_qscore(v):
    return v.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", r(phred.to_qscore("l_discount")).alias("q")
    )


@query("q_to_accuracy", "select read_id, round((1 - pow(10, -qscore / 10)) * 100, 6) as accuracy_pct from reads", ("reads",))
def q_to_accuracy(v):
    return v.reads.select("read_id", r(phred.accuracy_pct("qscore")).alias("accuracy_pct"))


@query("read_mean_q", """
select read_id, length, round(least(-10 * log10(
  list_sum(list_transform(string_split(qual, ''), lambda c: pow(10, -(ascii(c) - 33) / 10.0))) / length(qual)), 60), 6) as mean_q
from sentences""", ("sentences",))
def read_mean_q(v):
    return v.sentences.select("read_id", "length", r(phred.string_mean_q("qual")).alias("mean_q"))


@query("pass_by_read_quality", """
select experiment, count(*) as total_reads, count(*) filter (q >= 10) as pass_reads,
  round(count(*) filter (q >= 10) * 100.0 / count(*), 6) as pass_rate
from (select experiment, -10 * log10(list_sum(list_transform(string_split(qual, ''), lambda c: pow(10, -(ascii(c) - 33) / 10.0)))
  / length(qual)) as q from sentences) group by experiment""", ("sentences",))
def pass_by_read_quality(v):
    scored = v.sentences.select("experiment", (phred.string_mean_q("qual") >= 10).alias("ok"))
    return scored.groupBy("experiment").agg(
        F.count("*").alias("total_reads"), F.count_if("ok").alias("pass_reads"),
        r(F.count_if("ok") * 100.0 / F.count("*")).alias("pass_rate"),
    )


@query("q_ld", """
select read_id, round(-10 * log10(least(greatest(1.0 / (length * length), duration / length), 1.0)), 6) as q_ld from reads""", ("reads",))
def q_ld(v):
    return v.reads.select("read_id", r(phred.edit_quality("duration", "length")).alias("q_ld"))


@query("phred_mean", f"select exp_id, round({PHRED_SQL}, 6) as mean_qscore from reads group by exp_id", ("reads",))
def phred_mean(v):
    return rounded(R.phred_mean(v.reads, EXP), "mean_qscore")


@query("phred_mean_weighted", """
select exp_id, round(-10 * log10(sum(pow(10, -qscore / 10) * length) / sum(length)), 6) as mean_qscore
from reads group by exp_id""", ("reads",))
def phred_mean_weighted(v):
    return rounded(R.phred_mean_weighted(v.reads, EXP), "mean_qscore")


@query("medians", """
select exp_id, l.*, q.* exclude (exp_id) from (
  select exp_id, cast(percentile_disc(0.5) within group (order by length desc) as bigint) as length_upper,
    cast(percentile_disc(0.5) within group (order by length) as bigint) as length_lower,
    median(length) as length_median from reads group by exp_id) l
join (
  select exp_id, percentile_disc(0.5) within group (order by qscore desc) as q_upper,
    percentile_disc(0.5) within group (order by qscore) as q_lower, median(qscore) as q_median
  from reads group by exp_id) q using (exp_id)""".replace("exp_id, l.*, q.* exclude (exp_id)", "*"), ("reads",))
def medians(v):
    names = lambda p: {"upper_median": f"{p}_upper", "lower_median": f"{p}_lower", "median": f"{p}_median"}
    length = ranking.medians(v.reads, EXP, "length", ranking.LENGTH_WIDTH).withColumnsRenamed(names("length"))
    quality = ranking.medians(v.reads, EXP, "qscore", ranking.QUALITY_WIDTH).withColumnsRenamed(names("q"))
    return length.join(quality, "exp_id")


@query("q_thresholds", """
select exp_id, count(*) as total_reads,
  count(*) filter (qscore >= 10) as q10_reads, round(count(*) filter (qscore >= 10) * 100.0 / count(*), 6) as q10_pct,
  count(*) filter (qscore >= 20) as q20_reads, round(count(*) filter (qscore >= 20) * 100.0 / count(*), 6) as q20_pct,
  count(*) filter (qscore >= 30) as q30_reads, round(count(*) filter (qscore >= 30) * 100.0 / count(*), 6) as q30_pct,
  round(count(*) filter (passes) * 100.0 / count(*), 6) as pass_rate
from reads group by exp_id""", ("reads",))
def q_thresholds(v):
    return rounded(R.q_thresholds(v.reads, EXP), "q10_pct", "q20_pct", "q30_pct", "pass_rate")


@query("read_statistics", f"""
select a.*, n.n50 from (
  select exp_id, count(*) as total_reads, count(*) filter (passes) as passed_reads, count(*) filter (not passes) as failed_reads,
    cast(sum(length) as bigint) as total_bases, cast(coalesce(sum(length) filter (passes), 0) as bigint) as passed_bases,
    round(avg(length), 6) as mean_read_length,
    cast(percentile_disc(0.5) within group (order by length desc) as bigint) as median_read_length,
    min(length) as min_read_length, max(length) as max_read_length,
    round({PHRED_SQL}, 6) as mean_qscore,
    percentile_disc(0.5) within group (order by qscore desc) as median_qscore,
    round(avg(duration), 6) as mean_duration, round(sum(duration) / 3600, 6) as total_duration_hours
  from reads group by exp_id) a join run_n50 n using (exp_id)""", ("reads", "run_n50"))
def read_statistics(v):
    return rounded(
        R.read_statistics(v.reads, EXP), "mean_read_length", "mean_qscore", "mean_duration", "total_duration_hours"
    )


@query("n50", "select * from run_n50", ("run_n50",))
def n50(v):
    return ranking.nx(v.reads, EXP)


@query("n90", """
select exp_id, max(length) as n90 from (
  select exp_id, length, sum(length) over (partition by exp_id order by length desc) as c,
    sum(length) over (partition by exp_id) as t from reads)
where c >= t * 0.9 group by exp_id""", ("reads",))
def n90(v):
    return ranking.nx(v.reads, EXP, fractions={"n90": 0.9})


@query("length_quantiles", """
select exp_id, round(quantile_cont(length, 0.25), 6) as p25, round(quantile_cont(length, 0.75), 6) as p75,
  round(quantile_cont(length, 0.99), 6) as p99, round(quantile_cont(length, 0.995), 6) as p995
from reads group by exp_id""", ("reads",))
def length_quantiles(v):
    qs = {"p25": 0.25, "p75": 0.75, "p99": 0.99, "p995": 0.995}
    return rounded(ranking.quantiles(v.reads, EXP, "length", qs, ranking.LENGTH_WIDTH), *qs)


@query("sequence_multiplicity", """
select experiment, count(*) as unique_sequences, count(*) filter (c = 1) as singleton_sequences,
  count(*) filter (c > 1) as multi_occurrence_sequences, max(c) as max_occurrence, round(avg(c), 6) as mean_occurrence
from (select experiment, seq, count(*) as c from sentences group by experiment, seq) group by experiment""", ("sentences",))
def sequence_multiplicity(v):
    return rounded(R.sequence_multiplicity(v.sentences, ["experiment"]), "mean_occurrence")


@query("fasta_stats", """
select source, cast(sum(length) as bigint) as total_bases, count(*) as num_sequences from sentences group by source""", ("sentences",))
def fasta_stats(v):
    return R.fasta_stats(v.sentences, ["source"])


@query("alignment_statistics", """
with x as (select *, (flag & 4) = 0 as m, (flag & 4) = 0 and (flag & 256) = 0 and (flag & 2048) = 0 as p,
    list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)I', 1), lambda s: cast(s as bigint))) as ins,
    list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)D', 1), lambda s: cast(s as bigint))) as del
  from alignments),
n as (select exp_id, max(length) as n50 from (select exp_id, length, sum(length) over (partition by exp_id order by length desc) as c,
    sum(length) over (partition by exp_id) as t from x where p) where c >= t * 0.5 group by exp_id)
select a.*, n.n50 from (
  select exp_id, count(*) as total_records, count(*) filter (m) as mapped,
    round(count(*) filter (m) * 100.0 / count(*), 6) as mapped_pct, count(*) filter (p) as "primary",
    count(*) filter ((flag & 256) != 0) as secondary, count(*) filter ((flag & 2048) != 0) as supplementary,
    round(avg(mapq) filter (p), 6) as mean_mapq, count(*) filter (p and mapq >= 60) as mapq60_reads,
    round(avg(ins) filter (p), 6) as insertions_per_read, round(avg(del) filter (p), 6) as deletions_per_read,
    round(avg(greatest(nm - ins - del, 0)) filter (p), 6) as mismatches_per_read,
    quantile_cont(mapq, 0.5) filter (p) as median_mapq
  from x group by exp_id) a join n using (exp_id)""", ("alignments",))
def alignment_statistics(v):
    return rounded(
        R.alignment_statistics(v.alignments, EXP),
        "mapped_pct", "mean_mapq", "insertions_per_read", "deletions_per_read", "mismatches_per_read",
    )


@query("mapping_rate", """
select exp_id, round(count(*) filter ((flag & 4) = 0) * 100.0 / count(*), 6) as mapping_rate,
  count(*) filter (mapq >= 60) as mapq_60_reads, round(avg(mapq), 6) as mean_mapq from alignments group by exp_id""", ("alignments",))
def mapping_rate(v):
    mapped = F.col("flag").bitwiseAND(4) == 0
    return v.alignments.groupBy("exp_id").agg(
        r(F.count_if(mapped) * 100.0 / F.count("*")).alias("mapping_rate"),
        F.count_if(F.col("mapq") >= 60).alias("mapq_60_reads"),
        r(F.avg("mapq")).alias("mean_mapq"),
    )


@query("length_from_duration", """
select exp_id, read_id, cast(trunc(start_time / channel * 450) as bigint) as est_length from reads""", ("reads",))
def length_from_duration(v):
    return v.reads.select("exp_id", "read_id", sq.estimated_length("start_time", "channel").alias("est_length"))


# -- tolerant parsing over the messy text view --------------------------------

@query("parse_raw_reads", """
select read_id, cast(sequence_length_template as bigint) as length,
  upper(trim(passes_filtering)) in ('TRUE', '1', 'PASS', 'YES') as passes,
  case when alignment_identity in ('', '-1', '-1.000000', '*') then null else cast(alignment_identity as double) end as alignment_identity
from raw_reads where try_cast(sequence_length_template as bigint) is not null""", ("raw_reads",))
def parse_raw_reads(v):
    from runqc.sources.summary import canonical_reads

    return canonical_reads(v.raw_reads).select("read_id", "length", "passes", "alignment_identity")


@query("end_reason_alias", """
select read_id, case lower(replace(end_reason, ' ', '_'))
    when 'signal_positive' then 'signal_positive' when '4' then 'unblock_mux_change'
    when 'data_service' then 'data_service_unblock_mux_change' when 'mux_change' then 'mux_change'
    when 'adaptive_sampling' then 'unblock_mux_change' when 'signal_negative' then 'signal_negative'
    else 'unknown' end as end_reason
from raw_reads""", ("raw_reads",))
def end_reason_alias(v):
    return v.raw_reads.select("read_id", er.canonical("end_reason").alias("end_reason"))


@query("end_reason_category", """
select read_id, case when lower(trim(end_reason)) like '%signal_positive%' then 'signal_positive'
    when lower(trim(end_reason)) like '%unblock%' then 'unblock'
    when lower(trim(end_reason)) like '%mux_change%' then 'mux_change'
    when lower(trim(end_reason)) like '%signal_negative%' then 'signal_negative' else 'other' end as category
from raw_reads""".replace("like '%signal_positive%'", "like '%signal\\_positive%' escape '\\'")
 .replace("like '%mux_change%'", "like '%mux\\_change%' escape '\\'")
 .replace("like '%signal_negative%'", "like '%signal\\_negative%' escape '\\'"), ("raw_reads",))
def end_reason_category(v):
    return v.raw_reads.select("read_id", er.category("end_reason").alias("category"))


@query("end_reason_distribution", """
select exp_id, end_reason, n, round(n * 100.0 / sum(n) over (partition by exp_id), 2) as pct
from (select exp_id, end_reason, count(*) as n from reads group by exp_id, end_reason)""", ("reads",))
def end_reason_distribution(v):
    return E.distribution(v.reads, EXP)


@query("end_reason_verdict", """
with p as (select read_id, case lower(replace(end_reason, ' ', '_'))
    when 'signal_positive' then 'signal_positive' when '4' then 'unblock_mux_change'
    when 'data_service' then 'data_service_unblock_mux_change' when 'mux_change' then 'mux_change'
    when 'adaptive_sampling' then 'unblock_mux_change' when 'signal_negative' then 'signal_negative'
    else 'unknown' end as er, split_part(read_id, '-', 4) as exp from raw_reads),
c as (select exp, count(*) as total_reads,
    round(count(*) filter (er = 'signal_positive') * 100.0 / count(*), 2) as sp,
    round(count(*) filter (er = 'unblock_mux_change') * 100.0 / count(*), 2) as ub,
    round(count(*) filter (er = 'data_service_unblock_mux_change') * 100.0 / count(*), 2) as ds,
    round(count(*) filter (er = 'signal_negative') * 100.0 / count(*), 2) as sn from p group by exp)
select exp, total_reads, sp as signal_positive_pct, ub as unblock_mux_pct, ds as data_service_pct, sn as signal_negative_pct,
  case when sp < 50 then 'FAIL' when sp < 75 or sn > 20 then 'CHECK' else 'OK' end as quality_status,
  concat_ws('; ', case when sp < 50 then 'signal_positive too low (' || printf('%.1f', sp) || '% < 50%)'
    when sp < 75 then 'signal_positive below optimal (' || printf('%.1f', sp) || '% < 75%)' end,
    case when sn > 20 then 'high signal_negative (' || printf('%.1f', sn) || '% > 20%)' end) as issues,
  case when ub + ds > 5 then 'Adaptive sampling detected (' || printf('%.1f', ub + ds) || '% rejections)' end as adaptive_note
from c""", ("raw_reads",))
def end_reason_verdict(v):
    rows = v.raw_reads.select(
        F.split("read_id", "-")[3].alias("exp"), er.canonical("end_reason").alias("end_reason")
    )
    out = E.verdicts(rows, ["exp"])
    return out.withColumn("issues", F.array_join("quality_issues", "; ")).drop("quality_issues")


@query("end_reason_totals", """
select end_reason, count(*) as total, round(count(*) * 100.0 / (select count(*) from reads), 6) as pct from reads group by end_reason""", ("reads",))
def end_reason_totals(v):
    per = v.reads.groupBy("exp_id", "end_reason").agg(F.count("*").alias("n"))
    return rounded(E.totals(per), "pct")


@query("end_reason_of_experiments", """
select exp_id, end_reason, count(*) as n from reads where exp_id in (select exp_id from experiments where status = 'active')
group by exp_id, end_reason""", ("reads", "experiments"))
def end_reason_of_experiments(v):
    active = v.experiments.where(F.col("status") == "active").select("exp_id")
    counts = v.reads.groupBy("exp_id", "end_reason").agg(F.count("*").alias("n"))
    return counts.join(active, "exp_id", "left_semi")


@query("end_reason_blocks", """
with x as (select exp_id, length, case when end_reason = 'signal_positive' then 'signal_positive' else 'unblock' end as category from reads),
n as (select exp_id, category, max(length) as n50 from (select exp_id, category, length,
    sum(length) over (partition by exp_id, category order by length desc) as c,
    sum(length) over (partition by exp_id, category) as t from x) where c >= t * 0.5 group by exp_id, category),
w as (select exp_id, count(*) as n_all, count(*) filter (length < 200) as s, count(*) filter (length < 100) as d from x group by exp_id)
select exp_id, category, count(*) as n, round(count(*) * 100.0 / any_value(n_all), 6) as pct, any_value(n50) as n50,
  cast(floor(median(length)) as bigint) as median, round(avg(length), 6) as mean,
  round(any_value(s) * 100.0 / any_value(n_all), 6) as short_read_pct, round(any_value(d) * 100.0 / any_value(n_all), 6) as adapter_dimer_pct
from x join n using (exp_id, category) join w using (exp_id) group by exp_id, category""", ("reads",))
def end_reason_blocks(v):
    return rounded(E.blocks(v.reads, EXP), "pct", "mean", "short_read_pct", "adapter_dimer_pct")


@query("end_reason_rates", """
select exp_id, total_reads, round(signal_positive_pct, 6) as signal_positive_pct, round(unblock_pct, 6) as unblock_pct,
  round(data_service_pct, 6) as data_service_pct, round(rejection_rate, 6) as rejection_rate, is_adaptive from runs""", ("runs",))
def end_reason_rates(v):
    names = ["signal_positive_pct", "unblock_pct", "data_service_pct", "rejection_rate"]
    return rounded(E.rate_columns(E.counts_wide(v.reads, EXP)), *names).select("exp_id", "total_reads", *names, "is_adaptive")


@query("end_reason_wide", """
select exp_id, count(*) as total_reads,
  count(*) filter (end_reason = 'data_service_unblock_mux_change') as data_service_unblock_mux_change_count,
  count(*) filter (end_reason = 'signal_positive') as signal_positive_count,
  count(*) filter (end_reason = 'unblock_mux_change') as unblock_mux_change_count,
  round(count(*) filter (end_reason = 'data_service_unblock_mux_change') * 100.0 / count(*), 6) as data_service_unblock_mux_change_pct,
  round(count(*) filter (end_reason = 'signal_positive') * 100.0 / count(*), 6) as signal_positive_pct,
  round(count(*) filter (end_reason = 'unblock_mux_change') * 100.0 / count(*), 6) as unblock_mux_change_pct
from reads group by exp_id""", ("reads",))
def end_reason_wide(v):
    out = E.wide_table(v.reads, "exp_id")
    return rounded(out, *[c for c in out.columns if c.endswith("_pct")])


@query("consolidate_small", """
with c as (select experiment, end_reason, n, n * 100.0 / sum(n) over (partition by experiment) as pct from (
  select experiment, 'L' || cast(length // 10 as varchar) as end_reason, count(*) as n from sentences group by all))
select experiment, category, n, round(n * 100.0 / sum(n) over (partition by experiment), 6) as pct from (
  select experiment, case when pct < 1 then 'other' else end_reason end as category, cast(sum(n) as bigint) as n from c group by 1, 2)""", ("sentences",))
def consolidate_small(v):
    band = F.concat(F.lit("L"), F.floor(F.col("length") / 10).cast("string"))
    counts = v.sentences.groupBy("experiment", band.alias("end_reason")).agg(F.count("*").alias("n"))
    return rounded(E.consolidate_small(counts, ["experiment"]), "pct")


# -- distributions ------------------------------------------------------------

HIST_SQL = "select exp_id, length // 10 * 10 as bin, count(*) as n from reads group by all"
SMOOTH_SQL = """
k as (select o, exp(-0.5 * (o / 3.0) * (o / 3.0)) / sum(exp(-0.5 * (o / 3.0) * (o / 3.0))) over () as w from range(-12, 13) t(o)),
h as (select {key} as g, length // 10 as i, count(*) as n from reads where true {where} group by all),
s as (select g, i, n from h union all select g, -i - 1, n from h where i < 12),
y as (select g, s.i - k.o as i, sum(n * w) as y from s, k where s.i - k.o >= 0 group by all),
d as (select g, i * 10 as bin, round(y / max(y) over (partition by g) * 100, 9) as density from y)"""


@query("length_histogram", HIST_SQL, ("reads",))
def length_histogram(v):
    return D.length_histogram(v.reads, EXP)


@query("length_histogram_dense", """
with h as (select exp_id, length // 10 * 10 as bin, count(*) as n from reads group by all)
select b.exp_id, b.bin, coalesce(h.n, 0) as n from (select exp_id, unnest(range(0, max(bin) + 10, 10)) as bin from h group by exp_id) b left join h on h.exp_id = b.exp_id and h.bin = b.bin""", ("reads",))
def length_histogram_dense(v):
    return D.dense_histogram(D.length_histogram(v.reads, EXP), EXP)


@query("smoothed_histogram", "with " + SMOOTH_SQL.format(key="end_reason", where="") + """
select g as end_reason, bin, round(density, 6) as density from d""", ("reads",))
def smoothed_histogram(v):
    return rounded(D.smoothed_histogram(v.reads, ["end_reason"]), "density")


PEAK_SQL = """,
p as (select g, min(bin) filter (density = top) as peak_center, (max(bin) filter (density > top / 2) - min(bin) filter (density > top / 2)) / 2.355 as peak_sigma
  from (select *, max(density) over (partition by g) as top from d) group by g)"""


@query("main_peak", "with " + SMOOTH_SQL.format(key="end_reason", where="") + PEAK_SQL + """
select g as end_reason, peak_center, round(peak_sigma, 6) as peak_sigma from p""", ("reads",))
def main_peak(v):
    return rounded(D.main_peak(D.smoothed_histogram(v.reads, ["end_reason"]), ["end_reason"]), "peak_sigma")


@query("concatemer_pct", "with " + SMOOTH_SQL.format(key="exp_id", where="and end_reason = 'signal_positive'") + PEAK_SQL + """
select exp_id, peak_center as detected_target, round(count(*) filter (length > peak_center * 1.8) * 100.0 / count(*), 6) as concatemer_pct
from reads join p on g = exp_id where peak_center > 0 group by exp_id, peak_center""", ("reads",))
def concatemer_pct(v):
    return rounded(E.concatemers(v.reads, "exp_id"), "concatemer_pct")


KDE_SQL = """
m as (select {key} as g, stddev_samp(x) * {factor} as h, count(*) as n from src group by 1 having count(*) > 100),
c as (select {key} as g, x, count(*) as w from src group by all),
grid as (select i, (select lo from lim) + i * (select (hi - lo) / {last} from lim) as gx from range(0, {points}) t(i))
select g as end_reason, i as point, round(any_value(gx), 6) as x, round(sum(w * exp(-0.5 * ((gx - c.x) / h) * ((gx - c.x) / h))) / any_value(n * h * sqrt(2 * pi())), {places}) as density
from c join m using (g), grid group by g, i"""


def _kde(counts, value, low, high, points, factor, places=9):
    out = D.kde(counts, ["end_reason"], value, low, high, points, factor, min_reads=100)
    return out.withColumns({"x": r(F.col("x")), "density": r(F.col("density"), places)})


@query("kde_length", "with src as (select end_reason, cast(length as double) as x from reads),\n"
       "lim as (select 0.0::double as lo, quantile_cont(x, 0.995) as hi from src)," +
       KDE_SQL.format(key="end_reason", factor="0.02::double", points=500, last="499.0", places=12), ("reads",))
def kde_length(v):
    counts = v.reads.groupBy("end_reason", "length").agg(F.count("*").alias("n"))
    high = ranking.quantiles(v.reads, [], "length", {"hi": 0.995}, ranking.LENGTH_WIDTH).select("hi").scalar()
    return _kde(counts, "length", F.lit(0.0), high, 500, 0.02, places=12)


@query("kde_log_length", "with src as (select end_reason, log10(length) as x from reads),\n"
       "lim as (select min(x) as lo, max(x) as hi from src)," +
       KDE_SQL.format(key="end_reason", factor="0.1::double", points=300, last="299.0", places=9), ("reads",))
def kde_log_length(v):
    counts = v.reads.groupBy("end_reason", "length").agg(F.count("*").alias("n")).withColumn("x", F.log10("length"))
    lim = v.reads.agg(F.log10(F.min("length")).alias("lo"), F.log10(F.max("length")).alias("hi"))
    s = lim.select(F.struct("lo", "hi")).scalar()
    return _kde(counts.select("end_reason", "x", "n"), "x", s["lo"], s["hi"], 300, 0.1)


@query("kde_qscore", "with src as (select end_reason, qscore as x from reads),\n"
       "lim as (select 0.0::double as lo, 40.0::double as hi)," +
       KDE_SQL.format(key="end_reason", factor="0.1::double", points=1000, last="999.0", places=9), ("reads",))
def kde_qscore(v):
    counts = v.reads.groupBy("end_reason", "qscore").agg(F.count("*").alias("n"))
    return _kde(counts, "qscore", F.lit(0.0), F.lit(40.0), 1000, 0.1)


@query("curve_local_maxima", "with " + SMOOTH_SQL.format(key="end_reason", where="") + """,
l as (select *, lag(density) over (partition by g order by bin) as a, lead(density) over (partition by g order by bin) as b,
  max(density) over (partition by g) as top from d)
select g as end_reason, bin, round(density, 6) as density from l where density > a and density > b and density >= top * 0.05""", ("reads",))
def curve_local_maxima(v):
    curve = D.smoothed_histogram(v.reads, ["end_reason"])
    return rounded(D.local_maxima(curve, ["end_reason"], "bin", "density"), "density")


@query("curve_peaks")
def curve_peaks(v):
    """Smoothed prominence peaks have no SQL form; tested against hand-made curves."""
    counts = v.reads.groupBy("end_reason", "length").agg(F.count("*").alias("n"))
    high = ranking.quantiles(v.reads, [], "length", {"hi": 0.995}, ranking.LENGTH_WIDTH).select("hi").scalar()
    curve = D.kde(counts, ["end_reason"], "length", F.lit(0.0), high, 1000, 0.05, min_reads=100)
    return rounded(D.curve_peaks(curve, ["end_reason"], "point", "x", "density"), "peak_x", places=3)


@query("density_2d", """
select end_reason, floor(length / 1000.0) * 1000.0 as length_bin, floor(qscore / 0.5) * 0.5 as q_bin, count(*) as n
from reads group by all""", ("reads",))
def density_2d(v):
    return D.density_2d(v.reads, ["end_reason"], 1000.0, 0.5)


@query("log_histogram", """
with s as (select log10(greatest(min(length), 1)) as lo, log10(max(length)) as hi from reads)
select least(cast(floor((log10(length) - lo) / (hi - lo) * 49) as bigint), 48) as bin, count(*) as n from reads, s group by 1""", ("reads",))
def log_histogram(v):
    return D.log_histogram(v.reads)
