"""Timeline, channel, correlation, calibration and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from runqc.operators import calibration as C
from runqc.operators import channels as CH
from runqc.operators import correlate as K
from runqc.operators import grades as G
from runqc.operators import ranking
from runqc.operators import timeline as T
from runqc.plans.catalog import query
from runqc.plans.q_reads import PHRED_SQL, r, rounded

HOURS_SQL = """h as (select start_time // 3600 as hour, count(*) as n, cast(sum(length) as bigint) as bases,
  count(*) filter (qscore >= 10) as q10, count(*) filter (qscore >= 15) as q15, count(*) filter (qscore >= 20) as q20,
  count(*) filter (end_reason = 'signal_positive') as sp, -10 * log10(avg(pow(10, -qscore / 10))) as mq from reads group by 1),
hours as (select g.hour, coalesce(n, 0) as n, coalesce(bases, 0) as bases, coalesce(q10, 0) as q10, coalesce(q15, 0) as q15, coalesce(q20, 0) as q20,
  coalesce(sp, 0) as sp, coalesce(mq, 0) as mq from (select unnest(range(0, (select max(hour) + 1 from h))) as hour) g left join h using (hour))"""


@query("cumulative_yield", """
with b as (select end_reason, start_time // 60 * 60 as bin_start, count(*) as n, sum(length) as bases from reads group by all)
select end_reason, bin_start, cast(sum(n) over w as bigint) as cumulative_reads, cast(sum(bases) over w as bigint) as cumulative_bases
from b window w as (partition by end_reason order by bin_start)""", ("reads",))
def cumulative_yield(v):
    return T.cumulative_by_bin(v.reads, ["end_reason"])


@query("cumulative_yield_reads", """
select end_reason, read_id, row_number() over w as cumulative_reads, cast(sum(length) over w as bigint) as cumulative_bases
from reads window w as (partition by end_reason order by start_time, md5(read_id), read_id rows unbounded preceding)""", ("reads",))
def cumulative_yield_reads(v):
    out = T.cumulative_by_read(v.reads.select("end_reason", "read_id", "start_time", "length"), ["end_reason"])
    return out.select("end_reason", "read_id", "cumulative_reads", "cumulative_bases")


@query("rolling_mean", """
with k as (select greatest(100, count(*) // 100) as k from reads),
o as (select end_reason, start_time, qscore, length, row_number() over w as rn, sum(qscore) over w as sq, sum(length) over w as sl
  from reads window w as (partition by end_reason order by start_time, md5(read_id), read_id rows unbounded preceding))
select a.end_reason, a.rn - k + 1 as "window", l.start_time, round((a.sq - coalesce(b.sq, 0)) / k, 6) as rolling_q,
  round((a.sl - coalesce(b.sl, 0)) / k, 6) as rolling_length
from o a join k on a.rn >= k left join o b on b.end_reason = a.end_reason and b.rn = a.rn - k
join o l on l.end_reason = a.end_reason and l.rn = a.rn - k + 1 + k // 2""", ("reads",))
def rolling_mean(v):
    return rounded(T.rolling_quality_length(v.reads, ["end_reason"]), "rolling_q", "rolling_length")


@query("monitor_series", f"""
with x as (select *, start_time // 300 * 300 as bucket from reads),
b as (select exp_id, bucket, count(*) as n, sum(length) as bases, {PHRED_SQL} as mq from x group by all),
n as (select exp_id, bucket, max(length) as n50 from (select exp_id, bucket, length, sum(length) over (partition by exp_id, bucket order by length desc) as c,
  sum(length) over (partition by exp_id, bucket) as t from x) where c >= t * 0.5 group by all)
select exp_id, bucket, cast(sum(n) over w as bigint) as cumulative_reads, cast(sum(bases) over w as bigint) as cumulative_bases, round(mq, 6) as mean_qscore,
  round(sum(n) over w / ((bucket + 300) / 3600.0), 6) as reads_per_hour, round(sum(bases) over w / ((bucket + 300) / 3600.0), 3) as bases_per_hour, n50
from b join n using (exp_id, bucket) window w as (partition by exp_id order by bucket)""", ("reads",))
def monitor_series(v):
    out = rounded(T.monitor_series(v.reads, ["exp_id"]), "mean_qscore", "reads_per_hour")
    return rounded(out, "bases_per_hour", places=3)


@query("hourly_by_reason", f"""
with x as (select *, start_time // 3600 as hour from reads),
n as (select hour, end_reason, max(length) as n50 from (select hour, end_reason, length, sum(length) over (partition by hour, end_reason order by length desc) as c,
  sum(length) over (partition by hour, end_reason) as t from x) where c >= t * 0.5 group by all)
select hour, end_reason, count(*) as n, cast(sum(length) as bigint) as bases, case when count(*) > 10 then round({PHRED_SQL}, 6) end as mean_qscore,
  case when count(*) > 10 then round(avg(length), 6) end as mean_length, case when count(*) > 50 then any_value(n50) end as n50
from x join n using (hour, end_reason) group by hour, end_reason""", ("reads",))
def hourly_by_reason(v):
    return rounded(T.hourly_by_reason(v.reads), "mean_qscore", "mean_length")


@query("hourly_quality", f"""with {HOURS_SQL} select hour, n, round(case when n > 0 then q10 * 100.0 / n else 0 end, 6) as q10_pct,
  round(case when n > 0 then q15 * 100.0 / n else 0 end, 6) as q15_pct, round(case when n > 0 then q20 * 100.0 / n else 0 end, 6) as q20_pct,
  round(case when n > 0 then sp * 100.0 / n else 0 end, 6) as signal_positive_pct from hours""", ("reads",))
def hourly_quality(v):
    return rounded(T.hourly_quality(v.reads), "q10_pct", "q15_pct", "q20_pct", "signal_positive_pct")


@query("hourly_cumulative", f"""with {HOURS_SQL} select hour, cast(sum(n) over (order by hour) as bigint) as cumulative_reads,
  cast(sum(bases) over (order by hour) as bigint) as cumulative_bases from hours""", ("reads",))
def hourly_cumulative(v):
    return T.hourly_cumulative(v.reads)


@query("best_hours", f"""with {HOURS_SQL} select max(hour) + 1 as duration_hours, arg_max(hour, (mq, -hour)) as best_quality_hour, round(max(mq), 6) as best_quality,
  arg_max(hour, (bases, -hour)) as best_yield_hour, max(bases) as best_yield, max(n) as peak_reads_per_hour from hours""", ("reads",))
def best_hours(v):
    return rounded(T.best_hours(v.reads), "best_quality")


@query("active_channels", """with m as (select max(start_time) as hi from reads)
select least(cast(floor(start_time * 29.0::double / hi) as bigint), 28) as bin, count(distinct channel) as active_channels from reads, m group by 1""", ("reads",))
def active_channels(v):
    return T.active_channels(v.reads)


@query("reason_share_over_time", """with m as (select max(start_time) as hi from reads),
c as (select least(cast(floor(start_time * 49.0::double / hi) as bigint), 48) as bin, end_reason, count(*) as n from reads, m group by all)
select bin, end_reason, n, round(n * 100.0 / sum(n) over (partition by bin), 6) as pct from c""", ("reads",))
def reason_share_over_time(v):
    return rounded(T.reason_share_over_time(v.reads), "pct")


@query("read_rate", """with s as (select end_reason, min(start_time) as lo, max(start_time) as hi, count(*) as n_all from reads group by 1)
select end_reason, least(cast(floor((start_time - lo) * 30.0::double / (hi - lo)) as bigint), 29) as bin, count(*) as n,
  case when any_value(n_all) > 10 then round(count(*) / any_value((hi - lo) / 30.0::double) * 60, 6) end as reads_per_minute from reads join s using (end_reason) group by 1, 2""", ("reads",))
def read_rate(v):
    return rounded(T.read_rate(v.reads), "reads_per_minute")


@query("alerts", """
with m as (select exp_id, unnest(['mean_qscore', 'n50', 'reads_per_hour']) as metric, unnest([mean_qscore * 2, n50 / 74.0::double, total_reads * 24.0]) as value from runs),
t as (select unnest(['mean_qscore', 'n50', 'reads_per_hour']) as metric, unnest([10.0, 1000.0, 10000.0]) as threshold, unnest(['quality', 'quality', 'throughput']) as category)
select exp_id, metric, round(value, 6) as value, threshold, category, 'warning' as level from m join t using (metric) where value < threshold and not (metric = 'n50' and value <= 0)""", ("runs",))
def alerts(v):
    rows = G.metric_rows(
        v.runs.select(
            "exp_id", (F.col("mean_qscore") * 2).alias("mean_qscore"), (F.col("n50") / 74.0).alias("n50"),
            (F.col("total_reads") * 24.0).alias("reads_per_hour"),
        ), ["exp_id"], ["mean_qscore", "n50", "reads_per_hour"],
    )
    return rounded(T.alerts(rows).drop("message"), "value")


@query("pore_activity", """
with d as (select user_id % 20 as run, ts, event_id, cast(value * 4 as int) as a, cast(value as int) as s from events),
l as (select run, arg_max(a, (ts, event_id)) as a, arg_max(s, (ts, event_id)) as s from d group by run)
select run, round(a * 100.0 / 512, 6) as active_pores_pct, round(case when a > 0 then s / a::double else 0 end, 6) as occupancy from l""")
def pore_activity(v):
    duty = v.table("events").select(
        (F.col("user_id") % 20).alias("run"), F.struct("ts", "event_id").alias("time"),
        F.round(F.col("value") * 4).cast("int").alias("active_pores"), F.round("value").cast("int").alias("sequencing"),
    )
    return rounded(T.pore_activity(duty, ["run"]), "active_pores_pct", "occupancy")


@query("run_activity", """
with n as (select max(ts) as now from stream_reads)
select channel, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_seen, epoch(date_trunc('second', any_value(now))) - epoch(date_trunc('second', max(ts))) <= 86400 as is_active
from stream_reads, n group by channel""", ("stream_reads",))
def run_activity(v):
    now = v.stream_reads.agg(F.max("ts")).scalar()
    out = T.run_activity(v.stream_reads, ["channel"], "ts", now, 86_400)
    return out.withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))


# -- channels -----------------------------------------------------------------

@query("channel_counts", """
select channel, count(*) as total, count(*) filter (end_reason = 'signal_positive') as signal_positive, count(*) filter (end_reason != 'signal_positive') as unblock,
  0::bigint as other, round(count(*) filter (end_reason = 'signal_positive') * 100.0 / count(*), 6) as signal_positive_pct from reads group by channel""", ("reads",))
def channel_counts(v):
    return rounded(CH.channel_counts(v.reads), "signal_positive_pct")


@query("channel_performance", """
with c as (select channel, count(*) as n from reads group by 1),
s as (select g.channel, coalesce(n, 0) as n from (select unnest(range(1, (select max(channel) + 1 from c))) as channel) g left join c using (channel)),
m as (select avg(n) as mean from s)
select count(*) filter (n > 0) as active_channels, round(avg(n), 6) as mean_reads, median(n) as median_reads, round(stddev_pop(n), 6) as std_reads,
  count(*) filter (n < mean / 2) as low_performers, count(*) filter (n > mean * 1.5) as high_performers, round(count(*) filter (n > 0) * 100.0 / 512, 6) as efficiency_pct from s, m""", ("reads",))
def channel_performance(v):
    return rounded(CH.channel_performance(v.reads), "mean_reads", "std_reads", "efficiency_pct")


@query("channel_groups", f"""
select (channel - 1) // 128 as channel_group, end_reason, count(*) as n, round({PHRED_SQL}, 6) as mean_qscore, round(avg(length), 6) as mean_length,
  round(count(*) * 100.0 / sum(count(*)) over (partition by (channel - 1) // 128), 6) as pct from reads where channel >= 1 group by 1, 2""", ("reads",))
def channel_groups(v):
    return rounded(CH.channel_groups(v.reads), "mean_qscore", "mean_length", "pct")


@query("channel_grid", """
select (channel - 1) // 128 as row, (channel - 1) % 128 as col, round(count(*) filter (end_reason = 'signal_positive') * 100.0 / count(*), 6) as signal_positive_rate
from reads where channel >= 1 group by 1, 2""", ("reads",))
def channel_grid(v):
    return rounded(CH.channel_grid(v.reads), "signal_positive_rate")


# -- correlation --------------------------------------------------------------

CORR = "count(*) as n, round(corr(length, qscore), 9) as r, round(regr_slope(qscore, length), 12) as slope, round(regr_intercept(qscore, length), 6) as intercept"


@query("len_q_corr", f"""select 'all' as end_reason, {CORR} from reads union all select end_reason, {CORR} from reads group by end_reason""", ("reads",))
def len_q_corr(v):
    out = K.length_quality_correlation(v.reads)
    return rounded(rounded(rounded(out, "r", places=9), "slope", places=12), "intercept")


@query("n50_by_reason", f"""
with n as (select end_reason, max(length) as n50 from (select end_reason, length, sum(length) over (partition by end_reason order by length desc) as c,
  sum(length) over (partition by end_reason) as t from reads) where c >= t * 0.5 group by 1)
select end_reason, count(*) as n, round({PHRED_SQL}, 6) as mean_qscore, any_value(n50) as n50 from reads join n using (end_reason) group by 1""", ("reads",))
def n50_by_reason(v):
    return rounded(K.n50_by_reason(v.reads), "mean_qscore")


DECILE_SQL = """e as (select list_transform(range(0, 11), lambda i: i) as i, quantile_cont(length, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) as q from reads),
x as (select r.*, d.i as decile, (e.q[d.i + 1] + e.q[d.i + 2]) / 2 as bin_center from reads r, e, range(0, 10) d(i) where length >= e.q[d.i + 1] and (length < e.q[d.i + 2] or d.i = 9))"""


@query("q_by_length_decile", f"""with {DECILE_SQL} select end_reason, cast(decile as int) as decile, count(*) as n, round(any_value(bin_center), 6) as bin_center,
  case when count(*) > 10 then round({PHRED_SQL}, 6) end as mean_qscore from x group by 1, 2""", ("reads",))
def q_by_length_decile(v):
    return rounded(K.quality_by_length_decile(v.reads), "bin_center", "mean_qscore")


@query("q_percentiles_by_decile", f"""with {DECILE_SQL} select cast(decile as int) as decile, count(*) as n, quantile_cont(qscore, 0.25) as p25, quantile_cont(qscore, 0.5) as p50,
  quantile_cont(qscore, 0.75) as p75, quantile_cont(qscore, 0.9) as p90 from x group by 1""", ("reads",))
def q_percentiles_by_decile(v):
    return K.quality_percentiles_by_decile(v.reads)


@query("q_bands", """
select case when qscore < 10 then 'Q0-10' when qscore < 15 then 'Q10-15' when qscore < 20 then 'Q15-20' else 'Q20+' end as band, count(*) as n,
  round(avg(length), 6) as mean_length from reads where qscore >= 0 group by 1""", ("reads",))
def q_bands(v):
    return rounded(K.quality_bands(v.reads), "mean_length")


IDENTITY_SQL = """i as (select 'T' || cast(l_suppkey % 12 as varchar) as tag, case l_suppkey % 12 when 3 then 'unclassified' when 5 then 'mixed' when 7 then null else 'T' || cast(l_suppkey % 12 as varchar) end as alias,
  l_quantity / 2 as qscore, cast(floor(l_extendedprice) as bigint) as length, case when l_linenumber = 7 then null else 1 - round(l_discount * 100) * 0.015 end as identity from lineitem)"""


def identity_reads(v):
    k = F.col("l_suppkey") % 12
    alias = F.when(k == 3, "unclassified").when(k == 5, "mixed").when(k != 7, F.concat(F.lit("T"), k.cast("string")))
    return v.table("lineitem").select(
        alias.alias("alias"), (F.col("l_quantity") / 2).alias("qscore"), F.floor("l_extendedprice").alias("length"),
        F.when(F.col("l_linenumber") != 7, F.lit(1.0) - F.round(F.col("l_discount") * 100) * 0.015).alias("identity"),
    )


@query("per_target_stats", f"""with {IDENTITY_SQL} select alias, count(*) as n, round({PHRED_SQL}, 6) as mean_qscore, round(avg(length), 6) as mean_length,
  round(avg(identity), 6) as mean_identity, count(*) filter (identity >= 0.9999) as perfect_count from i where alias is not null and alias not in ('unclassified', 'mixed') group by 1""")
def per_target_stats(v):
    return rounded(K.per_target_stats(identity_reads(v)), "mean_qscore", "mean_length", "mean_identity")


@query("q_by_identity", f"""with {IDENTITY_SQL} select case when identity >= 0.99 then 'perfect' when identity >= 0.95 then 'high' when identity >= 0.9 then 'medium' else 'low' end as band,
  count(*) as n, round({PHRED_SQL}, 6) as mean_qscore from i where identity is not null group by 1""")
def q_by_identity(v):
    return rounded(K.quality_by_identity(identity_reads(v)), "mean_qscore")


# -- calibration --------------------------------------------------------------

ECE_SQL = """b as (select {key} as g, p, err, greatest(1, list_count(list_filter(edges, lambda e: e < p))) as bin from calibration c join e on e.g = {key}),
s as (select g, bin, count(*) as n, avg(p) as pm, avg(err) as om from b group by all),
ece as (select g, cast(sum(n) as bigint) as n, count(*) as bins, round(sum(abs(om - pm) * n) / sum(n), 9) as ece, round(max(abs(om - pm)), 9) as mce from s group by g)"""
QUANT_SQL = ("e as (select {key} as g, list_distinct(quantile_cont(p, ["
             + ", ".join(str(i / 20) for i in range(21)) + "])) as edges from calibration group by 1),\n")
UNIFORM_SQL = "e as (select k as g, list_transform(range(0, 21), lambda i: lo + (hi - lo) * (i / 20.0)) as edges from (select {key} as k, min(p) as lo, max(p) as hi from calibration group by 1)),\n"


@query("ece_quantile", "with " + QUANT_SQL.format(key="1") + ECE_SQL.format(key="1") + " select n, bins, ece, mce from ece", ("calibration",))
def ece_quantile(v):
    return rounded(C.calibration_error(C.bin_stats(v.calibration, []), []), "ece", "mce", places=9)


@query("ece_uniform", "with " + UNIFORM_SQL.format(key="1") + ECE_SQL.format(key="1") + " select n, bins, ece, mce from ece", ("calibration",))
def ece_uniform(v):
    return rounded(C.calibration_error(C.bin_stats(v.calibration, [], strategy="uniform"), []), "ece", "mce", places=9)


@query("brier", "select end_reason, count(*) as n, round(avg((p - err) * (p - err)), 9) as brier from calibration group by 1", ("calibration",))
def brier(v):
    return rounded(C.brier(v.calibration, ["end_reason"]), "brier", places=9)


@query("calibration_by_reason", "with " + QUANT_SQL.format(key="end_reason") + ECE_SQL.format(key="end_reason") + """
select g as end_reason, n, bins, ece, mce, brier from ece join (select end_reason as g, round(avg((p - err) * (p - err)), 9) as brier from calibration group by 1) using (g)""", ("calibration",))
def calibration_by_reason(v):
    return rounded(C.by_stratum(v.calibration, "end_reason"), "ece", "mce", "brier", places=9)


def recalibrated(out):
    return out.groupBy(r(F.col("p"), 12).alias("p")).agg(F.count("*").alias("n"), r(F.max("q_cal"), 5).alias("q_cal"))


@query("isotonic_recalibration", """
with pts as (select p, count(*) as n, sum(err) as e from calibration group by p),
o as (select *, row_number() over (order by p) as i, sum(n) over w as cn, sum(e) over w as ce from pts window w as (order by p rows unbounded preceding)),
means as (select a.i as j, b.i as k, (b.ce - a.ce + a.e)::double / (b.cn - a.cn + a.n) as m from o a join o b on b.i >= a.i),
low as (select j, k as i, min(m) over (partition by j order by k desc rows unbounded preceding) as m from means),
fit as (select i, max(m) as p_cal from low group by i)
select round(p, 12) as p, n, round(case when p_cal <= 0 then 60 else least(-10 * log10(p_cal), 60) end, 5) as q_cal from o join fit using (i)""", ("calibration",))
def isotonic_recalibration(v):
    """The fit is the greatest of the least means of all stretches that begin before and end after a point."""
    return recalibrated(C.isotonic_recalibrate(v.calibration))


@query("platt_recalibration", """
with recursive pts as (select p, count(*)::double as n, sum(err)::double as e from calibration group by p),
steps as (select 0 as s, 0.0::double as a, 0.0::double as b union all
 select steps.s + 1, steps.a + (h.sxx * h.g0 - h.sx * h.g1) / (h.s0 * h.sxx - h.sx * h.sx), steps.b + (h.s0 * h.g1 - h.sx * h.g0) / (h.s0 * h.sxx - h.sx * h.sx)
 from steps, lateral (select sum(e - n * m) as g0, sum((e - n * m) * p) as g1, sum(n * m * (1 - m)) as s0, sum(n * m * (1 - m) * p) as sx, sum(n * m * (1 - m) * p * p) as sxx
   from (select p, n, e, 1 / (1 + exp(-(steps.a + steps.b * p))) as m from pts)) h where steps.s < 12),
fit as (select a, b from steps order by s desc limit 1)
select round(p, 12) as p, cast(n as bigint) as n, round(least(-10 * log10(1 / (1 + exp(-(a + b * p)))), 60), 5) as q_cal from pts, fit""", ("calibration",))
def platt_recalibration(v):
    """Twelve Newton steps on either side."""
    return recalibrated(C.platt_recalibrate(v.calibration))


# -- sampling -----------------------------------------------------------------

@query("stratified_sample", """
with q as (select end_reason, greatest(10, cast(floor(5000 * (count(*)::double / (select count(*) from reads))) as bigint)) as n_keep from reads group by 1),
x as (select *, row_number() over (partition by end_reason order by md5(read_id || '42'), read_id) as rn from reads)
select end_reason, read_id, length, qscore from x join q using (end_reason) where rn <= n_keep""", ("reads",))
def stratified_sample(v):
    total = v.reads.agg(F.count("*")).scalar()
    quota = v.reads.groupBy("end_reason").agg(F.count("*").alias("n")).select(
        "end_reason", F.greatest(F.lit(10), F.floor(F.lit(5000) * (F.col("n") / total))).alias("n_keep")
    )
    picked = ranking.hash_sample(v.reads, ["end_reason"], quota, "read_id")
    return picked.select("end_reason", "read_id", "length", "qscore")


@query("random_sample", "select read_id, length from (select *, row_number() over (order by md5(read_id || '7'), read_id) as rn from reads) where rn <= 1000", ("reads",))
def random_sample(v):
    whole = v.reads.select("read_id", "length").withColumn("_all", F.lit(0))
    quota = whole.groupBy("_all").agg(F.lit(1000).alias("n_keep"))
    return ranking.hash_sample(whole, ["_all"], quota, "read_id", seed=7).drop("_all")


@query("balanced_sample", """
with c as (select passes, count(distinct exp_id) as files from reads group by 1),
x as (select r.*, row_number() over (partition by passes, exp_id order by md5(read_id || '42'), read_id) as rn from reads r)
select x.passes, exp_id, count(*) as kept, round(any_value(total) * 1.0 / count(*), 6) as scale from x join c using (passes)
join (select passes, exp_id, count(*) as total from reads group by all) t using (passes, exp_id)
where rn <= greatest(100, 10000 // files) group by x.passes, exp_id""", ("reads",))
def balanced_sample(v):
    """Half pass, half fail, an equal quota per run of at least 100; ``scale`` is a labelled estimate."""
    per = v.reads.groupBy("passes", "exp_id").agg(F.count("*").alias("total"))
    files = per.groupBy("passes").agg(F.count("*").alias("files"))
    quota = per.join(files, "passes").select(
        "passes", "exp_id", "total", F.greatest(F.lit(100), F.floor(F.lit(10_000) / F.col("files"))).alias("n_keep")
    )
    kept = ranking.hash_sample(v.reads, ["passes", "exp_id"], quota, "read_id")
    counts = kept.groupBy("passes", "exp_id").agg(F.count("*").alias("kept"))
    return counts.join(quota, ["passes", "exp_id"]).select(
        "passes", "exp_id", "kept", r(F.col("total") / F.col("kept")).alias("scale")
    )


@query("head_reads", """
select exp_id, read_id, start_time from (select *, row_number() over (partition by exp_id order by start_time, read_id) as rn from reads) where rn <= 20""", ("reads",))
def head_reads(v):
    """First N reads per source; the row_number limit is pushed below the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy("exp_id").orderBy("start_time", "read_id")
    return v.reads.select("exp_id", "read_id", "start_time").withColumn("rn", F.row_number().over(w)).where("rn <= 20").drop("rn")
