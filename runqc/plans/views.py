"""Canonical views over the driver tables, for Spark and (as text) for the SQL oracle.

The tables hold no sequencing data, so each view maps columns of a table one to one onto the
canonical shape; every row and the whole of every text is used.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runqc.functions.common import first_match
from runqc.operators import endreasons
from runqc.operators.joins import spread

LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGTAC"
QUALS = "()*+,-./0123456789:;<=>?@A"


def _dna(text):
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z]", "")), LETTERS, BASES)


def _qual(text):
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z]", "")), LETTERS, QUALS)


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def texts(self, name: str, key: str) -> DataFrame:
        """A table of long texts; one small file is spread over the cores first."""
        return spread(self.table(name), key)

    @cached_property
    def reads(self) -> DataFrame:
        reason = first_match(
            [(F.col("l_returnflag") == "N", "signal_positive"), (F.col("l_returnflag") == "A", "unblock_mux_change")],
            "data_service_unblock_mux_change",
        )
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("exp_id"),
            F.concat_ws(
                "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                F.round(F.col("l_extendedprice") * 100).cast("bigint"),
            ).alias("read_id"),
            (F.col("l_partkey") % 512 + 1).alias("channel"),
            F.floor("l_extendedprice").alias("length"),
            (F.col("l_quantity") / 2).alias("qscore"),
            (F.col("l_linestatus") == "O").alias("passes"),
            reason.alias("end_reason"),
            (F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")).cast("bigint") * 60).alias("start_time"),
            F.round(F.col("l_tax") * 100).alias("duration"),
        )

    @cached_property
    def raw_reads(self) -> DataFrame:
        """The same rows as messy text: several spellings, codes, sentinels and bad numbers."""
        n = F.col("l_linenumber")
        return self.table("lineitem").select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                        F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("read_id"),
            F.when(n == 7, "bad").otherwise(F.floor("l_extendedprice").cast("string")).alias("sequence_length_template"),
            first_match([(n == 1, " true"), (n == 2, "1"), (n == 3, "PASS"), (n == 4, "Yes"), (n == 5, "0")], "FALSE").alias("passes_filtering"),
            first_match(
                [(n == 1, "Signal Positive"), (n == 2, "4"), (n == 3, "data_service"), (n == 4, "MUX_CHANGE"),
                 (n == 5, "adaptive sampling"), (n == 6, "signal_negative")], "something else").alias("end_reason"),
            first_match([(n == 1, "-1"), (n == 2, ""), (n == 3, "*"), (n == 4, "-1.000000")],
                        (F.lit(100) - F.round(F.col("l_discount") * 100).cast("bigint")).cast("string")).alias("alignment_identity"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        """Per experiment: end-reason counts and derived rates, read totals and quality."""
        from runqc.operators import reads as R

        counts = endreasons.rate_columns(endreasons.counts_wide(self.reads, ["exp_id"]))
        stats = R.read_statistics(self.reads, ["exp_id"]).drop("total_reads")
        shares = self.reads.groupBy("exp_id").agg(
            (F.count_if(F.col("length") < 5000) * 100.0 / F.count("*")).alias("short_read_pct"),
            (F.count_if(F.col("length") < 2000) * 100.0 / F.count("*")).alias("adapter_dimer_pct"),
            (F.count_if(F.col("length") > 95000) * 100.0 / F.count("*")).alias("concatemer_pct"),
        )
        pass_rate = F.col("passed_reads") * 100.0 / F.col("total_reads")
        return counts.join(stats, "exp_id").join(shares, "exp_id").withColumn("pass_rate", pass_rate)

    @cached_property
    def experiments(self) -> DataFrame:
        s, n, r = self.table("supplier"), self.table("nation"), self.table("region")
        # nation and region are fixed reference tables of 25 and 5 rows.
        joined = s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).join(
            F.broadcast(r), F.col("n_regionkey") == r["r_regionkey"]
        )
        k = F.col("s_suppkey")
        return joined.select(
            k.alias("exp_id"),
            F.col("s_name").alias("name"),
            F.col("n_name").alias("sample"),
            F.concat(F.lit("FC"), (k % 7).cast("string")).alias("flowcell"),
            F.col("r_name").alias("device"),
            F.when(k % 3 == 0, "internal").when(k % 3 == 1, "public").otherwise("unknown").alias("source"),
            first_match([(k % 5 == 0, "archived"), (k % 5 == 1, "pending")], "active").alias("status"),
            F.array(F.concat(F.lit("t"), (k % 11).cast("string")), F.concat(F.lit("u"), (k % 13).cast("string"))).alias("tags"),
            F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("balance"),
        )

    @cached_property
    def registry_old(self) -> DataFrame:
        c = self.table("customer").where(F.col("c_custkey") % 10 != 3)
        return self._registry(c, F.lit(0))

    @cached_property
    def registry_new(self) -> DataFrame:
        c = self.table("customer").where(F.col("c_custkey") % 10 != 7)
        return self._registry(c, F.when(F.col("c_custkey") % 10 == 5, 2).otherwise(0))

    @staticmethod
    def _registry(c: DataFrame, extra) -> DataFrame:
        k = F.col("c_custkey")
        return c.select(
            F.concat(F.lit("/data/"), "c_mktsegment", F.lit("/"), k.cast("string")).alias("path"),
            F.col("c_name").alias("sample_id"),
            F.concat(F.lit("FC"), F.col("c_nationkey").cast("string")).alias("flow_cell_id"),
            (k % 17 + extra).cast("int").alias("pod5_files"),
            F.when(k % 4 != 0, (k % 4).cast("int")).alias("fast5_files"),
            (k % 23 + extra).cast("int").alias("fastq_files"),
            (k % 2).cast("int").alias("bam_files"),
            F.lit("active").alias("status"),
        )

    @cached_property
    def event_log(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("event_id"),
            F.col("o_custkey").alias("exp_id"),
            F.col("o_orderdate").alias("ts"),
            F.col("o_orderpriority").alias("analysis"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_totalprice").alias("value"),
        )

    @cached_property
    def stream_reads(self) -> DataFrame:
        return self.table("events").select(
            "event_id",
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("user_id").alias("channel"),
            F.col("event_type").alias("end_reason"),
            F.ceil(F.col("value") * 100).cast("bigint").alias("length"),
            (F.col("event_id") % 30).cast("double").alias("qscore"),
            (F.col("event_id") % 3 != 0).alias("passes"),
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )

    @cached_property
    def sentences(self) -> DataFrame:
        """Every sentence of every document as a read: bases, qualities, experiment and barcode."""
        d = self.texts("documents", "doc_id").select(
            "doc_id", "lang", "source", F.posexplode(F.split("text", "[.!?\n]+")).alias("pos", "s")
        ).where(F.col("s").rlike("[A-Za-z]"))
        return d.select(
            F.concat_ws("-", "doc_id", "pos").alias("read_id"),
            "doc_id",
            F.col("lang").alias("experiment"),
            F.concat(F.lit("barcode"), F.lpad((F.col("doc_id") % 30).cast("string"), 2, "0")).alias("barcode"),
            "source",
            _dna(F.col("s")).alias("seq"),
            _qual(F.col("s")).alias("qual"),
        ).withColumn("length", F.length("seq"))

    @cached_property
    def targets(self) -> DataFrame:
        """Distinct sentences of the benchmark passages as references with a size range."""
        b = self.table("benchmark").select("item_id", F.posexplode(F.split("text", "[.!?\n]+")).alias("pos", "s"))
        named = b.select((F.col("item_id") * 1000 + F.col("pos")).alias("ord"), _dna(F.col("s")).alias("target_seq"))
        first = named.where(F.col("target_seq") != "").groupBy("target_seq").agg(F.min("ord").alias("ord"))
        n = F.length("target_seq")
        return first.select(
            F.concat(F.lit("T"), F.col("ord").cast("string")).alias("target_id"),
            "target_seq", "ord",
            n.alias("expected_length"),
            (n - F.floor(n / 10)).cast("int").alias("range_min"),
            (n + F.floor(n / 10)).cast("int").alias("range_max"),
        )

    @cached_property
    def barcode_map(self) -> DataFrame:
        """One target per (experiment, barcode): the first in order."""
        lang = F.element_at(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]), (F.col("ord") % 4 + 1).cast("int"))
        code = F.concat(F.lit("barcode"), F.lpad(((F.floor(F.col("ord") / 1000) + F.col("ord")) % 25).cast("string"), 2, "0"))
        return self.targets.groupBy(lang.alias("experiment"), code.alias("barcode")).agg(
            F.min_by("target_id", "ord").alias("target")
        )

    @cached_property
    def refs(self) -> DataFrame:
        return self.targets.select(F.col("target_id").alias("ref_id"), F.col("target_seq").alias("ref_seq"), "ord")

    @cached_property
    def calibration(self) -> DataFrame:
        return self.table("lineitem").select(
            F.when(F.col("l_returnflag") == "N", "signal_positive").when(F.col("l_returnflag") == "A", "unblock_mux_change")
            .otherwise("data_service_unblock_mux_change").alias("end_reason"),
            F.pow(F.lit(10.0), -(F.col("l_quantity") / 2) / 10).alias("p"),
            F.when(F.round(F.col("l_tax") * 100) * 4 + 10 > F.col("l_quantity"), 1).otherwise(0).alias("err"),
        )

    @cached_property
    def alignments(self) -> DataFrame:
        n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int").cast("string")
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("exp_id"),
            first_match([(n == 2, 16), (n == 3, 256), (n == 4, 2048), (n == 5, 4)], 0).alias("flag"),
            (F.col("l_partkey") % 61).cast("int").alias("mapq"),
            F.concat(q, F.lit("M"), n.cast("string"), F.lit("I"), q, F.lit("M"),
                     (n % 3 + 1).cast("string"), F.lit("D5M")).alias("cigar"),
            (n * 2 + 3).cast("int").alias("nm"),
            F.floor("l_extendedprice").alias("length"),
        )

    @cached_property
    def tasks(self) -> DataFrame:
        t = F.col("turn")
        name = lambda c: F.concat(F.lit("t"), c.cast("string"))
        return self.table("conversations").select(
            F.col("conv_id").alias("experiment_id"),
            name(t).alias("name"),
            t.alias("ord"),
            F.element_at(F.array(*[F.lit(x) for x in ("passing", "pending", "failing", "skipped")]),
                         (F.length("text") % 4 + 1).cast("int")).alias("status"),
            (F.length("text") % 3 + 1).cast("int").alias("priority"),
            F.when(t == 0, F.array().cast("array<string>"))
            .when(t % 4 == 3, F.array(name(t - 1), name(t + 50)))
            .otherwise(F.array(name(t - 1))).alias("dependencies"),
        )

    @cached_property
    def parts(self) -> DataFrame:
        k, s = F.col("p_partkey"), F.col("p_size")
        return self.table("part").select(
            k.cast("bigint").alias("item"),
            F.when(s % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(k + s, k * 2)).alias("refs"),
            F.split("p_name", " ").alias("words"),
            F.col("p_type").alias("type"),
            F.col("p_size").alias("size"),
            F.col("p_brand").alias("brand"),
        )

    @cached_property
    def run_paths(self) -> DataFrame:
        """A run path per order with the usual naming parts."""
        k = F.col("o_orderkey")
        day = F.date_format("o_orderdate", "yyyyMMdd")
        pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
        return self.table("orders").select(
            k.alias("event_id"),
            F.concat(
                F.lit("/data/"), pick(["HG002", "na12878", "plain", "COLO829"]), F.lit("/"), day, F.lit("_1200_"),
                pick(["PA", "FA", "FB", "QX", "MN"]), F.lit("W"), F.lpad((k % 100000).cast("string"), 5, "0"),
                F.lit("_"), F.substring(F.md5(k.cast("string")), 1, 8), F.lit("/"),
                pick(["dna_r10.4.1_e8.2_sup", "r9.4.1_hac", "x_fast", "none"]), F.lit("/"),
                pick(["5mCG_5hmCG", "6mA", "plain"]), F.lit("/barcode"), F.lpad((k % 96).cast("string"), 2, "0"),
                F.lit("/rep"), (k % 4).cast("string"), F.lit("_"),
                pick(["sqk-lsk114", "SQK-RBK114", "kit", "adaptive_duplex", "hg38"]),
            ).alias("path"),
            F.when(k % 2 == 0, F.date_format("o_orderdate", "MMddyyyy")).otherwise(day).alias("date_text"),
            F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T08:15:30.123456-05:00")).alias("started"),
            F.concat(F.date_format(F.date_add(F.col("o_orderdate"), (k % 3 + 1).cast("int")), "yyyy-MM-dd"),
                     F.lit("T20:45:00.5+00:00")).alias("ended"),
        )


def _sql_dna(c: str, table: str) -> str:
    return f"translate(lower(regexp_replace({c}, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{table}')"


# name -> (views it needs, SQL text)
VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "reads": ((), """
select l_suppkey as exp_id,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint)) as read_id,
  l_partkey % 512 + 1 as channel,
  cast(floor(l_extendedprice) as bigint) as length,
  l_quantity / 2 as qscore,
  l_linestatus = 'O' as passes,
  case l_returnflag when 'N' then 'signal_positive' when 'A' then 'unblock_mux_change'
    else 'data_service_unblock_mux_change' end as end_reason,
  date_diff('day', timestamp '1995-01-01', l_shipdate) * 60 as start_time,
  round(l_tax * 100) as duration
from lineitem"""),
    "raw_reads": ((), """
select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint)) as read_id,
  case when l_linenumber = 7 then 'bad' else cast(cast(floor(l_extendedprice) as bigint) as varchar) end as sequence_length_template,
  case l_linenumber when 1 then ' true' when 2 then '1' when 3 then 'PASS' when 4 then 'Yes' when 5 then '0' else 'FALSE' end as passes_filtering,
  case l_linenumber when 1 then 'Signal Positive' when 2 then '4' when 3 then 'data_service' when 4 then 'MUX_CHANGE'
    when 5 then 'adaptive sampling' when 6 then 'signal_negative' else 'something else' end as end_reason,
  case l_linenumber when 1 then '-1' when 2 then '' when 3 then '*' when 4 then '-1.000000'
    else cast(100 - cast(round(l_discount * 100) as bigint) as varchar) end as alignment_identity
from lineitem"""),
    "run_n50": (("reads",), """
select exp_id, max(length) as n50 from (
  select exp_id, length,
    sum(length) over (partition by exp_id order by length desc) as c,
    sum(length) over (partition by exp_id) as t
  from reads) where c >= t * 0.5 group by exp_id"""),
    "runs": (("reads", "run_n50"), """
select a.*, n.n50,
  signal_positive * 100.0 / total_reads as signal_positive_pct,
  unblock_mux_change * 100.0 / total_reads as unblock_pct,
  data_service_unblock_mux_change * 100.0 / total_reads as data_service_pct,
  unblock_mux_change * 100.0 / total_reads + data_service_unblock_mux_change * 100.0 / total_reads as rejection_rate,
  unblock_mux_change * 100.0 / total_reads + data_service_unblock_mux_change * 100.0 / total_reads > 1.0 as is_adaptive,
  passed_reads * 100.0 / total_reads as pass_rate
from (
  select exp_id, count(*) as total_reads,
    count(*) filter (end_reason = 'signal_positive') as signal_positive,
    count(*) filter (end_reason = 'unblock_mux_change') as unblock_mux_change,
    count(*) filter (end_reason = 'data_service_unblock_mux_change') as data_service_unblock_mux_change,
    count(*) filter (passes) as passed_reads,
    cast(sum(length) as bigint) as total_bases,
    -10 * log10(avg(pow(10, -qscore / 10))) as mean_qscore,
    count(*) filter (length < 5000) * 100.0 / count(*) as short_read_pct,
    count(*) filter (length < 2000) * 100.0 / count(*) as adapter_dimer_pct,
    count(*) filter (length > 95000) * 100.0 / count(*) as concatemer_pct
  from reads group by exp_id) a join run_n50 n using (exp_id)"""),
    "experiments": ((), """
select s_suppkey as exp_id, s_name as name, n_name as sample,
  'FC' || cast(s_suppkey % 7 as varchar) as flowcell, r_name as device,
  case s_suppkey % 3 when 0 then 'internal' when 1 then 'public' else 'unknown' end as source,
  case s_suppkey % 5 when 0 then 'archived' when 1 then 'pending' else 'active' end as status,
  ['t' || cast(s_suppkey % 11 as varchar), 'u' || cast(s_suppkey % 13 as varchar)] as tags,
  case when s_acctbal > 0 then s_acctbal end as balance
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""),
    "registry_old": ((), """
select '/data/' || c_mktsegment || '/' || cast(c_custkey as varchar) as path, c_name as sample_id,
  'FC' || cast(c_nationkey as varchar) as flow_cell_id,
  cast(c_custkey % 17 as int) as pod5_files,
  case when c_custkey % 4 != 0 then cast(c_custkey % 4 as int) end as fast5_files,
  cast(c_custkey % 23 as int) as fastq_files, cast(c_custkey % 2 as int) as bam_files, 'active' as status
from customer where c_custkey % 10 != 3"""),
    "registry_new": ((), """
select '/data/' || c_mktsegment || '/' || cast(c_custkey as varchar) as path, c_name as sample_id,
  'FC' || cast(c_nationkey as varchar) as flow_cell_id,
  cast(c_custkey % 17 + case when c_custkey % 10 = 5 then 2 else 0 end as int) as pod5_files,
  case when c_custkey % 4 != 0 then cast(c_custkey % 4 as int) end as fast5_files,
  cast(c_custkey % 23 + case when c_custkey % 10 = 5 then 2 else 0 end as int) as fastq_files,
  cast(c_custkey % 2 as int) as bam_files, 'active' as status
from customer where c_custkey % 10 != 7"""),
    "event_log": ((), """
select o_orderkey as event_id, o_custkey as exp_id, o_orderdate as ts, o_orderpriority as analysis,
  o_orderstatus as status, o_totalprice as value from orders"""),
    "stream_reads": ((), """
select event_id, ts, user_id as channel, event_type as end_reason, cast(ceil(value * 100) as bigint) as length,
  cast(event_id % 30 as double) as qscore, event_id % 3 != 0 as passes,
  cast(json_extract_string(props, '$.k') as int) as k
from events"""),
    "sentences": ((), f"""
select read_id, doc_id, experiment, barcode, source, seq, qual, length(seq) as length from (
  select concat_ws('-', doc_id, pos) as read_id, doc_id, lang as experiment,
    'barcode' || lpad(cast(doc_id % 30 as varchar), 2, '0') as barcode, source,
    {_sql_dna('s', BASES)} as seq, {_sql_dna('s', QUALS)} as qual
  from (select doc_id, lang, source, unnest(parts) as s, generate_subscripts(parts, 1) - 1 as pos
    from (select doc_id, lang, source, regexp_split_to_array(text, '[.!?\\n]+') as parts from documents)))
where seq != ''"""),
    "targets": ((), f"""
select 'T' || cast(ord as varchar) as target_id, target_seq, ord, length(target_seq) as expected_length,
  length(target_seq) - length(target_seq) // 10 as range_min, length(target_seq) + length(target_seq) // 10 as range_max
from (select target_seq, min(ord) as ord from (
  select item_id * 1000 + pos as ord, {_sql_dna('s', BASES)} as target_seq
  from (select item_id, unnest(parts) as s, generate_subscripts(parts, 1) - 1 as pos
    from (select item_id, regexp_split_to_array(text, '[.!?\\n]+') as parts from benchmark)))
  where target_seq != '' group by target_seq)"""),
    "barcode_map": (("targets",), """
select experiment, barcode, arg_min(target_id, ord) as target from (
  select ['de','en','es','fr'][ord % 4 + 1] as experiment,
    'barcode' || lpad(cast((ord // 1000 + ord) % 25 as varchar), 2, '0') as barcode, target_id, ord from targets)
group by experiment, barcode"""),
    "calibration": ((), """
select case l_returnflag when 'N' then 'signal_positive' when 'A' then 'unblock_mux_change'
    else 'data_service_unblock_mux_change' end as end_reason,
  pow(10, -(l_quantity / 2) / 10) as p,
  case when round(l_tax * 100) * 4 + 10 > l_quantity then 1 else 0 end as err from lineitem"""),
    "alignments": ((), """
select l_suppkey as exp_id,
  case l_linenumber when 2 then 16 when 3 then 256 when 4 then 2048 when 5 then 4 else 0 end as flag,
  cast(l_partkey % 61 as int) as mapq,
  cast(cast(l_quantity as int) as varchar) || 'M' || cast(l_linenumber as varchar) || 'I' ||
    cast(cast(l_quantity as int) as varchar) || 'M' || cast(l_linenumber % 3 + 1 as varchar) || 'D5M' as cigar,
  l_linenumber * 2 + 3 as nm, cast(floor(l_extendedprice) as bigint) as length
from lineitem"""),
    "tasks": ((), """
select conv_id as experiment_id, 't' || cast(turn as varchar) as name, turn as ord,
  ['passing','pending','failing','skipped'][length(text) % 4 + 1] as status,
  cast(length(text) % 3 + 1 as int) as priority,
  case when turn = 0 then cast([] as varchar[])
    when turn % 4 = 3 then ['t' || cast(turn - 1 as varchar), 't' || cast(turn + 50 as varchar)]
    else ['t' || cast(turn - 1 as varchar)] end as dependencies
from conversations"""),
    "parts": ((), """
select cast(p_partkey as bigint) as item,
  case when p_size % 3 = 0 then cast([] as bigint[]) else [p_partkey + p_size, p_partkey * 2] end as refs,
  string_split(p_name, ' ') as words, p_type as type, p_size as size, p_brand as brand from part"""),
    "run_paths": ((), """
select o_orderkey as event_id,
  '/data/' || ['HG002','na12878','plain','COLO829'][o_orderkey % 4 + 1] || '/' || strftime(o_orderdate, '%Y%m%d') || '_1200_' ||
  ['PA','FA','FB','QX','MN'][o_orderkey % 5 + 1] || 'W' || lpad(cast(o_orderkey % 100000 as varchar), 5, '0') || '_' ||
  substring(md5(cast(o_orderkey as varchar)), 1, 8) || '/' ||
  ['dna_r10.4.1_e8.2_sup','r9.4.1_hac','x_fast','none'][o_orderkey % 4 + 1] || '/' ||
  ['5mCG_5hmCG','6mA','plain'][o_orderkey % 3 + 1] || '/barcode' || lpad(cast(o_orderkey % 96 as varchar), 2, '0') ||
  '/rep' || cast(o_orderkey % 4 as varchar) || '_' ||
  ['sqk-lsk114','SQK-RBK114','kit','adaptive_duplex','hg38'][o_orderkey % 5 + 1] as path,
  case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%m%d%Y') else strftime(o_orderdate, '%Y%m%d') end as date_text,
  strftime(o_orderdate, '%Y-%m-%d') || 'T08:15:30.123456-05:00' as started,
  strftime(o_orderdate + to_days(cast(o_orderkey % 3 + 1 as int)), '%Y-%m-%d') || 'T20:45:00.5+00:00' as ended
from orders"""),
}
