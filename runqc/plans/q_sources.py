"""Reader queries: the parsers of run files over texts that the tables are written out as."""

from __future__ import annotations

from pyspark.sql import functions as F

from runqc.operators import align, documents, endreasons
from runqc.operators import reads as R
from runqc.plans.catalog import query
from runqc.plans.q_reads import r
from runqc.session import shared_path
from runqc.sources import inventory, sequences, summary, writers

MEAN_Q = "round(least(-10 * log10(list_sum(list_transform(string_split(qual, ''), lambda c: pow(10, -(ascii(c) - 33) / 10.0))) / length(qual)), 60), 6)"


@query("fastq_records", f"""
select cast(doc_id as varchar) || case when doc_id % 3 = 0 then '_fail' else '_pass' end as file, read_id as name, seq, qual, doc_id % 3 <> 0 as passes, length, {MEAN_Q} as qscore
from sentences""", ("sentences",))
def fastq_records(v):
    """The sentences of each document as one FASTQ file, read by ranges of 4 KB."""
    record = F.concat(F.lit("@"), "read_id", F.lit(" run="), "experiment", F.lit("\n"), "seq", F.lit("\n+\n"), "qual", F.lit("\n"))
    file = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, "_fail").otherwise("_pass"))
    texts = v.sentences.groupBy(file.alias("file")).agg(F.array_join(F.collect_list(record), "").alias("text"))
    return sequences.fastq_text(texts, range_bytes=4096).withColumn("qscore", r(F.col("qscore")))


@query("end_reason_columns", """
select read_id, case when l_linenumber = 4 then 0 else cast(channel as int) end as channel, end_reason, case when l_linenumber = 2 then 0 else duration end as duration
from (select l_linenumber, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || cast(round(l_extendedprice * 100) as bigint) as read_id, l_partkey % 512 + 1 as channel,
  case l_returnflag when 'N' then 'signal_positive' when 'A' then 'unblock_mux_change' else 'data_service_unblock_mux_change' end as end_reason, round(l_tax * 100)::double as duration from lineitem)""")
def end_reason_columns(v):
    """Headers that only contain the names; channels and durations that cannot be read."""
    n = F.col("l_linenumber")
    read_id = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    reason = F.when(F.col("l_returnflag") == "N", "Signal Positive").when(F.col("l_returnflag") == "A", "unblock_mux_change").otherwise("Data Service")
    raw = v.table("lineitem").select(
        read_id.alias("the_read_id_"), F.when(n == 4, "?").otherwise((F.col("l_partkey") % 512 + 1).cast("string")).alias("Channel No"),
        reason.alias("end_reason_v2"), F.when(n == 2, "").otherwise(F.round(F.col("l_tax") * 100).cast("string")).alias("duration_s"))
    return summary.end_reason_columns(raw)


@query("key_values", """
select o_orderkey, 'I' || o_custkey as instrument, o_orderpriority || '=' || o_orderstatus as protocol, case when o_orderkey % 2 = 0 then cast(o_custkey as varchar) else 'old' end as sample_id, 3 as n from orders""")
def key_values(v):
    """Five lines of every order: a value with an equal sign, a key twice, a line without any."""
    line = F.array(
        F.concat(F.lit("instrument = I"), F.col("o_custkey").cast("string")), F.lit("no pair"), F.lit("sample_id=old"),
        F.concat(F.lit("protocol="), "o_orderpriority", F.lit("="), "o_orderstatus"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("sample_id="), F.col("o_custkey").cast("string"))).otherwise("end"))
    lines = v.table("orders").select(F.col("o_orderkey").alias("file"), F.posexplode(line).alias("line", "value"))
    get = lambda k: F.col("fields")[k].alias(k)
    return summary.key_values(lines).select(F.col("file").alias("o_orderkey"), get("instrument"), get("protocol"), get("sample_id"), F.size("fields").cast("bigint").alias("n"))


@query("fasta_text", "select doc_id, read_id as name, seq from sentences", ("sentences",))
def fasta_text(v):
    """The sentences of each document as one FASTA file, on lines of sixty bases, with marks inside the headers."""
    record = F.concat(F.lit(">"), "read_id", F.lit(" len>5\n"), F.regexp_replace("seq", "(.{60})", "$1\n"), F.lit("\n"))
    texts = v.sentences.groupBy("doc_id").agg(F.array_join(F.collect_list(record), "").alias("text"))
    return sequences.fasta_text(texts, ["doc_id"])


@query("sam_records", f"""
select read_id as name, cast(doc_id % 5 * 4 as int) as flag, experiment as ref, cast(length % 61 as int) as mapq, length || 'M' as cigar, seq, qual, cast(doc_id % 9 as int) as nm, length, {MEAN_Q} as qscore, doc_id % 5 in (1, 3) as is_unmapped
from sentences where doc_id % 7 <> 3""", ("sentences",))
def sam_records(v):
    """SAM lines of the sentences; every seventh document's are cut short, headers stand between."""
    d = F.col("doc_id")
    fields = [F.col("read_id"), (d % 5 * 4).cast("string"), F.col("experiment"), F.lit("1"), (F.col("length") % 61).cast("string"),
              F.concat(F.col("length").cast("string"), F.lit("M")), F.lit("*"), F.lit("0"), F.lit("0"), F.col("seq"), F.col("qual"), F.concat(F.lit("NM:i:"), (d % 9).cast("string"))]
    whole, short = F.concat_ws("\t", *fields), F.concat_ws("\t", *fields[:10])
    lines = v.sentences.select(F.explode(F.array(F.when(d % 7 == 3, short).otherwise(whole), F.concat(F.lit("@PG\t"), "read_id"))).alias("value"))
    return sequences.sam_lines(lines).withColumn("qscore", r(F.col("qscore")))


@query("side_rows", """
select cast(doc_id as varchar) as read_id, case quality when 1 then 'signal_positive' else 'unblock_mux_change' end as end_reason, case when doc_id % 5 = 0 then 0 else cast(toxic as int) end as forced from labels""")
def side_rows(v):
    raw = v.table("labels").select(
        F.col("doc_id").cast("string").alias("read_id"), F.when(F.col("quality") == 1, "signal_positive").otherwise("unblock_mux_change").alias("end_reason"),
        F.when(F.col("doc_id") % 10 == 0, "yes").when(F.col("doc_id") % 5 != 0, F.col("toxic").cast("string")).alias("forced"))
    return summary.side_rows(raw)


@query("throughput_points", """
select o_orderdate::timestamp as ts, o_custkey as cumulative_reads, cast(round(o_totalprice * 100) as bigint) as cumulative_bases from orders where o_orderkey % 6 <> 0 and o_orderkey % 7 <> 0""")
def throughput_points(v):
    """Time points of every order; a sixth has no time that can be read, a seventh no number."""
    k = F.col("o_orderkey")
    raw = v.table("orders").select(
        F.when(k % 6 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"),
        F.when(k % 7 == 0, "?").otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string"))).alias("reads"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string").alias("bases"))
    return summary.throughput(raw)


@query("duty_time_rows", """
select event_type as state, case when event_id % 11 <> 0 then event_id * 0.5::double end as minute, cast(round(value * 1000) as bigint) as samples from events""")
def duty_time_rows(v):
    raw = v.table("events").select(
        F.col("event_type").alias("Channel State"), F.when(F.col("event_id") % 11 == 0, "n/a").otherwise((F.col("event_id") * F.lit(0.5)).cast("string")).alias("Experiment Time (minutes)"),
        F.round(F.col("value") * 1000).cast("bigint").cast("string").alias("State Time (samples)"))
    return summary.duty_time(raw)


RESULTS = "total_reads bigint, end_reasons map<string,bigint>"


def _result_texts(v):
    """A JSON document for every order; every ninth is cut off."""
    k = F.col("o_orderkey")
    reasons = F.create_map(F.lit("signal_positive"), k % 100 + 1, F.concat(F.lit("reason_"), F.col("o_orderstatus")), k % 7 + 1)
    text = F.to_json(F.struct((k % 100 + k % 7 + 2).alias("total_reads"), reasons.alias("end_reasons")))
    docs = v.table("orders").select(F.concat(k.cast("string"), F.lit(".json")).alias("file"), F.when(k % 9 == 0, F.substring(text, 1, 20)).otherwise(text).alias("text"))
    return summary.result_texts(docs, RESULTS)


@query("result_texts", """
select cast(o_orderkey as varchar) as file, case when o_orderkey % 9 <> 0 then o_orderkey % 100 + o_orderkey % 7 + 2 end as total_reads, case when o_orderkey % 9 <> 0 then o_orderkey % 100 + 1 end as signal_positive,
  case when o_orderkey % 9 = 0 then 'error' else 'success' end as status from orders""")
def result_texts(v):
    return _result_texts(v).select("file", "total_reads", F.col("end_reasons")["signal_positive"].alias("signal_positive"), "status")


@query("result_totals", """
with x as (select o_orderkey, 'signal_positive' as end_reason, o_orderkey % 100 + 1 as n from orders union all select o_orderkey, 'reason_' || o_orderstatus, o_orderkey % 7 + 1 from orders),
t as (select end_reason, cast(sum(n) as bigint) as total from x where o_orderkey % 9 <> 0 group by 1)
select end_reason, total, round(total * 100.0 / sum(total) over (), 6) as pct from t""")
def result_totals(v):
    """End reasons of all documents that could be read."""
    long = _result_texts(v).where("status = 'success'").select("file", F.explode("end_reasons").alias("end_reason", "n"))
    return endreasons.totals(long).withColumn("pct", r(F.col("pct")))


@query("discover_experiments", """
with c as (select c_custkey as k, '/data/' || c_mktsegment || '/' || c_nationkey as parent from customer),
d as (select parent || '/run' || k as run_dir, parent, case when k % 4 = 0 then 'summary' when k % 4 = 1 or k % 12 = 3 then 'raw_only' end as discovery, k % 4 <> 3 or k % 12 = 3 as any_file from c),
p as (select parent as run_dir, bool_or(k % 40 = 5) as own, (select count(*) from d where d.parent = c.parent and any_file) as runs from c group by parent)
select run_dir, discovery from d where discovery is not null union all select run_dir, 'raw_only' from p where own and runs < 2""")
def discover_experiments(v):
    """Run folders among the files of every customer: summaries, raw data, reads only, an excluded folder, containers."""
    k = F.col("c_custkey")
    parent = F.concat(F.lit("/data/"), "c_mktsegment", F.lit("/"), F.col("c_nationkey").cast("string"))
    run = F.concat(parent, F.lit("/run"), k.cast("string"))
    at = lambda name: F.concat(run, F.lit(name))
    files = F.array_compact(F.array(
        F.when(k % 4 == 0, at("/sequencing_summary_a.txt")), F.when(k % 4 == 1, at("/pod5/a.pod5")), F.when(k % 4 == 2, at("/fastq_pass/b/a.fastq.gz")),
        F.when(k % 4 == 3, at("/pod5_pass/sequencing_summary_x.txt")), F.when(k % 12 == 3, at("/fast5_fail/a.fast5")), F.when(k % 40 == 5, F.concat(parent, F.lit("/loose.pod5")))))
    listed = v.table("customer").select(F.explode(files).alias("path"), F.lit(1).alias("size"))
    return inventory.experiments(listed).select("run_dir", "discovery")


@query("log_statistics", """
select o_custkey, cast(arg_max(o_orderkey % 1000, o_orderkey) as bigint) as total_reads, cast(arg_max(case o_orderkey % 3 when 0 then (o_orderkey % 50) * 1000000000 when 1 then (o_orderkey % 50) * 1000000 else o_orderkey % 50 end, o_orderkey) filter (o_orderkey % 2 = 1) as bigint) as bases_called,
  arg_max(round(o_totalprice) + 0.5, o_orderkey)::double as samples_per_second from orders group by 1""")
def log_statistics(v):
    """Three log lines of every order, one report of bases of every second; a customer's last report of each counts."""
    k = F.col("o_orderkey")
    unit = F.when(k % 3 == 0, "G").when(k % 3 == 1, "M").otherwise("")
    lines = F.array_compact(F.array(
        F.concat(F.lit("> Finished "), (k % 1000).cast("string"), F.lit(" Reads processed")),
        F.when(k % 2 == 1, F.concat(F.lit("done "), (k % 50).cast("string"), unit, F.lit("bases called"))),
        F.concat(F.lit("speed "), (F.round("o_totalprice") + 0.5).cast("decimal(20,1)").cast("string"), F.lit(" samples/s"))))
    rows = v.table("orders").select("o_custkey", F.posexplode(lines).alias("i", "value"), k)
    return summary.log_statistics(rows.select("o_custkey", (F.col("o_orderkey") * 4 + F.col("i")).alias("line_no"), "value"), ["o_custkey"])


@query("barcode_kits", """
with x as (select l_suppkey as exp_id, case when l_linenumber = 1 then '-' when l_linenumber = 2 then '' when l_linenumber <> 3 then 'barcode' || (l_partkey % 12) end as b, case when l_quantity > 25 then 'KIT' || (l_suppkey % 3) else '-' end as kit, l_linenumber in (5, 6) as duplex from lineitem)
select exp_id, array_to_string(list_sort(list(distinct b) filter (b not in ('-', ''))), ',') as barcodes, count(distinct case when b not in ('-', '') then b end) as barcode_count, min(case when kit <> '-' then kit end) as barcode_kit, count(*) filter (duplex) as duplex_read_count from x group by 1""")
def barcode_kits(v):
    n = F.col("l_linenumber")
    reads = v.table("lineitem").select(
        F.col("l_suppkey").alias("exp_id"),
        F.when(n == 1, "-").when(n == 2, "").when(n != 3, F.concat(F.lit("barcode"), (F.col("l_partkey") % 12).cast("string"))).alias("barcode_arrangement"),
        F.when(F.col("l_quantity") > 25, F.concat(F.lit("KIT"), (F.col("l_suppkey") % 3).cast("string"))).otherwise("-").alias("barcode_kit"),
        F.when(n == 5, "r1").otherwise("").alias("duplex_parent_template"), F.when(n == 6, "r2").alias("duplex_parent_complement"))
    return R.barcode_kit_summary(reads, ["exp_id"]).withColumn("barcodes", F.array_join("barcodes", ","))


@query("extract_figures", r"""
with p as (select doc_id, string_split(regexp_replace(text, '([a-zA-Z]+) (the|est|ist|es) ([a-zA-Z]+)', '\\begin{figure}\\caption{\1 of}\\label{fig:\3}\\end{figure}', 'g'), '\begin{figure}') as pieces from documents),
f as (select doc_id, unnest(pieces[2:]) as piece, generate_subscripts(pieces[2:], 1) as ordinal from p)
select doc_id, ordinal, 'figure' as kind, regexp_extract(piece, '\\caption\{(.*?)\}', 1) as caption, regexp_extract(piece, '\\label\{(.*?)\}', 1) as label from f""")
def extract_figures(v):
    """Figures planted at function words of whole documents, with caption and label."""
    planted = F.regexp_replace("text", r"([a-zA-Z]+) (the|est|ist|es) ([a-zA-Z]+)", r"\\begin{figure}\\caption{$1 of}\\label{fig:$3}\\end{figure}")
    rows = v.texts("documents", "doc_id").select("doc_id", planted.alias("text"))
    found = documents.figures_and_tables(rows, ["doc_id"])
    return found.select("doc_id", F.col("ordinal").cast("bigint").alias("ordinal"), "kind", "caption", "label")


# -- sinks: what is written is read again ---------------------------------------

def _written(v, name, write):
    path = shared_path(v.spark, name)
    write(path)
    return path


@query("per_read_csv", "select read_id, channel, end_reason, duration from reads", ("reads",))
def per_read_csv(v):
    path = _written(v, "per-read", lambda p: writers.per_read_csv(v.reads, p))
    return v.spark.read.csv(path, header=True, schema="read_id string, channel bigint, end_reason string, duration double")


@query("summary_json", "select exp_id, count(*) as reads, cast(sum(length) as bigint) as bases from reads group by 1", ("reads",))
def summary_json(v):
    rows = v.reads.groupBy("exp_id").agg(F.count("*").alias("reads"), F.sum("length").alias("bases"))
    return v.spark.read.json(_written(v, "summary", lambda p: writers.summary_json(rows, p)), schema="exp_id bigint, reads bigint, bases bigint")


@query("comparison_tables", """
with x as (select exp_id, count(*) as reads, max(length) as longest from reads group by 1) select form, x.* from x, (values ('csv'), ('tsv'), ('json')) as f(form)""", ("reads",))
def comparison_tables(v):
    """The same table in its three forms."""
    rows = v.reads.groupBy("exp_id").agg(F.count("*").alias("reads"), F.max("length").cast("bigint").alias("longest"))
    out, schema = None, "exp_id bigint, reads bigint, longest bigint"
    for form in ("csv", "tsv", "json"):
        path = _written(v, form, lambda p, form=form: writers.table(rows, p, form))
        read = v.spark.read.json(path, schema=schema) if form == "json" else v.spark.read.csv(path, header=True, schema=schema, sep={"csv": ",", "tsv": "\t"}[form])
        part = read.select(F.lit(form).alias("form"), "*")
        out = part if out is None else out.unionAll(part)
    return out


@query("distance_table", "select read_id, levenshtein(seq, 'AGAA') as a, levenshtein(seq, 'ACGTACGT') as b from sentences", ("sentences",))
def distance_table(v):
    """Distances written as a matrix, a column a reference."""
    rows = align.distance_columns(v.sentences.select("read_id", "seq"), {"a": "AGAA", "b": "ACGTACGT"}).drop("seq")
    path = _written(v, "distances", lambda p: writers.distance_matrix(rows, p))
    return v.spark.read.csv(path, header=True, sep="\t", schema="read_id string, a bigint, b bigint")


@query("position_table", "select exp_id, channel, count(*) as n from reads group by 1, 2", ("reads",))
def position_table(v):
    rows = v.reads.groupBy("exp_id", "channel").agg(F.count("*").alias("n"))
    path = _written(v, "positions", lambda p: writers.position_table(rows, p))
    return v.spark.read.csv(path, header=True, sep="\t", schema="exp_id bigint, channel bigint, n bigint")


@query("demultiplexed_files", "select barcode, count(*) as reads, cast(sum(length) as bigint) as bases, count(*) as listed from sentences group by 1", ("sentences",))
def demultiplexed_files(v):
    """A folder for each barcode, and the summary beside it."""
    rows = v.sentences.select("read_id", "seq", "length", "barcode", F.lit(0).alias("barcode_edits"))
    summary_path = shared_path(v.spark, "barcoding-summary")
    path = _written(v, "demultiplexed", lambda p: writers.demultiplexed(rows, p, summary_path))
    listed = v.spark.read.csv(summary_path, header=True, sep="\t").groupBy("barcode").agg(F.count("*").alias("listed"))
    files = v.spark.read.parquet(path).groupBy("barcode").agg(F.count("*").alias("reads"), F.sum("length").cast("bigint").alias("bases"))
    return files.join(listed, "barcode")


@query("fasta_file", "select target_id as name, target_seq as seq from targets", ("targets",))
def fasta_file(v):
    """References written as FASTA and read by the FASTA reader."""
    path = _written(v, "references", lambda p: writers.fasta(v.targets.select(F.col("target_id").alias("name"), F.col("target_seq").alias("seq")), p))
    return sequences.fasta(v.spark, path)


@query("warehouse_upsert", """
select read_id as uniq_id, 'E' || exp_id as exp_id, case when exp_id % 3 = 0 then length + 1 else length end as readlen from reads where exp_id % 3 <> 0 or channel % 2 = 0
union all select read_id, 'E' || exp_id, length from reads where exp_id % 3 = 0 and channel % 2 = 1""", ("reads",))
def warehouse_upsert(v):
    """All reads, then a second batch that replaces half of the reads of every third experiment."""
    row = lambda more: [F.col("read_id").alias("uniq_id"), F.concat(F.lit("E"), F.col("exp_id").cast("string")).alias("exp_id"), (F.col("length") + more).alias("readlen")]
    again = v.reads.where("exp_id % 3 = 0 and channel % 2 = 0").select(*row(1))
    path = _written(v, "warehouse", lambda p: (writers.warehouse(v.reads.select(*row(0)), p), writers.warehouse(again, p)))
    return writers.read_warehouse(v.spark, path).select("uniq_id", "exp_id", F.col("readlen").cast("bigint").alias("readlen"))
