"""Registry, event, task, document and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from runqc.functions import paths as P
from runqc.operators import documents as D
from runqc.operators import registry as X
from runqc.operators import tasks as TK
from runqc.plans.catalog import query
from runqc.plans.q_reads import r, rounded
from runqc.session import checkpoint_root
from runqc.streaming import monitor

COUNTS = "coalesce(pod5_files, 0) as pod5_files, coalesce(fast5_files, 0) as fast5_files, coalesce(fastq_files, 0) as fastq_files, coalesce(bam_files, 0) as bam_files"
DIFF_SQL = f"""d as (select path, {COUNTS} from registry_new), c as (select path, {COUNTS} from registry_old),
diff as (select coalesce(d.path, c.path) as path, case when c.path is null then 'new' when d.path is null then 'removed'
    when (d.pod5_files, d.fast5_files, d.fastq_files, d.bam_files) != (c.pod5_files, c.fast5_files, c.fastq_files, c.bam_files) then 'updated' else 'unchanged' end as change_type,
  concat_ws(',', case when d.pod5_files != c.pod5_files then 'pod5_files:' || c.pod5_files || '>' || d.pod5_files end,
    case when d.fast5_files != c.fast5_files then 'fast5_files:' || c.fast5_files || '>' || d.fast5_files end,
    case when d.fastq_files != c.fastq_files then 'fastq_files:' || c.fastq_files || '>' || d.fastq_files end,
    case when d.bam_files != c.bam_files then 'bam_files:' || c.bam_files || '>' || d.bam_files end) as changes
  from d full join c on d.path = c.path)"""
BOTH = ("registry_old", "registry_new")


@query("registry_diff", f"with {DIFF_SQL} select * from diff", BOTH)
def registry_diff(v):
    out = X.diff(v.registry_new, v.registry_old)
    text = F.transform("changes", lambda c: F.concat(c["field"], F.lit(":"), c["old"].cast("string"), F.lit(">"), c["new"].cast("string")))
    return out.withColumn("changes", F.coalesce(F.array_join(text, ","), F.lit("")))


@query("diff_summary", f"""with {DIFF_SQL} select count(*) filter (change_type != 'removed') as total_discovered, count(*) filter (change_type != 'new') as current_in_registry,
  count(*) filter (change_type = 'new') as new_count, count(*) filter (change_type = 'updated') as updated_count, count(*) filter (change_type = 'removed') as removed_count,
  count(*) filter (change_type = 'unchanged') as unchanged_count from diff""", BOTH)
def diff_summary(v):
    return X.diff_summary(X.diff(v.registry_new, v.registry_old))


@query("apply_proposal", f"""select coalesce(c.path, d.path) as path, case when c.path is null then 'discovered' when d.path is null then 'archived' else c.status end as status,
  case when d.path is null then 'directory_not_found' end as archived_reason,
  case when d.path is null then c.pod5_files else coalesce(d.pod5_files, 0) end as pod5_files, case when d.path is null then c.fast5_files else coalesce(d.fast5_files, 0) end as fast5_files,
  case when d.path is null then c.fastq_files else coalesce(d.fastq_files, 0) end as fastq_files, case when d.path is null then c.bam_files else coalesce(d.bam_files, 0) end as bam_files
from registry_old c full join registry_new d on c.path = d.path""", BOTH)
def apply_proposal(v):
    return X.apply_proposal(v.registry_new, v.registry_old)


@query("anti_new", "select path from registry_new where path not in (select path from registry_old)", BOTH)
def anti_new(v):
    return X.new_rows(v.registry_new, v.registry_old, "path").select("path")


@query("removed_runs", "select path from registry_old where path not in (select path from registry_new)", BOTH)
def removed_runs(v):
    return X.new_rows(v.registry_old, v.registry_new, "path").select("path")


@query("prefer_database", """select path, pod5_files, 'db' as origin from registry_old union all select path, pod5_files, 'registry' from registry_new where path not in (select path from registry_old)""", BOTH)
def prefer_database(v):
    pick = lambda df, origin: df.select("path", "pod5_files", F.lit(origin).alias("origin"))
    return X.prefer(pick(v.registry_old, "db"), pick(v.registry_new, "registry"), "path")


@query("incremental_reads", """select exp_id, count(*) as n from reads where exp_id not in (select exp_id from experiments where status = 'archived') group by 1""", ("reads", "experiments"))
def incremental_reads(v):
    """Runs already loaded are removed before the scan is aggregated."""
    loaded = v.experiments.where(F.col("status") == "archived").select("exp_id")
    return X.new_rows(v.reads, loaded, "exp_id").groupBy("exp_id").agg(F.count("*").alias("n"))


@query("reads_semi", "select read_id from reads where channel in (select p_partkey % 512 + 1 from part where p_size = 7)", ("reads",))
def reads_semi(v):
    wanted = v.table("part").where(F.col("p_size") == 7).select((F.col("p_partkey") % 512 + 1).alias("channel"))
    return v.reads.join(wanted, "channel", "left_semi").select("read_id")


@query("reads_with_side_reason", """
select r.read_id, coalesce(case o_orderstatus when 'F' then 'signal_positive' when 'O' then 'unblock_mux_change' end, 'not_found') as end_reason
from reads r left join orders on o_orderkey = cast(split_part(read_id, '-', 1) as bigint)""", ("reads",))
def reads_with_side_reason(v):
    status = F.col("o_orderstatus")
    side = v.table("orders").select(
        F.col("o_orderkey").alias("k"),
        F.when(status == "F", "signal_positive").when(status == "O", "unblock_mux_change").alias("reason"),
    )
    keyed = v.reads.select("read_id", F.split("read_id", "-")[0].cast("bigint").alias("k"))
    return keyed.join(side, "k", "left").select("read_id", F.coalesce("reason", F.lit("not_found")).alias("end_reason"))


@query("experiments_with_stats", """select e.exp_id, e.name, e.sample, r.total_reads, r.n50, round(r.mean_qscore, 6) as mean_qscore from experiments e left join runs r using (exp_id) order by e.name desc""", ("experiments", "runs"))
def experiments_with_stats(v):
    stats = v.runs.select("exp_id", "total_reads", "n50", r(F.col("mean_qscore")).alias("mean_qscore"))
    return v.experiments.select("exp_id", "name", "sample").join(stats, "exp_id", "left").orderBy(F.desc("name"))


@query("results_with_metadata", """select r.exp_id, r.total_reads, coalesce(case when e.exp_id % 6 != 0 then e.flowcell end, 'unknown') as flowcell, coalesce(case when e.exp_id % 4 != 0 then e.sample end, 'unknown') as sample
from runs r left join experiments e using (exp_id)""", ("experiments", "runs"))
def results_with_metadata(v):
    k = F.col("exp_id")
    meta = v.experiments.select("exp_id", F.when(k % 6 != 0, F.col("flowcell")).alias("f"), F.when(k % 4 != 0, F.col("sample")).alias("s"))
    return v.runs.select("exp_id", "total_reads").join(meta, "exp_id", "left").select(
        "exp_id", "total_reads", F.coalesce("f", F.lit("unknown")).alias("flowcell"), F.coalesce("s", F.lit("unknown")).alias("sample")
    )


@query("merge_sources", """select path, sample_id, pod5_files, fastq_files, source, n_name as physical from (
  select path, sample_id, pod5_files, fastq_files, flow_cell_id, 'internal' as source from registry_old union all select path, sample_id, null, fastq_files, flow_cell_id, 'public' from registry_new) u
left join (select 'FC' || cast(n_nationkey as varchar) as flow_cell_id, n_name from nation) n using (flow_cell_id)""", BOTH)
def merge_sources(v):
    internal = v.registry_old.select("path", "sample_id", "pod5_files", "fastq_files", "flow_cell_id", F.lit("internal").alias("source"))
    public = v.registry_new.select("path", "sample_id", "fastq_files", "flow_cell_id", F.lit("public").alias("source"))
    sizes = v.table("nation").select(
        F.concat(F.lit("FC"), F.col("n_nationkey").cast("string")).alias("flow_cell_id"), F.col("n_name").alias("physical")
    )
    return internal.unionByName(public, allowMissingColumns=True).join(sizes, "flow_cell_id", "left").drop("flow_cell_id")


@query("size_mappings", """select p_size as expected_size, p_partkey as mapping_id, p_brand as target_id, r.n as target_parts from part left join (select p_brand as b, count(*) as n from part group by 1) r on r.b = p_brand""")
def size_mappings(v):
    targets = v.table("part").groupBy(F.col("p_brand").alias("target_id")).agg(F.count("*").alias("target_parts"))
    maps = v.table("part").select(F.col("p_size").alias("expected_size"), F.col("p_partkey").alias("mapping_id"), F.col("p_brand").alias("target_id"))
    return maps.join(targets, "target_id", "left")


RELATED_SQL = """m as (select exp_id as id, 'sample' as kind, sample as value from experiments union all select exp_id, 'flowcell', flowcell from experiments
  union all select exp_id, 'tag', unnest(tags) from experiments)"""


@query("related_groups", f"""with {RELATED_SQL} select id, kind, value, count(*) over (partition by kind, value) as group_size from m qualify count(*) over (partition by kind, value) > 1""", ("experiments",))
def related_groups(v):
    return X.related(v.experiments, "exp_id")


@query("related_experiments", f"""with {RELATED_SQL}, ch as (select arg_max(exp_id, (coalesce(balance, 0), exp_id)) as id from experiments group by device),
e as (select a.id as of_id, b.id, min(case a.kind when 'sample' then 0 when 'flowcell' then 1 else 2 end) as o from m a join m b on a.kind = b.kind and a.value = b.value and a.id != b.id
  where a.id in (select id from ch) group by 1, 2)
select of_id, id, ['sample', 'flowcell', 'tag'][o + 1] as reason from e""", ("experiments",))
def related_experiments(v):
    """Neighbours of the leading experiment of every device."""
    lead = F.max_by("exp_id", F.struct(F.coalesce("balance", F.lit(0.0)), "exp_id")).alias("exp_id")
    chosen = v.experiments.groupBy("device").agg(lead)
    return X.related_of(v.experiments, chosen, "exp_id")


@query("registry_search", """select exp_id from experiments where contains(lower(name), '00007') or contains(lower(sample), 'nation_3') or contains(lower(source), 'nation_3') or contains(lower(flowcell), 'nation_3')""", ("experiments",))
def registry_search(v):
    hits = X.search_fields(v.experiments, "00007", ["name"]).select("exp_id")
    wide = X.search_document(v.experiments, "NATION_3").select("exp_id")
    return hits.union(wide).distinct()


@query("registry_exact", "select exp_id, name from experiments where flowcell = 'FC3' and device = 'ASIA'", ("experiments",))
def registry_exact(v):
    return X.search_exact(v.experiments, flowcell="FC3", device="ASIA", sample=None).select("exp_id", "name")


@query("find_by_id", "select exp_id, name from experiments where name = 'Supplier#000000007'", ("experiments",))
def find_by_id(v):
    return X.find_by_id(v.experiments, "plier#000000007", "name").select("exp_id", "name")


@query("registry_list", "select exp_id, name from experiments where status = 'active' and list_contains(tags, 't3')", ("experiments",))
def registry_list(v):
    return X.listing(v.experiments, status="active", tag="t3").select("exp_id", "name")


BATCH_SQL = """x as (select o_orderkey as id, case o_orderstatus when 'F' then 'good' when 'O' then 'partial' end as completeness_status,
  case when o_custkey % 3 > 0 then list_filter(string_split(o_orderpriority, '-'), lambda w: length(w) > 4) end as analyses, case when o_orderpriority < '3' then 'local' else 'public' end as source from orders)"""


@query("registry_batch", f"""with {BATCH_SQL} select id, source from x where completeness_status is distinct from 'good' and coalesce(len(analyses), 0) = 0 and source = 'public'""")
def registry_batch(v):
    k = F.col("o_custkey")
    rows = v.table("orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "good").when(F.col("o_orderstatus") == "O", "partial").alias("completeness_status"),
        F.when(k % 3 > 0, F.filter(F.split("o_orderpriority", "-"), lambda w: F.length(w) > 4)).alias("analyses"),
        F.when(F.col("o_orderpriority") < "3", "local").otherwise("public").alias("source"),
    )
    return X.batch(rows, incomplete=True, unanalysed=True, source="public").select("id", "source")


# Documents of three levels out of orders; some lack a level, some are not JSON.
ORDER_JSON_SQL = """d as (select o_orderkey as id, case when o_orderkey % 11 = 0 then 'no json' when o_orderkey % 5 = 0 then json_object('run', o_orderstatus)::varchar
  else json_object('run', json_object('state', o_orderstatus, 'qc', json_object('reads', o_custkey, 'price', o_totalprice)), 'command', o_orderpriority, 'agent', 'agent ' || (o_custkey % 7),
    'exit_code', o_custkey % 4, 'duration_seconds', o_totalprice, 'outputs', string_split(o_orderpriority, '-'))::varchar end as doc from orders)"""


def order_documents(v):
    k = F.col("o_orderkey")
    whole = F.struct(
        F.struct(F.col("o_orderstatus").alias("state"), F.struct(F.col("o_custkey").alias("reads"), F.col("o_totalprice").alias("price")).alias("qc")).alias("run"),
        F.col("o_orderpriority").alias("command"), F.concat(F.lit("agent "), (F.col("o_custkey") % 7).cast("string")).alias("agent"), (F.col("o_custkey") % 4).alias("exit_code"),
        F.col("o_totalprice").alias("duration_seconds"), F.split("o_orderpriority", "-").alias("outputs"),
    )
    doc = F.when(k % 11 == 0, "no json").when(k % 5 == 0, F.to_json(F.struct(F.col("o_orderstatus").alias("run")))).otherwise(F.to_json(whole))
    return v.table("orders").select(k.alias("id"), doc.alias("doc"))


@query("nested_lookup", f"""with {ORDER_JSON_SQL}, j as (select id, case when json_valid(doc) then doc::json end as doc from d)
select id, json_extract_string(doc, '$.run.state') as state, cast(json_extract_string(doc, '$.run.qc.reads') as bigint) as reads, round(cast(json_extract_string(doc, '$.run.qc.price') as double), 2) as price,
  json_extract_string(doc, '$.run.state.deeper') as deeper, json_extract_string(doc, '$.agent') as agent from j""")
def nested_lookup(v):
    docs = order_documents(v)
    at = lambda path, form="string": X.lookup(docs, "doc", path, form)
    return rounded(docs.select(
        "id", at("run.state").alias("state"), at("run.qc.reads", "bigint").alias("reads"), at("run.qc.price", "double").alias("price"),
        at("run.state.deeper").alias("deeper"), at("agent").alias("agent"),
    ), "price", places=2)


@query("event_provenance", f"""with {ORDER_JSON_SQL}, j as (select id, case when json_valid(doc) then doc::json end as doc from d)
select id, json_extract_string(doc, '$.command') as command, json_extract_string(doc, '$.agent') as agent, round(cast(json_extract_string(doc, '$.duration_seconds') as double), 2) as duration_seconds,
  cast(json_extract_string(doc, '$.exit_code') as int) as exit_code, coalesce(array_to_string(json_extract_string(doc, '$.outputs[*]'), '|'), '') as outputs,
  case when cast(json_extract_string(doc, '$.exit_code') as int) = 0 then 'ok' when json_extract_string(doc, '$.exit_code') is not null then 'failed' end as outcome from j""")
def event_provenance(v):
    """Documents of events with command, agent, duration, exit code and outputs."""
    out = X.provenance(order_documents(v), "id", [], "doc").drop("machine")
    return rounded(out.withColumn("outputs", F.coalesce(F.array_join("outputs", "|"), F.lit(""))), "duration_seconds", places=2)


@query("tag_overlap", "select exp_id from experiments where list_has_any(tags, ['t1', 'u5'])", ("experiments",))
def tag_overlap(v):
    return X.any_tag(v.experiments, ["t1", "u5"]).select("exp_id")


@query("recent_experiments", "select event_id, exp_id, value from event_log order by ts desc, event_id desc limit 50", ("event_log",))
def recent_experiments(v):
    return v.event_log.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "exp_id", "value")


@query("registry_dedup", """select user_id as run_id, arg_min(event_type, event_id) as event_type, arg_min(round(value, 2), event_id) as value, count(*) as records, count(distinct props) as n_paths from events group by 1""")
def registry_dedup(v):
    rows = v.table("events").select(F.col("user_id").alias("run_id"), "event_id", "event_type", r(F.col("value"), 2).alias("value"), F.col("props").alias("path"))
    return X.deduplicate(rows, "run_id", "event_id", "path").drop("event_id", "path")


@query("dedup_paths", "select user_id as run_id, props as path, min(event_id) as first_seen from events group by 1, 2")
def dedup_paths(v):
    rows = v.table("events").select(F.col("user_id").alias("run_id"), "event_id", F.col("props").alias("path"))
    return X.all_paths(rows, "run_id", "event_id", "path")


@query("fingerprint", """select path, substring(sha256(concat_ws('|', path, coalesce(cast(pod5_files as varchar), ''), coalesce(cast(fast5_files as varchar), ''), coalesce(cast(fastq_files as varchar), ''),
  coalesce(cast(bam_files as varchar), ''), sample_id, flow_cell_id)), 1, 16) as content_hash, substring(md5(path), 1, 12) as path_id from registry_new""", ("registry_new",))
def fingerprint(v):
    fields = ["path", "pod5_files", "fast5_files", "fastq_files", "bam_files", "sample_id", "flow_cell_id"]
    return v.registry_new.select("path", X.fingerprint(fields).alias("content_hash"), F.substring(F.md5("path"), 1, 12).alias("path_id"))


@query("registry_stats", """
with e as (select *, case when balance > 5000 then balance else 0 end as sp, device as dev from experiments),
u as (select 'all' as level, 'all' as value, * from e union all select 'source', source, * from e union all select 'status', status, * from e union all select 'device', device, * from e)
select level, value, count(*) as n, count(distinct flowcell) as unique_flowcells, count(distinct dev) as unique_devices, count(*) filter (sp != 0) as with_qc_data from u group by 1, 2""", ("experiments",))
def registry_stats(v):
    sp = F.when(F.col("balance") > 5000, F.col("balance")).otherwise(0)
    return X.registry_stats(v.experiments.withColumn("pct_signal_positive", sp).withColumn("dev", F.col("device")))


@query("fill_missing", """
select exp_id, name, case when exp_id % 3 = 0 then 'x' || cast(exp_id as varchar) else sample end as sample, case when exp_id % 4 = 0 then coalesce(case when exp_id % 8 = 0 then 'fc' end, '') else flowcell end as flowcell,
  concat_ws(',', case when exp_id % 3 = 0 then 'sample' end, case when exp_id % 8 = 0 then 'flowcell' end) as changes from experiments""", ("experiments",))
def fill_missing(v):
    k = F.col("exp_id")
    base = v.experiments.select("exp_id", "name", F.when(k % 3 != 0, F.col("sample")).alias("sample"),
                                F.when(k % 4 != 0, F.col("flowcell")).otherwise("").alias("flowcell"))
    found = v.experiments.select("exp_id", F.concat(F.lit("x"), k.cast("string")).alias("sample"), F.when(k % 8 == 0, "fc").alias("flowcell"))
    out = X.fill_missing(base, found, "exp_id", ["sample", "flowcell"])
    return out.withColumn("changes", F.array_join("changes", ","))


@query("deep_merge", """
select coalesce(b.c_custkey, u.c_custkey) as id, coalesce(case when u.c_custkey % 2 = 0 then 'new' end, b.c_name) as name,
  coalesce(case when u.c_custkey % 3 = 0 then u.c_acctbal end, b.c_acctbal) as acct, coalesce(u.c_mktsegment, b.c_mktsegment) as seg
from (select * from customer where c_custkey % 10 != 3) b full join (select * from customer where c_custkey % 10 != 7) u on b.c_custkey = u.c_custkey""")
def deep_merge(v):
    c = v.table("customer")
    k = F.col("c_custkey")
    base = c.where(k % 10 != 3).select(k.alias("id"), F.struct(
        F.col("c_name").alias("name"), F.struct(F.col("c_acctbal").alias("acct")).alias("m")).alias("d"),
        F.create_map(F.lit("seg"), "c_mktsegment").alias("urls"))
    update = c.where(k % 10 != 7).select(k.alias("id"), F.struct(
        F.when(k % 2 == 0, "new").alias("name"), F.struct(F.when(k % 3 == 0, F.col("c_acctbal")).alias("acct")).alias("m")).alias("d"),
        F.create_map(F.lit("seg"), "c_mktsegment").alias("urls"))
    return X.deep_merge(base, update, "id").select("id", "d.name", "d.m.acct", F.col("urls")["seg"].alias("seg"))


@query("metadata_from_path", """
select event_id, regexp_extract(path, '([PF][A-Z]{2}[0-9]{5})|([A-Z]{3}[0-9]{5})') as flowcell_id, upper(nullif(regexp_extract(path, '(HG[0-9]{3,5}|NA[0-9]{5}|COLO829)', 1, 'i'), '')) as sample,
  nullif(regexp_extract(path, '_([a-f0-9]{8})(?:[_/.]|$)', 1), '') as run_id, lower(regexp_extract(path, '(barcode[0-9]{2})', 1)) as barcode,
  case event_id % 4 when 0 then 'sup' when 1 then 'hac' when 2 then 'fast' end as basecall_model, case event_id % 4 when 0 then 'R10.4.1' when 1 then 'R9.4.1' else case when regexp_matches(path, 'e8[.]?2') then 'E8.2' end end as chemistry,
  case when event_id % 5 = 4 then 'GRCh38' end as reference, ['5mCG,5hmCG', '6mA', null][event_id % 3 + 1] as modifications, cast(event_id % 4 as int) as replicate,
  case event_id % 5 when 0 then 'SQK-LSK114' when 1 then 'SQK-RBK114' end as kit, ['PromethION', 'Flongle', 'Flongle', null, 'MinION'][event_id % 5 + 1] as device_type,
  event_id % 5 = 3 as adaptive_sampling, event_id % 5 = 3 as duplex from run_paths""", ("run_paths",))
def metadata_from_path(v):
    m = P.metadata("path")
    m["modifications"] = F.array_join(m["modifications"], ",")
    m.pop("dataset_date")
    return v.run_paths.select("event_id", *[c.alias(n) for n, c in m.items()])


@query("dataset_date", """
with x as (select event_id, regexp_extract(path, '([0-9]{4})[._]?([0-9]{2})(?:[._]([0-9]{2}))?', 1) as y, regexp_extract(path, '([0-9]{4})[._]?([0-9]{2})(?:[._]([0-9]{2}))?', 2) as m from run_paths)
select event_id, case when try_cast(y as int) between 2020 and 2030 and try_cast(m as int) between 1 and 12 then y || '-' || m end as dataset_date from x""", ("run_paths",))
def dataset_date(v):
    return v.run_paths.select("event_id", P.metadata("path")["dataset_date"].alias("dataset_date"))


@query("date_parse", """
with x as (select event_id, try_strptime(date_text, '%m%d%Y') as a, try_strptime(date_text, '%Y%m%d') as b from run_paths)
select event_id, strftime(coalesce(case when year(a) between 2015 and 2030 then a end, case when year(b) between 2015 and 2030 then b end), '%Y-%m-%d') as run_date from x""", ("run_paths",))
def date_parse(v):
    """Order dates moved by 20 years, so that the year guard keeps most and drops some."""
    return v.run_paths.select("event_id", F.date_format(P.compact_date("date_text"), "yyyy-MM-dd").alias("run_date"))


@query("run_duration_hours", """
select event_id, split_part(started, 'T', 1) as start_date, substring(split_part(started, 'T', 2), 1, 5) as start_clock,
  round((epoch(cast(substring(ended, 1, 19) as timestamp)) - epoch(cast(substring(started, 1, 19) as timestamp))) / 3600, 6) as hours from run_paths""", ("run_paths",))
def run_duration_hours(v):
    return v.run_paths.select(
        "event_id", P.iso_date("started").alias("start_date"), P.iso_time("started").alias("start_clock"),
        r(P.duration_hours("started", "ended")).alias("hours"),
    )


@query("run_inventory", """
with f as (select '/runs/' || c_mktsegment || '/r' || cast(c_nationkey as varchar) as run_dir, case c_custkey % 5 when 0 then 'pod5' when 1 then 'fastq' when 2 then 'bam' when 3 then 'sequencing_summary' end as kind, c_custkey as size from customer)
select run_dir, count(*) filter (kind = 'sequencing_summary') as sequencing_summary_files, count(*) filter (kind = 'pod5') as pod5_files, count(*) filter (kind = 'fastq') as fastq_files,
  count(*) filter (kind = 'bam') as bam_files, cast(sum(size) as bigint) as total_bytes, case when bool_or(kind = 'sequencing_summary') then 'sequencing_summary' when bool_or(kind = 'fastq') then 'fastq'
    when bool_or(kind = 'bam') then 'bam' else 'pod5' end as preferred_source from f where kind is not null group by 1""")
def run_inventory(v):
    from runqc.sources.inventory import run_inventory as inventory

    k = F.col("c_custkey")
    ending = F.when(k % 5 == 0, F.concat(F.lit("/pod5/f"), k.cast("string"), F.lit(".pod5"))).when(
        k % 5 == 1, F.concat(F.lit("/fastq_pass/barcode01/f"), k.cast("string"), F.lit(".fastq.gz"))).when(
        k % 5 == 2, F.concat(F.lit("/f"), k.cast("string"), F.lit(".bam"))).when(
        k % 5 == 3, F.lit("/sequencing_summary_x.txt")).otherwise("/notes.doc")
    files = v.table("customer").select(
        F.concat(F.lit("/runs/"), "c_mktsegment", F.lit("/r"), F.col("c_nationkey").cast("string"), ending).alias("path"), k.alias("size")
    )
    return inventory(files).select(
        "run_dir", "sequencing_summary_files", "pod5_files", "fastq_files", "bam_files", "total_bytes", "preferred_source"
    )


# -- events -------------------------------------------------------------------

@query("latest_event", """select exp_id, analysis, arg_max(event_id, (ts, event_id)) as event_id, arg_max(status, (ts, event_id)) as status, arg_max(round(value, 2), (ts, event_id)) as value from event_log group by 1, 2""", ("event_log",))
def latest_event(v):
    return rounded(X.latest_event(v.event_log, ["exp_id", "analysis"], ["ts", "event_id"], ["event_id", "status", "value"]), "value", places=2)


@query("sync_events", """
with l as (select exp_id, arg_max(value, (ts, event_id)) as v, arg_max(status, (ts, event_id)) as st from event_log where analysis = '1-URGENT' group by 1),
s as (select c_custkey as exp_id, c_name as name, c_acctbal as mean_qscore, c_nationkey as n50 from customer)
select coalesce(s.exp_id, l.exp_id) as exp_id, name, round(coalesce(case when st != 'P' then v end, mean_qscore), 2) as mean_qscore, n50 from s full join l using (exp_id)""", ("event_log",))
def sync_events(v):
    urgent = v.event_log.where(F.col("analysis") == "1-URGENT")
    newest = X.latest_event(urgent, ["exp_id"], ["ts", "event_id"], ["value", "status"])
    values = newest.select("exp_id", F.when(F.col("status") != "P", F.col("value")).alias("mean_qscore"), F.lit(None).cast("int").alias("n50"))
    stats = v.table("customer").select(
        F.col("c_custkey").alias("exp_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("mean_qscore"), F.col("c_nationkey").alias("n50")
    )
    return rounded(X.sync_statistics(stats, values, "exp_id", ["mean_qscore", "n50"]), "mean_qscore", places=2)


@query("replace_end_reasons", """
with d as (select exp_id, end_reason, count(*) as n from reads group by all), e as (select exp_id, status as end_reason, count(*) as n from event_log where exp_id in (select exp_id from reads) group by all)
select * from d where exp_id not in (select exp_id from e) union all select * from e""", ("reads", "event_log"))
def replace_end_reasons(v):
    d = v.reads.groupBy("exp_id", "end_reason").agg(F.count("*").alias("n"))
    known = v.reads.select("exp_id").distinct()
    e = v.event_log.join(known, "exp_id", "left_semi").groupBy(
        "exp_id", F.col("status").alias("end_reason")
    ).agg(F.count("*").alias("n"))
    return X.replace_end_reasons(d, e, "exp_id")


@query("event_history", """select exp_id, event_id, analysis, row_number() over (partition by exp_id order by ts desc, event_id desc) as position from event_log""", ("event_log",))
def event_history(v):
    return X.history(v.event_log, "exp_id", ["ts", "event_id"]).select("exp_id", "event_id", "analysis", "position")


@query("context_assembly", """
with ev as (select exp_id, count(*) as n_events, strftime(max(ts), '%Y-%m-%d') as last_event, arg_max(analysis, (ts, event_id)) as last_analysis from event_log group by 1),
er as (select exp_id, string_agg(end_reason || '=' || cast(n as varchar), ',' order by end_reason) as end_reasons from (select exp_id, end_reason, count(*) as n from reads group by all) group by 1)
select e.exp_id, e.name, r.total_reads, r.n50, coalesce(n_events, 0) as n_events, last_event, last_analysis, end_reasons from experiments e left join runs r using (exp_id) left join ev using (exp_id) left join er using (exp_id)""", ("experiments", "runs", "event_log", "reads"))
def context_assembly(v):
    reasons = v.reads.groupBy("exp_id", "end_reason").agg(F.count("*").alias("n"))
    out = X.context(v.experiments.select("exp_id", "name"), v.runs.select("exp_id", "total_reads", "n50"), v.event_log, reasons, "exp_id")
    return out.withColumn("last_event", F.date_format("last_event", "yyyy-MM-dd"))


@query("artifact_version", """select channel % 50 as exp, end_reason as artifact, coalesce(max(k) filter (event_id % 7 != 0), 0) + 1 as next_version from stream_reads group by 1, 2""", ("stream_reads",))
def artifact_version(v):
    rows = v.stream_reads.select(
        (F.col("channel") % 50).alias("exp"), F.col("end_reason").alias("artifact"),
        F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("v"), F.col("k").cast("string"))).otherwise("draft").alias("version"),
    )
    return X.artifact_versions(rows, ["exp", "artifact"], [])


# -- tasks --------------------------------------------------------------------

TASK_SQL = """dep as (select t.experiment_id, t.name, x.d, p.status as ds from tasks t, unnest(t.dependencies) as x(d) left join tasks p on p.experiment_id = t.experiment_id and p.name = x.d),
st as (select t.*, not t.status in ('passing', 'skipped') and coalesce((select bool_and(coalesce(ds in ('passing', 'skipped'), false)) from dep where dep.experiment_id = t.experiment_id and dep.name = t.name), true) as is_runnable,
  coalesce((select bool_or(coalesce(ds = 'failing', false)) from dep where dep.experiment_id = t.experiment_id and dep.name = t.name), false) as is_blocked from tasks t)"""


@query("runnable_tasks", f"with {TASK_SQL} select experiment_id, name, priority from st where is_runnable", ("tasks",))
def runnable_tasks(v):
    return TK.runnable(v.tasks).select("experiment_id", "name", "priority")


@query("blocked_tasks", f"with {TASK_SQL} select experiment_id, name from st where is_blocked", ("tasks",))
def blocked_tasks(v):
    return TK.blocked(v.tasks).select("experiment_id", "name")


@query("missing_dependencies", f"with {TASK_SQL} select experiment_id, name, d as dependency from dep where ds is null", ("tasks",))
def missing_dependencies(v):
    return TK.missing_dependencies(v.tasks).select("experiment_id", "name", "dependency")


@query("next_task", f"with {TASK_SQL} select experiment_id, arg_min(name, (priority, name)) as name, min(priority) as priority from st where is_runnable group by 1", ("tasks",))
def next_task(v):
    return TK.next_task(v.tasks)


@query("task_progress", "select experiment_id, status, count(*) as n from tasks group by 1, 2", ("tasks",))
def task_progress(v):
    return TK.progress(v.tasks)


@query("bootup_context", """
with l as (select experiment_id, coalesce(string_agg(name, ', ' order by ord) filter (status = 'pending'), '') as pending, coalesce(string_agg(name, ', ' order by ord) filter (status = 'failing'), '') as failing,
  coalesce(string_agg(name, ', ' order by ord) filter (status = 'passing'), '') as passing, arg_min(name, ord) filter (status = 'pending') as first_pending from tasks group by 1),
e as (select exp_id as experiment_id, arg_max(analysis, (ts, event_id)) as last_analysis from event_log where status != 'P' group by 1)
select experiment_id, pending, failing, passing, last_analysis, case when failing != '' then 'Fix failing tasks first: ' || failing when pending != '' then 'Next task: ' || first_pending else 'All tasks complete!' end as recommendation
from l left join e using (experiment_id)""", ("tasks", "event_log"))
def bootup_context(v):
    events = v.event_log.select(F.col("exp_id").alias("experiment_id"), "event_id", "ts", "analysis",
                                F.when(F.col("status") != "P", "analysis").otherwise("note").alias("type"))
    out = TK.bootup(v.tasks, events)
    return out.select("experiment_id", *[F.array_join(c, ", ").alias(c) for c in ("pending", "failing", "passing")], "last_analysis", "recommendation")


# -- validation ---------------------------------------------------------------

@query("schema_validate", """
with x as (select o_orderkey as id, case when o_orderkey % 9 = 0 then 'abc' else cast(o_custkey as varchar) end as reads, case when o_orderkey % 5 = 0 then null else o_orderpriority end as name,
  o_orderstatus as status, case when o_orderkey % 4 = 0 then 'extra' end as note from orders)
select id, concat_ws('; ', case when try_cast(reads as bigint) is null then 'Field ''reads'' has wrong type: expected int' end,
    case when try_cast(reads as bigint) < 10 then 'Field ''reads'' value below min 10' end, case when try_cast(reads as bigint) > 1400 then 'Field ''reads'' value above max 1400' end,
    case when name is null then 'Required field ''name'' is missing' end, case when length(name) > 8 then 'Field ''name'' length above max 8' end,
    case when not regexp_matches(name, '^[1-4]-') then 'Field ''name'' does not match pattern' end,
    case when status not in ('F', 'O') then 'Field ''status'' has invalid value: ' || status end) as errors, case when note is not null then 'Unknown field: note' else '' end as warnings from x""")
def schema_validate(v):
    k = F.col("o_orderkey")
    rows = v.table("orders").select(
        k.alias("id"), F.when(k % 9 == 0, "abc").otherwise(F.col("o_custkey").cast("string")).alias("reads"),
        F.when(k % 5 != 0, F.col("o_orderpriority")).alias("name"), F.col("o_orderstatus").alias("status"), F.when(k % 4 == 0, "extra").alias("note"),
    )
    schema = {
        "reads": {"type": "int", "min": 10, "max": 1400},
        "name": {"type": "str", "required": True, "max_length": 8, "pattern": "[1-4]-"},
        "status": {"choices": ["F", "O"]},
    }
    out = X.schema_validate(rows, ["id"], schema)
    return out.select("id", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


# -- documents ----------------------------------------------------------------

@query("extract_blocks", """
with p as (select page_id, unnest(parts) as piece, generate_subscripts(parts, 1) - 1 as i, parts from (select page_id, string_split(html, '<p>') as parts from pages))
select page_id, i as ordinal, 1 + list_sum(list_transform(parts[1:i], lambda x: length(x) - length(replace(x, chr(10), '')))) as line_number,
  md5(trim(string_split(piece, '</p>')[1])) as content_md5 from p where i > 0 and contains(piece, '</p>')""")
def extract_blocks(v):
    """Paragraph blocks of whole pages; the LaTeX environments use the same operator."""
    out = D.blocks_between(v.texts("pages", "page_id"), ["page_id"], "html", "<p>", "</p>", "p")
    return out.select("page_id", "ordinal", F.col("line_number"), F.md5("content").alias("content_md5"))


@query("extract_captions", """
select page_id, coalesce(nullif(regexp_extract(html, '<title>(.*?)</title>', 1), ''), 'No caption') as caption, nullif(regexp_extract(html, 'lang="(.*?)"', 1), '') as label,
  len(regexp_extract_all(html, '<h1>.*?</h1>')) as headings from pages""")
def extract_captions(v):
    html = F.col("html")
    return v.texts("pages", "page_id").select(
        "page_id",
        F.coalesce(F.nullif(F.regexp_extract(html, "<title>(.*?)</title>", 1), F.lit("")), F.lit("No caption")).alias("caption"),
        F.nullif(F.regexp_extract(html, 'lang="(.*?)"', 1), F.lit("")).alias("label"),
        F.size(F.regexp_extract_all(html, F.lit("<h1>.*?</h1>"), F.lit(0))).alias("headings"),
    )


PAGE_KINDS = {"head": ("<head>", "</head>"), "article": ("<article>", "</article>"), "p": ("<p>", "</p>"), "li": ("<li>", "</li>"), "h1": ("<h1>", "</h1>")}
# Before each block of a kind lie the pieces between blocks and the blocks before it.
PAGE_BLOCKS_SQL = "b as (" + " union all ".join(f"""
  select page_id, '{kind}' as kind, i as ordinal, html, inner_[i] as content, whole[i] as block,
    array_to_string(list_transform(range(1, i + 1), lambda j: gaps[j] || case when j < i then whole[j] else '' end), '') as head
  from (select page_id, html, unnest(range(1, len(whole) + 1)) as i, whole, inner_, gaps from (select page_id, html, regexp_extract_all(html, '(?s){o}.*?{c}') as whole,
    regexp_extract_all(html, '(?s){o}(.*?){c}', 1) as inner_, regexp_split_to_array(html, '(?s){o}.*?{c}') as gaps from pages))""" for kind, (o, c) in PAGE_KINDS.items()) + ")"


@query("page_environments", f"""with {PAGE_BLOCKS_SQL}
select page_id, kind, ordinal, 1 + length(head) - length(replace(head, chr(10), '')) as line_number, contains(right(head, 200), '<article>') as is_core,
  md5(trim(content, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) as content_md5, md5(right(head, 200)) as before_md5, md5(left(substr(html, length(head) + length(block) + 1), 200)) as after_md5 from b""")
def page_environments(v):
    """Blocks of several kinds, some inside others, from one scan of each page; LaTeX environments use the same operator."""
    out = D.environments(v.texts("pages", "page_id"), ["page_id"], "html", PAGE_KINDS, "<article>")
    return out.select("page_id", "kind", "ordinal", "line_number", "is_core", F.md5("content").alias("content_md5"), F.md5("before").alias("before_md5"), F.md5("after").alias("after_md5"))


@query("page_captions", f"""with {PAGE_BLOCKS_SQL}
select page_id, kind, ordinal, coalesce(nullif(regexp_extract(content, '(?s)<(?:h1|title)>(.*?)</', 1), ''), 'No caption') as caption, nullif(regexp_extract(content, 'charset="(.*?)"', 1), '') as label from b where kind in ('head', 'article', 'li')""")
def page_captions(v):
    """Captions of blocks: headings of articles, titles of heads; list items have none."""
    kinds = {k: PAGE_KINDS[k] for k in ("head", "article", "li")}
    blocks = D.environments(v.texts("pages", "page_id"), ["page_id"], "html", kinds)
    out = D.captions(blocks, "(?s)<(?:h1|title)>(.*?)</", 'charset="(.*?)"')
    return out.select("page_id", "kind", "ordinal", "caption", "label")


@query("symbols", """
select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(' ' || regexp_replace(text, '[^a-zA-Z]+', '  ', 'g') || ' ', ' ([a-zA-Z]) ', 1))), ',') as symbols from documents""")
def symbols(v):
    """Single-letter symbols of every document."""
    plain = F.concat(F.lit(" "), F.regexp_replace("text", "[^a-zA-Z]+", "  "), F.lit(" "))
    return v.texts("documents", "doc_id").select("doc_id", F.array_join(D.symbols(plain), ",").alias("symbols"))


@query("variable_definitions", """
with x as (select doc_id, unnest(regexp_extract_all(regexp_replace(text, ' (est|ist|es|the) ', ' $v_{1}$ is count of ', 'g'), '(\\$[^$]+\\$\\s+(?:represents?|denotes?|is|indicates?)\\s+[^.]+)', 1, 'i')) as hit from documents)
select doc_id, count(*) as definitions, count(distinct trim(regexp_extract(hit, '^\\$([^$]+)\\$', 1))) as symbols from x group by 1""")
def variable_definitions(v):
    """Definitions planted at function words, so that every language holds some."""
    planted = F.regexp_replace("text", " (est|ist|es|the) ", r" \$v_{1}\$ is count of ")
    rows = D.variable_definitions(v.texts("documents", "doc_id").select("doc_id", planted.alias("text")), ["doc_id"])
    return rows.groupBy("doc_id").agg(F.count("*").alias("definitions"), F.count_distinct("symbol").alias("symbols"))


DEFINED = "(?i)\\$[^$]+\\$\\s+(?:represents?|denotes?|is|indicates?)\\s+[^.]+"
UNITS_SQL = "case " + " ".join(f"when regexp_matches(near, '(?i){p}') then '{unit}'" for p, unit in D.UNITS) + " end"


@query("variable_units", f"""
with t as (select doc_id, regexp_replace(text, ' (\\S+) (est|ist|es|the) ', ' $\\1$ is ', 'g') as text from documents),
p as (select doc_id, text, regexp_extract_all(text, '{DEFINED}') as hits, regexp_split_to_array(text, '{DEFINED}') as gaps from t),
h as (select *, unnest(range(1, len(hits) + 1)) as i from p),
c as (select doc_id, i, hits[i] as hit, text, array_to_string(list_transform(range(1, i + 1), lambda j: gaps[j] || case when j < i then hits[j] else '' end), '') as head from h),
n as (select doc_id, i, trim(regexp_extract(hit, '^\\$([^$]+)\\$', 1)) as symbol, trim(regexp_extract(hit, '(?is)^\\$[^$]+\\$\\s+(?:represents?|denotes?|is|indicates?)\\s+(.*)$', 1)) as description,
  right(head, 500) || hit || left(substr(text, length(head) + length(hit) + 1), 500) as near from c)
select doc_id, i - 1 as ordinal, 'var_' || regexp_replace(replace(symbol, '^', '_'), '[^a-zA-Z0-9_]', '', 'g') as var_id, md5(description) as description_md5, {UNITS_SQL} as units,
  case when regexp_matches(lower(description), 'probability|likelihood|posterior') then 'probability' when regexp_matches(lower(description), 'count|number|size') then 'count'
    when regexp_matches(lower(description), 'rate|fraction|ratio') then 'rate' when regexp_matches(lower(description), 'score|quality') then 'score' end as math_type from n""")
def variable_units(v):
    """Words before a function word as symbols: ids, descriptions, types and units by value."""
    marked = F.regexp_replace("text", r" (\S+) (est|ist|es|the) ", r" \$$1\$ is ")
    out = D.variable_definitions(v.texts("documents", "doc_id").select("doc_id", marked.alias("text")), ["doc_id"])
    return out.select("doc_id", "ordinal", "var_id", F.md5("description").alias("description_md5"), "units", "math_type")


USE_SQL = """claimed as (select case when size < 25 then brand else type end as variable, item as "user" from parts union select words[1], item from parts),
actual as (select distinct unnest(case when size > 10 then words else [brand] end) as variable, item as "user" from parts)"""


def usage(v):
    claimed = v.parts.select(F.when(F.col("size") < 25, F.col("brand")).otherwise(F.col("type")).alias("variable"), F.col("item").alias("user")).union(
        v.parts.select(F.col("words")[0], "item")
    )
    held = F.when(F.col("size") > 10, F.col("words")).otherwise(F.array("brand"))
    actual = v.parts.select(F.explode(held).alias("variable"), F.col("item").alias("user"))
    return claimed, actual


@query("usage_mismatch", f"""with {USE_SQL} select coalesce(c.variable, a.variable) as variable, coalesce(c."user", a."user") as "user", case when c.variable is null then 'missing' else 'extra' end as problem
from claimed c full join actual a on c.variable = a.variable and c."user" = a."user" where c.variable is null or a.variable is null""", ("parts",))
def usage_mismatch(v):
    return D.usage_mismatch(*usage(v))


@query("orphans", f"with {USE_SQL} select distinct variable from claimed where variable not in (select variable from actual)", ("parts",))
def orphans(v):
    claimed, actual = usage(v)
    return D.orphans(claimed, actual)


@query("undefined_variables", f"with {USE_SQL} select distinct variable from actual where variable not in (select variable from claimed)", ("parts",))
def undefined_variables(v):
    claimed, actual = usage(v)
    return D.undefined(claimed, actual)


@query("where_used", f"""with {USE_SQL}, i as (select distinct variable from claimed) select i.variable, a."user" from i left join actual a using (variable)""", ("parts",))
def where_used(v):
    claimed, actual = usage(v)
    return D.where_used(claimed, actual)


@query("dangling_refs", "select distinct item, r as reference from (select item, unnest(refs) as r from parts) where r not in (select item from parts)", ("parts",))
def dangling_refs(v):
    return D.dangling_references(v.parts, "item", "refs")


@query("isolated_nodes", "select item from parts where len(refs) = 0 and item not in (select unnest(refs) from parts)", ("parts",))
def isolated_nodes(v):
    return D.isolated(v.parts, "item", "refs")


@query("category_share", "select coalesce(case when size > 5 then type end, 'unknown') as type, count(*) as n, round(count(*) * 100.0 / (select count(*) from parts), 6) as pct from parts group by 1", ("parts",))
def category_share(v):
    items = v.parts.withColumn("type", F.when(F.col("size") > 5, F.col("type")))
    return rounded(D.category_share(items, "type"), "pct")


@query("key_union", """select distinct k from (select unnest(words) as k from parts union all select type from parts)""", ("parts",))
def key_union(v):
    """Union of map keys over all rows."""
    kv = F.map_concat(
        F.map_from_entries(F.transform(F.array_distinct("words"), lambda w: F.struct(w, F.lit(1)))),
        F.create_map("type", F.lit(1)),
    )
    return v.parts.select(F.explode(F.map_keys(kv)).alias("k")).distinct()


# -- streaming ----------------------------------------------------------------

def _drain(v, name, build, mode):
    """Run a stream over the events table to its end and return what it wrote."""
    base = f"{checkpoint_root(v.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = v.table("events").schema
    raw = monitor.read_stream(v.spark, v.sf_dir, schema, pathGlobFilter="events.parquet")
    rows = raw.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("end_reason"),
        F.ceil(F.col("value") * 100).cast("bigint").alias("length"),
        (F.col("event_id") % 30).cast("double").alias("qscore"), (F.col("event_id") % 3 != 0).alias("passes"),
    )
    out = f"{base}/out"

    def sink(df, batch):
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}" if mode == "append" else out)

    monitor.start(build(rows), sink, f"{base}/checkpoint", mode, refresh=None).awaitTermination()
    return v.spark.read.parquet(out)


@query("stream_statistics", """
with n as (select end_reason, max(length) as n50 from (select end_reason, length, sum(length) over (partition by end_reason order by length desc) as c, sum(length) over (partition by end_reason) as t from stream_reads) where c >= t * 0.5 group by 1)
select end_reason, count(*) as total_reads, cast(sum(length) as bigint) as total_bases, count(*) filter (passes) as passed_reads, count(*) filter (not passes) as failed_reads, min(length) as min_length, max(length) as max_length,
  round(-10 * log10(avg(pow(10, -qscore / 10))), 6) as mean_qscore, any_value(n50) as n50 from stream_reads join n using (end_reason) group by 1""", ("stream_reads",))
def stream_statistics(v):
    state = _drain(v, "stream-statistics", lambda rows: monitor.length_state(rows, ["end_reason"]), "complete")
    return rounded(monitor.statistics_from_state(state, ["end_reason"]), "mean_qscore")


@query("stream_running_series", """
with b as (select end_reason, time_bucket(interval 5 minute, ts) as bucket, count(*) as n, cast(sum(length) as bigint) as bases, -10 * log10(avg(pow(10, -qscore / 10))) as q from stream_reads group by 1, 2)
select end_reason, strftime(bucket, '%Y-%m-%d %H:%M') as bucket, n, bases, cast(sum(n) over w as bigint) as cumulative_reads, cast(sum(bases) over w as bigint) as cumulative_bases, round(q, 6) as mean_qscore
from b where bucket + interval 5 minute <= (select max(ts) from stream_reads) - interval 1 hour window w as (partition by end_reason order by bucket)""", ("stream_reads",))
def stream_running_series(v):
    """Append mode: the buckets that were finished an hour before the last row, totals carried in keyed state."""
    out = _drain(v, "running-series", lambda rows: monitor.running_series(rows, ["end_reason"], late="1 hour"), "append").drop("batch")
    return rounded(out.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm")), "mean_qscore")


@query("stream_series", """
with b as (select end_reason, time_bucket(interval 5 minute, ts) as bucket, count(*) as n, cast(sum(length) as bigint) as bases, -10 * log10(avg(pow(10, -qscore / 10))) as q from stream_reads group by 1, 2)
select end_reason, strftime(bucket, '%Y-%m-%d %H:%M') as bucket, n, bases, cast(sum(n) over w as bigint) as cumulative_reads, cast(sum(bases) over w as bigint) as cumulative_bases, round(q, 6) as mean_qscore
from b window w as (partition by end_reason order by bucket)""", ("stream_reads",))
def stream_series(v):
    buckets = _drain(v, "stream-series", lambda rows: monitor.bucket_series(rows, ["end_reason"]), "complete")
    out = monitor.cumulative(buckets, ["end_reason"])
    return rounded(out.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm")), "mean_qscore")
