"""Sequence queries: strings, identifiers, matching, distances, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from runqc.functions import phred
from runqc.functions import sequence as sq
from runqc.operators import align as A
from runqc.operators import reads as R
from runqc.operators.joins import balanced
from runqc.plans.catalog import query
from runqc.plans.q_reads import r, rounded

PREFIX, ADAPTER, FRONT, REAR = "CCTGTACTTCG", "TTCAGTTACGTATTGCT", "AAGGTTAA", "CAGCACCT"
RC = "translate(reverse({}), 'ACGTacgt', 'TGCAtgca')"


@query("reverse_complement", f"select read_id, {RC.format('seq')} as rc from sentences", ("sentences",))
def reverse_complement(v):
    return v.sentences.select("read_id", sq.reverse_complement("seq").alias("rc"))


@query("core_sequence", "select doc_id, regexp_replace(text, '[^A-Z]', '', 'g') as core from documents")
def core_sequence(v):
    return v.texts("documents", "doc_id").select("doc_id", sq.core("text").alias("core"))


@query("build_reference", f"""
select b.experiment, b.barcode, t.target_id, '{PREFIX}{ADAPTER}{FRONT}' || upper(b.barcode) || '{REAR}' || t.target_seq as reference,
  length('{PREFIX}{ADAPTER}{FRONT}' || upper(b.barcode) || '{REAR}' || t.target_seq) as product_size,
  2 * length('{PREFIX}{ADAPTER}{FRONT}' || upper(b.barcode) || '{REAR}' || t.target_seq) as chimera_size
from barcode_map b join targets t on t.target_id = b.target""", ("targets", "barcode_map"))
def build_reference(v):
    parts = [F.lit(PREFIX), F.lit(ADAPTER), F.lit(FRONT), F.upper("barcode"), F.lit(REAR), F.col("target_seq")]
    joined = v.barcode_map.join(v.targets, F.col("target") == F.col("target_id"))
    return joined.select(
        "experiment", "barcode", "target_id", sq.assemble(*parts).alias("reference"),
        F.length(sq.assemble(*parts)).alias("product_size"), sq.chimera_length(*parts).alias("chimera_size"),
    )


@query("reference_sets", f"""
select experiment, barcode, target_id, strand, '{PREFIX}{ADAPTER}{FRONT}' || upper(barcode) || '{REAR}' ||
  case strand when 'forward' then target_seq else {RC.format('target_seq')} end as reference
from barcode_map join targets on target_id = target cross join (select unnest(['forward', 'reverse']) as strand)""", ("targets", "barcode_map"))
def reference_sets(v):
    codes = v.barcode_map.withColumn("barcode_seq", F.upper("barcode"))
    out = A.reference_sets(codes, v.targets.select("target_id", "target_seq"), PREFIX, ADAPTER, FRONT, REAR)
    return out.select("experiment", "barcode", "target_id", "strand", "reference")


@query("unique_read_id", """
select read_id, cast(exp_id as varchar) || case when exp_id % 4 = 0 then 'x' else substring('shf', cast(exp_id % 3 + 1 as int), 1) end || '520t' ||
  cast(channel % 2 as varchar) || 'm' || cast(exp_id % 5 as varchar) || '_' || substring(sha256(read_id), 1, 8) as uniq_id from reads""", ("reads",))
def unique_read_id(v):
    k = F.col("exp_id")
    tier = F.when(k % 4 != 0, F.substring(F.lit("shf"), (k % 3 + 1).cast("int"), F.lit(1)))
    uid = sq.unique_read_id(k, tier, F.lit("5.2.0"), F.col("channel") % 2, k % 5, F.col("read_id"))
    return v.reads.select("read_id", uid.alias("uniq_id"))


@query("model_from_rg", """
with x as (select o_orderkey, md5(cast(o_orderkey as varchar)) || '_dna_r10.4.1_e8.2_400bps' || ['_sup@v5.2.0', '_hac@v4.3.0', '_fast@v4', '_none', '_hac@v4.1_sup@v5.0'][o_orderkey % 5 + 1] || '_barcode07' as rg from orders)
select o_orderkey, case when regexp_matches(rg, '_sup@v[\\d.]+') then 's' when regexp_matches(rg, '_hac@v[\\d.]+') then 'h' when regexp_matches(rg, '_fast@v[\\d.]+') then 'f' end as tier,
  case when regexp_matches(rg, '_sup@v[\\d.]+') then regexp_extract(rg, '_sup@v([\\d.]+)', 1) when regexp_matches(rg, '_hac@v[\\d.]+') then regexp_extract(rg, '_hac@v([\\d.]+)', 1)
    when regexp_matches(rg, '_fast@v[\\d.]+') then regexp_extract(rg, '_fast@v([\\d.]+)', 1) end as version from x""")
def model_from_rg(v):
    k = F.col("o_orderkey")
    names = F.array(*[F.lit(x) for x in ("_sup@v5.2.0", "_hac@v4.3.0", "_fast@v4", "_none", "_hac@v4.1_sup@v5.0")])
    rg = F.concat(F.md5(k.cast("string")), F.lit("_dna_r10.4.1_e8.2_400bps"), F.element_at(names, (k % 5 + 1).cast("int")), F.lit("_barcode07"))
    rows = v.table("orders").select("o_orderkey", rg.alias("rg"))
    return rows.select("o_orderkey", sq.model_tier("rg").alias("tier"), sq.model_version("rg").alias("version"))


MOD_NAMES = ["non", "6mA", "6mA+5mCG_5hmCG", "5mC_5hmC", "6mA + 5mC", "4mC_5mC+other"]


@query("mod_bitflag", f"""select o_orderkey, [0, 1, 3, 4, 17, 8][o_orderkey % 6 + 1] as bitflag from orders""")
def mod_bitflag(v):
    mods = F.element_at(F.array(*[F.lit(m) for m in MOD_NAMES]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return v.table("orders").select("o_orderkey", sq.mod_bitflag(mods).alias("bitflag"))


@query("filename_fields", """
select o_orderkey, case when o_orderkey % 2 = 0 then 'E' || cast(o_custkey as varchar) || '_x' else 'FBD' || cast(o_custkey as varchar) end as exp_id,
  case when o_orderkey % 2 = 0 then 's' end as model_tier, case when o_orderkey % 2 = 0 then '5.2.0' end as model_ver,
  case when o_orderkey % 2 = 0 then cast(o_orderkey % 10 as int) end as trim, case when o_orderkey % 2 = 0 then 3 else 0 end as mod_bitflag from orders""")
def filename_fields(v):
    k = F.col("o_orderkey")
    c = F.col("o_custkey").cast("string")
    name = F.when(k % 2 == 0, F.concat(F.lit("E"), c, F.lit("_x_s_v5.2.0_"), (k % 10).cast("string"), F.lit("_6mA+5mCG_5hmCG.bam"))).otherwise(
        F.concat(F.lit("FBD"), c, F.lit("_pass_V04_2_2_34fa833d_5920c4dc_0.bam"))
    )
    return v.table("orders").select("o_orderkey", *sq.filename_fields(name))


# -- size and range joins -----------------------------------------------------

@query("size_class", """
select s.read_id, s.length, t.target_id, case when s.length < range_min then 'short' when s.length > range_max then 'long' else 'in_range' end as size_class
from sentences s join barcode_map b using (experiment, barcode) join targets t on t.target_id = b.target""", ("sentences", "targets", "barcode_map"))
def size_class(v):
    ranges = v.barcode_map.join(v.targets, F.col("target") == F.col("target_id")).select(
        "experiment", "barcode", "target_id", "range_min", "range_max"
    )
    tagged = v.sentences.join(ranges, ["experiment", "barcode"])
    return tagged.select("read_id", "length", "target_id", sq.size_class("length", "range_min", "range_max").alias("size_class"))


@query("range_match_first", """
select read_id, length, (select arg_min(target_id, ord) from targets where length between range_min and range_max) as target_id from sentences""", ("sentences", "targets"))
def range_match_first(v):
    return A.first_range_match(v.sentences.select("read_id", "length"), v.targets)


@query("size_candidates", """
with u as (select distinct experiment, target as target_id from barcode_map)
select read_id, t.target_id from sentences s join u using (experiment) join targets t on t.target_id = u.target_id and s.length between t.range_min and t.range_max""", ("sentences", "targets", "barcode_map"))
def size_candidates(v):
    pool = A.experiment_targets(v.barcode_map, v.targets.select("target_id", "range_min", "range_max"))
    return A.size_candidates(v.sentences.select("read_id", "experiment", "length"), pool).select("read_id", "target_id")


# -- distances ----------------------------------------------------------------

def expected_pairs(v):
    expected = v.barcode_map.join(v.targets, F.col("target") == F.col("target_id")).select(
        "experiment", "barcode", "target_id", "target_seq"
    )
    return v.sentences.join(expected, ["experiment", "barcode"])


PAIR_SQL = "pairs as (select s.*, t.target_id, t.target_seq from sentences s join barcode_map b using (experiment, barcode) join targets t on t.target_id = b.target)"
PAIR_VIEWS = ("sentences", "targets", "barcode_map")


@query("edit_distance", f"with {PAIR_SQL} select read_id, target_id, levenshtein(seq, target_seq) as edit_distance from pairs", PAIR_VIEWS)
def edit_distance(v):
    return expected_pairs(v).select("read_id", "target_id", F.levenshtein("seq", "target_seq").cast("bigint").alias("edit_distance"))


@query("edit_distance_k", f"""with {PAIR_SQL} select read_id, target_id, case when levenshtein(seq, target_seq) <= 12 then levenshtein(seq, target_seq) else -1 end as edit_distance from pairs""", PAIR_VIEWS)
def edit_distance_k(v):
    return expected_pairs(v).select("read_id", "target_id", A.edit_distance("seq", "target_seq", 12).cast("bigint").alias("edit_distance"))


@query("edit_normalised", f"""with {PAIR_SQL}, d as (select *, case when levenshtein(seq, target_seq) <= 40 then levenshtein(seq, target_seq) else -1 end as ed from pairs)
select read_id, target_id, case when ed >= 0 then round(ed::double / greatest(length(seq), length(target_seq)), 9) end as normalised from d""", PAIR_VIEWS)
def edit_normalised(v):
    d = A.edit_distance("seq", "target_seq", 40)
    return expected_pairs(v).select("read_id", "target_id", r(A.normalised_distance(d, "seq", "target_seq"), 9).alias("normalised"))


@query("edit_matrix", """
select read_id, levenshtein(seq, 'ATGGAC') as "AFRICA", levenshtein(seq, 'AAACGCA') as "AMERICA", levenshtein(seq, 'ACAA') as "ASIA",
  levenshtein(seq, 'AAGCGA') as "EUROPE", levenshtein(seq, 'AATTCAAACG') as "MIDDLE EAST" from sentences"""
       .replace("'ATGGAC'", "(select d from rg where r_name = 'AFRICA')").replace("'AAACGCA'", "(select d from rg where r_name = 'AMERICA')")
       .replace("'ACAA'", "(select d from rg where r_name = 'ASIA')").replace("'AAGCGA'", "(select d from rg where r_name = 'EUROPE')")
       .replace("'AATTCAAACG'", "(select d from rg where r_name = 'MIDDLE EAST')")
       .replace("select read_id", "with rg as (select r_name, translate(lower(regexp_replace(r_name, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') as d from region)\nselect read_id", 1),
       ("sentences",))
def edit_matrix(v):
    """Reads against the five region names: a matrix has one column per reference."""
    from runqc.plans.views import _dna

    refs = v.table("region").select("r_name", _dna(F.col("r_name")).alias("ref_seq")).orderBy("r_name").collect()  # five by definition
    out = A.distance_columns(v.sentences.select("read_id", "seq"), {ref.r_name: ref.ref_seq for ref in refs})
    return out.drop("seq")


CONV_SQL = """c as (select conv_id, role, row_number() over (partition by conv_id, role order by turn) as k,
  translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') as s from conversations)"""


@query("edit_pairwise", f"""with {CONV_SQL} select a.conv_id, a.k, levenshtein(a.s, b.s) as edit_distance from c a join c b on a.conv_id = b.conv_id and a.k = b.k and a.role = 'user' and b.role = 'assistant'""")
def edit_pairwise(v):
    """n-th question against n-th answer of each conversation (positional pairing)."""
    from pyspark.sql import Window

    from runqc.plans.views import _dna

    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    c = v.texts("conversations", "conv_id").select("conv_id", "role", F.row_number().over(w).alias("k"), _dna(F.col("text")).alias("s"))
    a = c.where(F.col("role") == "user").select("conv_id", "k", F.col("s").alias("a"))
    b = c.where(F.col("role") == "assistant").select("conv_id", "k", F.col("s").alias("b"))
    return a.join(b, ["conv_id", "k"]).select("conv_id", "k", F.levenshtein("a", "b").cast("bigint").alias("edit_distance"))


@query("similarity_join", """
with u as (select distinct seq from sentences)
select seq, target_id as ref_id, levenshtein(seq, target_seq) as edit_distance from u join targets on abs(length(seq) - expected_length) <= 2
where levenshtein(seq, target_seq) <= 2""", ("sentences", "targets"))
def similarity_join(v):
    out = A.similarity_join(v.sentences.select("seq"), v.refs, 2)
    return out.withColumn("edit_distance", F.col("edit_distance").cast("bigint"))


BEST_SQL = """best as (select seq, arg_min(target_id, (d, ord)) as ref_id, min(d) as edit_distance from (
  select seq, target_id, ord, levenshtein(seq, target_seq) as d from (select distinct seq from sentences) cross join targets) group by seq)"""


@query("best_reference", f"with {BEST_SQL} select read_id, ref_id, edit_distance from sentences join best using (seq)", ("sentences", "targets"))
def best_reference(v):
    out = A.best_reference(v.sentences.select("read_id", "seq"), v.refs)
    return out.select("read_id", "ref_id", F.col("edit_distance").cast("bigint").alias("edit_distance"))


@query("matches_by_distance", f"""with {BEST_SQL} select ref_id, count(*) as n, count(*) filter (edit_distance = 0) as perfect_reads, round(avg(edit_distance), 6) as mean_distance
from sentences join best using (seq) group by 1""", ("sentences", "targets"))
def matches_by_distance(v):
    out = A.best_reference(v.sentences.select("seq"), v.refs)
    return out.groupBy("ref_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("edit_distance") == 0).alias("perfect_reads"),
        r(F.avg("edit_distance")).alias("mean_distance"),
    )


@query("sma_exact", f"""with {BEST_SQL} select ref_id, count(*) as n, round(avg((edit_distance = 0)::int), 9) as sma_exact from sentences join best using (seq) group by 1""", ("sentences", "targets"))
def sma_exact(v):
    hits = A.best_reference(v.sentences.select("seq"), v.refs).join(v.refs.select("ref_id", "ref_seq"), "ref_id")
    return rounded(R.exact_accuracy(hits, ["ref_id"]), "sma_exact", places=9)


@query("classify_reads", """
with u as (select distinct experiment, target as target_id from barcode_map),
s as (select read_id, experiment, barcode, seq, length, b.target as expected from sentences left join barcode_map b using (experiment, barcode)),
c as (select read_id, t.target_id, levenshtein(s.seq, t.target_seq) as d, t.expected_length as len
  from s join u using (experiment) join targets t on t.target_id = u.target_id and s.length between t.range_min and t.range_max
  where expected is not null and length between 80 and 200),
k as (select *, row_number() over (partition by read_id order by d, len, target_id) as rn, count(*) over (partition by read_id) as nc from c),
w as (select read_id, any_value(nc) as nc, max(target_id) filter (rn = 1) as t1, max(d) filter (rn = 1) as d1, max(d) filter (rn = 2) as d2,
  concat_ws(',', max(target_id) filter (rn = 1), max(target_id) filter (rn = 2), max(target_id) filter (rn = 3)) as top from k group by 1)
select read_id, case when expected is null then 'unknown_barcode' when length < 80 or length > 200 then 'filtered' when nc is null then 'no_size_match' when nc = 1 then 'size' else 'edit_distance' end as method,
  t1 as target_id, d1 as edit_distance, case when nc is not null then expected end as expected_target,
  case when nc = 1 then case when t1 = expected then 'high' else 'mismatch' end when nc > 1 then case when d1 < d2 * 0.8 then 'high' when d1 < d2 then 'medium' else 'low' end end as confidence,
  case when nc > 1 then top end as candidates from s left join w using (read_id)""", PAIR_VIEWS)
def classify_reads(v):
    out = A.classify_reads(v.sentences.drop("length"), v.barcode_map, v.targets)
    return out.select(
        "read_id", "method", "target_id", F.col("edit_distance").cast("bigint").alias("edit_distance"), "expected_target", "confidence",
        F.array_join("candidates", ",").alias("candidates"),
    )


QUAL_SQL = "-10 * log10(list_sum(list_transform(string_split(qual, ''), lambda c: pow(10, -(ascii(c) - 33) / 10.0))) / length(qual))"


@query("ingest_reads", f"""
with m as (select *, (select arg_min(target_id, ord) from targets t where s.length between range_min and range_max) as target_id from sentences s),
e as (select doc_id, case quality when 1 then 'signal_positive' else 'unblock_mux_change' end as er, toxic as forced from labels)
select 'EXP' || experiment || 's520t1m3_' || substring(sha256(read_id), 1, 8) as uniq_id, experiment as exp_id, target_id as refseq_id, read_id, m.length as readlen,
  levenshtein(seq, target_seq) as ed, round({QUAL_SQL}, 6) as q_bc,
  case when target_id is not null then round(-10 * log10(least(greatest(1.0::double / (expected_length * expected_length), levenshtein(seq, target_seq)::double / expected_length), 1.0)), 6) end as q_ld, er, forced
from m left join targets using (target_id) left join e using (doc_id)""", ("sentences", "targets"))
def ingest_reads(v):
    labels = v.table("labels").select(
        "doc_id", F.when(F.col("quality") == 1, "signal_positive").otherwise("unblock_mux_change").alias("end_reason"),
        F.col("toxic").alias("forced"),
    )
    side = v.sentences.select("read_id", "doc_id").join(labels, "doc_id")
    rows = A.ingest_reads(
        v.sentences.withColumn("exp", F.concat(F.lit("EXP"), "experiment")), v.targets, side, F.col("experiment"),
        F.lit("s"), F.lit("5.2.0"), F.lit(1), F.lit(3),
    )
    return rounded(rows, "q_bc", "q_ld").select(
        F.concat(F.lit("EXP"), "uniq_id").alias("uniq_id"), "exp_id", "refseq_id", "read_id", F.col("readlen"),
        F.col("ed").cast("bigint").alias("ed"), "q_bc", "q_ld", F.col("ER").alias("er"), "forced",
    )


@query("warehouse_summary", f"""
with m as (select *, (select arg_min(target_id, ord) from targets t where s.length between range_min and range_max) as target_id from sentences s),
w as (select experiment, target_id, m.length as readlen, levenshtein(seq, target_seq) as ed, {QUAL_SQL} as q_bc,
  case when target_id is not null then -10 * log10(least(greatest(1.0::double / (expected_length * expected_length), levenshtein(seq, target_seq)::double / expected_length), 1.0)) end as q_ld from m left join targets using (target_id))
select experiment as exp_id, count(*) as total_reads, count(target_id) as matched_reads, round(avg(readlen), 6) as avg_readlen, round(avg(q_bc), 6) as avg_q_bc,
  round(avg(q_ld), 6) as avg_q_ld, round(avg(ed), 6) as avg_ed from w group by 1""", ("sentences", "targets"))
def warehouse_summary(v):
    side = v.table("labels").select(F.col("doc_id").cast("string").alias("read_id"), F.lit("x").alias("end_reason"), F.lit(0).alias("forced"))
    rows = A.ingest_reads(v.sentences, v.targets, side, F.col("experiment"), F.lit("s"), F.lit("5.2.0"), F.lit(1), F.lit(3))
    return rounded(R.warehouse_summary(rows, ["exp_id"]), "avg_readlen", "avg_q_bc", "avg_q_ld", "avg_ed")


@query("barcode_summary", f"""
with {PAIR_SQL}, x as (select p.barcode, p.length, levenshtein(seq, p.target_seq) as ed, {QUAL_SQL} as q, p.length between range_min and range_max as ok, p.length < range_min as short, p.length > range_max as long,
  p.doc_id % 3 = 0 as sp from pairs p join targets t using (target_id))
select barcode, count(*) as n, round(avg(ok::int) * 100, 6) as in_range_pct, count(*) filter (short) as short, count(*) filter (long) as long, round(avg(ed), 6) as mean_ed,
  round(avg((ed < 20)::int) * 100, 6) as ed_lt20_pct, round(avg((ed < 30)::int) * 100, 6) as ed_lt30_pct, round(avg((ed < 50)::int) * 100, 6) as ed_lt50_pct,
  round(avg((q >= 10)::int) * 100, 6) as q10_pct, round(avg(sp::int) * 100, 6) as signal_positive_pct, median(length) as median_length, median(ed) as median_ed, round(median(q), 6) as median_qscore
from x group by barcode""", PAIR_VIEWS)
def barcode_summary(v):
    ranges = v.targets.select("target_id", "range_min", "range_max")
    tagged = expected_pairs(v).join(ranges, "target_id").select(
        "barcode", "length", F.levenshtein("seq", "target_seq").alias("ed"), phred.string_mean_q("qual").alias("qscore"),
        sq.size_class("length", "range_min", "range_max").alias("size_class"),
        F.when(F.col("doc_id") % 3 == 0, "signal_positive").otherwise("unknown").alias("end_reason"),
    )
    out = A.barcode_summary(tagged)
    return rounded(out, *[c for c in out.columns if c.endswith("_pct") or c in ("mean_ed", "median_qscore")])


# -- kernels ------------------------------------------------------------------

@query("infix_distance")
def infix_distance(v):
    """Expected target of each read located inside it, ends free."""
    p = expected_pairs(v)
    return p.select("read_id", "target_id", A.locate_udf("HW")("target_seq", "seq").alias("x")).select("read_id", "target_id", "x.*")


@query("ratio_distance")
def ratio_distance(v):
    return expected_pairs(v).withColumn("edit_distance", A.ratio_distance("seq", "target_seq")).select("read_id", "target_id", "edit_distance")


@query("alignment_path", f"with {PAIR_SQL} select read_id, target_id, levenshtein(seq, target_seq) as edits, length(seq) as query_bases, length(target_seq) as target_bases from pairs", PAIR_VIEWS)
def alignment_path(v):
    """Totals of the extended CIGAR of every read against its expected target; the path itself differs among equals."""
    p = expected_pairs(v)
    unique = balanced(p.select("seq", "target_seq").distinct())
    totals = unique.select("seq", "target_seq", A.alignment_totals(A.cigar_udf()("seq", "target_seq", F.levenshtein("seq", "target_seq"))).alias("t"))
    return p.select("read_id", "target_id", "seq", "target_seq").join(totals, ["seq", "target_seq"]).select("read_id", "target_id", "t.*")


@query("demultiplex")
def demultiplex(v):
    """Barcodes are the kit of the run: the short targets of the benchmark, all of them."""
    kit = v.targets.where(F.col("expected_length").between(20, 26)).orderBy("ord").toLocalIterator()
    return A.demultiplex(v.sentences.select("read_id", "seq"), {k["target_id"]: k["target_seq"] for k in kit}, FRONT).drop("seq")


@query("error_profile", f"""
with {BEST_SQL}
select ref_id, max(expected_length) as positions, sum(length) as read_bases, sum(expected_length) as reference_bases, sum(edit_distance) as edits
from sentences join best using (seq) join targets on target_id = ref_id group by 1""", ("sentences", "targets"))
def error_profile(v):
    """What the profile of all positions of a reference adds up to; single positions differ among equal paths."""
    out = A.error_profile(v.sentences.select("read_id", "seq", "qual"), v.refs)
    total = lambda *names: sum(F.sum(f"count_{n}") for n in names)
    return out.groupBy("ref_id").agg(
        F.count("*").alias("positions"), total("correct", "incorrect", "inserted").alias("read_bases"),
        total("correct", "incorrect", "deleted").alias("reference_bases"), total("incorrect", "deleted", "inserted").alias("edits"),
    )
