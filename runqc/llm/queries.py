"""The registered queries of this subpackage and, where SQL can say them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from runqc.llm import conversations, decontaminate, hamming, hyperminhash, langid, lines, lm, mixing, negatives, pii, simhash, tokens, toxicity
from runqc.llm.common import documents


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.find_pii(docs, pii.trained_tagger(docs))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(documents(spark, sf_dir))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.stored_digests(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_decisions(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.page_languages(spark.read.parquet(f"{sf_dir}/pages.parquet"), documents(spark, sf_dir))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row's label is moved on by one first."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_copies(documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_and_repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP6_SQL = r"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents
), sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source asc nulls last) as turn from sized group by source
), weighed as (
  select *, case (turn - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w, 3 * source_size::double as cap from sources
), levels as (
  select *, ((select sum(source_size)::double from weighed) - coalesce(sum(cap) over ratio, 0.0::double))
         / ((select sum(w) from weighed) - coalesce(sum(w) over ratio, 0.0::double)) as level
  from weighed window ratio as (order by cap / w, source asc nulls last rows between unbounded preceding and 1 preceding)
), level as (
  select level as l from levels where level <= cap / w order by cap / w, source asc nulls last limit 1
), targets as (
  select source, source_size, least(cap, l * w) as target, ('0x' || substr(md5(coalesce(source, '')), 1, 4))::bigint / 65536.0::double as start
  from weighed, level
), placed as (
  select doc_id, size, source_size, target, start, case when source_size = 0 then 0.0::double else target / source_size end as rate,
         row_number() over (partition by sized.source order by size desc, doc_id) as i
  from sized join targets on sized.source is not distinct from targets.source
)
select doc_id, size, source_size, target,
       cast((floor(start + i * rate) - floor(start + (i - 1) * rate)) * size as bigint) as taken
from placed
"""

OP10_SQL = """
with pairs as (
  select q.vec_id as query_id, n.vec_id as neighbor_id,
         list_sum(list_transform(list_zip(q.embedding, n.embedding), lambda p: cast((p[1] > 0) <> (p[2] > 0) as bigint)))::bigint as distance
  from embeddings q, embeddings n where q.vec_id % 50 = 0
)
select query_id, neighbor_id, distance, row_number() over (partition by query_id order by distance, neighbor_id) as rank
from pairs qualify rank <= 10
"""

OP11_SQL = """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, r.vec_id as other_id, a.label = r.label as same,
         list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2]))::bigint as score
  from rows a join rows r on a.vec_id % 50 = 0 and a.vec_id <> r.vec_id
), positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, other_id) as integer) as rank,
       other_id as negative_id, positive_score, score as negative_score
from positives p join scored n on n.anchor_id = p.anchor_id and not n.same
  and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3
"""

OP12_SQL = r"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents
), shingled as (
  select distinct doc_id, case when len(words) < 5 then array_to_string(words, ' ') else array_to_string(words[i:i + 4], ' ') end as shingle
  from worded, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as t(i) where len(words) > 0
), sizes as materialized (
  select doc_id, count(*) as n from shingled group by doc_id
), linked as materialized (
  select a.doc_id as a, b.doc_id as b
  from shingled a join shingled b on a.shingle = b.shingle and a.doc_id <> b.doc_id
  join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reached as (
  select doc_id, doc_id as other from worded
  union
  select r.doc_id, l.b from reached r join linked l on l.a = r.other
)
select d.doc_id, coalesce(s.n, 0) as n_shingles, min(r.other) as component_id, d.doc_id = min(r.other) as kept
from worded d left join sizes s on s.doc_id = d.doc_id join reached r on r.doc_id = d.doc_id group by d.doc_id, s.n
"""

OP13_SQL = r"""
with recursive crc_table as (
  select list(v order by i) as t from (
    select i, list_reduce([i::ubigint] || range(8)::ubigint[], lambda c, k: case when c & 1 = 1 then xor(3988292384::ubigint, c >> 1) else c >> 1 end) as v from range(256) r(i))
), keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations
), lucky as (
  select k.*, xor(4294967295::ubigint, list_reduce([4294967295::ubigint] || list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::ubigint),
    lambda c, b: xor(t[((xor(c, b) & 255) + 1)::bigint], c >> 8))) % 20 as luck from keyed k, crc_table
), damaged as (
  select conv_id, turn, case when luck = 4 then 'user' else role end as role,
         case when luck = 1 then '' when luck = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from lucky, range(2) copies(n) where luck <> 0 and (n = 0 or luck = 3)
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from damaged
), flagged as (
  select *, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, row_number() over (partition by conv_id, role, text order by i) > 1 as again,
         not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') as open_end, lag(role) over (partition by conv_id order by i) as before from placed
), faults as (
  select conv_id, i, turn, role, text, blank, again and not blank as duplicate, open_end and not blank and not again as truncated,
         before is not null and before[1] || role[1] not in ('su', 'ua', 'au') as illegal, blank or again as must_go, role[1] as kind from flagged
), fills(a, b, cost, audit, said) as (
  values (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
    (0, 2, 5, 'I', chr(10) || 'user:'), (1, 2, 5, 'I', chr(10) || 'user:'), (3, 2, 5, 'I', chr(10) || 'user:'), (2, 3, 5, 'I', chr(10) || 'assistant:'),
    (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')
), ways(letter, price) as (values ('D', 2), ('K', 0), ('R', 1)
), states as (
  select conv_id, 0::bigint as i, 0 as state, {'cost': 0, 'audit': '', 'said': ''} as best from (select distinct conv_id from placed)
  union all
  select conv_id, i, state, min(best) from (
    select f.conv_id, f.i, case when letter = 'D' then b when letter = 'K' and kind = 's' then 1 when b = 2 then 3 else 2 end as state,
           {'cost': s.best.cost + l.cost + price + case when truncated and letter <> 'D' then 5 else 0 end, 'audit': s.best.audit || l.audit || letter,
            'said': s.best.said || l.said || case letter when 'D' then '' when 'K' then chr(10) || role || ':' || text
              else chr(10) || case when b = 2 then 'assistant' else 'user' end || ':' || text end} as best
    from states s join faults f on f.conv_id is not distinct from s.conv_id and f.i = s.i + 1 join fills l on l.a = s.state, ways
    where letter = 'D' or not must_go and (letter = 'R' or kind = 's' and b = 0 or kind = 'u' and b <> 2 or kind = 'a' and b = 2))
  group by conv_id, i, state
), counted as (
  select conv_id, max(i) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate,
         count(*) filter (truncated) as truncated, count(*) filter (illegal) as illegal from faults group by conv_id
), ended as (
  select c.*, (select min({'cost': s.best.cost + l.cost, 'audit': s.best.audit || l.audit, 'said': s.best.said || l.said})
    from states s join fills l on l.a = s.state where s.conv_id is not distinct from c.conv_id and s.i = c.n and l.b in (0, 3)) as best from counted c
)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
       coalesce(best.cost, 0)::bigint as cost, coalesce(best.audit, '') as audit, sha256(coalesce(substr(best.said, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join ended e on e.conv_id is not distinct from o.conv_id
"""

LLM_QUERIES = {
    "op1_pii": op1_pii,
    "op2_simhash": op2_simhash,
    "op3_lm_score": op3_lm_score,
    "op4_token_output": op4_token_output,
    "op5_line_dedup": op5_line_dedup,
    "op6_mixing": op6_mixing,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_top_k": op10_top_k,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_hyperminhash": op12_hyperminhash,
    "op13_conversation_repair": op13_conversation_repair,
    "pipeline": corpus_pipeline.run,
}

LLM_ORACLES = {"op6_mixing": OP6_SQL, "op10_top_k": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_hyperminhash": OP12_SQL, "op13_conversation_repair": OP13_SQL}
