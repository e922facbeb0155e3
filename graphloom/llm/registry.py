"""The queries that this subpackage registers, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import chat

    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit(r"\### Assistant: </turn> ok")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.expr("if(id = 0, 'user', 'assistant')").alias("role"), said.alias("text"))
    return chat.digests(chat.render(chat.fold(chat.message_log(given.unionByName(more)), dealt=True)))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import ngram_join

    return ngram_join.join(_table(spark, sf_dir, "documents")).drop("class_id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import shards

    return shards.shard(_table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import bpe

    return bpe.token_digests(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import substring_dedup

    return substring_dedup.dedup(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import quality

    return quality.predict(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import toxicity

    return toxicity.predict(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import secrets

    return secrets.find(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import langid

    return langid.predict(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm import decontam

    return decontam.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: op1: the escaped text doubles backslashes and adds one before a tag; each turn has 20 characters of template and its role.
OP1_SQL = r"""
with t as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '\### Assistant: </turn> ok'
    union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), f as (
    select *, regexp_replace(replace(text, '\', '\\'), '<(/?turn)', '\\<\1', 'g') as body, replace(regexp_replace(replace(role, '\', '\\'), '<(/?turn)', '\\<\1', 'g'), '"', '\"') as head from t
)
select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    cast(sum(length(head) + length(body) + length('<turn role="">') + length('</turn>') + 1) as bigint) as formatted_chars
from f group by conv_id
"""

#: op2: all pairs of sets that share a shingle, by their words; the least doc_id over the closure of the links.
OP2_SQL = r"""
with recursive w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
    select distinct doc_id, array_to_string(ws[i : i + 4], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from w where len(ws) > 0)
), n as (select doc_id, count(*) as k from s group by doc_id),
sets as (select doc_id, k, row_number() over (partition by x order by doc_id) as nth, min(doc_id) over (partition by x) as rep from (select doc_id, count(*) as k, md5(string_agg(g, chr(10) order by g)) as x from s group by doc_id)),
r as (select s.doc_id, s.g from s join sets using (doc_id) where nth = 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as x from r a join r b using (g) where a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c.x >= 75 * (x.k + y.k - c.x)),
e as (select a, b from l union all select b, a from l),
t as (select a, b from e union select t.a, e.b from t join e on t.b = e.a),
m as (select a, least(a, min(b)) as root from t group by a)
select w.doc_id, coalesce(sets.k, 0) as n_shingles, coalesce(m.root, sets.rep, w.doc_id) as component_id from w left join sets on w.doc_id = sets.doc_id left join m on m.a = sets.rep
"""

#: op10: every window of every item against every window of every document, by equality of the joined words.
OP10_SQL = r"""
with w as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), b as (
    select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark
), bw as (
    select distinct item, least(len(ws), 10) as n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') as s
    from (select item, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) as i from b where len(ws) > 0)
), dw as (
    select doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') as s
    from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from w, (select distinct n from bw) where len(ws) >= n)
), h as (
    select doc_id, i, n, item from dw join bw using (n, s)
), c as (
    select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from h) group by doc_id
), m as (
    select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from h) group by doc_id
)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join c on w.doc_id = c.doc_id left join m on w.doc_id = m.doc_id
"""


def queries() -> dict:
    all_ = (op1_chat_format, op2_ngram_jaccard_join, op3_sharding, op4_byte_bpe, op5_substring_dedup, op6_quality_rules, op7_toxicity, op8_secret_scan, op9_language_id, op10_decontamination)
    return {f.__name__: f for f in all_}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op2_ngram_jaccard_join": OP2_SQL, "op10_decontamination": OP10_SQL}
