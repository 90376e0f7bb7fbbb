"""Queries on ``conversations`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonewheel.llm.chat_collapse import rendered
from tonewheel.llm.hard_negatives import hard_negatives
from tonewheel.llm.registry import load, query
from tonewheel.llm.vector_graph import near_links

CHAT = """
with t as (
  select conv_id, role, text, turn, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as k
  from conversations where conv_id is not null
), s as (
  select conv_id, k, md5(to_json([k::varchar, role, text])) as h,
         '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') as said from t
), p as (
  select conv_id, k, string_agg(h, ',') over (partition by conv_id order by k) as prefix, max(k) over (partition by conv_id) as n from s
), whole as (
  select prefix, min(conv_id) as conv_id, max(k) as turns, count(*) as n_same from p where k = n group by prefix
), kept as (
  select * from whole where prefix not in (select prefix from p where k < n)
)
select kept.conv_id, any_value(turns) as turns, any_value(n_same) as n_same, string_agg(said, chr(10) order by k) as rendered
from kept join s on s.conv_id = kept.conv_id group by kept.conv_id
"""


@query("op9_chat_collapse", CHAT)
def op9_chat_collapse(spark, sf_dir):
    return rendered(load(spark, sf_dir, "conversations"))


@query("op7_vector_graph")
def op7_vector_graph(spark, sf_dir):
    return near_links(load(spark, sf_dir, "embeddings"), least=0.98)


NEGATIVES = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same,
         list_dot_product(a.v, b.v)::bigint as score
  from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
), p as (
  select anchor_id, id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, positive_id,
       row_number() over (partition by p.anchor_id, positive_id order by score desc, id)::integer as rank,
       id as negative_id, positive_score, score as negative_score
from p join s on p.anchor_id = s.anchor_id and not same
  and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, id) <= 10
"""


@query("op13_hard_negatives", NEGATIVES)
def op13_hard_negatives(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)
