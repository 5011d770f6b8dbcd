"""Query op12_near_vectors: operator 12 over all embeddings."""

from pyspark.sql import DataFrame, SparkSession

from perilune.llm.common import table
from perilune.llm.multi_index import near_duplicates


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
with recursive v as (
  select row_number() over () as r, vec_id, label, [x::double for x in embedding] as e from embeddings
  where vec_id is not null and label is not null and embedding is not null and len([1 for x in embedding if x is null or not isfinite(x)]) = 0
    and len([1 for x in embedding if x <> 0]) > 0),
links as (select a.r, b.r as other from v a join v b on a.label = b.label and a.r <> b.r where list_cosine_similarity(a.e, b.e) >= 0.93),
reached as (select r, vec_id as c from v union select other, c from reached join links using (r)),
found as (
  select vec_id, (select count(*) from links where links.r = v.r) as n_links, (select min(c) from reached where reached.r = v.r) as component_id from v
  union all
  select vec_id, 0, vec_id from embeddings
  where vec_id is null or label is null or embedding is null or len([1 for x in embedding if x is null or not isfinite(x)]) > 0 or len([1 for x in embedding if x <> 0]) = 0)
select vec_id, n_links::bigint as n_links, component_id, vec_id is not distinct from component_id as kept from found
"""
