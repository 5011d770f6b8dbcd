"""Query op10_topk: operator 10 over all embeddings; queries are the rows whose vec_id is divisible by 20."""

from pyspark.sql import DataFrame, SparkSession

from perilune.llm.common import table
from perilune.llm.topk import nearest, whole_vectors


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(whole_vectors(table(spark, sf_dir, "embeddings")), "vec_id % 20 = 0", k=20)


SQL = """
with v as (select vec_id, [floor(64 * cast(x as double)) for x in embedding] as e from embeddings
  where embedding is not null and len([1 for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
"""
