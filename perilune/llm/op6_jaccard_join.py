"""Query op6_jaccard_join: operator 6 over all documents."""

from pyspark.sql import DataFrame, SparkSession

from perilune.llm.common import table
from perilune.llm.jaccard_join import jaccard_components


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) >= 5 then list_distinct([array_to_string(w[i : i + 4], ' ') for i in generate_series(1, len(w) - 4)]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
n as (select doc_id, cast(len(s) as bigint) as n from s),
u as (select doc_id, unnest(s) as t from s),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from u a join u b on a.t = b.t and a.doc_id < b.doc_id group by all),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id, doc_id as m from documents union select r.doc_id, e.y from r join e on e.x = r.m)
select doc_id, n as n_shingles, min(m) as component_id from r join n using (doc_id) group by all
"""
