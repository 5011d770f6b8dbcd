"""Query op13_divergence: operator 13 over all documents."""

from pyspark.sql import DataFrame, SparkSession

from perilune.llm.common import table
from perilune.llm.divergence import audit_sources


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


SQL = r"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
w as (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from w group by lang, term having count(distinct r) >= 10),
c as (select lang, source, term, count(*) as n from w join kept using (lang, term) group by lang, source, term),
v as (select lang, count(*) as v from kept group by lang),
g as (
  select lang, source, coalesce(sum(n), 0)::hugeint as total, any_value(coalesce(v, 0))::hugeint as v
  from (select distinct lang, source from d) left join c using (lang, source) left join v using (lang) group by lang, source),
p as (
  select g.lang, g.source, term, coalesce(n, 0) as n, 1 + (1000000000::hugeint * (coalesce(n, 0) + 2)) // (total + 2 * v) as p
  from g join kept using (lang) left join c using (lang, source, term)),
h as (select lang, sum(total)::hugeint as total, any_value(v) as v from g group by lang),
q as (
  select lang, term, 1 + (1000000000::hugeint * (any_value(s.n) + 2)) // (any_value(total) + 2 * any_value(v)) as q
  from (select lang, term, sum(n)::hugeint as n from c group by lang, term) s join h using (lang) group by lang, term),
f as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
terms as (
  select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from p join q using (lang, term) where n > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank::integer as rank from ranked where part = 'pair' or rank <= 10
"""
