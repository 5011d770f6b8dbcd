"""Query op3_warc: operator 3's round trip of all pages."""

from pyspark.sql import DataFrame, SparkSession

from perilune.llm.common import table
from perilune.llm.warc import round_trip


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
q as (select page_id, octet_length(encode(html)) as n, sha256(html) as d from p),
r as (select *, min(page_id) over (partition by d) as f, count(*) over (partition by d) as c from q)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
  case when n >= 100 and f <> page_id then 'revisit' else 'response' end as record_type,
  case when n >= 100 and f <> page_id then f end as refers_to, true as intact
from r
"""
