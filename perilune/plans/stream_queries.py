"""Queries that run streams: tables are fed through micro-batches and restarts, and what the sinks hold is read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perilune.plans.registry import read, register
from perilune.plans.series_queries import _EV, events
from perilune.sources.files import scratch
from perilune.streaming.registry import Sessions, Upserts, session_changes


def fed(rows: DataFrame, part: Column, parts: int, start: Callable) -> None:
    """Rows arrive in `parts` parts, one after the other; each is read by a query of its own, which goes on from the checkpoint of the one before.

    start(stream) -> a DataStreamWriter.
    """
    spark = rows.sparkSession
    folder, state = scratch(spark), scratch(spark)
    for k in range(parts):
        rows.where(part == k).write.mode("append").parquet(folder)
        start(spark.readStream.schema(rows.schema).parquet(folder)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


@register(
    "snapshot_stream",
    f"""
with {_EV},
r as (select user_id, event_type, event_id, v, row_number() over (partition by user_id, event_type order by us desc, event_id desc) as n from ev)
select user_id, event_type, event_id, v from r where n = 1
""",
)
def snapshot_stream(spark: SparkSession, d: str) -> DataFrame:
    """The newest value of each key as a table that a stream keeps: events come in no order of time, epochs are merged on the way."""
    rows = events(spark, d)
    table = Upserts(scratch(spark), "event_id long, user_id long, event_type string, us long, v long", ["user_id", "event_type"], ["us", "event_id"], every=2)
    fed(rows, F.pmod("event_id", F.lit(3)), 3, lambda s: s.writeStream.foreachBatch(table.write))
    return table.read(spark).select("user_id", "event_type", "event_id", "v")


@register(
    "session_stream",
    """
with recursive o as (
  select o_custkey as host, o_orderkey as seq, cast(date_diff('day', date '1990-01-01', cast(o_orderdate as date)) as bigint) as t,
         case when o_orderkey % 3 = 0 then 'stop' else 'create' end as kind, 's' || o_orderkey // 4 % 3 as name, o_orderkey % 97 as period
  from orders),
e as (select *, t + seq % 11 * 50 as start, row_number() over (partition by host order by t, seq) as n from o),
w as (
  select host, cast(0 as bigint) as n, cast([] as struct(name varchar, a bigint, b bigint)[]) as active, cast(null as varchar) as name,
         cast(null as varchar) as outcome, cast(null as bigint) as start, cast(null as bigint) as until, cast(null as bigint) as seq
  from (select distinct host from e)
  union all
  select e.host, e.n,
         case when e.kind = 'stop' then [x for x in w.active if x.name <> e.name]
              when len([x for x in w.active if e.start <= x.b and x.a <= e.start + e.period]) > 0 then w.active
              else list_append([x for x in w.active if x.name <> e.name], {'name': e.name, 'a': e.start, 'b': e.start + e.period}) end,
         e.name,
         case when e.kind = 'stop' then case when len([x for x in w.active if x.name = e.name]) > 0 then 'stopped' else 'unknown' end
              when len([x for x in w.active if e.start <= x.b and x.a <= e.start + e.period]) > 0 then 'overlap' else 'created' end,
         case when e.kind = 'stop' then [x.a for x in w.active if x.name = e.name][1] else e.start end,
         case when e.kind = 'stop' then [x.b for x in w.active if x.name = e.name][1] else e.start + e.period end, e.seq
  from w join e on e.host = w.host and e.n = w.n + 1),
r as (select *, row_number() over (partition by host, name order by n desc) as k from w where outcome in ('created', 'stopped'))
select host, name, seq, start, until - start as period, outcome = 'created' as active from r where k = 1
""",
)
def session_stream(spark: SparkSession, d: str) -> DataFrame:
    """Sessions created and stopped by orders, in order of days: the registry's last word on each name."""
    day = F.datediff(F.col("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("double")
    key = F.col("o_orderkey")
    rows = read(spark, d, "orders").select(
        F.col("o_custkey").cast("long").alias("host"), day.alias("t"), key.cast("long").alias("seq"), F.when(key % 3 == 0, "stop").otherwise("create").alias("kind"),
        F.concat(F.lit("s"), (F.floor(key / 4) % 3).cast("string")).alias("name"), (day + key % 11 * 50).alias("start"), (key % 97).cast("double").alias("period"),
    )
    registry = Sessions(scratch(spark), every=2)
    change = lambda s: session_changes(s).writeStream.outputMode("append").foreachBatch(registry.write)
    fed(rows, (F.col("t") >= 1200).cast("int") + (F.col("t") >= 2000).cast("int"), 3, change)
    whole = [F.col(c).cast("long").alias(c) for c in ("start", "period")]
    return registry.all(spark).select("host", "name", "seq", *whole, "active")
