"""Queries on ordered series (events by user)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilune.operators import sequence as S
from perilune.plans.registry import read, register
from perilune.streaming.telemetry import fixed_rate, latest

_EV = "ev as (select event_id, user_id, event_type, epoch_us(ts) as us, cast(floor(value * 100) as bigint) as v from events)"


def events(spark: SparkSession, d: str) -> DataFrame:
    """us: microseconds; v: hundredths, whole, so that sums don't depend on their order."""
    return read(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.floor(F.col("value") * 100).cast("long").alias("v"))


#: Series of one user are cut into days.
DAY = 86_400_000_000


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ev = events(spark, d)
    return ev.where("event_type = 'purchase'").select("user_id", "us", "event_id"), ev.where("event_type = 'view'").select("user_id", "us", F.col("event_id").alias("id"), "v")


_SIDES = f"""with {_EV}, l as (select user_id, us, event_id from ev where event_type = 'purchase'),
r as (select user_id, us, event_id as id, v from ev where event_type = 'view'),
b as (select l.*, r.us as bt, r.id as bid, r.v as bv from l asof left join r on l.user_id = r.user_id and l.us >= r.us),
a as (select l.event_id, r.us as nt, r.id as aid, r.v as av from l asof left join r on l.user_id = r.user_id and l.us <= r.us),
j as (select * from b join a using (event_id)) """


@register("asof_nearest", _SIDES + """select event_id, user_id, us,
  case when nt is null or us - bt <= nt - us then bt else nt end as r_us, case when nt is null or us - bt <= nt - us then bid else aid end as r_id from j""")
def asof_nearest(spark: SparkSession, d: str) -> DataFrame:
    left, right = _sides(spark, d)
    return S.asof(left, right, "user_id", "us", ["id"], width=DAY)


@register("asof_signed_error", _SIDES + """select event_id, us - case when nt is null or us - bt <= nt - us then bt else nt end as error_us from j""")
def asof_signed_error(spark: SparkSession, d: str) -> DataFrame:
    left, right = _sides(spark, d)
    return S.asof(left, right, "user_id", "us", ["id"], width=DAY).select("event_id", (F.col("us") - F.col("r_us")).alias("error_us"))


@register("asof_backward_tolerance", _SIDES + """select event_id, case when us - bt <= 3600000000 then bt end as r_us from j""")
def asof_backward_tolerance(spark: SparkSession, d: str) -> DataFrame:
    left, right = _sides(spark, d)
    rows = S.asof(left, right, "user_id", "us", ["id"], "backward", max_gap=3_600_000_000, width=DAY)
    return rows.select("event_id", F.when(F.col("r_us").isNotNull() & (F.col("us") - F.col("r_us") <= 3_600_000_000), F.col("r_us")).alias("r_us"))


@register("interp_resample", _SIDES + """select event_id, cast(floor(1000 * case when bt is null then av when nt is null or nt = bt then bv
  else bv + (av - bv) * ((us - cast(bt as double)) / (cast(nt as double) - cast(bt as double))) end) as bigint) as milli from j""")
def interp_resample(spark: SparkSession, d: str) -> DataFrame:
    left, right = _sides(spark, d)
    return S.interpolate(left, right, "user_id", "us", "v", width=DAY).select("event_id", F.floor(F.col("interpolated") * 1000).cast("long").alias("milli"))


@register("keyframe_bracket", _SIDES + "select event_id, bt as lo_us, nt as hi_us, bv as lo_v, av as hi_v from j")
def keyframe_bracket(spark: SparkSession, d: str) -> DataFrame:
    left, right = _sides(spark, d)
    return S.bracket(left, right, "user_id", "us", "v", width=DAY).select("event_id", "lo_us", "hi_us", "lo_v", "hi_v")


@register("group_id_from_starts", f"""with {_EV}, s as (select *, lag(event_type) over w is distinct from event_type or row_number() over w = 1 as starts from ev window w as (partition by user_id order by us, event_id))
select event_id, user_id, starts, cast(sum(cast(starts as int)) over (partition by user_id order by us, event_id rows unbounded preceding) - 1 as bigint) as group_id from s""")
def group_id_from_starts(spark: SparkSession, d: str) -> DataFrame:
    return S.group_ids(S.start_flags(events(spark, d), "user_id", ["us", "event_id"], "event_type"), "user_id", ["us", "event_id"]).select("event_id", "user_id", "starts", "group_id")


@register("central_difference", f"""with {_EV}, s as (select event_id, coalesce(lead(us) over w, us) - coalesce(lag(us) over w, us) as dt, coalesce(lead(v) over w, v) - coalesce(lag(v) over w, v) as dv
  from ev window w as (partition by user_id order by us, event_id)) select event_id, case when dt <> 0 then cast(dv as double) / cast(dt as double) else 0.0 end as rate from s""")
def central_difference(spark: SparkSession, d: str) -> DataFrame:
    return S.central_difference(events(spark, d), "user_id", ["us", "event_id"], "us", "v").select("event_id", "rate")


@register("monotonic_violations", """with s as (select l_orderkey, lag(l_shipdate) over w > l_shipdate as bad, row_number() over w - 1 as pos from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate))
select l_orderkey, count(*) filter (bad) as violations, cast(min(pos) filter (bad) as bigint) as first_violation from s group by 1""")
def monotonic_violations(spark: SparkSession, d: str) -> DataFrame:
    return S.violations(read(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], "l_shipdate")


@register("counter_delta_load", f"""with {_EV}, c as (select event_id, user_id, us, sum(case when event_type = 'view' then abs(v) else 0 end) over w as idle, sum(abs(v)) over w as total
  from ev window w as (partition by user_id order by us, event_id rows unbounded preceding)),
d as (select event_id, idle - lag(idle) over w as di, total - lag(total) over w as dt from c window w as (partition by user_id order by us, event_id))
select event_id, cast(coalesce(case when dt > 0 then greatest(0, least(100, trunc((1 - cast(di as double) / cast(dt as double)) * 100))) else 0 end, 0) as integer) as load from d""")
def counter_delta_load(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = events(spark, d).withColumn("idle", F.sum(F.when(F.col("event_type") == "view", F.abs("v")).otherwise(0)).over(w)).withColumn("total", F.sum(F.abs("v")).over(w))
    return S.counter_load(rows, "user_id", ["us", "event_id"], "idle", "total").select("event_id", "load")


@register("long_series_groups", f"""with {_EV}, s as (select *, lag(user_id) over w is distinct from user_id or row_number() over w = 1 as starts
  from ev window w as (partition by event_type order by us, event_id))
select event_id, starts, cast(sum(cast(starts as int)) over (partition by event_type order by us, event_id rows unbounded preceding) - 1 as bigint) as group_id from s""")
def long_series_groups(spark: SparkSession, d: str) -> DataFrame:
    """A few long series, cut into days: the scans of `group_id_from_starts` in two levels."""
    order = ["us", "event_id"]
    flagged = S.start_flags(events(spark, d), "event_type", order, "user_id", width=DAY)
    return S.group_ids(flagged, "event_type", order, width=DAY).select("event_id", "starts", "group_id")


@register("long_series_violations", f"""with {_EV}, s as (select event_type, lag(v) over w > v as bad, row_number() over w - 1 as pos
  from ev window w as (partition by event_type order by us, event_id))
select event_type, count(*) filter (bad) as violations, cast(min(pos) filter (bad) as bigint) as first_violation from s group by 1""")
def long_series_violations(spark: SparkSession, d: str) -> DataFrame:
    return S.violations(events(spark, d), "event_type", ["us", "event_id"], "v", width=DAY)


@register("long_series_load", f"""with {_EV}, c as (select event_id, event_type, us, user_id * 7 + us // 1000000 as idle, user_id * 11 + us // 500000 as total from ev),
d as (select event_id, idle - lag(idle) over w as di, total - lag(total) over w as dt from c window w as (partition by event_type order by us, event_id))
select event_id, cast(coalesce(case when dt > 0 then greatest(0, least(100, trunc((1 - cast(di as double) / cast(dt as double)) * 100))) else 0 end, 0) as integer) as load from d""")
def long_series_load(spark: SparkSession, d: str) -> DataFrame:
    us = F.col("us")
    rows = events(spark, d).withColumns({"idle": F.col("user_id") * 7 + F.floor(us / 1_000_000), "total": F.col("user_id") * 11 + F.floor(us / 500_000)})
    return S.counter_load(rows, "event_type", ["us", "event_id"], "idle", "total", width=DAY).select("event_id", "load")


@register("long_series_stalled", f"""with {_EV}, u as (
  select *, coalesce(v > max(v) over (partition by event_type order by us, event_id rows between unbounded preceding and 1 preceding), true) as up from ev),
i as (select *, sum(cast(up as int)) over (partition by event_type order by us, event_id rows unbounded preceding) as island from u)
select event_id, cast(row_number() over w - 1 as bigint) as stalled, row_number() over w - 1 >= 50 as failed from i window w as (partition by event_type, island order by us, event_id)""")
def long_series_stalled(spark: SparkSession, d: str) -> DataFrame:
    return S.stalled(events(spark, d), "event_type", ["us", "event_id"], "v", 50, width=DAY).select("event_id", "stalled", "failed")


@register("rolling_stability", f"""with {_EV}, s as (select user_id, row_number() over p - 1 as pos, count(*) over w as n, sum(v) over w as s, sum(v * v) over w as q from ev
  window p as (partition by user_id order by us, event_id), w as (partition by user_id order by us, event_id rows 4 preceding))
select user_id, cast(min(pos) filter (n = 5 and n * q - s * s < 25 * 4000 * 4000) as bigint) as stable_at from s group by 1""")
def rolling_stability(spark: SparkSession, d: str) -> DataFrame:
    return S.first_stable(events(spark, d), "user_id", ["us", "event_id"], "v", 5, 4000)


@register("stalled_progress_islands", f"""with {_EV}, u as (select *, coalesce(v > max(v) over (partition by user_id order by us, event_id rows between unbounded preceding and 1 preceding), true) as up from ev),
i as (select *, sum(cast(up as int)) over (partition by user_id order by us, event_id rows unbounded preceding) as island from u)
select event_id, cast(row_number() over w - 1 as bigint) as stalled, row_number() over w - 1 >= 5 as failed from i window w as (partition by user_id, island order by us, event_id)""")
def stalled_progress_islands(spark: SparkSession, d: str) -> DataFrame:
    return S.stalled(events(spark, d), "user_id", ["us", "event_id"], "v", 5).select("event_id", "stalled", "failed")


@register("dedup_window_60s", f"""with {_EV} select event_id, coalesce(us - lag(us) over (partition by user_id, event_type order by us, event_id) < 60000000, false) as duplicate from ev""")
def dedup_window(spark: SparkSession, d: str) -> DataFrame:
    return S.within_window(events(spark, d), ["user_id", "event_type"], "us", 60_000_000, "event_id").select("event_id", "duplicate")


@register("last_n_errors", f"""with {_EV}, r as (select user_id, event_id, cast(row_number() over (partition by user_id order by us desc, event_id desc) as integer) as place from ev where event_type = 'error')
select * from r where place <= 20""")
def last_n_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).where("event_type = 'error'")
    return S.last_n(rows, ["user_id"], [F.desc("us"), F.desc("event_id")], 20).select("user_id", "event_id", "place")


@register("allan_deviation", f"""with {_EV}, p as (select user_id, v, row_number() over (partition by user_id order by us, event_id) as i from ev), m as (select unnest([1, 2, 4]) as m),
t as (select a.user_id, m.m, c.v - 2 * b.v + a.v as d from p a cross join m join p b on b.user_id = a.user_id and b.i = a.i + m.m join p c on c.user_id = a.user_id and c.i = a.i + 2 * m.m)
select user_id, cast(m as integer) as m, count(*) as terms, cast(sum(d * d) as bigint) as squares, cast(floor(sqrt(cast(sum(d * d) as double) / (2.0 * m * m * count(*)))) as bigint) as deviation from t group by user_id, m""")
def allan_deviation(spark: SparkSession, d: str) -> DataFrame:
    return S.allan(events(spark, d), "user_id", ["us", "event_id"], "v", [1, 2, 4]).withColumn("deviation", F.floor("deviation").cast("long"))


@register("median_representative", """with m as (select o_custkey, median(o_totalprice) as median from orders group by 1),
r as (select o_custkey, o_orderkey, m.median, row_number() over (partition by o_custkey order by abs(o_totalprice - m.median), o_orderkey) as n from orders join m using (o_custkey))
select o_custkey, median, o_orderkey from r where n = 1""")
def median_representative(spark: SparkSession, d: str) -> DataFrame:
    return S.closest_to_median(read(spark, d, "orders"), "o_custkey", "o_totalprice", "o_orderkey")


@register("interval_overlap_pairs", """with w as (select o_orderkey as id, o_custkey, epoch_us(o_orderdate) // 86400000000 as a, epoch_us(o_orderdate) // 86400000000 + 30 as b from orders)
select x.id, y.id as id_b from w x join w y on x.o_custkey = y.o_custkey and x.id < y.id and x.a <= y.b and y.a <= x.b""")
def interval_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    day = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000_000)
    w = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", day.alias("a"), (day + 30).alias("b"))
    return S.overlapping(w, w, "a", "b", 60, ["o_custkey"]).where("id < id_b").select("id", "id_b")


@register("missing_fragments", """with c as (select distinct o_custkey, o_orderkey as n from orders), g as (select o_custkey, coalesce(lag(n) over (partition by o_custkey order by n), -1) + 1 as first, n - 1 as last from c)
select o_custkey, first, last from g where first <= last""")
def missing_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Customers stand for images, their orders' keys for fragment numbers: which stretches of them are missing."""
    return S.gaps(read(spark, d, "orders"), "o_custkey", "o_orderkey")


@register("fragment_coverage", """select l_suppkey, count(distinct l_orderkey) as present, max(l_orderkey) as largest, max(l_orderkey) + 1 - count(distinct l_orderkey) as missing from lineitem group by 1""")
def fragment_coverage(spark: SparkSession, d: str) -> DataFrame:
    return S.coverage(read(spark, d, "lineitem"), "l_suppkey", "l_orderkey")


@register("dedup_first_fragment", """with c as (select conv_id, turn % 2 as slot, text, turn from conversations), r as (select *, row_number() over (partition by conv_id, slot order by turn) as n from c)
select conv_id, slot, turn, sha256(text) as digest from r where n = 1""")
def dedup_first_fragment(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations").select("conv_id", (F.col("turn") % 2).alias("slot"), "text", "turn")
    return S.first_occurrence(rows, ["conv_id", "slot"], ["turn"]).select("conv_id", "slot", "turn", F.sha2("text", 256).alias("digest"))


@register("reassemble_payload", """select conv_id, sha256(string_agg(text, '' order by turn)) as digest, count(*) as parts from conversations group by 1""")
def reassemble_payload(spark: SparkSession, d: str) -> DataFrame:
    return S.reassemble(read(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", F.sha2("payload", 256).alias("digest"), "parts")


@register("unit_autodetect", f"""with {_EV}, k as (select user_id % 2 as half, case when user_id % 2 = 0 then us / 1000000.0 else us / 1000000.0 - 946728000.0 end as t from ev)
select half, median(t) > 1e9 as is_unix, count(*) as n from k group by 1""")
def unit_autodetect(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.col("us") / 1_000_000.0
    rows = events(spark, d).select((F.col("user_id") % 2).alias("half"), F.when(F.col("user_id") % 2 == 0, seconds).otherwise(seconds - 946728000.0).alias("t"))
    found = S.medians(rows, "half", "t").select("half", (F.col("median") > 1e9).alias("is_unix"))
    return rows.groupBy("half").agg(F.count("*").alias("n")).join(found, "half").select("half", "is_unix", "n")


@register("priority_dispatch_order", f"""with {_EV}, p as (select *, case event_type when 'error' then 3 when 'purchase' then 2 when 'signup' then 1 else 0 end as priority from ev)
select event_id, user_id, cast(row_number() over (partition by user_id order by priority desc, us, event_id) as integer) as place from p""")
def priority_dispatch_order(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    rows = events(spark, d).withColumn("priority", F.when(kind == "error", 3).when(kind == "purchase", 2).when(kind == "signup", 1).otherwise(0))
    return S.last_n(rows, ["user_id"], [F.desc("priority"), F.col("us"), F.col("event_id")], 1 << 30).select("event_id", "user_id", "place")


@register("snapshot_latest", f"""with {_EV}, r as (select user_id, event_type, event_id, v, row_number() over (partition by user_id, event_type order by us desc, event_id desc) as n from ev)
select user_id, event_type, event_id, v from r where n = 1""")
def snapshot_latest(spark: SparkSession, d: str) -> DataFrame:
    """The stream's snapshot store, over a table."""
    rows = events(spark, d).withColumn("at", F.struct("us", "event_id"))
    return latest(rows, ["user_id", "event_type"], "at", ["event_id", "v"]).drop("at")


@register("fixed_rate_samples", f"""with {_EV} select user_id, us // 3600000000 as hour, count(*) as n, round(avg(v), 6) as mean from ev group by all""")
def fixed_rate_samples(spark: SparkSession, d: str) -> DataFrame:
    """The stream's hourly windows, over a table."""
    rows = events(spark, d).withColumn("ts", F.timestamp_micros("us"))
    made = fixed_rate(rows, "ts", ["user_id"], "v", "1 hour")
    return made.select("user_id", F.floor(F.unix_seconds("start") / 3600).alias("hour"), "n", F.round("mean", 6).alias("mean"))
