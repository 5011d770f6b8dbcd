"""Queries of attitude series: embeddings stand for states in 25 series, customers for landmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilune.functions import quaternion as Q
from perilune.operators import attitude as A
from perilune.plans.registry import read, register

_Q = ["x", "y", "z", "w"]
_BIAS = (0.01, -0.02, 0.03)


def _states(spark: SparkSession, d: str) -> DataFrame:
    v = [F.col("embedding")[i].cast("double") for i in range(7)]
    rows = read(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 25).alias("k"), (F.col("vec_id") / 25.0).alias("t"), *(c.alias(f"v{i}") for i, c in enumerate(v, 1)))
    unit = Q.normalized(tuple(F.col(f"v{i}") for i in range(1, 5)))
    return rows.select("vec_id", "k", "t", *(c.alias(n) for n, c in zip(_Q, unit, strict=True)), F.col("v5").alias("gx"), F.col("v6").alias("gy"), F.col("v7").alias("gz"))


_STATES = """v as (select vec_id, cast(embedding[1] as double) as a, cast(embedding[2] as double) as b, cast(embedding[3] as double) as c, cast(embedding[4] as double) as d,
  cast(embedding[5] as double) as gx, cast(embedding[6] as double) as gy, cast(embedding[7] as double) as gz from embeddings),
s as (select vec_id, vec_id % 25 as k, vec_id / cast(25 as double) as t, a / n as x, b / n as y, c / n as z, d / n as w, gx, gy, gz
  from (select *, sqrt(a * a + b * b + c * c + d * d) as n from v)),
n as (select *, lead(x) over o as bx, lead(y) over o as by_, lead(z) over o as bz, lead(w) over o as bw, lead(t) over o - t as dt
  from s window o as (partition by k order by vec_id))"""


@register("attitude_rates", f"""with {_STATES},
r as (select *, 2 * (w * bx - x * bw - y * bz + z * by_) / dt as rx, 2 * (w * by_ + x * bz - y * bw - z * bx) / dt as ry,
  2 * (w * bz - x * by_ + y * bx - z * bw) / dt as rz from n)
select vec_id, round(coalesce(rx, lag(rx) over o, 0.0), 7) as rx, round(coalesce(ry, lag(ry) over o, 0.0), 7) as ry,
  round(coalesce(rz, lag(rz) over o, 0.0), 7) as rz from r window o as (partition by k order by vec_id)""")
def attitude_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = A.attitude_rates(_states(spark, d), "k", "t", _Q, width=32)
    return rows.select("vec_id", *(F.round(f"rate_{a}", 7).alias(f"r{a}") for a in "xyz"))


@register("gyro_residuals", f"""with {_STATES},
g as (select *, (gx - 0.01) * dt as ex, (gy + 0.02) * dt as ey, (gz - 0.03) * dt as ez from n where dt is not null),
f as (select *, sqrt(ex * ex + ey * ey + ez * ez) as angle from g),
e as (select * replace (ex * u as ex, ey * u as ey, ez * u as ez), cos(angle / 2) as ew from (select *, case when angle < 1e-9 then 0.5 else sin(angle / 2) / angle end as u from f)),
m as (select vec_id, dt, bx, by_, bz, bw, w * ex + x * ew + y * ez - z * ey as mx, w * ey - x * ez + y * ew + z * ex as my,
  w * ez + x * ey - y * ex + z * ew as mz, w * ew - x * ex - y * ey - z * ez as mw from e)
select vec_id, round((mw * bx - mx * bw - my * bz + mz * by_) / (0.5 * dt), 7) as res_rot_x, round((mw * by_ + mx * bz - my * bw - mz * bx) / (0.5 * dt), 7) as res_rot_y,
  round((mw * bz - mx * by_ + my * bx - mz * bw) / (0.5 * dt), 7) as res_rot_z from m""")
def gyro_residuals(spark: SparkSession, d: str) -> DataFrame:
    rows = A.gyro_residuals(_states(spark, d), "k", "t", _Q, ["gx", "gy", "gz"], _BIAS, 0.5, width=32)
    return rows.select("vec_id", *(F.round(f"res_rot_{a}", 7).alias(f"res_rot_{a}") for a in "xyz"))


@register("landmark_residuals", f"""with {_STATES},
l as (select c_custkey, c_custkey % 25 as k, c_custkey * cast(0.037 as double) as t, radians(cast(c_custkey % 120 - 60 as double)) as lat, radians(c_nationkey * cast(14 as double)) as lon from customer),
p as (select *, 6371 * cos(lat) * cos(lon) as px, 6371 * cos(lat) * sin(lon) as py, 6371 * sin(lat) as pz from l),
b as (select p.*, s.t as bt, s.vec_id as bid from p asof left join s on p.k = s.k and p.t >= s.t),
a as (select b.*, s.t as at_, s.vec_id as aid from b asof left join s on b.k = s.k and b.t <= s.t),
h as (select *, case when at_ is null or t - bt <= at_ - t then bid else aid end as state_id from a),
j as (select h.*, s.x, s.y, s.z, s.w, px - 7000 * s.gx as dx, py - 7000 * s.gy as dy, pz - 7000 * s.gz as dz from h join s on s.vec_id = h.state_id),
u as (select *, dx / far as ux, dy / far as uy, dz / far as uz from (select *, sqrt(dx * dx + dy * dy + dz * dz) as far from j)),
r as (select c_custkey, state_id, ((1 - 2 * (y * y + z * z)) * ux + 2 * (x * y + w * z) * uy + 2 * (x * z - w * y) * uz) / 0.2 as rx,
  (2 * (x * y - w * z) * ux + (1 - 2 * (x * x + z * z)) * uy + 2 * (y * z + w * x) * uz - 0.6) / 0.2 as ry,
  (2 * (x * z + w * y) * ux + 2 * (y * z - w * x) * uy + (1 - 2 * (x * x + y * y)) * uz - 0.8) / 0.2 as rz from u)
select c_custkey, state_id, round(sqrt(rx * rx + ry * ry + rz * rz), 6) as norm, sqrt(rx * rx + ry * ry + rz * rz) > 5 as outlier from r""")
def landmark_residuals(spark: SparkSession, d: str) -> DataFrame:
    states = _states(spark, d).withColumns({f"r{a}": 7000 * F.col(f"g{a}") for a in "xyz"})
    lat, lon = F.radians((F.col("c_custkey") % 120 - 60).cast("double")), F.radians(F.col("c_nationkey") * F.lit(14.0))
    seen = read(spark, d, "customer").select(
        "c_custkey", (F.col("c_custkey") % 25).alias("k"), (F.col("c_custkey") * F.lit(0.037)).alias("t"), (6371 * F.cos(lat) * F.cos(lon)).alias("px"),
        (6371 * F.cos(lat) * F.sin(lon)).alias("py"), (6371 * F.sin(lat)).alias("pz"), F.lit(0.0).alias("bx"), F.lit(0.6).alias("by"), F.lit(0.8).alias("bz"),
    )
    rows = A.landmark_residuals(seen, states, "k", "t", ["px", "py", "pz"], ["bx", "by", "bz"], ["rx", "ry", "rz"], _Q, F.lit(0.2), ("vec_id",), width=32)
    return rows.select("c_custkey", F.col("s_vec_id").alias("state_id"), F.round("norm", 6).alias("norm"), "outlier")
