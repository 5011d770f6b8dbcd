"""Queries of navigation mathematics: embeddings stand for vectors and quaternions, customers for places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perilune.functions import nav, units
from perilune.functions import quaternion as Q
from perilune.operators import measure as M
from perilune.plans.registry import read, register


def _vec(spark: SparkSession, d: str) -> DataFrame:
    """Sixteen components as doubles, v1 ... v16."""
    return read(spark, d, "embeddings").select("vec_id", "label", *(F.col("embedding")[k - 1].cast("double").alias(f"v{k}") for k in range(1, 17)))


_VEC = "vv as (select vec_id, label, " + ", ".join(f"cast(embedding[{k}] as double) as v{k}" for k in range(1, 17)) + " from embeddings)"


def _cols(*ks: int) -> tuple[Column, ...]:
    return tuple(F.col(f"v{k}") for k in ks)


def _rounded(names: str, values, digits: int = 9) -> list[Column]:
    return [F.round(c, digits).alias(n) for n, c in zip(names.split(), values, strict=True)]


@register("quaternion_product", f"""with {_VEC} select vec_id, round(v1 * v5 - v2 * v6 - v3 * v7 - v4 * v8, 9) as w, round(v1 * v6 + v2 * v5 + v3 * v8 - v4 * v7, 9) as x,
  round(v1 * v7 - v2 * v8 + v3 * v5 + v4 * v6, 9) as y, round(v1 * v8 + v2 * v7 - v3 * v6 + v4 * v5, 9) as z from vv""")
def quaternion_product(spark: SparkSession, d: str) -> DataFrame:
    return _vec(spark, d).select("vec_id", *_rounded("w x y z", Q.product_wxyz(_cols(1, 2, 3, 4), _cols(5, 6, 7, 8))))


@register("quaternion_slerp", f"""with {_VEC}, n as (select vec_id, v1 / n1 as a1, v2 / n1 as a2, v3 / n1 as a3, v4 / n1 as a4, v5 / n2 as b1, v6 / n2 as b2, v7 / n2 as b3, v8 / n2 as b4
  from (select *, sqrt(v1 * v1 + v2 * v2 + v3 * v3 + v4 * v4) n1, sqrt(v5 * v5 + v6 * v6 + v7 * v7 + v8 * v8) n2 from vv)), d as (select *, a1 * b1 + a2 * b2 + a3 * b3 + a4 * b4 as dt from n),
p as (select *, case when 1 - abs(dt) < 0.01 then 0.7 else sin(0.7 * acos(least(abs(dt), 1.0))) / sin(acos(least(abs(dt), 1.0))) end as p, case when 1 - abs(dt) < 0.01 then 0.3 else sin(0.3 * acos(least(abs(dt), 1.0))) / sin(acos(least(abs(dt), 1.0))) end * case when dt < 0 then -1.0 else 1.0 end as q from d),
m as (select vec_id, dt, p * a1 + q * b1 as w, p * a2 + q * b2 as x, p * a3 + q * b3 as y, p * a4 + q * b4 as z from p), k as (select *, case when 1 - abs(dt) < 0.01 then 1.0 else sqrt(w * w + x * x + y * y + z * z) end as l from m)
select vec_id, round(w / l, 7) as w, round(x / l, 7) as x, round(y / l, 7) as y, round(z / l, 7) as z from k""")
def quaternion_slerp(spark: SparkSession, d: str) -> DataFrame:
    mixed = Q.slerp_wxyz(Q.normalized(_cols(1, 2, 3, 4)), Q.normalized(_cols(5, 6, 7, 8)), F.lit(0.3))
    return _vec(spark, d).select("vec_id", *_rounded("w x y z", mixed, 7))


@register("quaternion_mrp", f"""with {_VEC}, n as (select vec_id, v1 / n as w, v2 / n as x, v3 / n as y, v4 / n as z from (select *, sqrt(v1 * v1 + v2 * v2 + v3 * v3 + v4 * v4) n from vv)), m as (select vec_id, x / (1 + w) as x, y / (1 + w) as y, z / (1 + w) as z from n)
select vec_id, round(case when x * x + y * y + z * z >= 1 then -x / (x * x + y * y + z * z) else x end, 7) as mx, round(case when x * x + y * y + z * z >= 1 then -y / (x * x + y * y + z * z) else y end, 7) as my, round(case when x * x + y * y + z * z >= 1 then -z / (x * x + y * y + z * z) else z end, 7) as mz from m""")
def quaternion_mrp(spark: SparkSession, d: str) -> DataFrame:
    return _vec(spark, d).select("vec_id", *_rounded("mx my mz", Q.mrp_wxyz(_cols(1, 2, 3, 4)), 7))


@register("quaternion_inverse_rotate", f"""with {_VEC}, q as (select vec_id, v1 / n as x, v2 / n as y, v3 / n as z, v4 / n as w, v9 as a, v10 as b, v11 as c from (select *, sqrt(v1 * v1 + v2 * v2 + v3 * v3 + v4 * v4) n from vv))
select vec_id, round((1 - 2 * (y * y + z * z)) * a + 2 * (x * y + w * z) * b + 2 * (x * z - w * y) * c, 7) as rx, round(2 * (x * y - w * z) * a + (1 - 2 * (x * x + z * z)) * b + 2 * (y * z + w * x) * c, 7) as ry,
  round(2 * (x * z + w * y) * a + 2 * (y * z - w * x) * b + (1 - 2 * (x * x + y * y)) * c, 7) as rz from q""")
def quaternion_inverse_rotate(spark: SparkSession, d: str) -> DataFrame:
    return _vec(spark, d).select("vec_id", *_rounded("rx ry rz", Q.inverse_rotate_xyzw(Q.normalized(_cols(1, 2, 3, 4)), _cols(9, 10, 11)), 7))


@register("quaternion_angle_axis", f"""with {_VEC}, a as (select *, sqrt(v1 * v1 + v2 * v2 + v3 * v3) as g from vv), f as (select *, case when g < 1e-9 then 0.5 else sin(g / 2) / g end as k from a)
select vec_id, round(v1 * k, 9) as x, round(v2 * k, 9) as y, round(v3 * k, 9) as z, round(cos(g / 2), 9) as w from f""")
def quaternion_angle_axis(spark: SparkSession, d: str) -> DataFrame:
    return _vec(spark, d).select("vec_id", *_rounded("x y z w", Q.angle_axis_xyzw(_cols(1, 2, 3))))


_ORBIT = f"{_VEC}, o as (select vec_id, 7000 * v1 / n as x, 7000 * v2 / n as y, 7000 * v3 / n as z, 7.5 * v4 / m as vx, 7.5 * v5 / m as vy, 7.5 * v6 / m as vz from (select *, sqrt(v1 * v1 + v2 * v2 + v3 * v3) n, sqrt(v4 * v4 + v5 * v5 + v6 * v6) m from vv))"
_GM, _RE, _J2 = "398600.44188", "6378.137", "1.08262668e-3"


def _orbit(spark: SparkSession, d: str) -> tuple[DataFrame, tuple, tuple]:
    unit = lambda v, s: nav.scaled(v, s / nav.length(v))
    rows = _vec(spark, d)
    r, v = unit(_cols(1, 2, 3), 7000.0), unit(_cols(4, 5, 6), 7.5)
    rows = rows.select("vec_id", *(c.alias(n) for n, c in zip(("x", "y", "z", "vx", "vy", "vz"), (*r, *v), strict=True)))
    return rows, tuple(map(F.col, "xyz")), (F.col("vx"), F.col("vy"), F.col("vz"))


@register("kepler_j2_acceleration", f"""with {_ORBIT}, k as (select *, x * x + y * y + z * z + 1e-10 as r2 from o), f as (select *, -{_GM} / (r2 * sqrt(r2)) as g, 1.5 * {_J2} * {_GM} * {_RE} * {_RE} / (r2 * r2 * sqrt(r2)) as j, z * z / r2 as q from k)
select vec_id, round(g * x + j * x * (5 * q - 1), 12) as ax, round(g * y + j * y * (5 * q - 1), 12) as ay, round(g * z + j * z * (5 * q - 3), 12) as az from f""")
def kepler_j2_acceleration(spark: SparkSession, d: str) -> DataFrame:
    rows, r, v = _orbit(spark, d)
    return rows.select("vec_id", *_rounded("ax ay az", nav.acceleration(r, v, j2=True), 12))


@register("drag_acceleration", f"""with {_ORBIT}, e as (select vec_id, (6700 + vec_id % 350) * x / 7000 as x, (6700 + vec_id % 350) * y / 7000 as y, (6700 + vec_id % 350) * z / 7000 as z, vx, vy, vz from o),
h as (select *, sqrt(x * x + y * y + z * z + 1e-10) - {_RE} as h, vx + 7.2921150e-5 * y as a, vy - 7.2921150e-5 * x as b from e),
p as (select *, case when h < 350 then 2.418e-2 * exp(-(h - 300) / 53.628) when h < 400 then 9.518e-3 * exp(-(h - 350) / 53.298) when h < 450 then 3.725e-3 * exp(-(h - 400) / 58.515) when h < 500 then 1.585e-3 * exp(-(h - 450) / 60.828) when h < 600 then 6.967e-4 * exp(-(h - 500) / 63.822) else 1.454e-4 * exp(-(h - 600) / 71.835) end as rho from h),
f as (select *, -0.5 * 2.2 * (1.0e-8 / 1.3) * rho * sqrt(a * a + b * b + vz * vz + 1e-20) as k from p)
select vec_id, round(k * a * 1e12, 4) as ax, round(k * b * 1e12, 4) as ay, round(k * vz * 1e12, 4) as az from f""")
def drag_acceleration(spark: SparkSession, d: str) -> DataFrame:
    rows, r, v = _orbit(spark, d)
    r = nav.scaled(r, (6700 + F.col("vec_id") % 350) / 7000)
    return rows.select("vec_id", *_rounded("ax ay az", nav.scaled(nav.drag_acceleration(r, v, F.lit(2.2)), 1e12), 4))


@register("euler_rk4_steps", f"""with {_ORBIT}, k as (select *, -{_GM} / ((x * x + y * y + z * z + 1e-10) * sqrt(x * x + y * y + z * z + 1e-10)) as g from o)
select vec_id, round(x + vx * 10, 8) as ex, round(y + vy * 10, 8) as ey, round(vz + g * z * 10, 10) as evz, true as near from k""")
def euler_rk4_steps(spark: SparkSession, d: str) -> DataFrame:
    """An Euler step, and whether the RK4 step of a second stays within its second-order error of it."""
    rows, r, v = _orbit(spark, d)
    er, ev = nav.euler_step(r, v, F.lit(10.0))
    (rr, _), (e1, _) = nav.rk4_step(r, v, F.lit(1.0)), nav.euler_step(r, v, F.lit(1.0))
    return rows.select("vec_id", *_rounded("ex ey", er[:2], 8), F.round(ev[2], 10).alias("evz"), (nav.length(nav.minus(rr, e1)) < 0.01).alias("near"))


_PLACE = "p as (select c_custkey, radians(c_custkey % 360 - 180.0) as lon, radians(c_nationkey * 7 - 84.0) as lat, c_custkey % 600 as h from customer)"
_E2 = f"(({_RE} - 6356.7519) / {_RE}) * (2 - ({_RE} - 6356.7519) / {_RE})"


def _places(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", F.radians(F.col("c_custkey") % 360 - 180.0).alias("lon"), F.radians(F.col("c_nationkey") * 7 - 84.0).alias("lat"), (F.col("c_custkey") % 600).alias("h"))


@register("geodetic_to_ecef", f"""with {_PLACE}, n as (select *, {_RE} / sqrt(1 - {_E2} * sin(lat) * sin(lat)) as n from p)
select c_custkey, round((n + h) * cos(lat) * cos(lon), 6) + 0.0 as x, round((n + h) * cos(lat) * sin(lon), 6) + 0.0 as y, round((n * (1 - {_E2}) + h) * sin(lat), 6) + 0.0 as z from n""")
def geodetic_to_ecef(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).select("c_custkey", *_rounded("x y z", nav.geodetic_to_ecef(F.col("lon"), F.col("lat"), F.col("h")), 6))


@register("geodetic_roundtrip", f"with {_PLACE} select c_custkey, round(h, 5) as altitude, round(lon, 8) as lon, round(lat, 8) as lat from (select c_custkey, cast(h as double) as h, lon, lat from p)")
def geodetic_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    there = nav.geodetic_to_ecef(F.col("lon"), F.col("lat"), F.col("h"))
    rows = _places(spark, d).select("c_custkey", *(c.alias(n) for n, c in zip("xyz", there, strict=True)))
    back = nav.ecef_to_geodetic(tuple(map(F.col, "xyz")))
    clean = lambda c, k: F.round(c, k) + 0.0  # noqa: E731  no negative zero
    return rows.select("c_custkey", clean(back[0], 5).alias("altitude"), F.when(F.abs(back[1] - 3.141592653589793) < 1e-12, -3.14159265).otherwise(clean(back[1], 8)).alias("lon"), clean(back[2], 8).alias("lat"))


@register("geocentric_places", f"with {_PLACE} select c_custkey, round((h * 1000 + (2 * {_RE} + 6356.7519) / 3 * 1000) * cos(lat) * cos(lon), 3) as x, round((h * 1000 + (2 * {_RE} + 6356.7519) / 3 * 1000) * sin(lat), 3) as z from p")
def geocentric_places(spark: SparkSession, d: str) -> DataFrame:
    v = nav.geocentric_to_ecef(F.col("lon"), F.col("lat"), F.col("h") * 1000)
    return _places(spark, d).select("c_custkey", F.round(v[0], 3).alias("x"), F.round(v[2], 3).alias("z"))


@register("eci_ecef_roundtrip", f"with {_ORBIT} select vec_id, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z from o")
def eci_ecef_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows, r, _ = _orbit(spark, d)
    t = F.col("vec_id") * 777.0
    return rows.select("vec_id", *_rounded("x y z", nav.ecef_to_eci(nav.eci_to_ecef(r, t), t), 6))


@register("earth_orientation", f"with {_ORBIT} select vec_id, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z, true as turned from o")
def earth_orientation(spark: SparkSession, d: str) -> DataFrame:
    """To the Earth-fixed frame with precession, nutation and sidereal time, and back; along the pole a position moves no more than precession and nutation have turned it by then."""
    rows, _, _ = _orbit(spark, d)
    unix = F.col("vec_id") * 86_477.0 + 946_728_000
    fixed = nav.inertial_to_earth(rows.withColumn("z0", F.col("z")), ["x", "y", "z"], unix)
    back = nav.earth_to_inertial(fixed.withColumn("turned", F.abs(F.col("z") - F.col("z0")) < 7000 * nav.pole_shift(unix)), ["x", "y", "z"], unix)
    return back.select("vec_id", *(F.round(c, 6).alias(c) for c in "xyz"), "turned")


@register("pixel_bearings", """with b as (select l_orderkey, l_linenumber, l_partkey, (l_partkey % 4608 - 2304.0) / 3548 as u, (l_suppkey * 13 % 2592 - 1296.0) / 3548 as v, l_quantity as h, l_linenumber * 9 as w from lineitem)
select l_orderkey, l_linenumber, l_partkey, round(u / sqrt(u * u + v * v + 1), 9) as bx, round(v / sqrt(u * u + v * v + 1), 9) as by, round(1 / sqrt(u * u + v * v + 1), 9) as bz, round(least(h, w) / (6 * 3548.0), 12) as sigma from b""")
def pixel_bearings(spark: SparkSession, d: str) -> DataFrame:
    b = nav.pixel_bearing(F.col("l_partkey") % 4608, F.col("l_suppkey") * 13 % 2592, 3548.0, 3548.0, 2304.0, 1296.0)
    sigma = nav.landmark_sigma(F.col("l_quantity"), F.col("l_linenumber") * 9, F.lit(3548.0), F.lit(3548.0))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *_rounded("bx by bz", b), F.round(sigma, 12).alias("sigma"))


@register("j2000_times", """select o_orderkey, cast(epoch_us(o_orderdate) / 1000000 as double) - 946728000.0 + case when epoch_us(o_orderdate) / 1000000 >= 1483228800 then 37 when epoch_us(o_orderdate) / 1000000 >= 1435708800 then 36 when epoch_us(o_orderdate) / 1000000 >= 1341100800 then 35
  when epoch_us(o_orderdate) / 1000000 >= 1230768000 then 34 when epoch_us(o_orderdate) / 1000000 >= 1136073600 then 33 else 32 end + 32.184 as et, cast(epoch_us(o_orderdate) / 1000000 as double) - 946727936.0 as constant from orders""")
def j2000_times(spark: SparkSession, d: str) -> DataFrame:
    unix = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1_000_000
    return read(spark, d, "orders").select("o_orderkey", units.unix_to_j2000(unix).alias("et"), units.unix_to_j2000(unix, "constant").alias("constant"))


@register("unit_conversions", """select vec_id, round(v1 * (3.141592653589793 / 180), 12) as rad, round(v2 * 1000 / 262.4, 9) as dps, round(v3 * 1000 * 0.3, 9) as ut, round(v4 * 1000 / 512.0 + 23, 9) as celsius from (select vec_id, """ + ", ".join(f"cast(embedding[{k}] as double) as v{k}" for k in range(1, 5)) + " from embeddings)")
def unit_conversions(spark: SparkSession, d: str) -> DataFrame:
    a, b, c, e = _cols(1, 2, 3, 4)
    return _vec(spark, d).select("vec_id", F.round(units.dps_to_rad(a), 12).alias("rad"), F.round(units.raw_gyro_dps(b * 1000), 9).alias("dps"), F.round(units.raw_mag_ut(c * 1000), 9).alias("ut"), F.round(units.raw_temperature_c(e * 1000), 9).alias("celsius"))


@register("mahalanobis_outliers", f"with {_VEC} select vec_id, sqrt((v1 * 20) * (v1 * 20) + (v2 * 20) * (v2 * 20) + (v3 * 20) * (v3 * 20)) > 5.0 as outlier from vv")
def mahalanobis_outliers(spark: SparkSession, d: str) -> DataFrame:
    rows = _vec(spark, d).select("vec_id", *((F.col(f"v{k}") * 20).alias(f"r{k}") for k in (1, 2, 3)))
    return M.outliers(rows, ["r1", "r2", "r3"]).select("vec_id", "outlier")


@register("residual_summary", f"""with {_VEC}, n as (select label, sqrt((v1 * 20) * (v1 * 20) + (v2 * 20) * (v2 * 20) + (v3 * 20) * (v3 * 20)) as n from vv) select label, max(n) as worst, round(avg(n), 9) as mean, count(*) filter (n > 5.0) as rejected, count(*) as n from n group by 1""")
def residual_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _vec(spark, d).select("label", *((F.col(f"v{k}") * 20).alias(f"r{k}") for k in (1, 2, 3)))
    return M.residual_summary(M.outliers(rows, ["r1", "r2", "r3"]), ["label"]).withColumn("mean", F.round("mean", 9))


@register("estimator_cost", f"""with {_VEC} select label, round(sum(v1 * v1 * 100) + sum(v2 * v2 * 100) + sum(2 * 3.0 * 3.0 * (sqrt(1 + v3 * v3 * 400 / 9.0) - 1)), 7) as cost from vv group by 1""")
def estimator_cost(spark: SparkSession, d: str) -> DataFrame:
    v = _cols(1, 2, 3)
    rows = _vec(spark, d).select("label", (v[0] * v[0] * 100).alias("a"), (v[1] * v[1] * 100).alias("g"), (v[2] * v[2] * 400).alias("l"))
    return M.objective(rows, ["label"], "a", "g", "l").withColumn("cost", F.round("cost", 7))


@register("group_mean_direction", """with s as (select l_orderkey, cast(sum(l_partkey % 90 - 45) as double) as x, cast(sum(l_suppkey % 50 - 20) as double) as y, cast(sum(l_linenumber) as double) as z from lineitem group by 1)
select l_orderkey, round(x / sqrt(x * x + y * y + z * z) * 6971.0, 6) as x, round(y / sqrt(x * x + y * y + z * z) * 6971.0, 6) as y, round(z / sqrt(x * x + y * y + z * z) * 6971.0, 6) as z from s""")
def group_mean_direction(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 90 - 45).cast("double").alias("x"), (F.col("l_suppkey") % 50 - 20).cast("double").alias("y"), F.col("l_linenumber").cast("double").alias("z"))
    means = M.group_means(rows, ["l_orderkey"], ["x", "y", "z"])
    return means.select("l_orderkey", *(F.round(c, 6).alias(c) for c in "xyz"))


@register("wahba_sums", "select l_orderkey, " + ", ".join(f"cast(sum({r} * {b}) as bigint) as b{i}{j}" for i, r in enumerate(("(l_partkey % 90 - 45)", "(l_suppkey % 50 - 20)", "l_linenumber")) for j, b in enumerate(("(l_partkey % 70 - 30)", "l_linenumber", "(l_suppkey % 40)"))) + " from lineitem group by 1")
def wahba_sums(spark: SparkSession, d: str) -> DataFrame:
    k, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber").cast("long")
    rows = read(spark, d, "lineitem").select("l_orderkey", (k % 90 - 45).alias("r0"), (s % 50 - 20).alias("r1"), n.alias("r2"), (k % 70 - 30).alias("c0"), n.alias("c1"), (s % 40).alias("c2"))
    return M.wahba_sums(rows, ["l_orderkey"], ["r0", "r1", "r2"], ["c0", "c1", "c2"])


@register("wahba_attitude")
def wahba_attitude(spark: SparkSession, d: str) -> DataFrame:
    sums = wahba_sums(spark, d)
    return M.wahba_attitudes(sums, ["l_orderkey"])


@register("gyro_bias", "select l_suppkey, avg(l_linenumber - l_partkey % 7) as bias_x, avg(l_partkey % 11 - l_linenumber) as bias_y, avg(l_linenumber) as bias_z from lineitem group by 1")
def gyro_bias(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("l_partkey"), F.col("l_linenumber").cast("long")
    rows = read(spark, d, "lineitem").select("l_suppkey", n.alias("a"), (k % 7).alias("b"), (k % 11).alias("c"), F.lit(0).alias("z"))
    return M.mean_bias(rows, ["l_suppkey"], ["a", "c", "a"], ["b", "a", "z"])


@register("propagation_residual", f"""with {_ORBIT}, n as (select *, lead(x) over w as x1, lead(y) over w as y1, lead(vz) over w as vz1, -{_GM} / ((x * x + y * y + z * z + 1e-10) * sqrt(x * x + y * y + z * z + 1e-10)) as g from o window w as (partition by vec_id % 25 order by vec_id))
select vec_id, round(x1 - (x + vx * 2), 7) as rx, round(y1 - (y + vy * 2), 7) as ry, round(vz1 - (vz + g * z * 2), 9) as rvz from n where x1 is not null""")
def propagation_residual(spark: SparkSession, d: str) -> DataFrame:
    rows, _, _ = _orbit(spark, d)
    left = M.propagation_residuals(rows, F.col("vec_id") % 25, "vec_id", ["x", "y", "z"], ["vx", "vy", "vz"], F.lit(2.0))
    return left.select("vec_id", F.round("res_x", 7).alias("rx"), F.round("res_y", 7).alias("ry"), F.round("res_vz", 9).alias("rvz"))


@register("solution_validity", f"with {_VEC} select vec_id, abs(sqrt(v1 * v1 * 16 + v2 * v2 * 16 + v3 * v3 * 16 + v4 * v4 * 16) - 1) <= 0.3 as valid from vv")
def solution_validity(spark: SparkSession, d: str) -> DataFrame:
    return _vec(spark, d).select("vec_id", M.finite_unit([c * 4 for c in _cols(1, 2, 3, 4)], list(_cols(5, 6)), 0.3).alias("valid"))


@register("three_sigma_bounds", f"with {_VEC} select vec_id, 3 * sqrt(greatest(v1, 0.0)) as bound from vv")
def three_sigma_bounds(spark: SparkSession, d: str) -> DataFrame:
    return _vec(spark, d).select("vec_id", nav.three_sigma(F.col("v1")).alias("bound"))
