"""Queries of whole pipelines: orbit determination, reprocessing, set and report operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perilune.operators import commands as C
from perilune.operators import detection as D
from perilune.operators import frames as R
from perilune.operators import measure as M
from perilune.plans.orbit import determine_orbits, orbit_results, simulate
from perilune.plans.registry import read, register
from perilune.plans.reprocess import reprocess
from perilune.sources import outputs as O
from perilune.sources.config import Solver


def _passes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A simulated pass for each nation: landmarks and gyro rates."""

    def marks(parts):
        for p in parts:
            for key in p["n_nationkey"]:
                m = simulate(n=6, landmarks=4, seed=int(key))
                yield pd.DataFrame({"dataset_id": str(key), "t": m["t"][m["state"]], **{f"bearing_{a}": m["bearing"][:, i] for i, a in enumerate("xyz")}, **{f"eci_{a}_km": m["eci"][:, i] for i, a in enumerate("xyz")}, "sigma": m["sigma"]})

    def rates(parts):
        for p in parts:
            for key in p["n_nationkey"]:
                m = simulate(n=6, landmarks=4, seed=int(key))
                yield pd.DataFrame({"dataset_id": str(key), "t": m["t"], **{f"w{a}": m["gyro"][:, i] for i, a in enumerate("xyz")}})

    nations = read(spark, d, "nation").select("n_nationkey")
    landmark = nations.mapInPandas(marks, "dataset_id string, t double, bearing_x double, bearing_y double, bearing_z double, eci_x_km double, eci_y_km double, eci_z_km double, sigma double")
    return landmark, nations.mapInPandas(rates, "dataset_id string, t double, wx double, wy double, wz double")


def _results(spark: SparkSession, d: str, settings: Solver = Solver()) -> DataFrame:
    return orbit_results(*_passes(spark, d), settings)


@register("od_solve")
def od_solve(spark: SparkSession, d: str) -> DataFrame:
    """Each nation's pass, solved: state estimates."""
    return determine_orbits(*_passes(spark, d))


@register("od_invariants", """select n_nationkey::varchar as dataset_id, 6 as states, cast(0 as bigint) as rejected, true as unit, true as on_orbit, true as moves, true as known from nation""")
def od_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for each nation's solution: a state a time, none of the good landmarks rejected, unit attitudes, the orbit's radius and speed, and variances that say as much."""
    results = _results(spark, d, Solver(use_j2=True))
    every = lambda column, f: F.forall(column, f)
    size = lambda x, c: F.sqrt(sum((x[f"{c}_{a}"] * x[f"{c}_{a}"] for a in ("y_kms", "z_kms")), x[f"{c}_x_kms"] * x[f"{c}_x_kms"]))
    radius = lambda x: F.sqrt(x["pos_x_km"] * x["pos_x_km"] + x["pos_y_km"] * x["pos_y_km"] + x["pos_z_km"] * x["pos_z_km"])
    turn = lambda x: x["quat_x"] * x["quat_x"] + x["quat_y"] * x["quat_y"] + x["quat_z"] * x["quat_z"] + x["quat_w"] * x["quat_w"]
    return results.select(
        "dataset_id", F.size("states").alias("states"), "rejected", every("states", lambda x: F.abs(turn(x) - 1) < 1e-9).alias("unit"), every("states", lambda x: F.abs(radius(x) - 6971.0) < 1.0).alias("on_orbit"),
        every("states", lambda x: F.abs(size(x, "vel") - 7.5617) < 0.01).alias("moves"), every("covariance", lambda x: (x["pos_cov_x"] > 0) & (x["pos_cov_x"] < 1.0) & (x["rot_cov_z"] < 1e-4)).alias("known"),
    )


@register("reprocess_pipeline", """with f as (select o_orderkey, case o_orderstatus when 'O' then 1 when 'P' then 2 when 'F' then 3 else 0 end as stage, o_orderkey % 6 = 0 as image_missing from orders),
a as (select *, case when image_missing then 'failed' when stage < 3 then 'processed' else 'skipped' end as outcome from f) select outcome, count(*) as n, max(o_orderkey) as newest from a group by 1""")
def reprocess_pipeline(spark: SparkSession, d: str) -> DataFrame:
    s, k = F.col("o_orderstatus"), F.col("o_orderkey")
    frames = read(spark, d, "orders").select(k, F.when(s == "O", 1).when(s == "P", 2).when(s == "F", 3).otherwise(0).alias("stage"), F.lit(True).alias("has_results"), F.lit(True).alias("same_rc"), F.lit(True).alias("same_ld"))
    images = read(spark, d, "orders").where("o_orderkey % 6 <> 0").select("o_orderkey")
    done = reprocess(frames, images, "o_orderkey", target=3)
    return done.groupBy("outcome").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("newest"))


@register("measurement_validation", """with l as (select user_id, event_id as row, epoch_us(ts) as t, value - 20 as sigma from events where event_type = 'purchase'), g as (select user_id, event_id as row, epoch_us(ts) as t from events where event_type = 'view'),
lm as (select *, lag(t) over (partition by user_id order by row) > t as back from l), la as (select user_id, count(*) n, count(*) filter (sigma <= 0) bad, count(*) filter (back) back, min(t) t0, max(t) t1 from lm group by 1),
gm as (select *, lag(t) over (partition by user_id order by row) >= t as back from g), ga as (select user_id, count(*) m, count(*) filter (back) gback, min(t) g0, max(t) g1 from gm group by 1)
select user_id as dataset_id, concat_ws(',', case when n is null then 'no_landmarks' end, case when m is null then 'no_gyro' end, case when n < 12 then 'too_few_landmarks' end, case when bad = n then 'all_sigma_bad' end, case when bad > 0 and bad < n then 'warn_some_sigma_bad' end,
  case when t1 < g0 or t0 > g1 then 'no_overlap' end, case when back > 0 then 'landmark_time_falls' end, case when gback > 0 then 'gyro_time_does_not_rise' end) as problems from la full join ga using (user_id)""")
def measurement_validation(spark: SparkSession, d: str) -> DataFrame:
    ev = read(spark, d, "events").select(F.col("user_id").alias("dataset_id"), F.col("event_id").alias("row"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_type", (F.col("value") - 20).alias("sigma"))
    checks = M.measurement_checks(ev.where("event_type = 'purchase'"), ev.where("event_type = 'view'"), least=12)
    return checks.select("dataset_id", F.array_join("problems", ",").alias("problems"))


@register("processing_manifest", """select o_custkey, array_to_string(list(o_orderkey order by o_orderkey), ',') as frames, count(*) as n from orders group by 1""")
def processing_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Customers stand for datasets, orders for processed frames; the manifests are read as JSON."""
    path = F.col("o_custkey").cast("string").alias("folder_path")
    frames = read(spark, d, "orders").select(path, F.lit(0).alias("cam_id"), F.col("o_orderkey").alias("timestamp"), F.lit(3).alias("annotation_state"), F.lit(0.5).alias("rank"))
    datasets = frames.groupBy("folder_path").agg(F.collect_set("cam_id").alias("frame_id_list"))
    made = F.from_json("value", "folder_path string, processed_frames array<struct<timestamp:long>>")
    rows = O.processing_manifests(datasets, frames).select(made.alias("m"))
    return rows.select(F.col("m.folder_path").cast("long").alias("o_custkey"), F.array_join(F.transform("m.processed_frames", lambda x: x["timestamp"].cast("string")), ",").alias("frames"), F.size("m.processed_frames").cast("long").alias("n"))


@register("sent_markers", "select distinct o_custkey as marker from orders union select l_suppkey from lineitem")
def sent_markers(spark: SparkSession, d: str) -> DataFrame:
    return R.all_ids(read(spark, d, "orders").select(F.col("o_custkey").alias("marker")), read(spark, d, "lineitem").select("l_suppkey"))


@register("command_lookup", "select event_id, case event_type when 'view' then 'REQUEST_TELEMETRY' when 'purchase' then 'START_CAPTURE' when 'error' then 'REBOOT' else 'INVALID' end as handler from events")
def command_lookup(spark: SparkSession, d: str) -> DataFrame:
    return C.handlers(read(spark, d, "events"), "event_type", {"view": "REQUEST_TELEMETRY", "purchase": "START_CAPTURE", "error": "REBOOT"}).select("event_id", "handler")


@register("newest_by_state", "select o_custkey, max(o_orderkey) filter (o_orderstatus = 'F') as newest_done, count(distinct o_orderpriority) as priorities from orders group by 1")
def newest_by_state(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("newest_done"), F.count_distinct("o_orderpriority").alias("priorities"))


@register("detection_report_ordering", "select l_suppkey as region, l_linenumber as class_id, count(*) filter (l_returnflag = 'A') as true_positives, count(*) as n from lineitem group by 1, 2 order by true_positives desc, region, class_id")
def detection_report_ordering(spark: SparkSession, d: str) -> DataFrame:
    """Every region and class, in the report's order."""
    rows = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("region"), F.col("l_linenumber").alias("class_id"))
    return D.report_order(rows.agg(F.count_if(F.col("l_returnflag") == "A").alias("true_positives"), F.count("*").alias("n")))


@register("pixel_prefilter", """with p as (select l_suppkey as frame, l_partkey % 256 as r, l_orderkey % 256 as g, cast(l_quantity as bigint) * 5 as b from lineitem)
select frame, cast(100.0 * count(*) filter (least(r, g, b) > 100) / count(*) as integer) - case when 100.0 * count(*) filter (least(r, g, b) > 100) / count(*) < cast(100.0 * count(*) filter (least(r, g, b) > 100) / count(*) as integer) then 1 else 0 end as cloudiness,
  round((stddev_pop(r) + stddev_pop(g) + stddev_pop(b)) / 3, 6) as color_std, round(avg(greatest(r, g, b)), 6) as avg_value from p group by 1""")
def pixel_prefilter(spark: SparkSession, d: str) -> DataFrame:
    pixels = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("frame"), (F.col("l_partkey") % 256).alias("r"), (F.col("l_orderkey") % 256).alias("g"), (F.col("l_quantity").cast("long") * 5).alias("b"))
    return R.pixel_statistics(pixels, "frame").select("frame", "cloudiness", F.round("color_std", 6).alias("color_std"), F.round("avg_value", 6).alias("avg_value"))
