"""Operators that build and check orbit-determination measurements."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilune.functions import nav
from perilune.functions.quaternion import wahba


def landmark_measurements(frames: DataFrame, catalogue: DataFrame, cameras: DataFrame, sigma: float | None = None) -> DataFrame:
    """Measurements of all frames: landmarks exploded in order, known ones located by catalogue and camera (both small and checked by Spark's own size limit), bearings in the body frame, positions in km.

    frames: dataset_id, timestamp_ms, cam_id, landmarks; catalogue: region_id, class_id, lon_deg, lat_deg; cameras: cam_id, fx, fy, cx,
    cy, r (nine numbers by row). A group is a frame; the first landmark that is kept opens it.
    """
    rows = frames.select("dataset_id", "timestamp_ms", "cam_id", F.posexplode("landmarks").alias("place", "l")).select("dataset_id", "timestamp_ms", "cam_id", "place", "l.*")
    rows = rows.join(catalogue, ["region_id", "class_id"]).join(cameras, "cam_id")
    f = (F.col("fx") + F.col("fy")) / 2
    bearing = nav.rotate(nav.pixel_bearing(F.col("x"), F.col("y"), F.col("fx"), F.col("fy"), F.col("cx"), F.col("cy")), [F.col("r")[k] for k in range(9)])
    place = nav.geodetic_to_ecef(F.radians("lon_deg"), F.radians("lat_deg"), F.lit(0.0))
    rows = nav.earth_to_inertial(rows.withColumns({f"eci_{a}_km": c for a, c in zip("xyz", place, strict=True)}), [f"eci_{a}_km" for a in "xyz"], F.col("timestamp_ms") / 1000.0)
    order = Window.partitionBy("dataset_id").orderBy("timestamp_ms", "cam_id")
    spread = F.lit(sigma) if sigma is not None else F.least("height", "width") / (6 * f)
    return rows.select(
        "dataset_id", "timestamp_ms", *(c.alias(f"bearing_{a}") for a, c in zip("xyz", bearing, strict=True)), *(f"eci_{a}_km" for a in "xyz"),
        (F.dense_rank().over(order) - 1).cast("int").alias("group"), spread.alias("sigma"), "place",
    )


def measurement_checks(landmarks: DataFrame, gyro: DataFrame, dataset: str = "dataset_id", least: int = 4) -> DataFrame:
    """Per dataset the list of what is wrong; warnings begin with 'warn_'."""
    w, g = Window.partitionBy(dataset).orderBy("row"), Window.partitionBy(dataset).orderBy("row")
    marked = landmarks.withColumn("_back", F.lag("t").over(w) > F.col("t")).groupBy(dataset).agg(
        F.count("*").alias("n"), F.count_if(F.col("sigma") <= 0).alias("bad_sigma"), F.count_if("_back").alias("back"), F.min("t").alias("t0"), F.max("t").alias("t1")
    )
    series = gyro.withColumn("_back", F.lag("t").over(g) >= F.col("t")).groupBy(dataset).agg(F.count("*").alias("m"), F.count_if("_back").alias("g_back"), F.min("t").alias("g0"), F.max("t").alias("g1"))
    rows = marked.join(series, dataset, "full")
    checks = {
        "no_landmarks": F.col("n").isNull(), "no_gyro": F.col("m").isNull(), "too_few_landmarks": F.col("n") < least, "all_sigma_bad": F.col("bad_sigma") == F.col("n"),
        "warn_some_sigma_bad": (F.col("bad_sigma") > 0) & (F.col("bad_sigma") < F.col("n")), "no_overlap": (F.col("t1") < F.col("g0")) | (F.col("t0") > F.col("g1")),
        "landmark_time_falls": F.col("back") > 0, "gyro_time_does_not_rise": F.col("g_back") > 0,
    }
    return rows.select(dataset, F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items()))).alias("problems"))


def group_means(landmarks: DataFrame, key: list[str], position: list[str], radius: float = nav.R_ORBIT_MEAN + nav.ALTITUDE) -> DataFrame:
    """A first guess of the satellite's place for each group: the summed landmark directions, brought to the orbit's radius."""
    s = landmarks.groupBy(*key).agg(*(F.sum(c).alias(c) for c in position))
    n = F.sqrt(sum((F.col(c) * F.col(c) for c in position[1:]), F.col(position[0]) * F.col(position[0])))
    return s.select(*key, *((F.col(c) / n * radius).alias(c) for c in position))


def wahba_sums(rows: DataFrame, key: list[str], reference: list[str], body: list[str]) -> DataFrame:
    """Nine sums of products of reference and body directions: b00 ... b22."""
    return rows.groupBy(*key).agg(*(F.sum(F.col(r) * F.col(b)).alias(f"b{i}{j}") for i, r in enumerate(reference) for j, b in enumerate(body)))


def wahba_attitudes(sums: DataFrame, key: list[str]) -> DataFrame:
    """Best attitudes (q_x, q_y, q_z, q_w) from such sums; one stacked SVD for each Arrow batch."""

    def run(parts):
        for p in parts:
            b = p[[f"b{i}{j}" for i in range(3) for j in range(3)]].to_numpy(dtype=float).reshape(-1, 3, 3)
            q = wahba(b)
            q *= np.where(q[:, 3:] < 0, -1.0, 1.0)
            yield pd.concat([p[key].reset_index(drop=True), pd.DataFrame(q, columns=["q_x", "q_y", "q_z", "q_w"])], axis=1)

    kinds = dict(sums.dtypes)
    return sums.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in key), "q_x double, q_y double, q_z double, q_w double"]))


def outliers(rows: DataFrame, residual: list[str], threshold: float = 5.0) -> DataFrame:
    """Adds the residual's norm and whether it is above the threshold."""
    n = F.sqrt(sum((F.col(c) * F.col(c) for c in residual[1:]), F.col(residual[0]) * F.col(residual[0])))
    return rows.withColumn("norm", n).withColumn("outlier", n > threshold)


def residual_summary(rows: DataFrame, key: list[str], norm: str = "norm", outlier: str = "outlier") -> DataFrame:
    return rows.groupBy(*key).agg(F.max(norm).alias("worst"), F.avg(norm).alias("mean"), F.count_if(outlier).alias("rejected"), F.count("*").alias("n"))


def finite_unit(q: list[Column], values: list[Column], slack: float = 0.05) -> Column:
    """Whether all values are finite and the quaternion's norm is within slack of 1."""
    fine = [~F.isnan(c) & (F.abs(c) < float("inf")) for c in [*q, *values]]
    n = F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0]))
    out = F.abs(n - 1) <= slack
    for c in fine:
        out = out & c
    return F.coalesce(out, F.lit(False))


def objective(rows: DataFrame, key: list[str], acceleration: str, angular: str, landmark: str, m: float = 3.0) -> DataFrame:
    """The estimator's cost from squared, weighted residuals: acceleration and angular terms, and pseudo-Huber landmark terms."""
    return rows.groupBy(*key).agg((F.sum(acceleration) + F.sum(angular) + F.sum(nav.pseudo_huber(F.col(landmark), m))).alias("cost"))


def mean_bias(rows: DataFrame, key: list[str], measured: list[str], attitude: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(*(F.avg(F.col(a) - F.col(b)).alias(f"bias_{k}") for k, (a, b) in zip("xyz", zip(measured, attitude, strict=True), strict=False)))


def propagation_residuals(states: DataFrame, key: Column, order: str, position: list[str], velocity: list[str], dt: Column, step=nav.euler_step, **forces) -> DataFrame:
    """What a step from each state to the next of its key leaves: res_ columns of places and velocities; a key's last state has none."""
    w = Window.partitionBy(key).orderBy(order)
    r, v = step(tuple(F.col(c) for c in position), tuple(F.col(c) for c in velocity), dt, **forces)
    names = [*position, *velocity]
    rows = states.select("*", *(F.lead(c).over(w).alias(f"_n{c}") for c in names), *(x.alias(f"_e{c}") for c, x in zip(names, (*r, *v), strict=True)))
    return rows.where(F.col(f"_n{position[0]}").isNotNull()).select(*states.columns, *((F.col(f"_n{c}") - F.col(f"_e{c}")).alias(f"res_{c}") for c in names))


def looked_up(rows: DataFrame, *tables: tuple[DataFrame, str, str]) -> DataFrame:
    """Rows joined with (table, the rows' column, the table's column): small tables are broadcast where Spark's statistics prove their size, else both sides are shuffled."""
    for table, mine, its in tables:
        rows = rows.join(table, F.col(mine) == F.col(its)).drop(its)
    return rows
