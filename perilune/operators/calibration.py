"""Camera calibration reports: exposure metrics, preflight stability, the best candidate of a sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilune.operators.frames import sweep_best
from perilune.operators.sequence import closest_to_median, first_stable


def exposure_metrics(pixels: DataFrame, frame: str) -> DataFrame:
    """Mean luminance, percent over 250 and under 5, and the ratios of red and blue to green, from one row a pixel."""
    y = 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")
    rows = pixels.select(frame, y.alias("_y"), "r", "g", "b")
    agg = rows.groupBy(frame).agg(F.avg("_y").alias("luminance"), (F.count_if(F.col("_y") > 250) * 100.0 / F.count("*")).alias("saturated_pct"), (F.count_if(F.col("_y") < 5) * 100.0 / F.count("*")).alias("dark_pct"), F.avg("r").alias("_r"), F.avg("g").alias("_g"), F.avg("b").alias("_b"))
    return agg.select(frame, "luminance", "saturated_pct", "dark_pct", *(F.when(F.col("_g") > 0, F.col(f"_{c}") / F.col("_g")).alias(f"{c}g_ratio") for c in "rb"))


def blurred(pixels: DataFrame, frame: str, threshold: float = 50.0) -> DataFrame:
    """Whether the variance of the Laplacian of a gray image (frame, x, y, gray) is under the threshold; neighbours beyond an edge are mirrored."""
    size = pixels.groupBy(frame).agg(F.max("x").alias("_w"), F.max("y").alias("_h"))
    p = pixels.join(size, frame)
    mirror = lambda c, top: F.when(c < 0, -c).when(c > top, 2 * top - c).otherwise(c)
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(k).alias("k")) for dx, dy, k in ((0, 0, -4), (1, 0, 1), (-1, 0, 1), (0, 1, 1), (0, -1, 1))))
    asked = p.select(frame, "x", "y", "_w", "_h", F.inline(steps)).select(frame, "x", "y", "k", mirror(F.col("x") + F.col("dx"), F.col("_w")).alias("u"), mirror(F.col("y") + F.col("dy"), F.col("_h")).alias("v"))
    near = pixels.select(frame, F.col("x").alias("u"), F.col("y").alias("v"), F.col("gray").cast("double").alias("_g"))
    laplacian = asked.join(near, [frame, "u", "v"]).groupBy(frame, "x", "y").agg(F.sum(F.col("k") * F.col("_g")).alias("_l"))
    return laplacian.groupBy(frame).agg(F.var_pop("_l").alias("variance")).withColumn("blurred", F.col("variance") < threshold)


def calibration(metrics: DataFrame, session: str, step: str, candidate: str, target: float = 110.0, stable_rows: int = 5, stable_under: int = 200) -> DataFrame:
    """Per session: when luminance (in hundredths) is stable first, the frame nearest its median, and the best candidate."""
    whole = metrics.withColumn("_l", F.floor(F.col("luminance") * 100).cast("long"))
    stable = first_stable(whole, session, [step], "_l", stable_rows, stable_under)
    typical = closest_to_median(metrics, session, "luminance", step).select(session, F.col(step).alias("typical"))
    best = sweep_best(metrics, session, candidate, F.col("luminance"), target, F.col("saturated_pct"), F.col("dark_pct"))
    return stable.join(typical, session).join(best, session)
