"""Operators on series of attitudes: rates between neighbours, what a gyro leaves of each turn, landmarks against the states nearest in time.

Quaternions are four columns, xyzw. Series may be cut into stretches of time (`width`): neighbours across a cut come from one row a
stretch, so a key with very many rows is spread over tasks. Rows with a null key or time are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perilune.functions import quaternion as Q
from perilune.operators.measure import outliers
from perilune.operators.sequence import asof


def neighbours(rows: DataFrame, key: str, time: str, values: list[str], width: int | float | None = None) -> DataFrame:
    """Adds _before and _after: time (t) and values of the rows next to each in its key, null at the ends. Rows of equal time are ordered by their values."""
    rows = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn("_p", F.struct(F.col(time).alias("t"), *values))
    parts = [key]
    if width is not None:
        rows, parts = rows.withColumn("_s", F.floor(F.col(time) / width)), [key, "_s"]
        cuts = Window.partitionBy(key).orderBy("_s")
        ends = rows.groupBy(key, "_s").agg(F.min("_p").alias("first"), F.max("_p").alias("last"))
        ends = ends.select(key, "_s", F.lag("last").over(cuts).alias("_lo"), F.lead("first").over(cuts).alias("_hi"))
    order = Window.partitionBy(*parts).orderBy("_p")
    rows = rows.withColumns({"_before": F.lag("_p").over(order), "_after": F.lead("_p").over(order)})
    if width is not None:
        rows = rows.join(ends, [key, "_s"]).withColumns({"_before": F.coalesce("_before", "_lo"), "_after": F.coalesce("_after", "_hi")})
    return rows.drop("_p", "_s", "_lo", "_hi")


def _of(side: str, names: list[str]) -> tuple[Column, ...]:
    return tuple(F.col(side)[c] for c in names)


def _between(a: str | Column, b: str | Column) -> Column:
    return F.nullif((F.col(b) - F.col(a)).cast("double"), F.lit(0.0))


def attitude_rates(rows: DataFrame, key: str, time: str, q: list[str], width: int | float | None = None) -> DataFrame:
    """Adds rate_x, rate_y, rate_z: twice the vector part of the turn to the next row, over the time between.

    A key's last row takes the turn from the row before, as does one whose next row has the same time; a lone row has 0.
    """
    here = tuple(F.col(c) for c in q)
    rate = lambda a, b, dt: [2 * x / dt for x in Q.product_xyzw(Q.conjugate_xyzw(a), b)[:3]]
    ahead = rate(here, _of("_after", q), _between(time, "_after.t"))
    back = rate(_of("_before", q), here, _between("_before.t", time))
    found = [F.coalesce(a, b, F.lit(0.0)).alias(f"rate_{n}") for n, a, b in zip("xyz", ahead, back, strict=True)]
    return neighbours(rows, key, time, q, width).select(*rows.columns, *found)


def gyro_residuals(
    rows: DataFrame, key: str, time: str, q: list[str], gyro: list[str], bias: tuple[float, float, float] = (0.0, 0.0, 0.0), sigma: float = 1.0, width: int | float | None = None
) -> DataFrame:
    """Each row that has a next one, with res_rot_x, res_rot_y, res_rot_z: what the gyro's turn leaves of the turn to the next attitude, over sigma and the time between. Null between rows of equal time."""
    near = neighbours(rows, key, time, q, width).where("_after is not null").withColumn("_dt", _between(time, "_after.t"))
    turn = Q.angle_axis_xyzw(tuple((F.col(g) - b) * F.col("_dt") for g, b in zip(gyro, bias, strict=True)))
    near = near.withColumns({f"_e{i}": c for i, c in enumerate(turn)})
    moved = Q.product_xyzw(tuple(F.col(c) for c in q), tuple(F.col(f"_e{i}") for i in range(4)))
    near = near.withColumns({f"_m{i}": c for i, c in enumerate(moved)})
    left = Q.product_xyzw(Q.conjugate_xyzw(tuple(F.col(f"_m{i}") for i in range(4))), _of("_after", q))[:3]
    return near.select(*rows.columns, *((x / (sigma * F.col("_dt"))).alias(f"res_rot_{n}") for n, x in zip("xyz", left, strict=True)))


def landmark_residuals(
    landmarks: DataFrame, states: DataFrame, key: str, time: str, place: list[str], bearing: list[str], state_place: list[str], state_q: list[str],
    sigma: Column, more: tuple[str, ...] = (), threshold: float = 5.0, width: int | float | None = None,
) -> DataFrame:
    """Each landmark with the state nearest in time (columns s_...; the earlier one on ties, the end states beyond the ends), its residual res_x, res_y, res_z, the norm and whether it is an outlier.

    Thus landmarks that a solution left out are evaluated anew at it. A landmark at the state's own place, or without a state, has null residuals. more: further columns of the states.
    """
    rows = asof(landmarks, states, key, time, [*state_place, *state_q, *more], prefix="s_", width=width)
    rows = rows.withColumns({f"_d{i}": F.col(p) - F.col(f"s_{r}") for i, (p, r) in enumerate(zip(place, state_place, strict=True))})
    rows = rows.withColumn("_far", F.nullif(Q.norm(tuple(F.col(f"_d{i}") for i in range(3))), F.lit(0.0)))
    seen = Q.inverse_rotate_xyzw(tuple(F.col(f"s_{c}") for c in state_q), tuple(F.col(f"_d{i}") / F.col("_far") for i in range(3)))
    rows = rows.withColumns({f"res_{n}": (s - F.col(b)) / sigma for n, s, b in zip("xyz", seen, bearing, strict=True)}).drop("_d0", "_d1", "_d2", "_far")
    return outliers(rows, ["res_x", "res_y", "res_z"], threshold)
