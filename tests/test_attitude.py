import numpy as np
import pytest
from pyspark.sql import functions as F

from perilune.operators import attitude as A
from perilune.plans import orbit
from perilune.sources.config import Solver

Q = ["x", "y", "z", "w"]


@pytest.fixture(scope="module")
def series():
    g = np.random.default_rng(5)
    t = np.cumsum(g.uniform(0.2, 3.0, 60))
    q = g.normal(size=(60, 4))
    return t, q / np.linalg.norm(q, axis=1, keepdims=True), g.normal(size=(60, 3)), 7000 * g.normal(size=(60, 3))


def frame(spark, series):
    t, q, gyro, r = series
    rows = [("a", float(t[i]), *map(float, (*q[i], *gyro[i], *r[i]))) for i in range(len(t))]
    rows += [("lone", 1.0, 0.0, 0.0, 0.0, 1.0, *[0.0] * 6), (None, 1.0, *rows[0][2:]), ("a", None, *rows[0][2:])]
    names = "x double, y double, z double, w double, gx double, gy double, gz double, rx double, ry double, rz double"
    return spark.createDataFrame(rows, f"k string, t double, {names}")


@pytest.mark.parametrize("width", [None, 7])
def test_rates_and_gyro_residuals_equal_the_solver(spark, series, width):
    t, q, gyro, r = series
    bias = (0.01, -0.02, 0.03)
    rates = A.attitude_rates(frame(spark, series), "k", "t", Q, width).collect()
    assert [(x.rate_x, x.rate_y, x.rate_z) for x in rates if x.k == "lone"] == [(0.0, 0.0, 0.0)] and len(rates) == 61
    got = np.array([(x.rate_x, x.rate_y, x.rate_z) for x in sorted((x for x in rates if x.k == "a"), key=lambda x: x.t)])
    want = 2 * orbit.q_mul(orbit.q_conj(q[:-1]), q[1:])[:, :3] / np.diff(t)[:, None]
    assert np.allclose(got, np.vstack([want, want[-1:]]), atol=1e-12)
    s = Solver()
    p = orbit.Problem(t, gyro, np.zeros(1, dtype=int), r[:1], r[:1], np.ones(1), s)
    left = A.gyro_residuals(frame(spark, series), "k", "t", Q, ["gx", "gy", "gz"], bias, s.gyro_sigma, width).orderBy("t").collect()
    got = np.array([(x.res_rot_x, x.res_rot_y, x.res_rot_z) for x in left])
    assert np.allclose(got, p.turn(q[:-1], q[1:], np.array(bias)), rtol=1e-9, atol=1e-9)


def test_rows_of_equal_time_have_no_rate_of_their_own(spark):
    rows = [("a", 0.0, 0.0, 0.0, 0.0, 1.0), ("a", 0.0, 0.0, 0.0, 0.0, 1.0), ("a", 2.0, 0.0, 0.0, 1.0, 0.0)]
    got = A.attitude_rates(spark.createDataFrame(rows, "k string, t double, x double, y double, z double, w double"), "k", "t", Q).collect()
    assert sorted(r.rate_z for r in got) == [0.0, 1.0, 1.0]
    assert A.attitude_rates(spark.createDataFrame([], "k string, t double, x double, y double, z double, w double"), "k", "t", Q, 5).count() == 0


@pytest.mark.parametrize("width", [None, 7])
def test_left_out_landmarks_are_evaluated_at_the_nearest_state(spark, series, width):
    t, q, _, r = series
    g = np.random.default_rng(6)
    at = np.concatenate([g.uniform(-5, t[-1] + 5, 40), (t[:5] + t[1:6]) / 2])
    place, bearing = 6371 * g.normal(size=(45, 3)), g.normal(size=(45, 3))
    rows = [("a", i, float(at[i]), *map(float, (*place[i], *bearing[i]))) for i in range(45)]
    seen = spark.createDataFrame(rows, "k string, id long, t double, px double, py double, pz double, bx double, by double, bz double")
    got = A.landmark_residuals(seen, frame(spark, series), "k", "t", ["px", "py", "pz"], ["bx", "by", "bz"], ["rx", "ry", "rz"], Q, F.lit(0.5), width=width).orderBy("id").collect()
    state = orbit.nearest_states(t, at)
    want = orbit.residuals_at({"estimate": orbit.Estimate(None, None, None, q, None, 0.0, r, None)}, state, place, bearing, np.full(45, 0.5))
    assert np.allclose([(x.res_x, x.res_y, x.res_z) for x in got], want, atol=1e-9)
    assert [x.s_t for x in got] == t[state].tolist()
    assert [x.outlier for x in got] == (np.linalg.norm(want, axis=1) > 5).tolist()
