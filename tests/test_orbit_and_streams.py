import json
import os

import numpy as np
import pandas as pd
import pytest

from perilune.functions.nav import GM_EARTH, J2, R_EARTH
from perilune.plans import orbit as O
from perilune.plans.orbit import covariance, determine_orbits, gravity, nearest_states, simulate, solve_with_rejection
from perilune.sources.config import Solver
from perilune.streaming import stateful, telemetry


def test_nearest_state_ties_are_early():
    assert nearest_states(np.array([0.0, 10.0, 20.0]), np.array([-5.0, 5.0, 5.1, 15.0, 99.0])).tolist() == [0, 0, 1, 1, 2]


def test_solver_recovers_the_truth_and_rejects_outliers():
    m = simulate(n=8, landmarks=5)
    b = m["bearing"].copy()
    b[7] = -b[7]
    found, bad = solve_with_rejection(m["t"], m["gyro"], m["state"], m["eci"], b, m["sigma"], Solver())
    assert np.flatnonzero(bad).tolist() == [7]
    assert np.abs(found["r"] - m["r"]).max() < 0.1 and np.abs(found["bias"] - m["bias"]).max() < 1e-5
    assert np.allclose(np.linalg.norm(found["q"], axis=1), 1) and (covariance(found)["state"] > 0).all()
    # The rejected landmark's residual is taken at the last solution, the others are those of the solution.
    assert np.linalg.norm(found["residual"][7]) > 1000 and np.allclose(np.delete(found["residual"], 7, axis=0), found["landmark"])
    assert [s["n_rejected"] for s in found["solves"]] == [0, 1] and found["initial"][0].shape == found["r"].shape


def dense(p, e):
    """Rows of the whole linearised problem, by differences: unknowns r0, v0, accelerations, attitudes, bias and drag."""
    w = np.repeat((1 + (p.landmark(e) ** 2).sum(axis=1) / p.s.huber**2) ** -0.25, 3)

    def rows(e):
        parts = [p.landmark(e).ravel() * w, p.turn(e.q[:-1], e.q[1:], e.bias).ravel(), e.extra.ravel() / p.s.acceleration_sigma]
        return np.concatenate([*parts, [(e.cd - p.s.cd_nominal) / p.s.cd_sigma]] if p.drag else parts)

    def changed(k, h):
        x = np.zeros(6 + 3 * (p.n - 1) + 3 * p.n + 4)
        x[k] = h
        a, b = 6 + 3 * (p.n - 1), 6 + 3 * (p.n - 1) + 3 * p.n
        q = O.q_mul(e.q, O.q_exp(x[a:b].reshape(-1, 3)))
        return p.rolled(O.Estimate(e.r0 + x[:3], e.v0 + x[3:6], e.extra + x[6:a].reshape(-1, 3), q, e.bias + x[b : b + 3], e.cd + x[-1]))

    n = 6 + 3 * (p.n - 1) + 3 * p.n + 3 + p.drag
    h = [1e-2] * 3 + [1e-5] * 3 + [1e-7] * (3 * (p.n - 1)) + [1e-6] * (3 * p.n + 3) + [1e-3]
    return np.array([(rows(changed(k, h[k])) - rows(changed(k, -h[k]))) / (2 * h[k]) for k in range(n)]).T, rows(e)


@pytest.mark.parametrize("settings", [{}, {"use_j2": True, "integrator": "euler"}, {"use_drag": True, "use_j2": True}])
def test_sweeps_solve_the_whole_problem(settings):
    """One step and the variances equal those of dense least squares over all unknowns."""
    m, s = simulate(n=5, landmarks=5), Solver(**settings)
    p = O.Problem(m["t"], m["gyro"], m["state"], m["eci"], m["bearing"], m["sigma"], s)
    e = p.rolled(O.Estimate(m["r"][0] + [0.5, -0.3, 0.2], m["v"][0] + 1e-3, np.full((4, 3), 1e-6), m["q"], m["bias"] + 1e-5, 2.3))
    j, f = dense(p, e)
    x = np.linalg.lstsq(j / (scale := np.linalg.norm(j, axis=0)), -f, rcond=None)[0] / scale
    got = O.step(p, e, 0.0)
    assert np.allclose(got.r0 - e.r0, x[:3], rtol=1e-4, atol=1e-6) and np.allclose(got.v0 - e.v0, x[3:6], rtol=1e-4, atol=1e-8)
    assert np.allclose((got.extra - e.extra).ravel(), x[6:18], rtol=1e-4, atol=1e-10)
    assert np.allclose(got.bias - e.bias, x[33:36], rtol=1e-4, atol=1e-10) and (not p.drag or np.isclose(got.cd - e.cd, x[36], rtol=1e-4, atol=1e-9))
    var = covariance({"problem": p, "estimate": e})
    want = np.diag(np.linalg.pinv((j / scale).T @ (j / scale), rcond=1e-16)) / scale**2
    assert np.allclose(var["state"][0][:6], want[:6], rtol=1e-3) and np.allclose(var["state"][:, 6:].ravel(), want[18:33], rtol=1e-3) and np.allclose(var["bias"], want[33:36], rtol=1e-3)
    assert var["cd"] is None if not p.drag else np.isclose(var["cd"], want[36], rtol=1e-3)


@pytest.mark.parametrize("settings", [{"use_j2": True}, {"use_j2": True, "use_drag": True}, {"use_drag": True, "integrator": "rk4"}])
def test_truth_is_recovered_with_further_forces(settings):
    m = simulate(n=30, landmarks=6, j2=settings.get("use_j2", False), cd=2.2 if settings.get("use_drag") else None)
    found, bad = solve_with_rejection(m["t"], m["gyro"], m["state"], m["eci"], m["bearing"], m["sigma"], Solver(**settings))
    var = covariance(found)["state"]
    assert not bad.any() and np.abs(found["r"] - m["r"]).max() < 0.1 and np.abs((found["r"] - m["r"]) / np.sqrt(var[:, :3])).mean() < 2
    assert np.abs(O.dynamics_residuals(found)[:, :3]).max() < 1e-2


def test_long_passes_are_solved_in_time():
    """3,000 states, some 27,000 unknowns: steps whose time and memory follow the number of states."""
    import time

    m = simulate(n=3000, dt=1.0, landmarks=3)
    begun = time.time()
    p = O.Problem(m["t"], m["gyro"], m["state"], m["eci"], m["bearing"], m["sigma"], Solver())
    e = p.rolled(O.Estimate(m["r"][0] + 0.5, m["v"][0], np.zeros((2999, 3)), m["q"], m["bias"], 2.2))
    after = O.step(p, e, 0.0)
    assert p.cost(after) < p.cost(e) and np.abs(after.r - m["r"]).max() < 0.1 and time.time() - begun < 30


def test_results_hold_tables_and_a_summary(spark, tmp_path):
    from perilune.sources.outputs import read_results, write_results

    m = simulate(n=5, landmarks=4)
    marks = pd.DataFrame({"t": m["t"][m["state"]], **{f"bearing_{a}": m["bearing"][:, i] for i, a in enumerate("xyz")}, **{f"eci_{a}_km": m["eci"][:, i] for i, a in enumerate("xyz")}, "sigma": m["sigma"], "dataset_id": "a/b"})
    rates = pd.DataFrame({"t": m["t"], **{f"w{a}": m["gyro"][:, i] for i, a in enumerate("xyz")}, "dataset_id": "a/b"})
    s = Solver(use_drag=True)
    results = O.orbit_results(spark.createDataFrame(marks), spark.createDataFrame(rates), s).cache()
    tables = O.result_tables(results)
    assert {k: t.count() for k, t in tables.items()} == {"state_estimates": 5, "initial_trajectory": 5, "covariance": 5, "dynamics_residuals": 4, "landmark_residuals": 20}
    value = json.loads(O.result_documents(results, s).first().value)
    assert value["outputs"] == {"num_state_estimates": 5, "covariance_available": True, "od_solver_calls": 1, "landmarks_rejected": 0} and value["config"]["use_drag"] and value["estimates"]["cd_var"] > 0
    assert value["estimates"]["pos_x_km"] == pytest.approx(m["r"][-1][0], abs=0.1) and value["solver"]["return_status"] == "converged"
    write_results({**tables, "od_result": O.result_documents(results, s)}, str(tmp_path))
    back = read_results(spark, str(tmp_path))
    assert {k: t.count() for k, t in back.items()} == {**{k: t.count() for k, t in tables.items()}, "od_result": 1}
    assert back["state_estimates"].columns[0] == "timestamp_j2000" and json.loads(back["od_result"].first().value)["dataset_folder"] == "a/b"
    none = O.orbit_results(spark.createDataFrame(marks).limit(0), spark.createDataFrame(rates).limit(0))
    assert none.count() == 0 and O.result_documents(none).count() == 0


def test_force_settings_are_obeyed():
    m = simulate(n=4, landmarks=5)
    solved = lambda **s: solve_with_rejection(m["t"], m["gyro"], m["state"], m["eci"], m["bearing"], m["sigma"], Solver(outlier_rounds=1, **s))[0]
    plain = solved()
    stepped = solved(integrator="euler")
    assert np.abs(solved(use_j2=True)["v"] - plain["v"]).max() > 1e-5
    assert np.allclose(stepped["r"][1:], stepped["r"][:-1] + 10.0 * stepped["v"][:-1], rtol=0, atol=1e-9)
    assert solved(max_iterations=1)["iterations"] == 1
    assert solved(use_drag=True)["cd"] != 2.2 and plain["cd"] == 2.2 and solved(max_seconds=0.0)["status"] == "timeout"
    with pytest.raises(ValueError):
        solved(integrator="none")
    r = np.array([4000.0, -3000.0, 5000.0])
    potential = lambda x: J2 * GM_EARTH * R_EARTH**2 / 2 / np.linalg.norm(x) ** 3 * (1 - 3 * x[2] ** 2 / (x @ x))
    slope = np.array([(potential(r + h) - potential(r - h)) / 2e-2 for h in np.eye(3) * 1e-2])
    assert np.allclose(gravity(r, True) - gravity(r), slope, rtol=1e-4)


def test_datasets_are_solved_apart(spark):
    m = simulate(n=4, landmarks=4)
    marks = pd.DataFrame({"t": m["t"][m["state"]], **{f"bearing_{a}": m["bearing"][:, i] for i, a in enumerate("xyz")}, **{f"eci_{a}_km": m["eci"][:, i] for i, a in enumerate("xyz")}, "sigma": m["sigma"]})
    rates = pd.DataFrame({"t": m["t"], **{f"w{a}": m["gyro"][:, i] for i, a in enumerate("xyz")}})
    landmarks = spark.createDataFrame(pd.concat([marks.assign(dataset_id="a"), marks.head(3).assign(dataset_id="few")]))
    gyro = spark.createDataFrame(pd.concat([rates.assign(dataset_id=k) for k in ("a", "few")]))
    rows = determine_orbits(landmarks, gyro, Solver(outlier_rounds=1)).collect()
    assert {r.dataset_id for r in rows} == {"a"} and len(rows) == 4


def run(spark, tmp_path, rows, schema, fn, mode, files=2):
    """Feeds rows through a stream in several files; the sink's last values."""
    folder = tmp_path / "in"
    folder.mkdir()
    step = -(-len(rows) // files)
    for k in range(files):
        (folder / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows[k * step : (k + 1) * step]))
        os.utime(folder / f"{k}.json", (1e9 + k, 1e9 + k))  # files are read in order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
    name = f"t_{tmp_path.name}".replace("-", "_")
    q = fn(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_fixed_rate_windows(spark, tmp_path):
    rows = [{"ts": f"2024-01-01T00:00:{s:02d}.000Z", "k": "a", "v": float(s)} for s in range(0, 40)]
    got = run(spark, tmp_path, rows, "ts timestamp, k string, v double", lambda s: telemetry.fixed_rate(s, "ts", ["k"], "v", "10 seconds", "5 seconds"), "append")
    assert [(r.n, r.latest) for r in sorted(got, key=lambda r: r.start)][:2] == [(10, 9.0), (10, 19.0)]


def test_duplicates_within_watermark(spark, tmp_path):
    rows = [{"ts": "2024-01-01T00:00:00Z", "c": "x"}, {"ts": "2024-01-01T00:00:10Z", "c": "x"}, {"ts": "2024-01-01T00:00:20Z", "c": "y"}, {"ts": "2024-01-01T00:00:21Z", "c": "x"}]
    assert sorted(r.c for r in run(spark, tmp_path, rows, "ts timestamp, c string", lambda s: telemetry.deduplicated(s, ["c"], "ts"), "append")) == ["x", "y"]


SESSION = "dataset_id string, t double, start double, period double, target long"


def latest(got, key):
    """The last row of each key; a memory sink in update mode appends."""
    return {r[key]: r for r in got}


def test_collection_session_stops_at_the_target(spark, tmp_path):
    rows = [{"dataset_id": "a", "t": float(t), "start": 1.0, "period": 60.0, "target": 3} for t in (0, 1, 2, 3, 4, 5)] + [{"dataset_id": "b", "t": t, "start": 0.0, "period": 5.0, "target": 9} for t in (1.0, 7.0)]
    got = latest(run(spark, tmp_path, rows, SESSION, stateful.collection_sessions, "update"), "dataset_id")
    assert {k: (r.counted, r.status) for k, r in got.items()} == {"a": (3, "complete"), "b": (1, "expired")}


def test_sessions_expire_without_a_further_frame(spark, tmp_path):
    rows = [{"dataset_id": "a", "t": 1.0, "start": 0.0, "period": 5.0, "target": 3}, {"dataset_id": "other", "t": 2.0, "start": 0.0, "period": 900.0, "target": 9}]
    rows += [{"dataset_id": "other", "t": t, "start": 0.0, "period": 900.0, "target": 9} for t in (50.0, 60.0)]
    got = latest(run(spark, tmp_path, rows, SESSION, stateful.collection_sessions, "update"), "dataset_id")
    assert (got["a"].counted, got["a"].status) == (1, "expired") and got["other"].status == "running"


TRANSFER = "tid long, t double, seq long, kind string, fragments long, bitmap long"


def transfer(tid, *events):
    """(t, kind, number) -> rows."""
    return [{"tid": tid, "t": 1000.0 + t, "seq": k, "kind": kind, "fragments": n if kind == "start" else None, "bitmap": n if kind == "confirm" else None} for k, (t, kind, n) in enumerate(events)]


def test_downlink_sends_what_is_missing_until_it_stalls(spark, tmp_path):
    all_of = lambda n: (1 << n) - 1
    rows = transfer(1, (0, "start", 50), (1, "ack", 0), (2, "ack", 0), (3, "confirm", all_of(40) & ~5), (4, "confirm", all_of(12)))  # two of the first burst are sent again
    rows += transfer(2, (0, "start", 50), (1, "ack", 0), (2, "ack", 0), *((3 + k, "confirm", 0) for k in range(5)))
    rows += transfer(3, (0, "confirm", 9)) + transfer(4, (0, "start", 0), (1, "ack", 0), (2, "ack", 0))
    got = latest(run(spark, tmp_path, rows, TRANSFER, stateful.downlink, "update", files=1), "tid")
    assert {k: (r.status, r.reason, r.bursts, r.missing) for k, r in got.items()} == {1: ("done", "", 2, 0), 2: ("failed", "stalled_progress", 5, 50), 3: ("idle", "", 0, 0), 4: ("done", "", 0, 0)}


def test_downlink_gives_up_in_time(spark, tmp_path):
    rows = transfer(1, (0, "start", 5)) + transfer(2, (0, "start", 5), (7, "ack", 0)) + transfer(3, (0, "start", 5), (1, "ack", 0), (2, "ack", 0)) + transfer(4, (0, "start", 5), (4, "ack", 0), (5, "ack", 0))
    rows = sorted(rows, key=lambda r: r["t"]) + transfer(4, (21, "confirm", 31)) + transfer(9, (40, "start", 1), (41, "ack", 0))
    got = latest(run(spark, tmp_path, rows, TRANSFER, stateful.downlink, "update"), "tid")
    assert {k: (got[k].status, got[k].reason, got[k].repeated) for k in (1, 2, 3, 4)} == {1: ("failed", "create_ack_timeout", 3), 2: ("failed", "init_ack_timeout", 5), 3: ("failed", "confirm_timeout", 0), 4: ("done", "", 1)}


def test_chunk_transfer_waits_and_fails_in_time(spark, tmp_path):
    events = [("ack", 1), ("nack", 2), ("ack", 1), ("ack", 2)]
    rows = [{"tid": 1, "t": 1000.0 + i, "seq": i, "kind": k, "chunk": c, "chunks": 2} for i, (k, c) in enumerate(events)]
    rows += [{"tid": 2, "t": 1000.0, "seq": 0, "kind": "ack", "chunk": 1, "chunks": 3}, {"tid": 3, "t": 1060.0, "seq": 0, "kind": "ack", "chunk": 1, "chunks": 9}]
    got = latest(run(spark, tmp_path, rows, "tid long, t double, seq long, kind string, chunk long, chunks long", stateful.chunk_transfer, "update"), "tid")
    assert {k: (r.next_chunk, r.resent, r.status) for k, r in got.items()} == {1: (3, 1, "done"), 2: (2, 0, "failed"), 3: (2, 0, "sending")}


def test_state_machines_and_their_timers(spark, tmp_path):
    rows = [{"key": "h", "t": 1000.0 + i, "seq": i, "event": e} for i, e in enumerate(["booted", "power_on", "booted", "shutdown"])]
    rows += [{"key": "slow", "t": 1000.0, "seq": 0, "event": "power_on"}, {"key": "z", "t": 1130.0, "seq": 0, "event": "power_on"}, {"key": "z", "t": 1131.0, "seq": 1, "event": "booted"}]
    got = latest(run(spark, tmp_path, rows, "key string, t double, seq long, event string", lambda s: stateful.machine(s, stateful.POWER, "off", stateful.POWER_TIMERS), "update"), "key")
    assert {k: (r.state, r.rejected, r.expired) for k, r in got.items()} == {"h": ("off", 1, 1), "slow": ("off", 0, 1), "z": ("ready", 0, 0)}


def test_updates_that_were_not_taken_are_overruns(spark, tmp_path):
    rows = [{"key": "k", "t": 1000.0 + i, "seq": i, "kind": kind, "value": float(i)} for i, kind in enumerate(["update", "update", "take", "update", "update", "update"])]
    got = run(spark, tmp_path, rows, "key string, t double, seq long, kind string, value double", stateful.overruns, "update")
    assert (got[-1].value, got[-1].waiting, got[-1].overruns) == (5.0, True, 3)


def test_unhealthy_cameras_are_restarted_at_checks(spark, tmp_path):
    rows = [{"camera": c, "t": 1000.0 + t, "status": s, "error": e} for c, t, s, e in [("a", 0.0, "active", ""), ("a", 100.0, "active", "READ"), ("b", 0.0, "inactive", "x"), ("c", 0.0, "lost", ""), ("d", 0.0, "active", None), ("d", 1100.0, "active", None)]]
    got = latest(run(spark, tmp_path, rows, "camera string, t double, status string, error string", stateful.health_checks, "update", files=3), "camera")
    assert {k: (r.status, r.restarts) for k, r in got.items()} == {"a": ("active", 1), "b": ("inactive", 0), "c": ("active", 1), "d": ("active", 0)}


def test_ended_keys_are_evicted(spark, tmp_path):
    """A transfer number is used again long after its transfer ended: it begins anew."""
    far = stateful.HELD + 100
    rows = transfer(1, (0, "start", 1), (1, "ack", 0), (2, "ack", 0), (3, "confirm", 1)) + transfer(1, (far, "start", 2)) + transfer(1, (far + 1, "ack", 0), (far + 2, "ack", 0))
    got = latest(run(spark, tmp_path, rows, TRANSFER, stateful.downlink, "update", files=3), "tid")
    assert (got[1].status, got[1].missing) == ("sending", 2)


def test_missed_updates_restart(spark, tmp_path):
    rows = [{"host": "h", "seq": i, "changed": c} for i, c in enumerate([True, False, False, False, False])]
    got = run(spark, tmp_path, rows, "host string, seq long, changed boolean", stateful.missed_updates, "update")
    assert (got[-1].misses, got[-1].restarts) == (1, 1)
