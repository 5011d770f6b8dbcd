"""Orbit determination: initial trajectory, batch least squares with outlier rejection, covariance.

A dataset is one solver job, so datasets are spread over the cluster and each is solved by numpy in a grouped map. The unknowns are
the first state, a small unmodelled acceleration for each interval (propagated by RK4 or Euler steps, with J2 and drag if asked for), one
attitude error vector a state, the gyro bias and, with drag, its coefficient. Landmark residuals have a pseudo-Huber cost.

Each Gauss-Newton step is solved by a square-root information sweep: neighbouring states alone share rows, so they are
eliminated one after the other by small orthogonal transformations. Time and memory follow the number of states, and nothing is squared.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilune.functions.nav import ALTITUDE, ATMOSPHERE, DRAG_AREA, DRAG_MASS, GM_EARTH, J2, OMEGA_EARTH, R_EARTH, R_ORBIT_MEAN
from perilune.functions.quaternion import wahba
from perilune.sources.config import Solver


def q_mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """xyzw; rows pair by pair."""
    ax, ay, az, aw = np.moveaxis(a, -1, 0)
    bx, by, bz, bw = np.moveaxis(b, -1, 0)
    return np.stack([aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz], axis=-1)


def q_exp(v: np.ndarray) -> np.ndarray:
    angle = np.linalg.norm(v, axis=-1, keepdims=True)
    small = angle < 1e-9
    return np.concatenate([v * np.where(small, 0.5, np.sin(angle / 2) / np.where(small, 1.0, angle)), np.cos(angle / 2)], axis=-1)


def q_conj(q: np.ndarray) -> np.ndarray:
    return q * np.array([-1.0, -1.0, -1.0, 1.0])


def to_body(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Vectors seen from the rotated frame; rows pair by pair."""
    u, w = q[..., :3], q[..., 3:]
    t = 2 * np.cross(v, u)
    return v + w * t + np.cross(t, u)


def slerp(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    d = float(a @ b)
    b, d = (b, d) if d >= 0 else (-b, -d)
    if d > 0.9995:
        m = (1 - t) * a + t * b
    else:
        angle = np.arccos(d)
        m = (np.sin((1 - t) * angle) * a + np.sin(t * angle) * b) / np.sin(angle)
    return m / np.linalg.norm(m)


def gravity(x: np.ndarray, j2: bool = False) -> np.ndarray:
    """At places x (rows)."""
    r2 = (x * x).sum(axis=-1, keepdims=True) + 1e-10
    force = -GM_EARTH / r2**1.5 * x
    if j2:
        z = x[..., 2:] ** 2 / r2
        force = force + 1.5 * J2 * GM_EARTH * R_EARTH**2 / r2**2.5 * x * (5 * z - np.array([1.0, 1.0, 3.0]))
    return force


def drag(x: np.ndarray, v: np.ndarray, cd: float | np.ndarray) -> np.ndarray:
    """Of an atmosphere in exponential layers that turns with the Earth; the lowest layer also holds below it, the highest above."""
    h = np.linalg.norm(x, axis=-1, keepdims=True) - R_EARTH
    floor, base, scale = (np.array(c) for c in zip(*ATMOSPHERE, strict=True))
    k = np.clip(np.searchsorted(floor, h, side="right") - 1, 0, len(floor) - 1)
    rel = v - OMEGA_EARTH * np.stack([-x[..., 1], x[..., 0], np.zeros_like(x[..., 0])], axis=-1)
    return -0.5 * cd * DRAG_AREA / DRAG_MASS * base[k] * np.exp(-(h - floor[k]) / scale[k]) * np.linalg.norm(rel, axis=-1, keepdims=True) * rel


def euler(r: np.ndarray, v: np.ndarray, extra: np.ndarray, dt, j2: bool = False, cd=None) -> tuple[np.ndarray, np.ndarray]:
    force = gravity(r, j2) + extra
    return r + dt * v, v + dt * (force if cd is None else force + drag(r, v, cd))


def rk4(r: np.ndarray, v: np.ndarray, extra: np.ndarray, dt, j2: bool = False, cd=None) -> tuple[np.ndarray, np.ndarray]:
    force = lambda x, u: gravity(x, j2) + extra + (0 if cd is None else drag(x, u, cd))
    a1 = force(r, v)
    v2 = v + dt / 2 * a1
    a2 = force(r + dt / 2 * v, v2)
    v3 = v + dt / 2 * a2
    a3 = force(r + dt / 2 * v2, v3)
    v4 = v + dt * a3
    a4 = force(r + dt * v3, v4)
    return r + dt / 6 * (v + 2 * v2 + 2 * v3 + v4), v + dt / 6 * (a1 + 2 * a2 + 2 * a3 + a4)


def nearest_states(times: np.ndarray, group_times: np.ndarray) -> np.ndarray:
    """Index of the state nearest in time to each group, the earlier one on ties; held at the ends."""
    hi = np.clip(np.searchsorted(times, group_times, side="left"), 0, len(times) - 1)
    lo = np.clip(hi - 1, 0, len(times) - 1)
    return np.where(np.abs(group_times - times[lo]) <= np.abs(times[hi] - group_times), lo, hi)


def initial_trajectory(times: np.ndarray, state: np.ndarray, eci: np.ndarray, bearing: np.ndarray, gyro: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions, velocities, attitudes at times and the gyro bias: keyframes from each group's mean landmark direction and best attitude, mixed between and held at the ends."""
    keys = np.unique(state)
    kt, kr, kq = times[keys], [], []
    for k in keys:
        p, b = eci[state == k], bearing[state == k]
        mean = p.sum(axis=0)
        r = mean / np.linalg.norm(mean) * (R_ORBIT_MEAN + ALTITUDE)
        d = p - r
        d /= np.linalg.norm(d, axis=1, keepdims=True)
        kr.append(r)
        kq.append(wahba(d.T @ b))
    kr, kq = np.array(kr), np.array(kq)
    r = np.column_stack([np.interp(times, kt, kr[:, i]) for i in range(3)])
    hi = np.clip(np.searchsorted(kt, times, side="right"), 1, max(len(kt) - 1, 1))
    q = np.array([kq[0] if len(kt) == 1 else slerp(kq[h - 1], kq[h], float(np.clip((t - kt[h - 1]) / (kt[h] - kt[h - 1]), 0, 1))) for t, h in zip(times, hi, strict=True)])
    n = len(times)
    up, down = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
    span = (times[up] - times[down])[:, None]
    v = np.where(span > 0, (r[up] - r[down]) / np.where(span > 0, span, 1), 0.0)
    rate = np.zeros((n, 3))
    rate[:-1] = 2 * q_mul(q_conj(q[:-1]), q[1:])[:, :3] / np.diff(times)[:, None]
    if n > 1:
        rate[-1] = rate[-2]
    m = min(n, len(gyro))
    return r, v, q, (gyro[:m] - rate[:m]).mean(axis=0)


@dataclass
class Estimate:
    """What is sought. extra: the unmodelled acceleration of each interval; r0, v0: the first state; r, v follow from them."""

    r0: np.ndarray
    v0: np.ndarray
    extra: np.ndarray
    q: np.ndarray
    bias: np.ndarray
    cd: float
    r: np.ndarray = field(default=None, repr=False)
    v: np.ndarray = field(default=None, repr=False)


class Problem:
    """Residuals and their derivatives for one dataset."""

    def __init__(self, times, gyro, state, eci, bearing, sigma, s: Solver) -> None:
        s.supported()
        self.times, self.dt, self.gyro, self.s = times, np.diff(times), gyro, s
        order = np.argsort(state, kind="stable")
        self.order, self.state, self.eci, self.bearing, self.sigma = order, state[order], eci[order], bearing[order], sigma[order]
        self.n, self.drag = len(times), s.use_drag
        self.step = {"rk4": rk4, "euler": euler}[s.integrator]
        self.first = np.searchsorted(self.state, np.arange(self.n + 1))  # of each state's landmarks

    def moved(self, r, v, extra, dt, cd) -> tuple[np.ndarray, np.ndarray]:
        return self.step(r, v, extra, dt, self.s.use_j2, cd if self.drag else None)

    def rolled(self, e: Estimate) -> Estimate:
        """With the states that follow from the first one."""
        r, v = np.empty((self.n, 3)), np.empty((self.n, 3))
        r[0], v[0] = e.r0, e.v0
        for k in range(self.n - 1):
            r[k + 1], v[k + 1] = self.moved(r[k], v[k], e.extra[k], self.dt[k], e.cd)
        e.r, e.v = r, v
        return e

    def landmark(self, e: Estimate) -> np.ndarray:
        d = self.eci - e.r[self.state]
        d /= np.linalg.norm(d, axis=1, keepdims=True)
        return (to_body(e.q[self.state], d) - self.bearing) / self.sigma[:, None]

    def turn(self, q: np.ndarray, after: np.ndarray, bias: np.ndarray) -> np.ndarray:
        dt = self.dt[:, None]
        return q_mul(q_conj(q_mul(q, q_exp((self.gyro[:-1] - bias) * dt))), after)[:, :3] / (self.s.gyro_sigma * dt)

    def cost(self, e: Estimate) -> float:
        m2 = self.s.huber**2
        out = 2 * m2 * (np.sqrt(1 + (self.landmark(e) ** 2).sum(axis=1) / m2) - 1).sum() + (self.turn(e.q[:-1], e.q[1:], e.bias) ** 2).sum() + ((e.extra / self.s.acceleration_sigma) ** 2).sum()
        return float(out + (((e.cd - self.s.cd_nominal) / self.s.cd_sigma) ** 2 if self.drag else 0.0))

    def slopes(self, e: Estimate) -> dict:
        """Rows of the linearised problem: weighted landmark residuals by place and attitude, turns by both attitudes and the bias, steps by state, acceleration and drag."""
        d = self.eci - e.r[self.state]
        far = np.linalg.norm(d, axis=1)[:, None, None]
        d = d / far[:, :, 0]
        eye = np.broadcast_to(np.eye(3), (len(d), 3, 3))
        turned = np.stack([to_body(e.q[self.state], eye[:, i]) for i in range(3)], axis=2)  # columns: the axes seen from the body
        seen = to_body(e.q[self.state], d)
        x, y, z, o = *seen.T, np.zeros(len(seen))
        skew = np.stack([np.stack([o, -z, y], 1), np.stack([z, o, -x], 1), np.stack([-y, x, o], 1)], axis=1)
        f = (seen - self.bearing) / self.sigma[:, None]
        w = ((1 + (f**2).sum(axis=1) / self.s.huber**2) ** -0.25)[:, None]
        scale = (w / self.sigma[:, None])[:, :, None]
        out = {"f": f * w, "by_r": turned @ -(eye - d[:, :, None] * d[:, None, :]) / far * scale, "by_a": skew * scale}
        h = 1e-6
        steps = h * np.eye(3)
        both = lambda fn: np.stack([(fn(a) - fn(-a)) / (2 * h) for a in steps], axis=2)
        q, after = e.q[:-1], e.q[1:]
        out["g"] = self.turn(q, after, e.bias)
        out["g_a"] = both(lambda a: self.turn(q_mul(q, q_exp(a)), after, e.bias))
        out["g_b"] = both(lambda a: self.turn(q, q_mul(after, q_exp(a)), e.bias))
        out["g_bias"] = both(lambda a: self.turn(q, after, e.bias + a))
        dt, r, v = self.dt[:, None], e.r[:-1], e.v[:-1]
        move = lambda a=0.0, b=0.0, c=0.0, cd=0.0: np.concatenate(self.moved(r + a, v + b, e.extra + c, dt, e.cd + cd), axis=1)
        part = lambda name, size: np.stack([(move(**{name: size * a}) - move(**{name: -size * a})) / (2 * size) for a in np.eye(3)], axis=2)
        out["phi"] = np.concatenate([part("a", 1e-2), part("b", 1e-5)], axis=2)
        out["gamma"] = part("c", 1e-8)
        out["by_cd"] = (move(cd=1e-3) - move(cd=-1e-3)) / 2e-3 if self.drag else np.zeros((self.n - 1, 6))
        return out


#: Places in a state's vector: place, velocity, attitude; then the bias and the drag coefficient, which all states share.
_R, _V, _A, _BIAS, _CD, _SIZE = slice(0, 3), slice(3, 6), slice(6, 9), slice(9, 12), 12, 13


def sweep(p: Problem, e: Estimate, damping: float = 0.0) -> tuple[np.ndarray, list, dict]:
    """The forward sweep: (triangular rows of the last state with their right side, what each interval keeps for the way back, the slopes).

    Rows say: coefficients times the change sought equal the right side, each with unit weight. Interval k eliminates the acceleration of k and
    the attitude of k; its place and velocity follow from those of k + 1 exactly.
    """
    j = p.slopes(e)
    total = lambda m: np.sqrt(np.einsum("kij,kij->j", m, m) + 1e-30)
    seen = total(j["by_r"])
    first = np.zeros((0, _SIZE + 1))
    if damping:  # a step is held short by rows in the scale of what is known of each unknown
        d = np.zeros((_SIZE, _SIZE + 1))
        d[_R, _R], d[_V, _V] = np.diag(seen), np.diag(seen * max(p.times[-1] - p.times[0], 1.0))
        d[_BIAS, _BIAS] = np.diag(total(j["g_bias"]))
        d[_CD, _CD] = 1 / p.s.cd_sigma
        first = np.sqrt(damping) * d
    known = np.zeros((1, _SIZE + 1))  # the drag coefficient's prior; without drag it has no meaning and is held
    known[0, _CD], known[0, -1] = 1 / p.s.cd_sigma, (p.s.cd_nominal - e.cd) / p.s.cd_sigma
    rows = np.vstack([first, known])
    kept: list = []

    def measured(rows: np.ndarray, k: int) -> np.ndarray:
        a, b = p.first[k], p.first[k + 1]
        m = 3 * (b - a)
        new = np.zeros((m, _SIZE + 1))
        new[:, _R], new[:, _A], new[:, -1] = j["by_r"][a:b].reshape(m, 3), j["by_a"][a:b].reshape(m, 3), -j["f"][a:b].reshape(m)
        if damping:
            hold = np.zeros((3, _SIZE + 1))
            near = (j["by_a"][a:b].reshape(-1, 3) ** 2).sum(axis=0) + (j["g_a"][min(k, p.n - 2)] ** 2).sum(axis=0)
            hold[:, _A] = np.diag(np.sqrt(damping * near))
            new = np.vstack([new, hold])
        return np.vstack([rows, new])

    for k in range(p.n - 1):
        rows = measured(rows, k)
        back = np.linalg.inv(j["phi"][k])  # place and velocity of k from those of k + 1, the acceleration and the drag
        # Columns from here on: acceleration (3), attitude of k (3), then the vector of k + 1.
        both = np.zeros((len(rows) + 6, 6 + _SIZE + 1))
        moved = rows[:, :6] @ back
        both[: len(rows), :3] = -moved @ j["gamma"][k]
        both[: len(rows), 3:6] = rows[:, _A]
        both[: len(rows), 6:12] = moved
        both[: len(rows), 6 + 9 : 6 + 12] = rows[:, _BIAS]
        both[: len(rows), 6 + _CD] = rows[:, _CD] - moved @ j["by_cd"][k]
        both[: len(rows), -1] = rows[:, -1]
        at = len(rows)
        weight = 1 / p.s.acceleration_sigma * np.sqrt(1 + damping)
        both[at : at + 3, :3], both[at : at + 3, -1] = np.eye(3) * weight, -e.extra[k] / p.s.acceleration_sigma / np.sqrt(1 + damping)
        both[at + 3 :, 3:6], both[at + 3 :, 12:15], both[at + 3 :, 15:18], both[at + 3 :, -1] = j["g_a"][k], j["g_b"][k], j["g_bias"][k], -j["g"][k]
        t = np.linalg.qr(both, mode="r")
        kept.append((t[:6], back))
        rows = t[6 : 6 + _SIZE, 6:]
    return np.linalg.qr(measured(rows, p.n - 1), mode="r")[:_SIZE], kept, j


def _solved(t: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper triangular rows; unknowns that no row tells anything of stay as they are."""
    scale = np.abs(t).max(initial=0) * 1e-15
    weak = np.abs(np.diag(t)) <= scale
    if not weak.any():
        return np.linalg.solve(t, b)
    return np.linalg.lstsq(t, b, rcond=None)[0]


def step(p: Problem, e: Estimate, damping: float) -> Estimate:
    """The estimate after one Gauss-Newton step."""
    last, kept, j = sweep(p, e, damping)
    x = _solved(last[:, :_SIZE], last[:, -1])
    bias, cd = x[_BIAS], x[_CD]
    turned, extra = np.empty((p.n, 3)), np.empty((p.n - 1, 3))
    turned[-1] = x[_A]
    for k in range(p.n - 2, -1, -1):
        rows, back = kept[k]
        y = _solved(rows[:, :6], rows[:, -1] - rows[:, 6 : 6 + _SIZE] @ x)
        extra[k], turned[k] = y[:3], y[3:]
        place = back @ (x[:6] - j["gamma"][k] @ y[:3] - j["by_cd"][k] * cd)
        x = np.concatenate([place, y[3:], bias, [cd]])
    q = q_mul(e.q, q_exp(turned))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    return p.rolled(Estimate(e.r0 + x[_R], e.v0 + x[_V], e.extra + extra, q, e.bias + bias, e.cd + cd if p.drag else e.cd))


def solve(times: np.ndarray, gyro: np.ndarray, state: np.ndarray, eci: np.ndarray, bearing: np.ndarray, sigma: np.ndarray, s: Solver, start: Estimate | None = None, deadline: float | None = None) -> dict:
    """Damped Gauss-Newton, reweighted for the pseudo-Huber cost, until a round gains less than the tolerance, the rounds are used up or the time is over."""
    p = Problem(times, gyro, state, eci, bearing, sigma, s)
    deadline = deadline or time.monotonic() + s.max_seconds
    if start is None:
        r, v, q, bias = initial_trajectory(times, state, eci, bearing, gyro)
        start = Estimate(r[0], v[0], np.zeros((p.n - 1, 3)), q, bias, s.cd_nominal)
    e = p.rolled(start)
    now, damping, rounds, status = p.cost(e), 1e-3, 0, "max_iterations"
    for rounds in range(1, s.max_iterations + 1):
        if time.monotonic() > deadline:
            status = "timeout"
            break
        gain = 0.0
        for _ in range(8):
            tried = step(p, e, damping)
            if np.isfinite(new := p.cost(tried)) and new < now:
                gain, e, now, damping = now - new, tried, new, max(damping / 5, 1e-12)
                break
            damping *= 10
        if gain < s.tolerance * max(now, 1e-12):
            status = "converged"
            break
    landmark = np.empty((len(state), 3))
    landmark[p.order] = p.landmark(e)
    return {"estimate": e, "problem": p, "r": e.r, "v": e.v, "q": e.q, "bias": e.bias, "cd": e.cd, "landmark": landmark, "cost": now, "iterations": rounds, "status": status}


def covariance(solution: dict) -> dict[str, np.ndarray]:
    """Variances at the solution: of each state (place, velocity, attitude), of the bias and of the drag coefficient, from the undamped sweep and one way back."""
    p, e = solution["problem"], solution["estimate"]
    last, kept, j = sweep(p, e)
    inverse = np.linalg.pinv(last[:, :_SIZE], rcond=1e-18)
    cov = inverse @ inverse.T
    out = np.empty((p.n, 9))
    out[-1] = np.diag(cov)[:9]
    shared = np.diag(cov)[9:]
    for k in range(p.n - 2, -1, -1):
        rows, back = kept[k]
        t = np.linalg.pinv(rows[:, :6], rcond=1e-18)
        by_next = -t @ rows[:, 6 : 6 + _SIZE]
        # The vector of k is linear in (acceleration, attitude of k) and the vector of k + 1.
        a, b = np.zeros((_SIZE, 6)), np.zeros((_SIZE, _SIZE))
        a[:6, :3], a[_A, 3:] = -back @ j["gamma"][k], np.eye(3)
        b[:6, :6], b[:6, _CD], b[_BIAS, _BIAS], b[_CD, _CD] = back, -back @ j["by_cd"][k], np.eye(3), 1.0
        m = a @ by_next + b
        cov = m @ cov @ m.T + a @ t @ t.T @ a.T
        out[k] = np.diag(cov)[:9]
    return {"state": out, "bias": shared[:3], "cd": float(shared[3]) if p.drag else None}


def residuals_at(solution: dict, state, eci, bearing, sigma) -> np.ndarray:
    """Landmark residuals at a solution, also of landmarks that it didn't use."""
    e = solution["estimate"]
    d = eci - e.r[state]
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    return (to_body(e.q[state], d) - bearing) / sigma[:, None]


def dynamics_residuals(solution: dict) -> np.ndarray:
    """What each interval's step leaves: place, velocity (without the unmodelled acceleration) and turn, and the bias's (0, as it is fixed)."""
    p, e = solution["problem"], solution["estimate"]
    r, v = p.moved(e.r[:-1], e.v[:-1], np.zeros((p.n - 1, 3)), p.dt[:, None], e.cd)
    return np.concatenate([e.r[1:] - r, e.v[1:] - v, p.turn(e.q[:-1], e.q[1:], e.bias), np.zeros((p.n - 1, 3))], axis=1)


def solve_with_rejection(times, gyro, state, eci, bearing, sigma, s: Solver) -> tuple[dict, np.ndarray]:
    """Solves, drops landmarks whose residual is above the threshold, and solves again from there, until none is or the rounds are used up.

    The result also has `solves` (a summary of each), `initial` (the trajectory of the first start) and `residual`: of all landmarks, the rejected
    ones evaluated anew at the last solution.
    """
    keep, start, best, solves = np.ones(len(state), dtype=bool), None, None, []
    deadline = time.monotonic() + s.max_seconds
    first = initial_trajectory(times, state, eci, bearing, gyro)
    rounds = max(1, s.outlier_rounds)
    for k in range(rounds):
        begun = time.monotonic()
        best = solve(times, gyro, state[keep], eci[keep], bearing[keep], sigma[keep], s, start, deadline)
        bad = np.linalg.norm(best["landmark"], axis=1) > s.outlier_threshold
        solves.append({"return_status": best["status"], "iter_count": best["iterations"], "final_cost": best["cost"], "solve_time_ms": 1000 * (time.monotonic() - begun), "n_active_landmarks": int(keep.sum()), "n_rejected": int((~keep).sum())})
        # The last solution's landmarks stay unmarked, since it used them.
        if k == rounds - 1 or not bad.any() or (keep.sum() - bad.sum()) < 4 or time.monotonic() > deadline:
            break
        keep[np.flatnonzero(keep)[bad]] = False
        start = best["estimate"]
    best |= {"solves": solves, "initial": first, "residual": residuals_at(best, state, eci, bearing, sigma)}
    return best, ~keep


STATE = ("pos_x_km", "pos_y_km", "pos_z_km", "vel_x_kms", "vel_y_kms", "vel_z_kms", "quat_x", "quat_y", "quat_z", "quat_w")
COVARIANCE = tuple(f"{c}_cov_{a}" for c in ("pos", "vel", "rot") for a in "xyz")
DYNAMICS = tuple(f"{c}_res_{a}" for c in ("pos", "vel", "rot", "gyro_bias") for a in "xyz")
_SOLVE = "return_status string, iter_count long, final_cost double, solve_time_ms double, n_active_landmarks long, n_rejected long"


def _rows(names: tuple[str, ...]) -> str:
    return "array<struct<timestamp_j2000:double," + ",".join(f"{c}:double" for c in names) + ">>"


RESULT_SCHEMA = (
    f"dataset_id string, landmark_rows long, landmark_groups long, gyro_rows long, solves array<struct<{_SOLVE.replace(' ', ':').replace(',:', ',')}>>, cost double, rejected long, "
    f"states {_rows(STATE)}, initial {_rows(STATE)}, covariance {_rows(COVARIANCE)}, dynamics {_rows(DYNAMICS)}, "
    "landmarks array<struct<res_x:double,res_y:double,res_z:double,outlier:boolean>>, gyro_bias array<double>, gyro_bias_var array<double>, cd double, cd_var double"
)


def orbit_results(landmarks: DataFrame, gyro: DataFrame, settings: Solver = Solver()) -> DataFrame:
    """One row a dataset with all that its solution tells: summaries of the solves, states, the first trajectory, variances, residuals.

    landmarks: dataset_id, t, bearing_x..z, eci_x_km..z_km, sigma; gyro: dataset_id, t, wx, wy, wz (rad/s). Groups snap to the
    nearest gyro time. Datasets under four landmarks or two gyro rows have no rows.
    """
    settings.supported()
    names = [c.split(" ")[0] for c in RESULT_SCHEMA.split(", ")]

    def table(times: np.ndarray, values: np.ndarray, columns: tuple[str, ...]) -> list[dict]:
        return [dict(zip(("timestamp_j2000", *columns), (t, *row), strict=True)) for t, row in zip(times.tolist(), values.tolist(), strict=True)]

    def run(key: tuple, marks: pd.DataFrame, rates: pd.DataFrame) -> pd.DataFrame:
        marks, rates = marks.sort_values("t", kind="stable"), rates.sort_values("t", kind="stable")
        if len(marks) < 4 or len(rates) < 2:
            return pd.DataFrame(columns=names)
        at = nearest_states(rates["t"].to_numpy(), marks["t"].to_numpy())
        lo, hi = at.min(), at.max()
        times = rates["t"].to_numpy()[lo : hi + 1]
        if len(times) < 2:
            return pd.DataFrame(columns=names)
        found, bad = solve_with_rejection(times, rates[["wx", "wy", "wz"]].to_numpy()[lo : hi + 1], at - lo, marks[[f"eci_{a}_km" for a in "xyz"]].to_numpy(), marks[[f"bearing_{a}" for a in "xyz"]].to_numpy(), marks["sigma"].to_numpy(), settings)
        r, v, q, _ = found["initial"]
        var = covariance(found) if settings.compute_covariance else None
        row = {
            "dataset_id": key[0], "landmark_rows": len(marks), "landmark_groups": marks["t"].nunique(), "gyro_rows": len(rates), "solves": found["solves"], "cost": found["cost"], "rejected": int(bad.sum()),
            "states": table(times, np.column_stack([found["r"], found["v"], found["q"]]), STATE), "initial": table(times, np.column_stack([r, v, q]), STATE),
            "covariance": table(times, var["state"], COVARIANCE) if var else None, "dynamics": table(times[:-1], dynamics_residuals(found), DYNAMICS),
            "landmarks": [{"res_x": x, "res_y": y, "res_z": z, "outlier": bool(o)} for (x, y, z), o in zip(found["residual"].tolist(), bad, strict=True)],
            "gyro_bias": found["bias"].tolist(), "gyro_bias_var": var["bias"].tolist() if var else None, "cd": found["cd"] if settings.use_drag else None, "cd_var": var["cd"] if var else None,
        }
        return pd.DataFrame({c: [row[c]] for c in names})

    return landmarks.groupBy("dataset_id").cogroup(gyro.groupBy("dataset_id")).applyInPandas(run, RESULT_SCHEMA)


def determine_orbits(landmarks: DataFrame, gyro: DataFrame, settings: Solver = Solver()) -> DataFrame:
    """State estimates of every dataset: dataset_id, t, place, velocity, attitude, the solution's cost and how many landmarks it rejected."""
    rows = orbit_results(landmarks, gyro, settings).select("dataset_id", "cost", "rejected", F.explode("states").alias("s"))
    return rows.select("dataset_id", F.col("s.timestamp_j2000").alias("t"), *(F.col(f"s.{c}") for c in STATE), "cost", "rejected")


def result_tables(results: DataFrame) -> dict[str, DataFrame]:
    """The tables of a results folder, by name, each with dataset_id."""
    tables = {"state_estimates": "states", "initial_trajectory": "initial", "covariance": "covariance", "dynamics_residuals": "dynamics", "landmark_residuals": "landmarks"}
    return {name: results.select("dataset_id", F.inline(column)) for name, column in tables.items()}


def result_documents(results: DataFrame, settings: Solver = Solver()) -> DataFrame:
    """dataset_id, value: the summary of each solution as JSON, with its last state, variances and settings."""
    c, last = F.col, F.try_element_at("states", F.lit(-1))
    cov = F.try_element_at("covariance", F.lit(-1))
    units = {"pos": "km2", "vel": "km2s2", "rot": "rad2"}
    estimates = [last["timestamp_j2000"].alias("timestamp_j2000"), *(last[n].alias(n) for n in STATE), *(cov[f"{k}_cov_{a}"].alias(f"{k}_cov_{a}_{u}") for k, u in units.items() for a in "xyz")]
    for k, a in enumerate("xyz"):
        estimates += [c("gyro_bias")[k].alias(f"gyro_bias_{a}_rads"), c("gyro_bias_var")[k].alias(f"gyro_bias_cov_{a}_rads2")]
    final = F.try_element_at("solves", F.lit(-1))
    body = F.struct(
        c("dataset_id").alias("dataset_folder"), F.struct(*(final[n].alias(n) for n in ("return_status", "iter_count", "final_cost", "solve_time_ms"))).alias("solver"), c("solves").alias("solver_iterations"),
        F.struct(c("landmark_rows").alias("num_landmark_rows"), c("landmark_groups").alias("num_landmark_groups"), c("gyro_rows").alias("num_gyro_rows")).alias("inputs"),
        F.struct(F.size("states").alias("num_state_estimates"), c("covariance").isNotNull().alias("covariance_available"), F.size("solves").alias("od_solver_calls"), c("rejected").alias("landmarks_rejected")).alias("outputs"),
        F.struct(*(F.lit(getattr(settings, n)).alias(n) for n in ("use_j2", "use_drag", "compute_covariance", "integrator")), F.lit(settings.max_seconds).alias("max_run_time_sec")).alias("config"),
        F.struct(*estimates, c("cd"), c("cd_var")).alias("estimates"),
    )
    return results.select("dataset_id", F.to_json(body).alias("value"))


def simulate(n: int = 12, dt: float = 10.0, landmarks: int = 6, noise: float = 1e-5, seed: int = 1, j2: bool = False, cd: float | None = None) -> dict:
    """A circular orbit seen by a body that turns steadily, its landmark bearings and biased gyro rates: the truth to recover."""
    g = np.random.default_rng(seed)
    radius = R_ORBIT_MEAN + ALTITUDE
    speed = np.sqrt(GM_EARTH / radius)
    r, v = np.array([radius, 0.0, 0.0]), np.array([0.0, speed * 0.8, speed * 0.6])
    q, rate, bias = np.array([0.0, 0.0, 0.0, 1.0]), np.array([1e-3, -2e-3, 5e-4]), np.array([2e-4, -1e-4, 3e-4])
    rs, vs, qs, at, eci, bearing = [], [], [], [], [], []
    for i in range(n):
        rs.append(r)
        vs.append(v)
        qs.append(q)
        p = r / np.linalg.norm(r) * R_ORBIT_MEAN + g.normal(0, 150, (landmarks, 3))
        d = p - r
        d /= np.linalg.norm(d, axis=1, keepdims=True)
        b = to_body(q, d) + g.normal(0, noise, d.shape)
        eci.append(p)
        bearing.append(b / np.linalg.norm(b, axis=1, keepdims=True))
        at += [i] * landmarks
        r, v = rk4(r, v, np.zeros(3), dt, j2, cd)
        q = q_mul(q, q_exp(rate * dt))
    times = np.arange(n) * dt
    return {"t": times, "r": np.array(rs), "v": np.array(vs), "q": np.array(qs), "bias": bias, "gyro": np.tile(rate + bias, (n, 1)), "state": np.array(at), "eci": np.vstack(eci), "bearing": np.vstack(bearing), "sigma": np.full(n * landmarks, max(noise, 1e-6))}
