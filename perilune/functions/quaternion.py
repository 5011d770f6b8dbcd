"""Quaternions as four columns. Two orders are in use: `wxyz` (scalar first) and `xyzw`; every function names its own."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Quad = tuple[Column, Column, Column, Column]
Triple = tuple[Column, Column, Column]


def product_wxyz(a: Quad, b: Quad) -> Quad:
    (aw, ax, ay, az), (bw, bx, by, bz) = a, b
    return (aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw)


def to_wxyz(q: Quad) -> Quad:
    return (q[3], q[0], q[1], q[2])


def to_xyzw(q: Quad) -> Quad:
    return (q[1], q[2], q[3], q[0])


def product_xyzw(a: Quad, b: Quad) -> Quad:
    return to_xyzw(product_wxyz(to_wxyz(a), to_wxyz(b)))


def conjugate_xyzw(q: Quad) -> Quad:
    return (-q[0], -q[1], -q[2], q[3])


def conjugate_wxyz(q: Quad) -> Quad:
    return (q[0], -q[1], -q[2], -q[3])


def norm(q) -> Column:
    total = q[0] * q[0]
    for x in q[1:]:
        total = total + x * x
    return F.sqrt(total)


def normalized(q):
    n = norm(q)
    return tuple(x / n for x in q)


def angle_axis_xyzw(v: Triple) -> Quad:
    """The rotation by a vector; half of it for an angle near 0."""
    angle = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    factor = F.when(angle < 1e-9, F.lit(0.5)).otherwise(F.sin(angle / 2) / angle)
    return (v[0] * factor, v[1] * factor, v[2] * factor, F.cos(angle / 2))


def inverse_rotate_xyzw(q: Quad, v: Triple) -> Triple:
    """The vector in the rotated frame: conj(q) * v * q."""
    out = product_xyzw(product_xyzw(conjugate_xyzw(q), (*v, F.lit(0.0))), q)
    return out[:3]


def mrp_wxyz(q: Quad) -> Triple:
    """Modified Rodrigues parameters, from the shadow set where their norm is 1 or more."""
    w, x, y, z = normalized(q)
    m = (x / (1 + w), y / (1 + w), z / (1 + w))
    n2 = m[0] * m[0] + m[1] * m[1] + m[2] * m[2]
    return tuple(F.when(n2 >= 1, -c / n2).otherwise(c) for c in m)


def slerp_wxyz(a: Quad, b: Quad, t: Column, linear_below: float = 1e-2) -> Quad:
    """Along the shorter arc; nearly parallel ones are mixed linearly and not normalised."""
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3]
    sign, size = F.when(dot < 0, -1.0).otherwise(1.0), F.abs(dot)
    angle = F.acos(F.least(size, F.lit(1.0)))
    near = (1 - size) < linear_below
    p = F.when(near, 1 - t).otherwise(F.sin((1 - t) * angle) / F.sin(angle))
    q = F.when(near, t).otherwise(F.sin(t * angle) / F.sin(angle)) * sign
    mixed = tuple(p * x + q * y for x, y in zip(a, b, strict=True))
    n = norm(mixed)
    return tuple(F.when(near, m).otherwise(m / n) for m in mixed)


def kinematics_wxyz(q: Quad, rate: Triple) -> Quad:
    return tuple(x * 0.5 for x in product_wxyz(q, (F.lit(0.0), *rate)))


def skew(v: Triple) -> tuple[Triple, Triple, Triple]:
    """The matrix (rows) whose product with a vector is the cross product with v."""
    zero = F.lit(0.0)
    return ((zero, -v[2], v[1]), (v[2], zero, -v[0]), (-v[1], v[0], zero))


def left_matrix_wxyz(q: Quad) -> tuple[Quad, ...]:
    """Rows of the matrix that multiplies from the left by q."""
    w, x, y, z = q
    return ((w, -x, -y, -z), (x, w, -z, y), (y, z, w, -x), (z, -y, x, w))


def right_matrix_wxyz(q: Quad) -> tuple[Quad, ...]:
    """Rows of the matrix that multiplies from the right by q."""
    w, x, y, z = q
    return ((w, -x, -y, -z), (x, w, z, -y), (y, -z, w, x), (z, y, -x, w))


def tangent_basis_xyzw(q: Quad) -> tuple[Quad, Quad, Quad]:
    """Three unit vectors at right angles to q and to each other: q turned by the three imaginary units from the right. They span what attitude errors can change."""
    x, y, z, w = q
    return ((w, z, -y, -x), (-z, w, x, -y), (y, -x, w, -z))


def matrix_to_xyzw(r: np.ndarray) -> np.ndarray:
    """numpy: from rotation matrices (the last two axes), by the largest of the four components."""
    x, y, z = r[..., 0, 0], r[..., 1, 1], r[..., 2, 2]
    k = np.stack([x - y - z, y - x - z, z - x - y, x + y + z], axis=-1)
    m = np.empty((*r.shape[:-2], 4, 4))
    m[..., :3, :3] = r + np.swapaxes(r, -1, -2)
    m[..., 3, :3] = m[..., :3, 3] = np.stack([r[..., 2, 1] - r[..., 1, 2], r[..., 0, 2] - r[..., 2, 0], r[..., 1, 0] - r[..., 0, 1]], axis=-1)
    m[..., np.arange(4), np.arange(4)] = 1 + k
    q = np.take_along_axis(m, np.argmax(k, axis=-1)[..., None, None], axis=-2)[..., 0, :]
    return q / np.linalg.norm(q, axis=-1, keepdims=True)


def wahba(b: np.ndarray) -> np.ndarray:
    """numpy: the rotations (xyzw) that best turn body vectors into reference vectors, from their summed outer products (the last two axes); identity for a degenerate sum."""
    flat = np.linalg.norm(b, axis=(-2, -1)) < 1e-9
    u, _, vt = np.linalg.svd(np.where(flat[..., None, None], np.eye(3), b))
    turn = np.stack([np.ones(flat.shape), np.ones(flat.shape), np.where(np.linalg.det(u @ vt) > 0, 1.0, -1.0)], axis=-1)
    return np.where(flat[..., None], [0.0, 0.0, 0.0, 1.0], matrix_to_xyzw((u * turn[..., None, :]) @ vt))
