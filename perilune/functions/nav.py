"""Geodesy, camera geometry and orbital dynamics as column expressions. Kilometres, seconds and radians."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilune.functions.units import J2000_UNIX, unix_to_j2000

Triple = tuple[Column, Column, Column]

# The mission's constants.
GM_EARTH = 3.9860044188e5
R_EARTH = 6378.137
R_POLE = 6356.7519
R_ORBIT_MEAN, ALTITUDE = 6371.0, 600.0
J2 = 1.08262668e-3
OMEGA_EARTH = 7.2921150e-5
ARC_SECOND = 3.141592653589793 / 648000
DRAG_AREA, DRAG_MASS = 1.0e-8, 1.3
# Lower bound (km), density and scale height (km) of the layers of the exponential atmosphere.
ATMOSPHERE = ((300.0, 2.418e-2, 53.628), (350.0, 9.518e-3, 53.298), (400.0, 3.725e-3, 58.515), (450.0, 1.585e-3, 60.828), (500.0, 6.967e-4, 63.822), (600.0, 1.454e-4, 71.835))


def dot(a: Triple, b: Triple) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def length(a: Triple, floor: float = 0.0) -> Column:
    return F.sqrt(dot(a, a) + floor)


def scaled(a: Triple, s) -> Triple:
    return tuple(x * s for x in a)


def plus(*vs: Triple) -> Triple:
    return tuple(reduce(lambda x, y: x + y, parts) for parts in zip(*vs, strict=True))


def minus(a: Triple, b: Triple) -> Triple:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def kepler_acceleration(r: Triple) -> Triple:
    n = length(r, 1e-10)
    return scaled(r, -GM_EARTH / ((dot(r, r) + 1e-10) * n))


def j2_acceleration(r: Triple) -> Triple:
    r2 = dot(r, r) + 1e-10
    factor = 1.5 * J2 * GM_EARTH * R_EARTH * R_EARTH / (r2 * r2 * F.sqrt(r2))
    z = r[2] * r[2] / r2
    return (factor * r[0] * (5 * z - 1), factor * r[1] * (5 * z - 1), factor * r[2] * (5 * z - 3))


def density(r: Triple) -> Column:
    """Piecewise exponential; the lowest layer also holds below it, the highest above."""
    h = length(r, 1e-10) - R_EARTH
    layer = lambda k: F.exp(-(h - ATMOSPHERE[k][0]) / ATMOSPHERE[k][2]) * ATMOSPHERE[k][1]
    out = layer(len(ATMOSPHERE) - 1)
    for k in range(len(ATMOSPHERE) - 2, -1, -1):
        out = F.when(h < ATMOSPHERE[k + 1][0], layer(k)).otherwise(out)
    return out


def drag_acceleration(r: Triple, v: Triple, cd) -> Triple:
    rel = (v[0] + r[1] * OMEGA_EARTH, v[1] - r[0] * OMEGA_EARTH, v[2])
    return scaled(rel, density(r) * length(rel, 1e-20) * cd * (-0.5 * DRAG_AREA / DRAG_MASS))


def acceleration(r: Triple, v: Triple, extra: Triple | None = None, j2: bool = False, cd=None) -> Triple:
    parts = [kepler_acceleration(r)] + ([extra] if extra else []) + ([j2_acceleration(r)] if j2 else []) + ([drag_acceleration(r, v, cd)] if cd is not None else [])
    return plus(*parts)


def euler_step(r: Triple, v: Triple, dt: Column, **forces) -> tuple[Triple, Triple]:
    return plus(r, scaled(v, dt)), plus(v, scaled(acceleration(r, v, **forces), dt))


def rk4_step(r: Triple, v: Triple, dt: Column, **forces) -> tuple[Triple, Triple]:
    a1 = acceleration(r, v, **forces)
    r2, v2 = plus(r, scaled(v, dt / 2)), plus(v, scaled(a1, dt / 2))
    a2 = acceleration(r2, v2, **forces)
    r3, v3 = plus(r, scaled(v2, dt / 2)), plus(v, scaled(a2, dt / 2))
    a3 = acceleration(r3, v3, **forces)
    r4, v4 = plus(r, scaled(v3, dt)), plus(v, scaled(a3, dt))
    a4 = acceleration(r4, v4, **forces)
    mean = lambda a, b, c, d: scaled(plus(a, scaled(b, 2.0), scaled(c, 2.0), d), dt / 6)
    return plus(r, mean(v, v2, v3, v4)), plus(v, mean(a1, a2, a3, a4))


def sidereal_angle(t_j2000: Column) -> Column:
    """Earth's rotation angle at UT1 seconds since J2000. A z-rotation only, without precession and nutation (0.3 degrees in 2025); `inertial_to_earth` has them."""
    days = t_j2000 / 86400.0
    return (0.7790572732640 + days * 1.00273781191135448) % 1.0 * 6.283185307179586


def rotate_z(v: Triple, angle: Column) -> Triple:
    """Into a frame turned by angle about z."""
    c, s = F.cos(angle), F.sin(angle)
    return (c * v[0] + s * v[1], c * v[1] - s * v[0], v[2])


def rotate(v: Triple, m: list[Column]) -> Triple:
    """By a row-major matrix of nine columns."""
    return tuple(dot(tuple(m[3 * k : 3 * k + 3]), v) for k in range(3))


def eci_to_ecef(v: Triple, t_j2000: Column) -> Triple:
    return rotate_z(v, sidereal_angle(t_j2000))


def ecef_to_eci(v: Triple, t_j2000: Column) -> Triple:
    return rotate_z(v, -sidereal_angle(t_j2000))


def rotate_x(v: Triple, angle: Column) -> Triple:
    c, s = F.cos(angle), F.sin(angle)
    return (v[0], c * v[1] + s * v[2], c * v[2] - s * v[1])


def rotate_y(v: Triple, angle: Column) -> Triple:
    c, s = F.cos(angle), F.sin(angle)
    return (c * v[0] - s * v[2], v[1], s * v[0] + c * v[2])


def _powers(t: Column, *terms: float) -> Column:
    """terms[0] + terms[1] * t + ..., in arc seconds, as radians."""
    out = F.lit(terms[-1])
    for x in terms[-2::-1]:
        out = out * t + x
    return out * ARC_SECOND


def _centuries(unix: Column) -> Column:
    return unix_to_j2000(unix) / (86400.0 * 36525)


def _precession_tilt(t: Column) -> Column:
    return _powers(t, 0.0, 2004.3109, -0.42665, -0.041833)


def pole_shift(unix: Column) -> Column:
    """The angle that the Earth-fixed pole is at most away from that of J2000 at a Unix time: precession grows with time, and nutation adds 22 arc seconds at the very most."""
    return F.abs(_precession_tilt(_centuries(unix))) + 22 * ARC_SECOND


def _orientation(unix: Column, dut1: float) -> list[tuple]:
    """Rotations (about an axis, by an angle) from the inertial frame of J2000 to the Earth-fixed one, in order: precession, the main terms of nutation, sidereal time."""
    t = _centuries(unix)
    zeta, z, theta = _powers(t, 0.0, 2306.2181, 0.30188, 0.017998), _powers(t, 0.0, 2306.2181, 1.09468, 0.018203), _precession_tilt(t)
    tilt = _powers(t, 84381.448, -46.8150, -0.00059, 0.001813)
    node, sun, moon = (F.radians(a + t * b) for a, b in ((125.04452, -1934.136261), (280.4665, 36000.7698), (218.3165, 481267.8813)))
    along = (-17.20 * F.sin(node) - 1.32 * F.sin(2 * sun) - 0.23 * F.sin(2 * moon) + 0.21 * F.sin(2 * node)) * ARC_SECOND
    across = (9.20 * F.cos(node) + 0.57 * F.cos(2 * sun) + 0.10 * F.cos(2 * moon) - 0.09 * F.cos(2 * node)) * ARC_SECOND
    days = (unix.cast("double") - J2000_UNIX + dut1) / 86400.0
    u = days / 36525
    # Whole turns are taken off first, so that they don't cost digits.
    sidereal = (67310.54841 + u * (8640184.812866 + u * (0.093104 - u * 6.2e-6))) / 86400.0 + days % 1.0
    angle = (sidereal % 1.0) * 6.283185307179586 + along * F.cos(tilt + across)
    return [(rotate_z, -zeta), (rotate_y, theta), (rotate_z, -z), (rotate_x, tilt), (rotate_z, -along), (rotate_x, -(tilt + across)), (rotate_z, angle)]


def _turned(df: DataFrame, position: list[str], unix: Column, dut1: float, back: bool) -> DataFrame:
    """Angles are columns first, and each rotation is a step of its own: nested in one expression, every rotation would double its size."""
    turns = _orientation(unix, dut1)
    df = df.withColumns({f"_turn{k}": -angle if back else angle for k, (_, angle) in enumerate(turns)})
    for k in range(len(turns))[:: -1 if back else 1]:
        v = turns[k][0](tuple(F.col(c) for c in position), F.col(f"_turn{k}"))
        df = df.withColumns(dict(zip(position, v, strict=True)))
    return df.drop(*(f"_turn{k}" for k in range(len(turns))))


def inertial_to_earth(df: DataFrame, position: list[str], unix: Column, dut1: float = 0.0) -> DataFrame:
    """Three columns from J2000 to the Earth-fixed frame at a Unix time, within about an arc second: polar motion and small terms of nutation are left out. dut1: UT1 - UTC in seconds."""
    return _turned(df, position, unix, dut1, False)


def earth_to_inertial(df: DataFrame, position: list[str], unix: Column, dut1: float = 0.0) -> DataFrame:
    return _turned(df, position, unix, dut1, True)


def geodetic_to_ecef(lon: Column, lat: Column, altitude) -> Triple:
    """Kilometres."""
    f = (R_EARTH - R_POLE) / R_EARTH
    e2 = f * (2 - f)
    n = R_EARTH / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return ((n + altitude) * F.cos(lat) * F.cos(lon), (n + altitude) * F.cos(lat) * F.sin(lon), (n * (1 - e2) + altitude) * F.sin(lat))


def ecef_to_geodetic(v: Triple, rounds: int = 5) -> Triple:
    """altitude, lon, lat by fixed-point rounds from the geocentric latitude."""
    f = (R_EARTH - R_POLE) / R_EARTH
    e2 = f * (2 - f)
    p = F.sqrt(v[0] * v[0] + v[1] * v[1])
    lat = F.atan2(v[2], p * (1 - e2))
    for _ in range(rounds):
        n = R_EARTH / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
        lat = F.atan2(v[2] + e2 * n * F.sin(lat), p)
    n = R_EARTH / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    altitude = p * F.cos(lat) + v[2] * F.sin(lat) - n * (1 - e2 * F.sin(lat) * F.sin(lat))
    return (altitude, F.atan2(v[1], v[0]), lat)


def geocentric_to_ecef(lon: Column, lat: Column, altitude_m) -> Triple:
    """Metres, over the mean radius, as the mission's geocentric path has it."""
    r = altitude_m + (2 * R_EARTH + R_POLE) / 3 * 1000
    return (r * F.cos(lat) * F.cos(lon), r * F.cos(lat) * F.sin(lon), r * F.sin(lat))


def ecef_to_geocentric(v: Triple) -> Triple:
    """radius, lon, lat."""
    return (length(v), F.atan2(v[1], v[0]), F.atan2(v[2], F.sqrt(v[0] * v[0] + v[1] * v[1])))


def pixel_bearing(x: Column, y: Column, fx, fy, cx, cy, distortion: tuple[float, ...] = (0.0,) * 5, rounds: int = 5) -> Triple:
    """Unit vector through a pixel. Distortion is (k1, k2, p1, p2, k3), undone by fixed-point rounds."""
    u0, v0 = (x - cx) / fx, (y - cy) / fy
    u, v = u0, v0
    k1, k2, p1, p2, k3 = distortion
    for _ in range(rounds if any(distortion) else 0):
        r2 = u * u + v * v
        radial = 1 + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2
        du, dv = 2 * p1 * u * v + p2 * (r2 + 2 * u * u), p1 * (r2 + 2 * v * v) + 2 * p2 * u * v
        u, v = (u0 - du) / radial, (v0 - dv) / radial
    n = F.sqrt(u * u + v * v + 1)
    return (u / n, v / n, 1 / n)


def landmark_sigma(height: Column, width: Column, fx, fy) -> Column:
    return F.least(height, width) / (6 * ((fx + fy) / 2))


def pseudo_huber(squared: Column, m: float = 3.0) -> Column:
    return 2 * m * m * (F.sqrt(1 + squared / (m * m)) - 1)


def three_sigma(variance: Column) -> Column:
    return 3 * F.sqrt(F.greatest(variance, F.lit(0.0)))
