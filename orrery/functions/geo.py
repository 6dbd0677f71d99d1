"""Coordinates and directions as column expressions. Angles are radians unless a name says degrees; lengths are metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid, Earth rotation rate, speed of light, mean Earth radius.
RE = 6378137.0
FE = 1.0 / 298.257223563
OMEGA_E = 7.2921151467e-5
CLIGHT = 299792458.0
EARTH_MEAN = 6371000.0


def norm(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def ecef_to_geodetic(x: Column, y: Column, z: Column, rounds: int = 6) -> tuple[Column, Column, Column]:
    """(latitude, longitude, height); the iteration for z converges to under 1e-6 m within six rounds anywhere outside the core."""
    e2 = FE * (2 - FE)
    r2 = x * x + y * y

    def curvature(zk: Column) -> Column:
        return RE / F.sqrt(1 - e2 * zk * zk / (r2 + zk * zk))

    # a fold keeps the expression one step long
    zk = F.aggregate(F.array_repeat(F.lit(0), rounds), z, lambda a, _: z + curvature(a) * e2 * a / F.sqrt(r2 + a * a))
    v = curvature(zk)
    lat = F.when(r2 > 1e-12, F.atan(zk / F.sqrt(r2))).otherwise(F.signum(z) * math.pi / 2)
    lon = F.when(r2 > 1e-12, F.atan2(y, x)).otherwise(0.0)
    return lat, lon, F.sqrt(r2 + zk * zk) - v


def geodetic_to_ecef(lat: Column, lon: Column, h: Column) -> tuple[Column, Column, Column]:
    e2 = FE * (2 - FE)
    v = RE / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return (v + h) * F.cos(lat) * F.cos(lon), (v + h) * F.cos(lat) * F.sin(lon), (v * (1 - e2) + h) * F.sin(lat)


def to_enu(lat: Column, lon: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """An ECEF vector in local east, north, up at a position."""
    sp, cp, sl, cl = F.sin(lat), F.cos(lat), F.sin(lon), F.cos(lon)
    return -sl * x + cl * y, -sp * cl * x - sp * sl * y + cp * z, cp * cl * x + cp * sl * y + sp * z


def azimuth_elevation(e: Column, n: Column, u: Column) -> tuple[Column, Column]:
    """Azimuth in [0, 2 pi) and elevation of a local vector."""
    az = F.when(e * e + n * n < 1e-12, 0.0).otherwise(F.pmod(F.atan2(e, n), F.lit(2 * math.pi)))
    return az, F.asin(u / norm(e, n, u))


def sagnac(xs: Column, ys: Column, xr: Column, yr: Column) -> Column:
    return OMEGA_E * (xs * yr - ys * xr) / CLIGHT


def geometric_range(s: tuple[Column, Column, Column], r: tuple[Column, Column, Column]) -> Column:
    """Range with the Sagnac term; -1 where the source lies inside nine tenths of the Earth's radius."""
    d = norm(s[0] - r[0], s[1] - r[1], s[2] - r[2])
    return F.when(norm(*s) < 0.9 * RE, -1.0).otherwise(d + sagnac(s[0], s[1], r[0], r[1]))


def cross(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def dot(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def unit(a: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    n = norm(*a)
    return a[0] / n, a[1] / n, a[2] / n


def to_rac(pos: tuple[Column, ...], vel: tuple[Column, ...], vec: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    """A vector's radial, along-track and cross-track parts in the orbit frame."""
    r = unit(pos)
    c = unit(cross(pos, vel))
    a = cross(c, r)
    return dot(vec, r), dot(vec, a), dot(vec, c)


def wrap_pi(a: Column) -> Column:
    """Into (-pi, pi]."""
    w = F.pmod(a, F.lit(2 * math.pi))
    return F.when(w > math.pi, w - 2 * math.pi).otherwise(w)


def wrap_two_pi(a: Column) -> Column:
    return F.pmod(a, F.lit(2 * math.pi))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_MEAN) -> Column:
    """Great-circle distance between positions in degrees."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in degrees, [0, 360)."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl))), F.lit(360.0))


def quaternion_angle(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Angle in radians between two attitudes given as unit quaternions."""
    d = F.abs(a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3])
    return 2 * F.acos(F.least(d, F.lit(1.0)))
