"""Further models as columns or Arrow UDFs: Sun, Moon and tides, attitude, harmonic fields, mapping functions, slip repair, state upkeep."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from orrery.functions import geo as G

# Love and Shida numbers of degree two, mass ratios of Moon and Sun to the Earth, the geomagnetic reference radius.
H2, L2 = 0.6078, 0.0847
MOON_RATIO, SUN_RATIO = 0.012300034, 332946.0
R_MAG_KM = 6371.2


def moon_position(us: Column) -> tuple[Column, Column, Column]:
    """The Moon in the Earth-fixed frame, metres, by the low-precision almanac formula (about 0.3 degree)."""
    d = us / 86_400e6 + 40_587 - 51_544.5
    t = d / 36_525

    def s(a: float, b: float) -> Column:
        return F.sin(F.radians(a + b * t))

    def c(a: float, b: float) -> Column:
        return F.cos(F.radians(a + b * t))

    lam = F.radians(218.32 + 481267.881 * t + 6.29 * s(135.0, 477198.87) - 1.27 * s(259.3, -413335.36) + 0.66 * s(235.7, 890534.22) + 0.21 * s(269.9, 954397.74) - 0.19 * s(357.5, 35999.05) - 0.11 * s(186.5, 966404.03))
    beta = F.radians(5.13 * s(93.3, 483202.02) + 0.28 * s(228.2, 960400.89) - 0.28 * s(318.3, 6003.15) - 0.17 * s(217.6, -407332.21))
    par = F.radians(0.9508 + 0.0518 * c(135.0, 477198.87) + 0.0095 * c(259.3, -413335.36) + 0.0078 * c(235.7, 890534.22) + 0.0028 * c(269.9, 954397.74))
    r = G.RE / F.sin(par)
    eps = math.radians(23.439)
    l, m, n = F.cos(beta) * F.cos(lam), math.cos(eps) * F.cos(beta) * F.sin(lam) - math.sin(eps) * F.sin(beta), math.sin(eps) * F.cos(beta) * F.sin(lam) + math.cos(eps) * F.sin(beta)
    th = F.radians(280.46061837 + 360.98564736629 * d)
    return r * (l * F.cos(th) + m * F.sin(th)), r * (-l * F.sin(th) + m * F.cos(th)), r * n


def solid_tide(pos: tuple[Column, ...], body: tuple[Column, ...], ratio: float) -> tuple[Column, Column, Column]:
    """Degree-two solid Earth tide displacement by one body, in phase."""
    r, d = G.unit(pos), G.unit(body)
    k = ratio * G.RE**4 / F.pow(G.norm(*body), F.lit(3))
    c = G.dot(r, d)
    radial = k * H2 * (1.5 * c * c - 0.5)
    across = 3 * k * L2 * c
    return tuple(radial * r[i] + across * (d[i] - c * r[i]) for i in range(3))


def sun_elevation_over_orbit(pos: tuple[Column, ...], vel: tuple[Column, ...], sun: tuple[Column, ...]) -> Column:
    """The Sun's elevation over the orbital plane (beta)."""
    return F.asin(G.dot(G.unit(G.cross(pos, vel)), G.unit(sun)))


def orbit_angle(pos: tuple[Column, ...], vel: tuple[Column, ...], sun: tuple[Column, ...]) -> Column:
    """Angle along the orbit from midnight."""
    n = G.unit(G.cross(pos, vel))
    away = tuple(-(s - G.dot(sun, n) * k) for s, k in zip(sun, n, strict=True))
    e = G.unit(away)
    f = G.cross(n, e)
    return F.atan2(G.dot(pos, f), G.dot(pos, e))


def nominal_yaw(beta: Column, mu: Column) -> Column:
    """Yaw-steering angle for a Sun elevation and an orbit angle from midnight."""
    return F.atan2(-F.tan(beta), F.sin(mu))


def eclipsed(pos: tuple[Column, ...], sun: tuple[Column, ...]) -> Column:
    """In the cylindrical shadow of the Earth."""
    s = G.unit(sun)
    along = G.dot(pos, s)
    return (along < 0) & (F.sqrt(F.greatest(G.dot(pos, pos) - along * along, F.lit(0.0))) < G.RE)


def eclipse_filter(df: DataFrame, block: str, blocks: Sequence[str], pos: tuple[str, str, str], sun: tuple[str, str, str]) -> DataFrame:
    """Rows but those of the given satellite blocks in shadow."""
    dark = eclipsed(tuple(F.col(c) for c in pos), tuple(F.col(c) for c in sun))
    return df.where(~(F.coalesce(F.col(block).isin(*blocks), F.lit(False)) & dark))


def continued_fraction(el: Column, a: Column, b: Column, c: Column) -> Column:
    """Mapping function of three coefficients, 1 at the zenith."""
    s = F.sin(el)
    return (1 + a / (1 + b / (1 + c))) / (s + a / (s + b / (s + c)))


def height_correction(el: Column, height: Column) -> Column:
    """What a hydrostatic mapping function gains by height above the sea."""
    a, b, c = F.lit(2.53e-5), F.lit(5.49e-3), F.lit(1.14e-3)
    return (1 / F.sin(el) - continued_fraction(el, a, b, c)) * height / 1000


def legendre(n_max: int, x: np.ndarray) -> np.ndarray:
    """Fully normalised associated Legendre functions [n, m, point], without the Condon-Shortley phase."""
    p = np.zeros((n_max + 1, n_max + 1, len(x)))
    s = np.sqrt(1 - x * x)
    p[0, 0] = 1.0
    for n in range(1, n_max + 1):
        p[n, n] = s * p[n - 1, n - 1] * (math.sqrt(3.0) if n == 1 else math.sqrt((2 * n + 1) / (2 * n)))
        for m in range(n):
            f = math.sqrt((2 * n + 1) * (2 * n - 1) / ((n - m) * (n + m)))
            g = math.sqrt((2 * n + 1) * (n + m - 1) * (n - m - 1) / ((n - m) * (n + m) * (2 * n - 3))) if n >= 2 and n - 2 >= m else 0.0
            p[n, m] = f * x * p[n - 1, m] - (g * p[n - 2, m] if n >= 2 else 0.0)
    return p


def harmonic_vtec(c: np.ndarray, s: np.ndarray):
    """A column function of (latitude, Sun-fixed longitude) in radians: vertical TEC by spherical harmonics with coefficients c[n, m], s[n, m]."""
    n_max = c.shape[0] - 1

    @F.pandas_udf(DoubleType())
    def vtec(lat: pd.Series, lon: pd.Series) -> pd.Series:
        p = legendre(n_max, np.sin(lat.to_numpy(float)))
        m = np.arange(n_max + 1)[:, None] * lon.to_numpy(float)[None, :]
        return pd.Series((p * (c[:, :, None] * np.cos(m)[None] + s[:, :, None] * np.sin(m)[None])).sum((0, 1)))

    return vtec


def geomagnetic_field(g: np.ndarray, h: np.ndarray):
    """A column function of (geocentric latitude, longitude in radians, radius km): [north, east, down] in the coefficients' unit (Schmidt semi-normalised g[n, m], h[n, m])."""
    n_max = g.shape[0] - 1

    @F.pandas_udf(ArrayType(DoubleType()))
    def field(lat: pd.Series, lon: pd.Series, r: pd.Series) -> pd.Series:
        th, ph, a = math.pi / 2 - lat.to_numpy(float), lon.to_numpy(float), R_MAG_KM / r.to_numpy(float)
        step = 1e-6

        def potential_rows(angle: np.ndarray) -> np.ndarray:
            p = legendre(n_max, np.cos(angle))
            for n in range(n_max + 1):
                p[n] /= math.sqrt(2 * n + 1)
            return p

        p = potential_rows(th)
        dp = (potential_rows(th + step) - potential_rows(th - step)) / (2 * step)
        x = y = z = np.zeros(len(th))
        for n in range(1, n_max + 1):
            f = a ** (n + 2)
            for m in range(n + 1):
                cm, sm = np.cos(m * ph), np.sin(m * ph)
                w = g[n, m] * cm + h[n, m] * sm
                x = x + f * w * dp[n, m]
                y = y + f * m * (g[n, m] * sm - h[n, m] * cm) * p[n, m] / np.maximum(np.sin(th), 1e-9)
                z = z - f * (n + 1) * w * p[n, m]
        return pd.Series(list(np.column_stack([x, y, z])))

    return field


def repair_slips(d_gf: Column, d_mw: Column, lam1: float, lam2: float, tolerance: float = 0.25) -> tuple[Column, Column, Column]:
    """(n1, n2, accepted): the integer jumps of two phases from a jump in geometry-free metres and in wide-lane cycles. Accepted where both combinations fit within ``tolerance`` cycles."""
    wide = F.round(d_mw)
    n1f = (d_gf - lam2 * wide) / (lam1 - lam2)
    n1 = F.round(n1f)
    ok = (F.abs(d_mw - wide) < tolerance) & (F.abs(n1f - n1) < tolerance)
    return n1.cast("int"), (n1 - wide).cast("int"), ok


def relax(covariance: DataFrame, state_i: str, state_j: str, p: str, relaxed: str, ratio: float) -> DataFrame:
    """Long covariances with (ratio sigma)^2 added to the variance of every component of the relaxed state."""
    on = (F.col(state_i) == F.col(state_j)) & (F.col(state_i) == relaxed)
    return covariance.withColumn(p, F.when(on, F.col(p) * (1 + ratio * ratio)).otherwise(F.col(p)))


def expire_ambiguities(df: DataFrame, keys: Sequence[str], order: Sequence[str], rejected: str, slip: str, limit: int) -> DataFrame:
    """Adds reset: the row at which an ambiguity is reset, by a slip or by ``limit`` rejections in a row (counting begins anew after each)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    block = F.sum(F.when(F.col(rejected), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = df.withColumn("_b", block)
    run = F.sum(F.col(rejected).cast("int")).over(Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("reset", F.col(slip) | (F.col(rejected) & (run % limit == 0))).drop("_b")


def constraint_rows(kind: str, states: DataFrame, key: str, sigma: float) -> DataFrame:
    """Pseudo-observations (meas, key, coeff, value, var): 'zero' holds each state at zero, 'sum' their sum, 'pivot' the first state in order."""
    one = states.select(F.col(key).alias("key"))
    if kind == "pivot":
        one = one.groupBy().agg(F.min("key").alias("key")).where("key IS NOT NULL")
    name = F.lit("sum") if kind == "sum" else F.concat(F.lit(f"{kind}:"), "key")
    return one.select(name.alias("meas"), "key", F.lit(1.0).alias("coeff"), F.lit(0.0).alias("value"), F.lit(sigma * sigma).alias("var"))
