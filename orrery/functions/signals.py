"""Signal combinations, atmosphere and clock models as column expressions. Lengths are metres, angles radians, phases cycles."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions.geo import CLIGHT, dot

# Carrier frequencies in Hz, ionospheric constant, default broadcast ionosphere coefficients.
FREQ = {"L1": 1575.42e6, "L2": 1227.60e6, "L5": 1176.45e6, "E6": 1278.75e6, "E7": 1207.14e6, "E8": 1191.795e6, "B1": 1561.098e6, "B3": 1268.52e6}
TEC_CONSTANT = 40.3e16
KLOBUCHAR_DEFAULT = (0.1118e-07, -0.7451e-08, -0.5961e-07, 0.1192e-06, 0.1167e06, -0.2294e06, -0.1311e06, 0.1049e07)


def nonzero(c: Column) -> Column:
    """Zero means missing."""
    return F.when(c != 0, c)


def ionosphere_free(a: Column, b: Column, lam_a: Column, lam_b: Column) -> Column:
    d = lam_b * lam_b - lam_a * lam_a
    return lam_b * lam_b / d * nonzero(a) - lam_a * lam_a / d * nonzero(b)


def geometry_free(a: Column, b: Column) -> Column:
    return nonzero(a) - nonzero(b)


def wide_lane_length(lam_a: Column, lam_b: Column) -> Column:
    return lam_a * lam_b / (lam_b - lam_a)


def wide_lane_phase(la: Column, lb: Column, lam_a: Column, lam_b: Column) -> Column:
    """Wide-lane phase in metres from phases in cycles."""
    return (nonzero(la) - nonzero(lb)) * wide_lane_length(lam_a, lam_b)


def narrow_lane_code(pa: Column, pb: Column, lam_a: Column, lam_b: Column) -> Column:
    return (pa / lam_a + pb / lam_b) * (lam_a * lam_b / (lam_a + lam_b))


def melbourne_wuebbena(la: Column, lb: Column, pa: Column, pb: Column, lam_a: Column, lam_b: Column) -> Column:
    """Wide-lane cycles; null where any input is missing."""
    return (wide_lane_phase(la, lb, lam_a, lam_b) - narrow_lane_code(nonzero(pa), nonzero(pb), lam_a, lam_b)) / wide_lane_length(lam_a, lam_b)


def multipath(p: Column, la_m: Column, lb_m: Column, lam_a: Column, lam_b: Column) -> Column:
    """Code multipath from one code and two phases in metres."""
    a = lam_b * lam_b / (lam_a * lam_a)
    return p - (1 + 2 / (a - 1)) * la_m + (2 / (a - 1)) * lb_m


def observation_variance(sig_rec: Column, sig_sat: Column, el: Column, by_elevation: bool = True) -> Column:
    e = F.when(el == 0, math.pi / 8).otherwise(el)
    s = 1 / F.sin(e) if by_elevation else F.lit(1.0)
    return F.pow(sig_rec * s, 2) + F.pow(sig_sat * s, 2)


def klobuchar(tow: Column, lat: Column, lon: Column, az: Column, el: Column, coeff: Sequence[float] = KLOBUCHAR_DEFAULT) -> Column:
    """Broadcast ionospheric delay on L1 in metres; zero under the horizon or far below ground."""
    a, b = coeff[:4], coeff[4:]
    pi = math.pi
    psi = 0.0137 / (el / pi + 0.11) - 0.022
    phi = F.greatest(F.least(lat / pi + psi * F.cos(az), F.lit(0.416)), F.lit(-0.416))
    lam = lon / pi + psi * F.sin(az) / F.cos(phi * pi)
    phi_m = phi + 0.064 * F.cos((lam - 1.617) * pi)
    tt = F.pmod(43200.0 * lam + tow, F.lit(86400.0))
    f = 1.0 + 16.0 * F.pow(0.53 - el / pi, 3)
    amp = F.greatest(a[0] + phi_m * (a[1] + phi_m * (a[2] + phi_m * a[3])), F.lit(0.0))
    per = F.greatest(b[0] + phi_m * (b[1] + phi_m * (b[2] + phi_m * b[3])), F.lit(72000.0))
    x = 2 * pi * (tt - 50400.0) / per
    return F.when(el <= 0, 0.0).otherwise(CLIGHT * f * F.when(F.abs(x) < 1.57, 5e-9 + amp * (1 + x * x * (-0.5 + x * x / 24.0))).otherwise(5e-9))


def iono_mapping(el: Column, height_km: float = 450.0, kind: str = "SLM") -> Column:
    """Vertical to slant factor: single layer (SLM), its modified form (MSLM) or none."""
    if kind == "NONE":
        return F.lit(1.0)
    z = math.pi / 2 - el
    if kind == "MSLM":
        rp = 6371.0 / (6371.0 + 506.7) * F.sin(0.9782 * z)
    elif kind == "KLOBUCHAR":
        return 1 + 16 * F.pow(0.53 - el / math.pi, 3)
    else:
        rp = 6371.0 / (6371.0 + height_km) * F.sin(z)
    return 1 / F.sqrt(1 - rp * rp)


def pierce_point(lat: Column, lon: Column, az: Column, el: Column, height_km: float = 450.0, radius_km: float = 6371.0) -> tuple[Column, Column]:
    """Latitude and longitude where the line of sight meets the layer."""
    psi = math.pi / 2 - el - F.asin(radius_km / (radius_km + height_km) * F.cos(el))
    plat = F.asin(F.sin(lat) * F.cos(psi) + F.cos(lat) * F.sin(psi) * F.cos(az))
    return plat, lon + F.asin(F.sin(psi) * F.sin(az) / F.cos(plat))


def bilinear(v00: Column, v10: Column, v01: Column, v11: Column, a: Column, b: Column) -> Column:
    """Bilinear in a, b; with a corner missing the nearest corner, then the mean of what is there."""
    full = (1 - a) * (1 - b) * v00 + a * (1 - b) * v10 + (1 - a) * b * v01 + a * b * v11
    near = F.when((a <= 0.5) & (b <= 0.5), v00).when((a > 0.5) & (b <= 0.5), v10).when((a <= 0.5) & (b > 0.5), v01).otherwise(v11)
    have = F.array_compact(F.array(v00, v10, v01, v11))
    mean = F.aggregate(have, F.lit(0.0), lambda s, x: s + x) / F.size(have)
    return F.coalesce(full, near, F.when(F.size(have) > 0, mean))


def saastamoinen(lat: Column, height: Column, el: Column, humidity: float = 0.7) -> Column:
    """Slant tropospheric delay in a standard atmosphere; zero below -100 m, above 10 km and under the horizon."""
    h = F.greatest(height, F.lit(0.0))
    pres = 1013.25 * F.pow(1 - 2.2557e-5 * h, 5.2568)
    temp = 15.0 - 6.5e-3 * h + 273.16
    e = 6.108 * humidity * F.exp((17.15 * temp - 4684.0) / (temp - 38.45))
    z = math.pi / 2 - el
    dry = 0.0022768 * pres / (1 - 0.00266 * F.cos(2 * lat) - 0.00028 * h / 1000) / F.cos(z)
    wet = 0.002277 * (1255.0 / temp + 0.05) * e / F.cos(z)
    return F.when((height < -100) | (height > 1e4) | (el <= 0), 0.0).otherwise(dry + wet)


def gradient_mapping(az: Column, el: Column, c: float = 0.0031) -> tuple[Column, Column]:
    """Factors of the north and east gradients."""
    m = 1 / (F.sin(el) * F.tan(el) + c)
    return m * F.cos(az), m * F.sin(az)


def satellite_clock(f0: Column, f1: Column, f2: Column, dt: Column) -> Column:
    return f0 + f1 * dt + f2 * dt * dt


def relativity_periodic(pos: tuple[Column, ...], vel: tuple[Column, ...]) -> Column:
    """Periodic relativistic clock term in seconds."""
    return -2 * dot(pos, vel) / (CLIGHT * CLIGHT)


def shapiro(rs: Column, rr: Column, rng: Column, mu: float = 3.986004418e14) -> Column:
    """Shapiro delay in metres from the two geocentric radii and the range."""
    return 2 * mu / (CLIGHT * CLIGHT) * F.log((rs + rr + rng) / (rs + rr - rng))


def kepler_anomaly(m: Column, e: Column, rounds: int = 12) -> Column:
    """Eccentric anomaly by a fixed number of Newton steps (converged for e under 0.9)."""
    return F.aggregate(F.array_repeat(F.lit(0), rounds), m + e * F.sin(m), lambda x, _: x - (x - e * F.sin(x) - m) / (1 - e * F.cos(x)))


def protection_levels(p_ee: Column, p_nn: Column, p_en: Column, p_uu: Column, k_h: float = 6.0, k_v: float = 5.33) -> tuple[Column, Column]:
    """Horizontal and vertical protection levels from the position covariance."""
    half, diff = (p_ee + p_nn) / 2, (p_ee - p_nn) / 2
    return k_h * F.sqrt(half + F.sqrt(diff * diff + p_en * p_en)), k_v * F.sqrt(p_uu)


def met_mapping_wet(el: Column) -> Column:
    return 1.001 / F.sqrt(0.002001 + F.pow(F.sin(el), 2))


