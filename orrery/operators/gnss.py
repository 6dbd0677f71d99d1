"""Satellite-positioning composites: orbits, clocks, corrections, slips, differences, single-point solutions and delay grids.

Each is a chain of equi-joins, windows and staged columns; numerical integration runs as Arrow UDFs vectorised over rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from orrery.functions import geo as G
from orrery.functions import signals as P
from orrery.operators.estimate import map_small_groups, wls
from orrery.operators.joins import asof_join
from orrery.session import micros

# Earth's gravity constant, rotation, second zonal harmonic; the Sun's radius and the astronomical unit.
MU = 3.9860050e14
MU_GLO, J2_GLO, RE_GLO, OMEGA_GLO = 3.9860044e14, 1.0826257e-3, 6378136.0, 7.292115e-5
R_SUN, AU = 6.957e8, 1.495978707e11
# Mean and seasonal meteorology by latitude band (15 to 75 degrees): pressure, temperature, vapour, lapse rate, vapour lapse.
MET_MEAN = ((15, 1013.25, 299.65, 26.31, 6.30e-3, 2.77), (30, 1017.25, 294.15, 21.79, 6.05e-3, 3.15), (45, 1015.75, 283.15, 11.66, 5.58e-3, 2.57), (60, 1011.75, 272.15, 6.78, 5.39e-3, 1.81), (75, 1013.00, 263.65, 4.11, 4.53e-3, 1.55))
MET_SEASON = ((15, 0.0, 0.0, 0.0, 0.0, 0.0), (30, -3.75, 7.0, 8.85, 0.25e-3, 0.33), (45, -2.25, 11.0, 7.24, 0.32e-3, 0.46), (60, -1.75, 15.0, 5.36, 0.81e-3, 0.74), (75, -0.50, 14.5, 3.39, 0.62e-3, 0.30))
# Angular speeds of the eleven main tides in radians a second.
TIDE_SPEED = {"M2": 1.40519e-4, "S2": 1.45444e-4, "N2": 1.37880e-4, "K2": 1.45842e-4, "K1": 0.72921e-4, "O1": 0.67598e-4, "P1": 0.72523e-4, "Q1": 0.64959e-4, "MF": 0.053234e-4, "MM": 0.026392e-4, "SSA": 0.003982e-4}


def broadcast_positions(df: DataFrame, t_s: str) -> DataFrame:
    """Adds x, y, z, clk of Keplerian ephemerides (sqrtA, e, i0, OMG0, omg, M0, deln, OMGd, idot, cuc, cus, crc, crs, cic, cis, toe, toc, f0, f1, f2), times in seconds of one week."""
    wrap = F.pmod(F.col(t_s) - F.col("toe") + 302_400, F.lit(604_800.0)) - 302_400
    x = df.withColumn("_tk", wrap).withColumn("_A", F.col("sqrtA") * F.col("sqrtA"))
    x = x.withColumn("_M", F.col("M0") + (F.sqrt(MU / F.pow("_A", F.lit(3))) + F.col("deln")) * F.col("_tk"))
    x = x.withColumn("_E", P.kepler_anomaly(F.col("_M"), F.col("e")))
    x = x.withColumn("_u", F.atan2(F.sqrt(1 - F.col("e") * F.col("e")) * F.sin("_E"), F.cos("_E") - F.col("e")) + F.col("omg"))
    x = x.withColumns({"_s2": F.sin(2 * F.col("_u")), "_c2": F.cos(2 * F.col("_u"))})
    x = x.withColumns({
        "_uu": F.col("_u") + F.col("cus") * F.col("_s2") + F.col("cuc") * F.col("_c2"),
        "_r": F.col("_A") * (1 - F.col("e") * F.cos("_E")) + F.col("crs") * F.col("_s2") + F.col("crc") * F.col("_c2"),
        "_i": F.col("i0") + F.col("idot") * F.col("_tk") + F.col("cis") * F.col("_s2") + F.col("cic") * F.col("_c2"),
        "_O": F.col("OMG0") + (F.col("OMGd") - G.OMEGA_E) * F.col("_tk") - G.OMEGA_E * F.col("toe"),
    })
    x = x.withColumns({"_xp": F.col("_r") * F.cos("_uu"), "_yp": F.col("_r") * F.sin("_uu")})
    dt = F.pmod(F.col(t_s) - F.col("toc") + 302_400, F.lit(604_800.0)) - 302_400
    rel = -2 * F.sqrt(F.lit(MU) * F.col("_A")) * F.col("e") * F.sin("_E") / (G.CLIGHT * G.CLIGHT)
    x = x.withColumns({
        "x": F.col("_xp") * F.cos("_O") - F.col("_yp") * F.cos("_i") * F.sin("_O"),
        "y": F.col("_xp") * F.sin("_O") + F.col("_yp") * F.cos("_i") * F.cos("_O"),
        "z": F.col("_yp") * F.sin("_i"),
        "clk": P.satellite_clock(F.col("f0"), F.col("f1"), F.col("f2"), dt) + rel,
    })
    return x.drop(*[f"_{c}" for c in ("tk", "A", "M", "E", "u", "s2", "c2", "uu", "r", "i", "O", "xp", "yp")])


def _rk4(state: np.ndarray, dt: np.ndarray, force, step: float) -> np.ndarray:
    n = max(1, int(np.ceil(np.nanmax(np.abs(dt)) / step))) if len(dt) else 1
    h = (dt / n)[:, None]
    for _ in range(n):
        a = force(state)
        b = force(state + h / 2 * a)
        c = force(state + h / 2 * b)
        state = state + h / 6 * (a + 2 * b + 2 * c + force(state + h * c))
    return state


@F.pandas_udf(ArrayType(DoubleType()))
def glonass_state(state: pd.Series, acc: pd.Series, dt: pd.Series) -> pd.Series:
    """[x, y, z, vx, vy, vz] carried over dt seconds in the rotating frame with constant luni-solar acceleration, at most 60 s a step."""
    if not len(dt):
        return pd.Series([], dtype=object)
    s, a = np.stack(state.to_numpy()), np.stack(acc.to_numpy())

    def force(y: np.ndarray) -> np.ndarray:
        r2 = (y[:, :3] ** 2).sum(1)
        r3 = r2 * np.sqrt(r2)
        k = 1.5 * J2_GLO * MU_GLO * RE_GLO**2 / (r2 * r3)
        z2 = 5 * y[:, 2] ** 2 / r2
        base = -MU_GLO / r3 - k * (1 - z2)
        return np.column_stack([
            y[:, 3:], (base + OMEGA_GLO**2) * y[:, 0] + 2 * OMEGA_GLO * y[:, 4] + a[:, 0], (base + OMEGA_GLO**2) * y[:, 1] - 2 * OMEGA_GLO * y[:, 3] + a[:, 1], (base - 2 * k) * y[:, 2] + a[:, 2],
        ])

    return pd.Series(list(_rk4(s, dt.to_numpy(float), force, 60.0)))


@F.pandas_udf(ArrayType(DoubleType()))
def propagate_inertial(state: pd.Series, dt: pd.Series) -> pd.Series:
    """An inertial state carried over dt seconds under gravity to the second zonal harmonic, at most 30 s a step."""
    if not len(dt):
        return pd.Series([], dtype=object)
    s = np.stack(state.to_numpy())

    def force(y: np.ndarray) -> np.ndarray:
        r2 = (y[:, :3] ** 2).sum(1)
        r = np.sqrt(r2)
        k = 1.5 * 1.0826257e-3 * MU * G.RE**2 / (r2 * r2 * r)
        z2 = 5 * y[:, 2] ** 2 / r2
        g = -MU / (r2 * r)
        return np.column_stack([y[:, 3:], (g - k * (1 - z2)) * y[:, 0], (g - k * (1 - z2)) * y[:, 1], (g - k * (3 - z2)) * y[:, 2]])

    return pd.Series(list(_rk4(s, dt.to_numpy(float), force, 30.0)))


def apply_ssr(df: DataFrame, max_norm: float = 15.0, validity: float = 1.0) -> DataFrame:
    """Adds sx, sy, sz: broadcast positions (x, y, z, vx, vy, vz) minus radial, along and cross corrections (r0..c0, r1..c1 a second, age, udi); null when too old or too large."""
    d = {k: F.col(f"{k}0") + F.col(f"{k}1") * F.col("age") for k in "rac"}
    x = df.withColumns({f"_d{k}": v for k, v in d.items()})
    pos, vel = tuple(F.col(c) for c in "xyz"), tuple(F.col(f"v{c}") for c in "xyz")
    ea = G.unit(vel)
    ec = G.unit(G.cross(pos, vel))
    er = G.cross(ea, ec)
    ok = (F.abs("age") <= F.col("udi") * validity) & (G.norm(F.col("_dr"), F.col("_da"), F.col("_dc")) <= max_norm)
    return x.withColumns({f"s{c}": F.when(ok, F.col(c) - (er[i] * F.col("_dr") + ea[i] * F.col("_da") + ec[i] * F.col("_dc"))) for i, c in enumerate("xyz")}).drop("_dr", "_da", "_dc")


def bias_at(left: DataFrame, biases: DataFrame, on: Sequence[str], time: str, bucket_s: float = 86_400.0) -> DataFrame:
    """Adds bias and bias_var: linear between the entries (tini, bias, slope, var, slope_var) before and after, else the earlier one carried on by its slope."""
    b = asof_join(left, biases, on, time, "tini", "backward", None, bucket_s).withColumnRenamed("right", "_b")
    n = asof_join(b, biases, on, time, "tini", "forward", None, bucket_s).withColumnRenamed("right", "_n")
    t, t0, t1 = micros(time), F.unix_micros(F.col("_b.tini").cast("timestamp")), F.unix_micros(F.col("_n.tini").cast("timestamp"))
    f = (t - t0) / (t1 - t0)
    age = (t - t0) / 1e6
    between = F.col("_b.bias") + (F.col("_n.bias") - F.col("_b.bias")) * f
    value = F.when(t0 == t, F.col("_b.bias")).when(F.col("_n").isNotNull(), between).otherwise(F.col("_b.bias") + F.coalesce(F.col("_b.slope"), F.lit(0.0)) * age)
    var = F.when(t0 == t, F.col("_b.var")).when(F.col("_n").isNotNull(), (1 - f) * (1 - f) * F.col("_b.var") + f * f * F.col("_n.var")).otherwise(F.col("_b.var") + F.coalesce(F.col("_b.slope_var"), F.lit(0.0)) * age * age)
    return n.withColumn("bias", value).withColumn("bias_var", var).drop("_b", "_n")


def slips(df: DataFrame, keys: Sequence[str], time: str, l1: str, l2: str, p1: str, p2: str, lam1: float, lam2: float, lli: str | None = None, gf_limit: float = 0.05, mw_limit: float = 10.0, gap_s: float = 60.0) -> DataFrame:
    """Adds gf, mw, gap_s, first, slip_gap, slip_gf, slip_mw, slip_lli: phases in cycles, codes in metres. MW is held against the mean of its arc so far."""
    w = Window.partitionBy(*keys).orderBy(time)
    a, b = F.lit(lam1), F.lit(lam2)
    c = {k: F.col(v) for k, v in (("l1", l1), ("l2", l2), ("p1", p1), ("p2", p2))}
    x = df.withColumn("gf", P.geometry_free(c["l1"] * lam1, c["l2"] * lam2)).withColumn("mw", P.melbourne_wuebbena(c["l1"], c["l2"], c["p1"], c["p2"], a, b))
    x = x.withColumn("gap_s", (micros(time) - F.lag(micros(time)).over(w)) / 1e6).withColumn("first", F.col("gap_s").isNull())
    x = x.withColumn("slip_gap", F.coalesce(F.col("gap_s") > gap_s, F.lit(False)))
    prev = F.last("gf", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("slip_gf", ~F.col("slip_gap") & F.coalesce(F.abs(F.col("gf") - prev) > gf_limit, F.lit(False)))
    bits = (F.col(lli).bitwiseAND(3) != 0) & (F.col(l1) != 0) if lli else F.lit(False)
    x = x.withColumn("slip_lli", F.coalesce(bits, F.lit(False)))
    arc = F.sum((F.col("slip_gap") | F.col("slip_gf") | F.col("slip_lli")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_arc", arc)
    mean = F.avg("mw").over(Window.partitionBy(*keys, "_arc").orderBy(time).rowsBetween(Window.unboundedPreceding, -1))
    return x.withColumn("slip_mw", F.coalesce(F.abs(F.col("mw") - mean) > mw_limit, F.lit(False))).drop("_arc")


def unwrap(df: DataFrame, keys: Sequence[str], order: Sequence[str], raw: str, out: str = "unwrapped") -> DataFrame:
    """Adds a continuous count from an angle in cycles: the first value plus the summed differences, each within half a cycle (phase wind-up)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = F.col(raw) - F.lag(raw).over(w)
    return df.withColumn("_d", F.coalesce(d - F.round(d), F.col(raw))).withColumn(out, F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def double_differences(df: DataFrame, base: str, rover: str, epoch: str, sat: str, signal: str, value: str, quality: str) -> DataFrame:
    """(rover, epoch, signal, sat, reference, value): rover minus base, then satellite minus the epoch's reference, the satellite of highest quality at the base."""
    b = df.where(F.col(rover) == base).select(epoch, sat, signal, F.col(value).alias("_b"), F.col(quality).alias("_q"))
    single = df.where(F.col(rover) != base).join(b, [epoch, sat, signal]).withColumn("_sd", F.col(value) - F.col("_b"))
    ref = single.groupBy(rover, epoch, signal).agg(F.max_by(F.struct(F.col(sat).alias("s"), F.col("_sd").alias("v")), F.struct("_q", sat)).alias("_r"))
    j = single.join(ref, [rover, epoch, signal]).where(F.col(sat) != F.col("_r.s"))
    return j.select(rover, epoch, signal, sat, F.col("_r.s").alias("reference"), (F.col("_sd") - F.col("_r.v")).alias("value"))


def single_point(df: DataFrame, group: Sequence[str], sat: str, rounds: int = 10) -> DataFrame:
    """(group, x, y, z, clk, n, chi2, pdop): iterated weighted least squares on pseudoranges P (corrected for the satellite clock) with satellite positions x, y, z and variance var.

    Groups are epochs of one receiver. Fewer than four satellites, or a solution that does not settle, gives none.
    """
    def run(rows: list[tuple]) -> list[tuple]:
        m = np.array([r[1:] for r in rows], dtype=float)
        m = m[np.isfinite(m).all(1)]
        if len(m) < 4:
            return []
        pos, p, w = m[:, :3], m[:, 3], 1 / m[:, 4]
        x = np.zeros(4)
        for _ in range(rounds):
            d = pos - x[:3]
            r = np.sqrt((d**2).sum(1))
            h = np.column_stack([-d / r[:, None], np.ones(len(m))])
            rho = r + G.OMEGA_E * (pos[:, 0] * x[1] - pos[:, 1] * x[0]) / G.CLIGHT + x[3]
            v = p - rho
            s = wls(h, v, w)
            if s is None or not np.isfinite(s[0]).all():
                return []
            x += s[0]
            if np.abs(s[0]).max() < 1e-4:
                e = v - h @ s[0]
                q = np.linalg.inv(h.T @ h)
                return [(*map(float, x), len(m), float((w * e * e).sum()), float(np.sqrt(np.trace(q[:3, :3]))))]
        return []

    return map_small_groups(df, group, [sat, "x", "y", "z", "P", "var"], run, "px double, py double, pz double, clk double, n int, chi2 double, pdop double")


def tec_at(points: DataFrame, maps: DataFrame, point_id: str, time_us: str, lat: str, lon: str, dt_s: float, dlat: float, dlon: float) -> DataFrame:
    """(point, tec, corners): linear in time and bilinear in place between regular maps (epoch_us, lat, lon, tec). The eight corners are one equi-join on grid cells; missing corners are left out of the weights."""
    step = int(dt_s * 1e6)
    fi, fj, fk = F.col(lat) / dlat, F.col(lon) / dlon, F.col(time_us) / step
    p = points.select(F.col(point_id).alias("_id"), fi.alias("_fi"), fj.alias("_fj"), fk.alias("_fk"))
    bits = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (0, 1) for b in (0, 1) for c in (0, 1)]))
    p = p.withColumn("_x", bits)

    def part(f: str, bit: str) -> tuple[Column, Column]:
        low = F.floor(f)
        share = F.col(f) - low
        return low + F.col(f"_x.{bit}"), F.when(F.col(f"_x.{bit}") == 1, share).otherwise(1 - share)

    (i, wi), (j, wj), (k, wk) = part("_fi", "a"), part("_fj", "b"), part("_fk", "c")
    p = p.select("_id", i.alias("_i"), j.alias("_j"), k.alias("_k"), (wi * wj * wk).alias("_w")).where("_w > 0")
    m = maps.select(F.round(F.col("lat") / dlat).cast("long").alias("_i"), F.round(F.col("lon") / dlon).cast("long").alias("_j"), F.round(F.col("epoch_us") / step).cast("long").alias("_k"), "tec").where("tec IS NOT NULL")
    return p.join(m, ["_i", "_j", "_k"]).groupBy("_id").agg((F.sum(F.col("_w") * F.col("tec")) / F.sum("_w")).alias("tec"), F.count("*").alias("corners")).withColumnRenamed("_id", point_id)


def grid_corners(lat: Column, lon: Column, step: float) -> Column:
    """The four surrounding ionosphere grid points with their bilinear weights."""
    i, j = F.floor(lat / step), F.floor(lon / step)
    a, b = lat / step - i, lon / step - j
    return F.array(*[F.struct(((i + di) * step).cast("double").alias("lat"), ((j + dj) * step).cast("double").alias("lon"), ((a if di else 1 - a) * (b if dj else 1 - b)).alias("weight")) for di in (0, 1) for dj in (0, 1)])


def sun_position(us: Column) -> tuple[Column, Column, Column]:
    """The Sun in the Earth-fixed frame, metres, by the low-precision almanac formula (about 0.01 degree)."""
    d = us / 86_400e6 + 40_587 - 51_544.5
    g = F.radians(357.529 + 0.98560028 * d)
    lam = F.radians(280.459 + 0.98564736 * d + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g))
    r = (1.00014 - 0.01671 * F.cos(g) - 0.00014 * F.cos(2 * g)) * AU
    eps = F.radians(23.439 - 0.00000036 * d)
    x, y, z = r * F.cos(lam), r * F.cos(eps) * F.sin(lam), r * F.sin(eps) * F.sin(lam)
    th = F.radians(280.46061837 + 360.98564736629 * d)
    return x * F.cos(th) + y * F.sin(th), -x * F.sin(th) + y * F.cos(th), z


def sun_visibility(sat: tuple[Column, ...], sun: tuple[Column, ...]) -> Column:
    """Share of the Sun's disk a satellite sees past the Earth: 1 in the light, 0 in the shadow, by overlapping disks between."""
    to = tuple(b - a for a, b in zip(sat, sun, strict=True))
    rs, rd = G.norm(*sat), G.norm(*to)
    a, b = F.asin(R_SUN / rd), F.asin(G.RE / rs)
    c = F.acos(F.greatest(F.least(-G.dot(sat, to) / (rs * rd), F.lit(1.0)), F.lit(-1.0)))
    x = (c * c + a * a - b * b) / (2 * c)
    y = F.sqrt(F.greatest(a * a - x * x, F.lit(0.0)))
    lens = a * a * F.acos(F.greatest(F.least(x / a, F.lit(1.0)), F.lit(-1.0))) + b * b * F.acos(F.greatest(F.least((c - x) / b, F.lit(1.0)), F.lit(-1.0))) - c * y
    return F.when(c >= a + b, 1.0).when(c <= b - a, 0.0).otherwise(1 - lens / (math.pi * a * a))


def tide_displacement(points: DataFrame, loading: DataFrame, site: str, time_us: str) -> DataFrame:
    """(point columns, axis, metres): loading displacement as the sum over constituents (site, axis, constituent, amplitude, phase in degrees)."""
    speed = F.create_map(*[F.lit(v) for kv in TIDE_SPEED.items() for v in kv])
    l = loading.withColumn("_w", F.try_element_at(speed, F.col("constituent"))).where("_w IS NOT NULL").select(site, "axis", "amplitude", "phase", "_w")
    arg = F.col("_w") * (F.col(time_us) / 1e6) - F.radians("phase")
    return points.join(l, site).groupBy(*points.columns, "axis").agg(F.sum(F.col("amplitude") * F.cos(arg)).alias("metres"))


def pattern_at(pcv: Column, zen1: Column, dzen: Column, zenith_deg: Column) -> Column:
    """Linear interpolation of an antenna pattern array at a zenith angle; clamped to its ends."""
    f = F.greatest(F.least((zenith_deg - zen1) / dzen, (F.size(pcv) - 1).cast("double")), F.lit(0.0))
    i = F.least(F.floor(f).cast("int"), F.size(pcv) - 2)
    return F.get(pcv, i) + (F.get(pcv, i + 1) - F.get(pcv, i)) * (f - i)


def seasonal_trop(lat_deg: Column, height: Column, doy: Column, el: Column) -> tuple[Column, Column]:
    """(slant delay, mapping): climatology by latitude and season, south of the equator half a year later."""
    a = F.abs(lat_deg)

    def band(table: tuple, col: int) -> Column:
        out = F.lit(table[-1][col])
        for lo, hi in zip(reversed(table[:-1]), reversed(table[1:]), strict=True):
            out = F.when(a <= hi[0], lo[col] + (hi[col] - lo[col]) * (F.greatest(a, F.lit(float(lo[0]))) - lo[0]) / (hi[0] - lo[0])).otherwise(out)
        return F.when(a <= table[0][0], table[0][col]).otherwise(out)

    season = F.cos(2 * math.pi * (doy - F.when(lat_deg >= 0, 28).otherwise(211)) / 365.25)
    pres, temp, vap, beta, lam = (band(MET_MEAN, k) - band(MET_SEASON, k) * season for k in range(1, 6))
    k1, k2, rd, gm, g = 77.604, 382000.0, 287.054, 9.784, 9.80665
    dry0 = 1e-6 * k1 * rd * pres / gm
    wet0 = 1e-6 * k2 * rd / (gm * (lam + 1) - beta * rd) * vap / temp
    base = 1 - beta * height / temp
    dry, wet = dry0 * F.pow(base, g / (rd * beta)), wet0 * F.pow(base, (lam + 1) * g / (rd * beta) - 1)
    m = P.met_mapping_wet(el)
    return (dry + wet) * m, m


def chunks(design: DataFrame, meas: str, state: str, receiver: str, target: int) -> DataFrame:
    """(receiver, chunk): receivers spread over about ``target`` chunks by their number of rows; one chunk for all where any state is shared by receivers."""
    shared = design.groupBy(state).agg(F.countDistinct(receiver).alias("n")).where("n > 1").limit(1)
    n = design.groupBy(receiver).agg(F.countDistinct(meas).alias("_n"))
    w = Window.orderBy(F.desc("_n"), receiver)
    total = F.sum("_n").over(Window.partitionBy())
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    one = shared.agg(F.count("*").alias("_one"))
    return n.withColumn("chunk", F.floor(before * target / total).cast("int")).crossJoin(F.broadcast(one)).select(receiver, F.when(F.col("_one") > 0, 0).otherwise(F.col("chunk")).alias("chunk"))


def combine_ssr(orbit: DataFrame, clock: DataFrame, on: Sequence[str], time: str, iod: str, max_gap_s: float) -> DataFrame:
    """Orbit corrections with the clock correction of the same issue nearest in time, within max_gap_s."""
    j = asof_join(orbit, clock, [*on, iod], time, time, "nearest", max_gap_s, 86_400.0)
    return j.where(F.col("right").isNotNull())


def newest_set(df: DataFrame, by: Sequence[str], *order: str) -> DataFrame:
    """All rows of the newest (order...) set of each key: a semi-join on the key's maximum."""
    top = df.groupBy(*by).agg(F.max(F.struct(*order)).alias("_m")).select(*by, *[F.col(f"_m.{c}").alias(c) for c in order])
    return df.join(top, [*by, *order], "left_semi")
