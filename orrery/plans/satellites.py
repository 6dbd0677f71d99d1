"""Satellite-positioning composites over the driver's tables. Geometry the tables lack is made from their keys, as each docstring says."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from orrery.functions import geo as G
from orrery.functions import time as T
from orrery.operators import estimate as E
from orrery.operators import gnss as N
from orrery.operators import models as M
from orrery.plans.util import q6, r6, rounded
from orrery.session import micros, sized, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _ephemerides(spark, base):
    """A circular-like ephemeris per satellite of the residuals, spread over six planes."""
    s = table(spark, base, "residual").select("sat").distinct().withColumn("k", F.substring("sat", 2, 2).cast("double") + F.ascii("sat"))
    zero = {c: F.lit(0.0) for c in ("deln", "idot", "cuc", "cus", "crc", "crs", "cic", "cis", "f2", "toc")}
    return s.withColumns({"sqrtA": F.lit(5153.7), "e": F.lit(0.01), "i0": F.lit(0.96), "OMG0": F.col("k") * 1.047, "omg": F.lit(0.3), "M0": F.col("k") * 0.7, "OMGd": F.lit(-8e-9), "toe": F.lit(0.0), "f0": F.col("k") * 1e-6, "f1": F.lit(1e-12), **zero})


def _orbit(spark, base):
    e = table(spark, base, "residual").select("sat", F.floor(micros("datetime") / 900e6).alias("slot")).distinct()
    j = e.join(_ephemerides(spark, base), "sat").withColumn("t", F.pmod(F.col("slot") * 900 - 315_964_800, F.lit(604_800)).cast("double"))
    return N.broadcast_positions(j, "t").select("sat", "slot", "t", "x", "y", "z", "clk")


@query()
def broadcast_orbits(spark, base):
    """Radius and clock of every satellite and quarter hour."""
    o = _orbit(spark, base)
    return o.select("sat", "slot", F.round(G.norm(F.col("x"), F.col("y"), F.col("z")), 3).alias("radius"), F.round("clk", 12).alias("clk"))


@query()
def orbit_propagation(spark, base):
    """A state per satellite carried a quarter of an hour and back by numerical integration; what is left of the position, metres."""
    s = _ephemerides(spark, base).select("sat", F.array(F.lit(2.6e7), F.lit(0.0), F.lit(0.0), F.lit(0.0), 2000 + F.col("k"), F.lit(3000.0)).alias("s"))
    there = s.withColumn("q", N.propagate_inertial(F.col("s"), F.lit(900.0)))
    back = there.withColumn("b", N.propagate_inertial(F.col("q"), F.lit(-900.0)))
    return back.select("sat", F.round(F.abs(F.col("b")[0] - F.col("s")[0]), 3).alias("left"), F.round(F.col("q")[0], 1).alias("x"))


@query()
def glonass_orbits(spark, base):
    s = _ephemerides(spark, base).select("sat", F.array(F.lit(1.2e7), F.lit(0.9e7), F.lit(2.0e7), F.lit(1500.0), F.col("k"), F.lit(-1500.0)).alias("s"), F.array(*[F.lit(0.0)] * 3).alias("a"))
    q = s.withColumn("q", N.glonass_state(F.col("s"), F.col("a"), F.lit(450.0)))
    return q.select("sat", *[F.round(F.col("q")[i], 1).alias(c) for i, c in enumerate("xyz")])


@query()
def ssr_corrected_orbits(spark, base):
    o = _orbit(spark, base)
    v = o.withColumns({"vx": -F.col("y") * 1e-4, "vy": F.col("x") * 1e-4, "vz": F.lit(500.0), "r0": F.lit(0.1), "a0": F.lit(0.2), "c0": F.lit(-0.1), "r1": F.lit(0.0), "a1": F.lit(0.001), "c1": F.lit(0.0), "age": F.pmod(F.col("slot"), F.lit(7)) * 10.0, "udi": F.lit(60.0)})
    c = N.apply_ssr(v)
    return c.select("sat", "slot", F.round(F.col("sx") - F.col("x"), 4).alias("dx"), F.round(F.col("sz") - F.col("z"), 4).alias("dz"))


@query()
def single_point_positions(spark, base):
    """Receivers on a sphere solved from pseudoranges to the broadcast orbits at every quarter hour they have data of; distance from where they were put, metres."""
    o = _orbit(spark, base)
    r = table(spark, base, "residual").select("recv", "sat", F.floor(micros("datetime") / 900e6).alias("slot")).distinct()
    s = table(spark, base, "station")
    x, y, z = G.geodetic_to_ecef(F.radians("Latitude"), F.radians("Longitude"), F.col("Elevation"))
    s = s.select(F.col("site").alias("recv"), x.alias("rx"), y.alias("ry"), z.alias("rz"))
    all_sats = r.select("recv", "slot").distinct().join(o, "slot").join(s, "recv")
    rng = G.geometric_range((F.col("x"), F.col("y"), F.col("z")), (F.col("rx"), F.col("ry"), F.col("rz")))
    p = all_sats.withColumn("P", rng + 30.0).withColumn("var", F.lit(1.0))
    sol = N.single_point(p, ["recv", "slot"], "sat").join(s, "recv")
    return sol.select("recv", "slot", "n", F.round(G.norm(F.col("px") - F.col("rx"), F.col("py") - F.col("ry"), F.col("pz") - F.col("rz")), 2).alias("off"), F.round("clk", 2).alias("clk"))


@query()
def slip_flags(spark, base):
    """Two-frequency slip tests on a station's displacement readings in place of phases and codes."""
    p = table(spark, base, "pos_solution").where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ("dN", "dE", "dU")))
    d = p.withColumns({"L1": F.col("dN") * 5 + 100, "L2": F.col("dE") * 4 + 100, "P1": F.col("dU") + 20, "P2": F.col("dU") + 20})
    one = d.groupBy("site", "Time").agg(*[F.min(c).alias(c) for c in ("L1", "L2", "P1", "P2")])
    f = N.slips(one, ["site"], "Time", "L1", "L2", "P1", "P2", 0.19029367, 0.24421021, gap_s=3600)
    return f.groupBy("site").agg(*[F.sum(F.col(c).cast("int")).alias(c) for c in ("slip_gap", "slip_gf", "slip_mw", "slip_lli")])


@query("""WITH e AS (SELECT event_id, user_id, ts, value / 200.0 - floor(value / 200.0) AS raw FROM events), d AS (SELECT *, raw - lag(raw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM e)
SELECT event_id, (round(sum(coalesce(d - round(d), raw)) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 1e-9, 6) + 0.0) AS unwrapped FROM d""")
def wind_up(spark, base):
    e = table(spark, base, "events").withColumn("raw", F.col("value") / 200.0 - F.floor(F.col("value") / 200.0))
    return N.unwrap(e, ["user_id"], ["ts", "event_id"], "raw").select("event_id", r6("unwrapped").alias("unwrapped"))


@query("""WITH s AS (SELECT l_suppkey % 7 AS r, l_orderkey AS e, l_linenumber AS s, max(l_quantity) AS v FROM lineitem GROUP BY ALL), b AS (SELECT * FROM s WHERE r = 0),
d AS (SELECT s.r, s.e, s.s, s.v - b.v AS v, b.v AS q FROM s JOIN b USING (e, s) WHERE s.r <> 0), f AS (SELECT *, row_number() OVER (PARTITION BY r, e ORDER BY q DESC, s DESC) AS k FROM d)
SELECT d.r, d.e, d.s AS sat, f.s AS reference, d.v - f.v AS value FROM d JOIN f ON d.r = f.r AND d.e = f.e AND f.k = 1 WHERE d.s <> f.s""")
def double_differences(spark, base):
    l = table(spark, base, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("r"), F.col("l_orderkey").alias("e"), F.col("l_linenumber").alias("s")).agg(F.max("l_quantity").alias("v"))
    d = N.double_differences(l.withColumn("sig", F.lit("x")).withColumn("q", F.col("v")), 0, "r", "e", "s", "sig", "v", "q")
    return d.select("r", "e", F.col("s").alias("sat"), "reference", "value")


@query()
def tec_interpolation(spark, base):
    """TEC at every event's made-up place and time from two-hourly five-degree maps of a plane, which linear interpolation gives back."""
    e = table(spark, base, "events").select("event_id", micros("ts").alias("us"), ((F.col("user_id") * 13) % 1500 / 10.0 - 70).alias("lat"), ((F.col("user_id") * 29) % 3400 / 10.0 - 170).alias("lon"))
    span = e.agg(F.floor(F.min("us") / 7200e6), F.floor(F.max("us") / 7200e6)).first()
    if span[0] is None:
        return e.select("event_id", F.lit(None).cast("double").alias("tec"), F.lit(None).cast("long").alias("corners")).where("false")
    k = spark.range(int(span[0]), int(span[1]) + 2).withColumnRenamed("id", "k")
    grid = spark.range(37 * 73).select((F.floor(F.col("id") / 73) * 5 - 90).cast("double").alias("lat"), (F.col("id") % 73 * 5 - 180).cast("double").alias("lon"))
    m = grid.crossJoin(k).select((F.col("k") * 7_200_000_000).alias("epoch_us"), "lat", "lon", (20 + 0.1 * F.col("lat") + 0.02 * F.col("lon") + 0.5 * (F.col("k") - int(span[0]))).alias("tec"))
    return rounded(N.tec_at(e, m, "event_id", "us", "lat", "lon", 7200.0, 5.0, 5.0), "tec")


SQL["tec_interpolation"] = f"""WITH e AS (SELECT event_id, epoch_us(ts) AS us, (user_id * 13) % 1500 / 10.0 - 70 AS lat, (user_id * 29) % 3400 / 10.0 - 170 AS lon FROM events), s AS (SELECT floor(min(epoch_us(ts)) / 7200e6) AS k FROM events)
SELECT event_id, {q6("20 + 0.1 * lat + 0.02 * lon + 0.5 * (us / 7200e6 - k)")} AS tec, CAST((CASE WHEN lat / 5 = floor(lat / 5) THEN 1 ELSE 2 END) * (CASE WHEN lon / 5 = floor(lon / 5) THEN 1 ELSE 2 END) * (CASE WHEN us / 7200e6 = floor(us / 7200e6) THEN 1 ELSE 2 END) AS BIGINT) AS corners FROM e, s"""


@query()
def sun_and_shadow(spark, base):
    o = _orbit(spark, base)
    sun = N.sun_position(F.col("slot") * 900_000_000)
    v = N.sun_visibility((F.col("x"), F.col("y"), F.col("z")), (F.col("ux"), F.col("uy"), F.col("uz")))
    return o.withColumns({"ux": sun[0], "uy": sun[1], "uz": sun[2]}).select("sat", "slot", F.round(v, 4).alias("visible"))


@query()
def ocean_loading(spark, base):
    """Displacement of every station at the events' full hours from made-up constituents."""
    s = table(spark, base, "station").select("site")
    waves = F.explode(F.array(*[F.struct(F.lit(w).alias("constituent"), F.lit(0.01 / (k + 1)).alias("amplitude"), F.lit(30.0 * k).alias("phase")) for k, w in enumerate(N.TIDE_SPEED)]))
    l = s.select("site", F.explode(F.array(F.lit("up"), F.lit("west"), F.lit("south"))).alias("axis")).select("site", "axis", waves.alias("w")).select("site", "axis", "w.*")
    h = table(spark, base, "events").select((F.floor(micros("ts") / 21_600e6) * 21_600_000_000).alias("us")).distinct()
    return rounded(N.tide_displacement(s.crossJoin(sized(h)), l, "site", "us"), "metres")


@query()
def seasonal_troposphere(spark, base):
    p = table(spark, base, "pos_solution")
    d, m = N.seasonal_trop(F.col("Latitude"), F.col("Elevation"), F.dayofyear("Time"), F.lit(0.5))
    return p.select("pos_id", r6(d).alias("delay"), r6(m).alias("mapping"))


@query(f"""WITH z AS (SELECT event_id, least((user_id % 95) / 5.0, 18.0) AS f FROM events), i AS (SELECT *, least(floor(f), 17) AS i FROM z)
SELECT event_id, {q6("0.001 * i * i + (0.001 * (i + 1) * (i + 1) - 0.001 * i * i) * (f - i)")} AS pcv FROM i""")
def antenna_pattern(spark, base):
    pcv = F.array(*[F.lit(0.001 * k * k) for k in range(19)])
    z = table(spark, base, "events").select("event_id", (F.col("user_id") % 95).cast("double").alias("z"))
    return z.select("event_id", r6(N.pattern_at(pcv, F.lit(0.0), F.lit(5.0), F.col("z"))).alias("pcv"))


@query("""WITH n AS (SELECT recv, count(*) AS n FROM residual GROUP BY 1), c AS (SELECT recv, floor(coalesce(sum(n) OVER (ORDER BY n DESC, recv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 8 / sum(n) OVER ()) AS c FROM n)
SELECT recv, CAST(c AS INTEGER) AS chunk FROM c""")
def filter_chunks(spark, base):
    r = table(spark, base, "residual").select("res_id", "recv", F.concat_ws("/", "recv", "sat", "sig").alias("state"))
    return N.chunks(r, "res_id", "state", "recv", 8)


@query("""SELECT user_id, event_id FROM events e JOIN (SELECT user_id, max(CAST(ts AS DATE)) AS d FROM events GROUP BY 1) m USING (user_id) WHERE CAST(e.ts AS DATE) = d""")
def newest_states(spark, base):
    e = table(spark, base, "events").withColumn("d", F.to_date("ts"))
    return N.newest_set(e, ["user_id"], "d").select("user_id", "event_id")


@query("""WITH b AS (SELECT user_id, ts AS tini, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1, 2),
p AS (SELECT l.event_id, l.user_id, l.ts, b.tini AS t0, b.v AS v0 FROM events l ASOF LEFT JOIN b ON l.user_id = b.user_id AND l.ts >= b.tini WHERE l.event_type = 'click'),
n AS (SELECT p.*, b.tini AS t1, b.v AS v1 FROM p ASOF LEFT JOIN b ON p.user_id = b.user_id AND p.ts <= b.tini)
SELECT event_id, (round(CASE WHEN t0 = ts THEN v0 WHEN t1 IS NOT NULL THEN v0 + (v1 - v0) * ((epoch_us(ts) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0))) ELSE v0 + 1e-5 * (epoch_us(ts) - epoch_us(t0)) / 1e6 END + 1e-9, 6) + 0.0) AS bias FROM n""")
def bias_interpolation(spark, base):
    e = table(spark, base, "events")
    b = e.where("event_type = 'view'").groupBy("user_id", F.col("ts").alias("tini")).agg(F.max("value").alias("bias")).withColumns({"slope": F.lit(1e-5), "var": F.lit(0.1), "slope_var": F.lit(0.0)})
    return N.bias_at(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), b, ["user_id"], "ts").select("event_id", r6("bias").alias("bias"))


@query()
def orbit_comparison(spark, base):
    """Two orbits of the same satellites, the second turned and moved; the transform between them and, per satellite, the RMS that is left."""
    a = _orbit(spark, base)
    w = 1e-7
    b = a.select("sat", "slot", (F.col("x") + 0.5 - w * F.col("y")).alias("x2"), (F.col("y") - 0.25 + w * F.col("x")).alias("y2"), (F.col("z") + 0.1).alias("z2"))
    j = a.join(b, ["sat", "slot"]).withColumn("k", F.lit("all"))
    t = E.helmert(j, ["k"]).groupBy("k").pivot("state", ["tx", "ty", "tz", "rx_urad", "ry_urad", "rz_urad", "scale_ppm"]).agg(F.first("x"))
    f = j.join(F.broadcast(t), "k")
    x, y, z = F.col("x") / 1e6, F.col("y") / 1e6, F.col("z") / 1e6
    dx = F.col("x2") - F.col("x") - F.col("tx") - F.col("ry_urad") * z + F.col("rz_urad") * y - F.col("scale_ppm") * x
    dy = F.col("y2") - F.col("y") - F.col("ty") + F.col("rx_urad") * z - F.col("rz_urad") * x - F.col("scale_ppm") * y
    dz = F.col("z2") - F.col("z") - F.col("tz") - F.col("rx_urad") * y + F.col("ry_urad") * x - F.col("scale_ppm") * z
    return f.groupBy("sat").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(dx * dx + dy * dy + dz * dz)), 4).alias("rms"))


@query("""SELECT bern_id, (round(Year + (dayofyear(datetime) - 1 + epoch_us(datetime) % 86400000000 / 864e8) / (CASE WHEN Year % 4 = 0 AND (Year % 100 <> 0 OR Year % 400 = 0) THEN 366 ELSE 365 END) + 1e-9, 6) + 0.0) AS decimal_year FROM trop_bern""")
def decimal_years(spark, base):
    return table(spark, base, "trop_bern").select("bern_id", r6(T.decimal_year(F.col("datetime"))).alias("decimal_year"))


@query()
def residual_geometry(spark, base):
    """Azimuth and elevation of the broadcast orbit each residual's satellite was on, and the share of rows above ten degrees."""
    o = _orbit(spark, base)
    s = table(spark, base, "station")
    x, y, z = G.geodetic_to_ecef(F.radians("Latitude"), F.radians("Longitude"), F.col("Elevation"))
    s = s.select(F.col("site").alias("recv"), F.radians("Latitude").alias("la"), F.radians("Longitude").alias("lo"), x.alias("rx"), y.alias("ry"), z.alias("rz"))
    r = table(spark, base, "residual").groupBy("recv", "sat", F.floor(micros("datetime") / 900e6).alias("slot")).agg(F.count("*").alias("n"))
    j = r.join(o, ["sat", "slot"]).join(s, "recv")
    e, n, u = G.to_enu(F.col("la"), F.col("lo"), F.col("x") - F.col("rx"), F.col("y") - F.col("ry"), F.col("z") - F.col("rz"))
    j = j.withColumns({"e": e, "no": n, "u": u})
    az, el = G.azimuth_elevation(F.col("e"), F.col("no"), F.col("u"))
    return j.withColumn("el", el).groupBy("recv").agg(F.round(F.sum(F.when(F.col("el") > 10 * math.pi / 180, F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("above"))


@query()
def solid_tides(spark, base):
    """Sun and Moon tides of every station at the events' quarter days, metres up."""
    s = table(spark, base, "station")
    x, y, z = G.geodetic_to_ecef(F.radians("Latitude"), F.radians("Longitude"), F.col("Elevation"))
    s = s.select("site", x.alias("x"), y.alias("y"), z.alias("z"))
    h = table(spark, base, "events").select((F.floor(micros("ts") / 21_600e6) * 21_600_000_000).alias("us")).distinct()
    sun, moon = N.sun_position(F.col("us")), M.moon_position(F.col("us"))
    h = h.select("us", *[c.alias(n) for c, n in zip((*sun, *moon), ("sx", "sy", "sz", "mx", "my", "mz"), strict=True)])
    pos = tuple(F.col(c) for c in "xyz")
    parts = [M.solid_tide(pos, tuple(F.col(f"{b}{c}") for c in "xyz"), k) for b, k in (("s", M.SUN_RATIO), ("m", M.MOON_RATIO))]
    d = tuple(a + b for a, b in zip(*parts, strict=True))
    return s.crossJoin(sized(h)).select("site", "us", F.round(G.dot(d, G.unit(pos)), 4).alias("up"))


@query()
def eclipse_filter(spark, base):
    """Orbit rows left when satellites with odd numbers are dropped in the Earth's shadow."""
    sun = N.sun_position(F.col("slot") * 900_000_000)
    o = _orbit(spark, base).withColumns({"sx": sun[0], "sy": sun[1], "sz": sun[2], "block": F.when(F.substring("sat", 3, 1).cast("int") % 2 == 1, "old").otherwise("new")})
    return M.eclipse_filter(o, "block", ["old"], ("x", "y", "z"), ("sx", "sy", "sz")).select("sat", "slot")


@query()
def harmonic_vtec(spark, base):
    c, s = np.zeros((4, 4)), np.zeros((4, 4))
    c[0, 0], c[1, 0], c[2, 1], s[2, 1] = 20.0, 3.0, 1.5, -0.5
    e = table(spark, base, "events").select("event_id", F.radians((F.col("user_id") * 13) % 1500 / 10.0 - 70).alias("lat"), F.radians((F.col("user_id") * 29) % 3400 / 10.0 - 170).alias("lon"))
    return e.select("event_id", F.round(M.harmonic_vtec(c, s)(F.col("lat"), F.col("lon")), 6).alias("vtec"))


@query("""SELECT event_id, CAST(round(mw) AS INTEGER) AS wide, abs(mw - round(mw)) < 0.25 AS fits FROM (SELECT event_id, value / 7.0 AS mw FROM events)""")
def slip_repair(spark, base):
    lam1, lam2 = G.CLIGHT / 1575.42e6, G.CLIGHT / 1227.60e6
    e = table(spark, base, "events").withColumn("mw", F.col("value") / 7.0)
    e = e.withColumn("gf", lam1 * 3 - lam2 * (3 - F.round("mw")))
    n1, n2, ok = M.repair_slips(F.col("gf"), F.col("mw"), lam1, lam2)
    return e.select("event_id", (n1 - n2).alias("wide"), ok.alias("fits"))


@query("""WITH e AS (SELECT event_id, user_id, ts, value > 50 AS rej, value > 200 AS slip, sum(CASE WHEN value > 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT event_id, slip OR (rej AND sum(CAST(rej AS INTEGER)) OVER (PARTITION BY user_id, b ORDER BY ts, event_id) % 3 = 0) AS reset FROM e""")
def ambiguity_expiry(spark, base):
    e = table(spark, base, "events").withColumns({"rej": F.col("value") > 50, "slip": F.col("value") > 200})
    return M.expire_ambiguities(e, ["user_id"], ["ts", "event_id"], "rej", "slip", 3).select("event_id", "reset")
