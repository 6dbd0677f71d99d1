"""Estimator queries and physics columns over the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from orrery.functions import geo as G
from orrery.functions import ids as I
from orrery.functions import signals as P
from orrery.operators import estimate as E
from orrery.operators import stats as A
from orrery.plans.util import RESIDUALS, q6, r6, residuals, rounded
from orrery.session import micros, table

QUERIES: dict = {}
#: Variance of a code reading less its phase reading in hatch_smooth.
_HATCH = 0.09 + 1e-4
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- estimators


def _walks(spark, base):
    r = residuals(spark, base, "postfit").where("sigma > 0 AND NOT isnan(sigma)")
    r = r.withColumn("g", F.concat_ws("/", "recv", "sat", "sig", "meas", F.to_date("datetime"))).withColumn("t", micros("datetime") / 1e6).withColumn("v", F.col("sigma") * F.col("sigma"))
    return r.withColumn("s", F.lit("offset"))


@query()
def kalman_scalar(spark, base):
    """A random-walk offset per series and day, its smoothed values beside it."""
    return rounded(E.kalman(_walks(spark, base), "g", "t", "s", "postfit", "v", kind="walk", q=1e-6, smooth=True), "x", "p", "xs", "ps")


@query()
def kalman_vector(spark, base):
    """Per station and day the three displacement states as Gauss-Markov processes, outliers over six sigma rejected."""
    p = table(spark, base, "pos_solution").where("sN > 0 AND sE > 0 AND sU > 0")
    long = p.select(F.concat_ws("/", "site", F.to_date("Time")).alias("g"), (micros("Time") / 1e6).alias("t"), F.explode(F.array(*[F.struct(F.lit(c).alias("s"), F.col(c).alias("y"), (F.col(v) * F.col(v)).alias("v")) for c, v in (("dN", "sN"), ("dE", "sE"), ("dU", "sU"))])).alias("m"))
    return rounded(E.kalman(long.select("g", "t", "m.*"), "g", "t", "s", "y", "v", kind="markov", q=1e-6, tau=7200.0, sigma_limit=6.0).drop("xs", "ps"), "x", "p")


@query()
def rts_smooth(spark, base):
    return rounded(E.kalman(table(spark, base, "events").withColumn("s", F.lit("v")).withColumn("t", micros("ts") / 86_400e6).withColumn("r", F.lit(100.0)), "user_id", "t", "s", "value", "r", kind="walk", q=10.0, smooth=True), "x", "xs")


@query(f"""WITH RECURSIVE e AS (SELECT pos_id, site, epoch_us("Time") AS t, (dU + 10) - (dN + 10) AS a, dN + 10 AS l, row_number() OVER (PARTITION BY site ORDER BY "Time", pos_id) AS k
      FROM pos_solution WHERE dU IS NOT NULL AND dN IS NOT NULL AND NOT isnan(dU) AND NOT isnan(dN)),
f AS (SELECT pos_id, site, k, t, 1 AS n, a AS m, {_HATCH}::DOUBLE AS v, l FROM e WHERE k = 1
      UNION ALL SELECT pos_id, site, k, t, n, CASE WHEN n = 1 THEN a ELSE m + (a - m) / n END, {_HATCH} / (n * n) + (1 - 1 / n::DOUBLE) * (1 - 1 / n::DOUBLE) * v, l
      FROM (SELECT e.*, f.m, f.v, CASE WHEN e.t - f.t > 3600000000 OR abs(e.a - f.m) > 4 * sqrt(f.v + {_HATCH}) THEN 1 ELSE least(f.n + 1, 100) END AS n FROM f JOIN e ON e.site = f.site AND e.k = f.k + 1))
SELECT pos_id, {q6("m + l")} AS smoothed FROM f""")
def hatch_smooth(spark, base):
    """The two-measurement recursion with a station's up component as the noisy and its north component as the smooth reading."""
    p = table(spark, base, "pos_solution").where("dU IS NOT NULL AND dN IS NOT NULL AND NOT isnan(dU) AND NOT isnan(dN)").withColumn("us", micros("Time"))
    p = p.select("pos_id", "site", "us", (F.col("dU") + 10).alias("P"), (F.col("dN") + 10).alias("L"))
    return rounded(E.hatch_smooth(p, ["site"], ["us", "pos_id"], "P", "L", "us", outage_s=3600), "smoothed").select("pos_id", "smoothed")


@query(f"""WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT event_id, user_id, k, value AS m, 25.0::DOUBLE AS p FROM e WHERE k = 1
      UNION ALL SELECT e.event_id, e.user_id, e.k, f.m + (e.value - f.m) * (f.p + 1) / (25 + f.p + 1), 1 / (1 / 25.0::DOUBLE + 1 / (f.p + 1)) FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT event_id, {q6("m")} AS filtered FROM f""")
def low_pass(spark, base):
    e = table(spark, base, "events").withColumn("r", F.lit(25.0))
    return rounded(E.low_pass(e.select("event_id", "user_id", "ts", "value", "r"), ["user_id"], ["ts", "event_id"], "value", "r", 1.0), "filtered").select("event_id", "filtered")


@query()
def lowess_smooth(spark, base):
    e = table(spark, base, "events").withColumn("t", micros("ts") / 86_400e6)
    return rounded(E.lowess_smooth(e.select("event_id", "user_id", "t", "value"), ["user_id"], "t", "value", 0.3), "smooth").select("event_id", "smooth")


@query(f"""WITH d AS (SELECT user_id, value, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 864e8 AS x FROM events), f AS (SELECT user_id, regr_intercept(value, x) AS a, regr_slope(value, x) AS b FROM d GROUP BY 1)
SELECT user_id, CAST(0 AS INTEGER) AS k, {q6("a")} AS c FROM f UNION ALL SELECT user_id, 1, {q6("b")} FROM f""")
def poly_fit(spark, base):
    e = table(spark, base, "events")
    first = e.groupBy("user_id").agg(F.min(micros("ts")).alias("t0"))
    x = e.join(first, "user_id").withColumn("x", (micros("ts") - F.col("t0")) / 864e8)
    return rounded(E.poly_fit(x, ["user_id"], "x", "value", 1), "c")


@query(f"""WITH s AS (SELECT l_returnflag, sum(1.0) AS n, sum(l_quantity) AS a, sum(l_quantity * l_quantity) AS b, sum(l_tax) AS y, sum(l_quantity * l_tax) AS z FROM lineitem GROUP BY 1)
SELECT l_returnflag, 'one' AS state, {q6("(y * b - a * z) / (n * b - a * a)")} AS x FROM s UNION ALL SELECT l_returnflag, 'l_quantity', {q6("(n * z - a * y) / (n * b - a * a)")} FROM s""")
def least_squares(spark, base):
    l = table(spark, base, "lineitem").withColumn("one", F.lit(1.0)).withColumn("var", F.lit(1.0))
    return rounded(E.least_squares(l, ["l_returnflag"], ["one", "l_quantity"], "l_tax", "var").select("l_returnflag", "state", "x"), "x")


@query()
def raim(spark, base):
    """Offset and rate of a receiver's phase residuals of one day hour, with greedy exclusion."""
    r = residuals(spark, base, "postfit").where("meas = 'PHAS_MEAS' AND sigma > 0 AND NOT isnan(sigma)")
    r = r.withColumn("hour", F.floor(micros("datetime") / 900e6)).withColumn("one", F.lit(1.0)).withColumn("x", F.pmod(micros("datetime"), F.lit(900_000_000)) / 900e6)
    out = E.raim(r, ["recv", "sat", "sig", "hour"], "res_id", ["one", "x"], "postfit", "sigma")
    return rounded(out.select("res_id", "used", "chi2", "dof", "pass"), "chi2")


@query()
def ambiguity_fix(spark, base):
    """Integer candidates of the float vector a satellite's signals have at each receiver."""
    m = residuals(spark, base, "prefit").groupBy("recv", "sat", F.concat("sig", "meas").alias("i")).agg((F.avg("prefit") * 10).alias("a"))
    q = m.join(m.select("recv", "sat", F.col("i").alias("j")), ["recv", "sat"]).withColumn("q", F.when(F.col("i") == F.col("j"), 0.04).otherwise(0.01))
    return rounded(E.fix_ambiguities(q, ["recv", "sat"], "i", "j", "a", "q"), "ratio")


@query()
def helmert_transform(spark, base):
    """Translation, rotation and scale between the station table and the same positions moved by a known amount."""
    s = table(spark, base, "station")
    x, y, z = G.geodetic_to_ecef(F.radians("Latitude"), F.radians("Longitude"), F.col("Elevation"))
    t = s.select(F.lit("all").alias("k"), x.alias("x"), y.alias("y"), z.alias("z"))
    t = t.select("k", "x", "y", "z", (F.col("x") + 1.5 + 2e-8 * F.col("x")).alias("x2"), (F.col("y") - 0.5 + 2e-8 * F.col("y")).alias("y2"), (F.col("z") + 0.25 + 2e-8 * F.col("z")).alias("z2"))
    return E.helmert(t, ["k"]).select("state", F.round("x", 5).alias("x"))


@query(f"""WITH l AS (SELECT l_orderkey, l_linenumber AS n, (l_linenumber * l_linenumber)::DOUBLE AS c, max(l_quantity) AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem GROUP BY 1, 2)
SELECT i.l_orderkey, i.n AS a, j.n AS b, {q6("sqrt((i.c * i.c + j.c * j.c) / ((i.c - j.c) * (i.c - j.c))) * (j.c * i.v - i.c * j.v)")} AS value FROM l i JOIN l j ON i.l_orderkey = j.l_orderkey AND i.k % 2 = 1 AND j.k = i.k + 1""")
def iono_free_pairs(spark, base):
    """Lines of an order as measurements that share its ionosphere, the line number's square as coefficient."""
    l = table(spark, base, "lineitem").withColumn("c", (F.col("l_linenumber") * F.col("l_linenumber")).cast("double"))
    one = l.groupBy("l_orderkey", "l_linenumber").agg(F.max("c").alias("c"), F.max("l_quantity").alias("v"))
    return rounded(E.pair_iono_free(one, ["l_orderkey"], "l_linenumber", "c", "v"), "value")


@query()
def dilution_of_precision(spark, base):
    r = table(spark, base, "residual").select("recv", "datetime", "sat").distinct().withColumn("h", F.pmod(F.xxhash64("recv", "sat", F.floor(micros("datetime") / 3600e6)), F.lit(10_000)))
    r = r.withColumn("az", F.col("h") % 360 * math.pi / 180).withColumn("el", (10 + F.floor(F.col("h") / 360) * 3) * math.pi / 180)
    return rounded(A.dilution(r, ["recv", "datetime"], "az", "el"), "gdop", "pdop", "hdop", "vdop")


@query()
def grid_loading(spark, base):
    """Loading at every station from a five-degree grid of unit loads."""
    sites = table(spark, base, "station").select("site", F.col("Latitude").alias("lat"), F.col("Longitude").alias("lon"))
    grid = spark.range(36 * 72).select((F.floor(F.col("id") / 72) * 5 - 87.5).cast("double").alias("lat"), (F.col("id") % 72 * 5 - 177.5).cast("double").alias("lon"))
    grid = grid.withColumn("re", F.cos(F.radians("lon"))).withColumn("im", F.sin(F.radians("lon"))).withColumn("area", F.cos(F.radians("lat")))
    return rounded(A.grid_convolution(sites, grid, [0.0, 500.0, 2000.0, 20_100.0], [1.0, 0.2, 0.02, 0.0]), "re", "im")


# --- physics columns

_RAD = "pi() / 180"
_V = f"(6378137.0 / sqrt(1 - 0.0066943799901413165 * sin(Latitude * {_RAD}) * sin(Latitude * {_RAD})))"


@query(f"""SELECT site, round(({_V} + Elevation) * cos(Latitude * {_RAD}) * cos(Longitude * {_RAD}) + 1e-9, 3) AS x, round(({_V} + Elevation) * cos(Latitude * {_RAD}) * sin(Longitude * {_RAD}) + 1e-9, 3) AS y,
round(({_V} * (1 - 0.0066943799901413165) + Elevation) * sin(Latitude * {_RAD}) + 1e-9, 3) AS z FROM station""")
def geodetic_to_ecef(spark, base):
    x, y, z = G.geodetic_to_ecef(F.radians("Latitude"), F.radians("Longitude"), F.col("Elevation"))
    return table(spark, base, "station").select("site", *[F.round(c + 1e-9, 3).alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"))])


@query("""SELECT pos_id, round(Latitude + 1e-12, 9) AS lat, round(Longitude + 1e-12, 9) AS lon, round(Elevation + 1e-9, 4) AS h FROM pos_solution""")
def geodetic_round_trip(spark, base):
    """To geocentric and back; the result is the input."""
    p = table(spark, base, "pos_solution")
    x, y, z = G.geodetic_to_ecef(F.radians("Latitude"), F.radians("Longitude"), F.col("Elevation"))
    q = p.select("pos_id", x.alias("x"), y.alias("y"), z.alias("z"))
    lat, lon, h = G.ecef_to_geodetic(F.col("x"), F.col("y"), F.col("z"))
    return q.select("pos_id", F.round(F.degrees(lat) + 1e-12, 9).alias("lat"), F.round(F.degrees(lon) + 1e-12, 9).alias("lon"), F.round(h + 1e-9, 4).alias("h"))


_H = f"sin((b.Latitude - a.Latitude) * {_RAD} / 2) ** 2 + cos(a.Latitude * {_RAD}) * cos(b.Latitude * {_RAD}) * sin((b.Longitude - a.Longitude) * {_RAD} / 2) ** 2"


@query(f"""SELECT a.site AS a, b.site AS b, round(2 * 6371000.0 * asin(sqrt(least({_H}, 1.0))) + 1e-9, 2) AS metres FROM station a JOIN station b ON a.receiver_type = b.receiver_type AND a.site < b.site""")
def baseline_distance(spark, base):
    s = table(spark, base, "station")
    a = s.select("receiver_type", F.col("site").alias("a"), F.col("Latitude").alias("la"), F.col("Longitude").alias("oa"))
    b = s.select("receiver_type", F.col("site").alias("b"), F.col("Latitude").alias("lb"), F.col("Longitude").alias("ob"))
    return a.join(b, "receiver_type").where("a < b").select("a", "b", F.round(G.haversine_m(F.col("la"), F.col("oa"), F.col("lb"), F.col("ob")) + 1e-9, 2).alias("metres"))


@query(f"""WITH p AS (SELECT event_id, (user_id % 90) * {_RAD} AS el, (user_id * 7 % 360) * {_RAD} AS az, 0.6 AS lat FROM events)
SELECT event_id, {q6("1 / sqrt(1 - (6371.0 / 6821.0 * sin(pi() / 2 - el)) ** 2)")} AS slm, {q6("cos(az) / (sin(el) * tan(el) + 0.0031)")} AS grad_n, {q6("(3 / sin(CASE WHEN el = 0 THEN pi() / 8 ELSE el END)) ** 2 + (2 / sin(CASE WHEN el = 0 THEN pi() / 8 ELSE el END)) ** 2")} AS var FROM p""")
def mapping_functions(spark, base):
    e = table(spark, base, "events").select("event_id", (F.col("user_id") % 90 * math.pi / 180).alias("el"), (F.col("user_id") * 7 % 360 * math.pi / 180).alias("az"))
    el, az = F.col("el"), F.col("az")
    return e.select("event_id", r6(P.iono_mapping(el)).alias("slm"), r6(P.gradient_mapping(az, el)[0]).alias("grad_n"), r6(P.observation_variance(F.lit(3.0), F.lit(2.0), el)).alias("var"))


@query()
def atmosphere_delays(spark, base):
    """Broadcast ionosphere and standard troposphere delays of made-up directions."""
    e = table(spark, base, "events").select("event_id", (F.col("user_id") % 80 * math.pi / 180 + 0.1).alias("el"), (F.col("user_id") * 7 % 360 * math.pi / 180).alias("az"), (micros("ts") / 1e6 % 604_800).alias("tow"))
    el, az = F.col("el"), F.col("az")
    lat, lon = P.pierce_point(F.lit(0.6), F.lit(2.0), az, el)
    return e.select("event_id", r6(P.klobuchar(F.col("tow"), F.lit(0.6), F.lit(2.0), az, el)).alias("iono"), r6(P.saastamoinen(F.lit(0.6), F.lit(120.0), el)).alias("trop"), r6(lat).alias("lat"), r6(lon).alias("lon"))


_L1, _L2 = 299792458.0 / 1575.42e6, 299792458.0 / 1227.60e6
_PAIR = "(SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS la, max(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS lb, max(CASE WHEN l_linenumber = 1 THEN l_discount END) AS pa, max(CASE WHEN l_linenumber = 2 THEN l_discount END) AS pb FROM lineitem GROUP BY 1)"


@query(f"""WITH p AS (SELECT l_orderkey, nullif(la, 0) AS la, nullif(lb, 0) AS lb, nullif(pa, 0) AS pa, nullif(pb, 0) AS pb FROM {_PAIR})
SELECT l_orderkey, {q6("la - lb")} AS gf, {q6(f"({_L2} * {_L2} * la - {_L1} * {_L1} * lb) / ({_L2} * {_L2} - {_L1} * {_L1})")} AS iflc, {q6(f"(la - lb) - (pa / {_L1} + pb / {_L2}) * ({_L1} * {_L2} / ({_L1} + {_L2})) / ({_L1} * {_L2} / ({_L2} - {_L1}))")} AS mw FROM p""")
def linear_combinations(spark, base):
    l = table(spark, base, "lineitem")
    p = l.groupBy("l_orderkey").agg(*[F.max(F.when(F.col("l_linenumber") == n, F.col(c))).alias(a) for n, c, a in ((1, "l_quantity", "la"), (2, "l_quantity", "lb"), (1, "l_discount", "pa"), (2, "l_discount", "pb"))])
    a, b = F.lit(_L1), F.lit(_L2)
    la, lb, pa, pb = (F.col(c) for c in ("la", "lb", "pa", "pb"))
    return p.select("l_orderkey", r6(P.geometry_free(la, lb)).alias("gf"), r6(P.ionosphere_free(la, lb, a, b)).alias("iflc"), r6(P.melbourne_wuebbena(la, lb, pa, pb, a, b)).alias("mw"))


@query(f"""SELECT pos_id, {q6("6.0 * sqrt((sE * sE + sN * sN) / 2 + sqrt(((sE * sE - sN * sN) / 2) ** 2 + (Rne * sN * sE) ** 2))")} AS hpl, {q6("5.33 * sU")} AS vpl FROM pos_solution""")
def protection_levels(spark, base):
    h, v = P.protection_levels(F.col("sE") * F.col("sE"), F.col("sN") * F.col("sN"), F.col("Rne") * F.col("sN") * F.col("sE"), F.col("sU") * F.col("sU"))
    return table(spark, base, "pos_solution").select("pos_id", r6(h).alias("hpl"), r6(v).alias("vpl"))


@query("""SELECT DISTINCT sat, substr(sat, 1, 1) AS system, CAST(substr(sat, 2) AS INTEGER) AS prn, substr(sat, 1, 1) || lpad(CAST(CAST(substr(sat, 2) AS INTEGER) AS VARCHAR), 2, '0') AS again FROM residual""")
def sat_ids(spark, base):
    s = F.col("sat")
    return table(spark, base, "residual").select("sat").distinct().select("sat", I.sat_system(s).alias("system"), I.sat_prn(s).alias("prn"), I.sat_id(I.sat_system(s), I.sat_prn(s)).alias("again"))


@query("""SELECT event_id, (event_id >> 4) & 63 AS u, CASE WHEN (event_id >> 4) & 63 >= 32 THEN ((event_id >> 4) & 63) - 64 ELSE (event_id >> 4) & 63 END AS s, trim(regexp_replace(lower(event_type || ' / x'), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM events""")
def bit_slices(spark, base):
    w = F.col("event_id")
    return table(spark, base, "events").select("event_id", I.bits_unsigned(w, 54, 6).alias("u"), I.bits_signed(w, 54, 6).alias("s"), I.slug(F.concat("event_type", F.lit(" / x"))).alias("slug"))


@query("""WITH RECURSIVE s AS (SELECT b, CAST(b AS BIGINT) << 16 AS x, 0 AS i FROM range(256) r(b) UNION ALL SELECT b, xor(x << 1, CASE WHEN x & 8388608 <> 0 THEN 25578747 ELSE 0 END), i + 1 FROM s WHERE i < 8),
t AS (SELECT list(x & 16777215 ORDER BY b) AS t FROM s WHERE i = 8), e AS (SELECT event_id, list_prepend(0::BIGINT, list_transform(string_split(props, ''), lambda c: ascii(c)::BIGINT)) AS b FROM events)
SELECT event_id, CAST(list_reduce(b, lambda c, x: xor((c << 8) & 16777215, t[xor(c >> 16, x) + 1])) AS INTEGER) AS crc FROM e, t""")
def crc24q(spark, base):
    return table(spark, base, "events").select("event_id", I.crc24q(F.encode("props", "UTF-8")).alias("crc"))


@query(f"""SELECT sat, m, {q6("ecc")} AS ecc FROM (SELECT sat, count(*) % 628 / 100.0 AS m, 0.0 AS ecc FROM {RESIDUALS} GROUP BY sat)""")
def kepler(spark, base):
    """Mean anomaly to eccentric and back: the equation's residual, zero."""
    r = residuals(spark, base).groupBy("sat").agg((F.count("*") % 628 / 100.0).alias("m"))
    x = P.kepler_anomaly(F.col("m"), F.lit(0.3))
    return r.withColumn("e", x).select("sat", "m", r6(F.col("e") - 0.3 * F.sin("e") - F.col("m")).alias("ecc"))


@query(f"""SELECT name, filled FROM (SELECT 'trace' AS name, 'out/' || site || '/' || strftime("Time", '%Y') || strftime("Time", '%j') || strftime("Time", '%H') || '.txt' AS filled FROM pos_solution) GROUP BY ALL""")
def file_names(spark, base):
    t = F.concat(F.lit("out/"), "site", F.lit("/<YYYY><DDD><HH>.txt"))
    return table(spark, base, "pos_solution").select(F.lit("trace").alias("name"), I.replace_times(t, F.col("Time")).alias("filled")).distinct()
