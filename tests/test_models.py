import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import gnss as N
from orrery.operators import models as M
from orrery.sources import files as X
from orrery.sources import text as T
from orrery.sources import writers as W

US = int((datetime(2019, 7, 18) - datetime(1970, 1, 1)).total_seconds() * 1e6)


def lines(spark, *text):
    return spark.createDataFrame([(t,) for t in text], "value string")


def test_sun_moon_and_tides(spark):
    sun, moon = N.sun_position(F.lit(US)), M.moon_position(F.lit(US))
    site = (F.lit(-4052052.0), F.lit(4212836.0), F.lit(-2545105.0))
    tide = [a + b for a, b in zip(M.solid_tide(site, moon, M.MOON_RATIO), M.solid_tide(site, sun, M.SUN_RATIO), strict=True)]
    r = spark.range(1).select(*sun, *moon, *tide).first()
    assert 1.49e11 < np.linalg.norm(r[:3]) < 1.53e11 and 3.5e8 < np.linalg.norm(r[3:6]) < 4.1e8 and 0.001 < np.linalg.norm(r[6:]) < 0.6
    # on that day the Sun stands about 21 degrees north and the Moon opposite, two days past full
    assert math.degrees(math.asin(r[2] / np.linalg.norm(r[:3]))) == pytest.approx(21.0, abs=0.5)
    assert np.dot(r[:3], r[3:6]) / np.linalg.norm(r[:3]) / np.linalg.norm(r[3:6]) < -0.8


def test_shadow_and_yaw(spark):
    sun = (F.lit(1.5e11), F.lit(0.0), F.lit(0.0))
    df = spark.createDataFrame([(1, "IIA", -2.6e7, 1e6), (2, "IIA", 2.6e7, 1e6), (3, "IIR", -2.6e7, 1e6), (4, "IIA", -2.6e7, 7e6), (5, None, -2.6e7, 0.0)], "i int, b string, x double, y double").withColumns({"z": F.lit(0.0), "sx": sun[0], "sy": sun[1], "sz": sun[2]})
    assert sorted(r.i for r in M.eclipse_filter(df, "b", ["IIA"], ("x", "y", "z"), ("sx", "sy", "sz")).collect()) == [2, 3, 4, 5]
    pos, vel = (F.lit(-2.6e7), F.lit(0.0), F.lit(0.0)), (F.lit(0.0), F.lit(-3e3), F.lit(0.0))
    r = spark.range(1).select(M.sun_elevation_over_orbit(pos, vel, sun).alias("b"), M.orbit_angle(pos, vel, sun).alias("m"), M.nominal_yaw(F.lit(0.1), F.lit(math.pi / 2)).alias("y")).first()
    assert r.b == pytest.approx(0) and r.m == pytest.approx(0) and r.y == pytest.approx(math.atan2(-math.tan(0.1), 1))


def test_harmonics(spark):
    p = M.legendre(3, np.array([0.3]))
    assert p[1, 0, 0] == pytest.approx(math.sqrt(3) * 0.3) and p[2, 0, 0] == pytest.approx(math.sqrt(5) * (1.5 * 0.09 - 0.5)) and p[2, 2, 0] == pytest.approx(math.sqrt(15) / 2 * (1 - 0.09))
    c, s = np.zeros((2, 2)), np.zeros((2, 2))
    c[0, 0], c[1, 0] = 20.0, 1.0
    g = np.zeros((2, 2))
    g[1, 0] = -30_000.0
    r = spark.range(1).select(M.harmonic_vtec(c, s)(F.lit(math.pi / 6), F.lit(1.0)).alias("v"), M.geomagnetic_field(g, np.zeros((2, 2)))(F.lit(0.0), F.lit(0.5), F.lit(6371.2)).alias("eq"), M.geomagnetic_field(g, np.zeros((2, 2)))(F.lit(1.5), F.lit(0.5), F.lit(6371.2)).alias("pole")).first()
    assert r.v == pytest.approx(20 + math.sqrt(3) * 0.5) and r.eq == pytest.approx([30_000, 0, 0], abs=1) and r.pole[2] > 59_000


def test_mapping_and_repair(spark):
    r = spark.range(1).select(M.continued_fraction(F.lit(math.pi / 2), F.lit(1e-3), F.lit(3e-3), F.lit(6e-2)).alias("z"), M.continued_fraction(F.lit(math.radians(5)), F.lit(1.2e-3), F.lit(2.9e-3), F.lit(6.2e-2)).alias("low"), *[c.alias(n) for c, n in zip(M.repair_slips(F.lit(0.19029367 * 3 - 0.24421021 * -2), F.lit(5.1), 0.19029367, 0.24421021), ("n1", "n2", "ok"), strict=True)]).first()
    assert r.z == pytest.approx(1) and 10 < r.low < 10.4 and (r.n1, r.n2, r.ok) == (3, -2, True)


def test_state_upkeep(spark):
    c = spark.createDataFrame([("a", "a", 4.0), ("a", "b", 1.0), ("b", "b", 9.0)], "i string, j string, p double")
    assert {(r.i, r.j): r.p for r in M.relax(c, "i", "j", "p", "a", 0.5).collect()} == {("a", "a"): 5.0, ("a", "b"): 1.0, ("b", "b"): 9.0}
    df = spark.createDataFrame([("k", i, r, s) for i, (r, s) in enumerate([(True, False), (True, False), (False, False), (True, False), (True, False), (True, False), (False, True)])], "k string, i int, rej boolean, slip boolean")
    assert [r.reset for r in M.expire_ambiguities(df, ["k"], ["i"], "rej", "slip", 2).orderBy("i").collect()] == [False, True, False, False, True, False, True]
    rows = M.constraint_rows("pivot", spark.createDataFrame([("b",), ("a",)], "s string"), "s", 0.1).collect()
    assert [(r.key, r.coeff, r.var) for r in rows] == [("a", 1.0, pytest.approx(0.01))]


def test_more_formats_both_ways(spark):
    o = spark.createDataFrame([(datetime(2019, 7, 18, 0, 0, 30), "G05", "C1C", 2.2e7, 0), (datetime(2019, 7, 18, 0, 0, 30), "G05", "L1C", 1.1e8, 1), (datetime(2019, 7, 18, 0, 1), "R07", "C1C", 1.9e7, None)], "epoch timestamp, sat string, code string, value double, lli int")
    text = [r.value for r in W.rinex_obs_lines(o, F.lit("f"), {"G": ["C1C", "L1C"], "R": ["C1C"]}).orderBy("seq").collect()]
    assert {(r[3], r[4]): (r[5], r[6]) for r in X.rinex_obs(iter(text), "f")} == {("G05", "C1C"): (2.2e7, 0), ("G05", "L1C"): (1.1e8, 1), ("R07", "C1C"): (1.9e7, 0)}
    q = spark.createDataFrame([("G01", datetime(2019, 7, 18), 0.5, 0.5, -0.5, 0.5)], "sat string, epoch timestamp, q0 double, q1 double, q2 double, q3 double")
    assert [r[1:] for r in X.orbex(iter([r.value for r in W.orbex_lines(q, F.lit("f")).orderBy("seq").collect()]), "f")] == [("G01", datetime(2019, 7, 18), 0.5, 0.5, -0.5, 0.5)]
    e = spark.createDataFrame([("STAX", "ALIC", "1", datetime(2019, 7, 18, 12), "m", -4052052.16852, 0.001)], "param string, site string, soln string, epoch timestamp, unit string, estimate double, std double")
    rows = W.sinex_lines(e, F.lit("f")).orderBy("seq").withColumn("n", F.monotonically_increasing_id())
    got = T.sinex_estimates(T.sinex_block(rows, "file", "n", "SOLUTION/ESTIMATE")).first()
    assert got.estimate == pytest.approx(-4052052.16852) and got.std == pytest.approx(0.001) and got.site == "ALIC" and got.epoch == datetime(2019, 7, 18, 12)
    z = spark.createDataFrame([("ALIC", datetime(2019, 7, 18, 1), 2.4012, 0.0021, None, 0.0005)], "site string, epoch timestamp, total double, std double, grad_n double, grad_e double")
    t = T.trop_sinex(W.trop_sinex_lines(z, F.lit("f"))).first()
    assert t.total == pytest.approx(2.4012) and t.grad_e == pytest.approx(0.0005) and t.epoch == datetime(2019, 7, 18, 1)
    p = spark.createDataFrame([(datetime(2019, 7, 18), 1.0, 2.0, 3.0)], "Time timestamp, Latitude double, Longitude double, Elevation double")
    line = W.nmea_lines(p, F.lit("f")).first().value
    x = 0
    for ch in line[1:-3]:
        x ^= ord(ch)
    assert line.startswith("$POS,20190718") and line.endswith(f"*{x:02X}")


def test_small_tables(spark):
    b = T.ionex_biases(lines(spark, f"{'   G01    -7.123     0.010':60}PRN / BIAS / RMS", f"{'   G  ALIC 50137M001':26}{12.5:10.3f}{0.5:10.3f}".ljust(60) + "STATION / BIAS / RMS", "x")).collect()
    assert [(r.kind, r.id, r.bias_ns) for r in b] == [("satellite", "G01", -7.123), ("station", "ALIC 50137M001", 12.5)]
    m = T.ems_messages(lines(spark, "120 19 07 18 00 00 01 2 5308DFFC", "bad")).collect()
    assert [(r.prn, r.type, bytes(r.data)) for r in m] == [(120, 2, b"\x53\x08\xdf\xfc")] and m[0].time == datetime(2019, 7, 18, 0, 0, 1)
    s = T.satellite_ids(lines(spark, "# c", "lageos1 7603901 1155 8820")).first()
    assert (s.name, s.ilrs, s.sic, s.norad) == ("lageos1", "7603901", 1155, 8820)
    w = T.tide_coefficients(lines(spark, "255.555 M2 2 0 0.1 -0.2 0.3 0.4", "head")).first()
    assert (w.wave, w.n, w.s_pro, w.c_retro) == ("M2", 2, -0.2, 0.3)
