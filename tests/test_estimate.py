import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import geo as G
from orrery.operators import estimate as E
from orrery.operators import gnss as N


def test_kalman_constant_state_is_the_weighted_mean(spark):
    rnd = np.random.default_rng(1)
    rows = [("a", float(i), "x", float(5 + rnd.normal()), float(0.5 + i % 3)) for i in range(30)] + [("b", 0.0, "x", 1.0, 1.0), ("b", 1.0, "x", None, 1.0), ("b", 2.0, "x", math.nan, 1.0), ("b", 3.0, "x", 1.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, t double, s string, y double, r double")
    got = E.kalman(df, "g", "t", "s", "y", "r", kind="const", init_var=1e8, smooth=True).collect()
    y, w = np.array([r[3] for r in rows[:30]]), 1 / np.array([r[4] for r in rows[:30]])
    last = max((r for r in got if r.g == "a"), key=lambda r: r.t)
    assert last.x == pytest.approx((w * y).sum() / w.sum(), abs=1e-6) and last.p == pytest.approx(1 / w.sum(), rel=1e-5)
    assert all(r.xs == pytest.approx(last.x, abs=1e-5) for r in got if r.g == "a")
    assert len([r for r in got if r.g == "b"]) == 1


def test_smoother_against_batch_least_squares(spark):
    y = [1.0, 2.5, 2.0, 4.0, 3.5]
    q, r, n = 0.3, 0.5, 5
    h = np.zeros((2 * n - 1, n))
    h[:n] = np.eye(n)
    for k in range(n - 1):
        h[n + k, k], h[n + k, k + 1] = -1, 1
    x, p = E.wls(h, np.array([*y, *[0.0] * (n - 1)]), np.array([*[1 / r] * n, *[1 / q] * (n - 1)]))
    df = spark.createDataFrame([("a", float(i), "x", v, r) for i, v in enumerate(y)], "g string, t double, s string, y double, r double")
    got = sorted(E.kalman(df, "g", "t", "s", "y", "r", q=q, init_var=1e9, smooth=True).collect(), key=lambda v: v.t)
    assert [v.xs for v in got] == pytest.approx(x.tolist(), abs=1e-6) and [v.ps for v in got] == pytest.approx(np.diag(p).tolist(), abs=1e-6)


def test_outliers_are_rejected(spark):
    df = spark.createDataFrame([("a", float(i), "x", 100.0 if i == 7 else 1.0, 0.01) for i in range(12)], "g string, t double, s string, y double, r double")
    got = E.kalman(df, "g", "t", "s", "y", "r", q=1e-4, init_var=10.0, sigma_limit=4.0).collect()
    assert max(abs(r.x - 1) for r in got) < 0.05


def test_one_state_alone_is_the_state_beside_another(spark):
    rnd = random.Random(5)
    one = [("a", float(i // 2), "x", rnd.gauss(0, 1) + (40 if i == 9 else 0), 0.5 + i % 3) for i in range(40)]
    other = [("a", float(i), "y", 1.0, 1.0) for i in range(20)]
    schema = "g string, t double, s string, y double, r double"
    for kind in ("walk", "markov", "const"):
        a, b = (
            {r.t: (r.x, r.p, r.xs, r.ps) for r in E.kalman(spark.createDataFrame(rows, schema), "g", "t", "s", "y", "r", kind=kind, q=0.3, tau=7.0, mu=0.5, init_var=100.0, sigma_limit=5.0, smooth=True).collect() if r.s == "x"}
            for rows in (one, one + other)
        )
        assert a.keys() == b.keys() and all(a[t] == pytest.approx(b[t], rel=1e-6, abs=1e-9) for t in a)


def test_transitions():
    assert E.transition("walk", 2.0, 0, 0, -3) == (1.0, 6.0, 0.0)
    f, q, o = E.transition("markov", 2.0, 10.0, 5.0, 10.0)
    assert f == pytest.approx(math.exp(-1)) and q == pytest.approx(10 * (1 - math.exp(-2))) and o == pytest.approx(5 * (1 - math.exp(-1)))


def test_integer_search_against_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(20):
        b = rng.normal(size=(3, 3))
        q = b @ b.T + 0.05 * np.eye(3)
        a = rng.normal(0, 3, 3)
        best, cost = E.integer_least_squares(a, q)
        qi = np.linalg.inv(q)
        grid = sorted((float((a - z) @ qi @ (a - z)), tuple(z)) for z in itertools.product(*[range(int(np.floor(v)) - 6, int(np.ceil(v)) + 7) for v in a]))
        assert cost == pytest.approx([grid[0][0], grid[1][0]], rel=1e-6) and tuple(best[0]) == grid[0][1]


def test_raim_leaves_the_planted_outlier_out(spark):
    rnd = random.Random(2)
    rows = [("g", k, 1.0, float(k), 2 + 0.5 * k + rnd.gauss(0, 0.01) + (5.0 if k == 4 else 0), 0.01) for k in range(9)] + [("few", k, 1.0, float(k), 9.0 * k * k, 0.01) for k in range(3)]
    df = spark.createDataFrame(rows, "g string, m int, one double, x double, y double, s double")
    got = E.raim(df, ["g"], "m", ["one", "x"], "y", "s").collect()
    assert [r.m for r in got if r.g == "g" and not r.used] == [4] and all(r["pass"] for r in got if r.g == "g")
    assert all(r.used and not r["pass"] for r in got if r.g == "few")


def test_hatch_resets(spark):
    rows = [("s", i, 20.0 + (1 if i % 2 else -1), 10.0, i * 1_000_000, 0) for i in range(10)] + [("s", 10, 50.0, 10.0, 10_000_000, 1), ("s", 11, 50.0, 10.0, 200_000_000, 0), ("s", 12, 0.0, 10.0, 201_000_000, 0)]
    df = spark.createDataFrame(rows, "k string, i int, p double, l double, t long, lli int")
    got = {r.i: r.smoothed for r in E.hatch_smooth(df, ["k"], ["i"], "p", "l", "t", "lli", var_p=1.0).collect()}
    assert got[9] == pytest.approx(20.0) and got[10] == 50.0 and got[11] == 50.0 and (got[12] is None or math.isnan(got[12]))


def test_polynomials_and_lowess(spark):
    df = spark.createDataFrame([("a", float(x), 1 + 2 * x - 0.5 * x * x) for x in range(10)] + [("a", 3.0, math.nan)], "k string, x double, y double")
    x = np.arange(30.0)
    y = 0.3 * x
    y[10] = 50
    assert np.abs(E.lowess(x, y, 0.4) - 0.3 * x).max() < 0.2


def test_helmert(spark):
    rnd = random.Random(3)
    rows = []
    for _ in range(12):
        p = [rnd.uniform(-6e6, 6e6) for _ in range(3)]
        rows.append(("k", *p, p[0] + 1 + 1e-8 * p[0], p[1] - 2 + 1e-8 * p[1], p[2] + 3 + 1e-8 * p[2]))
    got = {r.state: r.x for r in E.helmert(spark.createDataFrame(rows, "k string, x double, y double, z double, x2 double, y2 double, z2 double"), ["k"]).collect()}
    assert got["tx"] == pytest.approx(1, abs=1e-4) and got["tz"] == pytest.approx(3, abs=1e-4) and got["scale_ppm"] == pytest.approx(0.01, abs=1e-5) and abs(got["rx_urad"]) < 1e-5


def test_iono_free_pairs_use_each_once(spark):
    df = spark.createDataFrame([("e", "a", 1.0, 10.0), ("e", "b", 1.0, 11.0), ("e", "c", 2.0, 12.0), ("e", "d", 3.0, 13.0)], "g string, m string, c double, v double")
    got = {(r.a, r.b) for r in E.pair_iono_free(df, ["g"], "m", "c", "v").collect()}
    assert got == {("a", "c"), ("b", "d")}


def test_single_point_and_visibility(spark):
    from orrery.plans.satellites import QUERIES

    got = QUERIES["single_point_positions"](spark, "/root/testdata/sf0.001").collect()
    assert got and max(r.off for r in got) < 0.05 and all(abs(r.clk - 30) < 0.05 for r in got)
    v = spark.range(1).select(
        N.sun_visibility((F.lit(2.6e7), F.lit(0.0), F.lit(0.0)), (F.lit(1.5e11), F.lit(0.0), F.lit(0.0))).alias("lit"), N.sun_visibility((F.lit(-2.6e7), F.lit(0.0), F.lit(0.0)), (F.lit(1.5e11), F.lit(0.0), F.lit(0.0))).alias("dark")
    ).first()
    assert v.lit == 1.0 and v.dark == 0.0


def test_propagation_returns_and_orbits_are_close(spark):
    from orrery.plans.satellites import QUERIES

    base = "/root/testdata/sf0.001"
    assert max(r.left for r in QUERIES["orbit_propagation"](spark, base).collect()) < 0.01
    assert all(2.6e7 < r.radius < 2.7e7 + 3e5 for r in QUERIES["broadcast_orbits"](spark, base).collect())
    assert max(r.rms for r in QUERIES["orbit_comparison"](spark, base).collect()) < 0.01


def test_geometry(spark):
    lat, lon = math.radians(-35.3), math.radians(149.1)
    x, y, z = G.geodetic_to_ecef(F.lit(lat), F.lit(lon), F.lit(575.0))
    df = spark.range(1).select(x.alias("x"), y.alias("y"), z.alias("z"))
    a, b, h = G.ecef_to_geodetic(F.col("x"), F.col("y"), F.col("z"))
    r = df.select(a.alias("a"), b.alias("b"), h.alias("h")).first()
    assert r.a == pytest.approx(lat, abs=1e-11) and r.b == pytest.approx(lon, abs=1e-12) and r.h == pytest.approx(575, abs=1e-4)
    az, el = G.azimuth_elevation(F.lit(-1.0), F.lit(0.0), F.lit(1.0))
    q = spark.range(1).select(az.alias("az"), el.alias("el"), G.wrap_pi(F.lit(4.0)).alias("w"), G.bearing_deg(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(10.0)).alias("b")).first()
    assert q.az == pytest.approx(1.5 * math.pi) and q.el == pytest.approx(math.pi / 4) and q.w == pytest.approx(4 - 2 * math.pi) and q.b == pytest.approx(90)
    rac = spark.range(1).select(*G.to_rac((F.lit(7e6), F.lit(0.0), F.lit(0.0)), (F.lit(0.0), F.lit(7e3), F.lit(0.0)), (F.lit(1.0), F.lit(2.0), F.lit(3.0)))).first()
    assert tuple(rac) == pytest.approx((1, 2, 3))
