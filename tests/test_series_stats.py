import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import select as S
from orrery.operators import series as W
from orrery.operators import stats as A
from orrery.operators import store as D

T0 = datetime(2019, 1, 6)


def series(spark, values, step=60):
    return spark.createDataFrame([("a", i, T0 + timedelta(seconds=step * i), None if v is None else float(v)) for i, v in enumerate(values)], "k string, i int, t timestamp_ntz, v double")


def test_jump_skips_missing_values(spark):
    d = W.jump(series(spark, [1.0, None, 0.0, math.nan, 5.0, 5.5]), ["k"], ["i"], "v", 3.0)
    got = {r.i: (r.previous, r.slip) for r in d.collect()}
    assert got[0] == (None, False) and got[4] == (1.0, True) and got[5] == (5.0, False) and not got[2][1]


def test_arcs_breaks_and_singletons(spark):
    rows = [("a", T0 + timedelta(seconds=s), float(i)) for i, s in enumerate((0, 60, 4000, 7000, 7060, 20_000))]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, v double")
    assert [r.arc for r in W.arcs(df, ["k"], "t", ["t"], 600).orderBy("t").collect()] == [0, 0, 1, 2, 2, 3]
    assert [r.arc for r in W.join_singletons(df, ["k"], "t", ["t"], 600).orderBy("t").collect()] == [0, 0, 1, 1, 1, 2]
    b = W.break_rows(df, ["k"], "t", ["v"], 600).orderBy("t").collect()
    assert [r.is_break for r in b] == [False, False, True, False, True, False, False, True, False] and b[2].v is None


def test_last_iteration_and_runs(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 3, 3.0), ("a", 2, 2.0), (None, -1, 9.0)], "k string, iter int, v double")
    assert {r.k: r.v for r in W.last_iteration(df, ["k"], "iter").collect()} == {"a": 3.0, None: 9.0}
    f = series(spark, [1, 1, 0, 1, 1, 1]).withColumn("f", F.col("v") > 0)
    assert [r.run for r in W.run_lengths(f, ["k"], ["i"], "f").orderBy("i").collect()] == [1, 2, 0, 1, 2, 3]


def test_detrend_and_weighted_mean(spark):
    d = W.detrend(series(spark, [1.0 + 0.5 * i for i in range(20)]), ["k"], "t", "v").collect()
    assert max(abs(r.detrended) for r in d) < 1e-9 and d[0].slope == pytest.approx(0.5 / 60)
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 4.0, 2.0), ("a", math.nan, 1.0), ("a", 7.0, math.nan)], "k string, v double, s double")
    got = [r.reduced for r in W.remove_weighted_mean(df, ["k"], "v", "s").collect()]
    m = (1 * 1 + 4 * 0.25 + 7 * 1) / 2.25
    assert got[0] == pytest.approx(1 - m) and got[3] == pytest.approx(7 - m)


def test_chi2_quantiles():
    assert A.chi2_quantile(0.95, 1) == pytest.approx(3.841459, abs=1e-5)
    assert A.chi2_quantile(0.95, 10) == pytest.approx(18.307038, abs=1e-5)
    assert A.chi2_quantile(0.99, 100) == pytest.approx(135.806723, abs=1e-4)


def test_chi2_degrees(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0)] * 3 + [("b", 0.1, 1.0)] * 6, "k string, v double, r double")
    got = {r.k: (r.dof, r["pass"]) for r in A.chi2_test(df, ["k"], "v", "r", 4).collect()}
    assert got == {"a": (0, False), "b": (3, True)}


def test_dilution_against_numpy(spark):
    rnd = random.Random(3)
    rows = [("a", rnd.uniform(0, 6.28), rnd.uniform(0.2, 1.5)) for _ in range(8)] + [("few", 1.0, 1.0)] * 3
    got = {r.k: r for r in A.dilution(spark.createDataFrame(rows, "k string, az double, el double"), ["k"], "az", "el").collect()}
    h = np.array([[math.cos(e) * math.sin(a), math.cos(e) * math.cos(a), math.sin(e), 1] for k, a, e in rows if k == "a"])
    q = np.linalg.inv(h.T @ h)
    assert got["a"].gdop == pytest.approx(math.sqrt(np.trace(q))) and got["a"].vdop == pytest.approx(math.sqrt(q[2, 2]))
    assert got["few"].gdop == 0.0


def test_qq_and_single_values(spark):
    q = A.qq_quantiles(series(spark, [float(i) for i in range(100)]), ["k"], "v").collect()
    assert len(q) == 100 and min(r.normal for r in q) == -math.inf and max(r.normal for r in q) == math.inf
    one = A.label_statistics(spark.createDataFrame([("a", 1.0, 1.0)], "k string, v double, s double"), ["k"], "v", "s").first()
    assert one.std is None and one.wstd == 0.0


def test_grid_convolution(spark):
    sites = spark.createDataFrame([("p", 0.0, 0.0), ("q", 0.0, 90.0)], "site string, lat double, lon double")
    grid = spark.createDataFrame([(0.0, 0.0, 1.0, 2.0, 1.0)], "lat double, lon double, re double, im double, area double")
    got = {r.site: (r.re, r.im) for r in A.grid_convolution(sites, grid, [0.0, 1000.0, 20_100.0], [1.0, 0.5, 0.0]).collect()}
    assert got["p"] == (1.0, 2.0) and 0 < got["q"][0] < 0.5


def test_selection(spark):
    df = spark.createDataFrame([("e", "L1C", 1.0, None), ("e", "L1W", 2.0, 5.0), ("e", "L1X", 3.0, 4.0)], "k string, code string, p double, l double")
    assert S.by_priority(df, ["k"], "code", ["L1C", "L1W"], [F.col("l").isNotNull()]).first().code == "L1W"
    names = spark.createDataFrame([("ALIC",), ("AL%C",), ("ALI",), (None,)], "n string")
    assert sorted(r.n for r in names.where(S.wildcard("n", "AL?C")).collect()) == ["AL%C", "ALIC"] and names.where(S.wildcard("n", "AL%*")).count() == 1
    with pytest.raises(ValueError):
        S.wildcard("n", "a*b*")
    flags = spark.createDataFrame([(True, None), (None, False)], "a boolean, b boolean")
    assert sorted(r[0] for r in flags.select(S.exclusion_word(["a", "b"])).collect()) == [0, 1]


def test_expected_classes(spark):
    e = spark.createDataFrame([("r", c) for c in ("L1C", "L2W", "L5Q", "L7I")], "r string, code string")
    o = spark.createDataFrame([("r", "L1C", 1.0, 2.0), ("r", "L2W", 1.0, 0.0), ("r", "L5Q", None, 3.0)], "r string, code string, p double, l double")
    assert {x.code: x["class"] for x in S.classify_expected(e, o, ["r"], "code", "p", "l").collect()} == {"L1C": "OBSERVED", "L2W": "CODE_ONLY", "L5Q": "PHASE_ONLY", "L7I": "MISSING"}


def test_store(spark):
    s = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 2, 3.0), ("b", 1, 4.0)], "k string, n int, x double")
    got = {r.k: (r.x_1, r.x_2) for r in D.reshape_states(D.states_documents(s, ["k"], "n", ["x"]), ["k"], "n", ["x"], [1, 2]).collect()}
    assert got == {"a": (1.0, None), "b": (4.0, None)}
    old, new = spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string"), spark.createDataFrame([(2, "n"), (3, "n")], "k int, v string")
    assert {r.k: r.v for r in D.upsert(old, new, ["k"]).collect()} == {1: "o", 2: "n", 3: "n"}
    f = spark.createDataFrame([("m", "a", 2.0), ("m", "b", -1.0)], "row string, col string, f double")
    v = spark.createDataFrame([("a", 3.0), ("b", 4.0)], "col string, v double")
    r = spark.createDataFrame([("a", "a", 1.0), ("b", "b", 2.0)], "col string, col2 string, r double")
    fv, frf = D.linear_combination(f, v, r)
    assert fv.first().v == 2.0 and frf.first().r == 6.0
    c = spark.createDataFrame([("p", "a", 1.0), ("p", "b", 2.0)], "pseudo string, parent string, coeff double")
    assert D.pseudo_state(v.withColumnRenamed("col", "key"), c, "key", "v").first().value == 11.0


def test_expiry_keeps_the_newest(spark):
    d = series(spark, [0.0, 1.0, 2.0])
    now = int((T0 - datetime(1970, 1, 1)).total_seconds() * 1e6) + 10**12
    assert [r.i for r in S.expire(d, ["k"], "t", now, 5).collect()] == [2]
    mid = int((T0 - datetime(1970, 1, 1)).total_seconds() * 1e6) + 90_000_000
    assert sorted(r.i for r in S.keep_current(d, ["k"], "t", mid).collect()) == [1, 2]


def test_documents_pairs_and_merges(spark):
    m = spark.createDataFrame([("e", "C", 1, 0.5, None), ("e", "P", 2, 1.5, 2.5), ("e", "P", 2, 1.0, 3.0)], "k string, c string, n int, Prefit double, Postfit double")
    assert D.measurement_documents(m, ["k"], "c", "n", ["Prefit", "Postfit"]).first().document == {"C-1-Prefit": 0.5, "P-2-Prefit": 1.5, "P-2-Postfit": 3.0}
    f = spark.createDataFrame([("/a/net.trace",), ("/b/net_smoothed.trace",), ("/a/alone.trace",)], "p string")
    assert [tuple(r) for r in D.pair_by_stem(f, "p", "_smoothed").collect()] == [("net", "/a/net.trace", "/b/net_smoothed.trace")]
    a = spark.createDataFrame([("x", "x", 1.0), ("x", "y", 0.5), ("y", "y", 2.0)], "i string, j string, p double")
    assert sorted((r["filter"], r.i, r.j) for r in D.merge_filters([a, a], ["x"]).collect()) == [(0, "x", "x"), (1, "x", "x")]
