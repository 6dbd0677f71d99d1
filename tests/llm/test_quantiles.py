import math

import numpy as np
from pyspark.sql import functions as F

from orrery.llm import quantiles as Q

AT = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


def exact(v, p):
    v = np.sort(v)
    return v[math.floor(p * (len(v) - 1))]


def test_error_bound_and_merge(spark):
    rng = np.random.default_rng(5)
    rows = [(k, d, float(x)) for k in ("a", "b") for d in range(5) for x in np.concatenate([rng.lognormal(0, 3, 200), -rng.lognormal(-5, 2, 200), np.zeros(3)])]
    df = spark.createDataFrame(rows, "k string, d int, x double")
    days = Q.sketch(df, ["k", "d"], "x", 0.02)
    merged = Q.percentiles(Q.merge(days, ["k"]), ["k"], AT, 0.02).collect()
    assert len(merged) == 2 * len(AT)
    for r in merged:
        v = np.array([x for k, _, x in rows if k == r.k])
        t = exact(v, r.p)
        assert r.n == len(v) and abs(r.estimate - t) <= 0.02 * abs(t) + 1e-9 and r.lower - 1e-12 <= t <= r.upper + 1e-12
    whole = {(r.k, r.p): r.estimate for r in Q.percentiles(Q.sketch(df, ["k"], "x", 0.02), ["k"], AT, 0.02).collect()}
    assert whole == {(r.k, r.p): r.estimate for r in merged}


def test_odd_values(spark):
    df = spark.createDataFrame([(None, None), (None, 1.0), (None, math.nan), (None, math.inf), ("z", -math.inf), ("z", 1e-300), ("z", 1e300)], "k string, x double")
    s = {(r.k, r.sgn, r.bucket) for r in Q.sketch(df, ["k"], "x").collect()}
    assert (None, None, 0) in s and (None, None, 1) in s and ("z", None, -1) in s and ("z", 1, -34537) in s
    p = {(r.k, r.p): r.estimate for r in Q.percentiles(Q.sketch(df, ["k"], "x"), ["k"], [0.0, 1.0]).collect()}
    assert abs(p[None, 0.0] - 1) < 0.01 and abs(p["z", 0.0] / 1e-300 - 1) < 0.01 and abs(p["z", 1.0] / 1e300 - 1) < 0.01


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([], "k string, n int, p int, bucket int, x double")
    assert Q.percentiles(Q.sketch(df, ["k"], "x"), ["k"], [0.5]).count() == 0
    one = spark.createDataFrame([("a", 1, 2, 3, 4.0)], "k string, n int, p int, bucket int, x double")
    assert Q.percentiles(Q.sketch(one, ["k"], "x"), ["k"], [0.5]).count() == 1


def test_pre_aggregates_before_the_shuffle(spark):
    df = spark.range(10).select(F.lit("k").alias("k"), F.rand().alias("x"))
    assert "partial_count" in Q.sketch(df, ["k"], "x")._jdf.queryExecution().executedPlan().toString()


def test_the_whole_report_stands_first():
    from orrery.llm.queries import QUERIES

    assert next(q for q in QUERIES if q.startswith("p1_")) == "p1_percentiles"


def test_tiny_values_keep_their_bound(spark):
    rows = [("a", x) for x in (1e-300, -3e-200, 0.0, -0.0, 5e-14)]
    got = {round(r.p, 2): r for r in Q.percentiles(Q.sketch(spark.createDataFrame(rows, "k string, v double"), ["k"], "v"), ["k"], (0.0, 0.5, 0.75, 1.0)).collect()}
    for p, t in ((0.0, -3e-200), (0.5, 0.0), (0.75, 1e-300), (1.0, 5e-14)):
        assert abs(got[p].estimate - t) <= 0.0101 * abs(t) and got[p].lower <= t * (1 - 1e-9 if t < 0 else 1) + abs(t) * 1e-9 and got[p].upper >= t - abs(t) * 1e-9
