import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from orrery.operators import joins as J

T0 = datetime(2019, 1, 6)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


@pytest.fixture(scope="module")
def sides(spark):
    rnd = random.Random(8)
    left = [(i, rnd.choice(["a", "b", None]), at(rnd.randrange(0, 6000))) for i in range(200)]
    right = [(i, rnd.choice(["a", "b", None]), at(rnd.randrange(0, 6000)), float(i)) for i in range(90)]
    return left, right, spark.createDataFrame(left, "id int, k string, t timestamp_ntz"), spark.createDataFrame(right, "rid int, k string, t timestamp_ntz, v double")


def brute(left, right, direction, age=None):
    out = {}
    for i, k, t in left:
        c = [(abs((rt - t).total_seconds()), rt > t, -rid if rt <= t else rid, rid) for rid, rk, rt, _ in right if rk == k and ((direction != "forward" and rt <= t) or (direction != "backward" and rt >= t))]
        if age is not None:
            c = [x for x in c if x[0] <= age]
        out[i] = min(c)[3] if c else None
    return out


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("bucket", [None, 3600.0, 86_400.0])
@pytest.mark.parametrize("age", [None, 1800.0])
def test_asof(sides, direction, bucket, age):
    left, right, l, r = sides
    got = {x.id: x.right.rid if x.right else None for x in J.asof_join(l, r, ["k"], "t", "t", direction, age, bucket, ["rid"]).collect()}
    assert got == brute(left, right, direction, age)


def test_asof_matches_pandas(sides):
    left, right, l, r = sides
    a = pd.DataFrame([x for x in left if x[1]], columns=["id", "k", "t"]).sort_values("t")
    b = pd.DataFrame([x for x in right if x[1]], columns=["rid", "k", "t", "v"]).sort_values(["t", "rid"])
    want = {x.id: None if pd.isna(x.rid) else int(x.rid) for x in pd.merge_asof(a, b, on="t", by="k").itertuples()}
    got = {x.id: x.right.rid if x.right else None for x in J.asof_join(l, r, ["k"], "t", "t", bucket_s=7200.0, order=["rid"]).collect() if x.k}
    assert got == want


def test_delay_and_empty_sides(spark, sides):
    _, _, l, r = sides
    none = spark.createDataFrame([], r.schema)
    assert all(x.right is None for x in J.asof_join(l, none, ["k"], "t", "t", bucket_s=3600.0).collect())
    assert J.asof_join(spark.createDataFrame([], l.schema), r, ["k"], "t", "t", bucket_s=3600.0).count() == 0
    one = spark.createDataFrame([(1, "a", at(10))], l.schema)
    src = spark.createDataFrame([(5, "a", at(9), 1.0), (4, "a", at(0), 1.0)], r.schema)
    assert J.asof_join(one, src, ["k"], "t", "t", delay_s=300).first().right.rid == 4


def test_straddle(spark):
    l = spark.createDataFrame([(i, "a", at(m)) for i, m in enumerate((0, 5, 10, 15, 40, -5))], "id int, k string, t timestamp_ntz")
    r = spark.createDataFrame([("a", at(0), 1.0, 7), ("a", at(10), 3.0, 7), ("a", at(20), 9.0, 8), ("a", at(200), 9.0, 8)], "k string, t timestamp_ntz, v double, iod int")
    got = {x.id: x.interpolated for x in J.straddle(l, r, ["k"], "t", "t", "v", same="iod", max_gap_s=1200, bucket_s=600.0).collect()}
    assert got == {0: 1.0, 1: 2.0, 2: 3.0, 3: None, 4: None, 5: None}


def test_polynomial(spark):
    pts = [(float(k), 2.0 + 3 * k - 0.5 * k * k) for k in (-3, -1, 0.5, 2, 4)]
    df = spark.createDataFrame([(pts,)], "p array<struct<t:double,v:double>>")
    assert df.select(J.neville(F.col("p"), F.lit(1.25))).first()[0] == pytest.approx(2 + 3 * 1.25 - 0.5 * 1.25**2)


def test_neighbours(spark):
    l = spark.createDataFrame([(1, "a", at(100))], "id int, k string, t timestamp_ntz")
    r = spark.createDataFrame([("a", at(m), float(m)) for m in range(0, 200, 10)], "k string, t timestamp_ntz, v double")
    p = J.neighbours(l, r, ["k"], "t", "t", "v", 3, 2, 3600, 3600).first().points
    assert [x.v for x in p] == [80.0, 90.0, 100.0, 110.0, 120.0]


def test_validity_policies(spark):
    l = spark.createDataFrame([(1, "a", at(5)), (2, "a", at(50))], "id int, k string, t timestamp_ntz")
    r = spark.createDataFrame([("a", at(0), at(10), 1)], "k string, s timestamp_ntz, e timestamp_ntz, v int")
    assert {x.id: x.right is not None for x in J.valid_at(l, r, ["k"], "t", "s", "e").collect()} == {1: True, 2: False}
    assert {x.id: x.right is not None for x in J.valid_at(l, r, ["k"], "t", "s", "e", "keep").collect()} == {1: True, 2: True}


def test_chain_guards_cycles_and_signs(spark):
    e = spark.createDataFrame([("A", "B", 1.0, 0.1), ("B", "C", 2.0, 0.1), ("C", "A", 10.0, 0.1), ("D", "C", 5.0, 0.2)], "c1 string, c2 string, b double, v double")
    got = {(r.src, r.dst): (r.value, r.hops, round(r.var, 3)) for r in J.chain_lookup(e, "c1", "c2", "b", "v").collect()}
    assert got["A", "B"] == (1.0, 1, 0.1) and got["B", "A"] == (-1.0, 1, 0.1) and got["A", "C"] == (-10.0, 1, 0.1)
    assert got["A", "D"] == (-15.0, 2, 0.3) and len(got) == 12


def test_priority_merge_and_metadata(spark):
    c = spark.createDataFrame([("s", "log", "X"), ("s", "sinex", "Y"), ("s", "rinex", ""), ("s", "other", "Z"), ("t", "log", None)], "id string, src string, v string")
    got = {r.id: (r.v, r.src, r.sources) for r in J.metadata_priority(c, "id", "src", "v", ["rinex", "sinex", "log"]).collect()}
    assert got == {"s": ("Y", "sinex", ["log", "sinex"])}
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    b = spark.createDataFrame([(2, float("nan")), (3, 3.0)], "k int, v double")
    assert {r.k: r.v for r in J.merge_outer(a, b, ["k"], ["v"]).collect()} == {1: 1.0, 2: 2.0, 3: 3.0}
    assert {r.k: r.side for r in J.match_three(a, b, ["k"]).collect()} == {1: "left", 2: "both", 3: "right"}
