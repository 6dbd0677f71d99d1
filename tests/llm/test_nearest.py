import random

from orrery.llm.nearest import first_delivery, nearest

L = "id long, e string, t long, k int"
R = "rid long, e string, t long, best int"


def pairs(spark, left, right, tol=150.0, tick=60.0, **kw):
    out = nearest(spark.createDataFrame([(*x, 0) for x in left], L), spark.createDataFrame([(*x, 0) for x in right], R), "e", "id", "rid", "t", "t", tol, tick, **kw)
    return sorted((r.id, r.rid) for r in out.collect())


def brute(left, right, tol):
    out = []
    for i, e, t in left:
        c = [(abs(rt - t), rt, rid) for rid, re_, rt in right if e is not None and t is not None and re_ == e and rt is not None and abs(rt - t) <= tol * 1e6]
        if c:
            out.append((i, min(c)[2]))
    return sorted(out)


def test_against_brute_force(spark):
    rnd = random.Random(4)
    s = 1_000_000
    right = [(1000 + i, rnd.choice("AAAB"), rnd.randrange(0, 7200 * 100) * s // 100) for i in range(120)]
    on = [(i, rnd.choice("AB"), 60 * s * rnd.randrange(0, 120)) for i in range(100)]
    off = [(200 + i, rnd.choice("AB"), rnd.randrange(0, 7200) * s + 7) for i in range(100)]
    for left in (on, off, on + off):
        assert pairs(spark, left, right) == brute(left, right, 150)
    assert pairs(spark, on, right, on_ticks=True) == brute(on, right, 150)


def test_ties_bounds_repeats_and_nulls(spark):
    s = 1_000_000
    left = [(1, "A", 600 * s), (2, "A", 6000 * s), (3, None, 600 * s), (4, "A", None), (5, "A", 601 * s), (6, "B", -600 * s)]
    right = [(9, "A", 700 * s), (8, "A", 500 * s), (7, "A", 500 * s), (10, "A", 6150 * s), (11, "A", 5849 * s), (12, None, 600 * s), (13, "A", None), (14, "B", -750 * s)]
    assert pairs(spark, left, right) == [(1, 7), (2, 10), (5, 9), (6, 14)] == brute(left, right, 150)


def test_empty(spark):
    assert pairs(spark, [], [(1, "A", 0)]) == [] and pairs(spark, [(1, "A", 0)], []) == []


def test_first_delivery(spark):
    df = spark.createDataFrame([(5, "A", 1.0), (3, "A", 1.0), (4, "A", None), (6, "A", None)], "id long, e string, x double")
    assert sorted(r.id for r in first_delivery(df, "id", ["e", "x"]).collect()) == [3, 4]
