import math
from datetime import datetime, timedelta

import pytest

from orrery.operators.regrid import regular_grid

SCHEMA = "site string, Time timestamp_ntz, dN double, dE double, dU double, status string, slot_s string"
T0 = datetime(2019, 1, 6)


def grid(spark, data, **kw):
    return [tuple(r) for r in regular_grid(spark.createDataFrame(data, SCHEMA), **kw).orderBy("site", "slot_s").collect()]


def at(minutes, v, site="A"):
    return (site, T0 + timedelta(minutes=minutes), v, v, v, "", "")


def test_fill_gap_and_reading(spark):
    got = grid(spark, [at(5, 1.0), at(35, 4.0), at(155, 16.0)], max_gap_s=3600)
    assert [g[2] for g in got][:4] == ["reading", "filled", "filled", "reading"]
    assert [g[2] for g in got][4:-1] == ["gap"] * 11 and got[-1][2] == "reading"
    assert got[1][4] == pytest.approx(1.5) and got[2][4] == pytest.approx(2.5) and got[3][4] == pytest.approx(3.5) and got[5][4] is None
    assert got[1][1] - got[0][1] == 600


def test_unusable_rows_repeats_and_sources(spark):
    bad = [("A", T0 + timedelta(minutes=15), math.nan, 1.0, 1.0, "", ""), ("A", T0 + timedelta(minutes=16), None, 1.0, 1.0, "", ""), ("A", None, 1.0, 1.0, 1.0, "", "")]
    got = grid(spark, [at(0, 1.0), at(0, 1.0), *bad, at(25, 2.0), at(3, 9.0, None)])
    assert [g[2] for g in got if g[0] == "A"] == ["reading", "filled", "reading"]
    assert [g[2] for g in got if g[0] is None] == ["reading"]


def test_exact_slot_start_and_no_limit(spark):
    got = grid(spark, [at(10, 1.0), at(1450, 145.0)], max_gap_s=None)
    assert len(got) == 145 and got[0][4] == 1.0 and got[72][4] == pytest.approx(73.0) and "gap" not in {g[2] for g in got}


def test_empty(spark):
    assert grid(spark, []) == []


def test_gaps_over_stretches(spark):
    """A gap of two years crosses many stretches; every slot comes once, the neighbours are the true ones."""
    got = grid(spark, [at(0, 1.0), at(10, 2.0), at(10 * 105_000, 3.0), at(0, 5.0, None)])
    a = [g for g in got if g[0] == "A"]
    assert len(a) == 105_001 and len({g[1] for g in a}) == len(a)
    assert [g[2] for g in a].count("gap") == 104_998 and a[-1][2] == "reading" and a[-1][3] == (10 * 105_000 - 10) * 60
    assert [g[2] for g in got if g[0] is None] == ["reading"]
