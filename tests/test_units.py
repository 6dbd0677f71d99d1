from datetime import datetime

import pytest
from pyspark.sql import functions as F

from orrery.operators.units import clean_label, harmonise_delays, label_of, length_factor, number_of, variance_form

BERN = "bern_id long, site string, datetime timestamp_ntz, ZTD string, std string, unit string, logged_at timestamp_ntz, factor string"
PEA = "pea_id long, site string, gpswk int, seconds double, datetime timestamp_ntz, trop_value double, trop_var double, var_unit string, raw string"
T = datetime(2019, 1, 8, 3)


NUMBERS = [("2 465.1", 2465.1, None), ("2465,1", 2465.1, None), ("+2.0179", 2.0179, None), ("1.976400E+0", 1.9764, None), ("2.258200E+3 mm", 2258.2, "mm"), ("7.23600592ns", 7.23600592, "ns"), ("  244.74 cm ", 244.74, "cm"), ("24242 0.1 mm", 24242.0, "0.1 mm"), ("n/a", None, None), ("", None, None), ("---", None, None), (None, None, None), (".85 m", 0.85, "m")]


def test_numbers(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(NUMBERS)], "k int, t string")
    for r in df.select("k", number_of(F.col("t")).alias("n"), clean_label(label_of(F.col("t"))).alias("l")).collect():
        text, number, label = NUMBERS[r.k]
        assert r.n == number and (r.l == label or number is None), text


LENGTHS = [("M", 1.0), ("[cm]", 0.01), ("unit=cm", 0.01), ("unit: mm", 0.001), ("mm.", 0.001), ("metre(s)", 1.0), ("tenths of mm", 1e-4), ("10^-4 m", 1e-4), ("1e-4 m", 1e-4), ("0.1 mm", 1e-4), ("µm", 1e-6), ('"', 0.0254), ("feet", 0.3048), ("nsec", 0.299792458), ("n/a", None), ("?", None), ("apples", None)]


def test_lengths(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(LENGTHS)], "k int, t string")
    for r in df.select("k", length_factor(clean_label(F.col("t"))).alias("f")).collect():
        label, metres = LENGTHS[r.k]
        assert r.f == (None if metres is None else pytest.approx(metres)), label


VARIANCES = [("MM**2", 1e-6, 1), ("square centimetres", 1e-4, 1), ("10^-6 m^2", 1e-6, 1), ("1e-6 m2", 1e-6, 1), ("variance [mm²]", 1e-6, 1), ("sq. metres", 1.0, 1), ("[m**2]", 1.0, 1), ("std dev, cm", 0.01, 2), ("sigma mm", 0.001, 2), ("std (mm)", 0.001, 2), ("1-sigma [m]", 1.0, 2)]


def test_variances(spark):
    f, p = variance_form(clean_label(F.col("t")))
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(VARIANCES)], "k int, t string")
    for r in df.select("k", f.alias("f"), p.alias("p")).collect():
        label, factor, power = VARIANCES[r.k]
        assert r.f == pytest.approx(factor) and r.p == power, label


def both(spark, bern, pea):
    a, b = harmonise_delays(spark.createDataFrame(bern, BERN), spark.createDataFrame(pea, PEA))
    return {(r.bern_id, r.field): r for r in a.collect()}, {r.pea_id: r for r in b.collect()}


def test_records(spark):
    bern = [
        (1, "A", T, "2400.0", "2.0", None, T, ""), (2, "A", T, "240.00", "0.20", "", T, ""), (3, "A", T, "2.4000", "0.0020", "-", T, ""), (4, "A", T, "240.00 cm", "2.0", "mm", T, ""), (5, "A", T, "7.87401575 ft", "0.00656", None, T, ""),
        (6, "A", T, "n/a", "2.0", None, T, ""), (7, "A", T, "n/a", "2.0", "mm", T, ""), (8, None, None, "2400.0", None, None, T, ""), (9, "A", T, "5.0", None, None, T, ""), (10, "A", T, "2.4 apples", None, None, T, ""), (10, "A", T, "2.4 apples", None, None, T, ""),
    ]
    pea = [(1, "A", 2035, 0.0, T, 2.4, 4e-6, None, ""), (2, "A", 2035, 183600.0, None, 2.4, 4.0, "", ""), (3, "A", 2035, 0.0, T, None, 2.0, "sigma mm", ""), (4, "A", None, None, None, None, None, None, "")]
    b, v = both(spark, bern, pea)
    assert [b[i, "ZTD"].value_m for i in (1, 2, 3, 4)] == pytest.approx([2.4] * 4) and b[5, "ZTD"].value_m == pytest.approx(2.4, abs=1e-6)
    assert [b[i, "std"].value_m for i in (1, 2, 3, 4)] == pytest.approx([0.002] * 4) and b[5, "std"].value_m == pytest.approx(0.002, abs=1e-5)
    assert b[6, "std"].value_m is None and b[7, "std"].value_m == pytest.approx(0.002) and b[8, "ZTD"].value_m == pytest.approx(2.4)
    assert b[9, "ZTD"].value_m is None and b[5, "std"].how == "ztd" and b[4, "std"].how in ("label", "graph")
    assert v[1].value_m2 == pytest.approx(4e-6) and v[2].value_m2 == pytest.approx(4e-6) and v[3].value_m2 == pytest.approx(4e-6) and v[4].value_m2 is None


def test_unknown_label_by_linked_sources(spark):
    bern = [(i, "A", T, f"{2.4 / 0.9144:.6f} ell", "0.002", None, T, "") for i in range(5)]
    b, _ = both(spark, bern, [(1, "A", 2035, 0.0, T, 2.4, 4e-6, None, "")])
    assert b[0, "ZTD"].value_m == pytest.approx(2.4, abs=1e-4) and b[0, "ZTD"].how == "graph"


def test_empty(spark):
    assert both(spark, [], []) == ({}, {})


def linked(spark, readings, **kw):
    """Sites of different heights, one reading an hour; readings(k, true metres) gives the text and the unit column."""
    rows, pea = [], []
    for k in range(60):
        t, v = T.replace(day=1 + k // 20, hour=k % 20), 1.9 + 0.6 * (k % 13) / 13
        rows.append((k, f"S{k % 13}", t, *readings(k, v), T, ""))
        pea.append((k, f"S{k % 13}", None, None, t, v, 4e-6, None, ""))
    a, _ = harmonise_delays(spark.createDataFrame([(i, s, t, z, None, u, lg, x) for i, s, t, z, u, lg, x in rows], BERN), spark.createDataFrame(pea, PEA), **kw)
    want = {r[0]: p[5] for r, p in zip(rows, pea, strict=True)}
    return {r.bern_id: r for r in a.where("field = 'ZTD'").collect()}, want


def test_links_give_units_labels_do_not_tell(spark):
    """Opaque labels of feet and nanoseconds, 1.7 % apart; the range allows either."""
    got, want = linked(spark, lambda k, v: (f"{v / (0.3048 if k % 2 else 0.299792458):.6f}", "foo" if k % 2 else "bar"))
    assert all(got[k].value_m == pytest.approx(want[k], abs=1e-5) and got[k].how == "graph" for k in want)


def test_a_source_with_an_offset(spark):
    """A source that counts centimetres above 1.5 m: scale and offset are both found."""
    got, want = linked(spark, lambda k, v: (f"{(v - 1.5) * 100:.4f}", "foo"))
    assert all(got[k].value_m == pytest.approx(want[k], abs=1e-3) and got[k].factor == pytest.approx(0.01) for k in want)


def test_a_label_that_lies_is_marked(spark):
    got, want = linked(spark, lambda k, v: (f"{v * 100:.3f}", "mm"))
    assert all(r.how == "conflict" for r in got.values())
    got, want = linked(spark, lambda k, v: (f"{v * 100:.3f}", "mm"), read_labels=False)
    assert all(got[k].value_m == pytest.approx(want[k], abs=1e-4) and got[k].how == "graph" for k in want)
