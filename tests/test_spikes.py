import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from orrery.operators.spikes import flag_spikes, phase_space, series_limits

T0 = datetime(2019, 1, 6)
SCHEMA = "res_id long, recv string, sat string, sig string, meas string, datetime timestamp_ntz, prefit double, postfit double, id string, value string, reason string"


def rows(values, start=T0, step=30, recv="A", first=1):
    return [(first + i, recv, "G01", "L1C", "CODE_MEAS", start + timedelta(seconds=step * i), v, 0.001 * ((i * 7) % 11), "x", "y", "z") for i, v in enumerate(values)]


def found(spark, data, **kw):
    df = flag_spikes(spark.createDataFrame(data, SCHEMA), **kw)
    return {(r.res_id, r.field): r.reason for r in df.collect()}


def noise(n, seed=1, sigma=0.01):
    return np.round(np.random.default_rng(seed).normal(0, sigma, n), 4).tolist()


def test_empty(spark):
    assert found(spark, []) == {}


def test_spike_nonfinite_and_null(spark):
    v = noise(300)
    v[50], v[60], v[70], v[80], v[90] = 1.0, math.nan, math.inf, -math.inf, None
    got = found(spark, rows(v))
    assert {k: r for k, r in got.items() if k[1] == "prefit"} == {(51, "prefit"): "spike", (61, "prefit"): "nonfinite", (71, "prefit"): "nonfinite", (81, "prefit"): "nonfinite"}


def test_held_run_over_midnight_with_nulls_and_repeats(spark):
    v = noise(40)
    start = T0 + timedelta(days=1) - timedelta(seconds=30 * 20)
    for i in range(16, 24):
        v[i] = 0.0123
    v.insert(20, None)
    data = rows(v, start)
    again = (99, *data[18][1:])
    got = found(spark, [*data, again])
    held = {k[0] for k, r in got.items() if r == "held" and k[1] == "prefit"}
    assert held == {17, 18, 19, 20, 22, 23, 24, 25, 99}


def test_seven_equal_epochs_are_no_run(spark):
    v = noise(60)
    v[10:17] = [0.02] * 7
    assert not [k for k, r in found(spark, rows(v)).items() if r == "held" and k[1] == "prefit"]


def test_nan_breaks_a_run(spark):
    v = noise(60)
    v[10:19] = [0.02] * 9
    v[14] = math.nan
    assert not [k for k, r in found(spark, rows(v)).items() if r == "held" and k[1] == "prefit"]


def test_long_excursion_of_a_whole_day(spark):
    v = noise(900)
    day = rows(v, T0, 300)
    gone = [(*r[:6], 5.0 + r[6], *r[7:]) if T0 + timedelta(days=2) <= r[5] < T0 + timedelta(days=2, hours=12) else r for r in day]
    got = found(spark, gone)
    want = {r[0] for r in gone if r[6] > 4}
    assert {k[0] for k, x in got.items() if x == "spike" and k[1] == "prefit"} == want and len(want) == 144


def test_coarse_resolution_has_a_spread(spark):
    rng = np.random.default_rng(3)
    v = (np.round(rng.normal(0, 0.4, 400))).tolist()
    v[100] = 50.0
    got = {k: r for k, r in found(spark, rows(v), held=1000).items() if k[1] == "prefit"}
    assert got == {(101, "prefit"): "spike"}


def test_null_keys_and_bounds(spark):
    data = [(1, None, None, None, None, None, 1e9, None, "", "", ""), (2, None, None, None, None, None, 0.0, None, "", "", "")]
    got = found(spark, data, bounds=(-1e6, 1e6))
    assert got[(1, "prefit")] == "bound" and (2, "prefit") not in got


def test_matches_brute_force(spark, base):
    r = spark.read.parquet(f"{base}/residual.parquet")
    got = {(x.res_id, x.field) for x in flag_spikes(r).collect()}
    pdf = r.select("res_id", "recv", "sat", "sig", "meas", F.unix_micros(F.col("datetime").cast("timestamp")).alias("t"), "prefit", "postfit").toArrow().to_pandas(types_mapper=lambda t: pd.Float64Dtype() if str(t) == "double" else None)
    want = set()
    for _, g in pdf.groupby(["recv", "sat", "sig", "meas"]):
        for f in ("prefit", "postfit"):
            have = g[~g[f].isna() | g[f].map(lambda v: v is not pd.NA and v != v)]
            v = np.array([float(x) if x is not pd.NA else math.nan for x in have[f]])
            ids, t = have.res_id.to_numpy(), have.t.to_numpy()
            null = np.array([x is pd.NA for x in have[f]])
            v, ids, t = v[~null], ids[~null], t[~null]
            fin = np.isfinite(v)
            want |= {(i, f) for i in ids[~fin]}
            if fin.any():
                med = np.median(v[fin])
                dev = np.abs(v[fin] - med)
                s = max(1.4826 * np.median(dev), np.quantile(dev, 0.9) / 1.6449)
                for _ in range(4):
                    s = v[fin][dev <= 10 * s].std()
                want |= {(i, f) for i, d in zip(ids[fin], dev, strict=True) if d > 10 * s}
            first = {}
            for tt, i, x in sorted(zip(t, ids, v, strict=True)):
                first.setdefault(tt, x)
            seq = sorted(first.items())
            runs, k = {}, 0
            while k < len(seq):
                j = k
                while j + 1 < len(seq) and seq[j + 1][1] == seq[k][1]:
                    j += 1
                if j - k + 1 >= 8:
                    runs |= {tt: seq[k][1] for tt, _ in seq[k : j + 1]}
                k = j + 1
            want |= {(i, f) for tt, i, x in zip(t, ids, v, strict=True) if runs.get(tt) == x}
    assert got == want


def test_phase_space_and_limits():
    v = np.random.default_rng(0).normal(5, 0.1, 500)
    v[100] = 9
    assert phase_space(v, 5.0, 0.1)[100]
    med, sp = series_limits(np.ones(500), v, np.zeros(500), 10.0)
    assert abs(med - 5) < 0.02 and abs(sp - 0.1) < 0.01
    assert series_limits(np.ones(3), np.ones(3), np.zeros(3), 10.0) == (1.0, 0.0)


def test_many_spikes_on_one_side_of_a_day(spark):
    v = noise(2880, sigma=1.0)
    at = range(30, 2880, 71)
    for j, i in enumerate(at):
        v[i] = 12.0 + 48.0 * j / len(at) if j % 2 else 12.5
    got = {k[0] for k, r in found(spark, rows(v)).items() if r == "spike" and k[1] == "prefit"}
    assert got == {i + 1 for i in at} and len(got) == 41


def test_spread_is_that_of_all_rows_within_the_limit(spark):
    v = noise(2880, sigma=1.0)
    v[100:2800:90] = [15.0] * 30
    r = flag_spikes(spark.createDataFrame(rows(v), SCHEMA)).where("field = 'prefit' AND reason = 'spike'").agg(F.count("*").alias("n"), F.max("series_spread").alias("s")).first()
    assert r.n == 30 and abs(r.s - np.std([x for x in v if x != 15.0])) < 1e-9


def test_jumps_under_ten_spreads_are_phase_flags(spark):
    """A slow wave with jumps of about four of its spreads: no spike by the limit, found by the differences; at least nine of ten, and little else than the epochs whose differences they spoil."""
    rng = np.random.default_rng(6)
    v = np.sin(np.arange(2000) / 300) + rng.normal(0, 0.02, 2000)
    at = rng.choice(np.arange(20, 1980, 7), 40, replace=False)
    v[at] += rng.choice([-3.0, 3.0], 40)
    data = rows(v.tolist(), step=40)
    got = {i - 1: r for (i, f), r in found(spark, data, fields=("prefit",), phase=True).items()}
    hit = sum(got.get(int(a)) == "phase" for a in at)
    assert hit >= 36 and set(got.values()) == {"phase"} and sum(min(abs(at - k)) > 2 for k in got) <= 20
    assert found(spark, data, fields=("prefit",)) == {}


def test_first_spread_is_of_the_despiked_series():
    from orrery.operators.spikes import _field_summary

    v = np.random.default_rng(3).normal(0, 1, 500)
    v[::25] += 60
    s = _field_summary(v)
    assert s["dn"] >= 350 and abs(np.sqrt(s["dq"] / s["dn"]) - 1) < 0.1
