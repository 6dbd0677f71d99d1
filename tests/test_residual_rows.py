"""Queries that read one column of residual take every row with a finite value there."""

from datetime import datetime, timedelta

from orrery.plans.estimation import QUERIES as E
from orrery.plans.relational import QUERIES as R

SCHEMA = "res_id long, iter int, datetime timestamp_ntz, meas string, sat string, recv string, sig string, prefit double, postfit double, sigma double"


def test_a_null_prefit_or_a_large_value_loses_no_row(spark, tmp_path):
    t0 = datetime(2019, 1, 6)
    rows = [(i, 1, t0 + timedelta(seconds=30 * i), "PHAS_MEAS", "G01", "A", "L1C", None if i % 2 else 0.1, 2000.0 if i == 4 else 0.001 * i, 0.01) for i in range(10)]
    rows += [(10, 1, t0 + timedelta(seconds=300), "PHAS_MEAS", "G01", "A", "L1C", 0.1, None, 0.01), (11, 1, t0 + timedelta(seconds=330), "PHAS_MEAS", "G01", "A", "L1C", 0.1, float("nan"), 0.01)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/residual.parquet")
    used = {r.res_id: r.used for r in E["raim"](spark, str(tmp_path)).collect()}
    assert set(used) == set(range(10)) and not used[4]
    assert E["kalman_scalar"](spark, str(tmp_path)).count() == 10
    assert R["chi2_pass"](spark, str(tmp_path)).first().dof == 10 - 3
