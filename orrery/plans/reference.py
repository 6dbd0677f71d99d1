"""All queries of the engine's own operators and their SQL."""

from __future__ import annotations


from orrery.operators.stats import matrix_with_margins
from orrery.plans import estimation, formats, relational, satellites, streams
from orrery.plans.util import q6, rounded
from orrery.session import table


def residual_matrix(spark, base):
    """Mean, spread and rms per cell, per row, per column and over all."""
    return rounded(matrix_with_margins(table(spark, base, "events"), "user_id", "event_type", "value"), "mean", "std", "rms")


QUERIES = {"residual_matrix": residual_matrix}
SQL = {
    "residual_matrix": f"""SELECT user_id, event_type, count(*) AS n, {q6("avg(value)")} AS mean, {q6("stddev_samp(value)")} AS std, {q6("sqrt(avg(value * value))")} AS rms,
CAST(grouping(user_id, event_type) AS INTEGER) AS margin FROM events GROUP BY CUBE (user_id, event_type)"""
}
for _m in (relational, estimation, satellites, formats, streams):
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
