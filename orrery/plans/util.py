"""Helpers the plan modules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.session import table


def r6(c: Column | str) -> Column:
    """Six decimals, eleven significant digits from a million on, where six decimals are more than a double holds in a sum.

    The nudge keeps exact halves from falling either way in the two engines, the zero a negative zero.
    """
    c = F.col(c) if isinstance(c, str) else c
    p = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(c))) - 10)
    return F.when((F.abs(c) >= 1e6) & (F.abs(c) < float("inf")), F.round(c / p + 1e-3) * p).otherwise(F.round(c + 1e-9, 6) + 0.0)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def residuals(spark: SparkSession, base: str, column: str = "postfit") -> DataFrame:
    """Residual rows with a finite value in the one column that is read, however large, and whatever the others hold: a sum has no use for the rest."""
    return table(spark, base, "residual").where(f"{column} IS NOT NULL AND NOT isnan({column}) AND abs({column}) < double('inf')")


#: The rows of residuals() in SQL, and rounding as by r6.
RESIDUALS = "(SELECT * FROM residual WHERE isfinite(postfit))"


def q6(x: str) -> str:
    p = f"pow(10.0, floor(log10(abs({x}))) - 10)"
    return f"(CASE WHEN abs({x}) >= 1e6 AND NOT isinf({x}) THEN round(({x}) / {p} + 1e-3) * {p} ELSE round({x} + 1e-9, 6) + 0.0 END)"
