"""Filters and selections: priorities, wildcards, exclusion bits, expected signals, validity windows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import micros


def excluded(flags: Sequence[str]) -> Column:
    """True where any of the named exclusion flags is set; null counts as unset."""
    return reduce(lambda a, b: a | b, (F.coalesce(F.col(f).cast("boolean"), F.lit(False)) for f in flags))


def exclusion_word(flags: Sequence[str]) -> Column:
    """The flags as one word, the first in bit 0."""
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.coalesce(F.col(f).cast("boolean"), F.lit(False)), 1 << i).otherwise(0) for i, f in enumerate(flags)))


def by_priority(df: DataFrame, group: Sequence[str], code: str, priorities: Sequence[str], prefer: Sequence[Column] = (), tie: Sequence[str] = ()) -> DataFrame:
    """The best row per group: unlisted codes are dropped; ``prefer`` conditions come first, then the place in the list. One map-side combined aggregate."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priorities]), F.col(code))
    rest = [c for c in df.columns if c not in group]
    order = F.struct(*[(~F.coalesce(p, F.lit(False))).alias(f"_p{i}") for i, p in enumerate(prefer)], rank.alias("_r"), *tie)
    return df.where(rank > 0).groupBy(*group).agg(F.min_by(F.struct(*rest), order).alias("_b")).select(*group, "_b.*").select(*df.columns)


def wildcard(name: Column | str, pattern: str) -> Column:
    """Match with '?' for one character and at most one '*' for any run of them."""
    if pattern.count("*") > 1:
        raise ValueError("a pattern has at most one '*'")
    quoted = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return (F.col(name) if isinstance(name, str) else name).like(quoted.replace("?", "_").replace("*", "%"))


def in_ignore_case(c: str, wanted: Sequence[str]) -> Column:
    return F.upper(c).isin(*[w.upper() for w in wanted])


def half_open(time: str, start: object, end: object) -> Column:
    return (F.col(time) >= F.lit(start)) & (F.col(time) < F.lit(end))


def finite(c: str) -> Column:
    """A number, neither NaN nor infinite, after coercion."""
    v = F.col(c).try_cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def only_where(kind: str, applies_to: Sequence[str], condition: Column) -> Column:
    """The condition, asked of some kinds of rows only."""
    return ~F.col(kind).isin(*applies_to) | condition


def repair_missing(df: DataFrame, group: Sequence[str], code: str, needs: str, source: str, value: str) -> DataFrame:
    """Rows of code ``needs`` without a value take the group's value of code ``source``."""
    w = Window.partitionBy(*group)
    src = F.max(F.when(F.col(code) == source, F.col(value))).over(w)
    return df.withColumn(value, F.when((F.col(code) == needs) & F.col(value).isNull(), src).otherwise(F.col(value)))


def classify_expected(expected: DataFrame, observed: DataFrame, on: Sequence[str], code: str, pseudorange: str, phase: str) -> DataFrame:
    """Every expected (on, code) with class OBSERVED, CODE_ONLY, PHASE_ONLY or MISSING."""
    o = observed.groupBy(*on, code).agg(F.max(pseudorange).alias("_p"), F.max(phase).alias("_l"))
    p, l = F.coalesce(F.col("_p") != 0, F.lit(False)), F.coalesce(F.col("_l") != 0, F.lit(False))
    cls = F.when(p & l, "OBSERVED").when(p, "CODE_ONLY").when(l, "PHASE_ONLY").otherwise("MISSING")
    return expected.join(o, [*on, code], "left").withColumn("class", cls).drop("_p", "_l")


def not_tracked(expected: DataFrame, observed: DataFrame, on: Sequence[str], visible: Column | None = None) -> DataFrame:
    """Expected rows nothing was observed of, where they were visible."""
    e = expected if visible is None else expected.where(visible)
    return e.join(observed.select(*on).distinct(), list(on), "left_anti")


def validity(intervals: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """Common validity: the latest start and the earliest end (null is open), where it is not empty."""
    g = intervals.groupBy(*by).agg(F.max(start).alias(start), F.min(end).alias(end))
    return g.where(F.col(end).isNull() | (F.col(start) <= F.col(end)))


def latest(df: DataFrame, by: Sequence[str], time: str, n: int = 1) -> DataFrame:
    """The newest n rows per key; n = 1 by a map-side combined aggregate."""
    if n == 1:
        rest = [c for c in df.columns if c not in by]
        return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(time)).alias("_r")).select(*by, "_r.*").select(*df.columns)
    w = Window.partitionBy(*by).orderBy(F.desc(time))
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def expire(df: DataFrame, by: Sequence[str], time: str, now_us: int, max_age_s: float) -> DataFrame:
    """Rows at most max_age_s older than now; the newest row of each key is always kept."""
    newest = df.groupBy(*by).agg(F.max(micros(time)).alias("_n"))
    t = micros(time)
    return df.join(newest, list(by)).where((t >= now_us - int(max_age_s * 1e6)) | (t == F.col("_n"))).drop("_n")


def keep_current(df: DataFrame, by: Sequence[str], time: str, now_us: int) -> DataFrame:
    """The newest row at or before now and every later one."""
    t = micros(time)
    base = df.groupBy(*by).agg(F.max(F.when(t <= now_us, t)).alias("_n"))
    return df.join(base, list(by)).where(F.col("_n").isNull() | (t >= F.col("_n"))).drop("_n")
