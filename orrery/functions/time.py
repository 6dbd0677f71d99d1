"""Column functions for GPST, UTC, week and civil time. Instants are long microseconds since 1970 on the named clock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# GPS epoch 1980-01-06, BeiDou epoch 2006-01-01, MJD of 1970-01-01, seconds of a week.
GPS_EPOCH_S = 315_964_800
BDS_EPOCH_S = 1_136_073_600
MJD_UNIX = 40_587
WEEK_S = 604_800
DAY_US = 86_400_000_000


def week_tow_us(week: Column, tow: Column) -> Column:
    """GPST microseconds of a GPS week and seconds of week."""
    return (F.lit(GPS_EPOCH_S) + week.cast("long") * WEEK_S) * 1_000_000 + F.round(tow * 1e6).cast("long")


def gps_week(us: Column) -> Column:
    return F.floor((us / 1_000_000 - GPS_EPOCH_S) / WEEK_S).cast("int")


def gps_tow(us: Column) -> Column:
    return F.pmod(us - GPS_EPOCH_S * 1_000_000, F.lit(WEEK_S * 1_000_000)) / 1e6


def mjd(us: Column) -> Column:
    return us / float(DAY_US) + MJD_UNIX


def second_of_day(us: Column) -> Column:
    return F.pmod(us, F.lit(DAY_US)) / 1e6


def leap_rows(leaps: DataFrame) -> list[tuple[int, int]]:
    """(utc microseconds from which, GPST minus UTC seconds); the table is a fixed one of a few rows, checked here."""
    rows = leaps.select(F.unix_micros(F.col("utc_from").cast("timestamp")), F.col("gpst_minus_utc")).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("a leap second table has under 1000 rows")
    return sorted((int(a), int(b)) for a, b in rows)


def utc_to_gpst(us: Column, leaps: Sequence[tuple[int, int]]) -> Column:
    """GPST microseconds; null before the first leap row."""
    out = F.lit(None).cast("long")
    for start, d in leaps:
        out = F.when(us >= start, us + d * 1_000_000).otherwise(out)
    return out


def gpst_to_utc(us: Column, leaps: Sequence[tuple[int, int]]) -> Column:
    """UTC microseconds; the second inserted by a leap keeps the count before it."""
    out = F.lit(None).cast("long")
    for start, d in leaps:
        out = F.when(us >= start + d * 1_000_000, us - d * 1_000_000).otherwise(out)
    return out


def zone_offset(us: Column, zone: Column) -> Column:
    """Offset from UTC in microseconds of an IANA zone at a UTC instant."""
    ts = F.timestamp_micros(us)
    return F.unix_micros(F.from_utc_timestamp(ts, zone)) - us


def doy_range(text: Column) -> Column:
    """'17' or '17-20' as an array of days; null where it is neither."""
    a, b = F.regexp_extract(text, r"^\s*(\d+)\s*(?:-\s*(\d+)\s*)?$", 1).try_cast("int"), F.regexp_extract(text, r"^\s*(\d+)\s*-\s*(\d+)\s*$", 2).try_cast("int")
    return F.when(a.isNotNull() & (F.coalesce(b, a) >= a), F.sequence(a, F.coalesce(b, a)))


def period_seconds(value: Column, unit: Column) -> Column:
    """Seconds of so many seconds, minutes, hours, days, weeks or years (singular, plural or short)."""
    u = F.lower(F.trim(unit))
    one = F.when(u.rlike("^s(ec(ond)?s?)?$"), 1.0).when(u.rlike("^m(in(ute)?s?)?$"), 60.0).when(u.rlike("^h((ou)?rs?)?$"), 3600.0).when(u.rlike("^d(ays?)?$"), 86_400.0).when(u.rlike("^w((ee)?ks?)?$"), 604_800.0).when(u.rlike("^y((ea)?rs?)?$"), 31_557_600.0)
    return value * one


def decimal_year(ts: Column) -> Column:
    """Year and the share of it that has passed."""
    y = F.year(ts)
    a, z = (F.unix_micros(F.make_timestamp(y + k, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))) for k in (0, 1))
    return y + (F.unix_micros(ts.cast("timestamp")) - a) / (z - a)


def nearest_week(week: Column, reference_week: Column) -> Column:
    """A week given modulo 1024, next to a reference week."""
    return week + F.round((reference_week - week) / 1024).cast("int") * 1024
