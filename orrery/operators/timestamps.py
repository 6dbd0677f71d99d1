"""Mixed timestamp notations, clocks and zones to one GPST instant.

Every text is turned into its possible civil readings by JVM expressions (no Python, no shuffle). The clock of a feed's
own civil times is estimated: its records give, per day, a count of the lags between civil time and ingestion in steps of a quarter
of an hour (a map-side combined aggregate, bounded by the calendar and not by the rows), and of all offset histories
- zones with their daylight rules, fixed offsets, GPST, and changes from one to another - the one is taken that leaves the
fewest records logged before they happened or too late after, then the shortest delays. A told clock is a candidate with
an advantage: it yields only where the records contradict it. The civil times are then converted with the
history chosen, and the reading that fits the ingestion time stands.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.time import DAY_US, GPS_EPOCH_S, MJD_UNIX, WEEK_S, gpst_to_utc, leap_rows, utc_to_gpst, zone_offset
from orrery.session import checkpointed, micros, sized

# Zone abbreviations with one meaning among the feeds' regions, in minutes from UTC.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "NPT": 345, "AWST": 480, "JST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "NST": -210, "NDT": -150,
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ZONES = (
    "GPST", "UTC", "Europe/London", "Europe/Berlin", "Europe/Athens", "Europe/Moscow", "Asia/Dubai", "Asia/Karachi", "Asia/Kolkata", "Asia/Kathmandu", "Asia/Dhaka",
    "Asia/Bangkok", "Asia/Shanghai", "Asia/Tokyo", "Australia/Adelaide", "Australia/Brisbane", "Australia/Sydney", "Pacific/Auckland", "America/St_Johns",
    "America/Sao_Paulo", "America/New_York", "America/Chicago", "America/Denver", "America/Los_Angeles", "Pacific/Honolulu",
)

#: Fixed offsets tried beside the zones, in steps of a quarter of an hour from UTC.
OFFSETS = tuple(range(-48, 57, 2)) + (23, 35, 51, 55)
STEP_US = 900_000_000

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2}(?:[.,]\d+)?))?\s*([AaPp][Mm])?"
_SUFFIX = r"\s*(\(?[A-Za-z][A-Za-z ]*(?:[+-]\d{1,2}(?::?\d{2})?)?\)?|[+-]\d{1,2}(?::?\d{2})?)?"
_FORMS = (
    # pattern, canonical form kind|Y|M|D|h|m|s|ampm|suffix
    (rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})[T ]\s*{_TIME}{_SUFFIX}$", "ymd|$1|$2|$3|$4|$5|$6|$7|$8"),
    (rf"^(\d{{4}})-(\d{{3}})T{_TIME}{_SUFFIX}$", "doy|$1|1|$2|$3|$4|$5|$6|$7"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})[T ]\s*{_TIME}{_SUFFIX}$", "ymd|$3|$2|$1|$4|$5|$6|$7|$8"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})[T ]\s*{_TIME}{_SUFFIX}$", "amb|$3|$2|$1|$4|$5|$6|$7|$8"),
    (rf"^(\d{{1,2}})-([A-Za-z]{{3}})-(\d{{2}}|\d{{4}})[T ]\s*{_TIME}{_SUFFIX}$", "mon|$3|$2|$1|$4|$5|$6|$7|$8"),
    (rf"^([A-Za-z]{{3}})[a-z]*\.? (\d{{1,2}}), ?(\d{{4}}),? {_TIME}{_SUFFIX}$", "mon|$3|$1|$2|$4|$5|$6|$7|$8"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})T?(\d{{2}})(\d{{2}})(\d{{2}}(?:\.\d+)?){_SUFFIX}$", "ymd|$1|$2|$3|$4|$5|$6||$7"),
    (r"^(\d{4})\s+(\d{1,2})\s+(\d{1,2})\s+(\d{1,2})\s+(\d{1,2})\s+(\d{1,2}(?:\.\d+)?)$", "ymd|$1|$2|$3|$4|$5|$6||"),
    (r"^(\d{2}):(\d{3}):(\d{5}(?:\.\d+)?)$", "sod|$1|1|$2|0|0|$3||"),
)
_WEEK = r"(?i)^(?:(?:wk|week|w)\s*)?(\d{1,4})\s*[: ]\s*(?:(?:tow|sow|s)\s*)?(-?\d+(?:\.\d+)?)$"


def _lit(text: str) -> str:
    """A raw SQL string literal (no pattern here holds a double quote)."""
    return f'r"{text}"'


def _table(pairs) -> str:
    return "map(" + ", ".join(f"'{k}', {v}" for k, v in pairs) + ")"


def _week_us(week: str, tow: str) -> str:
    """GPST-like microseconds of a week and seconds, or milliseconds, that may pass either end by a week; null where there is no such time."""
    s = f"(CASE WHEN abs({tow}) > {2 * WEEK_S} THEN {tow} / 1000 ELSE {tow} END)"
    return f"CASE WHEN {week} >= 0 AND {s} BETWEEN -{WEEK_S} AND {2 * WEEK_S} THEN {GPS_EPOCH_S * 1_000_000} + CAST({week} AS BIGINT) * {WEEK_S * 1_000_000} + CAST(round(CAST({s} AS DECIMAL(28,9)) * 1000000) AS BIGINT) END"


def _reading(civil: str, clk: str = "'FEED'", off: str = "CAST(NULL AS BIGINT)", extra: str = "0L") -> str:
    return f"named_struct('civil', {civil}, 'clk', {clk}, 'off', {off}, 'extra', {extra})"


def _week_readings(us: str, week: str) -> list[str]:
    """Readings of a week given whole, or modulo 1024."""
    return [_reading(us if k == 0 else f"CASE WHEN {week} < 1024 THEN {us} + {k * 1024 * WEEK_S * 1_000_000} END") for k in range(4)]


def _text_stages(text: str, p: str) -> list[list[str]]:
    """SQL of the columns that read a text, stage by stage: what one stage computes the next reads. Names begin with ``p``."""
    canon = "CASE " + " ".join(f"WHEN {p}t RLIKE {_lit(pattern)} THEN regexp_replace({p}t, {_lit(pattern)}, '{form}')" for pattern, form in _FORMS) + " END"
    num = _lit(r"^(?:UTC|GMT|UT)?([+-]\d{1,2}(?::?\d{2})?)$")

    def civil(month: str, day: str) -> str:
        by_doy = f"{p}k IN ('doy', 'sod')"
        first = f"CASE WHEN {p}ok THEN unix_micros(try_make_timestamp({p}yy, if({by_doy}, 1, {month}), if({by_doy}, 1, {day}), 0, 0, 0)) END"
        leap = f"(({p}yy % 4 = 0 AND {p}yy % 100 <> 0) OR {p}yy % 400 = 0)"
        return f"CASE WHEN NOT {by_doy} THEN {first} + {p}us WHEN {day} BETWEEN 1 AND if({leap}, 366, 365) THEN {first} + ({day} - 1) * {DAY_US} + {p}us END"

    return [
        [f"regexp_replace({text}, {_lit(r'^[\s ]+|[\s ]+$')}, '') AS {p}t"],
        [f"{canon} AS {p}canon"],
        # a count, a day or a week is tried where no civil form fits
        [f"split({p}canon, '[|]') AS {p}p", f"CASE WHEN {p}canon IS NULL THEN regexp_extract({p}t, {_lit(_WEEK)}, 1) END AS {p}w1", f"CASE WHEN {p}canon IS NULL AND {p}t RLIKE {_lit(r'^\d{9,19}(?:\.\d+)?$')} THEN {p}t END AS {p}n1",
         f"CASE WHEN {p}canon IS NULL AND {p}t RLIKE {_lit(r'^\d{5}\.\d+$')} THEN CAST({p}t AS DECIMAL(20,12)) END AS {p}mjd"],
        [f"{p}p[0] AS {p}k", f"try_cast({p}p[1] AS INT) AS {p}y", f"try_cast({p}p[3] AS INT) AS {p}d", f"try_cast({p}p[4] AS INT) AS {p}h", f"try_cast({p}p[5] AS INT) AS {p}mi",
         f"CASE WHEN {p}p[0] = 'mon' THEN try_element_at({_table((m, i + 1) for i, m in enumerate(MONTHS))}, lower({p}p[2])) ELSE try_cast({p}p[2] AS INT) END AS {p}m",
         f"CASE WHEN {p}p[6] = '' THEN CAST(0 AS DECIMAL(18,9)) ELSE try_cast(translate({p}p[6], ',', '.') AS DECIMAL(18,9)) END AS {p}s", f"upper({p}p[7]) AS {p}ap",
         f"upper(trim(translate({p}p[8], '()', ''))) AS {p}sfx", f"CASE WHEN {p}w1 <> '' THEN CAST({p}w1 AS INT) END AS {p}w",
         f"CASE WHEN {p}w1 <> '' THEN try_cast(regexp_extract({p}t, {_lit(_WEEK)}, 2) AS DECIMAL(20,9)) END AS {p}tow",
         f"length(substring_index({p}n1, '.', 1)) AS {p}len", f"CAST({p}n1 AS DECIMAL(32,9)) AS {p}n"],
        [f"CASE WHEN {p}k IN ('sod', 'mon') AND {p}y < 100 THEN {p}y + if({p}y >= 80, 1900, 2000) ELSE {p}y END AS {p}yy",
         f"CASE WHEN {p}ap = '' THEN {p}h WHEN {p}h BETWEEN 1 AND 12 THEN {p}h % 12 + if({p}ap = 'PM', 12, 0) END AS {p}hh",
         f"if({p}k <> 'sod' AND {p}s >= 60 AND {p}s < 61 AND {p}mi = 59, 1000000L, 0L) AS {p}extra", f"CASE WHEN {p}sfx <> '' THEN regexp_extract({p}sfx, {num}, 1) END AS {p}num",
         f"{_week_us(p + 'w', p + 'tow')} AS {p}wus", f"CAST(round({p}n * CASE WHEN {p}len <= 11 THEN 1000000 WHEN {p}len <= 14 THEN 1000 WHEN {p}len <= 17 THEN 1 ELSE 0.001 END) AS BIGINT) AS {p}count"],
        [f"translate({p}num, '+-:', '') AS {p}dig", f"CASE WHEN {p}k = 'sod' THEN {p}s < 86400 ELSE {p}hh BETWEEN 0 AND 23 AND {p}mi BETWEEN 0 AND 59 AND ({p}s < 60 OR {p}extra > 0) END AS {p}ok",
         f"({p}hh * 3600L + {p}mi * 60) * 1000000 + CAST(round({p}s * 1000000) AS BIGINT) - {p}extra AS {p}us"],
        [f"CASE WHEN {p}num <> '' THEN if(left({p}num, 1) = '-', -1, 1) * if(length({p}dig) <= 2, CAST({p}dig AS INT) * 60, CAST(left({p}dig, length({p}dig) - 2) AS INT) * 60 + CAST(right({p}dig, 2) AS INT)) "
         f"ELSE try_element_at({_table(ABBREVIATIONS.items())}, {p}sfx) END AS {p}min"],
        [f"CASE WHEN {p}sfx = '' THEN 'FEED' WHEN {p}sfx IN ('GPST', 'GPS', 'GPS TIME', 'GPSTIME') THEN 'GPST' WHEN abs({p}min) <= 840 THEN 'UTC' END AS {p}clk", f"{p}min * 60000000L AS {p}off",
         f"{civil(p + 'm', p + 'd')} AS {p}civil", f"CASE WHEN {p}k = 'amb' THEN {civil(p + 'd', p + 'm')} END AS {p}swap"],
    ]


def readings(df: DataFrame, id_col: str, week: str, tow: str, texts: Sequence[str], feed: str, logged: str) -> DataFrame:
    """(_id, _feed, _log, _r): every record with its possible civil readings."""
    out = df.select(
        F.col(id_col).alias("_id"), F.col(feed).alias("_feed"), micros(logged).alias("_log"), F.col(week).cast("int").alias("_w"),
        F.when(~F.isnan(F.col(tow).cast("double")), F.col(tow).cast("decimal(28,9)")).alias("_tow"), *[F.col(c).alias(f"_x{i}") for i, c in enumerate(texts)],
    )
    stages = [[], *(list(x) for x in _text_stages("_x0", "_x0_"))] if texts else [[]]
    for i in range(1, len(texts)):
        for stage, more in zip(stages[1:], _text_stages(f"_x{i}", f"_x{i}_"), strict=True):
            stage += more
    # seconds without a week are of the week that ends with the ingestion, or of the next where a clock is ahead of UTC
    span = WEEK_S * 1_000_000
    seconds = f"CAST(round(CAST(if(abs(_tow) > {2 * WEEK_S}, _tow / 1000, _tow) AS DECIMAL(28,9)) * 1000000) AS BIGINT)"
    stages[0] += [f"{_week_us('_w', '_tow')} AS _wus", f"CASE WHEN _w IS NULL THEN {seconds} END AS _sus"]
    stages.append([f"CASE WHEN _sus BETWEEN -{span} AND {2 * span} THEN _log - pmod(_log - {GPS_EPOCH_S * 1_000_000} - _sus, {span}) END AS _alone"])
    every = [*_week_readings("_wus", "_w"), _reading("_alone"), _reading(f"_alone + {span}")]
    for i in range(len(texts)):
        p = f"_x{i}_"
        every += [
            _reading(f"{p}civil", f"{p}clk", f"{p}off", f"{p}extra"), _reading(f"{p}swap", f"{p}clk", f"{p}off", f"{p}extra"),
            _reading(f"{p}count", "'UTC'", "0L"), _reading(f"{p}count + {GPS_EPOCH_S * 1_000_000}"),
            _reading(f"CAST(round(({p}mjd - {MJD_UNIX}) * {DAY_US}) AS BIGINT)"), _reading(f"CAST(round(({p}mjd - 25569) * {DAY_US}) AS BIGINT)"),
            *_week_readings(f"{p}wus", f"{p}w"),
        ]
    for stage in stages:
        out = out.selectExpr("*", *stage)
    return out.selectExpr("_id", "_feed", "_log", f"filter(array({', '.join(every)}), r -> r.civil IS NOT NULL AND r.clk IS NOT NULL) AS _r")


def lag_counts(read: DataFrame, leaps: Sequence[tuple[int, int]], zones: Sequence[str], max_delay_s: int) -> DataFrame:
    """(feed, day, lags, gpst, offsets) per feed and civil day: counts of ingestion minus civil time in quarter hours, of the records that
    GPST fits, and the quarter hours each zone is ahead of UTC (null where its offset changes about that day)."""
    limit = max_delay_s * 1_000_000
    # a notation's wrong readings are weeks off for every zone and say nothing of it
    near = F.filter("_r", lambda r: (r["clk"] == "FEED") & (F.abs(F.col("_log") - r["civil"]) < limit + 2 * DAY_US))
    one = read.select("_feed", "_log", F.explode(near).alias("r")).select("_feed", F.col("r.civil").alias("civil"), (F.col("_log") - F.col("r.civil")).alias("lag"))
    in_gpst = (F.col("lag") + F.col("civil") - gpst_to_utc(F.col("civil"), leaps)).between(0, limit)
    day = F.floor(F.col("civil") / DAY_US).cast("int").alias("day")
    counts = one.groupBy("_feed", day, F.floor(F.col("lag") / STEP_US).cast("int").alias("b")).agg(F.count("*").alias("n"), F.sum(in_gpst.cast("long")).alias("g"))
    days = counts.groupBy("_feed", "day").agg(F.collect_list(F.struct("b", "n")).alias("lags"), F.sum("g").alias("gpst"))

    def ahead(zone: str) -> str:
        u = (f"(day * {DAY_US} - 50400000000)", f"(day * {DAY_US} + 136800000000)")
        before, after = (f"(unix_micros(from_utc_timestamp(timestamp_micros({x}), '{zone}')) - {x})" for x in u)
        return f"CASE WHEN {before} = {after} THEN CAST(floor({before} / {STEP_US}) AS INT) END"

    calendar = days.select("day").distinct().selectExpr("day AS d", f"array({', '.join(map(ahead, zones))}) AS offsets")
    return days.join(sized(calendar, 100_000), F.col("day") == F.col("d")).select(F.col("_feed").alias("feed"), "day", "lags", "gpst", "offsets")


def best_history(cost: np.ndarray, switch: float) -> np.ndarray:
    """The candidate of each row with the least sum of costs, a change from row to row costing ``switch``; the first candidate wins a tie."""
    n, k = cost.shape
    total, came = cost[0].copy(), np.zeros((n, k), dtype=np.int32)
    for i in range(1, n):
        j = int(np.argmin(total))
        stay = total <= total[j] + switch
        came[i] = np.where(stay, np.arange(k), j)
        total = np.where(stay, total, total[j] + switch) + cost[i]
    out = np.zeros(n, dtype=np.int32)
    out[-1] = int(np.argmin(total))
    for i in range(n - 1, 0, -1):
        out[i - 1] = came[i, out[i]]
    return out


def estimate_offset_history(
    read: DataFrame, leaps: Sequence[tuple[int, int]], told: DataFrame | None = None, zones: Sequence[str] = ZONES, max_delay_s: int = 72 * 3600, switch: float = 12.0, trust: float = 0.15
) -> DataFrame:
    """(feed, since_us, zone, n, violations): per feed the stretches of its offset history, each from civil time since_us on.

    A violation is a civil time that, taken in the zone, lies after its ingestion or more than max_delay_s before it. The history with the
    least sum of violations, 0.003 of each hour of delay and ``switch`` for each change of zone is taken; the clock ``told`` (feed, zone)
    has an advantage of five violations and the share ``trust`` of the records, more than a delay of two days weighs. zone is a zone's name, an offset like +05:30, UTC or GPST. Feeds
    without a civil time near its ingestion get none. Partial aggregates only: a feed may hold any share of the rows.
    """
    named = [z for z in zones if z != "GPST"]
    counts = lag_counts(read, leaps, named, max_delay_s)
    counts = counts.withColumn("told", F.lit(None).cast("string")) if told is None else counts.join(sized(told.select("feed", F.col("zone").alias("told"))), "feed", "left")
    fixed = [f"{'-' if q < 0 else '+'}{abs(q) // 4:02d}:{abs(q) % 4 * 15:02d}" for q in OFFSETS]
    names = [*named, "GPST", *fixed]
    top, half = max_delay_s * 1_000_000 // STEP_US, (max_delay_s * 1_000_000 + 2 * DAY_US) // STEP_US + 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        n = len(pdf)
        hist = np.zeros((n, 2 * half + 1))
        for i, lags in enumerate(pdf["lags"]):
            for x in lags:
                hist[i, x["b"] + half] += x["n"]
        zero = np.zeros((n, 1))
        count, hours = np.hstack([zero, hist.cumsum(1)]), np.hstack([zero, (hist * (np.arange(-half, half + 1) + 0.5)).cumsum(1)])
        all_ = hist.sum(1)
        ahead = np.array([[np.nan if q is None else q for q in o] for o in pdf["offsets"]], dtype=float).reshape(n, len(named))
        utc = np.zeros((n, 1))
        ahead = np.hstack([ahead, utc, np.tile(np.array(OFFSETS, dtype=float), (n, 1))])
        known = ~np.isnan(ahead)
        q = np.where(known, ahead, 0).astype(int)
        lo, hi = np.clip(half - q, 0, 2 * half + 1), np.clip(half - q + top, 0, 2 * half + 1)
        row = np.arange(n)[:, None]
        fits = count[row, hi] - count[row, lo]
        delay = (hours[row, hi] - hours[row, lo] + fits * q) / 4
        gpst = len(named)
        fits[:, gpst] = pdf["gpst"]
        # seconds of delay decide between GPST and UTC, whose lags fall into the same steps
        delay[:, gpst] += fits[:, gpst] * 18 / 3600
        bad = np.where(known, all_[:, None] - fits, 0.0)
        cost = bad + np.where(known, 0.003 * delay, 0.0)
        cost[0, gpst + 1 :] += 0.5
        t = pdf["told"].iloc[0]
        if t in names:
            cost[:, names.index(t)] -= trust * all_
            cost[0, names.index(t)] -= 5
        chosen = best_history(cost, switch)
        starts = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        ends = np.append(starts[1:], n)
        days = pdf["day"].to_numpy()
        return pd.DataFrame({
            "feed": pdf["feed"].iloc[0], "since_us": [int(days[a]) * DAY_US for a in starts], "zone": [names[chosen[a]] for a in starts],
            "n": [int(all_[a:b].sum()) for a, b in zip(starts, ends, strict=True)], "violations": [int(bad[a:b, chosen[a]].sum()) for a, b in zip(starts, ends, strict=True)],
        })

    ft = counts.schema["feed"].dataType.simpleString()
    return counts.groupBy("feed").applyInPandas(run, schema=f"feed {ft}, since_us bigint, zone string, n bigint, violations bigint")


def normalise_times(
    df: DataFrame,
    clocks: DataFrame,
    leaps: DataFrame,
    id_col: str = "rec_id",
    feed: str = "feed",
    week: str = "gpswk",
    tow: str = "seconds",
    texts: Sequence[str] = ("Time", "ReferenceTimeGPST"),
    logged: str = "logged_at",
    max_delay_s: int = 72 * 3600,
    zones: Sequence[str] = ZONES,
) -> DataFrame:
    """(id, feed, gpst_us, status): every record's instant on GPST.

    status: 'resolved' (exactly one possible instant), 'ambiguous' (several, or a civil time that occurs twice),
    'void' (none). The clock of each feed's civil times is the offset history estimated from all its records (see
    estimate_offset_history); ``clocks`` (feed, clock, zone) only gives a candidate an advantage, so a feed it does not name, or names with a null or LOCAL without a
    zone, is estimated alike. Seconds without a week are of the one week that fits the ingestion. Null or empty fields, unknown words beside a time, civil times that never occur
    and records without logged_at are void. Repeated records are each resolved; they also count each in the estimate. Empty tables give no rows.
    """
    lp = leap_rows(leaps)
    read = checkpointed(readings(df, id_col, week, tow, texts, feed, logged))
    told = clocks.select(F.col("feed"), F.when(F.col("clock").isin("GPST", "UTC"), F.col("clock")).when(F.col("clock") == "LOCAL", F.col("zone")).alias("zone"))
    told = told.where("zone IS NOT NULL").groupBy("feed").agg(F.min("zone").alias("zone"))
    # zones told of feeds are candidates of all; a clock table has at most as many as the world has zones
    tried = list(dict.fromkeys([*zones, "UTC", *(r.zone for r in told.select("zone").distinct().orderBy("zone").limit(1000).collect())]))
    history = checkpointed(estimate_offset_history(read, lp, told, tried, max_delay_s))
    history = history.groupBy(F.col("feed").alias("_feed")).agg(F.array_sort(F.collect_list(F.struct("since_us", "zone"))).alias("_c"))
    known = read.join(sized(history), "_feed", "left")
    none = F.array().cast("array<long>")

    def clocked(r: Column) -> Column:
        """The reading with its clock, and with its zone's offsets a day before and after where the clock is a zone."""
        since = F.filter("_c", lambda h: h["since_us"] <= r["civil"])
        zone = F.when(r["off"].isNull() & (r["clk"] == "FEED"), F.coalesce(F.try_element_at(since, F.lit(-1)), F.get("_c", 0))["zone"])
        return F.struct(r["civil"].alias("civil"), r["extra"].alias("extra"), r["clk"].alias("clk"), r["off"].alias("off"), zone.alias("zone"))

    def placed(r: Column) -> Column:
        """The offsets of the reading's zone a day before and after."""
        clk = F.when(r["off"].isNotNull(), "UTC").when(r["clk"] != "FEED", r["clk"]).when(r["zone"] == "GPST", "GPST").when(r["zone"] == "UTC", "UTC").otherwise("LOCAL")
        at = F.when(clk == "LOCAL", r["civil"])
        return F.struct(
            r["civil"].alias("civil"), r["extra"].alias("extra"), clk.alias("clk"), F.coalesce(r["off"], F.lit(0)).alias("off"), r["zone"].alias("zone"),
            zone_offset(at - DAY_US, r["zone"]).alias("before"), zone_offset(at + DAY_US, r["zone"]).alias("after"),
        )

    def instants(r: Column) -> Column:
        """UTC instants of a reading (two in a fold, none in a gap)."""
        one, two = r["civil"] - r["before"], r["civil"] - r["after"]
        folded = F.filter(F.array(one, two), lambda u: zone_offset(u, r["zone"]) == r["civil"] - u)
        u = (
            F.when(r["clk"] == "UTC", F.array(r["civil"] - r["off"]))
            .when(r["clk"] == "GPST", F.array(gpst_to_utc(r["civil"], lp)))
            .when(r["before"] == r["after"], F.array(one))
            .when(r["before"].isNotNull(), folded)
            .otherwise(none)
        )
        return F.struct(r["civil"].alias("civil"), r["extra"].alias("extra"), r["clk"].alias("clk"), u.alias("u"))

    def judged(r: Column) -> Column:
        """The reading's GPST where it fits the ingestion time, and whether its civil time occurs twice."""
        fit = F.filter(r["u"], lambda u: (u <= F.col("_log")) & (u >= F.col("_log") - max_delay_s * 1_000_000))
        g = F.when(r["clk"] == "GPST", r["civil"]).otherwise(utc_to_gpst(F.get(fit, 0), lp)) + r["extra"]
        return F.struct(F.when(F.size(fit) > 0, g).alias("g"), (F.size(r["u"]) > 1).alias("fold"))

    known = known.select("_id", "_feed", "_log", F.transform(F.transform(F.transform("_r", clocked), placed), instants).alias("_r"))
    fits = F.filter(F.transform("_r", judged), lambda h: h["g"].isNotNull())
    done = known.select("_id", "_feed", fits.alias("_h")).select(
        "_id", "_feed", F.array_min(F.transform("_h", lambda h: h["g"])).alias("_lo"), F.array_max(F.transform("_h", lambda h: h["g"])).alias("_hi"),
        F.exists("_h", lambda h: h["fold"]).alias("_f"),
    )
    status = F.when(F.col("_lo").isNull(), "void").when(F.col("_f") | (F.col("_lo") != F.col("_hi")), "ambiguous").otherwise("resolved")
    return done.select(F.col("_id").alias(id_col), F.col("_feed").alias(feed), F.when(status == "resolved", F.col("_lo")).alias("gpst_us"), status.alias("status"))
