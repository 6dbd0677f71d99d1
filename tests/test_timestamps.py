from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from orrery.operators.timestamps import normalise_times

SCHEMA = "rec_id long, feed string, gpswk int, seconds double, Time string, ReferenceTimeGPST string, logged_at timestamp_ntz, civil string"
CLOCKS = [("g", "GPST", None), ("u", "UTC", None), ("b", "LOCAL", "Europe/Berlin"), ("n", "LOCAL", "America/New_York")]
LEAPS = [(datetime(2009, 1, 1), 15), (datetime(2012, 7, 1), 16), (datetime(2015, 7, 1), 17), (datetime(2017, 1, 1), 18)]


def run(spark, data, clocks=CLOCKS):
    df = spark.createDataFrame(data, SCHEMA)
    c = spark.createDataFrame(clocks, "feed string, clock string, zone string")
    lp = spark.createDataFrame(LEAPS, "utc_from timestamp_ntz, gpst_minus_utc int")
    out = normalise_times(df, c, lp).select("rec_id", "status", "gpst_us").collect()
    return {r.rec_id: (r.status, None if r.gpst_us is None else datetime(1970, 1, 1) + timedelta(microseconds=r.gpst_us)) for r in out}


GPST = datetime(2019, 1, 8, 13, 35, 24, 410000)
UTCT = GPST - timedelta(seconds=18)
LOG = UTCT + timedelta(minutes=5)


NOTATIONS = [
        ("g", 2035, 221724.41, None), ("g", 2035 - 1024, 221724.41, None), ("g", 2034, 826524.41, None), ("g", 2036, -383075.59, None), ("g", 2035, 221724410.0, None),
        ("g", None, None, "2019-01-08 13:35:24.410"), ("g", None, None, "\t2019-01-08T13:35:24.41  "), ("g", None, None, "2019/01/08 13:35:24.410000000"), ("g", None, None, "2019-008T13:35:24.41"),
        ("g", None, None, "2019  1  8 13 35 24.4100000"), ("g", None, None, "wk 2035 tow 221724.410"), ("g", None, None, "1011:221724.41"), ("g", None, None, "2035 221724.41"), ("g", None, None, "1230989724.41"),
        ("u", None, None, "1546954506410"), ("u", None, None, "1546954506410000"), ("u", None, None, "20190108T133506.41"), ("u", None, None, "20190108133506.41"), ("u", None, None, "Jan 8, 2019 13:35:06.41"),
        ("u", None, None, "2019-01-08 13:35:24.41 (GPS time)"), ("g", None, None, "2019-01-08 13:35:06.41Z"), ("g", None, None, "2019-01-08 13:35:06.41 (UTC)"), ("u", None, None, "2019-01-08T13:35:24.41GPST"),
        ("b", None, None, "08.01.2019 14:35:06.41"), ("b", None, None, "2019-01-08 14:35:06.41 CET"), ("b", None, None, "2019-01-08T08:35:06.41-0500"), ("b", None, None, "2019-01-08T19:20:06.41 UTC+5:45"),
        ("b", None, None, "2019-01-08T10:05:06.41 -03:30"), ("b", None, None, "2019-01-08 15:35:06.41+02"), ("n", None, None, "1/8/2019 8:35:06.41 AM"), ("n", None, None, "08-JAN-19 08:35:06.41"), ("b", None, None, "08/01/2019 14:35:06.41"),
    ]


def test_notations(spark):
    data = [(2 * k + f, feed, week, sec, None if f else text, text if f else None, LOG, "x") for k, (feed, week, sec, text) in enumerate(NOTATIONS) for f in (0, 1)]
    got = run(spark, data)
    assert {k: v for k, v in got.items() if v != ("resolved", GPST)} == {} and len(got) == len(data)


def test_mjd_and_sheet_days(spark):
    got = run(spark, [(1, "g", None, None, "58491.5662547454", None, LOG, ""), (2, "u", None, None, "43473.5660463", None, LOG, "")])
    assert got[1][0] == "resolved" and abs((got[1][1] - GPST).total_seconds()) < 0.001
    assert got[2][0] == "resolved" and abs((got[2][1] - GPST).total_seconds()) < 0.01


def test_yy_doy_sod(spark):
    got = run(spark, [(1, "g", None, None, "19:008:48924", None, LOG, "")])
    assert got[1] == ("resolved", GPST.replace(microsecond=0))


VOID = ["", "   ", "no time", "NaN", "-", "2019-02-30 01:00:00", "2019-13-32T01:00:00", "25:61:00", "0000-00-00 00:00:00.00", "13:35:24.41", "2019-01-08 25:61:00", "2019-01-08 13:35:06 XYZ"]


def test_void(spark):
    got = run(spark, [(k, "g", None, None, t, None, LOG, "") for k, t in enumerate(VOID)])
    assert set(got.values()) == {("void", None)} and len(got) == len(VOID)


def test_incomplete_weeks_and_nulls(spark):
    data = [(1, "g", None, 250_000.0, None, None, LOG, ""), (2, "g", 2035, None, None, None, LOG, ""), (3, "g", 2035, float("nan"), None, None, LOG, ""), (4, "g", -1, 5.0, None, None, LOG, ""), (5, None, None, None, "2019-01-08 13:35:24", None, LOG, ""), (6, "g", 2035, 221724.41, None, None, None, "")]
    assert {s for s, _ in run(spark, data).values()} == {"void"}
    # seconds alone: the one week that fits the ingestion, also past either end and in milliseconds
    data = [(k, "g", None, x, None, None, LOG, "") for k, x in enumerate([221724.41, 826524.41, -383075.59, 221724410.0])]
    assert set(run(spark, data).values()) == {("resolved", GPST)}


def test_fold_and_gap(spark):
    fold, gap = "2018-10-28 02:30:00", "2018-03-25 02:30:00"
    data = [(1, "b", None, None, fold, None, datetime(2018, 10, 28, 5), ""), (2, "b", None, None, gap, None, datetime(2018, 3, 25, 5), ""), (3, "b", None, None, fold + " CEST", None, datetime(2018, 10, 28, 5), ""), (4, "b", None, None, "2018-10-28 03:30:00", None, datetime(2018, 10, 28, 5), "")]
    got = run(spark, data)
    assert got[1][0] == "ambiguous" and got[2][0] == "void" and got[3] == ("resolved", datetime(2018, 10, 28, 0, 30, 18)) and got[4] == ("resolved", datetime(2018, 10, 28, 2, 30, 18))


def test_day_and_month_settled_by_the_log(spark):
    got = run(spark, [(1, "u", None, None, "03/04/2018 10:00:00", None, datetime(2018, 4, 3, 11), ""), (2, "u", None, None, "03/04/2018 10:00:00", None, datetime(2018, 3, 4, 11), ""), (3, "u", None, None, "03/04/2018 10:00:00", None, datetime(2018, 6, 4, 11), "")])
    assert got[1] == ("resolved", datetime(2018, 4, 3, 10, 0, 18)) and got[2] == ("resolved", datetime(2018, 3, 4, 10, 0, 18)) and got[3][0] == "void"


def test_inserted_second(spark):
    got = run(spark, [(1, "u", None, None, "2016-12-31 23:59:60.5", None, datetime(2017, 1, 1, 1), "")])
    assert got[1] == ("resolved", datetime(2017, 1, 1, 0, 0, 17, 500000))


def test_unknown_clock_is_estimated(spark):
    zone = ZoneInfo("Australia/Adelaide")
    data = []
    for i in range(200):
        utc = datetime(2018, 1, 1, tzinfo=UTC) + timedelta(days=2 * i, minutes=37 * i)
        local = utc.astimezone(zone)
        delay = [20, 90, 400, 90_000][i % 4]
        data.append((i, "x", None, None, local.strftime("%Y-%m-%d %H:%M:%S"), None, utc.replace(tzinfo=None) + timedelta(seconds=delay), ""))
    got = run(spark, data)
    folds = sum(s == "ambiguous" for s, _ in got.values())
    right = sum(t == datetime(2018, 1, 1) + timedelta(days=2 * i, minutes=37 * i, seconds=18) for i, (_, t) in got.items())
    assert right + folds == 200 and folds <= 2


def test_empty(spark):
    assert run(spark, []) == {}


def test_no_shuffle_of_the_records(spark, base):
    t = normalise_times(spark.read.parquet(f"{base}/epoch_stamp.parquet"), spark.read.parquet(f"{base}/feed_clock.parquet"), spark.read.parquet(f"{base}/leap_second.parquet"))
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert t.where(F.col("status") == "resolved").count() > 150


def feed_of(zone_at, n=800):
    """Records every second day, logged 20 s to 25 h later, on the civil time of zone_at(i)."""
    data, want = [], {}
    for i in range(n):
        utc = datetime(2018, 1, 1, tzinfo=UTC) + timedelta(hours=9 * i, minutes=7 * i)
        local = utc.astimezone(ZoneInfo(zone_at(i)))
        data.append((i, "x", None, None, local.strftime("%Y-%m-%d %H:%M:%S"), None, utc.replace(tzinfo=None) + timedelta(seconds=[20, 90, 400, 90_000][i % 4]), ""))
        want[i] = utc.replace(tzinfo=None) + timedelta(seconds=18)
    return data, want


def test_a_feed_that_moves(spark):
    """Half the records from Tokyo, half from Denver: the history has both, and nearly every record its right instant."""
    data, want = feed_of(lambda i: "Asia/Tokyo" if i < 400 else "America/Denver")
    got = run(spark, data)
    assert sum(got[i][1] == want[i] for i in want) >= 790


def test_a_clock_told_wrongly_yields(spark):
    """The clock told is Berlin, the records are of Yangon, which is no candidate by name: its fixed offset is found."""
    data, want = feed_of(lambda i: "Asia/Yangon")
    got = run(spark, data, [("x", "LOCAL", "Europe/Berlin")])
    assert sum(got[i][1] == want[i] for i in want) == 800
