"""Format round trips over whole tables: rows to lines and back, rows to frames and back. Their SQL reads the table itself."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import functions as F

from orrery.functions import geo as G
from orrery.plans.util import r6
from orrery.session import micros, shared_dir, table
from orrery.sources import binary as B
from orrery.sources import files as X
from orrery.sources import text as T
from orrery.sources import writers as W

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""SELECT iter, epoch_us(datetime) AS us, meas, sat, recv, sig, round(prefit, 6) + 0.0 AS prefit, round(postfit, 6) + 0.0 AS postfit, label FROM residual""")
def trace_round_trip(spark, base):
    p = T.trace(W.trace_lines(table(spark, base, "residual"), F.lit("all")))
    return p.select("iter", micros("datetime").alias("us"), "meas", "sat", "recv", "sig", (F.round("prefit", 6) + 0.0).alias("prefit"), (F.round("postfit", 6) + 0.0).alias("postfit"), "label")


_POK = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ("dN", "dE", "dU"))


@query(f"""SELECT epoch_us("Time") AS us, round(dN, 4) + 0.0 AS dN, round(dE, 4) + 0.0 AS dE, round(dU, 4) + 0.0 AS dU FROM pos_solution WHERE {_POK}""")
def position_round_trip(spark, base):
    p = T.positions(W.position_lines(table(spark, base, "pos_solution").where(_POK), F.col("site")))
    return p.select(micros("Time").alias("us"), *[(F.round(c, 4) + 0.0).alias(c) for c in ("dN", "dE", "dU")])


@query("""SELECT CASE WHEN value > 100 THEN 'STATE' ELSE 'MEAS' END AS kind, count(*) AS n FROM events GROUP BY 1""")
def large_error_lines(spark, base):
    e = table(spark, base, "events")
    meas = F.format_string("LARGE MEAS  ERROR OF : %.3f AT %d : CODE_MEAS G%02d RC%02d L1C", F.abs("value"), F.col("event_id").cast("int"), (F.col("user_id") % 32).cast("int"), (F.col("user_id") % 50).cast("int"))
    state = F.format_string("LARGE STATE ERROR OF : %.3f AT %d : TROP RC%02d 0", F.abs("value"), F.col("event_id").cast("int"), (F.col("user_id") % 50).cast("int"))
    v = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("  "), F.when(F.col("value") > 100, state).otherwise(meas))
    return T.large_errors(e.select(v.alias("value"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN user_id % 2 = 0 THEN 'KF' ELSE NULL END AS reason, count(*) AS n FROM events WHERE user_id % 2 = 0 GROUP BY 1 UNION ALL SELECT 'GF', count(*) FROM events UNION ALL SELECT 'SCDIA', count(*) FROM events WHERE user_id % 3 = 0""")
def reason_explode(spark, base):
    """Reset lines to reasons, one row each, counted."""
    e = table(spark, base, "events")
    act = F.when(F.col("user_id") % 2 == 0, " REJECT").otherwise("PREPROC")
    tail = F.concat(F.lit("  - GF  - GF"), F.when(F.col("user_id") % 3 == 0, "  - SCDIA").otherwise(""))
    v = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSS"), F.lit("  Ambiguity Removed      - "), act, F.lit("  AMBIGUITY  E11  ALIC  L1C"), tail)
    r = T.ambiguity_resets(e.select(v.alias("value")))
    return r.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def _orbit(spark, base):
    """Made-up orbits at the receivers' epochs: every satellite once per quarter hour."""
    r = table(spark, base, "residual").select("sat", F.timestamp_micros(F.floor(micros("datetime") / 900_000_000) * 900_000_000).alias("epoch")).distinct()
    a = (F.substring("sat", 2, 2).cast("double") * 0.2 + micros("epoch") % 43_200_000_000 / 43_200e6 * 6.283185307)
    return r.select("sat", "epoch", F.round(2.6e7 * F.cos(a), 3).alias("x"), F.round(2.6e7 * F.sin(a), 3).alias("y"), F.round(1.0e6 * F.cos(a * 2), 3).alias("z"), F.round(1e-5 * F.sin(a), 12).alias("clk"))


@query("""SELECT sat, count(*) AS n FROM (SELECT DISTINCT sat, floor(epoch_us(datetime) / 900000000.0) AS e FROM residual) GROUP BY 1""")
def sp3_round_trip(spark, base):
    """Orbits to SP3 files, one a day, written to the shared folder and read back by the data source; rows per satellite that came back whole."""
    X.register(spark)
    o = _orbit(spark, base)
    path = f"{shared_dir(spark)}/sp3-{zlib.crc32(base.encode())}"
    W.write_lines(W.sp3_lines(o, F.date_format("epoch", "yyyyDDD")), path)
    back = spark.read.format("gnss").option("kind", "sp3").load(path)
    near = o.join(back.select("sat", "epoch", F.col("x").alias("bx"), F.col("clk").alias("bc")), ["sat", "epoch"]).where((F.abs(F.col("x") - F.col("bx")) < 1e-2) & (F.abs(F.col("clk") - F.col("bc")) < 1e-11))
    return near.groupBy("sat").agg(F.count("*").alias("n"))


@query("""SELECT sat AS id, count(*) AS n FROM (SELECT DISTINCT sat, floor(epoch_us(datetime) / 900000000.0) AS e FROM residual) GROUP BY 1""")
def clock_round_trip(spark, base):
    o = _orbit(spark, base).select(F.col("sat").alias("id"), "epoch", "clk", F.lit(1e-11).alias("clk_std"))
    path = f"{shared_dir(spark)}/clock-{zlib.crc32(base.encode())}"
    W.write_lines(W.clock_lines(o, F.date_format("epoch", "yyyyDDD")), path)
    back = T.rinex_clock(spark.read.text(path))
    near = o.join(back.select("id", F.col("epoch"), F.col("clk").alias("b")), ["id", "epoch"]).where(F.abs(F.col("clk") - F.col("b")) < 1e-15)
    return near.groupBy("id").agg(F.count("*").alias("n"))


@query("""SELECT 'G' || lpad(CAST(l_suppkey % 32 + 1 AS VARCHAR), 2, '0') AS prn, 'C' || l_linenumber || 'C' AS cod1, round(max_by(l_tax, l_shipdate) + 1e-9, 4) AS bias FROM
(SELECT l_suppkey % 32 AS l_suppkey, l_linenumber, l_shipdate, max(l_tax) AS l_tax FROM lineitem GROUP BY ALL) GROUP BY 1, 2""")
def bias_round_trip(spark, base):
    """The newest bias of each satellite and code, through bias lines."""
    l = table(spark, base, "lineitem").groupBy((F.col("l_suppkey") % 32).alias("s"), "l_linenumber", "l_shipdate").agg(F.max("l_tax").alias("bias"))
    b = l.select(F.lit("OSB").alias("kind"), F.format_string("G%03d", (F.col("s") + 1).cast("int")).alias("svn"), F.format_string("G%02d", (F.col("s") + 1).cast("int")).alias("prn"), F.lit("").alias("site"), F.concat(F.lit("C"), "l_linenumber", F.lit("C")).alias("cod1"), F.lit("").alias("cod2"), F.col("l_shipdate").alias("tini"), F.lit(None).cast("timestamp").alias("tfin"), "bias", F.lit(0.01).alias("std"))
    return T.bias_sinex(W.bias_lines(b, F.lit("all"))).select("prn", "cod1", (F.round(F.col("bias") + 1e-9, 4) + 0.0).alias("bias"))


@query("""SELECT round(epoch_us(d) / 864e8 + 40587, 2) AS mjd, round(v + 1e-9, 6) AS xp FROM (SELECT date_trunc('day', ts) AS d, count(*) / 1e5 AS v FROM events GROUP BY 1)""")
def erp_round_trip(spark, base):
    e = table(spark, base, "events").groupBy(F.floor(micros("ts") / 86_400_000_000).alias("d")).agg((F.count("*") / 1e5).alias("xp"))
    x = e.select((F.col("d") + 40587).cast("double").alias("mjd"), "xp", (F.col("xp") / 2).alias("yp"), F.lit(-0.1234567).alias("ut1_utc"), F.lit(0.0012).alias("lod"))
    return T.erp(W.erp_lines(x, F.lit("all"))).select("mjd", r6("xp").alias("xp"))


@query("""SELECT 'G' || lpad(CAST(user_id % 32 + 1 AS VARCHAR), 2, '0') AS sat, count(*) AS n FROM events GROUP BY 1""")
def msm_round_trip(spark, base):
    """Events as pseudoranges in MSM7 frames, decoded again; cells within a millimetre."""
    e = table(spark, base, "events").select("event_id", "user_id", (2.2e7 + F.col("value") * 10).alias("P"))

    def frames(batches):
        for pdf in batches:
            yield pd.DataFrame({"data": [B.encode_msm7("G", 7, int(i) % 604_800_000, [(int(u) % 32 + 1, 2, p, p + 0.25, 100.5, 5, 45.0)]) for i, u, p in zip(pdf.event_id, pdf.user_id, pdf.P, strict=True)], "want": pdf.P})

    raw = e.mapInPandas(frames, schema="data binary, want double")
    back = B.msm_observations(raw.select("data"))
    return back.where((F.col("code") == "1C") & (F.abs(F.col("L") - F.col("P") - 0.25) < 1e-3) & (F.abs(F.col("D") - 100.5) < 1e-3)).groupBy("sat").agg(F.count("*").alias("n"))


@query("""SELECT CAST(1005 AS INTEGER) AS number, count(*) AS frames FROM station""")
def station_messages(spark, base):
    s = table(spark, base, "station")
    x, y, z = G.geodetic_to_ecef(F.radians("Latitude"), F.radians("Longitude"), F.col("Elevation"))
    p = s.select(F.pmod(F.xxhash64("site"), F.lit(4096)).cast("int").alias("id"), x.alias("x"), y.alias("y"), z.alias("z"))

    def frames(batches):
        for pdf in batches:
            yield pd.DataFrame({"data": [B.encode_station(int(i), a, b, c) for i, a, b, c in zip(pdf.id, pdf.x, pdf.y, pdf.z, strict=True)]})

    return B.message_counts(p.mapInPandas(frames, schema="data binary")).select("number", "frames")


@query("""SELECT site, count(*) AS points FROM pos_solution GROUP BY 1""")
def gpx_track(spark, base):
    lines = W.gpx_lines(table(spark, base, "pos_solution"), F.col("site"))
    return lines.where(F.col("value").startswith("<trkpt")).groupBy(F.col("file").alias("site")).agg(F.count("*").alias("points"))


@query("""SELECT site, (315964800 + gpswk::BIGINT * 604800 + floor(seconds)::BIGINT) * 1000000 AS us, round(max(trop_value), 4) + 0.0 AS total FROM trop_pea WHERE trop_value IS NOT NULL GROUP BY 1, 2""")
def trop_sinex_round_trip(spark, base):
    p = table(spark, base, "trop_pea").where("trop_value IS NOT NULL")
    t = F.timestamp_seconds(F.lit(315_964_800) + F.col("gpswk").cast("long") * 604_800 + F.floor("seconds"))
    z = p.groupBy("site", t.alias("epoch")).agg(F.max("trop_value").alias("total")).withColumns({"std": F.lit(0.001), "grad_n": F.lit(None).cast("double"), "grad_e": F.lit(0.0)})
    return T.trop_sinex(W.trop_sinex_lines(z, F.col("site"))).select("site", F.unix_micros("epoch").alias("us"), (F.round("total", 4) + 0.0).alias("total"))


@query("""SELECT recv AS marker, count(*) AS n FROM (SELECT DISTINCT recv, sat, sig, datetime FROM residual WHERE meas = 'CODE_MEAS' AND prefit IS NOT NULL AND NOT isnan(prefit) AND abs(prefit) <= 1000) GROUP BY 1""")
def rinex_obs_round_trip(spark, base):
    """Code readings to observation files, one a receiver, written to the shared folder and read back; those that came back within a millimetre."""
    X.register(spark)
    r = table(spark, base, "residual").where("meas = 'CODE_MEAS' AND prefit IS NOT NULL AND NOT isnan(prefit) AND abs(prefit) <= 1000")
    o = r.groupBy("recv", F.col("datetime").alias("epoch"), "sat", F.regexp_replace("sig", "^L", "C").alias("code")).agg((F.max("prefit") + 2.2e7).alias("value")).withColumn("lli", F.lit(0))
    codes = {s: ["C1C", "C1P", "C2C", "C2W", "C2I", "C5Q", "C6I", "C7Q", "C7I"] for s in "GREC"}
    path = f"{shared_dir(spark)}/rinex-{zlib.crc32(base.encode())}"
    W.write_lines(W.rinex_obs_lines(o, F.col("recv"), codes), path)
    back = spark.read.format("gnss").option("kind", "rinex_obs").load(path).select(F.regexp_extract("file", "file=([^/]+)", 1).alias("recv"), "epoch", "sat", "code", F.col("value").alias("b"))
    near = o.withColumn("epoch", F.col("epoch").cast("timestamp")).join(back, ["recv", "epoch", "sat", "code"]).where(F.abs(F.col("value") - F.col("b")) < 1e-3)
    return near.groupBy(F.col("recv").alias("marker")).agg(F.count("*").alias("n"))
