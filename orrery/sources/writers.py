"""Text formats out: each function gives (file, seq, value), the lines of its files in order; write_lines puts them down.

Lines are built by column expressions. A file's lines are sorted within its partition, so files are written in parallel and none passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.geo import geodetic_to_ecef
from orrery.functions.ids import replace_times


def _stamp(t: Column, pattern: str) -> Column:
    return F.date_format(t.cast("timestamp"), pattern)


def _seconds(t: Column) -> Column:
    return F.second(t.cast("timestamp")) + F.pmod(F.unix_micros(t.cast("timestamp")), F.lit(1_000_000)) / 1e6


def trace_lines(df: DataFrame, file: Column) -> DataFrame:
    """Residual rows as '%' lines, one for each, with ratios where one is present. A null or empty text is written as '-', a null number as 'null'; text.trace reads both as null."""

    def word(c: str) -> Column:
        return F.when(F.col(c) != "", F.col(c)).otherwise("-")

    stamp = F.coalesce(_stamp(F.col("datetime"), "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("- -"))
    ratio = F.when(F.col("prefit_ratio").isNotNull() | F.col("postfit_ratio").isNotNull(), F.format_string(" %.6f %.6f", "prefit_ratio", "postfit_ratio")).otherwise("")
    v = F.concat(
        F.format_string("%% %d %s %s %s %s %s %.6f %.6f %.6f", F.col("iter").cast("int"), stamp, *[word(c) for c in ("meas", "sat", "recv", "sig")], F.col("prefit"), F.col("postfit"), F.col("sigma")),
        ratio, F.lit(" "), word("label"),
    )
    return df.select(file.alias("file"), F.struct("datetime", "recv", "sat", "sig", "meas", "iter").alias("seq"), v.alias("value"))


def position_lines(df: DataFrame, file: Column) -> DataFrame:
    """POS rows: 24 tokens, geocentric columns among them."""
    x, y, z = geodetic_to_ecef(F.radians("Latitude"), F.radians("Longitude"), F.col("Elevation"))
    v = F.format_string(
        "%s 0 0 0 %.4f %.4f %.4f 0 0 0 0 %.9f %.9f %.5f %.5f %.5f %.5f %.5f %.5f %.5f %.5f %.5f %.5f %s", _stamp(F.col("Time"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), x, y, z,
        *[F.col(c) for c in ("Latitude", "Longitude", "Elevation", "dN", "dE", "dU", "sN", "sE", "sU", "Rne", "Rnu", "Reu")], F.coalesce(F.col("soln"), F.lit("-")),
    )
    return df.select(file.alias("file"), F.struct("Time").alias("seq"), v.alias("value"))


def sp3_lines(df: DataFrame, file: Column) -> DataFrame:
    """(sat, epoch, x, y, z, clk) in metres and seconds as SP3 records with header, epoch lines and EOF."""
    e = F.col("epoch").cast("timestamp")
    base = df.select(file.alias("file"), e.alias("epoch"), "sat", "x", "y", "z", "clk")
    head_time = F.format_string("%4d %2d %2d %2d %2d %11.8f", F.year("t"), F.month("t"), F.dayofmonth("t"), F.hour("t"), F.minute("t"), _seconds(F.col("t")))
    head = base.groupBy("file").agg(F.min("epoch").alias("t"), F.countDistinct("epoch").alias("n")).select("file", F.struct(F.lit(0).alias("a"), F.col("t").alias("b"), F.lit("").alias("c")).alias("seq"), F.concat(F.lit("#dP"), head_time, F.format_string(" %7d", F.col("n"))).alias("value"))
    epochs = base.select("file", F.col("epoch").alias("t")).distinct().select("file", F.struct(F.lit(1).alias("a"), F.col("t").alias("b"), F.lit("").alias("c")).alias("seq"), F.concat(F.lit("*  "), head_time).alias("value"))
    row = F.format_string("P%s%14.6f%14.6f%14.6f%14.6f", F.col("sat"), F.coalesce(F.col("x"), F.lit(0.0)) / 1000, F.coalesce(F.col("y"), F.lit(0.0)) / 1000, F.coalesce(F.col("z"), F.lit(0.0)) / 1000, F.coalesce(F.col("clk") * 1e6, F.lit(999999.999999)))
    rows = base.select("file", F.struct(F.lit(1).alias("a"), F.col("epoch").alias("b"), F.col("sat").alias("c")).alias("seq"), row.alias("value"))
    last = base.groupBy("file").agg(F.max("epoch").alias("t")).select("file", F.struct(F.lit(2).alias("a"), F.col("t").alias("b"), F.lit("").alias("c")).alias("seq"), F.lit("EOF").alias("value"))
    return head.unionByName(epochs).unionByName(rows).unionByName(last)


def clock_lines(df: DataFrame, file: Column) -> DataFrame:
    """(id, epoch, clk, clk_std) as AS (satellites) and AR records."""
    t = F.col("epoch").cast("timestamp")
    kind = F.when(F.col("id").rlike(r"^[GRECJSI]\d{2}$"), "AS").otherwise("AR")
    v = F.format_string("%s %-4s %4d %02d %02d %02d %02d %9.6f %2d   %19.12E %19.12E", kind, F.col("id"), F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.minute(t), _seconds(t), F.lit(2), F.col("clk"), F.coalesce(F.col("clk_std"), F.lit(0.0)))
    return df.select(file.alias("file"), F.struct("epoch", "id").alias("seq"), v.alias("value"))


def bias_lines(df: DataFrame, file: Column) -> DataFrame:
    """The newest row per (prn, site, cod1, cod2) as OSB or DSB lines in nanoseconds."""
    key = ["kind", "svn", "prn", "site", "cod1", "cod2"]
    rest = ["tini", "tfin", "bias", "std"]
    x = df.groupBy(file.alias("file"), *key).agg(F.max_by(F.struct(*rest), F.col("tini")).alias("_r")).select("file", *key, "_r.*")

    def ydo(c: str) -> Column:
        t = F.col(c).cast("timestamp")
        sod = F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
        return F.when(F.col(c).isNull(), "0000:000:00000").otherwise(F.format_string("%04d:%03d:%05d", F.year(t), F.dayofyear(t), sod))

    v = F.format_string(" %-4s %-4s %-3s %-9s %-4s %-4s %s %s %-4s %21.5f %11.5f", *[F.col(c) for c in key], ydo("tini"), ydo("tfin"), F.lit("ns"), F.col("bias") / 0.299792458, F.coalesce(F.col("std"), F.lit(0.0)) / 0.299792458)
    return x.select("file", F.struct(*key).alias("seq"), v.alias("value"))


def erp_lines(df: DataFrame, file: Column) -> DataFrame:
    v = F.format_string("%8.2f %8d %8d %9d %8d", F.col("mjd"), F.round(F.col("xp") * 1e6).cast("long"), F.round(F.col("yp") * 1e6).cast("long"), F.round(F.col("ut1_utc") * 1e7).cast("long"), F.round(F.coalesce(F.col("lod"), F.lit(0.0)) * 1e7).cast("long"))
    return df.select(file.alias("file"), F.struct("mjd").alias("seq"), v.alias("value"))


def gpx_lines(df: DataFrame, file: Column) -> DataFrame:
    """A track of positions (Time, Latitude, Longitude, Elevation)."""
    v = F.format_string('<trkpt lat="%.9f" lon="%.9f"><ele>%.4f</ele><time>%s</time></trkpt>', F.col("Latitude"), F.col("Longitude"), F.col("Elevation"), _stamp(F.col("Time"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    points = df.select(file.alias("file"), F.struct(F.lit(1).alias("a"), F.col("Time").cast("timestamp").alias("b")).alias("seq"), v.alias("value"))
    files = points.select("file").distinct()

    def edge(k: int, text: str) -> DataFrame:
        return files.select("file", F.struct(F.lit(k).alias("a"), F.lit(None).cast("timestamp").alias("b")).alias("seq"), F.lit(text).alias("value"))

    return edge(0, '<gpx version="1.1" creator="orrery"><trk><trkseg>').unionByName(points).unionByName(edge(2, "</trkseg></trk></gpx>"))


def ionex_lines(df: DataFrame, file: Column) -> DataFrame:
    """One TEC map line per (epoch, lat): values along the longitude in tenths of a TECU."""
    g = df.groupBy(file.alias("file"), "epoch", "lat", "height").agg(F.array_sort(F.collect_list(F.struct("lon", "value"))).alias("_a"))
    vals = F.array_join(F.transform("_a", lambda s: F.format_string("%5d", F.coalesce(F.round(s["value"] * 10).cast("int"), F.lit(9999)))), "")
    lon1, lon2 = F.element_at("_a", 1)["lon"], F.element_at("_a", -1)["lon"]
    head = F.format_string("  %6.1f%6.1f%6.1f%6.1f%6.1f%28sLAT/LON1/LON2/DLON/H", F.col("lat"), lon1, lon2, (lon2 - lon1) / F.greatest(F.size("_a") - 1, F.lit(1)), F.col("height"), F.lit(""))
    both = F.explode(F.array(F.struct(F.lit(0).alias("k"), head.alias("value")), F.struct(F.lit(1).alias("k"), vals.alias("value"))))
    return g.select("file", "epoch", "lat", both.alias("_b")).select("file", F.struct("epoch", (-F.col("lat")).alias("lat"), F.col("_b.k").alias("k")).alias("seq"), F.col("_b.value").alias("value"))


def write_lines(lines: DataFrame, path: str, partitions: int | None = None) -> None:
    """Each file's lines in order, one folder a file. Files are hash-partitioned; a file is written by one task."""
    n = partitions or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartition(n, "file").sortWithinPartitions("file", "seq").select("file", "value").write.mode("overwrite").partitionBy("file").text(path)


def file_name(template: str, time: str, **ids: str) -> Column:
    """A file name column from a template with <RECEIVER>-like ids and time macros."""
    out = F.lit(template)
    for name, col in ids.items():
        out = F.replace(out, F.lit(f"<{name}>"), F.col(col))
    return replace_times(out, F.col(time))



def rinex_obs_lines(df: DataFrame, file: Column, codes: dict[str, list[str]]) -> DataFrame:
    """(epoch, sat, code, value, lli) as version 3 observation records; ``codes`` gives each system's columns."""
    t = F.col("epoch").cast("timestamp")
    base = df.select(file.alias("file"), t.alias("t"), "sat", "code", "value", "lli")
    per = base.groupBy("file", "t", "sat").agg(F.map_from_entries(F.collect_list(F.struct("code", F.struct("value", "lli")))).alias("_m"))

    def cell(code: Column) -> Column:
        v = F.try_element_at("_m", code)
        lli = F.when(F.coalesce(v["lli"], F.lit(0)) > 0, v["lli"].cast("string")).otherwise(" ")
        return F.when(v.isNull(), F.lit(" " * 16)).otherwise(F.concat(F.format_string("%14.3f", v["value"]), lli, F.lit(" ")))

    order = F.create_map(*[x for k, cs in codes.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in cs]))])
    per = per.withColumn("_c", F.try_element_at(order, F.substring("sat", 1, 1)))
    row = F.concat("sat", F.array_join(F.transform("_c", cell), ""))
    rows = per.select("file", F.struct("t", F.lit(1).alias("k"), "sat").alias("seq"), F.rtrim(row).alias("value")).where("value IS NOT NULL")
    stamp = F.format_string("> %4d %02d %02d %02d %02d%11.7f  0%3d", F.year("t"), F.month("t"), F.dayofmonth("t"), F.hour("t"), F.minute("t"), _seconds(F.col("t")), F.col("n"))
    epochs = per.groupBy("file", "t").agg(F.count("*").alias("n")).select("file", F.struct("t", F.lit(0).alias("k"), F.lit("").alias("sat")).alias("seq"), stamp.alias("value"))
    head = [f"{'     3.04           OBSERVATION DATA    M':60}RINEX VERSION / TYPE"] + [f"{s}  {len(cs):3d} {' '.join(cs)}".ljust(60) + "SYS / # / OBS TYPES" for s, cs in codes.items()] + ["".ljust(60) + "END OF HEADER"]
    files = per.select("file").distinct()
    top = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(h).alias("h")) for i, h in enumerate(head)]))
    heads = files.select("file", top.alias("_h")).select("file", F.struct(F.lit(None).cast("timestamp").alias("t"), F.col("_h.i").alias("k"), F.lit("").alias("sat")).alias("seq"), F.col("_h.h").alias("value"))
    return heads.unionByName(epochs).unionByName(rows)


def orbex_lines(df: DataFrame, file: Column) -> DataFrame:
    """(sat, epoch, q0..q3) as attitude records under their epochs."""
    t = F.col("epoch").cast("timestamp")
    base = df.select(file.alias("file"), t.alias("t"), "sat", *[f"q{k}" for k in range(4)])
    rows = base.select("file", F.struct("t", F.lit(1).alias("k"), "sat").alias("seq"), F.format_string(" ATT %-3s              4 %19.16f %19.16f %19.16f %19.16f", "sat", "q0", "q1", "q2", "q3").alias("value"))
    stamp = F.format_string("## %4d %02d %02d %02d %02d %15.12f %3d", F.year("t"), F.month("t"), F.dayofmonth("t"), F.hour("t"), F.minute("t"), _seconds(F.col("t")), F.col("n"))
    epochs = base.groupBy("file", "t").agg(F.count("*").alias("n")).select("file", F.struct("t", F.lit(0).alias("k"), F.lit("").alias("sat")).alias("seq"), stamp.alias("value"))
    heads = base.select("file").distinct().select("file", F.struct(F.lit(None).cast("timestamp").alias("t"), F.lit(0).alias("k"), F.lit("").alias("sat")).alias("seq"), F.lit("%=ORBEX  0.09").alias("value"))
    return heads.unionByName(epochs).unionByName(rows)


def _ydo(t: Column) -> Column:
    t = t.cast("timestamp")
    return F.format_string("%02d:%03d:%05d", F.year(t) % 100, F.dayofyear(t), F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t))


def sinex_lines(df: DataFrame, file: Column) -> DataFrame:
    """(param, site, soln, epoch, unit, estimate, std) as a SOLUTION/ESTIMATE block, numbered in order within its file."""
    w = Window.partitionBy("file").orderBy("site", "epoch", "param")
    x = df.select(file.alias("file"), "param", "site", "soln", "epoch", "unit", "estimate", "std").withColumn("_i", F.row_number().over(w))
    row = F.format_string(" %5d %-6s %-4s  A %4s %s %-4s 2 %21.14E %11.5E", F.col("_i"), F.col("param"), F.col("site"), F.col("soln"), _ydo(F.col("epoch")), F.col("unit"), F.col("estimate"), F.col("std"))
    rows = x.select("file", F.struct(F.lit(1).alias("a"), F.col("_i").alias("b")).alias("seq"), row.alias("value"))
    files = rows.select("file").distinct()

    def edge(a: int, b: int, text: str) -> DataFrame:
        return files.select("file", F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")).alias("seq"), F.lit(text).alias("value"))

    return edge(0, 0, "%=SNX 2.02").unionByName(edge(0, 1, "+SOLUTION/ESTIMATE")).unionByName(rows).unionByName(edge(2, 0, "-SOLUTION/ESTIMATE")).unionByName(edge(2, 1, "%ENDSNX"))


def trop_sinex_lines(df: DataFrame, file: Column) -> DataFrame:
    """(site, epoch, total, std, gradients n and e) in metres as a TROP/SOLUTION block in millimetres."""
    v = F.format_string(" %-9s %s %7.1f %6.1f %7.3f %7.3f", F.col("site"), _ydo(F.col("epoch")), F.col("total") * 1000, F.col("std") * 1000, F.coalesce(F.col("grad_n"), F.lit(0.0)) * 1000, F.coalesce(F.col("grad_e"), F.lit(0.0)) * 1000)
    rows = df.select(file.alias("file"), F.struct(F.lit(1).alias("a"), F.col("site").alias("b"), F.col("epoch").cast("timestamp").alias("c")).alias("seq"), v.alias("value"))
    files = rows.select("file").distinct()

    def edge(a: int, text: str) -> DataFrame:
        return files.select("file", F.struct(F.lit(a).alias("a"), F.lit("").alias("b"), F.lit(None).cast("timestamp").alias("c")).alias("seq"), F.lit(text).alias("value"))

    return edge(0, "+TROP/SOLUTION").unionByName(rows).unionByName(edge(2, "-TROP/SOLUTION"))


def nmea_lines(df: DataFrame, file: Column) -> DataFrame:
    """$POS lines of solutions (Time, Latitude, Longitude, Elevation) with the NMEA check sum of each."""
    body = F.format_string("POS,%s,%.9f,%.9f,%.4f", _stamp(F.col("Time"), "yyyyMMddHHmmss.SSS"), F.col("Latitude"), F.col("Longitude"), F.col("Elevation"))
    x = df.select(file.alias("file"), F.col("Time"), body.alias("b"))
    check = F.aggregate(F.transform(F.split("b", ""), lambda c: F.ascii(c)), F.lit(0), lambda a, c: a.bitwiseXOR(c))
    return x.select("file", F.struct("Time").alias("seq"), F.format_string("$%s*%02X", F.col("b"), check).alias("value"))
