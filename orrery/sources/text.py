"""Line formats as column expressions: any DataFrame with a string column ``value`` (spark.read.text) to typed rows.

A line that is not of the format is left out; a field that is no number is null. Files of any size split by line, as Spark reads text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.ids import fixed_number

# The forms of two kinds of trace lines.
_LARGE = r"^(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2}\.\d+)\s+LARGE\s+(STATE|MEAS)\s+ERROR\s+OF\s*:\s*([0-9.]+)\s+AT\s+\d+\s*:\s*(.*)$"
_RESET = r"^(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2}\.\d+)\s+Ambiguity Removed\s+-\s+(PREPROC|REJECT)\s+AMBIGUITY\s+(\S+)\s+(\S+)\s+(\S+)(.*)$"


def _stamp(date: Column, time: Column) -> Column:
    return F.concat(F.regexp_replace(date, "/", "-"), F.lit(" "), time).try_cast("timestamp_ntz")


def _double(c: Column) -> Column:
    return c.try_cast("double")


def trace(lines: DataFrame) -> DataFrame:
    """'%' residual lines of 12 fields, or 14 with ratios. '-' is a null text, what is no number a null number."""
    p = F.col("_p")

    def word(c: Column) -> Column:
        return F.when(c != "-", c)

    x = lines.where(F.col("value").startswith("%")).withColumn("_p", F.split(F.trim(F.col("value")), r"\s+")).where(F.size("_p") >= 12)
    long = F.size("_p") >= 14
    return x.select(
        p[1].try_cast("int").alias("iter"), _stamp(p[2], p[3]).alias("datetime"), *[word(p[i]).alias(c) for i, c in enumerate(("meas", "sat", "recv", "sig"), 4)],
        _double(p[8]).alias("prefit"), _double(p[9]).alias("postfit"), _double(p[10]).alias("sigma"),
        F.when(long, _double(F.get("_p", F.lit(11)))).alias("prefit_ratio"), F.when(long, _double(F.get("_p", F.lit(12)))).alias("postfit_ratio"),
        word(F.when(long, F.get("_p", F.lit(13))).otherwise(p[11])).alias("label"),
    )


def large_errors(lines: DataFrame) -> DataFrame:
    """'LARGE STATE|MEAS ERROR OF : value AT n : ...' lines."""
    head = _LARGE
    x = lines.where(F.col("value").rlike(head))
    g = [F.regexp_extract("value", head, i) for i in range(6)]
    x = x.select(_stamp(g[1], g[2]).alias("datetime"), g[3].alias("kind"), _double(g[4]).alias("value"), F.split(F.trim(g[5]), r"\s+").alias("_p"))
    meas = F.size("_p") >= 4

    def at(i: int) -> Column:
        return F.get("_p", F.lit(i))

    return x.where(F.size("_p") >= 3).select(
        "datetime", "kind", "value", F.when(meas, at(0)).alias("meas_type"), F.when(meas, at(1)).alias("sat"), F.when(meas, at(2)).otherwise(at(1)).alias("recv"),
        F.when(meas, at(3)).alias("sig"), F.when(~meas, at(0)).alias("param"), F.when(~meas, at(2)).alias("comp"),
    )


def ambiguity_resets(lines: DataFrame) -> DataFrame:
    """'Ambiguity Removed' lines with their reasons, each once and in order; a REJECT without KF gets it in front."""
    head = _RESET
    x = lines.where(F.col("value").rlike(head))
    g = [F.regexp_extract("value", head, i) for i in range(8)]
    parts = F.transform(F.split(g[7], "-"), lambda s: F.regexp_replace(F.trim(s), r"\s+", " "))
    clean = F.array_distinct(F.filter(parts, lambda s: (s != "") & ~F.upper(s).isin("PREPROC", "REJECT", "AMBIGUITY")))
    x = x.select(_stamp(g[1], g[2]).alias("datetime"), g[3].alias("action"), g[4].alias("sat"), g[5].alias("recv"), g[6].alias("sig"), clean.alias("_r"))
    kf = F.exists("_r", lambda s: F.upper(s) == "KF")
    return x.withColumn("reasons", F.when((F.col("action") == "REJECT") & ~kf, F.concat(F.array(F.lit("KF")), "_r")).otherwise(F.col("_r"))).drop("_r")


def positions(lines: DataFrame) -> DataFrame:
    """POS rows of at least 24 tokens that begin with an ISO time (header lines do not)."""
    x = lines.withColumn("_p", F.split(F.trim("value"), r"\s+")).where(F.size("_p") >= 24).withColumn("Time", F.col("_p")[0].try_cast("timestamp_ntz")).where("Time IS NOT NULL")
    names = ["Latitude", "Longitude", "Elevation", "dN", "dE", "dU", "sN", "sE", "sU"]
    p = F.col("_p")
    return x.select("Time", *[_double(p[11 + i]).alias(n) for i, n in enumerate(names)], _double(p[19]).alias("sElevation"), *[_double(p[20 + i]).alias(n) for i, n in enumerate(("Rne", "Rnu", "Reu"))], p[23].alias("soln"))


def single_points(lines: DataFrame) -> DataFrame:
    """SPP rows of at least 20 tokens."""
    at = {"HDOP": 5, "VDOP": 6, "GDOP": 7, "Nref": 11, "Eref": 12, "Href": 13, "dN": 14, "dE": 15, "dU": 16, "dH": 17, "HPL": 18, "VPL": 19}
    x = lines.where(~F.ltrim("value").startswith("*")).withColumn("_p", F.split(F.trim("value"), r"\s+")).where(F.size("_p") >= 20).withColumn("time", F.col("_p")[0].try_cast("timestamp_ntz")).where("time IS NOT NULL")
    return x.select("time", *[_double(F.col("_p")[i]).alias(n) for n, i in at.items()])


def year_doy_sod(text: Column) -> Column:
    """'YY:DDD:SSSSS' or 'YYYY:DDD:SSSSS' as a time; '00:000:00000' and its like are null. Two-digit years over 50 are of the last century."""
    y, d, s = (F.regexp_extract(text, r"^\s*(\d{2,4}):(\d{3}):(\d{5})", i).try_cast("int") for i in (1, 2, 3))
    year = F.when(y > 999, y).when(y > 50, y + 1900).otherwise(y + 2000)
    base = F.try_make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return F.when(d > 0, F.timestamp_micros(F.unix_micros(base) + ((d - 1).cast("long") * 86_400 + s) * 1_000_000))


def bias_sinex(lines: DataFrame) -> DataFrame:
    """OSB and DSB lines: nanoseconds in metres, cycles kept; open ends are null."""
    v = F.col("value")
    x = lines.where(v.rlike(r"^ (OSB|DSB|ISB)\s"))
    cut = {"kind": (1, 4), "svn": (6, 4), "prn": (11, 3), "site": (15, 9), "cod1": (25, 4), "cod2": (30, 4), "unit": (65, 4)}
    x = x.select("value", *[F.trim(F.substring(v, a + 1, n)).alias(c) for c, (a, n) in cut.items()], year_doy_sod(F.substring(v, 36, 14)).alias("tini"), year_doy_sod(F.substring(v, 51, 14)).alias("tfin"))
    fact = F.when(F.col("unit") == "ns", 0.299792458).otherwise(1.0)
    num = {"bias": (70, 21), "std": (92, 11), "slope": (104, 21), "slope_std": (126, 11)}
    return x.select("kind", "svn", "prn", "site", "cod1", "cod2", "tini", "tfin", "unit", *[(fixed_number(v, a, n) * fact).alias(c) for c, (a, n) in num.items()])


def rinex_clock(lines: DataFrame) -> DataFrame:
    """AS and AR records: id, epoch, clock and its deviation in seconds."""
    p = F.col("_p")
    x = lines.where(F.col("value").rlike("^A[SR] ")).select(F.split(F.trim("value"), r"\s+").alias("_p")).where(F.size("_p") >= 10)
    t = F.try_make_timestamp(*[p[i].try_cast("int") for i in range(2, 7)], p[7].try_cast("decimal(8,6)"))

    def num(c: Column) -> Column:
        return F.regexp_replace(c, "[dD]", "E").try_cast("double")

    return x.select(p[0].alias("type"), p[1].alias("id"), t.alias("epoch"), num(p[9]).alias("clk"), num(F.get("_p", F.lit(10))).alias("clk_std"))


def erp(lines: DataFrame) -> DataFrame:
    """Rows of IGS version 2 (MJD, 1e-6 arcsec, 1e-7 s) or IERS C04 (year month day [hour] MJD, arcsec, s) as arcsec and seconds."""
    p = F.split(F.trim("value"), r"\s+")
    x = lines.select(p.alias("_p")).where(F.exists("_p", lambda s: s.try_cast("double").isNotNull()) & (F.size("_p") >= 5))
    d = F.transform("_p", lambda s: s.try_cast("double"))
    x = x.select(d.alias("_d")).where(F.col("_d")[0].isNotNull())
    igs = F.col("_d")[0].between(30_000, 100_000)
    at = F.when(igs, 0).when(F.col("_d")[3].between(30_000, 100_000), 3).when(F.col("_d")[4].between(30_000, 100_000), 4)

    def v(i: int, igs_scale: float) -> Column:
        return F.get("_d", at + i) * F.when(igs, igs_scale).otherwise(1.0)

    x = x.where(at.isNotNull())
    return x.select(F.get("_d", at).alias("mjd"), v(1, 1e-6).alias("xp"), v(2, 1e-6).alias("yp"), v(3, 1e-7).alias("ut1_utc"), F.when(igs, v(4, 1e-7)).alias("lod"))


def whitespace_table(lines: DataFrame, names: list[str], comment: str = r"^\s*[!#%*]") -> DataFrame:
    """Rows of numbers after comment lines: mapping-function and height grids, loading and pole-tide tables."""
    x = lines.where(~F.col("value").rlike(comment)).select(F.split(F.trim("value"), r"\s+").alias("_p")).where(F.size("_p") >= len(names))
    return x.select(*[_double(F.col("_p")[i]).alias(n) for i, n in enumerate(names)]).where(F.col(names[0]).isNotNull())


def vmf3_grid(lines: DataFrame) -> DataFrame:
    return whitespace_table(lines, ["lat", "lon", "ah", "aw", "zhd", "zwd"])


def gravity_field(lines: DataFrame, degree_max: int | None = None) -> DataFrame:
    """gfc coefficient lines: degree, order, C, S."""
    m = r"^(?:gfc|gfct)\s+(\d+)\s+(\d+)\s+(\S+)\s+(\S+)"
    x = lines.where(F.col("value").rlike(m))
    g = [F.regexp_extract("value", m, i) for i in range(5)]
    out = x.select(g[1].cast("int").alias("n"), g[2].cast("int").alias("m"), F.regexp_replace(g[3], "[dD]", "E").try_cast("double").alias("c"), F.regexp_replace(g[4], "[dD]", "E").try_cast("double").alias("s"))
    return out if degree_max is None else out.where(F.col("n") <= degree_max)


def igrf(lines: DataFrame) -> DataFrame:
    """Geomagnetic coefficients unpivoted by epoch: g/h, n, m, epoch, value; the secular variation has epoch null. Each file's rows take the header of that file.

    lines are (value), of one file, or (file, value); a file has one header, the first by its text where it has more.
    """
    lines = lines if "file" in lines.columns else lines.withColumn("file", F.lit(""))
    head = lines.where(F.col("value").rlike(r"^g/h\s")).groupBy("file").agg(F.split(F.trim(F.min("value")), r"\s+").alias("_h"))
    rows = lines.where(F.col("value").rlike(r"^[gh]\s")).select("file", F.split(F.trim("value"), r"\s+").alias("_p"))
    z = rows.join(head, "file").select(F.col("_p")[0].alias("kind"), F.col("_p")[1].cast("int").alias("n"), F.col("_p")[2].cast("int").alias("m"), F.explode(F.arrays_zip(F.slice("_h", 4, 1000).alias("e"), F.slice("_p", 4, 1000).alias("v"))).alias("_z"))
    return z.select("kind", "n", "m", F.col("_z.e").try_cast("double").alias("epoch"), F.col("_z.v").try_cast("double").alias("value"))


def sinex_block(lines: DataFrame, file: str, number: str, block: str) -> DataFrame:
    """Data lines of one block: between '+block' and '-block', per file by line number."""
    edge = lines.where(F.col("value").rlike(rf"^[+-]{block}\s*$")).groupBy(file).agg(
        F.min(F.when(F.col("value").startswith("+"), F.col(number))).alias("_a"), F.max(F.when(F.col("value").startswith("-"), F.col(number))).alias("_z")
    )
    x = lines.join(edge, file).where((F.col(number) > F.col("_a")) & (F.col(number) < F.col("_z")) & ~F.col("value").rlike(r"^[*%]"))
    return x.drop("_a", "_z")


def sinex_estimates(block: DataFrame) -> DataFrame:
    """SOLUTION/ESTIMATE lines: parameter, site, point, solution, epoch, unit, estimate and deviation."""
    v = F.col("value")
    cut = {"param": (7, 6), "site": (14, 4), "point": (19, 2), "soln": (22, 4), "unit": (40, 4)}
    return block.select(fixed_number(v, 1, 5).cast("int").alias("index"), *[F.trim(F.substring(v, a + 1, n)).alias(c) for c, (a, n) in cut.items()], year_doy_sod(F.substring(v, 28, 12)).alias("epoch"), fixed_number(v, 47, 21).alias("estimate"), fixed_number(v, 69, 11).alias("std"))




def trop_sinex(lines: DataFrame) -> DataFrame:
    """TROP/SOLUTION rows: site, epoch, total delay and deviation in metres, gradients where given."""
    p = F.split(F.trim("value"), r"\s+")
    x = lines.where(F.col("value").rlike(r"^ \S+\s+\d{2,4}:\d{3}:\d{5}\s")).select(p.alias("_p")).where(F.size("_p") >= 4).withColumn("epoch", year_doy_sod(F.get("_p", F.lit(1))))

    def mm(i: int) -> Column:
        return F.get("_p", F.lit(i)).try_cast("double") / 1000

    return x.select(F.col("_p")[0].alias("site"), "epoch", mm(2).alias("total"), mm(3).alias("std"), mm(4).alias("grad_n"), mm(5).alias("grad_e"))


def ionex_biases(lines: DataFrame) -> DataFrame:
    """'PRN / BIAS / RMS' and 'STATION / BIAS / RMS' lines: id, bias and deviation in nanoseconds."""
    v = F.col("value")
    kind = F.trim(F.substring(v, 61, 20))
    x = lines.where(kind.isin("PRN / BIAS / RMS", "STATION / BIAS / RMS"))
    sat = kind == "PRN / BIAS / RMS"
    return x.select(F.when(sat, "satellite").otherwise("station").alias("kind"), F.when(sat, F.trim(F.substring(v, 4, 3))).otherwise(F.trim(F.substring(v, 7, 20))).alias("id"), F.when(sat, fixed_number(v, 6, 10)).otherwise(fixed_number(v, 26, 10)).alias("bias_ns"), F.when(sat, fixed_number(v, 16, 10)).otherwise(fixed_number(v, 36, 10)).alias("rms_ns"))


def ems_messages(lines: DataFrame) -> DataFrame:
    """Archived augmentation messages: 'prn yy mm dd hh mm ss type hex' as satellite, time, type and bytes."""
    m = r"^\s*(\d+)\s+(\d{2})\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+([0-9A-Fa-f]+)\s*$"
    x = lines.where(F.col("value").rlike(m))
    g = [F.regexp_extract("value", m, i) for i in range(10)]
    t = F.try_make_timestamp(g[2].cast("int") + 2000, g[3].cast("int"), g[4].cast("int"), g[5].cast("int"), g[6].cast("int"), g[7].cast("int"))
    return x.select(g[1].cast("int").alias("prn"), t.alias("time"), g[8].cast("int").alias("type"), F.unhex(g[9]).alias("data"))


def satellite_ids(lines: DataFrame) -> DataFrame:
    """Satellite identity lines 'name cospar sic norad ...' as a dimension."""
    p = F.split(F.trim("value"), r"\s+")
    x = lines.where(~F.col("value").rlike(r"^\s*[#*!]")).select(p.alias("_p")).where((F.size("_p") >= 4) & F.col("_p")[2].rlike(r"^\d+$"))
    return x.select(F.col("_p")[0].alias("name"), F.col("_p")[1].alias("ilrs"), F.col("_p")[2].cast("int").alias("sic"), F.col("_p")[3].try_cast("int").alias("norad"))


def tide_coefficients(lines: DataFrame) -> DataFrame:
    """Harmonic tide rows 'doodson wave n m C+ S+ C- S-'."""
    m = r"^\s*(\d{2,3}\.\d{3})\s+(\S+)\s+(\d+)\s+(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)"
    x = lines.where(F.col("value").rlike(m))
    g = [F.regexp_extract("value", m, i) for i in range(9)]
    return x.select(g[1].alias("doodson"), g[2].alias("wave"), g[3].cast("int").alias("n"), g[4].cast("int").alias("m"), *[_double(g[5 + k]).alias(c) for k, c in enumerate(("c_pro", "s_pro", "c_retro", "s_retro"))])


def space_weather(lines: DataFrame) -> DataFrame:
    """Daily rows of a space weather file: date, the eight Kp (tenths), mean Ap and adjusted F10.7."""
    v = F.col("value")
    x = lines.where(v.rlike(r"^\d{4} \d{2} \d{2} \d{4}"))
    day = F.try_make_timestamp(F.substring(v, 1, 4).cast("int"), F.substring(v, 6, 2).cast("int"), F.substring(v, 9, 2).cast("int"), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    return x.select(day.alias("day"), F.array(*[fixed_number(v, 18 + 3 * k, 3) for k in range(8)]).alias("kp"), fixed_number(v, 79, 4).alias("ap"), fixed_number(v, 93, 6).alias("f107"))
