"""Queries of the general data problems (p3 to p6), each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.regrid import READ, regular_grid
from orrery.operators.spikes import flag_spikes
from orrery.functions.time import leap_rows
from orrery.operators.timestamps import estimate_offset_history, normalise_times, readings
from orrery.operators.units import harmonise_delays
from orrery.plans.util import r6
from orrery.session import table


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """Records with exactly one possible instant and its GPST in milliseconds."""
    t = normalise_times(table(spark, base, "epoch_stamp"), table(spark, base, "feed_clock"), table(spark, base, "leap_second"))
    return t.where("status = 'resolved'").select("rec_id", F.floor((F.col("gpst_us") + 500) / 1000).cast("long").alias("gpst_ms"))


def p3_untold(spark: SparkSession, base: str) -> DataFrame:
    """The same with every feed's clock hidden: all civil times on the offset history estimated from the ingestion times."""
    t = normalise_times(table(spark, base, "epoch_stamp"), table(spark, base, "feed_clock").where("false"), table(spark, base, "leap_second"))
    return t.where("status = 'resolved'").select("rec_id", F.floor((F.col("gpst_us") + 500) / 1000).cast("long").alias("gpst_ms"))


def p3_offset_history(spark: SparkSession, base: str) -> DataFrame:
    """The offset history each feed's civil times fit best, told by the ingestion times alone."""
    read = readings(table(spark, base, "epoch_stamp"), "rec_id", "gpswk", "seconds", ["Time", "ReferenceTimeGPST"], "feed", "logged_at")
    return estimate_offset_history(read, leap_rows(table(spark, base, "leap_second")))


def _amounts(lengths: DataFrame, variances: DataFrame) -> DataFrame:
    """Readings not recorded in metres or square metres, in 0.1 mm or 0.01 mm2."""
    a = lengths.where("value_m IS NOT NULL AND NOT isnan(value_m) AND factor <> 1.0").select("field", F.col("bern_id").alias("row_id"), F.floor(F.col("value_m") * 1e4 + 0.5).cast("long").alias("amount"))
    v = variances.where("value_m2 IS NOT NULL AND NOT isnan(value_m2) AND NOT (factor = 1.0 AND power = 1)")
    return a.unionByName(v.select(F.lit("trop_var").alias("field"), F.col("pea_id").alias("row_id"), F.floor(F.col("value_m2") * 1e8 + 0.5).cast("long").alias("amount")))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """Readings not recorded in metres or square metres, converted, in 0.1 mm or 0.01 mm2."""
    return _amounts(*harmonise_delays(table(spark, base, "trop_bern"), table(spark, base, "trop_pea")))


def p4_unread(spark: SparkSession, base: str) -> DataFrame:
    """The same with the labels unread: they only tell sources apart, and all units come from the links."""
    return _amounts(*harmonise_delays(table(spark, base, "trop_bern"), table(spark, base, "trop_pea"), read_labels=False))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    """Rows whose prefit or postfit is not finite, a spike or held."""
    return flag_spikes(table(spark, base, "residual")).select("res_id").distinct()


def p5_phase(spark: SparkSession, base: str) -> DataFrame:
    """Jumps against their neighbours that stay under ten spreads: what the ellipsoids alone flag."""
    return flag_spikes(table(spark, base, "residual"), phase=True).where("reason = 'phase'").select("res_id", "field", r6("value").alias("value"))


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    """Slots without a usable reading between a station's first and last."""
    return regular_grid(table(spark, base, "pos_solution")).where(F.col("status") != READ).select("site", "slot_s")


def p6_grid(spark: SparkSession, base: str) -> DataFrame:
    """The whole regular series, interpolated up to a gap of one hour."""
    g = regular_grid(table(spark, base, "pos_solution"))
    return g.select("site", "slot_s", "status", *[r6(c).alias(c) for c in ("dN", "dE", "dU")])


QUERIES = {"p4_found": p4_found, "p4_unread": p4_unread, "p3_found": p3_found, "p3_untold": p3_untold, "p3_offset_history": p3_offset_history, "p5_found": p5_found, "p5_phase": p5_phase, "p6_found": p6_found, "p6_grid": p6_grid}

_FIELD = """
SELECT res_id, recv, sat, sig, meas, datetime, {f} AS v FROM residual WHERE {f} IS NOT NULL"""

_FOUND = """
{p}x AS ({field}), {p}ok AS (SELECT * FROM {p}x WHERE isfinite(v)),
{p}m AS (SELECT recv, sat, sig, meas, median(v) AS med FROM {p}ok GROUP BY ALL),
{p}d AS (SELECT o.*, abs(o.v - m.med) AS dev, m.med FROM {p}ok o JOIN {p}m m ON {on}),
{p}s0 AS (SELECT recv, sat, sig, meas, greatest(1.4826 * median(dev), quantile_cont(dev, 0.9) / 1.6449) AS s FROM {p}d GROUP BY ALL),
{p}s1 AS (SELECT o.recv, o.sat, o.sig, o.meas, stddev_pop(v) AS s FROM {p}d o JOIN {p}s0 m ON {on} WHERE dev <= 10 * s GROUP BY ALL),
{p}s2 AS (SELECT o.recv, o.sat, o.sig, o.meas, stddev_pop(v) AS s FROM {p}d o JOIN {p}s1 m ON {on} WHERE dev <= 10 * s GROUP BY ALL),
{p}spike AS (SELECT o.res_id FROM {p}d o JOIN {p}s2 m ON {on} WHERE dev > 10 * s),
{p}e AS (SELECT recv, sat, sig, meas, datetime, min_by(v, res_id) AS v FROM {p}x GROUP BY ALL),
{p}r AS (SELECT *, sum(CASE WHEN v = p THEN 0 ELSE 1 END) OVER (PARTITION BY recv, sat, sig, meas ORDER BY datetime) AS g FROM (SELECT *, lag(v) OVER (PARTITION BY recv, sat, sig, meas ORDER BY datetime) AS p FROM {p}e)),
{p}h AS (SELECT *, count(*) OVER (PARTITION BY recv, sat, sig, meas, g) AS n FROM {p}r),
{p}held AS (SELECT o.res_id FROM {p}x o JOIN {p}h m ON {on} AND o.datetime = m.datetime AND o.v = m.v WHERE n >= 8)"""
_ON = "o.recv = m.recv AND o.sat = m.sat AND o.sig = m.sig AND o.meas = m.meas"
_P5 = ",".join(_FOUND.format(p=f"{f}_", field=_FIELD.format(f=f), on=_ON) for f in ("prefit", "postfit"))

_LENGTHS = ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in [
    ("m", 1.0), ("metre", 1.0), ("metres", 1.0), ("metre s", 1.0), ("meter", 1.0), ("meters", 1.0), ("cm", 0.01), ("centimetres", 0.01), ("mm", 0.001), ("millimetres", 0.001), ("millimeter", 0.001),
    ("um", 1e-6), ("microns", 1e-6), ("in", 0.0254), ("inch", 0.0254), ("inches", 0.0254), ('"', 0.0254), ("ft", 0.3048), ("foot", 0.3048), ("feet", 0.3048), ("ns", 0.299792458), ("nsec", 0.299792458), ("nanoseconds", 0.299792458),
    ("0.1 mm", 1e-4), ("1e-4 m", 1e-4), ("10^-4 m", 1e-4), ("tenths of mm", 1e-4),
])
_AREAS = ", ".join(f"('{k}', {f!r}::DOUBLE, {p})" for k, f, p in [
    ("mm**2", 1e-6, 1), ("mm^2", 1e-6, 1), ("mm2", 1e-6, 1), ("variance mm²", 1e-6, 1), ("square millimetres", 1e-6, 1), ("10^-6 m^2", 1e-6, 1), ("1e-6 m2", 1e-6, 1), ("cm^2", 1e-4, 1), ("cm2", 1e-4, 1), ("square centimetres", 1e-4, 1),
    ("std dev, cm", 0.01, 2), ("sigma mm", 0.001, 2), ("std mm", 0.001, 2), ("1-sigma m", 1.0, 2), ("m^2", 1.0, 1), ("m**2", 1.0, 1), ("m2", 1.0, 1), ("sq. metres", 1.0, 1),
])
_NUM = r"'^[\s]*([+-]?[0-9]{1,3}( [0-9]{3})+|[+-]?[0-9]+)([.,][0-9]+)?([eE][+-]?[0-9]+)?[\s]*(.*?)[\s]*$'"


def _number(c: str) -> str:
    return f"TRY_CAST(replace(regexp_extract({c}, {_NUM}, 1), ' ', '') || replace(regexp_extract({c}, {_NUM}, 3), ',', '.') || regexp_extract({c}, {_NUM}, 4) AS DOUBLE)"


def _label(c: str) -> str:
    clean = f"trim(regexp_replace(regexp_replace(regexp_replace(lower(translate({c}, 'µμ', 'uu')), '[\\[\\](){{}}]', ' ', 'g'), '^ *units? *[:=]? *', ''), '[.] *$', ''))"
    return f"CASE WHEN regexp_replace({clean}, ' +', ' ', 'g') IN ('', '-', '---', '?', 'n/a') THEN NULL ELSE regexp_replace({clean}, ' +', ' ', 'g') END"


SQL = {
    "p4_found": f"""
WITH b AS (SELECT bern_id, {_number("ZTD")} AS z, {_label(f"regexp_extract(ZTD, {_NUM}, 5)")} AS zl, {_number("std")} AS s, {_label(f"regexp_extract(std, {_NUM}, 5)")} AS sl, {_label("unit")} AS ul FROM trop_bern),
u(l, f) AS (VALUES {_LENGTHS}), a(l, f, p) AS (VALUES {_AREAS}),
z AS (SELECT b.*, coalesce(zu.f, CASE WHEN coalesce(zl, ul) IS NULL THEN CASE WHEN z BETWEEN 1.2 AND 3.2 THEN 1.0 WHEN z * 0.01 BETWEEN 1.2 AND 3.2 THEN 0.01 WHEN z * 0.001 BETWEEN 1.2 AND 3.2 THEN 0.001 END END) AS zf,
      su.f AS sf FROM b LEFT JOIN u zu ON zu.l = coalesce(zl, ul) LEFT JOIN u su ON su.l = coalesce(sl, ul)),
v AS (SELECT pea_id, trop_var AS v, {_label("var_unit")} AS l FROM trop_pea WHERE trop_var IS NOT NULL AND NOT isnan(trop_var)),
w AS (SELECT pea_id, v, coalesce(a.f, CASE WHEN v.l IS NULL THEN CASE WHEN sqrt(v) < 0.05 THEN 1.0 WHEN sqrt(v) < 50 THEN 1e-6 END END) AS f, coalesce(a.p, 1) AS p FROM v LEFT JOIN a ON a.l = v.l)
SELECT 'ZTD' AS field, bern_id AS row_id, CAST(floor(z * zf * 1e4 + 0.5) AS BIGINT) AS amount FROM z WHERE z IS NOT NULL AND zf <> 1
UNION ALL SELECT 'std', bern_id, CAST(floor(s * coalesce(sf, zf) * 1e4 + 0.5) AS BIGINT) FROM z WHERE s IS NOT NULL AND coalesce(sf, zf) <> 1
UNION ALL SELECT 'trop_var', pea_id, CAST(floor(CASE WHEN p = 1 THEN v * f ELSE v * f * v * f END * 1e8 + 0.5) AS BIGINT) FROM w WHERE NOT (f = 1 AND p = 1)
""",
    "p5_found": f"""
WITH {_P5}
SELECT res_id FROM residual WHERE isnan(prefit) OR isinf(prefit) OR isnan(postfit) OR isinf(postfit)
UNION SELECT res_id FROM prefit_spike UNION SELECT res_id FROM postfit_spike UNION SELECT res_id FROM prefit_held UNION SELECT res_id FROM postfit_held
""",
    "p6_grid": """
WITH u AS (SELECT site, epoch_us("Time") AS t, CAST(floor(epoch_us("Time") / 600000000.0) AS BIGINT) AS slot, dN, dE, dU FROM pos_solution
           WHERE dN IS NOT NULL AND dE IS NOT NULL AND dU IS NOT NULL AND NOT isnan(dN) AND NOT isnan(dE) AND NOT isnan(dU)),
     g AS (SELECT site, unnest(generate_series(min(slot), max(slot))) AS slot FROM u GROUP BY site),
     o AS (SELECT g.site, g.slot, g.slot * 600000000 AS a, EXISTS (SELECT 1 FROM u WHERE u.site = g.site AND u.slot = g.slot) AS read FROM g),
     n AS (SELECT o.*, f.t AS t1, f.dN AS n1, f.dE AS e1, f.dU AS u1 FROM o ASOF LEFT JOIN (SELECT DISTINCT ON (site, t) * FROM u ORDER BY site, t, dN, dE, dU) f ON o.site = f.site AND o.a <= f.t),
     b AS (SELECT n.*, p.t AS t0, p.dN AS n0, p.dE AS e0, p.dU AS u0 FROM n ASOF LEFT JOIN (SELECT DISTINCT ON (site, t) * FROM u ORDER BY site, t, dN DESC, dE DESC, dU DESC) p ON n.site = p.site AND n.a > p.t)
SELECT site, slot * 600 AS slot_s, CASE WHEN read THEN 'reading' WHEN t1 - t0 <= 3600000000 THEN 'filled' ELSE 'gap' END AS status,
       round(CASE WHEN t0 IS NULL THEN n1 WHEN t1 - t0 <= 3600000000 THEN n0 + (n1 - n0) * ((a - t0) / (t1 - t0)) END + 1e-9, 6) + 0.0 AS dN,
       round(CASE WHEN t0 IS NULL THEN e1 WHEN t1 - t0 <= 3600000000 THEN e0 + (e1 - e0) * ((a - t0) / (t1 - t0)) END + 1e-9, 6) + 0.0 AS dE,
       round(CASE WHEN t0 IS NULL THEN u1 WHEN t1 - t0 <= 3600000000 THEN u0 + (u1 - u0) * ((a - t0) / (t1 - t0)) END + 1e-9, 6) + 0.0 AS dU FROM b
""",
    "p6_found": """
WITH u AS (SELECT DISTINCT site, CAST(floor(epoch_us("Time") / 600000000.0) AS BIGINT) AS slot FROM pos_solution
           WHERE dN IS NOT NULL AND dE IS NOT NULL AND dU IS NOT NULL AND NOT isnan(dN) AND NOT isnan(dE) AND NOT isnan(dU)),
     r AS (SELECT site, min(slot) AS a, max(slot) AS b FROM u GROUP BY site),
     g AS (SELECT site, unnest(generate_series(a, b)) AS slot FROM r)
SELECT g.site, g.slot * 600 AS slot_s FROM g ANTI JOIN u ON g.site IS NOT DISTINCT FROM u.site AND g.slot = u.slot
""",
}
