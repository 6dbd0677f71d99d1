"""Quantities in different units to common ones.

A source is a label as written, or an unlabelled field together with the order of magnitude of its numbers, so units mixed without
labels in one site still part into sources. The same entities (site and hour) are linked across sources by an equi-join on
pre-aggregated keys. Each pair of linked sources gets a robust scale and offset: the median ratio where ratios agree, else the
slope of the quartiles and the median of what it leaves. Scale and offset are carried through the source graph from a source in
metres and snapped to known conversions; the graph decides. A label's meaning, read from a table, settles between conversions too close to tell,
stands in for sources without links, and marks a conflict where the graph says otherwise; ranges only check.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import checkpointed, micros, sized

# Metres in one unit; a nanosecond is light travel time in vacuum.
METRES = {
    "m": 1.0, "metre": 1.0, "metres": 1.0, "meter": 1.0, "meters": 1.0,
    "dm": 0.1, "cm": 0.01, "centimetre": 0.01, "centimetres": 0.01, "centimeter": 0.01, "centimeters": 0.01,
    "mm": 0.001, "millimetre": 0.001, "millimetres": 0.001, "millimeter": 0.001, "millimeters": 0.001,
    "um": 1e-6, "micron": 1e-6, "microns": 1e-6, "micrometre": 1e-6, "micrometres": 1e-6, "micrometer": 1e-6, "micrometers": 1e-6,
    "nm": 1e-9, "km": 1000.0,
    "in": 0.0254, "inch": 0.0254, "inches": 0.0254, '"': 0.0254, "ft": 0.3048, "foot": 0.3048, "feet": 0.3048, "'": 0.3048, "yd": 0.9144,
    "ns": 0.299792458, "nsec": 0.299792458, "nanosecond": 0.299792458, "nanoseconds": 0.299792458, "ps": 0.000299792458, "us": 299.792458,
}
NO_LABEL = ("", "-", "--", "---", "?", "n/a", "na", "nan", "none", "null", "unknown")
_NUMBER = r"^[\s ]*([+-]?\d{1,3}(?:[   ]\d{3})+|[+-]?\d+|[+-]?(?=\.\d))([.,]\d+)?([eE][+-]?\d+)?[\s ]*(.*?)[\s ]*$"


def parted(text: Column) -> Column:
    """[number, unit text] of a text that begins with a number (decimal comma, blanks between thousands, exponent), else null."""
    one = F.split(F.when(text.rlike(_NUMBER), F.regexp_replace(text, _NUMBER, "$1;$2;$3;$4")), ";", 4)
    return F.transform(F.array(one), lambda x: F.array(F.concat(F.translate(x[0], " \u00a0\u202f", ""), F.translate(x[1], ",", "."), x[2]), x[3]))[0]


def number_of(text: Column) -> Column:
    """The number a text begins with, null if none."""
    return parted(text)[0].try_cast("double")


def label_of(text: Column) -> Column:
    """The unit text beside the number, null if none."""
    s = parted(text)[1]
    return F.when(s != "", s)


def clean_label(label: Column) -> Column:
    """Lower case, without brackets, 'unit' and trailing points; null where it says nothing."""
    s = F.lower(F.regexp_replace(label, "[µμ]", "u"))
    s = F.regexp_replace(F.regexp_replace(s, r"[\[\](){}]", " "), r"^\s*units?\s*[:=]?\s*", "")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"\.\s*$", ""))
    s = F.regexp_replace(s, r"^(metre|meter) s$", "metres")
    return F.when(s.isin(*NO_LABEL), None).otherwise(s)


def _factor(s: Column) -> tuple[Column, Column]:
    """(multiplier written before a unit, metres of the unit) of a cleaned label."""
    power = F.regexp_extract(s, r"^(?:1(?:\.0)?e|10\s*\^\s*|10\*\*)\s*([+-]?\d+)\s*(?=[a-z])", 1).try_cast("int")
    plain = F.regexp_extract(s, r"^(\d+(?:\.\d+)?)\s*(?=[a-z])", 1).try_cast("double")
    words = F.when(s.rlike("^tenths? of "), 0.1).when(s.rlike("^hundredths? of "), 0.01).when(s.rlike("^thousandths? of "), 0.001)
    mult = F.coalesce(F.pow(F.lit(10.0), power), words, plain, F.lit(1.0))
    unit = F.trim(F.regexp_replace(s, r"^(?:1(?:\.0)?e[+-]?\d+|10\s*\^\s*[+-]?\d+|10\*\*[+-]?\d+|\d+(?:\.\d+)?|(?:tenth|hundredth|thousandth)s? of)\s*", ""))
    table = F.create_map(*[F.lit(x) for kv in METRES.items() for x in kv])
    return mult, F.try_element_at(table, unit)


def length_factor(label: Column) -> Column:
    """Metres in one unit of a cleaned label, null if not known."""
    mult, base = _factor(label)
    return mult * base


def variance_form(label: Column) -> tuple[Column, Column]:
    """(factor, power): the square metres are (value * factor) ** power. Power 2 where the label speaks of a deviation."""
    dev = label.rlike(r"std|sigma|deviation|\brms\b|σ")
    s = F.regexp_replace(label, r"std\.?\s*dev(iation)?\.?|standard deviation|deviation|1\s*-?\s*sigma|sigma|\bstd\b|variance|\bvar\b|[,;:]|σ", " ")
    square = s.rlike(r"\^\s*2|\*\*\s*2|²|\bsq(uare|\.)?\b|[a-z]2\b")
    s = F.regexp_replace(s, r"\^\s*2\b|\*\*\s*2\b|²|\bsquared?\b|\bsq\b\.?|(?<=[a-z])2\b", " ")
    mult, base = _factor(F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.when(square & ~dev, mult * base * base).otherwise(mult * base), F.when(square & ~dev, 1).otherwise(2)


def magnitude(v: Column) -> Column:
    return F.floor(F.log10(F.abs(v))).cast("int")


def link_sources(left: DataFrame, right: DataFrame, keys: Sequence[str], agree: float = 0.02) -> DataFrame:
    """(a, b, r, c, spread, n) for each pair of linked sources: a value of a is r times the value of b plus c.

    left and right are (keys..., node, v); left should hold one row an entity and node. r is the median ratio, c zero, where half the
    ratios lie within the share ``agree`` of it or the quartiles are too close to tell a slope; else r is the ratio of the quartile
    distances and c the median of the rest. spread is the middle half of the ratios (log) or of the rest over the values.
    """
    l, r = left.withColumnsRenamed({"node": "a", "v": "va"}), right.withColumnsRenamed({"node": "b", "v": "vb"})
    ok = (F.col("va") != 0) & (F.col("vb") != 0) & ((F.col("va") > 0) == (F.col("vb") > 0))
    both = checkpointed(l.join(r, list(keys)).where(ok).select("a", "b", "va", "vb"))
    q = [0.25, 0.5, 0.75]
    e = both.groupBy("a", "b").agg(
        F.percentile_approx(F.log(F.col("va") / F.col("vb")), q, 10_000).alias("q"), F.percentile_approx("va", q, 10_000).alias("qa"), F.percentile_approx("vb", q, 10_000).alias("qb"), F.count("*").alias("n")
    )
    wide = F.col("q")[2] - F.col("q")[0]
    slope = (F.col("qa")[2] - F.col("qa")[0]) / F.nullif(F.col("qb")[2] - F.col("qb")[0], F.lit(0.0))
    bent = (wide > 2 * agree) & (F.col("n") >= 20) & (slope > 0)
    e = checkpointed(e.select("a", "b", "n", bent.alias("bent"), F.when(bent, slope).otherwise(F.exp(F.col("q")[1])).alias("r"), wide.alias("wide"), F.abs(F.col("qa")[1]).alias("size")))
    rest = both.join(sized(e.where("bent").select("a", "b", "r")), ["a", "b"]).groupBy("a", "b").agg(F.percentile_approx(F.col("va") - F.col("r") * F.col("vb"), q, 10_000).alias("o"))
    e = e.join(sized(rest), ["a", "b"], "left")
    # a line that fits no better than the ratio is not taken
    better = F.col("bent") & ((F.col("o")[2] - F.col("o")[0]) / F.col("size") < F.col("wide") / 4)
    plain = F.when(F.col("bent") & ~better, F.lit(None)).otherwise(F.col("r"))
    return e.select("a", "b", F.when(better, F.col("r")).otherwise(plain).alias("r"), F.when(better, F.col("o")[1]).otherwise(0.0).alias("c"), F.when(better, (F.col("o")[2] - F.col("o")[0]) / F.col("size")).otherwise(F.col("wide")).alias("spread"), "n").where("r IS NOT NULL")


def link_scales(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(b, r, h, n): the median ratios of a quantity, and of its root, to each linked source's values. left holds one row an entity."""
    both = left.withColumnsRenamed({"v": "va"}).drop("node").join(right.withColumnsRenamed({"node": "b", "v": "vb"}), list(keys)).where("va > 0 AND vb > 0")
    e = both.groupBy("b").agg(F.percentile_approx(F.log(F.col("va") / F.col("vb")), 0.5, 10_000).alias("r"), F.percentile_approx(F.log(F.sqrt("va") / F.col("vb")), 0.5, 10_000).alias("h"), F.count("*").alias("n"))
    return e.select("b", F.exp("r").alias("r"), F.exp("h").alias("h"), "n")


def propagate_scales(edges: DataFrame, roots: Sequence[str]) -> DataFrame:
    """(node, scale, shift, hops): root units are scale times a node's value plus shift, along the heaviest edge of each round, until no round reaches a new node."""
    spark = edges.sparkSession
    known = spark.createDataFrame([(k, 1.0, 0.0, 0) for k in roots], "node string, scale double, shift double, hops int")
    hop, grew = 0, True
    while grew:
        hop += 1
        step = edges.join(known.withColumnRenamed("node", "a"), "a").join(known.select(F.col("node").alias("b")), "b", "left_anti")
        best = step.groupBy("b").agg(F.max(F.struct("n", (F.col("scale") * F.col("r")).alias("s"), (F.col("scale") * F.col("c") + F.col("shift")).alias("o"))).alias("m"))
        new = checkpointed(best.select(F.col("b").alias("node"), F.col("m.s").alias("scale"), F.col("m.o").alias("shift"), F.lit(hop).alias("hops")))
        grew = not new.isEmpty()
        known = checkpointed(known.unionByName(new)) if grew else known
    return known


def snap(scale: Column, known: Sequence[float], within: float, told: Column | None = None) -> Column:
    """The known conversion nearest on a log scale, null beyond ``within``; what is told stands where it lies as near as ``within`` itself."""
    best = F.array_min(F.array(*[F.struct(F.abs(F.log(scale / F.lit(k))).alias("d"), F.lit(k).alias("k")) for k in known]))
    near = F.when((scale > 0) & (best["d"] <= within), best["k"])
    return near if told is None else F.when((scale > 0) & (F.abs(F.log(scale / told)) <= within), told).otherwise(near)


def by_label(df: DataFrame, label: str, **columns) -> DataFrame:
    """Add columns that depend on a label alone, computed once for each distinct label and joined back."""
    each = df.select(F.col(label).alias("_by")).distinct().where("_by IS NOT NULL").select("_by", *[c(F.col("_by")).alias(n) for n, c in columns.items()])
    return df.join(sized(each), F.col(label) == F.col("_by"), "left").drop("_by")


def harmonise_delays(bern: DataFrame, pea: DataFrame, read_labels: bool = True) -> tuple[DataFrame, DataFrame]:
    """Delays and their uncertainties in metres and square metres.

    Gives (bern_id, field, raw, value_m, factor, how) for ZTD and std, and (pea_id, raw, value_m2, factor, power, how) for trop_var.
    how: 'graph' (the label's, or the unlabelled magnitude's, scale and offset came from linked sources), 'label' (no links; the label's own meaning),
    'conflict' (the graph contradicts the label's meaning; the meaning is kept), 'ztd' (a std follows its record's ZTD), 'range' (no links, no label: the one of m, cm,
    mm or of m2, mm2 that a delay or variance can have). With read_labels off, labels only tell sources apart and the graph alone gives
    their units. A text without a number, a label neither linked nor known and a number no
    unit makes plausible give null values. Zero and negative numbers keep their unit. Repeated rows count each; extra columns are not
    read; null sites link to nothing; empty tables give empty results.
    """
    hour = 3_600_000_000
    none = F.lit(None).cast("double")
    b = bern.select("bern_id", "site", F.floor(micros("datetime") / hour).alias("_h"), parted(F.col("ZTD")).alias("_zt"), parted(F.col("std")).alias("_st"), F.col("unit").alias("_u"))
    b = b.select("bern_id", "site", "_h", F.col("_zt")[0].try_cast("double").alias("_z"), F.col("_zt")[1].alias("_zr"), F.col("_st")[0].try_cast("double").alias("_s"), F.col("_st")[1].alias("_sr"), "_u")
    b = b.withColumns({out: clean_label(F.col(raw)) for raw, out in (("_zr", "_zl"), ("_sr", "_sl"), ("_u", "_ul"))})
    b = b.withColumn("_label", F.coalesce("_zl", "_ul")).withColumn("_slabel", F.coalesce("_sl", "_ul"))
    b = b.withColumn("_node", F.when(F.col("_label").isNotNull(), F.concat(F.lit("ztd|"), "_label")).otherwise(F.concat(F.lit("ztd|none|"), magnitude(F.col("_z")))))
    us = F.coalesce(micros("datetime"), (F.lit(315_964_800) + F.col("gpswk").cast("long") * 604_800) * 1_000_000 + F.round(F.col("seconds") * 1e6).cast("long"))
    p = pea.select("pea_id", "site", F.floor(us / hour).alias("_h"), F.col("trop_value").alias("_tv"), F.col("trop_var").alias("_v"), "var_unit")
    p = by_label(p, "var_unit", _label=clean_label)
    p = p.withColumn("_node", F.when(F.col("_label").isNotNull(), F.concat(F.lit("var|"), "_label")).otherwise(F.concat(F.lit("var|none|"), magnitude(F.col("_v")))))

    # delays: every source against trop_value at the same site and hour
    delay = b.where("_z IS NOT NULL AND _node IS NOT NULL").select("site", "_h", F.col("_node").alias("node"), F.col("_z").alias("v"))
    hours = checkpointed(p.groupBy("site", "_h", "_node").agg(F.avg(F.when(~F.isnan("_tv"), F.col("_tv"))).alias("tv"), F.exp(F.avg(F.when(F.col("_v") > 0, F.log("_v")))).alias("v"), F.count(F.when(F.col("_v") > 0, 1)).alias("n"), F.count(F.when(~F.isnan("_tv"), 1)).alias("m")))
    ref = hours.where("m > 0").groupBy("site", "_h").agg((F.sum(F.col("tv") * F.col("m")) / F.sum("m")).alias("v")).withColumn("node", F.lit("trop_value"))
    lengths = sorted({*METRES.values(), 1e-4})
    meaning = (lambda c: length_factor(c)) if read_labels else (lambda c: F.lit(None).cast("double"))
    ztd = propagate_scales(link_sources(ref, delay, ["site", "_h"]), ["trop_value"]).where("hops > 0")
    told = F.when(~F.col("node").startswith("ztd|none|"), meaning(F.substring("node", 5, 1000)))
    ztd = checkpointed(ztd.select(F.col("node").alias("_node"), snap(F.col("scale"), lengths, 0.01, told).alias("_f"), F.col("shift").alias("_o"), told.alias("_t")))
    bad = F.col("_t").isNotNull() & (F.coalesce(F.col("_f"), F.lit(0.0)) != F.col("_t"))
    labels = ztd.where("NOT _node LIKE 'ztd|none|%'").select(F.substring("_node", 5, 1000).alias("_l"), F.when(bad, F.col("_t")).otherwise(F.col("_f")).alias("_lf"), F.when(bad, 0.0).otherwise(F.col("_o")).alias("_lo"), F.when(bad, "conflict").otherwise("graph").alias("_lh")).where("_lf IS NOT NULL")

    def labelled(df: DataFrame, label: str, tag: str) -> DataFrame:
        """Factor, offset and origin of a length label: the graph's, else its own meaning."""
        df = df.join(sized(labels.withColumnsRenamed({"_l": f"{tag}k", "_lf": f"{tag}g", "_lo": f"{tag}o", "_lh": f"{tag}h"})), F.col(label) == F.col(f"{tag}k"), "left").drop(f"{tag}k")
        df = df.withColumn(f"{tag}m", meaning(F.col(label)))
        return df.withColumns({f"{tag}f": F.coalesce(f"{tag}g", f"{tag}m"), f"{tag}h": F.when(F.col(f"{tag}g").isNotNull(), F.col(f"{tag}h")).when(F.col(f"{tag}m").isNotNull(), "label")}).drop(f"{tag}g", f"{tag}m")

    b = labelled(labelled(b, "_label", "_z1"), "_slabel", "_s1")
    b = b.join(sized(ztd.where("_node LIKE 'ztd|none|%'").select("_node", F.col("_f").alias("_n"))), "_node", "left")
    z = F.col("_z")

    def plausible(f: Column) -> Column:
        return (z * f).between(1.2, 3.2)

    free = F.col("_label").isNull()
    linked = F.col("_n").isin(1.0, 0.01, 0.001) & plausible(F.col("_n"))
    ranged = F.when(plausible(F.lit(1.0)), 1.0).when(plausible(F.lit(0.01)), 0.01).when(plausible(F.lit(0.001)), 0.001)
    b = b.withColumn("_zf", F.when(free, F.when(linked, F.col("_n")).otherwise(ranged)).otherwise(F.col("_z1f"))).withColumn("_zo", F.when(free, 0.0).otherwise(F.coalesce("_z1o", F.lit(0.0))))
    b = b.withColumn("_zh", F.when(free, F.when(linked, "graph").when(ranged.isNotNull(), "range")).otherwise(F.col("_z1h")))
    follow = F.col("_slabel").isNull() & (F.col("_zl").isNull() | F.col("_ul").isNull())
    sf = F.when(F.col("_slabel").isNotNull(), F.col("_s1f")).when(follow, F.col("_zf"))
    b = b.withColumns({"_sf": sf, "_sh": F.when(F.col("_slabel").isNotNull(), F.col("_s1h")).when(sf.isNotNull(), "ztd")})
    lengths_out = b.select(
        "bern_id",
        F.explode(F.array(
            F.struct(F.lit("ZTD").alias("field"), z.alias("raw"), (z * F.col("_zf") + F.col("_zo")).alias("value_m"), F.col("_zf").alias("factor"), F.col("_zh").alias("how")),
            F.struct(F.lit("std").alias("field"), F.col("_s").alias("raw"), (F.col("_s") * F.col("_sf")).alias("value_m"), F.col("_sf").alias("factor"), F.col("_sh").alias("how")),
        )).alias("r"),
    ).select("bern_id", "r.*")

    # variances: unlabelled ones, of m2 or mm2, against the squared deviations of the delays; labelled ones against those
    spread = b.where("_s > 0 AND _sf IS NOT NULL").groupBy("site", "_h").agg(F.avg(F.pow(F.col("_s") * F.col("_sf"), F.lit(2.0))).alias("v")).withColumn("node", F.lit("std"))
    one = hours.where("v IS NOT NULL AND _node LIKE 'var|none|%'").select("site", "_h", F.col("_node").alias("node"), "v")
    unit = link_scales(spread, one, ["site", "_h"])
    unit = checkpointed(unit.select(F.col("b").alias("_node"), snap(F.col("r"), [1.0, 1e-6], 5.0).alias("_n")))
    ranged_v = F.when(F.sqrt("v") < 0.05, 1.0).when(F.sqrt("v") < 50, 1e-6)
    base = hours.where("v IS NOT NULL AND _node LIKE 'var|none|%'").join(sized(unit), "_node", "left").withColumn("_k", F.coalesce("_n", ranged_v)).where("_k IS NOT NULL")
    base = base.groupBy("site", "_h").agg(F.exp(F.sum(F.log(F.col("v") * F.col("_k")) * F.col("n")) / F.sum("n")).alias("v")).withColumn("node", F.lit("var"))
    tagged = hours.where("v IS NOT NULL AND NOT _node LIKE 'var|none|%'").select("site", "_h", F.col("_node").alias("node"), "v")
    fit = link_scales(base, tagged, ["site", "_h"])
    # of the known conversions of a variance and of a deviation, the nearest; a deviation is off by half the logarithm of its square
    forms = [F.struct(F.abs(F.log(F.col("r" if q == 1 else "h") / F.lit(k))).alias("d"), F.lit(q).alias("p"), F.lit(k).alias("k")) for q, ks in ((1, (1.0, 1e-4, 1e-6)), (2, (1.0, 0.01, 0.001))) for k in ks]
    forms = F.transform(F.array(*forms), lambda x: F.struct((x["d"] * x["p"]).alias("d"), x["p"].alias("p"), x["k"].alias("k")))
    fit = fit.select("b", F.array_min(forms).alias("m"))
    label_v = F.substring("b", 5, 1000)
    tf, tp = variance_form(label_v) if read_labels else (none, F.lit(None).cast("int"))
    fit = fit.select("b", F.col("m.k").alias("_gf"), F.col("m.p").alias("_gp"), F.col("m.d").alias("_gd"), tf.alias("_tf"), tp.alias("_tp"))
    # over 0.8 (a factor of 2.2) from every known form, the links say nothing
    far = F.col("_gd") >= 0.8
    clash = F.col("_tf").isNotNull() & ((F.col("_tf") != F.col("_gf")) | (F.col("_tp") != F.col("_gp")))
    fit = fit.select(F.col("b").alias("_node"), F.when(clash | far, F.col("_tf")).otherwise(F.col("_gf")).alias("_lf"), F.when(clash | far, F.col("_tp")).otherwise(F.col("_gp")).alias("_lp"), F.when(far, "label").when(clash, "conflict").otherwise("graph").alias("_lh"))
    fit = checkpointed(fit.where("_lf IS NOT NULL"))
    p = p.join(sized(unit), "_node", "left").join(sized(fit), "_node", "left")
    p = by_label(p, "_label", _mf=lambda c: variance_form(c)[0], _mp=lambda c: variance_form(c)[1]) if read_labels else p.withColumns({"_mf": none, "_mp": F.lit(None).cast("int")})
    v = F.col("_v")
    free_v = F.col("_label").isNull()
    ok = F.col("_n").isNotNull() & (F.sqrt(v * F.col("_n")) < 0.05)
    range_v = F.when(F.sqrt(v) < 0.05, 1.0).when(F.sqrt(v) < 50, 1e-6)
    vf = F.when(free_v, F.when(ok, F.col("_n")).otherwise(range_v)).otherwise(F.coalesce("_lf", "_mf"))
    vp = F.when(free_v, 1).otherwise(F.coalesce("_lp", "_mp", F.lit(1)))
    how = F.when(free_v, F.when(ok, "graph").when(range_v.isNotNull(), "range")).otherwise(F.coalesce("_lh", F.when(F.col("_mf").isNotNull(), "label")))
    variances = p.select("pea_id", v.alias("raw"), vf.alias("factor"), vp.alias("power"), how.alias("how"))
    root_v = F.col("raw") * F.col("factor")
    return lengths_out, variances.select("pea_id", "raw", F.when(F.col("power") == 1, root_v).otherwise(root_v * root_v).alias("value_m2"), "factor", "power", "how")
