"""Queries of the training-data problems tagged llm (1, 2, 7, 8, 9), each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.time import week_tow_us
from orrery.llm import quantiles as Q
from orrery.llm.leaks import find_leaks
from orrery.llm.nearest import first_delivery, nearest
from orrery.llm.packing import pack, token_sizes
from orrery.llm.spam import score_pages
from orrery.operators.units import number_of
from orrery.session import micros, table

P1_AT = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
P1_ACCURACY = 0.01


def p1_daily_sketch(spark: SparkSession, base: str) -> DataFrame:
    """The partial results of single days: counts of postfit per signal, satellite and signed bucket, ready to be combined."""
    r = table(spark, base, "residual").withColumn("day", F.to_date("datetime").cast("string"))
    return Q.sketch(r, ["sig", "sat", "day"], "postfit", P1_ACCURACY)


def p1_percentiles(spark: SparkSession, base: str) -> DataFrame:
    """Percentiles of postfit per signal and satellite, from sketches of single days."""
    r = table(spark, base, "residual").withColumn("day", F.to_date("datetime"))
    days = Q.sketch(r, ["sig", "sat", "day"], "postfit", P1_ACCURACY)
    out = Q.percentiles(Q.merge(days, ["sig", "sat"]), ["sig", "sat"], P1_AT, P1_ACCURACY)
    return out.select("sig", "sat", "n", "p", *[F.round(F.col(c), 9).alias(c) for c in ("estimate", "lower", "upper")])


def p1_sketch(spark: SparkSession, base: str) -> DataFrame:
    """The merged sketch itself: counts per signed bucket, non-finite values apart."""
    r = table(spark, base, "residual").withColumn("day", F.to_date("datetime"))
    return Q.merge(Q.sketch(r, ["sig", "sat", "day"], "postfit", P1_ACCURACY), ["sig", "sat"])


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """trop_bern rows holding a number with the nearest trop_pea row of their site, at most 150 s away."""
    b = table(spark, base, "trop_bern")
    left = first_delivery(b.where(number_of(F.col("ZTD")).isNotNull()), "bern_id", [c for c in b.columns if c not in ("bern_id", "logged_at")])
    # of right rows at one time the smallest id is taken, so repeated deliveries need no pass of their own
    p = table(spark, base, "trop_pea").where("trop_value IS NOT NULL")
    right = p.select("site", "pea_id", F.coalesce(micros("datetime"), week_tow_us(F.col("gpswk"), F.col("seconds"))).alias("t"))
    on = b.where(F.pmod(micros("datetime"), F.lit(60_000_000)) != 0).isEmpty()
    return nearest(left.withColumn("t", micros("datetime")), right, "site", "bern_id", "pea_id", "t", "t", 150.0, on_ticks=on).select("bern_id", "pea_id")


def p7_containers(spark: SparkSession, base: str) -> DataFrame:
    """Where each document's tokens lie, for each capacity."""
    return pack(token_sizes(table(spark, base, "documents")), table(spark, base, "pack_target")).withColumnRenamed("id", "doc_id")


def p7_fill(spark: SparkSession, base: str) -> DataFrame:
    """Containers, tokens and the share of their room used, for each capacity."""
    c = p7_containers(spark, base).groupBy("target").agg(F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    g = table(spark, base, "pack_target")
    return c.join(g, "target").select("target", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4).alias("used"))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents with at least twelve consecutive words of an item's text."""
    return find_leaks(table(spark, base, "documents"), table(spark, base, "eval_item")).where("exact").select("item_id", "doc_id").distinct()


def p8_edited(spark: SparkSession, base: str) -> DataFrame:
    """Documents holding an item whole, found from the item with its middle word replaced, doubled or dropped: only fingerprints within the radius can."""
    w = F.split("text", r"\s+")
    mid = F.floor(F.size("w") / 2).cast("int")
    kind = F.pmod(F.col("item_id"), F.lit(3))
    new = F.when(kind == 0, F.array(F.lit("instead"))).when(kind == 1, F.array(F.lit("besides"), F.get("w", mid))).otherwise(F.array().cast("array<string>"))
    edited = table(spark, base, "eval_item").withColumn("w", w).select("item_id", F.array_join(F.concat(F.slice("w", 1, mid), new, F.slice("w", mid + 2, F.size("w"))), " ").alias("text"))
    return find_leaks(table(spark, base, "documents"), edited, whole=True).select("item_id", "doc_id", F.round("similarity", 6).alias("similarity")).distinct()


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    """Documents scored as spam."""
    return score_pages(table(spark, base, "documents")).where("score > 0.5").select("doc_id")


def p9_changes(spark: SparkSession, base: str) -> DataFrame:
    """Pages whose verdict differs from what their signals alone said: by the trees (labelled otherwise or not at all, and found spam) or by their host."""
    s = score_pages(table(spark, base, "documents"))
    by = F.when((F.col("score") > 0.5) != (F.col("page") > 0.5), "host").when((F.col("page") > 0.5) != (F.coalesce("weak", F.lit(0.0)) > 0.5), "trees")
    return s.withColumn("by", by).where("by IS NOT NULL").select("doc_id", "by", "weak", "page", "score")


QUERIES = {"p1_percentiles": p1_percentiles, "p1_daily_sketch": p1_daily_sketch, "p1_sketch": p1_sketch, "p2_found": p2_found, "p7_containers": p7_containers, "p7_fill": p7_fill, "p8_found": p8_found, "p8_edited": p8_edited, "p9_found": p9_found, "p9_changes": p9_changes}

_P1_SKETCH = """
SELECT sig, sat,
       CASE WHEN isnan(postfit) OR isinf(postfit) THEN NULL WHEN postfit = 0 THEN 0 WHEN postfit > 0 THEN 1 ELSE -1 END AS sgn,
       CASE WHEN isnan(postfit) THEN 0 WHEN isinf(postfit) THEN CASE WHEN postfit > 0 THEN 1 ELSE -1 END WHEN postfit = 0 THEN 0
            ELSE CAST(ceil(ln(abs(postfit)) / ln(1.01 / 0.99)) AS INTEGER) END AS bucket,
       count(*) AS n
FROM residual WHERE postfit IS NOT NULL GROUP BY ALL
"""

SQL = {
    "p1_daily_sketch": _P1_SKETCH.replace("SELECT sig, sat,", "SELECT sig, sat, CAST(CAST(datetime AS DATE) AS VARCHAR) AS day,"),
    "p1_sketch": _P1_SKETCH,
    "p1_percentiles": f"""
WITH s AS ({_P1_SKETCH}), f AS (SELECT * FROM s WHERE sgn IS NOT NULL),
c AS (SELECT *, sum(n) OVER (PARTITION BY sig, sat ORDER BY sgn * (bucket + 1000000) ROWS UNBOUNDED PRECEDING) AS hi, sum(n) OVER (PARTITION BY sig, sat) AS t FROM f),
k AS (SELECT c.*, q.p FROM c, (SELECT unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS p) q WHERE floor(q.p::DOUBLE * (t - 1)) < hi AND floor(q.p::DOUBLE * (t - 1)) >= hi - n)
SELECT sig, sat, CAST(t AS BIGINT) AS n, CAST(p AS DOUBLE) AS p,
       round(CASE WHEN sgn = 0 THEN 0 ELSE sgn * 2 * pow(1.01 / 0.99, bucket) / (1.01 / 0.99 + 1) END, 9) AS estimate,
       round(CASE WHEN sgn > 0 THEN pow(1.01 / 0.99, bucket) / (1.01 / 0.99) WHEN sgn < 0 THEN -pow(1.01 / 0.99, bucket) ELSE 0 END, 9) AS lower,
       round(CASE WHEN sgn > 0 THEN pow(1.01 / 0.99, bucket) WHEN sgn < 0 THEN -pow(1.01 / 0.99, bucket) / (1.01 / 0.99) ELSE 0 END, 9) AS upper
FROM k
""",
    "p2_found": """
WITH b AS (SELECT min(bern_id) AS bern_id, site, datetime FROM trop_bern WHERE regexp_matches(trim(ZTD), '^[+-]?[.]?[0-9]')
           GROUP BY site, agency, datetime, Decimal_year, Year, DOY, Month, Day, Hour, Minute, ZTD, std, unit),
p AS (SELECT pea_id, site, coalesce(epoch_us(datetime), (315964800 + gpswk::BIGINT * 604800) * 1000000 + round(seconds * 1e6)::BIGINT) AS t FROM trop_pea WHERE trop_value IS NOT NULL),
j AS (SELECT bern_id, pea_id, row_number() OVER (PARTITION BY bern_id ORDER BY abs(p.t - epoch_us(b.datetime)), p.t, pea_id) AS k
      FROM b JOIN p ON b.site = p.site AND p.t BETWEEN epoch_us(b.datetime) - 150000000 AND epoch_us(b.datetime) + 150000000)
SELECT bern_id, pea_id FROM j WHERE k = 1
""",
}
