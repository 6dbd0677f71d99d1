"""Mergeable percentiles with guaranteed relative error.

A value x falls into signed logarithmic bucket ceil(log_g |x|) with g = (1 + a) / (1 - a); the middle of its
bucket differs from x by at most the fraction a. A sketch is a plain table (keys, sign, bucket, count): sketches of
days, partitions or sources are combined by adding counts of equal buckets, which Spark does map side first, so a
hot group costs no more than any other. A group has at most a few thousand buckets over the whole double range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gamma(accuracy: float) -> float:
    return (1 + accuracy) / (1 - accuracy)


def bucket(v: Column, accuracy: float) -> Column:
    """Bucket number of |v|."""
    return F.ceil(F.log(F.abs(v)) / F.lit(math.log(gamma(accuracy)))).cast("int")


def sketch(df: DataFrame, keys: Sequence[str], value: str, accuracy: float = 0.01) -> DataFrame:
    """(keys..., sgn, bucket, n): counts per signed bucket; sgn 0 is exactly zero, any other value has a bucket.

    Nulls are not counted. NaN and infinities are counted apart with sgn null and bucket 0 (NaN), 1 (+inf) or -1 (-inf), so that
    merged sketches still tell them; they take no part in percentiles. Null keys are keys. An empty table gives an empty sketch.
    """
    v = F.col(value).cast("double")
    finite = ~F.isnan(v) & (F.abs(v) != float("inf"))
    sgn = F.when(finite, F.when(v == 0, 0).when(v > 0, 1).otherwise(-1))
    b = F.when(~finite, F.when(F.isnan(v), 0).when(v > 0, 1).otherwise(-1)).when(v == 0, 0).otherwise(bucket(v, accuracy))
    return df.where(v.isNotNull()).groupBy(*keys, sgn.alias("sgn"), b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the counts of matching buckets; keys may be fewer than the sketches have."""
    return sketches.groupBy(*keys, "sgn", "bucket").agg(F.sum("n").alias("n"))


def percentiles(merged: DataFrame, keys: Sequence[str], at: Sequence[float], accuracy: float = 0.01) -> DataFrame:
    """(keys..., n, p, estimate, lower, upper): each percentile's estimate and the bounds its true value lies within.

    The percentile p of n values is the one of rank floor(p (n - 1)) in ascending order. |estimate - true| <= accuracy |true|.
    """
    g = gamma(accuracy)
    order = F.col("sgn") * (F.col("bucket").cast("long") + 1_000_000)
    w = Window.partitionBy(*keys).orderBy("_o") if keys else Window.orderBy("_o")
    every = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    cum = merged.where("sgn IS NOT NULL").withColumn("_o", order)
    cum = cum.withColumn("_hi", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("n").over(every))
    ranks = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.floor(F.lit(float(p)) * (F.col("_n") - 1)).alias("k")) for p in at])
    hit = cum.select(*keys, "sgn", "bucket", "_n", F.explode(F.filter(ranks, lambda r: (r["k"] < F.col("_hi")) & (r["k"] >= F.col("_hi") - F.col("n")))).alias("r"))
    up = F.pow(F.lit(g), F.col("bucket"))
    near, far = up / g, up
    mid = F.col("sgn") * (2 * up / (g + 1))
    lower, upper = F.when(F.col("sgn") > 0, near).when(F.col("sgn") < 0, -far).otherwise(0.0), F.when(F.col("sgn") > 0, far).when(F.col("sgn") < 0, -near).otherwise(0.0)
    return hit.select(*keys, F.col("_n").alias("n"), F.col("r.p").alias("p"), F.when(F.col("sgn") == 0, 0.0).otherwise(mid).alias("estimate"), lower.alias("lower"), upper.alias("upper"))
