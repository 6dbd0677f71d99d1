"""Epoch synchronisation rules, in batch and as a watermarked stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import micros


def tolerance(interval_s: float, wanted_s: float) -> float:
    """A tolerance is at most half the interval."""
    return min(wanted_s, interval_s / 2)


def classify(df: DataFrame, time: str, interval_s: float, tolerance_s: float, start_us: int = 0) -> DataFrame:
    """Adds epoch_us (the nearest epoch, later on a tie), within (inside the tolerance) and class CURRENT, PAST (before it) or FUTURE."""
    step, tol = int(interval_s * 1e6), int(tolerance(interval_s, tolerance_s) * 1e6)
    t = micros(time)
    ep = F.floor((t - start_us + step / 2) / step) * step + start_us
    x = df.withColumn("epoch_us", ep)
    off = t - F.col("epoch_us")
    return x.withColumn("within", F.abs(off) <= tol).withColumn("class", F.when(F.abs(off) <= tol, "CURRENT").when(off < 0, "PAST").otherwise("FUTURE"))


def infer_interval(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """(keys, interval_s): the smallest positive step between rows."""
    w = Window.partitionBy(*keys).orderBy(time)
    d = df.select(*keys, (micros(time) - F.lag(micros(time)).over(w)).alias("_d"))
    return d.groupBy(*keys).agg((F.min(F.when(F.col("_d") > 0, F.col("_d"))) / 1e6).alias("interval_s"))


def periodic_reset(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], interval_s: float) -> DataFrame:
    """Adds reset: a multiple of the interval was reached or crossed since the row before."""
    step = interval_s * 1e6
    prev = F.lag(micros(time)).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("reset", F.coalesce(F.floor(micros(time) / step) > F.floor(prev / step), F.lit(False)))


def specific_reset(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], second_of_day: float) -> DataFrame:
    """Adds reset: that time of day was reached or crossed since the row before, midnight included."""
    day, at = 86_400_000_000, int(second_of_day * 1e6)
    prev = F.lag(micros(time)).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("reset", F.coalesce(F.floor((micros(time) - at) / day) > F.floor((prev - at) / day), F.lit(False)))


def epoch_stream(stream: DataFrame, time: str, interval_s: float, tolerance_s: float, latency_s: float, by: Sequence[str], value: str) -> DataFrame:
    """Per epoch and key the rows within tolerance, emitted once the watermark (the latency allowed) has passed; later rows are PAST and left out."""
    x = classify(stream.withWatermark(time, f"{latency_s} seconds"), time, interval_s, tolerance_s).where("within")
    half = int(interval_s * 500)
    win = F.window(F.col(time), f"{int(interval_s * 1000)} milliseconds", startTime=f"{half} milliseconds")
    return x.groupBy(win, *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select((F.col("window.end").cast("timestamp") - F.expr(f"INTERVAL {half / 1000} SECOND")).alias("epoch"), *by, "n", "mean")
