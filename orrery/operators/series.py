"""Per-series window operators. Series keys are the partition, so a window holds one series; order columns carry a tie-break."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import micros


def _real(v: str) -> Column:
    """The value, NaN as null."""
    c = F.col(v).cast("double")
    return F.when(~F.isnan(c), c)


def last_iteration(df: DataFrame, keys: Sequence[str], iteration: str, tie: Sequence[str] = ()) -> DataFrame:
    """The row of the highest iteration per key (the last by ``tie``), by a map-side combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(iteration, *tie)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, "_r.*").select(*df.columns)


def jump(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, threshold: float) -> DataFrame:
    """Adds previous, delta and slip: |value - previous| > threshold; zero, null and NaN values are no values and leave the previous as it was."""
    v = F.when(_real(value) != 0, _real(value))
    w = Window.partitionBy(*keys).orderBy(*order)
    prev = F.last(v, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.withColumn("previous", prev).withColumn("delta", F.when(v.isNotNull(), v - F.col("previous")))
    return d.withColumn("slip", F.coalesce(F.abs("delta") > threshold, F.lit(False)))


def slip_lli(lli: str, phase: str) -> Column:
    """Loss of lock flagged on a present phase."""
    return F.coalesce((F.col(lli).bitwiseAND(3) != 0) & (F.col(phase) != 0), F.lit(False))


def last_event(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, time: str) -> DataFrame:
    """Adds last_event: the newest time at or before the row at which the flag was set."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("last_event", F.max(F.when(F.col(flag), F.col(time))).over(w))


def arcs(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], gap_s: float, breaks: Column | None = None) -> DataFrame:
    """Adds gap_s (to the row before), starts (a gap or a break) and arc (0-based number of the arc)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    gap = (micros(time) - F.lag(micros(time)).over(w)) / 1e6
    x = df.withColumn("gap_s", gap)
    start = F.coalesce(F.col("gap_s") > gap_s, F.lit(False))
    if breaks is not None:
        start = start | F.coalesce(breaks, F.lit(False))
    x = x.withColumn("starts", start)
    return x.withColumn("arc", F.sum(F.col("starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def break_rows(df: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], gap_s: float) -> DataFrame:
    """The rows and, after each that a gap follows, a row 1 ms later whose values are null. Marked by is_break."""
    w = Window.partitionBy(*keys).orderBy(time)
    gap = (F.lead(micros(time)).over(w) - micros(time)) / 1e6
    own = df.withColumn("_g", gap)
    blank = own.where(F.col("_g") > gap_s).withColumn(time, (F.col(time).cast("timestamp") + F.expr("INTERVAL 0.001 SECOND")).cast(df.schema[time].dataType))
    blank = blank.withColumns({v: F.lit(None).cast(df.schema[v].dataType) for v in values}).withColumn("is_break", F.lit(True))
    return own.withColumn("is_break", F.lit(False)).unionByName(blank).drop("_g")


def join_singletons(df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], gap_s: float) -> DataFrame:
    """Arcs as by ``arcs``, but a lone row between two gaps joins the nearer side."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = (micros(time) - F.lag(micros(time)).over(w)) / 1e6
    after = (F.lead(micros(time)).over(w) - micros(time)) / 1e6
    x = df.withColumn("_b", before).withColumn("_a", after)
    lone = (F.col("_b") > gap_s) & (F.col("_a") > gap_s)
    x = x.withColumn("_lone", lone).withColumn("_joins_next", lone & (F.col("_a") < F.col("_b")))
    start = F.when(F.col("_lone"), F.col("_joins_next")).when(F.lag("_joins_next").over(w), False).when(F.col("_b").isNull(), False).otherwise(F.col("_b") > gap_s)
    x = x.withColumn("starts", start)
    return x.withColumn("arc", F.sum(F.coalesce(F.col("starts").cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b", "_a", "_lone", "_joins_next")


def demean(df: DataFrame, by: Sequence[str], value: str, out: str = "demeaned") -> DataFrame:
    """value - mean over ``by`` (a series or an epoch), NaN and null left out. The mean is an aggregate joined back, so a hot group is combined map side."""
    m = df.groupBy(*by).agg(F.avg(_real(value)).alias("_m"))
    return df.join(m, list(by), "left").withColumn(out, F.col(value) - F.col("_m")).drop("_m")


def remove_weighted_mean(df: DataFrame, by: Sequence[str], value: str, sigma: str, out: str = "reduced") -> DataFrame:
    """value minus the mean weighted by 1 / sigma^2; a missing or zero sigma weighs 1."""
    s = _real(sigma)
    w = F.when(s.isNotNull() & (s != 0), 1 / (s * s)).otherwise(1.0)
    ok = _real(value).isNotNull()
    m = df.groupBy(*by).agg((F.sum(F.when(ok, w * F.col(value))) / F.sum(F.when(ok, w))).alias("_m"))
    return df.join(m, list(by), "left").withColumn(out, F.col(value) - F.col("_m")).drop("_m")


def detrend(df: DataFrame, by: Sequence[str], time: str, value: str, out: str = "detrended") -> DataFrame:
    """value minus the least-squares line over seconds since the group's first epoch; adds slope and intercept."""
    t = micros(time)
    first = df.groupBy(*by).agg(F.min(t).alias("_t0"))
    x = df.join(first, list(by), "left").withColumn("_x", (t - F.col("_t0")) / 1e6)
    fit = x.groupBy(*by).agg(F.regr_slope(_real(value), F.col("_x")).alias("slope"), F.regr_intercept(_real(value), F.col("_x")).alias("intercept"))
    return x.join(fit, list(by), "left").withColumn(out, F.col(value) - (F.col("intercept") + F.col("slope") * F.col("_x"))).drop("_t0", "_x")


def decimate(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Each n-th row of a series, its first included."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where((F.col("_k") - 1) % n == 0).drop("_k")


def first_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """(keys, base): the first value of each series."""
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias("base"))


def cumulative_counts(df: DataFrame, keys: Sequence[str], time: str, kind: str, kinds: Sequence[str]) -> DataFrame:
    """Per key and time, the running count of each kind (0 before its first). Counts are aggregated before they are summed up."""
    per = df.groupBy(*keys, time).agg(*[F.count(F.when(F.col(kind) == k, 1)).alias(k) for k in kinds])
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return per.select(*keys, time, *[F.sum(k).over(w).alias(k) for k in kinds])


def residual_chain(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, var: str) -> DataFrame:
    """Adds chain and chain_var: running sums over a measurement's components, variances only where positive."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("chain", F.sum(value).over(w)).withColumn("chain_var", F.sum(F.when(F.col(var) > 0, F.col(var)).otherwise(0.0)).over(w))


def run_lengths(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str) -> DataFrame:
    """Adds run: how many consecutive rows up to this one have the flag set (0 where it is not)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    x = df.withColumn("_i", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sum(F.col(flag).cast("int")).over(Window.partitionBy(*keys, "_i").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("run", F.coalesce(run, F.lit(0))).drop("_i")


def outlier_mask(df: DataFrame, by: Sequence[str], value: str, k: float = 3.0) -> DataFrame:
    """Adds outlier: farther than k population standard deviations from the group's mean."""
    v = _real(value)
    s = df.groupBy(*by).agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_s"))
    return df.join(s, list(by), "left").withColumn("outlier", F.coalesce(F.abs(v - F.col("_m")) > k * F.col("_s"), F.lit(False))).drop("_m", "_s")


def trim_ends(df: DataFrame, time: str, minutes: float) -> DataFrame:
    """Rows at least so many minutes within the whole table's first and last epoch."""
    ends = df.agg(F.min(micros(time)).alias("_a"), F.max(micros(time)).alias("_z"))
    cut = int(minutes * 60_000_000)
    return df.crossJoin(F.broadcast(ends)).where((micros(time) >= F.col("_a") + cut) & (micros(time) <= F.col("_z") - cut)).drop("_a", "_z")


def sat_order(sat: str) -> list[Column]:
    """Natural order of satellite ids: constellation, then number."""
    return [F.substring(sat, 1, 1), F.substring(sat, 2, 9).try_cast("int")]
