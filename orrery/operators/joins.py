"""Time-valid joins: as-of families, straddles, interpolation, validity intervals, fallbacks and code chains.

As-of joins tag and union both sides and carry the last right row forward in one window, so no pair is formed
that is not a result. With ``bucket_s`` a key is cut into time buckets, each opened by the right row carried in from the
buckets before it, so a hot key is spread over its buckets and the carrying works on one row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import checkpointed, micros


def _us(c: str, df: DataFrame) -> Column:
    return micros(c) if df.schema[c].dataType.typeName().startswith("timestamp") else F.col(c).cast("long")


def asof_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, direction: str = "backward",
    max_age_s: float | None = None, bucket_s: float | None = None, order: Sequence[str] = (), delay_s: float = 0.0,
) -> DataFrame:
    """Every left row with one right row as struct ``right`` (null where none fits).

    'backward' takes the newest right row at or before the left time (less delay_s, the time until a row is available),
    'forward' the first at or after it, 'nearest' the nearer one (the earlier on a tie). Right rows at one time stand in the order of
    ``order``: the last for backward, the first for forward. max_age_s bounds the distance, both ends included.
    """
    if direction == "nearest":
        b = asof_join(left, right, on, left_time, right_time, "backward", max_age_s, bucket_s, order, delay_s).withColumnRenamed("right", "_b")
        n = asof_join(b, right, on, left_time, right_time, "forward", max_age_s, bucket_s, order, delay_s)
        at = _us(left_time, left)
        back = at - _field_us("_b", right_time, right)
        fwd = _field_us("right", right_time, right) - at
        pick = F.when(F.col("right").isNull() | (back <= fwd), F.col("_b")).otherwise(F.col("right"))
        return n.withColumn("right", pick).drop("_b")
    back = direction == "backward"
    us = 1_000_000
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(on)]
    k = [f"_k{i}" for i in range(len(on))]
    lt = _us(left_time, left) - int(delay_s * us) * (1 if back else -1)
    rt = _us(right_time, right)
    l = left.select(*keys, lt.alias("_t"), F.struct(*left.columns).alias("_l"))
    r = right.where(F.col(right_time).isNotNull()).select(*keys, rt.alias("_t"), F.struct(*[F.col(c) for c in order]).alias("_o") if order else F.lit(0).alias("_o"), F.struct(*right.columns).alias("_r"))
    part = list(k)
    if bucket_s:
        size = int(bucket_s * us)
        l, r = (x.withColumn("_b", F.floor(F.col("_t") / size)) for x in (l, r))
        edge = r.groupBy(*k, "_b").agg((F.max_by if back else F.min_by)(F.struct("_t", "_o", "_r"), F.struct("_t", "_o")).alias("_e"))
        want = _full(l.select(*k, "_b").distinct(), edge, [*k, "_b"])
        w = Window.partitionBy(*k).orderBy("_b") if k else Window.orderBy("_b")
        carry = F.last("_e", True).over(w.rowsBetween(Window.unboundedPreceding, -1)) if back else F.first("_e", True).over(w.rowsBetween(1, Window.unboundedFollowing))
        opened = want.withColumn("_c", carry).where("_c IS NOT NULL").select(*k, F.col("_c._t").alias("_t"), F.col("_c._o").alias("_o"), F.col("_c._r").alias("_r"), "_b")
        r = r.unionByName(opened)
        part.append("_b")
    rtype, ltype, otype = r.schema["_r"].dataType, l.schema["_l"].dataType, r.schema["_o"].dataType
    both = r.withColumn("_l", F.lit(None).cast(ltype)).unionByName(l.withColumn("_r", F.lit(None).cast(rtype)).withColumn("_o", F.lit(None).cast(otype)))
    side = F.col("_l").isNotNull().cast("int")
    if back:
        w = Window.partitionBy(*part).orderBy("_t", side, "_o").rowsBetween(Window.unboundedPreceding, 0)
        hit = F.last(F.when(F.col("_l").isNull(), F.struct("_t", "_r")), True).over(w)
    else:
        w = Window.partitionBy(*part).orderBy("_t", side.desc(), "_o").rowsBetween(0, Window.unboundedFollowing)
        hit = F.first(F.when(F.col("_l").isNull(), F.struct("_t", "_r")), True).over(w)
    out = both.withColumn("_h", hit).where(F.col("_l").isNotNull())
    fits = F.lit(True) if max_age_s is None else F.abs(F.col("_t") - F.col("_h._t")) <= int(max_age_s * us)
    return out.select("_l.*", F.when(fits, F.col("_h._r")).alias("right"))


def _full(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join in which null keys meet."""
    both = a.withColumn("_e", F.lit(None).cast(b.schema["_e"].dataType)).unionByName(b)
    return both.groupBy(*keys).agg(F.first("_e", True).alias("_e"))


def _field_us(struct: str, field: str, df: DataFrame) -> Column:
    c = F.col(struct)[field]
    return F.unix_micros(c.cast("timestamp")) if df.schema[field].dataType.typeName().startswith("timestamp") else c.cast("long")


def asof_fallback(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, max_age_s: float, bucket_s: float | None = None) -> DataFrame:
    """Backward as-of within max_age_s; where nothing fits, the first later row within it."""
    b = asof_join(left, right, on, left_time, right_time, "backward", max_age_s, bucket_s).withColumnRenamed("right", "_b")
    return asof_join(b, right, on, left_time, right_time, "forward", max_age_s, bucket_s).withColumn("right", F.coalesce("_b", "right")).drop("_b")


def straddle(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, value: str, same: str | None = None, max_gap_s: float | None = None, bucket_s: float | None = None) -> DataFrame:
    """Linear interpolation of a right value between the rows before and after each left time.

    Adds before, after (values), interpolated and share. A right row at exactly the left time is used alone. Pairs that disagree in ``same``
    (an issue number) or lie more than max_gap_s apart give null.
    """
    b = asof_join(left, right, on, left_time, right_time, "backward", None, bucket_s).withColumnRenamed("right", "_b")
    n = asof_join(b, right, on, left_time, right_time, "forward", None, bucket_s).withColumnRenamed("right", "_n")
    t0, t1, t = _field_us("_b", right_time, right), _field_us("_n", right_time, right), _us(left_time, left)
    exact = t0 == t
    ok = F.col("_b").isNotNull() & F.col("_n").isNotNull()
    if same:
        ok = ok & (F.col("_b")[same] == F.col("_n")[same])
    if max_gap_s is not None:
        ok = ok & (t1 - t0 <= int(max_gap_s * 1_000_000))
    share = (t - t0) / (t1 - t0)
    v0, v1 = F.col("_b")[value], F.col("_n")[value]
    return (
        n.withColumn("before", v0).withColumn("after", v1)
        .withColumn("share", F.when(exact, 0.0).when(ok, share))
        .withColumn("interpolated", F.when(exact, v0).when(ok, v0 + (v1 - v0) * share))
        .drop("_b", "_n")
    )


def neighbours(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, right_time: str, value: str, before: int, after: int, window_s: float, bucket_s: float) -> DataFrame:
    """Left rows with ``points``: up to before + after right (t, v) pairs around their time, in time order, within window_s.

    Rights are copied to the buckets their window touches; a bucket is at least as long as the window.
    """
    size, win = int(bucket_s * 1e6), int(window_s * 1e6)
    l = left.withColumn("_t", _us(left_time, left)).withColumn("_b", F.floor(F.col("_t") / size))
    r = right.select(*on, _us(right_time, right).alias("_rt"), F.col(value).cast("double").alias("_v"))
    r = r.withColumn("_b", F.explode(F.sequence(F.floor((F.col("_rt") - win) / size), F.floor((F.col("_rt") + win) / size))))
    lists = r.groupBy(*on, "_b").agg(F.array_sort(F.collect_list(F.struct(F.col("_rt").alias("t"), F.col("_v").alias("v")))).alias("_p"))
    j = l.join(lists, [*on, "_b"], "left")
    lo = F.filter("_p", lambda p: (p["t"] <= F.col("_t")) & (p["t"] >= F.col("_t") - win))
    hi = F.filter("_p", lambda p: (p["t"] > F.col("_t")) & (p["t"] <= F.col("_t") + win))
    tail = F.when(F.size(lo) > before, F.slice(lo, F.size(lo) - before + 1, before)).otherwise(lo)
    return j.withColumn("points", F.concat(tail, F.slice(hi, 1, after))).drop("_b", "_p", "_t")


def neville(points: Column, t: Column) -> Column:
    """Polynomial through points (t, v) evaluated at t, as a column expression (barycentric form; null without points)."""
    def weight(p: Column) -> Column:
        return F.aggregate(points, F.lit(1.0), lambda acc, q: F.when(q["t"] == p["t"], acc).otherwise(acc * ((t - q["t"]) / (p["t"] - q["t"]))))

    return F.when(F.size(points) > 0, F.aggregate(F.transform(points, lambda p: p["v"] * weight(p)), F.lit(0.0), lambda a, x: a + x))


def valid_at(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, start: str, end: str, expired: str = "skip", bucket_s: float | None = None) -> DataFrame:
    """Backward as-of on a validity start. An entry whose end has passed is kept ('keep') or gives null ('skip'); a null end is open."""
    out = asof_join(left, right, on, left_time, start, "backward", None, bucket_s)
    if expired == "keep":
        return out
    t, e = _us(left_time, left), _field_us("right", end, right)
    return out.withColumn("right", F.when(e.isNull() | (t <= e), F.col("right")))


def interval_first(left: DataFrame, right: DataFrame, on: Sequence[str], left_time: str, start: str, end: str, rank: str, bucket_s: float) -> DataFrame:
    """The first right row by ``rank`` with start <= time <= end (null end open). Intervals are copied to the buckets they touch, up to the left side's last."""
    size = int(bucket_s * 1e6)
    l = left.withColumn("_t", _us(left_time, left)).withColumn("_b", F.floor(F.col("_t") / size)).withColumn("_id", F.struct(*left.columns))
    last = l.agg(F.max("_t"), F.min("_t")).first()
    if last[0] is None:
        return left.withColumn("right", F.lit(None).cast(right.select(F.struct(*right.columns)).schema[0].dataType))
    r = right.select(*on, F.greatest(_us(start, right), F.lit(last[1])).alias("_s"), F.least(F.coalesce(_us(end, right), F.lit(last[0])), F.lit(last[0])).alias("_e"), F.struct(*right.columns).alias("_r")).where("_s <= _e")
    r = r.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / size), F.floor(F.col("_e") / size))))
    j = l.join(r, [*on, "_b"], "left").where("_r IS NULL OR (_t BETWEEN _s AND _e)")
    best = j.groupBy("_id").agg(F.min_by("_r", F.col("_r")[rank]).alias("right"))
    rest = l.join(best, "_id", "left")
    return rest.select(*left.columns, "right")


def priority_coalesce(base: DataFrame, sources: Sequence[DataFrame], on: Sequence[str], value: str) -> DataFrame:
    """``value`` from the first listed source that has it, and ``source`` its position (1-based)."""
    out = base
    for i, s in enumerate(sources):
        out = out.join(s.select(*on, F.col(value).alias(f"_v{i}")), list(on), "left")
    cols = [F.col(f"_v{i}") for i in range(len(sources))]
    which = F.coalesce(*[F.when(c.isNotNull(), i + 1) for i, c in enumerate(cols)])
    return out.select(*base.columns, F.coalesce(*cols).alias(value), which.alias("source"))


def merge_outer(a: DataFrame, b: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Union of both sides' keys; b's values that are neither null nor NaN win."""
    r = b.select(*on, *[F.when(~F.isnan(F.col(v).cast("double")), F.col(v)).alias(f"_{v}") for v in values])
    j = a.join(r, list(on), "full_outer")
    return j.select(*on, *[F.coalesce(f"_{v}", v).alias(v) for v in values])


def difference(a: DataFrame, b: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """a - b at equal keys; values only a has are kept."""
    r = b.select(*on, *[F.col(v).alias(f"_{v}") for v in values if v in b.columns])
    return a.join(r, list(on)).select(*on, *[(F.col(v) - F.col(f"_{v}") if v in b.columns else F.col(v)).alias(v) for v in values])


def match_three(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys of both sides with side 'both', 'left' or 'right'."""
    x = a.select(*on).distinct().withColumn("_a", F.lit(1)).join(b.select(*on).distinct().withColumn("_b", F.lit(1)), list(on), "full_outer")
    return x.select(*on, F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "both").when(F.col("_a").isNotNull(), "left").otherwise("right").alias("side"))


def chain_lookup(edges: DataFrame, src: str, dst: str, value: str, var: str, max_hops: int | None = None, group: Sequence[str] = ()) -> DataFrame:
    """(group..., src, dst, value, var, hops, path): sums along code chains, an edge usable both ways (value negated backwards).

    Per pair the chain of fewest hops stands, then the first path in code order. Frontiers grow by self-joins and stop when nothing new is reached; ``max_hops`` is a rule where one is wanted.
    """
    g = list(group)
    one = edges.select(*g, F.col(src).alias("a"), F.col(dst).alias("b"), F.col(value).alias("v"), F.col(var).alias("r"))
    both = one.unionByName(one.select(*g, F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("v")).alias("v"), "r"))
    w = Window.partitionBy(*g, "a", "b").orderBy("hops", "path", "v")

    def best(x: DataFrame) -> DataFrame:
        return x.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")

    known = best(both.where("a <> b").select(*g, "a", "b", "v", "r", F.lit(1).alias("hops"), F.array("a", "b").alias("path")))
    front = known
    step = both.select(*g, F.col("a").alias("b"), F.col("b").alias("c"), F.col("v").alias("v2"), F.col("r").alias("r2"))
    hops = 1
    while max_hops is None or hops < max_hops:
        hops += 1
        grown = front.join(step, [*g, "b"]).where(~F.array_contains("path", F.col("c")))
        grown = best(grown.select(*g, "a", F.col("c").alias("b"), (F.col("v") + F.col("v2")).alias("v"), (F.col("r") + F.col("r2")).alias("r"), (F.col("hops") + 1).alias("hops"), F.concat("path", F.array("c")).alias("path")))
        front = checkpointed(grown.join(known.select(*g, "a", "b"), [*g, "a", "b"], "left_anti"))
        if front.isEmpty():
            break
        known = checkpointed(known.unionByName(front))
    return known.select(*g, F.col("a").alias("src"), F.col("b").alias("dst"), F.col("v").alias("value"), F.col("r").alias("var"), "hops", "path")


def inherit_options(levels: DataFrame, entity: str, level: str, fields: Sequence[str]) -> DataFrame:
    """One row per entity: each field from the deepest level that sets it (levels ascend from global to specific)."""
    return levels.groupBy(entity).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(level))).alias(f) for f in fields])


def metadata_priority(candidates: DataFrame, entity: str, source: str, value: str, priorities: Sequence[str]) -> DataFrame:
    """(entity, value, source, sources): the value of the listed source of highest priority (first listed), and all listed contributors. Absent values and unlisted sources are ignored."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priorities]), F.col(source)).cast("int")
    ok = candidates.withColumn("_p", rank).where((F.col("_p") > 0) & F.col(value).isNotNull() & (F.col(value).cast("string") != ""))
    return ok.groupBy(entity).agg(F.min_by(value, F.struct("_p", value)).alias(value), F.min_by(source, "_p").alias(source), F.array_sort(F.collect_set(source)).alias("sources"))


def in_region(points: DataFrame, regions: DataFrame, cell_deg: float = 5.0) -> DataFrame:
    """Pairs of points (lat, lon) and regions (lat0, lat1, lon0, lon1) that contain them; regions are copied to the grid cells they touch."""
    def cells(lo: str, hi: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(lo) / cell_deg), F.floor(F.col(hi) / cell_deg)))

    r = regions.withColumn("_ci", cells("lat0", "lat1")).withColumn("_cj", cells("lon0", "lon1"))
    p = points.withColumn("_ci", F.floor(F.col("lat") / cell_deg)).withColumn("_cj", F.floor(F.col("lon") / cell_deg))
    return p.join(r, ["_ci", "_cj"]).where("lat BETWEEN lat0 AND lat1 AND lon BETWEEN lon0 AND lon1").drop("_ci", "_cj")
