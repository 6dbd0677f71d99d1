"""Pairing records of one entity by nearest time within a tolerance.

Tick expansion: every right record is copied to each tick of the left side's coarse clock within the tolerance, the
nearest per (entity, tick) is kept by a map-side combined aggregate, and left records meet it by an equi-join on
(entity, tick). No pair is formed that is not a result, and a hot entity is spread over its ticks.
Left records off the clock's ticks go the exact way for them: both sides share time cells, and the neighbours
before and after are found within a cell, whose rows are bounded by its length. A caller that has seen that no such record
exists says so, and that way is not planned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_delivery(df: DataFrame, id_col: str, content: Sequence[str]) -> DataFrame:
    """Of rows with equal content only the smallest id."""
    return df.groupBy(*content).agg(F.min(id_col).alias(id_col))


def _signed(code: Column) -> Column:
    """Right minus left time of a code: twice the distance, plus one where the right record is the later."""
    return F.when(F.pmod(code, F.lit(2)) == 1, F.floor(code / 2)).otherwise(-F.floor(code / 2))


def nearest(
    left: DataFrame, right: DataFrame, entity: str, left_id: str, right_id: str, left_us: str, right_us: str, tolerance_s: float, tick_s: float = 60.0, on_ticks: bool = False
) -> DataFrame:
    """(left_id, right_id, dt_us): each left record with the nearest right record of its entity at most tolerance_s away.

    Times are long microseconds. The earlier right record wins a tie, then the smaller id. Left records without a partner, and
    rows with a null entity or time, are left out. Several left records may share a partner. Empty sides give no rows.
    ``on_ticks`` says that every left time lies on a tick (the caller has looked), so the way for other times is not planned.
    """
    tol, tick = int(round(tolerance_s * 1e6)), int(round(tick_s * 1e6))
    l = left.where(F.col(entity).isNotNull() & F.col(left_us).isNotNull()).select(F.col(entity).alias("_e"), F.col(left_id).alias("_lid"), F.col(left_us).alias("_lt"))
    r = right.where(F.col(entity).isNotNull() & F.col(right_us).isNotNull()).select(F.col(entity).alias("_e"), F.col(right_id).alias("_rid"), F.col(right_us).alias("_rt"))
    on = F.pmod(F.col("_lt"), F.lit(tick)) == 0

    ticks = r.withColumn("_k", F.explode(F.sequence(F.ceil((F.col("_rt") - tol) / tick), F.floor((F.col("_rt") + tol) / tick))))
    dt = F.col("_rt") - F.col("_k") * tick
    code = 2 * F.abs(dt) + (dt > 0).cast("long")
    kept = ticks.groupBy("_e", "_k").agg(F.min(F.struct(code.alias("c"), F.col("_rid").alias("rid"))).alias("best"))
    direct = (l if on_ticks else l.where(on)).withColumn("_k", F.floor(F.col("_lt") / tick)).join(kept, ["_e", "_k"])
    out = direct.select(F.col("_lid").alias(left_id), F.col("best.rid").alias(right_id), _signed(F.col("best.c")).alias("dt_us"))
    if on_ticks:
        return out

    off = l.where(~on)
    cell = max(4 * tol, tick)
    copies = r.withColumn("_c", F.explode(F.sequence(F.floor((F.col("_rt") - tol) / cell), F.floor((F.col("_rt") + tol) / cell))))
    both = off.select("_e", F.floor(F.col("_lt") / cell).alias("_c"), F.col("_lt").alias("_t"), "_lid", F.lit(None).cast(r.schema["_rid"].dataType).alias("_rid")).unionByName(
        copies.select("_e", "_c", F.col("_rt").alias("_t"), F.lit(None).cast(l.schema["_lid"].dataType).alias("_lid"), "_rid")
    )
    # at equal times the smallest right id lies next to the left row on either side
    w = Window.partitionBy("_e", "_c")
    rec = F.when(F.col("_rid").isNotNull(), F.struct(F.col("_t").alias("t"), F.col("_rid").alias("id")))
    back = F.last(rec, ignorenulls=True).over(w.orderBy("_t", F.col("_rid").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    fwd = F.first(rec, ignorenulls=True).over(w.orderBy("_t", F.col("_rid").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing))
    near = both.withColumn("_b", back).withColumn("_f", fwd).where(F.col("_lid").isNotNull())
    sides = [F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["t"] - F.col("_t")).alias("d"), F.col(c)["t"].alias("rt"), F.col(c)["id"].alias("rid"))) for c in ("_b", "_f")]
    cand = F.array_min(F.filter(F.array(*sides), lambda x: x.isNotNull()))
    exact = near.withColumn("best", cand).where(F.col("best.d") <= tol)
    return out.unionByName(exact.select(F.col("_lid").alias(left_id), F.col("best.rid").alias(right_id), (F.col("best.rt") - F.col("_t")).alias("dt_us")))
