"""Irregular readings onto a regular grid, with gaps filled or marked.

Readings are first folded into one row per (source, slot): the first and the last usable reading of
the slot, a map-side combined aggregate that bounds every later window by the number of grid slots,
not of readings. Each occupied slot then meets the previous occupied one (as-of merge on both sides):
a source is cut into stretches of ``STRETCH`` slots, a window holds one stretch, and a stretch's first slot gets its
predecessor from the last slots of the earlier stretches, of which there is one row each. The slots between a pair are generated
from it alone, stretch by stretch, so no dense grid is joined and no array holds more than a stretch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.session import micros

#: Slots of one window; at ten minutes a slot four weeks.
STRETCH = 4096
FILLED, GAP, READ = "filled", "gap", "reading"


def regular_grid(
    df: DataFrame,
    source: str = "site",
    time_col: str = "Time",
    fields: Sequence[str] = ("dN", "dE", "dU"),
    step_s: int = 600,
    max_gap_s: int | None = 3600,
) -> DataFrame:
    """(source, slot_s, status, gap_s, one column per field) for every slot from a source's first to its last usable reading.

    A reading is usable when its time and all fields are present and not NaN. Slots are aligned to midnight; slot_s is the
    slot's start in seconds since 1970-01-01. Each field is interpolated linearly in time at the slot's start between the
    last reading at or before it and the first at or after it. status: 'reading' where the slot holds a usable reading,
    'filled' where it holds none but the neighbours are at most max_gap_s apart, 'gap' where they are farther (fields
    null). The first slot has no earlier neighbour: it takes its first reading. Readings at one time are averaged only by the
    choice of the smallest field values (repeated deliveries agree). A null source is a source; an empty table gives no rows.
    """
    step = step_s * 1_000_000
    t = micros(time_col)
    usable = t.isNotNull()
    for f in fields:
        usable = usable & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    reading = F.struct(t.alias("t"), *[F.col(f).cast("double").alias(f"v{i}") for i, f in enumerate(fields)])
    slots = (
        df.where(usable)
        .select(F.col(source).alias("_src"), F.floor(t / step).alias("_slot"), reading.alias("_r"))
        .groupBy("_src", "_slot")
        .agg(F.min("_r").alias("_first"), F.max("_r").alias("_last"))
    )
    slots = slots.withColumn("_c", F.floor(F.col("_slot") / STRETCH))
    w = Window.partitionBy("_src", "_c").orderBy("_slot")
    ends = slots.groupBy("_src", "_c").agg(F.max(F.struct(F.col("_slot").alias("s"), F.col("_last").alias("r"))).alias("_e"))
    before = ends.select(F.col("_src").alias("_bs"), F.col("_c").alias("_bc"), F.lag("_e").over(Window.partitionBy("_src").orderBy("_c")).alias("_b"))
    pair = slots.select("_src", "_c", "_slot", "_first", F.lag(F.struct(F.col("_slot").alias("s"), F.col("_last").alias("r"))).over(w).alias("_in"))
    pair = pair.join(before, F.col("_src").eqNullSafe(F.col("_bs")) & (F.col("_c") == F.col("_bc")), "left").withColumn("_e", F.coalesce("_in", "_b"))
    pair = pair.select("_src", "_slot", "_first", F.col("_e.s").alias("_ps"), F.col("_e.r").alias("_p")).withColumn("_from", F.coalesce(F.col("_ps") + 1, F.col("_slot")))
    parts = pair.withColumn("_a", F.explode(F.sequence("_from", "_slot", F.lit(STRETCH))))
    grid = parts.withColumn("_s", F.explode(F.sequence("_a", F.least(F.col("_a") + (STRETCH - 1), F.col("_slot")))))
    at = F.col("_s") * F.lit(step)
    gap = F.col("_first.t") - F.col("_p.t")
    near = F.lit(True) if max_gap_s is None else gap <= max_gap_s * 1_000_000
    share = (at - F.col("_p.t")) / gap
    status = F.when(F.col("_s") == F.col("_slot"), READ).when(near, FILLED).otherwise(GAP)
    values = []
    for i, f in enumerate(fields):
        a, b = F.col(f"_p.v{i}"), F.col(f"_first.v{i}")
        values.append(F.when(F.col("_p").isNull(), b).when(near, F.when(gap == 0, b).otherwise(a + (b - a) * share)).alias(f))
    return grid.select(F.col("_src").alias(source), (F.col("_s") * step_s).cast("long").alias("slot_s"), status.alias("status"), (gap / 1e6).alias("gap_s"), *values)
