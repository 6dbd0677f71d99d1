"""Keyed state across micro-batches: a filter per key, expiry, and batch hooks. Batch results over the same rows are the same."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orrery.session import micros


def stateful_filter(stream: DataFrame, key: str, time: str, value: str, var: str, q: float, init_var: float = 1e6, outage_s: float | None = None, timeout_ms: int | None = None) -> DataFrame:
    """(key, t, x, p): a random-walk state per key carried across batches. Rows are taken in time order within a batch; a row older
    than the state is late and left out, an outage restarts the state, and a key idle for timeout_ms of processing time is dropped."""
    src = stream.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(key).alias("k"), (micros(time) / 1e6).alias("t"), F.col(value).cast("double").alias("y"), F.col(var).cast("double").alias("r"))
    kt = src.schema["k"].dataType.simpleString()

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        x, p, last, seen = state.get if state.exists else (0.0, init_var, 0.0, False)
        rows = []
        for row in pd.concat(list(frames)).sort_values(["t", "y"], kind="stable").itertuples(index=False):
            if seen and row.t < last:
                continue
            if not seen or (outage_s is not None and row.t - last > outage_s):
                x, p = 0.0, init_var
            else:
                p += q * (row.t - last)
            gain = p / (p + row.r)
            x, p, last, seen = x + gain * (row.y - x), (1 - gain) * p, row.t, True
            rows.append((k[0], row.t, x, p))
        state.update((float(x), float(p), float(last), bool(seen)))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(rows, columns=["k", "t", "x", "p"])

    out = src.groupBy("k").applyInPandasWithState(
        run, f"k {kt}, t double, x double, p double", "x double, p double, last double, seen boolean", "append",
        GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout,
    )
    return out.withColumnRenamed("k", key)


def latest_valid(stream: DataFrame, key: str, time: str, fields: Sequence[str], validity_s: float) -> DataFrame:
    """Corrections with the time they expire; downstream joins keep rows up to it. The watermark bounds what a join must hold."""
    return stream.withWatermark(time, f"{validity_s} seconds").select(key, time, *fields, (F.col(time) + F.expr(f"INTERVAL {validity_s} SECOND")).alias("expires"))


def valid_join(obs: DataFrame, corrections: DataFrame, key: str, time: str, c_time: str, late_s: float) -> DataFrame:
    """Stream-stream join of observations with corrections valid at their time; both sides are watermarked, so state is dropped as time passes."""
    o = obs.withWatermark(time, f"{late_s} seconds").alias("o")
    c = corrections.alias("c")
    return o.join(c, F.expr(f"o.{key} = c.{key} AND o.{time} >= c.{c_time} AND o.{time} <= c.expires"))


def expiry_counter(stream: DataFrame, key: str, time: str, bad: str, limit: int) -> DataFrame:
    """(key, t, count, expired): consecutive bad rows per key, reset by a good one; expired at the limit, after which counting begins anew."""
    src = stream.select(F.col(key).alias("k"), (micros(time) / 1e6).alias("t"), F.col(bad).cast("boolean").alias("b"))
    kt = src.schema["k"].dataType.simpleString()

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = []
        for row in pd.concat(list(frames)).sort_values("t", kind="stable").itertuples(index=False):
            n = n + 1 if row.b else 0
            done = n >= limit
            rows.append((k[0], row.t, n, done))
            n = 0 if done else n
        state.update((int(n),))
        yield pd.DataFrame(rows, columns=["k", "t", "count", "expired"])

    return src.groupBy("k").applyInPandasWithState(run, f"k {kt}, t double, count bigint, expired boolean", "n bigint", "append", GroupStateTimeout.NoTimeout).withColumnRenamed("k", key)


def each_batch(stream: DataFrame, hook: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Run a hook over every micro-batch; with ``once`` over what is there now, then stop."""
    w = stream.writeStream.foreachBatch(hook).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
