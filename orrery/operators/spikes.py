"""Spikes, stuck values and impossible readings, flagged per series.

Phase-space thresholding over one pass of shuffled rows. A series is cut into chunks of one
day, so a task holds at most one day of one series however hot the series is:

1. summary: robust ellipsoids over value, first and second differences despike each chunk, repeated until no
   new point falls outside; the chunk emits count, mean and sum of squares of what is left, a bounded set of
   weighted centroids of all its values and the runs of equal values touching its two ends;
2. merge: the despiked moments of a series' chunks give its first spread (of the usual chunk within, of chunk means between), the centroids its median, which
   is off by less than a 32nd of a chunk's values in rank (the size of a middle group); the edge runs are joined
   across chunks, so a run over midnight is counted whole;
3. spread: count, sum and sum of squares over all rows within k spreads, combined map side, repeated
   for the series whose limit still passes a value, so that the spread is exact however many spikes
   a chunk holds;
4. flag: the rows of a chunk meet the merged limits. The ellipsoids screen the epochs again, now about the
   series' median and spread; zero-difference runs and bounds catch the other faults.

An ellipsoid's value axis is sqrt(2 ln n) usual spreads, under 5 for a day of one-second epochs, so
everything beyond the final limit of ``k`` = 10 spreads is outside it and the exact check of that
limit only drops points, it never misses others. What it drops, jumps under that limit, is reported as 'phase' where asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import checkpointed, micros, sized

DAY_US = 86_400_000_000
CENTROIDS = 64
#: Chunks of fewer finite values have no ellipsoids of their own.
LEAST = 16


def _null_aware(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values (nulls as NaN) and the null mask; NaN and null stay distinct."""
    null = col.is_null().to_numpy(zero_copy_only=False) if isinstance(col, pa.Array) else np.asarray(col.is_null())
    return np.asarray(col.fill_null(np.nan), dtype=np.float64), np.asarray(null, dtype=bool)


def phase_space(v: np.ndarray, med: float, su: float, rounds: int = 8) -> np.ndarray:
    """True where a value lies outside the phase-space ellipsoids of a series with this median and spread.

    v is finite and in time order. Flagged values are bridged linearly before the next round.
    """
    n = len(v)
    if n < 5 or su == 0.0:
        return np.abs(v - med) > np.sqrt(2.0 * np.log(max(n, 5))) * su
    out = np.zeros(n, dtype=bool)
    lam = np.sqrt(2.0 * np.log(n))
    at = np.arange(n)
    for _ in range(rounds):
        keep = ~out
        if keep.sum() < 5:
            break
        u = (v if keep.all() else np.interp(at, at[keep], v[keep])) - med
        d1 = np.gradient(u)
        d2 = np.gradient(d1)
        s1, s2 = 1.4826 * float(np.median(np.abs(d1))), 1.4826 * float(np.median(np.abs(d2)))
        a, b, c = lam * su, lam * (s1 or su), lam * (s2 or su)
        # the tilt is that of the values no axis excludes: a few jumps would turn it
        calm = (np.abs(d1) <= b) & (np.abs(d2) <= c) & (np.abs(u) <= a)
        theta = np.arctan2(float(np.dot(u[calm], d2[calm])), float(np.dot(u[calm], u[calm]))) if calm.any() else 0.0
        ct, st = np.cos(theta), np.sin(theta)
        den = ct**4 - st**4
        p, q = a * a, c * c
        if abs(den) > 1e-9:
            p, q = max(((a * ct) ** 2 - (c * st) ** 2) / den, (0.2 * a) ** 2), max(((c * ct) ** 2 - (a * st) ** 2) / den, (0.2 * c) ** 2)
        r1, r2 = u * ct + d2 * st, -u * st + d2 * ct
        bad = ((u / a) ** 2 + (d1 / b) ** 2 > 1) | ((d1 / b) ** 2 + (d2 / c) ** 2 > 1) | (r1**2 / p + r2**2 / q > 1)
        new = bad & keep
        if not new.any():
            break
        out |= new
    return out


def _centroids(v: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most ``size`` centroids (count, mean, sum of squares about the mean) of sorted values, the tails kept singly."""
    v = np.sort(v)
    n = len(v)
    if n <= size:
        return np.ones(n), v, np.zeros(n)
    tail = size // 4
    cuts = np.unique(np.concatenate([np.arange(tail), np.linspace(tail, n - tail, size - 2 * tail + 1).astype(int), np.arange(n - tail, n)]))
    cnt = np.diff(np.append(cuts, n)).astype(float)
    mean = np.add.reduceat(v, cuts) / cnt
    m2 = np.add.reduceat((v - np.repeat(mean, cnt.astype(int))) ** 2, cuts)
    return cnt, mean, m2


def first_limits(cnt: np.ndarray, mean: np.ndarray, m2: np.ndarray) -> tuple[float, float]:
    """Median and first spread from centroids, by the median deviation; where that is zero, by the nearest 95 %."""
    order = np.argsort(mean, kind="stable")
    cnt, mean, m2 = cnt[order], mean[order], m2[order]
    cum = np.cumsum(cnt)
    half = cum[-1] / 2.0
    i = int(np.searchsorted(cum, half))
    med = float(mean[i] + mean[min(i + 1, len(mean) - 1)]) / 2 if cum[i] == half else float(mean[i])
    dev = np.abs(mean - med)
    by = np.argsort(dev, kind="stable")
    dc = np.cumsum(cnt[by])
    s = 1.4826 * float(dev[by][np.searchsorted(dc, half)])
    if s == 0.0:
        part = by[: int(np.searchsorted(dc, 0.95 * dc[-1])) + 1]
        s = float(np.sqrt((cnt[part] * dev[part] ** 2 + m2[part]).sum() / cnt[part].sum()))
    return med, s


def _middle(v: np.ndarray, weight: np.ndarray) -> float:
    """The weighted median."""
    order = np.argsort(v, kind="stable")
    cum = np.cumsum(weight[order])
    return float(v[order][np.searchsorted(cum, cum[-1] / 2)])


def series_limits(cnt: np.ndarray, mean: np.ndarray, m2: np.ndarray, k: float) -> tuple[float, float]:
    """Median and usual spread from centroids: the standard deviation of what lies within k spreads of the median."""
    med, s = first_limits(cnt, mean, m2)
    if s == 0.0:
        return med, 0.0
    dev = np.abs(mean - med)
    for _ in range(30):
        inside = dev <= k * s
        w = cnt[inside].sum()
        mu = float((cnt[inside] * mean[inside]).sum() / w)
        nxt = float(np.sqrt((cnt[inside] * (mean[inside] - mu) ** 2 + m2[inside]).sum() / w))
        if nxt == 0.0 or abs(nxt - s) <= 1e-9 * s:
            break
        s = nxt
    return med, s


def exact_spreads(rows: DataFrame, first: DataFrame, keys: Sequence[str], nf: int, k: float) -> DataFrame:
    """The keys and _sp0, _sp1, ...: standard deviations of the finite values of each series within k of these same spreads.

    first holds one row a series with _med and _sp of each field. Each round reads all rows of the series that
    aren't settled. A field is settled when k new spreads hold the same values as k old ones did, or when the
    limit would turn back, so each round but the last moves the limit past a value.
    """
    live = first
    for i in range(nf):
        sp = F.col(f"_sp{i}")
        live = live.withColumns({f"_on{i}": (sp > 0) & ~F.isnan(sp), f"_dir{i}": F.lit(0.0)})
    live, done = checkpointed(live), None
    out = [*keys, *[f"_sp{i}" for i in range(nf)]]
    open_ = F.lit(False)
    for i in range(nf):
        open_ = open_ | F.col(f"_on{i}")
    while True:
        settled = live.where(~open_).select(*out)
        done = settled if done is None else done.unionByName(settled)
        live = live.where(open_)
        if live.isEmpty():
            return done
        side = sized(live.withColumnsRenamed({c: f"_s{c}" for c in keys}))
        on = F.lit(True)
        for c in keys:
            on = on & F.col(c).eqNullSafe(F.col(f"_s{c}"))
        sums = []
        for i in range(nf):
            v, u = F.col(f"_f{i}"), F.col(f"_f{i}") - F.col(f"_med{i}")
            fin = F.col(f"_on{i}") & ~F.isnan(v) & (F.abs(v) < float("inf"))
            inside, limit = F.abs(u) <= k * F.col(f"_sp{i}"), F.abs(u)
            sums += [F.first(f"_{c}{i}").alias(f"_{c}{i}") for c in ("med", "sp", "on", "dir")]
            sums += [F.count(F.when(fin & inside, 1)).alias(f"_n{i}"), F.sum(F.when(fin & inside, u)).alias(f"_u{i}"), F.sum(F.when(fin & inside, u * u)).alias(f"_q{i}")]
            sums += [F.max(F.when(fin & inside, limit)).alias(f"_in{i}"), F.min(F.when(fin & ~inside, limit)).alias(f"_out{i}")]
        live = rows.join(side, on).groupBy(*keys).agg(*sums)
        for i in range(nf):
            n, q, sp, way = (F.col(f"_{c}{i}") for c in ("n", "q", "sp", "dir"))
            var = q / n - (F.col(f"_u{i}") / n) ** 2
            # values that are all equal have no spread but the first one
            nxt = F.when(F.col(f"_on{i}") & (n > 0) & (var > 1e-12 * q / n), F.sqrt(var)).otherwise(sp)
            same = (nxt == sp) | ((F.col(f"_in{i}") <= k * nxt) & F.coalesce(F.col(f"_out{i}") > k * nxt, F.lit(True)))
            turned = (way != 0) & (F.signum(nxt - sp) != way)
            live = live.withColumns({f"_sp{i}": nxt, f"_on{i}": F.col(f"_on{i}") & ~same & ~turned, f"_dir{i}": F.signum(nxt - sp)})
        live = checkpointed(live.select(*keys, *[f"_{c}{i}" for i in range(nf) for c in ("med", "sp", "on", "dir")]))


def _epochs(t: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order by time then id, and the positions in it where a new epoch begins."""
    order = np.lexsort((ids, t))
    ts = t[order]
    first = np.ones(len(ts), dtype=bool)
    first[1:] = ts[1:] != ts[:-1]
    return order, first


def _runs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values (NaN equals nothing)."""
    if not len(v):
        return np.zeros(0, int), np.zeros(0, int)
    change = np.ones(len(v), dtype=bool)
    change[1:] = v[1:] != v[:-1]
    start = np.flatnonzero(change)
    return start, np.diff(np.append(start, len(v)))


def _field_summary(v: np.ndarray) -> dict:
    """Summary of one field of one chunk from its non-null epoch values in time order."""
    fin = v[np.isfinite(v)]
    cnt, mean, m2 = _centroids(fin, CENTROIDS)
    clean = {"dn": 0, "dm": 0.0, "dq": 0.0}
    if len(fin) >= LEAST:
        med = float(np.median(fin))
        s = 1.4826 * float(np.median(np.abs(fin - med)))
        left = fin[~phase_space(fin, med, s)] if s > 0 else fin[:0]
        if len(left):
            clean = {"dn": len(left), "dm": float(left.mean()), "dq": float(((left - left.mean()) ** 2).sum())}
    start, length = _runs(v)
    edge = {"n": len(v), "v0": None, "l0": 0, "v1": None, "l1": 0}
    if len(v):
        edge = {"n": len(v), "v0": float(v[0]), "l0": int(length[0]), "v1": float(v[-1]), "l1": int(length[-1])}
    return edge | clean | {"c": cnt.tolist(), "m": mean.tolist(), "q": m2.tolist()}


_EDGE = "n bigint, v0 double, l0 bigint, v1 double, l1 bigint, dn bigint, dm double, dq double, c array<double>, m array<double>, q array<double>"


def _arrow_edge() -> pa.StructType:
    lst = pa.list_(pa.float64())
    return pa.struct([("n", pa.int64()), ("v0", pa.float64()), ("l0", pa.int64()), ("v1", pa.float64()), ("l1", pa.int64()), ("dn", pa.int64()), ("dm", pa.float64()), ("dq", pa.float64()), ("c", lst), ("m", lst), ("q", lst)])


def flag_spikes(
    df: DataFrame,
    id_col: str = "res_id",
    keys: Sequence[str] = ("recv", "sat", "sig", "meas"),
    time_col: str = "datetime",
    fields: Sequence[str] = ("prefit", "postfit"),
    k: float = 10.0,
    held: int = 8,
    bounds: tuple[float, float] | None = None,
    phase: bool = False,
) -> DataFrame:
    """One row (id, field, value, reason, median, spread) per faulty reading.

    reason: 'nonfinite', 'bound' (outside the given physical bounds), 'spike' (farther than k usual
    spreads from the series median, and outside the phase-space ellipsoids), 'held'
    (part of ``held`` or more consecutive epochs of one value) and, with ``phase``, 'phase' (outside the ellipsoids but within
    k spreads: a jump against its neighbours, with the epochs up to two away whose differences it spoils). The first that applies is given.

    Nulls are no readings and do not break a run; NaN and infinities do. Rows of one series at one time are
    one epoch (repeated deliveries); each of its rows is judged by its own value. A null key is a key. A row without
    time is an epoch of its own that belongs to no run. A series with
    zero spread flags any value that differs from its median. An empty table gives an empty result.
    Other columns, whatever their names, are not read.
    """
    keys, fields = list(keys), list(fields)
    rows = df.select(
        F.col(id_col).alias("_id"),
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)],
        micros(time_col).alias("_t"),
        *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(fields)],
    ).withColumn("_day", F.floor(F.col("_t") / DAY_US).cast("int"))
    gk = [f"_k{i}" for i in range(len(keys))]
    chunk = [*gk, "_day"]
    kt = [rows.schema[c].dataType.simpleString() for c in gk]
    nf = len(fields)
    id_type = rows.schema["_id"].dataType.simpleString()
    key_ddl = ", ".join(f"{c} {t}" for c, t in zip(gk, kt, strict=True))

    def ordered(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        k = np.arange(len(t))
        tt, none = np.asarray(t["_t"].fill_null(0)), np.asarray(t["_t"].is_null())
        return _epochs(np.where(none, k, tt), k)

    def summarise(key: tuple, t: pa.Table) -> pa.Table:
        order, first = ordered(t)
        at = order[first]
        cols = {c: pa.array([key[i].as_py()]) if key[i].is_valid else pa.nulls(1, t.schema.field(c).type) for i, c in enumerate(chunk)}
        cols = {c: a.cast(t.schema.field(c).type) for c, a in cols.items()}
        for i in range(nf):
            v, null = _null_aware(t[f"_f{i}"])
            s = _field_summary(v[at][~null[at]])
            cols[f"_s{i}"] = pa.array([s if t["_day"][0].is_valid else s | {"n": 0}], type=_arrow_edge())
        return pa.table(cols)

    summary = rows.groupBy(*chunk).applyInArrow(summarise, schema=f"{key_ddl}, _day int, " + ", ".join(f"_s{i} struct<{_EDGE.replace(' bigint', ':bigint').replace(' double', ':double').replace(' array', ':array')}>" for i in range(nf)))

    lim = ", ".join(f"_med{i} double, _sp{i} double, _pre{i} bigint, _post{i} bigint" for i in range(nf))

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        days = np.asarray(t["_day"].fill_null(-(2**31) + 1))
        order = np.argsort(days, kind="stable")
        n = len(days)
        out: dict = {c: t[c].take(pa.array(order)) for c in chunk}
        for i in range(nf):
            s = [x for x in t[f"_s{i}"].take(pa.array(order)).to_pylist()]
            cnt, mean, m2 = (np.concatenate([np.asarray(x[c], dtype=float) for x in s]) for c in "cmq")
            med, sp = first_limits(cnt, mean, m2) if len(cnt) else (np.nan, np.nan)
            dn, dm, dq = (np.array([x[c] for x in s], dtype=float) for c in ("dn", "dm", "dq"))
            if dn.sum() > 0.3 * cnt.sum():
                # the usual chunk's spread and the usual distance of chunks from the median: a chunk gone astray moves neither
                clean = float(np.hypot(_middle(np.sqrt(dq / np.maximum(dn, 1)), dn), 1.4826 * _middle(np.abs(dm - med), dn)))
                sp = clean if clean > 0 else sp
            pre, post = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            for fwd in (True, False):
                run, val = 0, None
                for j in range(n) if fwd else range(n - 1, -1, -1):
                    x = s[j]
                    (pre if fwd else post)[j] = run if x["n"] and x["v0" if fwd else "v1"] == val else 0
                    if x["n"]:
                        v, length = (x["v1"], x["l1"]) if fwd else (x["v0"], x["l0"])
                        whole = length == x["n"]
                        run, val = (length + run if whole and v == val else length), v
            out |= {f"_med{i}": pa.array(np.full(n, med)), f"_sp{i}": pa.array(np.full(n, sp)), f"_pre{i}": pa.array(pre), f"_post{i}": pa.array(post)}
        return pa.table(out)

    merged = checkpointed(summary.groupBy(*gk).applyInArrow(merge, schema=f"{key_ddl}, _day int, {lim}"))
    first_of = merged.groupBy(*gk).agg(*[F.first(f"_{c}{i}").alias(f"_{c}{i}") for i in range(nf) for c in ("med", "sp")])
    spreads = exact_spreads(rows, first_of, gk, nf, k).withColumnsRenamed({c: f"_s{c}" for c in gk})
    same_series = F.lit(True)
    for c in gk:
        same_series = same_series & F.col(c).eqNullSafe(F.col(f"_s{c}"))
    limits = merged.drop(*[f"_sp{i}" for i in range(nf)]).join(sized(spreads), same_series).select(*chunk, *[f"_{c}{i}" for i in range(nf) for c in ("med", "sp", "pre", "post")])

    def flag(t: pa.Table, lim_t: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("id", "field", "value", "reason", "med", "sp")}
        if len(t) and len(lim_t):
            order, first = ordered(t)
            epoch = np.empty(len(order), dtype=np.int64)
            epoch[order] = np.cumsum(first) - 1
            at = order[first]
            for i, name in enumerate(fields):
                v, null = _null_aware(t[f"_f{i}"])
                med, sp, pre, post = (lim_t[f"_{c}{i}"][0].as_py() for c in ("med", "sp", "pre", "post"))
                ev, en = v[at], null[at]
                live = np.flatnonzero(~en)
                start, length = _runs(ev[live])
                total = length.copy()
                if len(total):
                    total[0] += pre
                    total[-1] += post
                held_epoch = np.zeros(len(at), dtype=bool)
                if len(total) and t["_day"][0].is_valid:
                    held_epoch[live] = np.repeat(total >= held, length)
                same = v == ev[epoch]
                nonfin = ~np.isfinite(v) & ~null
                with np.errstate(invalid="ignore"):
                    bound = ((v < bounds[0]) | (v > bounds[1])) & ~null if bounds else np.zeros(len(v), bool)
                    fin = live[np.isfinite(ev[live])]
                    screened = np.zeros(len(at), dtype=bool)
                    # the ellipsoids are only asked where their answer counts
                    far = np.abs(v - med) > k * sp
                    if len(fin) and (phase or far.any()):
                        screened[fin] = phase_space(ev[fin], med, sp)
                    # a row that differs from the first delivery of its epoch has no place among the differences
                    spike = (screened[epoch] | ~same) & far & ~null & ~nonfin
                stuck = held_epoch[epoch] & same & ~null
                hit = nonfin | bound | spike | stuck | (screened[epoch] & same & ~null if phase else False)
                w = np.flatnonzero(hit)
                if len(w):
                    out["id"].append(t["_id"].combine_chunks().take(pa.array(w)))
                    reason = np.where(nonfin[w], "nonfinite", np.where(bound[w], "bound", np.where(spike[w], "spike", np.where(stuck[w], "held", "phase"))))
                    out["field"].append(pa.array([name] * len(w)))
                    out["value"].append(pa.array(v[w]))
                    out["reason"].append(pa.array(reason.tolist(), type=pa.string()))
                    out["med"].append(pa.array(np.full(len(w), med)))
                    out["sp"].append(pa.array(np.full(len(w), sp)))
        ty = {"id": t.schema.field("_id").type, "field": pa.string(), "value": pa.float64(), "reason": pa.string(), "med": pa.float64(), "sp": pa.float64()}
        names = dict(zip(out, ("id", "field", "value", "reason", "series_median", "series_spread"), strict=True))
        return pa.table({names[c]: pa.chunked_array(a, type=ty[c]) for c, a in out.items()})

    flagged = (
        rows.groupBy(*chunk)
        .cogroup(limits.groupBy(*chunk))
        .applyInArrow(flag, schema=f"id {id_type}, field string, value double, reason string, series_median double, series_spread double")
    )
    return flagged.withColumnRenamed("id", id_col)
