"""Estimators over groups. A group is one filter (a receiver, a chunk, a network) and its rows are bounded by its epochs and states.

Filters keep long tables: measurements (group, epoch, meas, value, var), design rows (group, epoch, meas, state, coeff). Each group is one
Arrow task in epoch order; groups are independent, so a receiver's arcs or days can be groups of their own where one would be too long.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.stats import chi2_quantile


def _ddl(df: DataFrame, cols: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitions of a fixed number, so that Python groups keep all cores busy where their bytes are few."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def map_small_groups(df: DataFrame, group: Sequence[str], cols: Sequence[str], fn: Callable[[list[tuple]], list[tuple]], out: str) -> DataFrame:
    """fn over each group's rows (sorted tuples of ``cols``), for many groups of a few rows each: one Arrow row a group, not one frame."""
    g = by_key(df.select(*group, *cols), *group).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("_a"))

    def run(it):
        for pdf in it:
            keys = list(zip(*[pdf[k] for k in group], strict=True))
            rows = [(*k, *r) for k, a in zip(keys, pdf["_a"], strict=True) for r in fn([tuple(x[c] for c in cols) for x in a])]
            yield pd.DataFrame(rows, columns=[*group, *names])

    names = [x.strip().split(" ")[0].strip("`") for x in out.split(",")]
    return g.mapInPandas(run, schema=f"{_ddl(df, group)}, {out}")


# --- kernels


def kf_update(x: np.ndarray, p: np.ndarray, v: np.ndarray, h: np.ndarray, r: np.ndarray, joseph: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """(x, P, innovation chi-square) after measurements with innovations v = y - H x; the gain comes from a Cholesky factor, else least squares."""
    s = r + h @ p @ h.T
    try:
        lower = np.linalg.cholesky(s)
        sv = np.linalg.solve(lower, v)
        k = np.linalg.solve(lower.T, np.linalg.solve(lower, h @ p)).T
        chi2 = float(sv @ sv)
    except np.linalg.LinAlgError:
        si = np.linalg.pinv(s)
        k, chi2 = p @ h.T @ si, float(v @ si @ v)
    if joseph:
        a = np.eye(len(x)) - k @ h
        pn = a @ p @ a.T + k @ r @ k.T
    else:
        pn = p - k @ h @ p
    return x + k @ v, (pn + pn.T) / 2, chi2


def transition(kind: str, q: float, tau: float, mu: float, dt: float) -> tuple[float, float, float]:
    """(F, Q, offset) of one state over dt: 'walk' random walk, 'markov' first-order Gauss-Markov about mu, 'white' reset, 'const'."""
    if kind == "walk":
        return 1.0, q * abs(dt), 0.0
    if kind == "markov" and tau > 0:
        f = float(np.exp(-dt / tau))
        return f, q * tau / 2 * (1 - f * f), mu * (1 - f)
    if kind == "white":
        return 0.0, q, mu
    return 1.0, 0.0, 0.0


def wls(h: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(x, P) of weighted least squares; None with fewer rows than columns or a singular normal matrix."""
    if h.shape[0] < h.shape[1]:
        return None
    w = np.where(np.isfinite(w), w, 0.0)
    n = h.T @ (w[:, None] * h)
    try:
        p = np.linalg.inv(n)
    except np.linalg.LinAlgError:
        return None
    return p @ (h.T @ (w * y)), p


def rts(minus: list, plus: list, trans: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """Backward smoothing of (x, P) pairs: minus and plus each epoch's, trans[k] the transition into epoch k."""
    xs, ps = plus[-1]
    out = [(xs, ps)]
    for k in range(len(plus) - 2, -1, -1):
        xm, pm = minus[k + 1]
        xp, pp = plus[k]
        s = np.linalg.solve(pm + 1e-20 * np.eye(len(xm)), trans[k + 1] @ pp)
        xs, ps = xp + s.T @ (xs - xm), pp + s.T @ (ps - pm) @ s
        out.append((xs, ps))
    return out[::-1]


def reduce_lattice(basis: np.ndarray, delta: float = 0.99) -> tuple[np.ndarray, np.ndarray]:
    """(reduced basis, integer matrix u) with reduced = basis @ u: Lenstra-Lenstra-Lovasz reduction of a basis in columns, by its QR triangle."""
    n = basis.shape[1]
    b, u = basis.astype(float).copy(), np.eye(n, dtype=np.int64)
    k = 1
    while k < n:
        r = np.linalg.qr(b[:, : k + 1], mode="r")
        for j in range(k - 1, -1, -1):
            m = round(r[j, k] / r[j, j])
            if m:
                b[:, k] -= m * b[:, j]
                u[:, k] -= m * u[:, j]
                r[:, k] -= m * r[:, j]
        if r[k, k] ** 2 + r[k - 1, k] ** 2 >= delta * r[k - 1, k - 1] ** 2:
            k += 1
        else:
            b[:, [k - 1, k]], u[:, [k - 1, k]] = b[:, [k, k - 1]], u[:, [k, k - 1]]
            k = max(k - 1, 1)
    return b, u


def integer_least_squares(a: np.ndarray, q: np.ndarray, n_best: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The n_best integer vectors nearest to a in the metric of q, and their squared distances.

    The distance of z is |W (a - z)| with W' W the inverse of q, so the columns of W span a lattice and W a is the point whose nearest
    lattice points are wanted: the basis is reduced, and the points are enumerated over its triangle, nearest layers first.
    """
    n = len(a)
    w = np.linalg.inv(np.linalg.cholesky(q.astype(float)))  # raises where q is not positive definite
    basis, u = reduce_lattice(w)
    qm, r = np.linalg.qr(basis)
    shift = np.round(a)
    target = qm.T @ (w @ (a - shift))
    found: list[tuple[float, tuple[int, ...]]] = []

    def layer(k: int, tail: tuple[int, ...], spent: float) -> None:
        """Choose component k, given the later ones in ``tail``."""
        if k < 0:
            found.append((spent, tail))
            found.sort()
            del found[n_best:]
            return
        centre = (target[k] - r[k, k + 1 :] @ np.array(tail, dtype=float)) / r[k, k] if tail else target[k] / r[k, k]
        for c in sorted(range(int(np.floor(centre)) - 1, int(np.ceil(centre)) + 2), key=lambda c: abs(c - centre)):
            outward(k, c, tail, spent, centre)
        down, up = int(np.floor(centre)) - 2, int(np.ceil(centre)) + 2
        while outward(k, down, tail, spent, centre):
            down -= 1
        while outward(k, up, tail, spent, centre):
            up += 1

    def outward(k: int, c: int, tail: tuple[int, ...], spent: float, centre: float) -> bool:
        """Follow one choice; False when it is already farther than the points held."""
        cost = spent + (r[k, k] * (c - centre)) ** 2
        if len(found) == n_best and cost >= found[-1][0]:
            return False
        layer(k - 1, (c, *tail), cost)
        return True

    layer(n - 1, (), 0.0)
    return np.array([shift + u @ np.array(z) for _, z in found]), np.array([c for c, _ in found])


def lowess(x: np.ndarray, y: np.ndarray, frac: float, rounds: int = 2) -> np.ndarray:
    """Robust local lines with tricube weights over the nearest share of points."""
    n = len(x)
    k = max(2, int(np.ceil(frac * n)))
    out, rob = y.astype(float).copy(), np.ones(n)
    for _ in range(rounds + 1):
        for i in range(n):
            lo = max(0, min(i - k // 2, n - k))
            while lo + k < n and x[i] - x[lo] > x[lo + k] - x[i]:
                lo += 1
            s = slice(lo, lo + k)
            h = max(np.abs(x[s] - x[i]).max(), 1e-12)
            w = (1 - np.minimum(np.abs(x[s] - x[i]) / h, 1) ** 3) ** 3 * rob[s]
            sw = w.sum()
            if sw <= 0:
                continue
            mx, my = (w * x[s]).sum() / sw, (w * y[s]).sum() / sw
            sxx = (w * (x[s] - mx) ** 2).sum()
            b = (w * (x[s] - mx) * (y[s] - my)).sum() / sxx if sxx > 1e-12 else 0.0
            out[i] = my + b * (x[i] - mx)
        r = np.abs(y - out)
        m = np.median(r)
        if m == 0:
            break
        rob = (1 - np.minimum(r / (6 * m), 1) ** 2) ** 2
    return out


# --- operators


def kalman(
    meas: DataFrame, group: str, epoch: str, state: str, value: str, var: str, coeff: str | None = None, kind: str = "walk", q: float = 1.0, tau: float = 0.0,
    mu: float = 0.0, init_var: float = 1e6, sigma_limit: float | None = None, smooth: bool = False,
) -> DataFrame:
    """(group, epoch, state, x, p, xs, ps): a filter per group over rows that each measure one state (times coeff).

    States appear at their first measurement. A measurement whose innovation exceeds sigma_limit of its standard deviation is rejected. xs, ps are
    the backward smoothed values (null unless ``smooth``). Rows with a null epoch, value or non-positive variance are left out.
    """
    src = meas.where(F.col(epoch).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.col(var) > 0))
    src = src.select(F.col(group).alias("g"), F.col(epoch).cast("double").alias("t"), F.col(state).cast("string").alias("s"), F.col(value).cast("double").alias("y"), F.col(var).cast("double").alias("r"), (F.col(coeff).cast("double") if coeff else F.lit(1.0)).alias("c"))
    gt = src.schema["g"].dataType.simpleString()

    def one_state(pdf: pd.DataFrame, name: str) -> pd.DataFrame:
        """The same recursion in plain numbers."""
        x, p, last = 0.0, init_var, None
        out: list[list] = []
        ts, ys, rs, cs = (pdf[c].tolist() for c in ("t", "y", "r", "c"))
        i, m = 0, len(ts)
        while i < m:
            t, j = ts[i], i
            while j < m and ts[j] == t:
                j += 1
            f = 1.0
            if last is not None:
                f, qk, off = transition(kind, q, tau, mu, t - last)
                x, p = f * x + off, f * f * p + qk
            xm, pm = x, p
            for k in range(i, j):
                if sigma_limit is None or abs(ys[k] - cs[k] * xm) <= sigma_limit * (cs[k] * cs[k] * pm + rs[k]) ** 0.5:
                    g = p * cs[k] / (cs[k] * cs[k] * p + rs[k])
                    x, p = x + g * (ys[k] - cs[k] * x), (1 - g * cs[k]) * p
            out.append([t, x, p, xm, pm, f])
            last, i = t, j
        xs, ps = [None] * len(out), [None] * len(out)
        if smooth:
            a, b = out[-1][1], out[-1][2]
            xs[-1], ps[-1] = a, b
            for k in range(len(out) - 2, -1, -1):
                g = out[k][2] * out[k + 1][5] / out[k + 1][4] if out[k + 1][4] > 0 else 0.0
                a, b = out[k][1] + g * (a - out[k + 1][3]), out[k][2] + g * g * (b - out[k + 1][4])
                xs[k], ps[k] = a, b
        return pd.DataFrame({"g": [pdf.g.iloc[0]] * len(out), "t": [o[0] for o in out], "s": name, "x": [o[1] for o in out], "p": [o[2] for o in out], "xs": np.array(xs, dtype=float), "ps": np.array(ps, dtype=float)})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "s", "y"], kind="stable")
        names = sorted(pdf.s.unique())
        at = {s: i for i, s in enumerate(names)}
        n = len(names)
        if n == 1:
            return one_state(pdf, names[0])
        x, p, seen, last = np.zeros(n), np.zeros((n, n)), np.zeros(n, bool), None
        epochs, minus, plus, trans = [], [], [], []
        for t, e in pdf.groupby("t", sort=True):
            f = np.eye(n)
            if last is not None:
                fk, qk, off = transition(kind, q, tau, mu, t - last)
                f[seen, seen] = fk
                x = np.where(seen, fk * x + off, x)
                p = f @ p @ f.T + np.diag(np.where(seen, qk, 0.0))
            idx = np.array([at[s] for s in e.s])
            for i in idx[~seen[idx]]:
                if not seen[i]:
                    seen[i], p[i, i] = True, init_var
            minus.append((x.copy(), p.copy()))
            h = np.zeros((len(e), n))
            h[np.arange(len(e)), idx] = e.c.to_numpy()
            v, r = e.y.to_numpy() - h @ x, e.r.to_numpy()
            if sigma_limit is not None:
                ok = np.abs(v) <= sigma_limit * np.sqrt(np.einsum("ij,jk,ik->i", h, p, h) + r)
                h, v, r = h[ok], v[ok], r[ok]
            if len(v):
                x, p, _ = kf_update(x, p, v, h, np.diag(r))
            plus.append((x.copy(), p.copy()))
            trans.append(f)
            epochs.append((t, seen.copy()))
            last = t
        sm = rts([(a, b + np.diag(np.where(np.diag(b) == 0, 1.0, 0.0))) for a, b in minus], plus, trans) if smooth else None
        g = pdf.g.iloc[0]
        rows = [(g, t, names[i], plus[k][0][i], plus[k][1][i, i], sm[k][0][i] if sm else None, sm[k][1][i, i] if sm else None) for k, (t, live) in enumerate(epochs) for i in np.flatnonzero(live)]
        return pd.DataFrame(rows, columns=["g", "t", "s", "x", "p", "xs", "ps"])

    out = by_key(src, "g").groupBy("g").applyInPandas(run, schema=f"g {gt}, t double, s string, x double, p double, xs double, ps double")
    return out.withColumnsRenamed({"g": group, "t": epoch, "s": state})


def sequential(df: DataFrame, group: Sequence[str], order: Sequence[str], columns: Sequence[str], out: str, step: Callable[[tuple | None, tuple], tuple[tuple, float | None]]) -> DataFrame:
    """Adds ``out`` by a recursive step over each group's rows in order: step(state, row values) -> (state, value)."""
    schema = f"{_ddl(df, df.columns)}, `{out}` double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order), kind="stable").reset_index(drop=True)
        state, vals = None, []
        for row in pdf[list(columns)].itertuples(index=False, name=None):
            state, v = step(state, row)
            vals.append(np.nan if v is None else v)
        return pdf.assign(**{out: vals})

    return by_key(df, *group).groupBy(*group).applyInPandas(run, schema=schema)


def hatch_smooth(df: DataFrame, group: Sequence[str], order: Sequence[str], p: str, l: str, t_us: str, lli: str | None = None, window: int = 100, outage_s: float = 60.0, var_p: float = 0.09, var_l: float = 1e-4, out: str = "smoothed") -> DataFrame:
    """Carrier-smoothed pseudorange: the running mean of P - L plus L; reset on loss of lock, outage or a jump over four sigma."""

    def step(s, row):
        code, phase, t, lost = row
        if not code or not phase or code != code or phase != phase:
            return s, None
        amb = code - phase
        if s is not None and ((int(lost or 0) & 3) or t - s[3] > outage_s * 1e6 or abs(amb - s[1]) > 4 * np.sqrt(s[2] + var_p + var_l)):
            s = None
        n, est, var = (0, 0.0, 0.0) if s is None else s[:3]
        n = min(n + 1, window)
        est += (amb - est) / n
        var = (var_p + var_l) / (n * n) + (1 - 1 / n) ** 2 * var
        return (n, est, var, t), est + phase

    x = df if lli else df.withColumn("_lli", F.lit(0))
    r = sequential(x, group, order, [p, l, t_us, lli or "_lli"], out, step)
    return r if lli else r.drop("_lli")


def low_pass(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, var: str, q: float, out: str = "filtered") -> DataFrame:
    """Variance-weighted recursive mean: the scalar filter with process noise q squared a step, the gain with the prior variance in it."""

    def step(s, row):
        m, r = row
        if m is None or m != m:
            return s, None
        if s is None:
            return (m, r), m
        p = s[1] + q * q
        mean = s[0] + (m - s[0]) * p / (r + p)
        return (mean, 1 / (1 / r + 1 / p)), mean

    return sequential(df, group, order, [value, var], out, step)


def lowess_smooth(df: DataFrame, group: Sequence[str], time: str, value: str, frac: float = 0.3, out: str = "smooth") -> DataFrame:
    """Local regression of each group's series."""
    schema = f"{_ddl(df, df.columns)}, `{out}` double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([time], kind="stable").reset_index(drop=True)
        ok = np.isfinite(pdf[value].to_numpy(dtype=float))
        res = np.full(len(pdf), np.nan)
        if ok.sum() >= 2:
            res[ok] = lowess(pdf[time].to_numpy(dtype=float)[ok], pdf[value].to_numpy(dtype=float)[ok], frac)
        elif ok.any():
            res[ok] = pdf[value].to_numpy(dtype=float)[ok]
        return pdf.assign(**{out: res})

    return df.groupBy(*group).applyInPandas(run, schema=schema)


def poly_fit(df: DataFrame, group: Sequence[str], x: str, y: str, degree: int) -> DataFrame:
    """(group, k, c): polynomial coefficients from power sums, so groups of any size are combined map side and only the sums are solved."""
    v, u = F.col(y).cast("double"), F.col(x).cast("double")
    ok = df.where(v.isNotNull() & ~F.isnan(v) & u.isNotNull())
    sums = [F.sum(F.pow(u, F.lit(i))).alias(f"s{i}") for i in range(2 * degree + 1)] + [F.sum(v * F.pow(u, F.lit(i))).alias(f"b{i}") for i in range(degree + 1)]
    g = ok.groupBy(*group).agg(*sums)
    schema = f"{_ddl(df, group)}, k int, c double"

    def solve(it):
        for pdf in it:
            rows = []
            for r in pdf.to_dict("records"):
                m = np.array([[r[f"s{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
                b = np.array([r[f"b{i}"] for i in range(degree + 1)])
                c = np.linalg.lstsq(m, b, rcond=None)[0]
                rows += [[*[r[k] for k in group], k, float(c[k])] for k in range(degree + 1)]
            yield pd.DataFrame(rows, columns=[*group, "k", "c"])

    return g.mapInPandas(solve, schema=schema)


def least_squares(df: DataFrame, group: Sequence[str], columns: Sequence[str], y: str, var: str) -> DataFrame:
    """(group, state, x, p): weighted least squares from distributed normal-equation sums; groups with too few rows give none."""
    n = len(columns)
    w = F.when(F.col(var) > 0, 1 / F.col(var)).otherwise(0.0)
    ok = df.where(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")))
    sums = [F.sum(w * F.col(columns[i]) * F.col(columns[j])).alias(f"n{i}_{j}") for i in range(n) for j in range(i, n)]
    g = ok.groupBy(*group).agg(F.count("*").alias("rows"), *sums, *[F.sum(w * F.col(c) * F.col(y)).alias(f"b{i}") for i, c in enumerate(columns)])
    schema = f"{_ddl(df, group)}, state string, x double, p double"

    def solve(it):
        for pdf in it:
            rows = []
            for r in pdf.to_dict("records"):
                m = np.array([[r[f"n{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
                if r["rows"] < n or np.linalg.matrix_rank(m) < n:
                    continue
                p = np.linalg.inv(m)
                x = p @ np.array([r[f"b{i}"] for i in range(n)])
                rows += [[*[r[k] for k in group], c, float(x[i]), float(p[i, i])] for i, c in enumerate(columns)]
            yield pd.DataFrame(rows, columns=[*group, "state", "x", "p"])

    return g.mapInPandas(solve, schema=schema)


def raim(df: DataFrame, group: Sequence[str], member: str, columns: Sequence[str], y: str, sigma: str, sigmas: float = 4.0) -> DataFrame:
    """(group, member, used, chi2, dof, pass): least squares per group; while the chi-square test fails, the row whose omission lowers chi2 / dof most is left out.

    A round needs two degrees of freedom and a candidate solution one. Groups are epochs of one receiver, a few dozen rows.
    """
    from statistics import NormalDist

    alpha = 2 * (1 - NormalDist().cdf(sigmas))
    n = len(columns)
    limits: dict[int, float] = {}

    def limit(k: int) -> float:
        if k not in limits:
            limits[k] = chi2_quantile(1 - alpha, k)
        return limits[k]

    def fit(h, v, w):
        s = wls(h, v, w)
        if s is None:
            return None
        e = v - h @ s[0]
        return float((w * e * e).sum())

    def run(rows: list[tuple]) -> list[tuple]:
        m = np.array([r[1:] for r in rows], dtype=float)
        h, v, w = m[:, :n], m[:, n], 1 / m[:, n + 1] ** 2
        used = np.ones(len(rows), bool)
        chi2 = fit(h, v, w)
        while chi2 is not None:
            dof = int(used.sum()) - n
            if dof < 2 or chi2 <= limit(dof):
                break
            best = None
            for i in np.flatnonzero(used):
                u = used.copy()
                u[i] = False
                c = fit(h[u], v[u], w[u])
                if c is not None and dof - 1 >= 1 and (best is None or c / (dof - 1) < best[0]):
                    best = (c / (dof - 1), i, c)
            if best is None or best[0] >= chi2 / dof:
                break
            used[best[1]], chi2 = False, best[2]
        dof = int(used.sum()) - n
        ok = chi2 is not None and dof >= 1 and chi2 <= limit(dof)
        return [(r[0], bool(u), chi2, dof, ok) for r, u in zip(rows, used, strict=True)]

    return map_small_groups(df, group, [member, *columns, y, sigma], run, f"{_ddl(df, [member])}, used boolean, chi2 double, dof int, pass boolean")


def fix_ambiguities(df: DataFrame, group: Sequence[str], i: str, j: str, a: str, q: str, ratio: float = 3.0) -> DataFrame:
    """(group, i, fixed, ratio, accepted) from long float ambiguities and covariance (i, j, a on the diagonal rows, q); the ratio test compares the two best."""

    def run(rows: list[tuple]) -> list[tuple]:
        names = sorted({r[0] for r in rows})
        at = {s: k for k, s in enumerate(names)}
        m, x = np.zeros((len(names), len(names))), np.zeros(len(names))
        for ri, rj, av, qv in rows:
            m[at[ri], at[rj]] = m[at[rj], at[ri]] = qv
            if ri == rj:
                x[at[ri]] = av
        best, cost = integer_least_squares(x, m)
        rt = float(cost[1] / cost[0]) if len(cost) > 1 and cost[0] > 0 else float("inf")
        return [(s, float(best[0][at[s]]), rt, rt >= ratio) for s in names]

    return map_small_groups(df, group, [i, j, a, q], run, f"{_ddl(df, [i])}, fixed double, ratio double, accepted boolean")


def helmert(df: DataFrame, group: Sequence[str], weight: str | None = None) -> DataFrame:
    """(group, state, x, p): translation, rotation and scale between positions (x, y, z) and (x2, y2, z2), weighted, from normal-equation sums."""
    w = F.col(weight) if weight else F.lit(1.0)
    x, y, z = F.col("x") / 1e6, F.col("y") / 1e6, F.col("z") / 1e6
    zero, one = F.lit(0.0), F.lit(1.0)
    rows = [
        ("x", [one, zero, zero, zero, z, -y, x]),
        ("y", [zero, one, zero, -z, zero, x, y]),
        ("z", [zero, zero, one, y, -x, zero, z]),
    ]
    names = ["tx", "ty", "tz", "rx_urad", "ry_urad", "rz_urad", "scale_ppm"]
    each = F.explode(F.array(*[F.struct((F.col(f"{c}2") - F.col(c)).alias("dy"), (1 / w).alias("var"), *[v.alias(n) for v, n in zip(h, names, strict=True)]) for c, h in rows]))
    long = df.select(*group, each.alias("_e")).select(*group, "_e.*")
    return least_squares(long, group, names, "dy", "var")


def pair_iono_free(df: DataFrame, group: Sequence[str], meas: str, coeff: str, value: str) -> DataFrame:
    """(group, a, b, value): pairs of measurements that share an ionosphere state with unequal coefficients, each used once, in order."""
    kind = df.schema[meas].dataType.simpleString()

    def run(rec: list[tuple]) -> list[tuple]:
        out, used = [], set()
        for p in range(len(rec)):
            if p in used:
                continue
            for r in range(p + 1, len(rec)):
                ci, cj = rec[p][1], rec[r][1]
                if r in used or ci == cj or ci * cj <= 0:
                    continue
                s = np.sqrt((ci * ci + cj * cj) / (ci - cj) ** 2)
                out.append((rec[p][0], rec[r][0], float(s * (cj * rec[p][2] - ci * rec[r][2]))))
                used |= {p, r}
                break
        return out

    return map_small_groups(df, group, [meas, coeff, value], run, f"a {kind}, b {kind}, value double")
