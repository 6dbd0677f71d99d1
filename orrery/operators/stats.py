"""Exact statistics: groups, weighted groups, margins, percentiles, normal equations, chi-square tests, dilution of precision."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def real(v: str) -> Column:
    c = F.col(v).cast("double")
    return F.when(~F.isnan(c), c)


def series_statistics(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, n, mean, sumsq, rms) over values that are neither null nor NaN."""
    v = real(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.sum(v * v).alias("sumsq"), F.sqrt(F.avg(v * v)).alias("rms"))


def aggregate_statistics(stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of series statistics: the plain mean of means and the RMS over all values."""
    return stats.groupBy(*by).agg(F.sum("n").alias("n"), F.avg("mean").alias("mean"), F.sqrt(F.sum("sumsq") / F.sum("n")).alias("rms"))


def component_table(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, n, mean, median, std, rms), std of the population."""
    v = real(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.stddev_pop(v).alias("std"), F.sqrt(F.avg(v * v)).alias("rms"))


def weighted_statistics(df: DataFrame, by: Sequence[str], value: str, sigma: str) -> DataFrame:
    """(by, n, wmean, wstd, wrms) with weights 1 / sigma^2 over sigma > 0; wstd is the weighted population's."""
    v, s = real(value), real(sigma)
    ok = df.where(v.isNotNull() & (s > 0)).withColumn("_w", 1 / (s * s)).withColumn("_v", v)
    g = ok.groupBy(*by).agg(F.count("*").alias("n"), F.sum("_w").alias("_sw"), F.sum(F.col("_w") * F.col("_v")).alias("_s1"), F.sum(F.col("_w") * F.col("_v") * F.col("_v")).alias("_s2"))
    m = F.col("_s1") / F.col("_sw")
    return g.select(*by, "n", m.alias("wmean"), F.sqrt(F.greatest(F.col("_s2") / F.col("_sw") - m * m, F.lit(0.0))).alias("wstd"), F.sqrt(F.col("_s2") / F.col("_sw")).alias("wrms"))


def label_statistics(df: DataFrame, by: Sequence[str], value: str, sigma: str) -> DataFrame:
    """Unweighted (std of the sample) and weighted statistics of each label, full outer joined."""
    v = real(value)
    plain = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.sqrt(F.avg(v * v)).alias("rms"))
    return plain.join(weighted_statistics(df, by, value, sigma).withColumnRenamed("n", "wn"), list(by), "full_outer")


def matrix_with_margins(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """(row, col, n, mean, std, rms, margin): cells, both margins and the whole, margin as grouping id."""
    v = real(value)
    return df.where(v.isNotNull()).cube(row, col).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.sqrt(F.avg(v * v)).alias("rms"), F.grouping_id().cast("int").alias("margin")
    )


def difference_statistics(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, n, mean, std, rms, min, p5 .. p95, max), exact percentiles."""
    v = real(value)
    at = (5, 10, 50, 75, 90, 95)
    g = df.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.sqrt(F.avg(v * v)).alias("rms"), F.min(v).alias("min"),
        F.percentile(v, [p / 100 for p in at]).alias("_p"), F.max(v).alias("max"),
    )
    return g.select(*by, "n", "mean", "std", "rms", "min", *[F.col("_p")[i].alias(f"p{p}") for i, p in enumerate(at)], "max")


def qq_quantiles(df: DataFrame, by: Sequence[str], value: str, n: int = 100) -> DataFrame:
    """(by, at, q, normal): n empirical quantiles beside the standard normal's, whose ends are infinite."""
    at = [k / (n - 1) for k in range(n)]
    normal = [-math.inf if p <= 0 else math.inf if p >= 1 else NormalDist().inv_cdf(p) for p in at]
    g = df.groupBy(*by).agg(F.percentile(real(value), at).alias("_q"))
    both = F.arrays_zip(F.col("_q").alias("q"), F.array(*[F.lit(x) for x in normal]).alias("normal"))
    return g.select(*by, F.posexplode(both).alias("at", "_z")).select(*by, "at", "_z.q", "_z.normal")


def rms_3d(df: DataFrame, by: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """RMS per axis and of the vector's norm."""
    return df.groupBy(*by).agg(*[F.sqrt(F.avg(F.col(a) * F.col(a))).alias(f"rms_{a}") for a in axes], F.sqrt(F.avg(sum((F.col(a) * F.col(a) for a in axes), F.lit(0.0)))).alias("rms_3d"))


def wls_line(df: DataFrame, by: Sequence[str], x: str, y: str, sigma: str) -> DataFrame:
    """Weighted least squares of y = a + b x from normal-equation sums: (by, n, a, b, var_a, var_b, chi2)."""
    w = F.when(F.col(sigma) > 0, 1 / (F.col(sigma) * F.col(sigma)))
    d = df.where(w.isNotNull() & real(x).isNotNull() & real(y).isNotNull()).select(*by, w.alias("w"), real(x).alias("x"), real(y).alias("y"))
    s = d.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("x")).alias("sx"), F.sum(F.col("w") * F.col("y")).alias("sy"),
        F.sum(F.col("w") * F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("w") * F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("syy"),
    )
    det = F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx")
    b = (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / det
    a = (F.col("sy") * F.col("sxx") - F.col("sx") * F.col("sxy")) / det
    s = s.where((F.col("n") >= 2) & (det > 1e-12)).select(*by, "n", a.alias("a"), b.alias("b"), (F.col("sxx") / det).alias("var_a"), (F.col("sw") / det).alias("var_b"), "syy", "sy", "sxy")
    return s.withColumn("chi2", F.col("syy") - F.col("a") * F.col("sy") - F.col("b") * F.col("sxy")).drop("syy", "sy", "sxy")


def chi2_quantile(p: float, dof: int) -> float:
    """Quantile of the chi-square distribution by bisection of the regularised gamma function."""
    def cdf(x: float) -> float:
        a, y = dof / 2.0, x / 2.0
        if y <= 0:
            return 0.0
        if y < a + 1:
            term = total = 1.0 / a
            n = a
            while abs(term) > 1e-15 * abs(total):
                n += 1
                term *= y / n
                total += term
            return total * math.exp(-y + a * math.log(y) - math.lgamma(a))
        b, c = y + 1 - a, 1e300
        d = 1 / b
        h = d
        for i in range(1, 500):
            an = -i * (i - a)
            b += 2
            d = 1 / (an * d + b or 1e-300)
            c = b + an / c or 1e-300
            h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return 1 - math.exp(-y + a * math.log(y) - math.lgamma(a)) * h

    lo, hi = 0.0, max(10.0, dof + 20 * math.sqrt(2.0 * dof) + 50)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def chi2_test(df: DataFrame, by: Sequence[str], residual: str, var: str, states: int, sigmas: float = 4.0) -> DataFrame:
    """(by, rows, dof, chi2, limit, pass): sum of v^2 / r against the quantile of two-tailed normal ``sigmas``. dof = rows - (states - 1); under 1 fails.

    Quantiles up to 200 degrees of freedom are exact; larger ones follow the cube approximation (relative error under 1e-4).
    """
    g = df.where(F.col(var) > 0).groupBy(*by).agg(F.count("*").alias("rows"), F.sum(F.col(residual) * F.col(residual) / F.col(var)).alias("chi2"))
    g = g.withColumn("dof", (F.col("rows") - (states - 1)).cast("int"))
    alpha = 2 * (1 - NormalDist().cdf(sigmas))
    z = NormalDist().inv_cdf(1 - alpha)
    small = F.array(*[F.lit(chi2_quantile(1 - alpha, k)) for k in range(1, 201)])
    n = F.col("dof").cast("double")
    large = n * F.pow(1 - 2 / (9 * n) + z * F.sqrt(2 / (9 * n)), 3)
    limit = F.when(F.col("dof").between(1, 200), F.get(small, F.col("dof") - 1)).when(F.col("dof") > 200, large)
    return g.withColumn("limit", limit).withColumn("pass", F.coalesce(F.col("chi2") <= F.col("limit"), F.lit(False)))


def dilution(df: DataFrame, by: Sequence[str], azimuth: str, elevation: str) -> DataFrame:
    """(by, n, gdop, pdop, hdop, vdop) from the normal matrix of line-of-sight rows; zeros under four satellites or where it is singular."""
    sa, ca, se, ce = F.sin(azimuth), F.cos(azimuth), F.sin(elevation), F.cos(elevation)
    h = [ce * sa, ce * ca, se, F.lit(1.0)]
    sums = [F.sum(h[i] * h[j]).alias(f"m{i}{j}") for i in range(4) for j in range(i, 4)]
    g = df.groupBy(*by).agg(F.count("*").alias("n"), *sums)

    def m(i: int, j: int) -> Column:
        return F.col(f"m{min(i, j)}{max(i, j)}")

    def det3(r: list[int], c: list[int]) -> Column:
        return m(r[0], c[0]) * (m(r[1], c[1]) * m(r[2], c[2]) - m(r[1], c[2]) * m(r[2], c[1])) - m(r[0], c[1]) * (m(r[1], c[0]) * m(r[2], c[2]) - m(r[1], c[2]) * m(r[2], c[0])) + m(r[0], c[2]) * (m(r[1], c[0]) * m(r[2], c[1]) - m(r[1], c[1]) * m(r[2], c[0]))

    rest = [[x for x in range(4) if x != i] for i in range(4)]
    minors = [det3(rest[i], rest[i]) for i in range(4)]
    det = sum((((-1) ** j) * m(0, j) * det3(rest[0], rest[j]) for j in range(4)), F.lit(0.0))
    g = g.withColumns({f"c{i}": minors[i] for i in range(4)} | {"det": det})
    q = [F.col(f"c{i}") / F.col("det") for i in range(4)]
    ok = (F.col("n") >= 4) & (F.col("det") > 1e-12)

    def root(x: Column, name: str) -> Column:
        return F.when(ok, F.sqrt(x)).otherwise(0.0).alias(name)

    return g.select(*by, "n", root(q[0] + q[1] + q[2] + q[3], "gdop"), root(q[0] + q[1] + q[2], "pdop"), root(q[0] + q[1], "hdop"), root(q[2], "vdop"))


def receiver_counters(df: DataFrame, receiver: str, epoch: str, sat: str, code: str) -> DataFrame:
    """(receiver, epochs, observations, satellites, first, last, code_counts)."""
    per = df.groupBy(receiver, code).agg(F.count("*").alias("_n"))
    codes = per.groupBy(receiver).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(code, "_n")))).alias("code_counts"))
    g = df.groupBy(receiver).agg(F.countDistinct(epoch).alias("epochs"), F.count("*").alias("observations"), F.countDistinct(sat).alias("satellites"), F.min(epoch).alias("first"), F.max(epoch).alias("last"))
    return g.join(codes, receiver, "left")


def correlation(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(by, a, b, corr): correlation of each pair of columns, in long form."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    g = df.groupBy(*by).agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return g.select(*by, F.explode(rows).alias("_r")).select(*by, "_r.*")


def totals_pivot(df: DataFrame, key: str, kind: str, kinds: Sequence[str], top: int | None = None) -> DataFrame:
    """Counts of each kind per key with their total, largest first; ``top`` keeps that many rows."""
    g = df.groupBy(key).agg(*[F.count(F.when(F.col(kind) == k, 1)).alias(k) for k in kinds])
    g = g.withColumn("total", sum((F.col(f"`{k}`") for k in kinds), F.lit(0))).orderBy(F.desc("total"), key)
    return g.limit(top) if top else g


def grid_convolution(sites: DataFrame, grid: DataFrame, green_km: Sequence[float], green: Sequence[float]) -> DataFrame:
    """(site, re, im): loading at each site as the sum over the grid of load times Green's function at its distance.

    The grid is the larger side and is never shuffled: sites are few and go to it only behind a check of their number (in blocks of 2,000 beyond it).
    """
    from orrery.functions.geo import haversine_m

    total = sites.count()
    blocks = max(1, -(-total // 2000))
    out = None
    for b in range(blocks):
        s = sites if blocks == 1 else sites.where(F.pmod(F.xxhash64("site"), F.lit(blocks)) == b)
        j = grid.crossJoin(F.broadcast(s.select("site", F.col("lat").alias("_slat"), F.col("lon").alias("_slon"))))
        km = haversine_m(F.col("lat"), F.col("lon"), F.col("_slat"), F.col("_slon")) / 1000
        g = F.lit(float(green[-1]))
        for i in range(len(green_km) - 2, -1, -1):
            x0, x1, y0, y1 = green_km[i], green_km[i + 1], green[i], green[i + 1]
            g = F.when(km <= x1, y0 + (y1 - y0) * (F.greatest(km, F.lit(float(x0))) - x0) / (x1 - x0)).otherwise(g)
        one = j.groupBy("site").agg(F.sum(F.col("re") * F.col("area") * g).alias("re"), F.sum(F.col("im") * F.col("area") * g).alias("im"))
        out = one if out is None else out.unionByName(one)
    return out


def running_count(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.withColumn("count", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
