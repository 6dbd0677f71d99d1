"""The document store's query layer on canonical long tables: catalog, pivots, grouped arrays, arbitrary grouping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_discovery(df: DataFrame, document: str) -> DataFrame:
    """(key, rows): the keys that occur in a JSON or map column."""
    keys = F.map_keys(F.col(document)) if df.schema[document].dataType.typeName() == "map" else F.json_object_keys(F.col(document))
    return df.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("rows"))


def catalog(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(type, value): the distinct values of each column, as content documents list them."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("type"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(rows.alias("_r")).select("_r.*").where("value IS NOT NULL").distinct()


def group_push(df: DataFrame, by: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """One row per group with the values as arrays in the order of ``order``."""
    g = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, *values))).alias("_a"))
    return g.select(*by, *[F.col(f"_a.{c}").alias(c) for c in (order, *values)])


def arbitrary_group(df: DataFrame, by: Sequence[str], y: str, labels: Sequence[str]) -> DataFrame:
    """(by, y, n_values, excess): one y per group; where several differ, y is null and excess names the labels that still vary."""
    g = df.groupBy(*by).agg(F.min(y).alias("_y"), F.countDistinct(y).alias("n_values"), *[F.countDistinct(c).alias(f"_n_{c}") for c in labels])
    varying = F.array_compact(F.array(*[F.when(F.col(f"_n_{c}") > 1, F.lit(c)) for c in labels]))
    return g.select(*by, F.when(F.col("n_values") == 1, F.col("_y")).alias(y), "n_values", F.when(F.col("n_values") > 1, F.array_join(varying, ",")).otherwise("").alias("excess"))


def pivot_long(df: DataFrame, by: Sequence[str], kind: str, kinds: Sequence[str], value: str) -> DataFrame:
    """One row per key and one column per kind; a kind that is missing or occurs twice is null."""
    one = [F.when(F.count(F.when(F.col(kind) == k, 1)) == 1, F.max(F.when(F.col(kind) == k, F.col(value)))).alias(k) for k in kinds]
    return df.groupBy(*by).agg(*one)


def states_documents(df: DataFrame, by: Sequence[str], num: str, fields: Sequence[str]) -> DataFrame:
    """State documents: each field as an array ordered by ``num``, beside the numbers themselves."""
    return group_push(df, by, num, fields)


def reshape_states(df: DataFrame, by: Sequence[str], num: str, fields: Sequence[str], nums: Sequence[int]) -> DataFrame:
    """State documents back to columns <field>_<num>; missing or doubled numbers are null."""
    z = df.select(*by, F.explode(F.arrays_zip(F.col(num).alias("_n"), *[F.col(f) for f in fields])).alias("_z"))
    out = []
    for f in fields:
        for n in nums:
            at = F.col("_z._n") == n
            out.append(F.when(F.count(F.when(at, 1)) == 1, F.max(F.when(at, F.col(f"_z.{f}")))).alias(f"{f}_{n}"))
    return z.groupBy(*by).agg(*out)


def to_document(ids: Sequence[str], values: Sequence[str]) -> Column:
    """The trace document {"id": {...}, "val": {...}} as JSON."""
    return F.to_json(F.struct(F.struct(*ids).alias("id"), F.struct(*values).alias("val")))


def covariance_triangle(df: DataFrame, by: Sequence[str], i: str, j: str, p: str) -> DataFrame:
    """The upper triangle of long covariances as one array per key, row by row."""
    up = df.where(F.col(i) <= F.col(j))
    g = up.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(i, j, p))).alias("_a"))
    return g.select(*by, F.transform("_a", lambda s: s[p]).alias("covar"))


def upsert(old: DataFrame, new: DataFrame, by: Sequence[str]) -> DataFrame:
    """Old rows, those with a new row of the same key replaced by it."""
    return old.join(new.select(*by).distinct(), list(by), "left_anti").unionByName(new)


def retain(df: DataFrame, time: str, since: object) -> DataFrame:
    return df.where(F.col(time) >= F.lit(since))


def pseudo_state(states: DataFrame, combos: DataFrame, key: str, x: str) -> DataFrame:
    """(pseudo, value): states combined from their parents with coefficients; combos is (pseudo, parent, coeff)."""
    return combos.join(states.select(F.col(key).alias("parent"), F.col(x).alias("_x")), "parent").groupBy("pseudo").agg(F.sum(F.col("coeff") * F.col("_x")).alias("value"))


def linear_combination(design: DataFrame, values: DataFrame, noise: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F v and F R F' from long triplets: design (row, col, f), values (col, v), noise (col, col2, r)."""
    fv = design.join(values, "col").groupBy("row").agg(F.sum(F.col("f") * F.col("v")).alias("v"))
    other = design.select(F.col("row").alias("row2"), F.col("col").alias("col2"), F.col("f").alias("f2"))
    frf = design.join(noise, "col").join(other, "col2").groupBy("row", "row2").agg(F.sum(F.col("f") * F.col("r") * F.col("f2")).alias("r"))
    return fv, frf


def unshared_states(design: DataFrame, meas: str, state: str) -> DataFrame:
    """(meas, states): states only one measurement refers to, where it has at least two such; they can be merged into one."""
    once = design.groupBy(state).agg(F.countDistinct(meas).alias("_n"), F.min(meas).alias(meas)).where("_n = 1")
    g = once.groupBy(meas).agg(F.array_sort(F.collect_list(state)).alias("states"))
    return g.where(F.size("states") >= 2)


def measurement_documents(df: DataFrame, by: Sequence[str], comment: str, num: str, kinds: Sequence[str]) -> DataFrame:
    """One document per key: a map from '<comment>-<num>-<Kind>' to the value, kinds being columns such as Prefit, Postfit, Sigma. Of doubled names the largest value stands."""
    long = F.explode(F.array(*[F.struct(F.concat_ws("-", comment, num, F.lit(k)).alias("key"), F.col(k).cast("double").alias("value")) for k in kinds]))
    one = df.select(*by, long.alias("_e")).where("_e.value IS NOT NULL").groupBy(*by, F.col("_e.key").alias("_k")).agg(F.max("_e.value").alias("_v"))
    return one.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias("document"))


def merge_filters(filters: Sequence[DataFrame], keep: Sequence[str] | None = None) -> DataFrame:
    """Several filters' long covariances (i, j, p) as one block-diagonal filter, of the kept states only; states of different filters do not correlate."""
    parts = []
    for k, f in enumerate(filters):
        x = f if keep is None else f.where(F.col("i").isin(*keep) & F.col("j").isin(*keep))
        parts.append(x.withColumn("filter", F.lit(k)))
    return reduce(DataFrame.unionByName, parts)


def align_clocks(states: DataFrame, broadcast: DataFrame, key: str, clock: str, max_offset: float, tau: float) -> DataFrame:
    """Adds mu and tau: the mean each clock state is drawn to where its broadcast clock is within max_offset; elsewhere mu is null and tau -1 (not drawn)."""
    j = states.join(broadcast.select(key, F.col(clock).alias("_b")), key, "left")
    near = F.coalesce(F.abs(F.col(clock) - F.col("_b")) <= max_offset, F.lit(False))
    return j.withColumn("mu", F.when(near, F.col("_b"))).withColumn("tau", F.when(near, tau).otherwise(-1.0)).drop("_b")


def pair_by_stem(files: DataFrame, path: str, suffix: str) -> DataFrame:
    """(stem, forward, smoothed): files paired by the name without the suffix that marks smoothed ones."""
    name = F.regexp_extract(F.col(path), r"([^/]+?)(?:\.[^./]*)?$", 1)
    x = files.select(F.col(path).alias("_f"), name.alias("_n")).withColumn("_s", F.col("_n").endswith(suffix))
    x = x.withColumn("stem", F.when(F.col("_s"), F.expr(f"left(_n, length(_n) - {len(suffix)})")).otherwise(F.col("_n")))
    return x.groupBy("stem").agg(F.min(F.when(~F.col("_s"), F.col("_f"))).alias("forward"), F.min(F.when(F.col("_s"), F.col("_f"))).alias("smoothed")).where("forward IS NOT NULL AND smoothed IS NOT NULL")
