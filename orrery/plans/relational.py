"""Joins, windows, aggregates, selections and store queries over the driver's tables, with their SQL."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import ids as I
from orrery.functions import time as T
from orrery.operators import joins as J
from orrery.operators import select as S
from orrery.operators import series as W
from orrery.operators import stats as A
from orrery.operators import store as D
from orrery.plans.util import RESIDUALS, q6, r6, residuals, rounded
from orrery.streaming.epochs import classify, infer_interval, periodic_reset
from orrery.session import micros, sized, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
SERIES = ["recv", "sat", "sig", "meas"]
BUCKET = 86_400.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _kinds(spark: SparkSession, base: str, *kinds: str) -> list[DataFrame]:
    e = table(spark, base, "events")
    return [e.where(F.col("event_type") == k).select("event_id", "user_id", "ts", "value") for k in kinds]


_E = "SELECT event_id, user_id, ts, value FROM events WHERE event_type = "


# --- joins


@query(f"""SELECT l.event_id, r.event_id AS click_id, r.value AS click_value FROM ({_E}'purchase') l ASOF LEFT JOIN ({_E}'click') r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_backward(spark, base):
    p, c = _kinds(spark, base, "purchase", "click")
    return J.asof_join(p, c, ["user_id"], "ts", "ts", bucket_s=BUCKET, order=["event_id"]).select("event_id", F.col("right.event_id").alias("click_id"), F.col("right.value").alias("click_value"))


@query(f"""SELECT l.event_id, r.event_id AS click_id FROM ({_E}'purchase') l ASOF LEFT JOIN ({_E}'click') r ON l.user_id = r.user_id AND l.ts <= r.ts""")
def asof_forward(spark, base):
    p, c = _kinds(spark, base, "purchase", "click")
    return J.asof_join(p, c, ["user_id"], "ts", "ts", "forward", bucket_s=BUCKET, order=["event_id"]).select("event_id", F.col("right.event_id").alias("click_id"))


@query(f"""SELECT l.event_id, CASE WHEN epoch_us(l.ts) - epoch_us(r.ts) <= 7200000000 THEN r.event_id END AS click_id
FROM ({_E}'purchase') l ASOF LEFT JOIN ({_E}'click') r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_max_age(spark, base):
    p, c = _kinds(spark, base, "purchase", "click")
    return J.asof_join(p, c, ["user_id"], "ts", "ts", max_age_s=7200, bucket_s=BUCKET).select("event_id", F.col("right.event_id").alias("click_id"))


@query(f"""WITH b AS (SELECT l.event_id, l.user_id, l.ts, CASE WHEN epoch_us(l.ts) - epoch_us(r.ts) <= 86400000000 THEN r.event_id END AS b FROM ({_E}'purchase') l ASOF LEFT JOIN ({_E}'click') r ON l.user_id = r.user_id AND l.ts >= r.ts),
f AS (SELECT b.event_id, b.b, CASE WHEN epoch_us(r.ts) - epoch_us(b.ts) <= 86400000000 THEN r.event_id END AS f FROM b ASOF LEFT JOIN ({_E}'click') r ON b.user_id = r.user_id AND b.ts <= r.ts)
SELECT event_id, coalesce(b, f) AS click_id FROM f""")
def asof_fallback_future(spark, base):
    p, c = _kinds(spark, base, "purchase", "click")
    return J.asof_fallback(p, c, ["user_id"], "ts", "ts", 86_400, bucket_s=BUCKET).select("event_id", F.col("right.event_id").alias("click_id"))


@query(f"""SELECT l.event_id, r.event_id AS click_id FROM (SELECT *, ts - INTERVAL 2 HOUR AS t FROM ({_E}'purchase')) l ASOF LEFT JOIN ({_E}'click') r ON l.user_id = r.user_id AND l.t >= r.ts""")
def asof_delayed(spark, base):
    p, c = _kinds(spark, base, "purchase", "click")
    return J.asof_join(p, c, ["user_id"], "ts", "ts", delay_s=7200, bucket_s=BUCKET).select("event_id", F.col("right.event_id").alias("click_id"))


@query(f"""WITH c AS (SELECT l.event_id, r.event_id AS rid, abs(epoch_us(l.ts) - epoch_us(r.ts)) AS d, r.ts FROM ({_E}'purchase') l JOIN ({_E}'click') r ON l.user_id = r.user_id),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, ts) AS k FROM c WHERE d <= 43200000000)
SELECT l.event_id, k.rid AS click_id FROM ({_E}'purchase') l LEFT JOIN k ON l.event_id = k.event_id AND k.k = 1""")
def asof_nearest(spark, base):
    p, c = _kinds(spark, base, "purchase", "click")
    return J.asof_join(p, c, ["user_id"], "ts", "ts", "nearest", max_age_s=43_200, bucket_s=BUCKET).select("event_id", F.col("right.event_id").alias("click_id"))


_STRADDLE = f"""b AS (SELECT l.event_id, l.user_id, l.ts, r.ts AS t0, r.value AS v0 FROM ({_E}'click') l ASOF LEFT JOIN ({_E}'purchase') r ON l.user_id = r.user_id AND l.ts >= r.ts),
n AS (SELECT b.*, r.ts AS t1, r.value AS v1 FROM b ASOF LEFT JOIN ({_E}'purchase') r ON b.user_id = r.user_id AND b.ts <= r.ts)"""


@query(f"""WITH {_STRADDLE} SELECT event_id, v0 AS before, v1 AS after,
{q6("CASE WHEN t0 = ts THEN v0 WHEN t0 IS NOT NULL AND t1 IS NOT NULL AND epoch_us(t1) - epoch_us(t0) <= 1209600000000 THEN v0 + (v1 - v0) * ((epoch_us(ts) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0))) END")} AS interpolated FROM n""")
def straddle_interp(spark, base):
    p, c = _kinds(spark, base, "purchase", "click")
    return J.straddle(c, p, ["user_id"], "ts", "ts", "value", max_gap_s=1_209_600, bucket_s=BUCKET).select("event_id", "before", "after", r6("interpolated").alias("interpolated"))


@query()
def polynomial_interp(spark, base):
    """Clock-like values through up to 11 neighbours, in days to keep the polynomial's arguments small."""
    p, c = _kinds(spark, base, "purchase", "click")
    j = J.neighbours(c, p, ["user_id"], "ts", "ts", "value", 6, 5, 10 * 86_400, 20 * 86_400)
    pts = F.transform("points", lambda x: F.struct(((x["t"] - micros("ts")) / 86_400e6).alias("t"), x["v"].alias("v")))
    return j.select("event_id", F.size("points").alias("n"), r6(J.neville(pts, F.lit(0.0))).alias("value"))


_DAILY = "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, avg(value) AS v FROM events WHERE event_type = '{}' GROUP BY ALL"


def _daily(spark, base, kind):
    return table(spark, base, "events").where(F.col("event_type") == kind).groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.avg("value").alias("v"))


@query(f"""SELECT a.user_id, a.day, {q6("a.v - b.v")} AS v FROM ({_DAILY.format("click")}) a JOIN ({_DAILY.format("purchase")}) b USING (user_id, day)""")
def epoch_diff(spark, base):
    return rounded(J.difference(_daily(spark, base, "click"), _daily(spark, base, "purchase"), ["user_id", "day"], ["v"]), "v")


@query(f"""SELECT user_id, day, {q6("coalesce(b.v, a.v)")} AS v FROM ({_DAILY.format("click")}) a FULL JOIN ({_DAILY.format("purchase")}) b USING (user_id, day)""")
def outer_merge(spark, base):
    return rounded(J.merge_outer(_daily(spark, base, "click"), _daily(spark, base, "purchase"), ["user_id", "day"], ["v"]), "v")


@query(f"""SELECT user_id, day, CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN 'both' WHEN a.v IS NOT NULL THEN 'left' ELSE 'right' END AS side
FROM ({_DAILY.format("click")}) a FULL JOIN ({_DAILY.format("purchase")}) b USING (user_id, day)""")
def match_three(spark, base):
    return J.match_three(_daily(spark, base, "click"), _daily(spark, base, "purchase"), ["user_id", "day"])


@query("""SELECT o.o_orderkey, o.o_orderdate, r.k AS entry FROM orders o ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS k FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL) r
ON o.o_custkey = r.o_custkey AND o.o_orderdate >= r.o_orderdate""")
def validity_keep_expired(spark, base):
    """Backward on start; an entry stays in use after its end."""
    o = table(spark, base, "orders")
    r = o.where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("start"), F.date_add("o_orderdate", 90).cast("timestamp").alias("end"))
    one = r.groupBy("o_custkey", "start").agg(F.max("o_orderkey").alias("o_orderkey"), F.max("end").alias("end"))
    return J.valid_at(o, one, ["o_custkey"], "o_orderdate", "start", "end", "keep", 30 * BUCKET).select("o_orderkey", "o_orderdate", F.col("right.o_orderkey").alias("entry"))


@query("""WITH r AS (SELECT o_custkey, o_orderdate AS s, o_orderdate + INTERVAL 30 DAY AS e, o_orderkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT o.o_orderkey, min(r.k) AS entry FROM orders o LEFT JOIN r ON o.o_custkey = r.o_custkey AND o.o_orderdate BETWEEN r.s AND r.e GROUP BY o.o_orderkey""")
def interval_first(spark, base):
    o = table(spark, base, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    r = table(spark, base, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey", F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("s"), F.expr("o_orderdate + INTERVAL 30 DAY").alias("e"))
    return J.interval_first(o, r, ["o_custkey"], "o_orderdate", "s", "e", "k", 30 * BUCKET).select("o_orderkey", F.col("right.k").alias("entry"))


@query("""SELECT c.c_custkey, coalesce(a.v, b.v, c.c_acctbal) AS v, CASE WHEN a.v IS NOT NULL THEN 1 WHEN b.v IS NOT NULL THEN 2 WHEN c.c_acctbal IS NOT NULL THEN 3 END AS source FROM customer c
LEFT JOIN (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) a ON a.k = c.c_custkey LEFT JOIN (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1) b ON b.k = c.c_custkey""")
def source_fallback(spark, base):
    c, o = table(spark, base, "customer"), table(spark, base, "orders")
    first = o.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("v"))
    second = o.where("o_orderpriority = '5-LOW'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("v"))
    third = c.select("c_custkey", F.col("c_acctbal").alias("v"))
    return J.priority_coalesce(c.select("c_custkey"), [first, second, third], ["c_custkey"], "v")


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b, n_nationkey * 0.5 AS v FROM nation),
x AS (SELECT a, b, v FROM e WHERE a <> b UNION ALL SELECT b, a, -v FROM e WHERE a <> b),
p AS (SELECT a, b, v, 1 AS hops, [a, b] AS path FROM x UNION ALL SELECT p.a, x.b, p.v + x.v, p.hops + 1, list_append(p.path, x.b) FROM p JOIN x ON p.b = x.a WHERE NOT list_contains(p.path, x.b)),
k AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY hops, path, v) AS k FROM p)
SELECT CAST(a AS INTEGER) AS src, CAST(b AS INTEGER) AS dst, CAST(v AS DOUBLE) AS value, CAST(hops AS INTEGER) AS hops FROM k WHERE k = 1""")
def bias_chain(spark, base):
    n = table(spark, base, "nation")
    e = n.select(F.col("n_nationkey").cast("int").alias("c1"), ((F.col("n_nationkey") * 7 + 3) % 25).cast("int").alias("c2"), (F.col("n_nationkey") * 0.5).cast("double").alias("bias"), F.lit(0.01).alias("var")).where("c1 <> c2")
    return J.chain_lookup(e, "c1", "c2", "bias", "var").select("src", "dst", "value", F.col("hops").cast("int").alias("hops"))


@query("""WITH l AS (SELECT o_custkey AS k, o_orderpriority AS lev, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS a, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS b FROM orders GROUP BY 1, 2)
SELECT k, max_by(a, CASE WHEN a IS NOT NULL THEN lev END) AS a, max_by(b, CASE WHEN b IS NOT NULL THEN lev END) AS b FROM l GROUP BY k""")
def option_inheritance(spark, base):
    l = table(spark, base, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("lev")).agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("a"), F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("b"))
    return J.inherit_options(l, "k", "lev", ["a", "b"])


_PRIO = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
_PSQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END"


@query(f"""SELECT o_custkey, min_by(o_orderkey, ({_PSQL}) * 1e12 + o_orderkey) AS value, min_by(o_orderpriority, {_PSQL}) AS o_orderpriority, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS sources FROM orders WHERE {_PSQL} IS NOT NULL GROUP BY 1""")
def metadata_priority(spark, base):
    o = table(spark, base, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("value"))
    return J.metadata_priority(o, "o_custkey", "o_orderpriority", "value", _PRIO).select("o_custkey", "value", "o_orderpriority", F.array_join("sources", ",").alias("sources"))


@query("""SELECT s.site, r.name AS region FROM station s JOIN (SELECT * FROM (VALUES ('north', 30.0, 90.0, -180.0, 180.0), ('tropics', -23.5, 23.5, -180.0, 180.0), ('east', -90.0, 90.0, 0.0, 90.0)) v(name, lat0, lat1, lon0, lon1)) r
ON s.Latitude BETWEEN r.lat0 AND r.lat1 AND s.Longitude BETWEEN r.lon0 AND r.lon1""")
def region_containment(spark, base):
    s = table(spark, base, "station").select("site", F.col("Latitude").alias("lat"), F.col("Longitude").alias("lon"))
    r = spark.createDataFrame([("north", 30.0, 90.0, -180.0, 180.0), ("tropics", -23.5, 23.5, -180.0, 180.0), ("east", -90.0, 90.0, 0.0, 90.0)], "region string, lat0 double, lat1 double, lon0 double, lon1 double")
    return J.in_region(s, r).select("site", "region")


@query("""SELECT count(*) AS n, round(sum(l.l_extendedprice) + 1e-9, 2) AS total, n_name FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n_name""")
def star_join(spark, base):
    l, o, c, n = (table(spark, base, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice") + 1e-9, 2).alias("total")).select("n", "total", "n_name")


# --- series


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY datetime, meas, sat, recv, sig ORDER BY iter DESC, res_id DESC) AS k FROM residual) SELECT res_id, recv, sat, sig, iter, postfit FROM r WHERE k = 1""")
def last_iteration(spark, base):
    return W.last_iteration(table(spark, base, "residual"), ["datetime", *SERIES], "iter", ["res_id"]).select("res_id", "recv", "sat", "sig", "iter", "postfit")


@query("""WITH e AS (SELECT event_id, value, last_value(nullif(value, 0) IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM events)
SELECT event_id, round(value - p + 1e-9, 6) AS delta, coalesce(abs(value - p) > 100, false) AS slip FROM e WHERE value <> 0""")
def slip_detect(spark, base):
    e = W.jump(table(spark, base, "events").where("value <> 0"), ["user_id"], ["ts", "event_id"], "value", 100.0)
    return e.select("event_id", r6("delta").alias("delta"), "slip")


@query("""WITH e AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(g + 1e-9, 6) AS gap_s, CAST(sum(CASE WHEN g > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS arc FROM e""")
def gap_segments(spark, base):
    a = W.arcs(table(spark, base, "events"), ["user_id"], "ts", ["ts", "event_id"], 86_400)
    return a.select("event_id", r6("gap_s").alias("gap_s"), "arc")


@query("""WITH e AS (SELECT site, "Time" AS t, dN, lead("Time") OVER (PARTITION BY site ORDER BY "Time") AS n FROM (SELECT DISTINCT site, "Time", dN + 0.0 AS dN FROM pos_solution WHERE dN IS NOT NULL AND NOT isnan(dN)))
SELECT site, t AS time, dN, false AS is_break FROM e UNION ALL SELECT site, t + INTERVAL 1 MILLISECOND, NULL, true FROM e WHERE epoch_us(n) - epoch_us(t) > 3600000000""")
def gap_breaks(spark, base):
    p = table(spark, base, "pos_solution").where("dN IS NOT NULL AND NOT isnan(dN)").select("site", F.col("Time").alias("time"), (F.col("dN") + 0.0).alias("dN")).distinct()
    return W.break_rows(p, ["site"], "time", ["dN"], 3600)


@query("""WITH g AS (SELECT event_id, user_id, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS b, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
l AS (SELECT *, coalesce(b > 43200 AND a > 43200, false) AS lone FROM g), j AS (SELECT *, lone AND a < b AS joins FROM l), s AS (SELECT *, lag(joins) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pj FROM j)
SELECT event_id, CAST(sum(CASE WHEN lone THEN CAST(joins AS INTEGER) WHEN pj THEN 0 WHEN b > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS arc FROM s""")
def singleton_arcs(spark, base):
    return W.join_singletons(table(spark, base, "events"), ["user_id"], "ts", ["ts", "event_id"], 43_200).select("event_id", "arc")


@query(f"""SELECT res_id, {q6("postfit - avg(postfit) OVER (PARTITION BY recv, sat, sig, meas)")} AS demeaned FROM {RESIDUALS}""")
def demean_series(spark, base):
    return W.demean(residuals(spark, base), SERIES, "postfit").select("res_id", r6("demeaned").alias("demeaned"))


@query(f"""SELECT res_id, {q6("postfit - avg(postfit) OVER (PARTITION BY datetime)")} AS demeaned FROM {RESIDUALS}""")
def demean_epoch(spark, base):
    return W.demean(residuals(spark, base), ["datetime"], "postfit").select("res_id", r6("demeaned").alias("demeaned"))


_OKS = "sigma IS NOT NULL AND NOT isnan(sigma) AND sigma <> 0"


@query(f"""WITH r AS (SELECT *, CASE WHEN {_OKS} THEN 1 / (sigma * sigma) ELSE 1 END AS w FROM {RESIDUALS})
SELECT res_id, {q6("postfit - sum(w * postfit) OVER (PARTITION BY recv, sat, sig, meas) / sum(w) OVER (PARTITION BY recv, sat, sig, meas)")} AS reduced FROM r""")
def remove_weighted_mean(spark, base):
    return W.remove_weighted_mean(residuals(spark, base), SERIES, "postfit", "sigma").select("res_id", r6("reduced").alias("reduced"))


@query("""WITH d AS (SELECT event_id, user_id, value, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS x FROM events),
f AS (SELECT user_id, regr_slope(value, x) AS s, regr_intercept(value, x) AS i FROM d GROUP BY 1) SELECT event_id, round(value - (i + s * x) + 1e-9, 5) AS detrended FROM d JOIN f USING (user_id)""")
def detrend_linear(spark, base):
    return W.detrend(table(spark, base, "events"), ["user_id"], "ts", "value").select("event_id", F.round(F.col("detrended") + 1e-9, 5).alias("detrended"))


@query("""SELECT event_id FROM events QUALIFY (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1) % 5 = 0""")
def decimate_n(spark, base):
    return W.decimate(table(spark, base, "events"), ["user_id", "event_type"], ["ts", "event_id"], 5).select("event_id")


@query("""SELECT user_id, min_by(value, ts) AS base FROM events GROUP BY 1""")
def first_epoch_base(spark, base):
    return W.first_value(table(spark, base, "events"), ["user_id"], ["ts"], "value")


_TYPES = ["click", "purchase", "view"]


@query("""WITH d AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'view') AS v FROM events GROUP BY ALL)
SELECT user_id, day, CAST(sum(c) OVER w AS BIGINT) AS click, CAST(sum(p) OVER w AS BIGINT) AS purchase, CAST(sum(v) OVER w AS BIGINT) AS view FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)""")
def cumulative_counts(spark, base):
    return W.cumulative_counts(table(spark, base, "events").withColumn("day", F.to_date("ts").cast("string")), ["user_id"], "day", "event_type", _TYPES)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(sum(l_extendedprice - l_quantity) OVER w + 1e-9, 4) AS chain, round(sum(CASE WHEN l_discount > 0 THEN l_discount ELSE 0 END) OVER w + 1e-9, 4) AS chain_var FROM lineitem
WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING)""")
def residual_chain(spark, base):
    l = table(spark, base, "lineitem").withColumn("d", F.col("l_extendedprice") - F.col("l_quantity"))
    return W.residual_chain(l, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], "d", "l_discount").select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("chain", "chain_var")])


@query("""WITH e AS (SELECT event_id, user_id, ts, value > 50 AS f, sum(CASE WHEN value > 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT event_id, CAST(sum(CAST(f AS INTEGER)) OVER (PARTITION BY user_id, i ORDER BY ts, event_id) AS BIGINT) AS run FROM e""")
def run_lengths(spark, base):
    return W.run_lengths(table(spark, base, "events").withColumn("f", F.col("value") > 50), ["user_id"], ["ts", "event_id"], "f").select("event_id", "run")


@query(f"""SELECT res_id, abs(postfit - avg(postfit) OVER w) > 3 * stddev_pop(postfit) OVER w AS outlier FROM {RESIDUALS} WINDOW w AS (PARTITION BY recv, sat, sig, meas)""")
def outlier_mask_single(spark, base):
    return W.outlier_mask(residuals(spark, base), SERIES, "postfit").select("res_id", "outlier")


@query("""WITH a AS (SELECT min(ts) AS a, max(ts) AS z FROM events) SELECT event_id FROM events, a WHERE ts >= a + INTERVAL 1440 MINUTE AND ts <= z - INTERVAL 1440 MINUTE""")
def trim_ends(spark, base):
    return W.trim_ends(table(spark, base, "events"), "ts", 1440).select("event_id")


@query("""SELECT event_id, max(CASE WHEN value > 150 THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_event FROM events""")
def last_slip_event(spark, base):
    e = table(spark, base, "events").withColumn("f", F.col("value") > 150).withColumn("us", micros("ts"))
    return W.last_event(e, ["user_id"], ["ts", "event_id"], "f", "us").select("event_id", "last_event")


@query("""SELECT DISTINCT sat, substr(sat, 1, 1) AS system, CAST(substr(sat, 2) AS INTEGER) AS prn, dense_rank() OVER (ORDER BY substr(sat, 1, 1), CAST(substr(sat, 2) AS INTEGER)) AS k FROM residual""")
def natural_sat_order(spark, base):
    s = table(spark, base, "residual").select("sat").distinct()
    return s.select("sat", I.sat_system(F.col("sat")).alias("system"), I.sat_prn(F.col("sat")).alias("prn"), F.dense_rank().over(Window.orderBy(*W.sat_order("sat"))).cast("long").alias("k"))


# --- aggregates


@query(f"""SELECT recv, sat, sig, meas, count(*) AS n, {q6("avg(postfit)")} AS mean, {q6("sum(postfit * postfit)")} AS sumsq, {q6("sqrt(avg(postfit * postfit))")} AS rms FROM {RESIDUALS} GROUP BY ALL""")
def series_statistics(spark, base):
    return rounded(A.series_statistics(residuals(spark, base), SERIES, "postfit"), "mean", "sumsq", "rms")


@query(f"""WITH s AS (SELECT recv, sat, sig, meas, count(*) AS n, avg(postfit) AS mean, sum(postfit * postfit) AS q FROM {RESIDUALS} GROUP BY ALL)
SELECT recv, CAST(sum(n) AS BIGINT) AS n, {q6("avg(mean)")} AS mean, {q6("sqrt(sum(q) / sum(n))")} AS rms FROM s GROUP BY recv""")
def aggregate_statistics(spark, base):
    return rounded(A.aggregate_statistics(A.series_statistics(residuals(spark, base), SERIES, "postfit"), ["recv"]), "mean", "rms")


@query(f"""SELECT sig, meas, count(*) AS n, {q6("avg(postfit)")} AS mean, {q6("median(postfit)")} AS median, {q6("stddev_pop(postfit)")} AS std, {q6("sqrt(avg(postfit * postfit))")} AS rms FROM {RESIDUALS} GROUP BY ALL""")
def component_table(spark, base):
    return rounded(A.component_table(residuals(spark, base), ["sig", "meas"], "postfit"), "mean", "median", "std", "rms")


_WS = f"SELECT recv, count(*) AS n, sum(w) AS sw, sum(w * postfit) AS s1, sum(w * postfit * postfit) AS s2 FROM (SELECT *, 1 / (sigma * sigma) AS w FROM {RESIDUALS} WHERE sigma > 0 AND NOT isnan(sigma)) GROUP BY recv"


@query(f"""SELECT recv, n, {q6("s1 / sw")} AS wmean, {q6("sqrt(greatest(s2 / sw - (s1 / sw) * (s1 / sw), 0))")} AS wstd, {q6("sqrt(s2 / sw)")} AS wrms FROM ({_WS})""")
def weighted_stats(spark, base):
    return rounded(A.weighted_statistics(residuals(spark, base), ["recv"], "postfit", "sigma"), "wmean", "wstd", "wrms")


@query(f"""WITH p AS (SELECT label, count(*) AS n, avg(postfit) AS mean, stddev_samp(postfit) AS std, sqrt(avg(postfit * postfit)) AS rms FROM {RESIDUALS} WHERE label IS NOT NULL GROUP BY 1)
SELECT label, n, {q6("mean")} AS mean, {q6("std")} AS std, {q6("rms")} AS rms FROM p""")
def label_statistics(spark, base):
    return rounded(A.label_statistics(residuals(spark, base).where("label IS NOT NULL"), ["label"], "postfit", "sigma").select("label", "n", "mean", "std", "rms"), "mean", "std", "rms")


@query(f"""SELECT recv, sat, count(*) AS n, {q6("avg(postfit)")} AS mean, {q6("stddev_samp(postfit)")} AS std, {q6("sqrt(avg(postfit * postfit))")} AS rms, CAST(grouping(recv, sat) AS INTEGER) AS margin FROM {RESIDUALS} GROUP BY CUBE (recv, sat)""")
def recv_sat_matrix(spark, base):
    return rounded(A.matrix_with_margins(residuals(spark, base), "recv", "sat", "postfit"), "mean", "std", "rms")


@query(f"""SELECT event_type, count(*) AS n, {q6("avg(value)")} AS mean, {q6("stddev_pop(value)")} AS std, {q6("min(value)")} AS min, {", ".join(f"{q6(f'quantile_cont(value, {p / 100})')} AS p{p}" for p in (5, 10, 50, 75, 90, 95))}, {q6("max(value)")} AS max FROM events GROUP BY 1""")
def percentile_table(spark, base):
    c = ["mean", "std", "min", "p5", "p10", "p50", "p75", "p90", "p95", "max"]
    return rounded(A.difference_statistics(table(spark, base, "events"), ["event_type"], "value"), *c).select("event_type", "n", *c)


_AT = [k / 99 for k in range(100)]
_NORMAL = ", ".join(f"({k}, {p!r}::DOUBLE, {NormalDist().inv_cdf(p)!r}::DOUBLE)" if 0 < p < 1 else f"({k}, {p!r}::DOUBLE, '{'-' if p <= 0 else ''}inf'::DOUBLE)" for k, p in enumerate(_AT))


@query(f"""WITH n(k, p, normal) AS (VALUES {_NORMAL}), q AS (SELECT event_type, quantile_cont(value, {[float(p) for p in _AT]}) AS q FROM events WHERE NOT isnan(value) GROUP BY 1)
SELECT event_type, CAST(k AS INTEGER) AS "at", {q6("q[k + 1]")} AS q, {q6("normal")} AS normal FROM q, n""")
def qq_quantiles(spark, base):
    return rounded(A.qq_quantiles(table(spark, base, "events"), ["event_type"], "value"), "q", "normal")


@query(f"""SELECT site, {", ".join(f"{q6(f'sqrt(avg({c} * {c}))')} AS rms_{c}" for c in ("dN", "dE", "dU"))}, {q6("sqrt(avg(dN * dN + dE * dE + dU * dU))")} AS rms_3d FROM pos_solution
WHERE dN IS NOT NULL AND dE IS NOT NULL AND dU IS NOT NULL AND NOT isnan(dN) AND NOT isnan(dE) AND NOT isnan(dU) GROUP BY 1""")
def position_rms(spark, base):
    p = table(spark, base, "pos_solution").where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in ("dN", "dE", "dU")))
    return rounded(A.rms_3d(p, ["site"], ["dN", "dE", "dU"]), "rms_dN", "rms_dE", "rms_dU", "rms_3d")


@query(f"""WITH s AS (SELECT l_returnflag, l_linestatus, count(*) AS n, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM
(SELECT l_returnflag, l_linestatus, 1 / (l_linenumber * l_linenumber) AS w, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem) GROUP BY ALL)
SELECT l_returnflag, l_linestatus, n, {q6("(sy * sxx - sx * sxy) / (sw * sxx - sx * sx)")} AS a, {q6("(sw * sxy - sx * sy) / (sw * sxx - sx * sx)")} AS b FROM s""")
def wls_normal_eq(spark, base):
    l = table(spark, base, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000).withColumn("s", F.col("l_linenumber").cast("double"))
    return rounded(A.wls_line(l, ["l_returnflag", "l_linestatus"], "l_quantity", "y", "s").select("l_returnflag", "l_linestatus", "n", "a", "b"), "a", "b")


@query(f"""SELECT recv, sat, count(*) AS rows, CAST(count(*) - 3 AS INTEGER) AS dof, {q6("sum(postfit * postfit / (sigma * sigma))")} AS chi2 FROM {RESIDUALS} WHERE sigma * sigma > 0 GROUP BY ALL""")
def chi2_test(spark, base):
    r = residuals(spark, base).withColumn("v", F.col("sigma") * F.col("sigma"))
    return A.chi2_test(r, ["recv", "sat"], "postfit", "v", 4).select("recv", "sat", "rows", "dof", r6("chi2").alias("chi2"))


_TAIL = 2 * (1 - NormalDist().cdf(4.0))
_LIMITS = ", ".join(f"({k}, {A.chi2_quantile(1 - _TAIL, k)!r}::DOUBLE)" for k in range(1, 201))
_Z = repr(NormalDist().inv_cdf(1 - _TAIL)) + "::DOUBLE"


@query(f"""WITH t(dof, l) AS (VALUES {_LIMITS}), s AS (SELECT recv, sat, CAST(count(*) - 3 AS INTEGER) AS dof, sum(postfit * postfit / (sigma * sigma)) AS c FROM {RESIDUALS} WHERE sigma * sigma > 0 GROUP BY ALL),
j AS (SELECT s.*, CASE WHEN s.dof > 200 THEN s.dof * pow(1 - 2 / (9.0::DOUBLE * s.dof) + {_Z} * sqrt(2 / (9.0::DOUBLE * s.dof)), 3) ELSE t.l END AS l FROM s LEFT JOIN t ON s.dof = t.dof)
SELECT recv, sat, dof, {q6("l")} AS "limit", coalesce(c <= l, false) AS pass FROM j""")
def chi2_pass(spark, base):
    r = residuals(spark, base, "postfit").withColumn("v", F.col("sigma") * F.col("sigma"))
    return A.chi2_test(r, ["recv", "sat"], "postfit", "v", 4).select("recv", "sat", "dof", r6("limit").alias("limit"), "pass")


@query(f"""SELECT recv, count(DISTINCT datetime) AS epochs, count(*) AS observations, count(DISTINCT sat) AS satellites, min(datetime) AS first, max(datetime) AS last FROM residual GROUP BY 1""")
def receiver_counters(spark, base):
    return A.receiver_counters(table(spark, base, "residual"), "recv", "datetime", "sat", "sig").drop("code_counts")


@query("""SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS view,
count(*) FILTER (event_type IN ('click', 'purchase', 'view')) AS total FROM events GROUP BY 1 ORDER BY total DESC, user_id LIMIT 20""")
def topn_groups(spark, base):
    return A.totals_pivot(table(spark, base, "events"), "user_id", "event_type", _TYPES, top=20)


@query(f"""SELECT l_returnflag, 'l_quantity' AS a, 'l_extendedprice' AS b, {q6("corr(l_quantity, l_extendedprice)")} AS corr FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'l_quantity', 'l_tax', {q6("corr(l_quantity, l_tax)")} FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'l_extendedprice', 'l_tax', {q6("corr(l_extendedprice, l_tax)")} FROM lineitem GROUP BY 1 UNION ALL SELECT DISTINCT l_returnflag, c, c, 1.0 FROM lineitem, (VALUES ('l_quantity'), ('l_extendedprice'), ('l_tax')) v(c)""")
def correlation_matrix(spark, base):
    return rounded(A.correlation(table(spark, base, "lineitem"), ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_tax"]), "corr")


# --- selection


@query(f"""SELECT o_custkey, o_orderkey, o_orderpriority FROM orders WHERE {_PSQL} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, {_PSQL}, o_orderkey) = 1""")
def priority_select(spark, base):
    o = table(spark, base, "orders")
    return S.by_priority(o, ["o_custkey"], "o_orderpriority", _PRIO, [F.col("o_orderstatus") == "F"], ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("""SELECT p_partkey, p_name FROM part WHERE p_name LIKE '_a%' OR p_name LIKE '%e'""")
def wildcard_match(spark, base):
    return table(spark, base, "part").where(S.wildcard("p_name", "?a*") | S.wildcard("p_name", "*e")).select("p_partkey", "p_name")


@query("""SELECT event_id, CASE WHEN value > 100 THEN 1 ELSE 0 END + CASE WHEN user_id % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN event_type = 'view' THEN 4 ELSE 0 END AS word FROM events""")
def exclusion_bits(spark, base):
    e = table(spark, base, "events").withColumn("a", F.col("value") > 100).withColumn("b", F.col("user_id") % 2 == 0).withColumn("c", F.col("event_type") == "view")
    return e.select("event_id", S.exclusion_word(["a", "b", "c"]).alias("word"))


@query(f"""SELECT recv, sat, count(*) AS n FROM residual WHERE upper(sat) IN ('G05', 'E12', 'R07') AND regexp_matches(coalesce(label, ''), '^KF-[0-4]') AND datetime >= TIMESTAMP '2019-01-07' AND datetime < TIMESTAMP '2019-01-12' GROUP BY ALL""")
def attribute_filter(spark, base):
    r = table(spark, base, "residual").where(S.in_ignore_case("sat", ["g05", "E12", "r07"]) & F.coalesce(F.col("label"), F.lit("")).rlike("^KF-[0-4]"))
    r = r.withColumn("at", F.col("datetime").cast("timestamp")).where((F.col("at") >= F.to_timestamp(F.lit("2019-01-07"))) & (F.col("at") < F.to_timestamp(F.lit("2019-01-12"))))
    return r.groupBy("recv", "sat").agg(F.count("*").alias("n"))


@query("""SELECT res_id FROM residual WHERE postfit IS NOT NULL AND isfinite(postfit)""")
def finite_filter(spark, base):
    return table(spark, base, "residual").where(S.finite("postfit")).select("res_id")


@query("""SELECT event_id FROM events WHERE event_type NOT IN ('purchase', 'view') OR value > 50""")
def kind_conditional(spark, base):
    return table(spark, base, "events").where(S.only_where("event_type", ["purchase", "view"], F.col("value") > 50)).select("event_id")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN coalesce(v, max(CASE WHEN l_returnflag = 'N' THEN v END) OVER (PARTITION BY l_orderkey)) ELSE v END AS v FROM (SELECT *, CASE WHEN l_quantity > 25 THEN l_extendedprice END AS v FROM lineitem)""")
def phase_repair(spark, base):
    l = table(spark, base, "lineitem").withColumn("v", F.when(F.col("l_quantity") > 25, F.col("l_extendedprice")))
    return S.repair_missing(l, ["l_orderkey"], "l_returnflag", "R", "N", "v").select("l_orderkey", "l_linenumber", "v")


_EXP = "(SELECT recv, sig FROM (SELECT DISTINCT recv FROM residual), (SELECT DISTINCT sig FROM residual)) x"


def _expected(spark, base):
    r = table(spark, base, "residual")
    return r.select("recv").distinct().join(sized(r.select("sig").distinct()))


@query(f"""SELECT x.recv, x.sig, CASE WHEN o.p <> 0 AND o.l <> 0 THEN 'OBSERVED' WHEN o.p <> 0 THEN 'CODE_ONLY' WHEN o.l <> 0 THEN 'PHASE_ONLY' ELSE 'MISSING' END AS class FROM {_EXP} LEFT JOIN
(SELECT recv, sig, max(CASE WHEN meas = 'CODE_MEAS' THEN 1.0 END) AS p, max(CASE WHEN meas = 'PHAS_MEAS' THEN 1.0 END) AS l FROM residual GROUP BY ALL) o ON x.recv = o.recv AND x.sig = o.sig""")
def expected_signals(spark, base):
    r = table(spark, base, "residual").withColumn("P", F.when(F.col("meas") == "CODE_MEAS", 1.0)).withColumn("L", F.when(F.col("meas") == "PHAS_MEAS", 1.0))
    return S.classify_expected(_expected(spark, base), r, ["recv"], "sig", "P", "L").select("recv", "sig", "class")


@query(f"""SELECT recv, sig FROM {_EXP} ANTI JOIN residual r ON x.recv = r.recv AND x.sig = r.sig""")
def not_tracked(spark, base):
    return S.not_tracked(_expected(spark, base), table(spark, base, "residual"), ["recv", "sig"]).select("recv", "sig")


@query("""SELECT o_custkey, max(o_orderdate) AS s, min(CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 2000 DAY END) AS e FROM orders GROUP BY 1 HAVING e IS NULL OR s <= e""")
def validity_restriction(spark, base):
    o = table(spark, base, "orders").select("o_custkey", F.col("o_orderdate").alias("s"), F.when(F.col("o_orderstatus") != "O", F.expr("o_orderdate + INTERVAL 2000 DAY")).alias("e"))
    return S.validity(o, ["o_custkey"], "s", "e")


@query("""SELECT user_id, event_type, max(ts) AS ts, max_by(value, ts) AS value FROM events GROUP BY 1, 2""")
def latest_per_key(spark, base):
    return S.latest(table(spark, base, "events").select("user_id", "event_type", "ts", "value"), ["user_id", "event_type"], "ts")


@query("""SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 2""")
def latest_two(spark, base):
    return S.latest(table(spark, base, "events"), ["user_id"], "ts", 2).select("event_id")


@query("""WITH n AS (SELECT user_id, max(epoch_us(ts)) AS n FROM events GROUP BY 1), m AS (SELECT max(epoch_us(ts)) AS now FROM events)
SELECT event_id FROM events e JOIN n USING (user_id), m WHERE epoch_us(ts) >= now - 7200 * 1000000::BIGINT OR epoch_us(ts) = n""")
def expiry_keep_newest(spark, base):
    e = table(spark, base, "events")
    now = e.agg(F.max(micros("ts"))).first()[0] or 0
    return S.expire(e, ["user_id"], "ts", now, 7200).select("event_id")


# --- store


@query("""SELECT k AS key, count(*) AS rows FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY 1""")
def key_discovery(spark, base):
    return D.key_discovery(table(spark, base, "events"), "props")


@query("""SELECT 'recv' AS type, recv AS value FROM residual WHERE recv IS NOT NULL GROUP BY 2 UNION ALL SELECT 'sat', sat FROM residual WHERE sat IS NOT NULL GROUP BY 2 UNION ALL SELECT 'sig', sig FROM residual WHERE sig IS NOT NULL GROUP BY 2""")
def content_catalog(spark, base):
    return D.catalog(table(spark, base, "residual"), ["recv", "sat", "sig"])


@query("""SELECT user_id, event_type, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS ids FROM events GROUP BY 1, 2""")
def group_push(spark, base):
    return D.group_push(table(spark, base, "events"), ["user_id", "event_type"], "ts", ["event_id"]).select("user_id", "event_type", F.array_join(F.transform("event_id", lambda x: x.cast("string")), ",").alias("ids"))


@query("""WITH g AS (SELECT o_custkey, o_orderdate, min(o_orderstatus) AS y, count(DISTINCT o_orderstatus) AS n_values, count(DISTINCT o_orderpriority) AS p, count(DISTINCT o_orderkey) AS k FROM orders GROUP BY 1, 2)
SELECT o_custkey, o_orderdate, CASE WHEN n_values = 1 THEN y END AS o_orderstatus, n_values, CASE WHEN n_values > 1 THEN concat_ws(',', CASE WHEN p > 1 THEN 'o_orderpriority' END, CASE WHEN k > 1 THEN 'o_orderkey' END) ELSE '' END AS excess FROM g""")
def arbitrary_group(spark, base):
    return D.arbitrary_group(table(spark, base, "orders"), ["o_custkey", "o_orderdate"], "o_orderstatus", ["o_orderpriority", "o_orderkey"])


@query(f"""SELECT l_orderkey, {", ".join(f"CASE WHEN count(*) FILTER (l_linenumber = {n}) = 1 THEN max(CASE WHEN l_linenumber = {n} THEN l_extendedprice END) END AS l{n}" for n in (1, 2, 3))} FROM lineitem GROUP BY 1""")
def pivot_states(spark, base):
    l = table(spark, base, "lineitem").withColumn("k", F.concat(F.lit("l"), "l_linenumber"))
    return D.pivot_long(l, ["l_orderkey"], "k", ["l1", "l2", "l3"], "l_extendedprice")


@query(f"""SELECT l_orderkey, {", ".join(f"CASE WHEN count(*) FILTER (l_linenumber = {n}) = 1 THEN max(CASE WHEN l_linenumber = {n} THEN {f} END) END AS {f}_{n}" for f in ("l_quantity", "l_tax") for n in (1, 2))} FROM lineitem GROUP BY 1""")
def states_round_trip(spark, base):
    """Rows to state documents with arrays, and the documents back to columns."""
    docs = D.states_documents(table(spark, base, "lineitem"), ["l_orderkey"], "l_linenumber", ["l_quantity", "l_tax"])
    return D.reshape_states(docs, ["l_orderkey"], "l_linenumber", ["l_quantity", "l_tax"], [1, 2])


@query(f"""WITH k AS (SELECT datetime, recv, sat, meas || '-' || sig AS c, max(prefit) AS p, max(postfit) AS q FROM {RESIDUALS} WHERE isfinite(prefit) GROUP BY ALL), e AS (SELECT datetime, recv, sat, c || '-prefit' AS k, p AS v FROM k UNION ALL SELECT datetime, recv, sat, c || '-postfit', q FROM k)
SELECT epoch_us(datetime) AS us, recv, sat, string_agg(k, ',' ORDER BY k) AS names, {q6("sum(v)")} AS total FROM e GROUP BY 1, 2, 3""")
def measurement_documents(spark, base):
    d = D.measurement_documents(residuals(spark, base).where("prefit IS NOT NULL AND NOT isnan(prefit) AND abs(prefit) < double('inf')"), ["datetime", "recv", "sat"], "meas", "sig", ["prefit", "postfit"])
    total = F.aggregate(F.map_values("document"), F.lit(0.0), lambda a, v: a + v)
    return d.select(micros("datetime").alias("us"), "recv", "sat", F.array_join(F.map_keys("document"), ",").alias("names"), r6(total).alias("total"))


@query("""SELECT c_custkey, CASE WHEN abs(c_acctbal - n) <= 500 THEN n END AS mu, CASE WHEN abs(c_acctbal - n) <= 500 THEN 60.0 ELSE -1.0 END AS tau FROM customer LEFT JOIN (SELECT o_custkey AS k, max(o_totalprice) / 100 AS n FROM orders GROUP BY 1) ON k = c_custkey""")
def clock_alignment(spark, base):
    c = table(spark, base, "customer").select("c_custkey", F.col("c_acctbal").alias("clk"))
    b = table(spark, base, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.max("o_totalprice") / 100).alias("clk"))
    return D.align_clocks(c, b, "c_custkey", "clk", 500.0, 60.0).select("c_custkey", "mu", "tau")


@query("""SELECT event_id, '{"id":{"user_id":' || user_id || ',"event_type":"' || event_type || '"},"val":{"event_id":' || event_id || '}}' AS doc FROM events""")
def trace_json(spark, base):
    return table(spark, base, "events").select("event_id", D.to_document(["user_id", "event_type"], ["event_id"]).alias("doc"))


@query("""WITH o AS (SELECT l_partkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) = 1) SELECT l_orderkey, array_to_string(list_sort(list(l_partkey)), ',') AS states FROM o GROUP BY 1 HAVING count(*) >= 2""")
def merge_correlated(spark, base):
    return D.unshared_states(table(spark, base, "lineitem"), "l_orderkey", "l_partkey").select("l_orderkey", F.array_join(F.transform("states", lambda x: x.cast("string")), ",").alias("states"))


@query("""SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events UNION SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) FROM orders""")
def union_epochs(spark, base):
    return table(spark, base, "events").select(F.to_date("ts").cast("string").alias("day")).union(table(spark, base, "orders").select(F.to_date("o_orderdate").cast("string"))).distinct()


@query("""SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'""")
def intersect_epochs(spark, base):
    p, c = _kinds(spark, base, "purchase", "click")
    return c.select("user_id").intersect(p.select("user_id"))


@query("""SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders""")
def key_difference(spark, base):
    return table(spark, base, "customer").select("c_custkey").exceptAll(table(spark, base, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct())


# --- time


@query("""SELECT pos_id, CAST(floor((epoch_us("Time") / 1000000 - 315964800) / 604800) AS INTEGER) AS week, round(((epoch_us("Time") - 315964800000000) % 604800000000) / 1e6 + 1e-9, 6) AS tow, round(epoch_us("Time") / 86400000000.0 + 40587 + 1e-9, 6) AS mjd,
CAST(dayofyear("Time") AS INTEGER) AS doy, round((epoch_us("Time") % 86400000000) / 1e6 + 1e-9, 6) AS sod FROM pos_solution""")
def time_scales(spark, base):
    us = micros("Time")
    return table(spark, base, "pos_solution").select(
        "pos_id", T.gps_week(us).alias("week"), r6(T.gps_tow(us)).alias("tow"), r6(T.mjd(us)).alias("mjd"), F.dayofyear("Time").alias("doy"), r6(T.second_of_day(us)).alias("sod")
    )


@query("""SELECT rec_id, epoch_us(logged_at) + 1000000 * (SELECT max(gpst_minus_utc) FROM leap_second l WHERE l.utc_from <= e.logged_at) AS gpst_us FROM epoch_stamp e""")
def utc_to_gpst(spark, base):
    leaps = T.leap_rows(table(spark, base, "leap_second"))
    return table(spark, base, "epoch_stamp").select("rec_id", T.utc_to_gpst(micros("logged_at"), leaps).alias("gpst_us"))


@query("""SELECT pea_id, (315964800 + gpswk::BIGINT * 604800) * 1000000 + CAST(round(seconds * 1e6) AS BIGINT) AS us FROM trop_pea""")
def week_tow_time(spark, base):
    return table(spark, base, "trop_pea").select("pea_id", T.week_tow_us(F.col("gpswk"), F.col("seconds")).alias("us"))


@query("""SELECT CAST(floor(epoch_us(ts) / 1800000000.0) AS BIGINT) * 1800000000 AS slot, count(*) AS n FROM events GROUP BY 1""")
def floor_period(spark, base):
    return table(spark, base, "events").groupBy((F.floor(micros("ts") / 1_800_000_000) * 1_800_000_000).alias("slot")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_id, ts, floor((epoch_us(ts) + 900000000) / 1800000000.0)::BIGINT * 1800000000 AS ep FROM events)
SELECT event_id, ep AS epoch_us, abs(epoch_us(ts) - ep) <= 300000000 AS within, CASE WHEN abs(epoch_us(ts) - ep) <= 300000000 THEN 'CURRENT' WHEN epoch_us(ts) < ep THEN 'PAST' ELSE 'FUTURE' END AS class FROM e""")
def epoch_sync(spark, base):
    return classify(table(spark, base, "events"), "ts", 1800, 300).select("event_id", "epoch_us", "within", "class")


@query("""WITH e AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT event_id, coalesce(floor(epoch_us(ts) / 3600000000.0) > floor(epoch_us(p) / 3600000000.0), false) AS reset, min(CASE WHEN ts > p THEN (epoch_us(ts) - epoch_us(p)) / 1e6 END) OVER (PARTITION BY user_id) AS interval_s FROM e""")
def periodic_resets(spark, base):
    e = periodic_reset(table(spark, base, "events"), ["user_id"], "ts", ["ts", "event_id"], 3600)
    return e.join(infer_interval(table(spark, base, "events"), ["user_id"], "ts"), "user_id", "left").select("event_id", "reset", "interval_s")
