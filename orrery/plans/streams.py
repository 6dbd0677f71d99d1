"""Streaming queries run to completion over the tables as files, their results read back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.plans.util import q6, rounded
from orrery.session import shared_dir, table
from orrery.streaming.epochs import classify
from orrery.streaming.state import stateful_filter

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _stream(spark, base, name):
    """The table as a stream: its folder, or the one file in its folder."""
    schema = table(spark, base, name).schema
    path = f"{base}/{name}.parquet"
    reader = spark.readStream.schema(schema)
    if os.path.isfile(path):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(base)
    return reader.parquet(path)


def _run(spark, df, name, mode="append"):
    out = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    q = df.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/check").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/data")


@query(f"""SELECT user_id, CAST(floor((epoch_us(ts) + 900000000) / 1800000000.0) AS BIGINT) * 1800 AS epoch_s, count(*) AS n, {q6("avg(value)")} AS mean FROM events
WHERE abs(epoch_us(ts) - CAST(floor((epoch_us(ts) + 900000000) / 1800000000.0) AS BIGINT) * 1800000000) <= 300000000 GROUP BY 1, 2""")
def stream_epoch_sync(spark, base):
    """Rows gathered into epochs by a stream; complete output, as a batch over the same rows gives it."""
    e = _stream(spark, base, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    x = classify(e, "ts", 1800, 300).where("within")
    g = x.groupBy("user_id", (F.col("epoch_us") / 1_000_000).cast("long").alias("epoch_s")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    out = f"{shared_dir(spark)}/stream-epochs-{uuid.uuid4().hex}"

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data")

    q = g.writeStream.foreachBatch(save).outputMode("complete").option("checkpointLocation", f"{out}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return rounded(spark.read.parquet(f"{out}/data"), "mean")


@query(f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS k FROM events),
f AS (SELECT user_id, k, t, 1e6 / (1e6 + 100) * value AS x, (1 - 1e6 / (1e6 + 100)) * 1e6 AS p FROM e WHERE k = 1
      UNION ALL SELECT e.user_id, e.k, e.t, f.x + (f.p + 1e-4 * (e.t - f.t)) / (f.p + 1e-4 * (e.t - f.t) + 100) * (e.value - f.x), (1 - (f.p + 1e-4 * (e.t - f.t)) / (f.p + 1e-4 * (e.t - f.t) + 100)) * (f.p + 1e-4 * (e.t - f.t))
      FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id, t AS ts, {q6("x")} AS x, {q6("p")} AS p FROM f""")
def stream_filter(spark, base):
    """A random-walk filter per user, its state carried across micro-batches."""
    e = _stream(spark, base, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("r", F.lit(100.0))
    return rounded(_run(spark, stateful_filter(e, "user_id", "ts", "value", "r", 1e-4), "filter"), "x", "p").withColumnRenamed("t", "ts")
