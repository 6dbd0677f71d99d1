import socket
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orrery.streaming.epochs import classify, epoch_stream, specific_reset, tolerance
from orrery.streaming.ntrip import NtripSource, next_delay
from orrery.streaming.state import each_batch, expiry_counter, stateful_filter

T0 = datetime(2019, 1, 6)
SCHEMA = "k string, t timestamp, v double, r double"


@pytest.fixture
def source(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    write([])
    return write, spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    return q


def test_filter_over_batches_is_the_filter_over_all(spark, source):
    write, stream = source
    rows = [("a", T0 + timedelta(seconds=i), float(i % 3), 1.0) for i in range(12)]
    q = drain(stateful_filter(stream, "k", "t", "v", "r", 0.5, outage_s=100.0), "filter_out")
    for part in (rows[:4], rows[4:9], [rows[2]], rows[9:]):
        write(part)
        q.processAllAvailable()
    q.stop()
    x, p, want = 0.0, 1e6, []
    for i, r in enumerate(rows):
        p += 0.5 if i else 0
        g = p / (p + 1)
        x, p = x + g * (r[2] - x), (1 - g) * p
        want.append(x)
    got = [r.x for r in spark.table("filter_out").orderBy("t").collect()]
    assert got == pytest.approx(want)


def test_expiry_counts(spark, source):
    write, stream = source
    q = drain(expiry_counter(stream.withColumn("bad", F.col("v") > 0), "k", "t", "bad", 3), "expiry_out")
    write([("a", T0 + timedelta(seconds=i), v, 1.0) for i, v in enumerate((1.0, 1.0))])
    q.processAllAvailable()
    write([("a", T0 + timedelta(seconds=9 + i), v, 1.0) for i, v in enumerate((1.0, 1.0, 0.0, 1.0))])
    q.processAllAvailable()
    q.stop()
    assert [(r["count"], r.expired) for r in spark.table("expiry_out").orderBy("t").collect()] == [(1, False), (2, False), (3, True), (1, False), (0, False), (1, False)]


def test_watermarked_epochs_leave_late_rows_out(spark, source):
    write, stream = source
    q = drain(epoch_stream(stream, "t", 60, 10, 30, ["k"], "v"), "epoch_out")
    write([("a", T0 + timedelta(seconds=s), 1.0, 1.0) for s in (-5, 0, 5, 25, 58)])
    q.processAllAvailable()
    write([("a", T0 + timedelta(seconds=600), 1.0, 1.0)])
    q.processAllAvailable()
    write([("a", T0 + timedelta(seconds=3), 9.0, 1.0), ("a", T0 + timedelta(seconds=1200), 1.0, 1.0)])
    q.processAllAvailable()
    q.stop()
    got = {r.epoch: (r.n, r["mean"]) for r in spark.table("epoch_out").collect()}
    assert got[T0] == (3, 1.0) and got[T0 + timedelta(seconds=60)] == (1, 1.0)


def test_hook_and_rules(spark, source, tmp_path):
    write, stream = source
    seen = []
    write([("a", T0, 1.0, 1.0)])
    each_batch(stream, lambda df, i: seen.append(df.count()), str(tmp_path / "check")).awaitTermination()
    assert sum(seen) == 1
    assert tolerance(30, 20) == 15 and tolerance(30, 10) == 10 and next_delay(40) == 64 and next_delay(1) == 2
    df = spark.createDataFrame([("a", T0 + timedelta(hours=h), 0.0, 0.0) for h in (22, 25, 26)], SCHEMA)
    assert [r.reset for r in specific_reset(df, ["k"], "t", ["t"], 0).orderBy("t").collect()] == [False, True, False]
    c = classify(spark.createDataFrame([("a", T0 + timedelta(seconds=s), 0.0, 0.0) for s in (1, 29, 31, 45)], SCHEMA), "t", 60, 20).orderBy("t").collect()
    assert [r["class"] for r in c] == ["CURRENT", "FUTURE", "PAST", "CURRENT"]


def test_caster(spark):
    server = socket.create_server(("127.0.0.1", 0))
    port = server.getsockname()[1]

    def serve():
        for _ in range(6):
            try:
                c, _ = server.accept()
                c.sendall(b"ICY 200 OK\r\n\r\n" + b"\xd3" * 1000)
                c.close()
            except OSError:
                return

    threading.Thread(target=serve, daemon=True).start()
    spark.dataSource.register(NtripSource)
    df = spark.readStream.format("ntrip").option("host", "127.0.0.1").option("port", port).option("mount", "TEST").option("wait", "0.2").load()
    q = df.writeStream.format("memory").queryName("caster_out").start()
    q.awaitTermination(8)
    q.stop()
    server.close()
    got = spark.table("caster_out").collect()
    assert got and b"ICY 200 OK" in bytes(got[0].data) and got[0].stream == "TEST"
