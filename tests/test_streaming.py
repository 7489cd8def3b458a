import datetime
import json

from pyspark.sql import functions as F

from tenmark.streaming import oplog

DAY = datetime.datetime(2024, 1, 1)


def ops(spark, ids, minute):
    rows = [(i, f"t{n % 2}", "c", "x", 1, "index", i, None, "application/json", json.dumps({"n": n}), DAY + datetime.timedelta(minutes=minute + n)) for n, i in enumerate(ids)]
    return spark.createDataFrame(rows, oplog.OP)


def test_log_is_idempotent_over_a_restart(spark, tmp_path):
    source, log, mark = (str(tmp_path / x) for x in ("in", "log", "mark"))
    ops(spark, ["a", "b", "a", "c"], 0).write.parquet(source)
    for more in (["b", "d"], ["d", "e", "a"]):
        q = oplog.append(oplog.deduplicated(oplog.read_ops(spark, source)), log, mark)
        q.awaitTermination(120)
        ops(spark, more, 5).write.mode("append").parquet(source)
    oplog.append(oplog.deduplicated(oplog.read_ops(spark, source)), log, mark).awaitTermination(120)
    kept = oplog.in_order(spark.read.parquet(log))
    assert sorted(r.op_id for r in kept.collect()) == ["a", "b", "c", "d", "e"]


def test_capture_drops_credentials(spark):
    df = spark.createDataFrame([([("Authorization", "Bearer x"), ("a", "b")],)], "headers array<struct<name:string,value:string>>")
    assert [h.name for h in oplog.captured(df).first().headers] == ["a"]


def test_windowed_metrics(spark, tmp_path):
    rows = [(DAY + datetime.timedelta(days=n % 6), n % 3 == 0) for n in range(30)] + [(DAY + datetime.timedelta(days=60), False)]
    spark.createDataFrame(rows, "ts timestamp, is_error boolean").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, is_error boolean").parquet(str(tmp_path / "e"))
    q = oplog.windowed_metrics(stream).writeStream.format("memory").queryName("windowed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = spark.table("windowed").agg(F.sum("total").alias("n"), F.sum("errors").alias("e")).first()
    assert (got.n, got.e) == (30, 10)
