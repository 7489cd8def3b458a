"""The operation log, capture tee and TTL views as Structured Streaming.

The log is a table partitioned by day of the event; its key is the tenant, so ``in_order`` keeps a tenant's
operations together and in sequence. Appends are idempotent by ``op_id`` within the watermark, and a restart
goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

OP = "op_id string, partition string, cluster string, index string, epoch long, op_type string, id string, routing string, content_type string, body string, ts timestamp"


def read_ops(spark: SparkSession, folder: str, per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(OP).option("maxFilesPerTrigger", per_batch).parquet(folder)


def deduplicated(ops: DataFrame, within: str = "1 hour") -> DataFrame:
    """Each ``op_id`` once; state is kept for ``within`` of event time."""
    return ops.withWatermark("ts", within).dropDuplicatesWithinWatermark(["op_id"])


def append(ops: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends to the log, all that is there, exactly once."""
    return ops.withColumn("day", F.to_date("ts")).writeStream.format("parquet").partitionBy("day").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def in_order(log: DataFrame) -> DataFrame:
    """A tenant's operations in one partition, in sequence."""
    return log.repartition("partition").sortWithinPartitions("partition", "ts", "op_id")


def captured(exchanges: DataFrame) -> DataFrame:
    """Exchanges as the capture sink keeps them: the authorization header never leaves."""
    kept = F.filter("headers", lambda h: F.lower(h["name"]) != "authorization")
    return exchanges.withColumn("headers", kept)


def tee(exchanges: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends to ``folder``, as JSON lines, the exchanges whose ``capture`` is wanted; authorization stays out of it."""
    return captured(exchanges.filter("capture")).drop("capture").writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_metrics(events: DataFrame, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Requests and errors per window of event time; rows later than ``late`` are left out."""
    w = F.window("ts", every)
    return events.withWatermark("ts", late).groupBy(w).agg(F.count("*").alias("total"), F.count_if(F.col("is_error")).alias("errors")).select(F.col("window.start").alias("start"), "total", "errors")


class _Affinity(StatefulProcessor):
    """The cluster of each cursor, forgotten after its TTL."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pin = handle.getValueState("pin", "cluster string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            for op, cluster in zip(pdf["op"], pdf["cluster"], strict=True):
                if op == "pin":
                    self.pin.update((cluster,))
                elif op == "release":
                    self.pin.clear()
                else:
                    found = self.pin.get() if self.pin.exists() else None
                    yield pd.DataFrame({"cursor": [key[0]], "cluster": [found[0] if found else None]})

    def close(self) -> None:
        pass


def cursor_affinity(events: DataFrame, ttl_ms: int = 300_000) -> DataFrame:
    """Answers ``resolve`` events of ``cursor, op, cluster`` from the pins before them."""
    return events.groupBy("cursor").transformWithStateInPandas(_Affinity(ttl_ms), "cursor string, cluster string", "Append", "ProcessingTime")
