"""Bulk bodies and requests as streams: each micro-batch takes the newest placements and directives.

A body arrives as a file. Its items go the way of a bulk request, so what is stored is what ``lifecycle.prepared``
admits; a batch that is repeated after a failure writes the same folder again and nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tenmark.functions import scalars as S
from tenmark.operators import lifecycle, observe
from tenmark.sources.ndjson import parse_bulk


def bulk_bodies(spark: SparkSession, folder: str, per_batch: int = 64) -> DataFrame:
    """``request_id, body`` of NDJSON files as they arrive; the file's name is the request."""
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", per_batch).load(folder)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("request_id"), F.col("value").alias("body"))


def ingest(bodies: DataFrame, placements: Callable[[], DataFrame], folder: str, checkpoint: str, default_index: str, template: str, partition: str = "tenant_id") -> StreamingQuery:
    """Writes the operations of arriving bodies below ``folder``, a sub-folder for each batch; the tenant is in the document.

    ``placements`` is asked once a batch, and items are stamped with the epoch that it gave.
    """

    def run(batch: DataFrame, number: int) -> None:
        current = placements()
        items = parse_bulk(batch)
        items = items.filter("error IS NULL").withColumn("partition", S.json_scalar(F.col("source"), partition)).drop("error", "routing", "cas")
        stamped = items.join(current.select("partition", F.col("epoch").alias("stamped_epoch")), "partition", "left")
        out = lifecycle.prepared(stamped, current, default_index, template)
        out.select("request_id", "ordinal", "action", "cluster", "target_index", "physical_id", "logical_id", F.col("routing"), "body", "error").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return bodies.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class DirectiveView:
    """The directive set that is in force: a file that operators replace.

    A refresh takes what is there now. A set that does not decode changes nothing; a file that is gone is an empty set.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.current = observe.decode_directives(spark, '{"directives": []}', 0.0)

    def refresh(self, now: float) -> DataFrame:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            text = '{"directives": []}'
        else:
            text = self.spark.read.text(self.path, wholetext=True).first()["value"]
        try:
            self.current = observe.decode_directives(self.spark, text, now)
        except ValueError:
            pass  # the last good set stays
        return self.current


def diagnosed(requests: DataFrame, view: DirectiveView, clock: Callable[[], float], folder: str, checkpoint: str) -> StreamingQuery:
    """The diagnostics of arriving requests, by the directives in force when their batch is planned."""

    def run(batch: DataFrame, number: int) -> None:
        now = clock()
        observe.diagnostics(batch, view.refresh(now), F.lit(now)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
