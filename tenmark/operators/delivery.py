"""What a write becomes on the wire, in the operation log, and as an answer.

Projections only: method and URI of the upstream request, the log envelope, and the answer of a queued write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenmark.functions import scalars as S


def upstream_request(action: Column, index: Column, ident: Column, routing: Column, base: str = "") -> Column:
    """``(method, uri)``; an index or create without an id is a POST that lets the store choose one."""
    verb = F.when((action == "create") & ident.isNotNull(), "_create").when(action == "update", "_update").otherwise("_doc")
    query = F.concat_ws("&", F.when((action == "create") & ident.isNull(), "op_type=create"), F.when(routing.isNotNull(), F.concat(F.lit("routing="), S.percent_encode(routing))))
    path = F.concat(F.lit(base + "/"), index, F.lit("/"), verb, F.when(ident.isNotNull(), F.concat(F.lit("/"), S.percent_encode(ident))).otherwise(F.lit("")))
    method = F.when(action == "delete", "DELETE").when((action == "update") | ident.isNull(), "POST").otherwise("PUT")
    return F.struct(method.alias("method"), F.concat(path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))).alias("uri"))


def upstream_result(body: Column, fallback: Column) -> Column:
    """``(id, created)`` of an upstream answer."""
    return F.struct(F.coalesce(F.get_json_object(body, "$._id"), fallback).alias("id"), F.coalesce(F.get_json_object(body, "$.result") == "created", F.lit(False)).alias("created"))


def envelopes(ops: DataFrame) -> DataFrame:
    """Log rows of ``op_id, partition, cluster, index, epoch, action, id, routing, source, ts``; a delete has no body."""
    has_body = F.col("action") != "delete"
    none = F.lit("")
    return ops.select(
        "op_id", "partition", "cluster", "index", "epoch", F.col("action").alias("op_type"), F.coalesce("id", none).alias("id"), F.coalesce("routing", none).alias("routing"),
        F.when(has_body, "application/json").otherwise(none).alias("content_type"), F.when(has_body, F.coalesce("source", none)).otherwise(none).alias("body"), "ts",
    )


def bulk_op_ids(items: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Adds ``op_id`` = batch:ordinal and the error of items that cannot be queued: updates and conditional writes."""
    bad = (F.col("action") == "update") | F.coalesce("cas", F.lit(False))
    return items.withColumn("op_id", F.concat_ws(":", batch, F.col("ordinal").cast("string"))).withColumn("error", F.when(bad, "unsupported_async"))


def queued_answer(unsupported: Column, enabled: Column, stored: Column) -> Column:
    """Status of a queued write: 400 before 422 before 503, else 202."""
    return F.when(unsupported, 400).when(~enabled, 422).when(~stored, 503).otherwise(202)
