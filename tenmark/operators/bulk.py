"""Bulk demultiplexing: batches by target, and results back in the order of the request."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tenmark.functions.folds import folded

MAX_OPS, MAX_BYTES = 256, 4 << 20


def count_batches(ops: DataFrame, target: list[str], most: int = MAX_OPS) -> DataFrame:
    """Adds ``batch``: every ``most`` operations of a target, by ordinal."""
    at = F.row_number().over(Window.partitionBy(*target).orderBy("ordinal"))
    return ops.withColumn("batch", F.floor((at - 1) / most).cast("int"))


def flush_batches(ops: DataFrame, target: list[str], most: int = MAX_OPS, most_bytes: int = MAX_BYTES) -> DataFrame:
    """Adds ``batch`` where a batch ends at ``most`` operations or once it holds ``most_bytes``.

    The sum starts anew with each batch, which no window can do; a target's operations are folded in order.
    Rows need ``ordinal`` and ``bytes``.
    """
    at = ops.columns.index("bytes")

    def run(held: Iterator[tuple]):
        batch, n, size = 0, 0, 0
        for row in held:
            yield *row, batch
            n, size = n + 1, size + row[at]
            if n >= most or size >= most_bytes:
                batch, n, size = batch + 1, 0, 0

    return folded(ops, target, ["ordinal"], run, StructType([*ops.schema.fields, StructField("batch", IntegerType())]))


#: Status of an item's error.
ITEM_STATUS = {
    "partition_unresolved": 400, "missing_source": 400, "reserved_field_collision": 400, "id_construction": 400, "irreversible_id": 400,
    "delete_without_id": 400, "update_without_id": 400, "invalid_json": 400, "serialize": 400, "unsupported_async": 400,
    "placement_missing": 404, "not_found": 404, "stale_epoch": 409, "conflict": 409, "upstream_failed": 502, "enqueue_failed": 503,
}


def item_status(error: Column, result: Column) -> Column:
    """One lookup: a branch for each error would make a method too long to be compiled."""
    known = F.create_map(*(F.lit(x) for pair in ITEM_STATUS.items() for x in pair))
    return F.when(error.isNull(), F.when(result == "created", 201).otherwise(200)).otherwise(F.coalesce(F.try_element_at(known, error), F.lit(500)))


def item_error(action: Column, ident: Column, source: Column) -> Column:
    """What an item lacks, before it is routed."""
    return F.when((action == "delete") & ident.isNull(), "delete_without_id").when((action == "update") & ident.isNull(), "update_without_id").when((action != "delete") & source.isNull(), "missing_source")


def interleaved(items: DataFrame, request: str = "request_id") -> DataFrame:
    """One row per request: ``items`` in ordinal order and whether any has an error. A request's items are one value."""
    line = F.struct("ordinal", "line")
    ordered = F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"])
    return items.groupBy(request).agg(F.bool_or("is_error").alias("errors"), F.array_join(ordered, ",").alias("items"))
