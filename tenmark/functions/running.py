"""Running totals whose keys may be of any size.

A window over a key sorts all its rows in one task. Here a key's rows go in chunks of the order column: each chunk is
summed, the sums of chunks are few and run over in a window of their own, and rows are only ordered within a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 16


def with_running(rows: DataFrame, keys: list[str], order: str, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the key's rows up to and with this one, by ``order``, a whole number.

    Null keys are a key of their own. Rows of the same key should differ in ``order``.
    """
    held = rows.withColumn("_chunk", F.floor(F.col(order) / chunk)).withColumn("_value", value)
    by = [F.col(k) for k in keys]
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy(*by, "_chunk").agg(F.sum("_value").alias("_sum"))
    bases = sums.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_chunk").alias("_c"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    match = F.col("_chunk") == F.col("_c")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    within = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = held.withColumn("_own", F.sum("_value").over(within)).join(bases, match)
    return out.select(*(F.col(c) for c in rows.columns), (F.col("_base") + F.col("_own")).alias(name))
