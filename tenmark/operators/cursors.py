"""Cursor tokens, keyset pages, pinned snapshots and cursor affinity."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenmark.functions import scalars as S


def hmac_tag(key: bytes):
    """HMAC-SHA256 in hexadecimal over ``cluster 0x1f cursor``; SQL has no HMAC, so an Arrow UDF."""

    @F.pandas_udf("string")
    def tag(cluster: pd.Series, cursor: pd.Series) -> pd.Series:
        one = lambda c, s: None if c is None or s is None else hmac.new(key, f"{c}\x1f{s}".encode(), hashlib.sha256).hexdigest()
        return pd.Series([one(c, s) for c, s in zip(cluster, cursor, strict=True)], dtype=object)

    return tag


def wrap(cluster: Column, cursor: Column, tag: Column) -> Column:
    return F.concat_ws(".", S.hex_text(cluster), tag, cursor)


def unwrap(token: Column) -> Column:
    """``(cluster, tag, cursor)``; null where a token has no such shape."""
    parts = F.split(token, r"\.", 3)
    cluster = S.unhex_text(F.get(parts, F.lit(0)))
    whole = (F.size(parts) == 3) & cluster.isNotNull() & (cluster != "") & (F.get(parts, F.lit(2)) != "")
    return F.when(whole, F.struct(cluster.alias("cluster"), F.get(parts, F.lit(1)).alias("tag"), F.get(parts, F.lit(2)).alias("cursor")))


def verified(tokens: DataFrame, key: bytes, token: str = "token") -> DataFrame:
    """Adds ``cluster`` and ``cursor``, or the error ``cursor_unresolvable`` where the signature does not hold."""
    held = tokens.withColumn("_c", unwrap(F.col(token)))
    good = F.coalesce(F.col("_c.tag") == hmac_tag(key)(F.col("_c.cluster"), F.col("_c.cursor")), F.lit(False))
    held = held.withColumn("_good", good)
    return held.select(*tokens.columns, *(F.when(F.col("_good"), F.col(f"_c.{c}")).alias(c) for c in ("cluster", "cursor")), F.when(~F.col("_good"), "cursor_unresolvable").alias("error"))


def page(base: DataFrame, order: str, size: int, after: tuple | None = None, tie: str = "_id") -> DataFrame:
    """The next ``size`` rows after ``(order, tie)``: a keyset page, which costs no more the deeper it is."""
    rows = base
    if after:
        rows = rows.filter((F.col(order) > F.lit(after[0])) | ((F.col(order) == F.lit(after[0])) & (F.col(tie) > F.lit(after[1]))))
    return rows.orderBy(order, tie).limit(size)


def pit_close(ids: DataFrame) -> DataFrame:
    """One call per cluster with its ids in order: ``cluster, ids, n`` from ``pos, cluster, cursor``."""
    return ids.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cursor"))), lambda x: x["cursor"]).alias("ids"), F.count("*").alias("n"))


def affinity(pins: DataFrame, now: Column, ttl_s: int = 300, capacity: int = 100_000) -> DataFrame:
    """The pins alive at ``now``: the last of each cursor, not older than ``ttl_s``, the ``capacity`` youngest."""
    last = pins.groupBy("cursor").agg(F.max_by(F.struct("cluster", "pinned_at"), "pinned_at").alias("p")).select("cursor", "p.*")
    alive = last.filter(F.col("pinned_at").cast("double") > now.cast("double") - ttl_s)
    return alive.orderBy(F.desc("pinned_at"), "cursor").limit(capacity)


def opens_scroll(query: Column) -> Column:
    return F.exists(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: F.split(p, "=")[0] == "scroll")
