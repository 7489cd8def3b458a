"""Document-store writes as a merge of ordered operations into a snapshot.

State is ``key, source``; operations are ``key, ordinal, action, source``. Index replaces, create fails where
the document is, delete fails where it is not, update merges. Keys without updates and creates need only
their last operation. The others depend on each step before and are folded per key, in order; a key's
operations of one batch are what a task holds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenmark.functions.folds import folded


def last_writes(ops: DataFrame) -> DataFrame:
    """The last operation of each key: an aggregate with partial sums, no window."""
    rest = [c for c in ops.columns if c not in ("key", "ordinal")]
    return ops.groupBy("key").agg(F.max_by(F.struct("ordinal", *rest), "ordinal").alias("o")).select("key", "o.*")


def index_results(ops: DataFrame, state: DataFrame) -> DataFrame:
    """``created`` for the first index of a key that the snapshot lacks, else ``updated``."""
    known = state.select("key").distinct().withColumn("known", F.lit(True))
    first = F.row_number().over(Window.partitionBy("key").orderBy("ordinal")) == 1
    both = ops.join(known, "key", "left").withColumn("created", first & F.col("known").isNull())
    return both.withColumn("result", F.when(F.col("created"), "created").otherwise("updated")).drop("known", "created")


def create_results(ops: DataFrame, state: DataFrame) -> DataFrame:
    """201 for the first create of a key that the snapshot lacks, 409 ``conflict`` for the others."""
    known = state.select("key").distinct().withColumn("known", F.lit(True))
    first = F.row_number().over(Window.partitionBy("key").orderBy("ordinal")) == 1
    both = ops.join(known, "key", "left").withColumn("ok", first & F.col("known").isNull())
    return both.withColumn("status", F.when(F.col("ok"), 201).otherwise(409)).withColumn("error", F.when(~F.col("ok"), "conflict")).drop("known", "ok")


def merged(old: dict | None, change: dict) -> tuple[dict | None, str]:
    """An update on a document: shallow merge, else ``upsert``, else ``doc`` if it may stand in, else nothing."""
    if old is not None:
        return {**old, **change.get("doc", {})}, "updated"
    if "upsert" in change:
        return change["upsert"], "created"
    if change.get("doc_as_upsert"):
        return change.get("doc", {}), "created"
    return None, "not_found"


def fold(source: str | None, steps: list[tuple[str, str | None]]) -> tuple[str | None, list[str]]:
    """One key's operations in order: its last source and each step's result."""
    out = []
    for action, text in steps:
        if action == "index":
            out.append("updated" if source is not None else "created")
            source = text
        elif action == "create":
            out.append("conflict" if source is not None else "created")
            source = source if source is not None else text
        elif action == "delete":
            out.append("deleted" if source is not None else "not_found")
            source = None
        elif action == "update":
            new, result = merged(None if source is None else json.loads(source), json.loads(text or "{}"))
            out.append(result)
            source = source if new is None else json.dumps(new, separators=(",", ":"), ensure_ascii=False)
        else:
            out.append("rejected")
    return source, out


def apply_ops(state: DataFrame, ops: DataFrame) -> DataFrame:
    """``key, source, ordinal, result``: a row for each operation, and with a null ordinal the key's new source.

    Keys that no operation names are not in the result; ``next_state`` adds them.
    """
    rows = ops.select("key", F.col("ordinal").cast("long"), "action", "source").unionByName(state.join(ops.select("key").distinct(), "key", "left_semi").select("key", F.lit(-1).cast("long").alias("ordinal"), F.lit("state").alias("action"), "source"))

    def run(held: Iterator[tuple]):
        key = source = None
        for key, ordinal, action, text in held:
            if action == "state":
                source = text
                continue
            source, (result,) = fold(source, [(action, text)])
            yield key, None, ordinal, result
        yield key, source, None, None

    return folded(rows, ["key"], ["ordinal"], run, "key string, source string, ordinal long, result string")


def next_state(state: DataFrame, applied: DataFrame) -> DataFrame:
    """The snapshot after a batch."""
    changed = applied.filter("ordinal IS NULL").select("key", "source")
    return state.join(changed.select("key"), "key", "left_anti").select("key", "source").unionByName(changed.filter("source IS NOT NULL"))


def delete_by_query(matches: DataFrame, batch: str, cap: int = 10_000) -> DataFrame:
    """One delete row per match, ``op_id`` = batch:ordinal; above ``cap`` matches a single ``rejected`` row and no delete.

    The count looks at ``cap + 1`` ids at most, so a refused query is cheap.
    """
    few = matches.select("_id").limit(cap + 1)
    total = few.agg(F.count("*").alias("n"))
    order = Window.orderBy("_id")
    ops = few.withColumn("ordinal", F.row_number().over(order) - 1).join(F.broadcast(total), F.lit(True))  # one row
    fine = ops.filter(F.col("n") <= cap).select(F.concat_ws(":", F.lit(batch), F.col("ordinal").cast("string")).alias("op_id"), "_id", F.lit("delete").alias("op_type"))
    over = total.filter(F.col("n") > cap).select(F.lit(batch).alias("op_id"), F.lit(None).cast("string").alias("_id"), F.lit("rejected").alias("op_type"))
    return fine.unionByName(over)
