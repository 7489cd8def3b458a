"""Document rewrites: inject, strip, ids on the way in and out.

A document is JSON text; fields that no rule names pass through unread. Injection splices the new fields
after the opening brace, so it costs the same for any document, and refuses a document that already has one
of the names at its top level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenmark.functions import scalars as S


def collides(body: Column, names: list[str]) -> Column:
    return F.arrays_overlap(F.json_object_keys(body), F.array(*map(F.lit, names))) if names else F.lit(False)


def inject(body: Column, fields: dict[str, Column]) -> Column:
    """The document with ``fields`` (JSON texts) first; null if it is no object or has one of the names."""
    if not fields:
        return F.when(S.is_json_object(body), body)
    pairs = F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()))
    rest = F.ltrim(F.substring(F.ltrim(body), F.lit(2), F.length(body)))
    spliced = F.concat(F.lit("{"), pairs, F.when(rest.startswith("}"), F.lit("")).otherwise(F.lit(",")), rest)
    return F.when(S.is_json_object(body) & ~collides(body, list(fields)), spliced)


def inject_error(body: Column, fields: dict[str, Column]) -> Column:
    return keys_error(F.json_object_keys(body), list(fields))


def keys_error(keys: Column, names: list[str]) -> Column:
    """``inject_error`` of a document whose keys are known; null keys are no object's."""
    taken = F.arrays_overlap(keys, F.array(*map(F.lit, names))) if names else F.lit(False)
    return F.when(keys.isNull(), "invalid_json").when(taken, "reserved_field_collision")


def inject_update(body: Column, fields: dict[str, Column]) -> Column:
    """Injects into the ``doc`` and ``upsert`` of an update, each only if there."""
    out = body
    parts = []
    for name in ("doc", "upsert"):
        sub = F.get_json_object(body, f"$.{name}")
        parts.append(F.when(S.has_key(body, name), F.concat(F.lit(f'"{name}":'), inject(sub, fields))))
    others = strip(out, ["doc", "upsert"])
    inner = F.regexp_replace(others, r"(?s)^\{(.*)\}$", "$1")
    return F.concat(F.lit("{"), F.concat_ws(",", *parts, F.when(inner != "", inner)), F.lit("}"))


def strip(body: Column, names: list[str]) -> Column:
    """The document without ``names`` at its top level; other values keep their types."""
    held = F.from_json(body, "map<string,variant>")
    return F.when(S.is_json_object(body), F.to_json(F.map_filter(held, lambda k, v: ~k.isin(names)))) if names else body


def stripped_count(body: Column, names: list[str]) -> Column:
    return F.size(F.array_intersect(F.json_object_keys(body), F.array(*map(F.lit, names))))


def for_write(docs: DataFrame, template: str | None, fields: dict[str, Column], set_routing: bool = True, body: str = "_source", partition: str = "partition") -> DataFrame:
    """Adds ``_id``, ``_routing`` and the injected ``_source``, or an ``error``.

    Without a template there is no id yet. Of several errors the first in the order body, collision, id wins.
    """
    ident = S.construct_id(template, F.col(partition), F.col(body)) if template else F.lit(None).cast("string")
    error = F.coalesce(inject_error(F.col(body), fields), F.when(F.lit(bool(template)) & ident.isNull(), "id_construction"))
    routing = F.when(F.lit(set_routing), F.col(partition))
    return docs.withColumn("_id", ident).withColumn("_routing", routing).withColumn("error", error).withColumn(body, inject(F.col(body), fields))


def for_read(hits: DataFrame, template: str | None, names: list[str], logical_index: Column, partition: Column, body: str = "_source") -> DataFrame:
    """Physical hits as the client sees them: logical index and id, no routing, no injected fields.

    An id outside the partition's frame stays as it is.
    """
    ident = F.coalesce(S.to_logical(template, partition, F.col("_id")), F.col("_id")) if template else F.col("_id")
    shaped = hits.withColumn("_index", logical_index).withColumn("_id", ident).withColumn(body, strip(F.col(body), names))
    return shaped.drop("_routing")
