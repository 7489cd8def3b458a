"""From a request or a bulk item to what is written and what is answered, as one plan.

Every step is a column over the step before: who asks, which branch serves it, whose partition it is, where that
lives, what is written there, whether the gate admits it, and the line that answers. An item that fails keeps its
first error and goes on as a row. The only shuffles are the placement join and, for a whole answer, one group by
request.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenmark.functions import scalars as S
from tenmark.operators import bulk, rewrite, routing

#: The branch that serves each endpoint; others are refused.
BRANCHES = {
    "IngestDoc": "ingest_doc", "IngestBulk": "ingest_bulk", "GetById": "get_by_id", "MultiGet": "multi_get", "DeleteById": "delete_by_id",
    "DeleteByQuery": "delete_by_query", "Search": "search", "MultiSearch": "multi_search", "Count": "count", "Cursor": "cursor", "Admin": "admin",
}


def authenticated(requests: DataFrame, tokens: DataFrame | None, bearer: Column, certificate: Column | None = None) -> DataFrame:
    """Adds ``principal`` and ``auth_error``; ``tokens (token, principal)`` is a table, None means development mode.

    In development mode everyone is let in, named after a verified certificate, else the token, else anonymous.
    """
    if tokens is None:
        who = F.coalesce(*([certificate] if certificate is not None else []), bearer, F.lit("anonymous"))
        return requests.withColumn("principal", who).withColumn("auth_error", F.lit(None).cast("string"))
    known = tokens.select(F.col("token").alias("_token"), F.col("principal").alias("principal"))
    found = requests.withColumn("_bearer", bearer).join(known, F.col("_bearer") == F.col("_token"), "left")
    error = F.when(F.col("_bearer").isNull(), "missing_credentials").when(F.col("principal").isNull(), "invalid_credentials")
    return found.withColumn("auth_error", error).drop("_bearer", "_token")


def authorized(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Adds ``granted``: whether ``grants (principal, endpoint)`` has the pair; a null endpoint grants all."""
    every = grants.filter("endpoint IS NULL").select(F.col("principal").alias("_any")).distinct()
    some = grants.filter("endpoint IS NOT NULL").select(F.col("principal").alias("_p"), F.col("endpoint").alias("_e")).distinct()
    both = requests.join(every, F.col("principal") == F.col("_any"), "left").join(some, (F.col("principal") == F.col("_p")) & (F.col("endpoint") == F.col("_e")), "left")
    return both.withColumn("granted", F.col("_any").isNotNull() | F.col("_p").isNotNull()).drop("_any", "_p", "_e")


def branch(endpoint: Column, logical_index: Column, passthrough: tuple[str, ...] | None = None) -> Column:
    """What serves a request: ``passthrough`` before anything else if its index matches, the endpoint's own branch, or null."""
    own = reduce(lambda c, kv: c.when(endpoint == kv[0], kv[1]), list(BRANCHES.items())[1:], F.when(endpoint == "IngestDoc", BRANCHES["IngestDoc"]))
    return own if passthrough is None else F.when(routing.matches_prefix(logical_index, passthrough), "passthrough").otherwise(own)


def tried(sources: dict[str, Column]) -> Column:
    """``(partition, kinds)``: the first source that is there, and the kinds looked at until then, in order."""
    names, values = list(sources), list(sources.values())
    found = F.array_position(F.array(*(v.isNotNull() for v in values)), F.lit(True)).cast("int")
    looked = F.when(found > 0, found).otherwise(len(names))
    return F.struct(F.coalesce(*values).alias("partition"), F.slice(F.array(*map(F.lit, names)), F.lit(1), looked).alias("kinds"))


def context_fields(fields: dict[str, tuple[str, str]], attributes: Column, headers: Column) -> tuple[dict[str, Column], Column]:
    """Injected values by name as JSON, and the error of the first that is missing.

    A field is ``("constant", json)``, ``("principal", attribute)`` or ``("header", name)``; ``attributes`` is a map.
    """
    values, errors = {}, []
    for name, (kind, arg) in fields.items():
        if kind == "constant":
            values[name] = F.lit(arg)
            continue
        own = F.try_element_at(attributes, F.lit(arg)) if kind == "principal" else S.header(headers, arg)
        values[name] = S.json_string(own)
        errors.append(F.when(own.isNull(), "principal_attr_missing" if kind == "principal" else "header_missing"))
    return values, F.coalesce(*errors, F.lit(None).cast("string"))


def item_ids(template: str, shared: Column, action: Column, partition: Column, ident: Column, made: Column) -> tuple[Column, Column]:
    """The physical and the logical id of an item.

    In a shared index a client's id is framed, and without one the id ``made`` from the document counts and is answered
    by the part that identifies it there. Elsewhere the client's id is the id; without one the store chooses.
    """
    framed = S.to_physical(template, partition, ident)
    physical = F.when(~shared, ident).when(ident.isNotNull(), framed).when(action.isin("index", "create"), made)
    logical = F.when(ident.isNotNull(), ident).when(shared & action.isin("index", "create"), F.coalesce(S.to_logical(template, partition, made), made)).when(action.isin("index", "create"), F.lit(""))
    return physical, logical


def prepared(items: DataFrame, placements: DataFrame, default_index: str, template: str, tenant_field: str = "_tenant", set_routing: bool = True) -> DataFrame:
    """Write operations of items ``request_id, ordinal, action, index, id, source, partition, stamped_epoch``.

    Adds ``logical_index, cluster, target_index, physical_id, logical_id, routing, body, error``. The first error of
    partition, placement, id, document, collision, made id and epoch gate is the item's; it has no body then.
    """
    action, source, partition = F.col("action"), F.col("source"), F.col("partition")
    # what follows from an item alone is named after the join, so that it is not shuffled
    rows = routing.located(items, placements).withColumn("logical_index", F.coalesce("index", F.lit(default_index))).drop("index")
    rows = routing.targeted(rows.withColumn("error", F.when(partition.isNull(), "partition_unresolved")))
    shared = F.coalesce(F.col("kind") == "SharedIndex", F.lit(False))
    writes_doc = action.isin("index", "create")
    # each document is read once for its id and once for its keys, and only where they count
    rows = rows.withColumn("_made", F.when(shared & writes_doc & F.col("id").isNull(), S.construct_id(template, partition, source)))
    rows = rows.withColumn("_keys", F.when((shared & writes_doc) | (action == "update"), F.json_object_keys(source)))
    physical, logical = item_ids(template, shared, action, partition, F.col("id"), F.col("_made"))
    rows = rows.withColumn("physical_id", physical).withColumn("logical_id", F.coalesce(logical, F.col("id")))
    fields = {tenant_field: S.json_string(partition)}
    body = F.when(~shared, source).when(writes_doc, rewrite.inject(source, fields)).when(action == "update", rewrite.inject_update(source, fields))
    refused = F.when(shared & writes_doc, rewrite.keys_error(F.col("_keys"), list(fields))).when(action == "update", F.when(F.col("_keys").isNull(), "invalid_json"))
    made = F.when(shared & writes_doc & F.col("physical_id").isNull(), "id_construction")
    gate = F.when(~routing.admitted(F.col("phase"), F.col("epoch"), F.col("stamped_epoch")), "stale_epoch")
    error = F.coalesce("error", bulk.item_error(action, F.col("id"), source), refused, made, gate)
    good = F.col("error").isNull()
    rows = rows.withColumn("error", error).withColumn("body", F.when(good & (action != "delete"), body))
    routed = F.when(good & shared & F.lit(set_routing) & F.col("physical_id").isNotNull(), partition)
    return rows.withColumn("routing", routed).drop("_made", "_keys")


def bulk_line(action: Column, index: Column, ident: Column, status: Column, result: Column, op_id: Column, error: Column) -> Column:
    """The line that answers an item, as JSON: a result, a queued operation with its id, or an error's type."""
    def line(index: Column, ident: Column, result: Column, op_id: Column, error: Column, literal: Callable[[Column], Column]) -> Column:
        text = lambda c: F.coalesce(literal(c), F.lit("null"))
        head = F.concat(F.lit('{"'), action, F.lit('":{"_index":'), text(index), F.lit(',"_id":'), text(ident))
        queued = F.when(error.isNull() & op_id.isNotNull(), F.concat(F.lit(',"op_id":'), text(op_id))).otherwise("")
        outcome = F.when(error.isNotNull(), F.concat(F.lit(',"error":{"type":'), text(error), F.lit("}"))).otherwise(F.concat(F.lit(',"result":'), F.when(op_id.isNotNull(), F.lit('"queued"')).otherwise(text(result))))
        return F.concat(head, queued, F.lit(',"status":'), status.cast("string"), outcome, F.lit("}}"))

    # One look at all texts tells whether any needs an escape. The other form is a lambda's, which adds next to nothing
    # to the generated method: beyond 8,000 bytes of it the JVM would not compile it.
    parts = {"index": index, "ident": ident, "result": result, "op_id": op_id, "error": error}
    slow = S.let(F.struct(*(c.alias(k) for k, c in parts.items())), lambda p: line(*(p[k] for k in parts), S.json_string))
    return F.when(S.plain_text(F.concat_ws("", *parts.values())), line(*parts.values(), S.quoted)).otherwise(slow)


def bulk_response(lines: DataFrame) -> DataFrame:
    """One answer per request from ``request_id, ordinal, line, is_error``: lines by ordinal, ``errors`` if any failed."""
    whole = bulk.interleaved(lines)
    body = F.concat(F.lit('{"took":0,"errors":'), F.col("errors").cast("string"), F.lit(',"items":['), F.col("items"), F.lit("]}"))
    return whole.select("request_id", "errors", body.alias("body"))


def document_response(index: Column, ident: Column, source: Column, names: list[str]) -> Column:
    """The answer to a read: the document as the client knows it, or that there is none."""
    head = F.concat(F.lit('{"_index":'), S.json_string(index), F.lit(',"_id":'), S.json_string(ident))
    own = F.concat(F.lit(',"found":true,"_source":'), rewrite.strip(source, names))
    return F.concat(head, F.coalesce(own, F.lit(',"found":false')), F.lit("}"))


def multi_get_error(index: Column, ident: Column, error: Column) -> Column:
    """The entry of a multi-get document that could not be read."""
    return F.to_json(F.struct(index.alias("_index"), ident.alias("_id"), F.struct(error.alias("type")).alias("error")))


def delete_response(index: Column, ident: Column, status: Column) -> Column:
    result = F.when(status == 404, "not_found").otherwise("deleted")
    return F.to_json(F.struct(index.alias("_index"), ident.alias("_id"), result.alias("result")))


def logical_write_id(template: str, shared: Column, partition: Column, physical: Column) -> Column:
    """The id that a write answers: logical where the frame fits, else physical."""
    return F.when(shared, F.coalesce(S.to_logical(template, partition, physical), physical)).otherwise(physical)


def with_scroll_id(body: Column, token: Column) -> Column:
    """A search answer whose ``_scroll_id`` is replaced by a wrapped one; one without stays as it is."""
    there = F.get_json_object(body, "$._scroll_id").isNotNull()
    rest = F.regexp_replace(rewrite.strip(body, ["_scroll_id"]), r"(?s)^\{(.*)\}$", "$1")
    return F.when(there, F.concat(F.lit('{"_scroll_id":'), S.json_string(token), F.when(rest != "", F.concat(F.lit(","), rest)).otherwise(F.lit("")), F.lit("}"))).otherwise(body)


def scroll_ids(body: Column, path_id: Column) -> Column:
    """The ids that a scroll request names: in its path, or one or several in its body."""
    one = F.get_json_object(body, "$.scroll_id")
    some = F.from_json(body, "scroll_id array<string>")["scroll_id"]
    return F.coalesce(F.when(path_id.isNotNull(), F.array(path_id)), some, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))


def merged_status(calls: DataFrame, by: list[str]) -> DataFrame:
    """One answer for a close that went to several clusters: the worst status, how many succeeded and were freed."""
    return calls.groupBy(*by).agg(F.max("status").alias("status"), F.bool_and(F.col("status") < 300).alias("succeeded"), F.sum("freed").alias("num_freed"))


def auto_ids(rows: DataFrame, seed: list[str], ident: str = "physical_id") -> DataFrame:
    """Gives rows without an id one made from ``seed``, which must tell rows apart: no counter to agree on."""
    made = F.substring(F.sha2(F.concat_ws("\x1f", *(F.col(c).cast("string") for c in seed)), 256), 1, 20)
    return rows.withColumn("assigned", F.col(ident).isNull() & F.col("error").isNull()).withColumn(ident, F.when(F.col("assigned"), made).otherwise(F.col(ident)))
