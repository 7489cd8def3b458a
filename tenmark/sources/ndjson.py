"""NDJSON request bodies: bulk, multi-get and multi-search.

Whether a bulk line is an action or a document depends on the lines before it, so a body is read in order; a
body is one row, and bodies are read in parallel. A malformed line fails its whole body, which then gives one
row with an ``error``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenmark.functions.scalars import let

VERBS = ("index", "create", "update", "delete")
LINE_CAP = 64 << 20
#: Keys of a conditional write.
CONDITIONAL = ("if_seq_no", "if_primary_term", "version", "version_type")
#: Action lines as most clients send them: one verb, then an index, an id and a routing, each if there, texts without
#: escapes. Such a line is an object by its form alone; any other is read by the JSON parser.
_GAP, _PLAIN_TEXT = r"[ \t\r\n]*+", r'"[^"\\\x00-\x1f]{0,512}+"'
_PLAIN = r"^G\{G\"(?:index|create|update|delete)\"G:G\{G" + "".join(rf'(?:"{k}"G:G(T)G(?:,(?=G")G|(?=\}})))?+' for k in ("_index", "_id", "routing")) + r"\}G\}G\z"
_PLAIN = _PLAIN.replace("G", _GAP).replace("T", _PLAIN_TEXT)
BULK_SCHEMA = "request_id string, ordinal int, action string, index string, id string, routing string, cas boolean, source string, error string"


def lines(body: str) -> Iterator[str]:
    """Lines without their end; blank ones are skipped and the last needs no end."""
    for line in body.split("\n"):
        line = line.removesuffix("\r")
        if line.strip():
            if len(line.encode("utf-8", "surrogatepass")) > LINE_CAP:
                raise ValueError("a line is too long")
            yield line


def _object(line: str) -> dict:
    found = json.loads(line)
    if not isinstance(found, dict):
        raise ValueError("a line is no object")
    return found


def _text(meta: Column, name: str) -> Column:
    """A text of an action's metadata; anything else is none."""
    own = F.try_variant_get(meta, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(own) == "STRING", F.try_variant_get(meta, f"$.{name}", "string"))


def _operations(lines: Column) -> Column:
    """A body's operations in order, as ``role, action, line, source, plain``; one without an action if a line is malformed; none for no lines."""
    verb = lambda x: F.regexp_extract(x, r'^\s*\{\s*"(index|create|update|delete)"\s*:', 1)
    letter = lambda v: F.when(v == "", "x").when(v == "delete", "d").otherwise("a")
    op = lambda *cs: F.struct(*(c.cast(t).alias(k) for c, (k, t) in zip(cs, (("role", "string"), ("action", "string"), ("line", "string"), ("source", "string"), ("plain", "boolean")), strict=True)))
    damaged = op(F.lit("x"), *[F.lit(None)] * 4)

    def every(ls: Column, verbs: Column, roles: Column) -> Column:
        role = lambda i: F.get(roles, i)
        return F.transform(ls, lambda x, i: op(role(i), F.get(verbs, i), x, F.when(role(i) == "a", F.get(ls, i + 1)), role(i).isin("a", "d") & x.rlike(_PLAIN)))

    def bad(o: Column) -> Column:
        # exactly one verb, objects alone, no line beyond the cap, and no action that lacks its document
        keys, role = F.json_object_keys(o["line"]), o["role"]
        good = F.when(o["plain"], True).when(role == "s", keys.isNotNull()).when(role == "x", False).otherwise(F.coalesce(F.size(keys) == 1, F.lit(False)))
        return ~good | (F.octet_length(o["line"]) > LINE_CAP) | ((role == "a") & o["source"].isNull())

    # an action that is no delete takes the line after it, from the left: one letter for each line, in one pass
    roles = lambda vs: F.split(F.regexp_replace(F.array_join(F.transform(vs, letter), ""), "a.", "as"), "")
    told = let(lines, lambda ls: let(F.transform(ls, verb), lambda vs: let(roles(vs), lambda rs: every(ls, vs, rs))))
    return let(told, lambda os: F.when(F.exists(os, bad), F.array(damaged)).otherwise(F.filter(os, lambda o: o["role"] != "s")))


def parse_bulk(bodies: DataFrame) -> DataFrame:
    """Rows of ``BULK_SCHEMA`` from ``request_id, body``; a null body is empty and gives no row.

    Which line is an action depends on the verbs before it, so a body's lines are told apart in one pass over their
    verbs; the rest is done line by line, each line once. A body is bounded by the cap that requests have.
    """
    split = F.filter(F.split(F.coalesce("body", F.lit("")), "\r?\n"), lambda x: ~x.rlike(r"^\s*$"))
    # outer, as a filter on the array's size would be worked out beside it; a body without lines gives a null here
    ops = bodies.select("request_id", F.posexplode_outer(_operations(split)).alias("at", "o")).filter("at IS NOT NULL")
    action, line = F.col("o.action"), F.col("o.line")
    good, plain = action.isNotNull(), F.col("o.plain")
    meta = F.when(~plain, F.element_at(F.from_json(line, "map<string,variant>"), action))
    ops = ops.select("request_id", F.when(good, F.col("at")).alias("ordinal"), action.alias("action"), line.alias("line"), plain.alias("plain"), meta.alias("meta"), F.col("o.source").alias("source"), F.when(~good, "invalid_json").alias("error"))

    def text(name: str, group: int) -> Column:
        quoted = F.regexp_extract("line", _PLAIN, group)
        return F.when(F.col("plain"), F.when(quoted != "", F.substring(quoted, F.lit(2), F.length(quoted) - 2))).otherwise(_text(F.col("meta"), name))

    cas = reduce(lambda a, k: a | F.try_variant_get("meta", f"$.{k}", "variant").isNotNull(), CONDITIONAL, F.lit(False))
    return ops.select("request_id", "ordinal", "action", text("_index", 1).alias("index"), text("_id", 2).alias("id"), text("routing", 3).alias("routing"), F.when(F.col("error").isNull(), cas).alias("cas"), "source", "error")


def parse_multi_get(bodies: DataFrame, default_index: str = "") -> DataFrame:
    """``request_id, pos, index, id`` from ``docs`` or ``ids``, in the order asked."""
    parsed = F.from_json("body", "docs array<struct<_index:string,_id:string,routing:string>>, ids array<string>")
    wanted = F.coalesce(F.transform(parsed["docs"], lambda d: F.struct(F.coalesce(d["_index"], F.lit(default_index)).alias("index"), d["_id"].alias("id"))), F.transform(parsed["ids"], lambda i: F.struct(F.lit(default_index).alias("index"), i.alias("id"))))
    return bodies.select("request_id", F.posexplode(wanted).alias("pos", "w")).select("request_id", "pos", "w.index", "w.id")


def parse_multi_search(body: str, default_index: str = "") -> list[tuple[str, dict]]:
    """``(index, query body)`` of each header and body pair; of an index list the first counts."""
    found = [_object(x) for x in lines(body)]
    if len(found) % 2:
        raise ValueError("a header lacks its body")
    out = []
    for head, query in zip(found[::2], found[1::2], strict=True):
        index = head.get("index") or default_index
        out.append((index[0] if isinstance(index, list) else index, query))
    return out
