"""Column functions over requests and JSON documents: paths, ids, headers, hashes, encodings, backoff.

All are built-in expressions. A path is dotted object keys, without array indexes. A JSON scalar is a string,
number or boolean; objects, arrays, null and missing paths are none.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` reads it: the optimizer inlines columns, but no lambda's variable."""
    return F.element_at(F.transform(F.array(value), then), 1)


def json_path(path: str) -> str:
    """The JSONPath of dotted keys."""
    return "$" + "".join(f"['{k}']" for k in path.split("."))


def json_scalar(body: Column, path: str) -> Column:
    """The scalar at ``path`` as text, else null. Of equal keys the first counts."""
    text = F.get_json_object(body, json_path(path))
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), json_path(path).replace("['", '["').replace("']", '"]'), "variant"))
    return F.when(F.coalesce(kind.rlike("^(OBJECT|ARRAY)"), F.lit(False)), F.lit(None)).otherwise(text)


def lone_surrogate(body: Column) -> Column:
    """Whether a JSON text escapes half a surrogate pair; its string then is no text."""
    plain = F.regexp_replace(body, r"\\\\", "")  # escaped backslashes
    paired = F.regexp_replace(plain, r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}", "")
    return paired.rlike(r"\\u[dD][89a-fA-F][0-9a-fA-F]{2}")


def json_text(body: Column, path: str) -> Column:
    """``json_scalar`` of a document whose strings are all texts, else null."""
    return F.when(~lone_surrogate(body), json_scalar(body, path))


def is_json_object(body: Column) -> Column:
    return F.json_object_keys(body).isNotNull()


def has_key(body: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(body), name), F.lit(False))


def plain_text(value: Column) -> Column:
    """Whether a text is ASCII without anything that JSON escapes."""
    return value.rlike(r"\A[ !#-\[\]-~]*+\z")


def quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), value, F.lit('"'))


def json_string(value: Column) -> Column:
    """A JSON string literal of a text, null for null."""
    return F.when(plain_text(value), quoted(value)).when(value.isNotNull(), F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", "$1"))


def is_json_number(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), F.lit(False))


def percent_encode(text: Column) -> Column:
    """Everything but ``A-Za-z0-9-_.~:`` as ``%XX``."""
    swaps = (("+", "%20"), ("*", "%2A"), ("%3A", ":"), ("%7E", "~"))
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), swaps, F.url_encode(text))


def hex_text(text: Column) -> Column:
    return F.lower(F.hex(text.cast("binary")))


def unhex_text(text: Column) -> Column:
    return F.when(text.rlike("^([0-9a-fA-F]{2})*$"), F.decode(F.unhex(text), "utf-8"))


def _fnv_halves(text: Column) -> Column:
    """64-bit FNV-1a of a text's bytes as its two 32-bit halves, so that every product fits a long."""
    pairs = F.regexp_extract_all(F.hex(text.cast("binary")), F.lit(".."), F.lit(0))
    bytes_ = F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("long"))
    low, mask = FNV_PRIME & 0xFFFF, F.lit(0xFFFFFFFF)  # the prime is 2^40 + low

    def step(h, b):
        product = h["lo"].bitwiseXOR(b) * low
        shifted = F.shiftleft(h["lo"].bitwiseXOR(b), 8)
        return F.struct((h["hi"] * low + F.shiftright(product, 32) + shifted).bitwiseAND(mask).alias("hi"), product.bitwiseAND(mask).alias("lo"))

    start = F.struct(F.lit(FNV_OFFSET >> 32).cast("long").alias("hi"), F.lit(FNV_OFFSET & 0xFFFFFFFF).cast("long").alias("lo"))
    return F.aggregate(bytes_, start, step)


def fnv1a(text: Column) -> Column:
    """64-bit FNV-1a of a text's bytes, unsigned."""
    wide = lambda c: c.cast("decimal(20,0)")
    halves = F.transform(F.array(_fnv_halves(text)), lambda h: (wide(h["hi"]) * F.lit(Decimal(1 << 32)) + wide(h["lo"])).cast("decimal(20,0)"))
    return F.element_at(halves, 1)


def fnv1a_mod(text: Column, n: int) -> Column:
    """``fnv1a(text)`` modulo a small number, in longs alone."""
    rest = F.transform(F.array(_fnv_halves(text)), lambda h: ((h["hi"] % n) * ((1 << 32) % n) + h["lo"]) % n)
    return F.element_at(rest, 1).cast("int")


def header(headers: Column, name: str) -> Column:
    """The value of the first header of that name, case-insensitive, else null."""
    found = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.get(found, F.lit(0))["value"]


#: Headers that never reach the upstream.
NEVER_FORWARDED = ("connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade", "host", "content-length", "accept-encoding")


def forward_headers(headers: Column, denied: tuple[str, ...] = ()) -> Column:
    """Headers without the hop-by-hop, framing and configured ones; order and repeats stay."""
    names = sorted({*NEVER_FORWARDED, *(d.lower() for d in denied)})
    return F.filter(headers, lambda h: ~F.lower(h["name"]).isin(names))


def without_authorization(headers: Column) -> Column:
    return F.filter(headers, lambda h: F.lower(h["name"]) != "authorization")


def bearer_token(value: Column) -> Column:
    """The token of a ``Bearer`` value, scheme case-insensitive; null without one."""
    token = F.trim(F.regexp_extract(value, r"^(?i:bearer) +(.*)$", 1))
    return F.when(token != "", token)


def add_header(headers: Column, name: str, value: Column) -> Column:
    return F.concat(headers, F.array(F.struct(F.lit(name).alias("name"), value.alias("value"))))


def remove_header(headers: Column, name: str) -> Column:
    return F.filter(headers, lambda h: F.lower(h["name"]) != name.lower())


def replace_header(headers: Column, name: str, value: Column) -> Column:
    return add_header(remove_header(headers, name), name, value)


def is_op_id(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[A-Za-z0-9_.:-]{1,128}$"), F.lit(False))


def op_id(client: Column, request_id: Column) -> Column:
    """The client's id if valid, else the request's."""
    return F.when(is_op_id(client), client).otherwise(request_id)


def write_mode(value: Column, baseline: str = "sync") -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin("sync", "async"), low).otherwise(F.lit(baseline))


def async_unsupported(path: Column, query: Column) -> Column:
    """Conditional writes and partial updates cannot be queued."""
    names = F.transform(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: F.split(p, "=")[0])
    cas = F.arrays_overlap(names, F.array(F.lit("if_seq_no"), F.lit("if_primary_term"), F.lit("version"), F.lit("version_type")))
    return cas | F.array_contains(F.split(path, "/"), "_update")


def traceparent(value: Column) -> Column:
    """``(trace_id, span_id, sampled)`` of a W3C traceparent of version 00, else null."""
    pattern = r"^00-([0-9a-fA-F]{32})-([0-9a-fA-F]{16})-([0-9a-fA-F]{2})$"
    part = lambda k: F.lower(F.regexp_extract(value, pattern, k))
    valid = value.rlike(pattern) & ~part(1).rlike("^0+$") & ~part(2).rlike("^0+$")
    odd = F.conv(F.substring(part(3), 2, 1), 16, 10).cast("int") % 2 == 1
    return F.when(valid, F.struct(part(1).alias("trace_id"), part(2).alias("span_id"), odd.alias("sampled")))


def b3(value: Column) -> Column:
    """The same of a single B3 header; 64-bit trace ids are padded, and no sampling state means sampled."""
    pattern = r"^([0-9a-fA-F]{16}|[0-9a-fA-F]{32})-([0-9a-fA-F]{16})(?:-([01d])(?:-[^-]*)?)?$"
    part = lambda k: F.lower(F.regexp_extract(value, pattern, k))
    valid = value.rlike(pattern) & ~part(1).rlike("^0+$") & ~part(2).rlike("^0+$")
    return F.when(valid, F.struct(F.lpad(part(1), 32, "0").alias("trace_id"), part(2).alias("span_id"), (part(3) != "0").alias("sampled")))


def b3_single(headers: Column) -> Column:
    """One B3 value of a request: the single header, or its multi-header form folded into it."""
    trace, span, flag = (header(headers, f"x-b3-{n}") for n in ("traceid", "spanid", "sampled"))
    debug = header(headers, "x-b3-flags") == "1"
    state = F.when(F.coalesce(debug, F.lit(False)), "d").when(flag.isin("1", "true"), "1").when(flag.isin("0", "false"), "0")
    return F.coalesce(header(headers, "b3"), F.when(trace.isNotNull() & span.isNotNull(), F.concat_ws("-", trace, span, state)))


#: Fixed value: longer ones are dropped.
TRACESTATE_MOST = 512


def trace_context(w3c: Column, b3_value: Column, request_id: Column, tracestate: Column | None = None) -> Column:
    """``(trace_id, span_id, parent_span_id, tracestate, sampled)`` of a request's own span.

    A caller's trace goes on, W3C before B3: its trace id and sampling stay, its span becomes the parent and the
    span id is the request's own. Without one the request is a sampled root. ``tracestate`` goes on unchanged
    with a W3C context only, if it is not blank and not too long.
    """
    digest, of_w3c = F.sha2(request_id, 256), traceparent(w3c)
    caller = F.coalesce(of_w3c, b3(b3_value))
    state = F.trim(F.lit(None).cast("string") if tracestate is None else tracestate)
    return F.struct(
        F.coalesce(caller["trace_id"], F.substring(digest, 1, 32)).alias("trace_id"),
        F.substring(digest, 33, 16).alias("span_id"),
        caller["span_id"].alias("parent_span_id"),
        F.when(of_w3c.isNotNull() & (state != "") & (F.octet_length(state) <= TRACESTATE_MOST), state).alias("tracestate"),
        F.coalesce(caller["sampled"], F.lit(True)).alias("sampled"),
    )


def with_trace_headers(headers: Column, context: Column, exporting: Column) -> Column:
    """While traces are exported, the headers with the request's own trace context in place of the caller's."""
    own = replace_header(remove_header(headers, "tracestate"), "traceparent", format_traceparent(context))
    whole = F.when(context["tracestate"].isNotNull(), add_header(own, "tracestate", context["tracestate"])).otherwise(own)
    return F.when(exporting, whole).otherwise(headers)


def applicable_headers(headers: Column) -> Column:
    """Headers that can be sent: names are tokens and values have no control characters."""
    return F.filter(headers, lambda h: h["name"].rlike(r"^[!#$%&'*+.^_`|~0-9A-Za-z-]+$") & ~F.coalesce(h["value"], F.lit("")).rlike(r"[\x00-\x08\x0A-\x1F\x7F]"))


def format_traceparent(context: Column) -> Column:
    return F.concat_ws("-", F.lit("00"), context["trace_id"], context["span_id"], F.when(context["sampled"], "01").otherwise("00"))


def saturating_minus(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def backoff_ms(attempt: Column, base: int = 50, most: int = 1000) -> Column:
    """``base`` doubled for each attempt, ``most`` at most."""
    return F.least(F.lit(most), (F.lit(base) * F.pow(F.lit(2), F.least(attempt, F.lit(40)))).cast("long")).cast("long")


def body_bytes(body: Column) -> Column:
    return F.coalesce(F.octet_length(body), F.lit(0))


def content_length(value: Column) -> Column:
    return F.when(value.rlike(r"^[0-9]{1,18}$"), value.cast("long"))


def crc32(text: Column) -> Column:
    return F.crc32(text.cast("binary"))


def query_parameters(query: Column, allowed: tuple[str, ...]) -> Column:
    """The parameters of a query string whose names are allowed, in order; null if none is left."""
    kept = F.filter(F.split(query, "&"), lambda p: F.split(p, "=")[0].isin(*allowed))
    return F.when(F.size(kept) > 0, F.array_join(kept, "&"))


_TEMPLATE = re.compile(r"\{([^{}]*)\}")


def template_parts(template: str) -> list[tuple[str, str]]:
    """``(kind, value)`` of an id template; kinds are text, partition and body."""
    out, at = [], 0
    for m in _TEMPLATE.finditer(template):
        if m.start() > at:
            out.append(("text", template[at : m.start()]))
        name = m[1]
        if name == "partition":
            out.append(("partition", ""))
        elif name.startswith("body.") and len(name) > 5:
            out.append(("body", name[5:]))
        else:
            raise ValueError(f"unknown placeholder {{{name}}}")
        at = m.end()
    if at < len(template):
        out.append(("text", template[at:]))
    return out


def construct_id(template: str, partition: Column, body: Column) -> Column:
    """The id that a template gives; null if a path is no scalar."""
    value = {"text": lambda v: F.lit(v), "partition": lambda v: partition, "body": lambda v: json_scalar(body, v)}
    return F.concat(*(value[k](v) for k, v in template_parts(template)))


def id_frame(template: str, partition: Column) -> tuple[Column, Column]:
    """What stands before and after the one body value of a reversible template."""
    parts = template_parts(template)
    at = [k for k, (kind, _) in enumerate(parts) if kind == "body"]
    if len(at) != 1:
        raise ValueError("a template with other than one body value cannot be inverted")
    side = lambda ps: F.concat(F.lit(""), *(F.lit(v) if kind == "text" else partition for kind, v in ps))
    return side(parts[: at[0]]), side(parts[at[0] + 1 :])


def to_physical(template: str, partition: Column, logical: Column) -> Column:
    before, after = id_frame(template, partition)
    return F.concat(before, logical, after)


def to_logical(template: str, partition: Column, physical: Column) -> Column:
    """The id inside a partition's frame; null if the frame does not fit."""
    before, after = id_frame(template, partition)
    fits = physical.startswith(before) & physical.endswith(after) & (F.length(physical) >= F.length(before) + F.length(after))
    return F.when(fits, F.substring(physical, F.length(before) + 1, F.length(physical) - F.length(before) - F.length(after)))
