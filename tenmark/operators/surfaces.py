"""The edges of a deployment as columns: introspection, body modes, header directives, log frames, pinned searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenmark.functions import scalars as S
from tenmark.operators import cursors, observe, rewrite, routing

#: Paths that are served before authentication and never forwarded.
INTERNAL = ("/metrics", "/admin/directives")


def is_internal(path: Column) -> Column:
    return path.startswith("/debug/") | path.isin(*INTERNAL)


def introspection(method: Column, path: Column, debug: Column, admin: Column, cleartext_refused: Column, token: Column, known: Column, decode_error: Column) -> Column:
    """``(status, error)`` of an introspection request, null for any other.

    ``debug`` and ``admin`` tell whether those surfaces are on, ``cleartext_refused`` that a mutation needs transport
    security which this request lacks, ``token`` that its token is right, ``known`` that the explained request is,
    ``decode_error`` what is wrong with a published set.
    """
    out = lambda status, error=None: F.struct(F.lit(status).alias("status"), (F.lit(error) if not isinstance(error, Column) else error).cast("string").alias("error"))
    explain = F.when(known, out(200)).otherwise(out(404, "unknown_request_id"))
    debugging = F.when(~debug, out(404, "not_enabled")).when(path.startswith("/debug/explain/"), explain).when(path == "/debug/breakglass", out(200))
    read = F.when(~admin, out(404, "not_enabled")).when(~token, out(401, "unauthorized")).otherwise(out(200))
    publish = (
        F.when(~admin, out(404, "not_enabled")).when(method != "POST", out(405, "method_not_allowed")).when(cleartext_refused, out(403, "tls_required"))
        .when(~token, out(401, "unauthorized")).when(decode_error.isNotNull(), out(400, decode_error)).otherwise(out(200))
    )
    return F.when(path.startswith("/debug/"), debugging).when(path == "/metrics", out(200)).when(path == "/admin/directives", F.when(method == "GET", read).otherwise(publish))


def is_sync_write(headers: Column, baseline: str = "sync") -> Column:
    return S.write_mode(S.header(headers, "x-write-mode"), baseline) == "sync"


def body_mode(endpoint: Column, path: Column, logical_index: Column, query: Column, sync: Column, capturing: Column, passthrough: tuple[str, ...] | None) -> Column:
    """How a request's bodies move: ``forward`` and the two streams are whole only where nothing captures them."""
    forward = F.lit(False) if passthrough is None else routing.matches_prefix(logical_index, passthrough) & ~is_internal(path)
    mode = F.when(capturing, "buffered").when(forward, "forward").when((endpoint == "Search") & ~cursors.opens_scroll(query), "search_stream").when((endpoint == "IngestBulk") & sync, "bulk_stream")
    return F.coalesce(mode, F.lit("buffered"))


def header_directive(payload: Column, now: Column) -> Column:
    """The directive of a verified header's JSON, null if its level, expiry or rate is not valid; an expired one is none."""
    at = lambda k: F.get_json_object(payload, f"$.{k}")
    level, expires, rate = at("level"), S.json_scalar(payload, "exp"), S.json_scalar(payload, "sample_per_mille")
    whole = lambda c: F.when(c.rlike("^[0-9]{1,18}$"), c.cast("long"))
    per_mille = F.when(S.has_key(payload, "sample_per_mille"), whole(rate)).otherwise(F.lit(1000))
    good = level.isin(*observe.LEVELS) & (whole(expires) > now) & per_mille.between(0, 1000)
    flags = (F.coalesce(at(k) == "true", F.lit(False)).alias(k) for k in ("ring_buffer", "capture"))
    return F.when(good, F.struct(level.alias("level"), *(at(k).alias(k) for k in ("tenant", "index", "principal")), per_mille.cast("int").alias("sample_per_mille"), whole(expires).cast("double").alias("expires_at"), *flags))


def combined_diagnostics(requests: DataFrame, store: DataFrame, directive: Column, now: Column, baseline: str = "Off", capture: bool = False) -> DataFrame:
    """Per request the highest of the baseline's, the store's and its own header's level, and what is wanted of it.

    ``directive`` is ``header_directive`` of the request; it counts where its fields fit the request and it is sampled.
    """
    held = requests.withColumn("_own", directive)
    fits = F.col("_own").isNotNull() & observe.sampled(F.col("request_id"), F.col("_own.sample_per_mille"))
    for f in ("tenant", "index", "principal"):
        fits = fits & (F.col(f"_own.{f}").isNull() | (F.col(f"_own.{f}") == F.col(f)))
    held = held.select("request_id", F.coalesce(fits, F.lit(False)).alias("_fits"), "_own")
    both = observe.diagnostics(requests, store, now).join(held, "request_id")
    mine = F.when(F.col("_fits"), observe.level_rank(F.col("_own.level"))).otherwise(0)
    rank = F.greatest(observe.level_rank(F.col("level")), mine, F.lit(observe.LEVELS.index(baseline)))
    wants = lambda k: F.col(k) | (F.col("_fits") & F.coalesce(F.col(f"_own.{k}"), F.lit(False)))
    return both.select("request_id", F.element_at(F.array(*map(F.lit, observe.LEVELS)), rank + 1).alias("level"), wants("ring_buffer").alias("ring_buffer"), (wants("capture") | F.lit(capture)).alias("capture"))


def _little_endian(n: Column, width: int) -> Column:
    h = F.lpad(F.hex(n), 2 * width, "0")
    return F.unhex(F.concat(*(F.substring(h, 2 * k + 1, 2) for k in reversed(range(width)))))


def _number(data: Column, at: Column, width: int) -> Column:
    h = F.hex(F.substring(data, at, F.lit(width)))
    return F.conv(F.concat(*(F.substring(h, 2 * k + 1, 2) for k in reversed(range(width)))), 16, 10).cast("long")


def frame(topic: Column, key: Column, payload: Column) -> Column:
    """A log frame: length and CRC-32 of a body that holds topic, key and payload, lengths little-endian."""
    name, key, payload = topic.cast("binary"), key.cast("binary"), payload.cast("binary")
    body = F.concat(_little_endian(F.octet_length(name), 2), name, _little_endian(F.octet_length(key), 4), key, payload)
    return F.concat(_little_endian(F.octet_length(body), 4), _little_endian(F.crc32(body), 4), body)


def unframed(data: Column) -> Column:
    """``(topic, key, payload)`` of a frame; null if it is cut off or its checksum does not hold."""
    body = F.substring(data, F.lit(9), F.octet_length(data))
    whole = (F.octet_length(data) >= 14) & (_number(data, F.lit(1), 4) == F.octet_length(body)) & (_number(data, F.lit(5), 4) == F.crc32(body))
    topic_size = _number(body, F.lit(1), 2).cast("int")
    key_size = _number(body, topic_size + 3, 4).cast("int")
    part = lambda at, n: F.substring(body, at, n)
    fits = (topic_size + 6 <= F.octet_length(body)) & (topic_size + key_size + 6 <= F.octet_length(body))
    return F.when(whole & fits, F.struct(F.decode(part(F.lit(3), topic_size), "utf-8").alias("topic"), part(topic_size + 7, key_size).alias("key"), part(topic_size + key_size + 7, F.octet_length(body)).alias("payload")))


def readable(frames: DataFrame, segment: str = "segment", seq: str = "seq", data: str = "frame") -> DataFrame:
    """The records of each segment up to its first damaged frame; what follows a torn tail is dropped with it."""
    read = frames.withColumn("record", unframed(F.col(data)))
    torn = read.groupBy(segment).agg(F.min(F.when(F.col("record").isNull(), F.col(seq))).alias("_torn"))
    return read.join(torn, segment).filter(F.col("_torn").isNull() | (F.col(seq) < F.col("_torn"))).drop("_torn")


def pit_of(body: Column) -> Column:
    """The wrapped point in time that a search names."""
    return F.get_json_object(body, "$.pit.id")


def with_pit(body: Column, ident: Column) -> Column:
    """The search with another point-in-time id; the rest of the pit object stays."""
    pit = F.get_json_object(body, "$.pit")
    rest = lambda c: F.regexp_replace(c, r"(?s)^\{(.*)\}$", "$1")
    own = F.concat_ws(",", F.concat(F.lit('"id":'), S.json_string(ident)), F.nullif(rest(rewrite.strip(pit, ["id"])), F.lit("")))
    whole = F.concat_ws(",", F.concat(F.lit('"pit":{'), own, F.lit("}")), F.nullif(rest(rewrite.strip(body, ["pit"])), F.lit("")))
    return F.when(pit.isNull(), body).otherwise(F.concat(F.lit("{"), whole, F.lit("}")))


def shaped_hits(hits: DataFrame, template: str, names: list[str], logical_index: str, partition: Column) -> DataFrame:
    """``position, hit`` of a search answer from physical hits ``position, _id, _source``, as JSON the client knows."""
    out = rewrite.for_read(hits, template, names, F.lit(logical_index), partition)
    hit = F.concat(F.lit('{"_index":'), S.json_string(F.col("_index")), F.lit(',"_id":'), S.json_string(F.col("_id")), F.lit(',"_source":'), F.col("_source"), F.lit("}"))
    return out.select("position", hit.alias("hit"))


def document_call(index: Column, ident: Column) -> Column:
    """``(method, path)`` of a document sent by a typed call; an empty id lets the store choose."""
    none = F.coalesce(ident, F.lit("")) == ""
    path = F.concat(F.lit("/"), index, F.lit("/_doc"), F.when(none, F.lit("")).otherwise(F.concat(F.lit("/"), ident)))
    return F.struct(F.when(none, "POST").otherwise("PUT").alias("method"), path.alias("path"))


def error_context(error: Column, retryable: Column, partition: Column) -> Column:
    """What is kept of a failed request: its code, and the partition where the failure came after it was known."""
    return F.when(error.isNotNull(), F.struct(error.alias("code"), retryable.alias("retryable"), F.when(error == "placement_missing", partition).alias("partition")))


def certificate_fingerprint(der: Column) -> Column:
    return F.sha2(der, 256)


def log_line(request_id: Column, level: Column, status: Column) -> Column:
    """The JSON line of a request's log: nothing of what it carried."""
    return F.to_json(F.struct(request_id.alias("request_id"), level.alias("level"), status.alias("status"), status.between(200, 299).alias("ok")))


def brief(findings: DataFrame, title: str) -> DataFrame:
    """A verdict as Markdown: one row. Findings are the few lines of one run, ``name, measured, bound, passed``."""
    line = F.format_string("| %s | %.2f | %.2f | %s |", "name", F.col("measured").cast("double"), F.col("bound").cast("double"), F.when(F.col("passed"), "pass").otherwise("fail"))
    head = f"# {title}\n\n| Check | Measured | Bound | Result |\n|---|---|---|---|\n"
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", line.alias("line")))), lambda x: x["line"]), "\n")
    return findings.agg(F.concat(F.lit(head), lines, F.lit("\n\nVerdict: "), F.when(F.bool_and("passed"), "pass").otherwise("fail"), F.lit("\n")).alias("brief"))
