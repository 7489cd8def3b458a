"""Queries of the edges of a deployment."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenmark.functions import scalars as S
from tenmark.operators import observe, routing, surfaces
from tenmark.plans.catalog import query
from tenmark.plans.tables import TEMPLATE, documents, requests, table

_long = lambda c: c.cast("long")


@query("""WITH x AS (SELECT event_id, event_id % 7 AS p, event_id % 2 = 0 AS a, event_id % 3 = 0 AS b, event_id % 5 = 0 AS c, event_id % 11 = 0 AS d FROM events),
y AS (SELECT event_id, CASE p WHEN 0 THEN CASE WHEN a THEN '404 not_enabled' WHEN b THEN '200' ELSE '404 unknown_request_id' END WHEN 1 THEN CASE WHEN a THEN '404 not_enabled' ELSE '200' END WHEN 2 THEN '200'
  WHEN 3 THEN CASE WHEN b THEN '404 not_enabled' WHEN c THEN '401 unauthorized' ELSE '200' END WHEN 4 THEN CASE WHEN b THEN '404 not_enabled' ELSE '405 method_not_allowed' END
  WHEN 5 THEN CASE WHEN b THEN '404 not_enabled' WHEN a THEN '403 tls_required' WHEN c THEN '401 unauthorized' WHEN d THEN '400 zero_ttl' ELSE '200' END END AS o FROM x)
SELECT event_id, CAST(split_part(o, ' ', 1) AS INTEGER) AS status, nullif(split_part(o, ' ', 2), '') AS error FROM y""")
def introspection_routes(spark: SparkSession, d: str) -> DataFrame:
    """What the surfaces before authentication answer, and that others are none of theirs."""
    n = F.col("event_id")
    a, b, c, e = (n % k == 0 for k in (2, 3, 5, 11))
    paths = ("/debug/explain/x", "/debug/breakglass", "/metrics", "/admin/directives", "/admin/directives", "/admin/directives", "/orders/_search")
    path = F.element_at(F.array(*map(F.lit, paths)), (n % 7 + 1).cast("int"))
    method = F.when(n % 7 == 4, "PUT").when(n % 7 == 5, "POST").otherwise("GET")
    out = surfaces.introspection(method, path, ~a, ~b, a, ~c, b, F.when(e, "zero_ttl"))
    return table(spark, d, "events").select("event_id", out["status"].alias("status"), out["error"].alias("error"))


@query("""SELECT request_id, CASE WHEN seq % 5 = 0 THEN 'buffered' WHEN logical_index LIKE 'ord%' AND seq % 2 = 0 THEN 'forward' WHEN endpoint = 'Search' AND seq % 3 <> 0 THEN 'search_stream' WHEN endpoint = 'IngestBulk' AND seq % 7 <> 0 THEN 'bulk_stream' ELSE 'buffered' END AS mode, seq % 7 <> 0 AS sync FROM @req""")
def body_modes(spark: SparkSession, d: str) -> DataFrame:
    r, n = routing.classified(requests(spark, d)), F.col("seq")
    headers = F.when(n % 7 == 0, S.add_header(F.col("headers"), "X-Write-Mode", F.lit("Async"))).otherwise(S.add_header(F.col("headers"), "x-write-mode", F.lit("later")))
    sync = surfaces.is_sync_write(headers)
    mode = lambda p: surfaces.body_mode(F.col("endpoint"), F.col("path"), F.col("logical_index"), F.when(n % 3 == 0, "scroll=1m"), sync, n % 5 == 0, p)
    return r.select("request_id", F.when(n % 2 == 0, mode(("ord",))).otherwise(mode(None)).alias("mode"), sync.alias("sync"))


_HEADER = {"directives": [{"id": "s", "level": "Shape", "ttl_secs": 60, "endpoint": "Search", "ring_buffer": True}]}


@query("""WITH x AS (SELECT request_id, seq, endpoint = 'Search' AS s, CASE seq % 6 WHEN 0 THEN 3 WHEN 1 THEN CASE WHEN user_id = 7 THEN 2 ELSE 0 END ELSE 0 END AS own FROM @req)
SELECT request_id, ['Off', 'Shape', 'ShapeTiming', 'ShapeRewriteDiff'][greatest(own, CASE WHEN s THEN 1 ELSE 0 END) + 1] AS level, s AS ring_buffer, own > 0 AS capture FROM x""")
def combined_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Directives of the store and of signed headers: those that are expired, of a bad rate or forged have no effect."""
    n = F.col("seq")
    payload = (
        F.when(n % 6 == 0, F.lit('{"level":"ShapeRewriteDiff","exp":2000,"capture":true}')).when(n % 6 == 1, F.lit('{"level":"ShapeTiming","exp":2000,"tenant":"7","capture":true}'))
        .when(n % 6 == 2, F.lit('{"level":"ShapeTiming","exp":1010,"capture":true}')).when(n % 6 == 3, F.lit('{"level":"ShapeTiming","exp":2000,"sample_per_mille":1001}')).when(n % 6 == 4, F.lit('{"level":"Loud","exp":2000}'))
    )
    r = routing.classified(requests(spark, d)).select("request_id", "seq", F.col("user_id").cast("string").alias("tenant"), F.col("logical_index").alias("index"), F.lit("p").alias("principal"), "endpoint")
    store = observe.decode_directives(spark, json.dumps(_HEADER), 1000.0)
    return surfaces.combined_diagnostics(r, store, surfaces.header_directive(payload, F.lit(1010)), F.lit(1010.0))


_CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(h) // 2 + 1), lambda i: ('0x' || substr(h, (2 * i - 1)::INTEGER, 2))::BIGINT), lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"


@query(f"""WITH b AS (SELECT event_id, lower(hex(encode('t1'))) AS t, lower(hex(encode('k' || user_id))) AS k, lower(hex(encode(props))) AS p FROM events),
f AS (SELECT event_id, '0200' || t || printf('%02x', length(k) // 2) || '000000' || k || p AS h FROM b),
g AS (SELECT event_id, h, printf('%08x', {_CRC}) AS c, printf('%08x', length(h) // 2) AS n FROM f)
SELECT event_id, substr(n, 7, 2) || substr(n, 5, 2) || substr(n, 3, 2) || substr(n, 1, 2) || substr(c, 7, 2) || substr(c, 5, 2) || substr(c, 3, 2) || substr(c, 1, 2) || h AS frame FROM g""")
def log_frames(spark: SparkSession, d: str) -> DataFrame:
    own = surfaces.frame(F.lit("t1"), F.concat(F.lit("k"), F.col("user_id").cast("string")), F.col("props"))
    return table(spark, d, "events").select("event_id", F.lower(F.hex(own)).alias("frame"))


@query("""WITH x AS (SELECT user_id, event_id, props, min(CASE WHEN event_id % 50 = 49 THEN event_id END) OVER (PARTITION BY user_id) AS torn FROM events)
SELECT user_id AS segment, event_id AS seq, 't1' AS topic, 'k' || user_id AS key, props AS payload FROM x WHERE torn IS NULL OR event_id < torn""")
def torn_segments(spark: SparkSession, d: str) -> DataFrame:
    """Frames are read up to the first that is cut off or damaged."""
    n = F.col("event_id")
    own = surfaces.frame(F.lit("t1"), F.concat(F.lit("k"), F.col("user_id").cast("string")), F.col("props"))
    hurt = F.when(n % 100 == 49, F.substring(own, F.lit(1), F.octet_length(own) - 1)).when(n % 100 == 99, F.concat(F.substring(own, F.lit(1), F.octet_length(own) - 1), F.unhex(F.lit("00")))).otherwise(own)
    frames = table(spark, d, "events").select(F.col("user_id").alias("segment"), n.alias("seq"), hurt.alias("frame"))
    text = lambda c: F.decode(c, "utf-8")
    return surfaces.readable(frames).select("segment", "seq", "record.topic", text(F.col("record.key")).alias("key"), text(F.col("record.payload")).alias("payload"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'w' || event_id END AS pit, CASE WHEN event_id % 2 = 0 THEN '{"pit":{"id":"r' || event_id || '","keep_alive":"1m"},"size":1}' ELSE '{"size":1}' END AS body FROM events""")
def pit_bodies(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    text = n.cast("string")
    body = F.when(n % 2 == 0, F.concat(F.lit('{"size":1,"pit":{"keep_alive":"1m","id":"w'), text, F.lit('"}}'))).otherwise(F.lit('{"size":1}'))
    return table(spark, d, "events").select("event_id", surfaces.pit_of(body).alias("pit"), surfaces.with_pit(body, F.concat(F.lit("r"), text)).alias("body"))


@query("""SELECT o_orderkey AS position, '{"_index":"orders","_id":"' || o_orderkey || '","_source":{"s":"' || o_orderstatus || '"}}' AS hit FROM orders WHERE o_custkey = 7""")
def search_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits as the client sees them: its index and id, without what tenancy added."""
    own = documents(spark, d).filter("_tenant = 7")
    source = F.concat(F.lit('{"_tenant":"7","s":"'), F.col("o_orderstatus"), F.lit('"}'))
    return surfaces.shaped_hits(own.select(F.col("o_orderkey").alias("position"), "_id", source.alias("_source"), F.lit("7").alias("_routing")), TEMPLATE, ["_tenant"], "orders", F.lit("7"))


@query("""SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'POST' ELSE 'PUT' END AS method, '/orders/_doc' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '/' || o_orderkey END AS path, 'IngestDoc' AS endpoint FROM orders""")
def document_calls(spark: SparkSession, d: str) -> DataFrame:
    """Documents sent by typed calls go the way of any other request."""
    k = F.col("o_orderkey")
    call = surfaces.document_call(F.lit("orders"), F.when(k % 3 == 0, F.when(k % 2 == 0, "")).otherwise(k.cast("string")))
    rows = table(spark, d, "orders").select(k.alias("key"), call["method"].alias("method"), call["path"].alias("path"))
    return routing.classified(rows).select("key", "method", "path", "endpoint")


@query("""SELECT request_id, CASE WHEN e = 'placement_missing' THEN e || '/false/' || user_id WHEN e IS NOT NULL THEN e || '/true/' END AS context FROM (SELECT request_id, user_id, CASE seq % 3 WHEN 0 THEN 'placement_missing' WHEN 1 THEN 'stale_epoch' END AS e FROM @req)""")
def error_contexts(spark: SparkSession, d: str) -> DataFrame:
    error = F.when(F.col("seq") % 3 == 0, "placement_missing").when(F.col("seq") % 3 == 1, "stale_epoch")
    c = surfaces.error_context(error, error == "stale_epoch", F.col("user_id").cast("string"))
    return requests(spark, d).select("request_id", F.when(c.isNotNull(), F.concat(c["code"], F.lit("/"), c["retryable"].cast("string"), F.lit("/"), F.coalesce(c["partition"], F.lit("")))).alias("context"))


@query("""SELECT request_id, sha256(request_id) AS fingerprint, '{"request_id":"' || request_id || '","level":"Shape","status":' || (200 + seq % 2 * 300) || ',"ok":' || CASE WHEN seq % 2 = 0 THEN 'true' ELSE 'false' END || '}' AS line FROM @req""")
def log_lines(spark: SparkSession, d: str) -> DataFrame:
    line = surfaces.log_line(F.col("request_id"), F.lit("Shape"), _long(200 + F.col("seq") % 2 * 300))
    return requests(spark, d).select("request_id", surfaces.certificate_fingerprint(F.col("request_id").cast("binary")).alias("fingerprint"), line.alias("line"))


@query("""WITH f AS (SELECT event_type AS name, CAST(count(*) AS DOUBLE) AS m FROM events GROUP BY 1)
SELECT '# Run' || chr(10) || chr(10) || '| Check | Measured | Bound | Result |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg(printf('| %s | %.2f | %.2f | %s |', name, m, 50.0, CASE WHEN m <= 50 THEN 'pass' ELSE 'fail' END), chr(10) ORDER BY name) || chr(10) || chr(10) || 'Verdict: ' || CASE WHEN bool_and(m <= 50) THEN 'pass' ELSE 'fail' END || chr(10) AS brief FROM f""")
def run_brief(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").cast("double").alias("measured"))
    return surfaces.brief(rows.select("name", "measured", F.lit(50.0).alias("bound"), (F.col("measured") <= 50).alias("passed")), "Run")
