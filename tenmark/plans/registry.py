"""Name to query, and name to oracle SQL, of the engine's own operators."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenmark.functions import scalars as S
from tenmark.operators import bulk, control, cursors, observe, rewrite, routing, stats, writes
from tenmark.plans import search as Q
from tenmark.plans.catalog import ORACLES, QUERIES, query
from tenmark.plans.tables import TEMPLATE, bodies, documents, operations, placement_log, requests, table

def _long(c: Column) -> Column:
    return c.cast("long")


# --- scalars and rewrites -------------------------------------------------------------------------------


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS missing FROM events")
def json_scalar(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", S.json_scalar(F.col("props"), "k").alias("k"), S.json_scalar(F.col("props"), "none").alias("missing"))


@query("SELECT o_orderkey AS key, o_orderpriority AS level, CAST(o_orderkey % 7 AS VARCHAR) AS n, CAST(NULL AS VARCHAR) AS meta, CAST(NULL AS VARCHAR) AS tags FROM orders")
def json_scalar_nested(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("body")
    return bodies(spark, d).select("key", S.json_scalar(b, "meta.level").alias("level"), S.json_scalar(b, "meta.n").alias("n"), S.json_scalar(b, "meta").alias("meta"), S.json_scalar(b, "tags").alias("tags"))


@query("SELECT o_orderkey AS key, CAST(o_custkey AS VARCHAR) AS tenant, 'eu' AS region, o_orderstatus AS status, CAST(7 AS BIGINT) AS n_keys FROM orders")
def inject_fields(spark: SparkSession, d: str) -> DataFrame:
    out = rewrite.inject(F.col("body"), {"_tenant": S.json_string(F.col("partition")), "_region": F.lit('"eu"')})
    held = bodies(spark, d).select("key", out.alias("b"))
    at = lambda p: F.get_json_object("b", p)
    return held.select("key", at("$._tenant").alias("tenant"), at("$._region").alias("region"), at("$.status").alias("status"), _long(F.size(F.json_object_keys("b"))).alias("n_keys"))


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'reserved_field_collision' END AS error FROM orders")
def inject_collision(spark: SparkSession, d: str) -> DataFrame:
    own = F.when(F.col("key") % 2 == 0, F.lit('{"_tenant":"x"}')).otherwise(F.col("body"))
    return bodies(spark, d).select("key", rewrite.inject_error(own, {"_tenant": F.lit("1")}).alias("error"))


@query("SELECT o_orderkey AS key, CAST(NULL AS VARCHAR) AS status, CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderkey % 7 AS VARCHAR) AS n, CAST(3 AS BIGINT) AS n_keys, CAST(2 AS BIGINT) AS removed FROM orders")
def strip_fields(spark: SparkSession, d: str) -> DataFrame:
    names = ["status", "tenant_id", "never"]
    held = bodies(spark, d).select("key", rewrite.strip(F.col("body"), names).alias("b"), _long(rewrite.stripped_count(F.col("body"), names)).alias("removed"))
    at = lambda p: F.get_json_object("b", p)
    return held.select("key", at("$.status").alias("status"), at("$.id").alias("id"), at("$.meta.n").alias("n"), _long(F.size(F.json_object_keys("b"))).alias("n_keys"), "removed")


@query("SELECT o_orderkey AS key, CAST(o_custkey AS VARCHAR) AS t_doc, CAST(o_custkey AS VARCHAR) AS t_up, 'true' AS flag FROM orders")
def inject_update(spark: SparkSession, d: str) -> DataFrame:
    change = F.concat(F.lit('{"doc":{"a":1},"flag":true,"upsert":'), F.col("body"), F.lit("}"))
    out = bodies(spark, d).select("key", rewrite.inject_update(change, {"_t": S.json_string(F.col("partition"))}).alias("b"))
    at = lambda p: F.get_json_object("b", p)
    return out.select("key", at("$.doc._t").alias("t_doc"), at("$.upsert._t").alias("t_up"), at("$.flag").alias("flag"))


@query("SELECT o_orderkey AS key, CAST(o_custkey AS VARCHAR) || ':' || o_orderkey AS id, CAST(NULL AS VARCHAR) AS none FROM orders")
def construct_id(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("body")
    return bodies(spark, d).select("key", S.construct_id(TEMPLATE, F.col("partition"), b).alias("id"), S.construct_id("{partition}:{body.meta}", F.col("partition"), b).alias("none"))


@query("SELECT o_orderkey AS key, 'p' || o_custkey || '-' || o_orderkey || '!' AS id FROM orders")
def logical_to_physical(spark: SparkSession, d: str) -> DataFrame:
    return bodies(spark, d).select("key", S.to_physical("p{partition}-{body.id}!", F.col("partition"), F.col("key").cast("string")).alias("id"))


@query("SELECT _id AS physical, CAST(o_orderkey AS VARCHAR) AS own, CASE WHEN o_custkey = 7 THEN CAST(o_orderkey AS VARCHAR) END AS of_seven FROM @docs")
def physical_to_logical(spark: SparkSession, d: str) -> DataFrame:
    own = documents(spark, d)
    return own.select(F.col("_id").alias("physical"), S.to_logical(TEMPLATE, F.col("_tenant").cast("string"), F.col("_id")).alias("own"), S.to_logical(TEMPLATE, F.lit("7"), F.col("_id")).alias("of_seven"))


@query("SELECT _id AS physical, CAST(o_orderkey AS VARCHAR) AS _id, 'orders' AS _index, CAST(o_orderkey AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS hidden FROM @docs")
def write_read_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = bodies(spark, d).withColumnRenamed("body", "_source")
    stored = rewrite.for_write(rows, TEMPLATE, {"_tenant": S.json_string(F.col("partition"))}).filter("error IS NULL").withColumn("physical", F.col("_id"))
    seen = rewrite.for_read(stored, TEMPLATE, ["_tenant"], F.lit("orders"), F.col("partition"))
    return seen.select("physical", "_id", "_index", F.get_json_object("_source", "$.id").alias("id"), F.get_json_object("_source", "$._tenant").alias("hidden"))


@query("SELECT p_partkey, replace(replace(url_encode(p_name || ':~*/é'), '%3A', ':'), '+', '%20') AS encoded FROM part")
def percent_encode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.percent_encode(F.concat("p_name", F.lit(":~*/é"))).alias("encoded"))


@query("SELECT event_id, lower(hex(encode('c' || event_id))) AS hexed, 'c' || event_id AS back FROM events")
def hex_codec(spark: SparkSession, d: str) -> DataFrame:
    own = F.concat(F.lit("c"), F.col("event_id").cast("string"))
    return table(spark, d, "events").select("event_id", S.hex_text(own).alias("hexed"), S.unhex_text(S.hex_text(own)).alias("back"))


@query("""SELECT event_id, CAST(strlen(props) AS BIGINT) AS length, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(props) + 1), lambda i: ascii(substr(props, i::INTEGER, 1))::BIGINT),
  lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS crc FROM events""")
def crc32_frame(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.octet_length("props").cast("long").alias("length"), S.crc32(F.col("props")).alias("crc"))


@query("""SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS trace_id, substr(md5(CAST(event_id AS VARCHAR)), 1, 16) AS span_id, event_id % 2 = 1 AS sampled,
  repeat('0', 16) || substr(md5(CAST(event_id AS VARCHAR)), 17, 16) AS b3_trace FROM events""")
def trace_headers(spark: SparkSession, d: str) -> DataFrame:
    h = F.md5(F.col("event_id").cast("string").cast("binary"))
    w3c = F.concat_ws("-", F.lit("00"), h, F.substring(h, 1, 16), F.concat(F.lit("0"), (F.col("event_id") % 2).cast("string")))
    b3 = S.b3(F.concat_ws("-", F.substring(h, 17, 16), F.substring(h, 1, 16), F.lit("1")))
    own = S.traceparent(w3c)
    return table(spark, d, "events").select("event_id", own["trace_id"].alias("trace_id"), own["span_id"].alias("span_id"), own["sampled"].alias("sampled"), b3["trace_id"].alias("b3_trace"))


@query("SELECT request_id, CAST(CASE WHEN seq % 4 <> 1 THEN 1 ELSE 0 END AS BIGINT) AS n, CASE WHEN seq % 4 <> 1 THEN CAST(user_id AS VARCHAR) END AS tenant, 't' AS token FROM @req")
def header_forward_set(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("headers")
    kept = S.forward_headers(h, ("authorization",))
    return requests(spark, d).select("request_id", _long(F.size(kept)).alias("n"), S.header(kept, "x-tenant").alias("tenant"), S.bearer_token(S.header(h, "authorization")).alias("token"))


@query("SELECT request_id, event_type = 'click' AS valid, CASE WHEN event_type = 'click' THEN event_type || ':' || seq ELSE request_id END AS op_id, CASE WHEN event_type = 'view' THEN 'async' ELSE 'sync' END AS mode FROM @req")
def op_id_validity(spark: SparkSession, d: str) -> DataFrame:
    client = F.when(F.col("event_type") == "click", F.concat_ws(":", "event_type", F.col("seq").cast("string"))).otherwise(F.concat("event_type", F.lit(" no")))
    mode = S.write_mode(F.when(F.col("event_type") == "view", "ASYNC").when(F.col("event_type") == "error", "later"))
    return requests(spark, d).select("request_id", S.is_op_id(client).alias("valid"), S.op_id(client, F.col("request_id")).alias("op_id"), mode.alias("mode"))


@query("SELECT event_id AS n, CAST(least(50 * pow(2, least(event_id, 40)), 1000) AS BIGINT) AS ms, CAST(greatest(event_id - 500, 0) AS BIGINT) AS past FROM events")
def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, d, "events").select(n.alias("n"), S.backoff_ms(n).alias("ms"), _long(S.saturating_minus(n, F.lit(500))).alias("past"))


@query("SELECT request_id, CASE WHEN seq % 2 = 0 THEN 'scroll=1m&keep_alive=2m' END AS kept, seq % 2 = 0 AS opens, seq % 3 = 0 AS unsupported FROM @req")
def query_parameters(spark: SparkSession, d: str) -> DataFrame:
    q = F.when(F.col("seq") % 2 == 0, "scroll=1m&x=1&keep_alive=2m").otherwise("pretty=1")
    path = F.when(F.col("seq") % 3 == 0, "/orders/_update/1").otherwise("/orders/_doc/1")
    return requests(spark, d).select("request_id", S.query_parameters(q, ("scroll", "keep_alive")).alias("kept"), cursors.opens_scroll(q).alias("opens"), S.async_unsupported(path, q).alias("unsupported"))


# --- routing ----------------------------------------------------------------------------------------------


@query("SELECT request_id, endpoint, logical_index, did AS doc_id FROM @req")
def classify_endpoint(spark: SparkSession, d: str) -> DataFrame:
    return routing.classified(requests(spark, d)).select("request_id", "endpoint", "logical_index", "doc_id")


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return routing.resolved(routing.classified(requests(spark, d)), routing.any_of(F.col("body_tenant"), S.header(F.col("headers"), "x-tenant")))


@query("SELECT request_id, partition, CASE WHEN event_type = 'error' THEN 'unsupported_endpoint' WHEN partition IS NULL THEN 'partition_unresolved' END AS error FROM @req")
def resolve_partition(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).select("request_id", "partition", "error")


_ROUTED = """WITH r AS (SELECT q.request_id, q.seq, q.endpoint, p.kind, p.cluster, p.epoch, p.phase, CASE p.kind WHEN 'DedicatedCluster' THEN q.logical_index ELSE p.idx END AS target_index,
  CASE WHEN event_type = 'error' THEN 'unsupported_endpoint' WHEN q.partition IS NULL THEN 'partition_unresolved' WHEN p.cluster IS NULL THEN 'placement_missing' END AS error
  FROM @req q LEFT JOIN @placement p ON q.partition = p.partition) """


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return routing.placed(_resolved(spark, d), routing.current_placements(placement_log(spark, d)))


@query(_ROUTED + "SELECT request_id, kind, cluster, target_index, epoch, error FROM r")
def placement_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d).select("request_id", "kind", "cluster", "target_index", "epoch", "error")


@query("SELECT partition, kind, cluster, idx AS index, epoch, phase FROM @placement")
def current_placements(spark: SparkSession, d: str) -> DataFrame:
    return routing.current_placements(placement_log(spark, d)).select("partition", "kind", "cluster", "index", "epoch", "phase")


@query(_ROUTED + "SELECT request_id, coalesce(error, CASE WHEN NOT (phase <> 'cutover' AND epoch = 1 + seq % 5) THEN 'stale_epoch' END) AS error FROM r WHERE endpoint IN ('IngestDoc', 'IngestBulk', 'DeleteById')")
def epoch_gate(spark: SparkSession, d: str) -> DataFrame:
    writes_ = _placed(spark, d).filter(F.col("endpoint").isin(*routing.WRITES)).withColumn("stamped_epoch", 1 + F.col("seq") % 5)
    return routing.gated(writes_).select("request_id", "error")


@query(_ROUTED + ", e AS (SELECT * FROM (VALUES ('partition_unresolved', 400), ('unsupported_endpoint', 400), ('placement_missing', 404)) v(error, status)) SELECT coalesce(r.error, 'none') AS error, coalesce(e.status, 200) AS status, count(*) AS n FROM r LEFT JOIN e ON r.error = e.error GROUP BY ALL")
def error_statuses(spark: SparkSession, d: str) -> DataFrame:
    return routing.with_status(_placed(spark, d)).groupBy(F.coalesce("error", F.lit("none")).alias("error"), "status").agg(F.count("*").alias("n"))


@query("SELECT request_id, logical_index LIKE 'ord%' AS pass, event_type = 'error' AS admin, false AS climbs FROM @req")
def passthrough_prefix(spark: SparkSession, d: str) -> DataFrame:
    r = routing.classified(requests(spark, d))
    return r.select("request_id", routing.matches_prefix(F.col("logical_index"), ("ord", "zzz")).alias("pass"), routing.admin_allowed(F.col("path"), ("/_cat",)).alias("admin"), routing.climbs(F.col("path")).alias("climbs"))


@query("SELECT request_id, CASE WHEN endpoint IN ('IngestDoc', 'IngestBulk', 'DeleteById') AND seq % 2 = 1 THEN 'unauthorized' WHEN seq % 3 = 0 THEN 'auth_failed' WHEN seq % 5 = 0 THEN 'unauthorized' END AS error FROM @req")
def gate_order(spark: SparkSession, d: str) -> DataFrame:
    r, n = routing.classified(requests(spark, d)), F.col("seq")
    return r.select("request_id", routing.first_gate_error(F.col("endpoint").isin(*routing.WRITES), n % 2 == 0, n % 3 != 0, n % 5 != 0).alias("error"))


@query("SELECT event_id, CASE WHEN 400 + event_id % 200 >= 500 THEN 'upstream_failed' END AS error, 400 + event_id % 200 BETWEEN 502 AND 504 AS retryable FROM events")
def upstream_outcome(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", routing.upstream_outcome(400 + F.col("event_id") % 200).alias("o")).select("event_id", "o.error", "o.retryable")


# --- search -----------------------------------------------------------------------------------------------

_SEVEN = {"_tenant": "7"}


def _logical(hits: DataFrame) -> DataFrame:
    return hits.withColumn("_id", F.coalesce(S.to_logical(TEMPLATE, F.col("_tenant").cast("string"), F.col("_id")), F.col("_id")))


@query("SELECT 'orders' AS _index, CAST(o_orderkey AS VARCHAR) AS _id, o_orderstatus, o_totalprice FROM @docs WHERE tenant = '7' AND o_orderstatus = 'F' ORDER BY o_totalprice DESC, _id LIMIT 5")
def isolated_search_term(spark: SparkSession, d: str) -> DataFrame:
    body = {"query": {"term": {"o_orderstatus": "F"}}, "sort": [{"o_totalprice": "desc"}], "size": 5}
    return _logical(Q.search(documents(spark, d), body, _SEVEN)).select("_index", "_id", "o_orderstatus", "o_totalprice")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("_id"), "text", "lang", F.col("source").alias("_tenant"))


@query(r"""SELECT doc_id FROM documents WHERE source = 'src3' AND lang = 'en' AND list_has_any(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), ['onnd', 'thtion'])""")
def isolated_search_match(spark: SparkSession, d: str) -> DataFrame:
    body = {"query": {"bool": {"must": [{"match": {"text": "Onnd thtion"}}], "filter": [{"term": {"lang.keyword": "en"}}]}}}
    return Q.matched(_texts(spark, d), body, {"_tenant": "src3"}).select(F.col("_id").alias("doc_id"))


@query("SELECT _id, o_totalprice FROM @docs WHERE o_custkey = 8 AND (o_orderstatus = 'O' OR o_totalprice > 300000) AND NOT o_orderpriority LIKE '1%' ORDER BY o_totalprice DESC, _id LIMIT 4 OFFSET 1")
def isolated_search_sort_size(spark: SparkSession, d: str) -> DataFrame:
    body = {"query": {"bool": {"should": [{"term": {"o_orderstatus": "O"}}, {"range": {"o_totalprice": {"gt": 300000}}}], "must_not": {"prefix": {"o_orderpriority": "1"}}}}, "sort": {"o_totalprice": {"order": "desc"}}, "from": 1, "size": 4, "_source": ["o_totalprice"]}
    return Q.search(documents(spark, d), body, {"_tenant": "8"}).select("_id", "o_totalprice")


@query("SELECT count(*) AS count FROM orders WHERE o_custkey = 7 AND o_custkey = 8")
def isolated_adversarial(spark: SparkSession, d: str) -> DataFrame:
    return Q.count(documents(spark, d), {"query": {"bool": {"should": [{"term": {"_tenant": "8"}}]}}}, _SEVEN)


@query("SELECT count(*) AS count FROM orders WHERE o_custkey = 7 AND o_totalprice BETWEEN 10000 AND 250000 AND o_orderpriority IS NOT NULL")
def isolated_count(spark: SparkSession, d: str) -> DataFrame:
    return Q.count(documents(spark, d), {"query": {"bool": {"filter": [{"range": {"o_totalprice": {"gte": 10000, "lte": 250000}}}, {"exists": {"field": "o_orderpriority"}}]}}}, _SEVEN)


@query("SELECT o_orderstatus AS key, count(*) AS doc_count, sum(o_orderkey) AS keys FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2")
def terms_agg(spark: SparkSession, d: str) -> DataFrame:
    body = {"aggs": {"s": {"terms": {"field": "o_orderstatus", "size": 2}, "aggs": {"keys": {"sum": {"field": "o_orderkey"}}}}}}
    return Q.aggregate(documents(spark, d), body, None, "s")


@query("SELECT o_orderstatus AS key, count(*) AS doc_count, sum(o_orderkey) AS keys FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2")
def terms_agg_all(spark: SparkSession, d: str) -> DataFrame:
    """``terms_agg`` over every customer's orders."""
    body = {"aggs": {"s": {"terms": {"field": "o_orderstatus", "size": 2}, "aggs": {"keys": {"sum": {"field": "o_orderkey"}}}}}}
    return Q.aggregate(documents(spark, d), body, None, "s")


@query("SELECT o_orderpriority AS key, o_orderstatus AS key2, count(*) AS doc_count, max(o_totalprice) AS best FROM orders GROUP BY 1, 2")
def nested_terms(spark: SparkSession, d: str) -> DataFrame:
    body = {"aggs": {"p": {"terms": {"field": "o_orderpriority"}, "aggs": {"s": {"terms": {"field": "o_orderstatus"}, "aggs": {"best": {"max": {"field": "o_totalprice"}}}}}}}}
    return Q.aggregate(documents(spark, d), body, None, "p")


@query("""WITH r AS (SELECT o_orderstatus AS key, _id, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, _id) AS k, count(*) OVER (PARTITION BY o_orderstatus) AS doc_count FROM @docs WHERE o_custkey = 7)
SELECT key, doc_count, string_agg(_id, ',' ORDER BY k) AS top FROM r WHERE k <= 2 GROUP BY 1, 2""")
def terms_top_hits(spark: SparkSession, d: str) -> DataFrame:
    body = {"aggs": {"s": {"terms": {"field": "o_orderstatus"}, "aggs": {"t": {"top_hits": {"size": 2, "sort": [{"o_totalprice": "desc"}]}}}}}}
    return Q.aggregate(documents(spark, d), body, _SEVEN, "s").withColumn("top", F.array_join("top", ","))


@query("SELECT _id, o_totalprice FROM @docs WHERE tenant = '7' AND o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_custkey = 7)")
def get_by_id(spark: SparkSession, d: str) -> DataFrame:
    own = documents(spark, d)
    least = own.filter("_tenant = 7").agg(F.min("o_orderkey").cast("string").alias("id"))
    wanted = least.select(F.lit(0).alias("pos"), S.to_physical(TEMPLATE, F.lit("7"), F.col("id")).alias("_id"))
    return Q.get_by_ids(own, wanted, _SEVEN).select("_id", "o_totalprice")


@query("SELECT _id, o_totalprice FROM @docs WHERE tenant = '7' AND o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_custkey = 7)")
def point_read(spark: SparkSession, d: str) -> DataFrame:
    """The same for an id that is known when the read is planned, as a client's is."""
    own = documents(spark, d)
    asked = own.filter("_tenant = 7").agg(F.min("o_orderkey").cast("string").alias("id")).first()["id"]
    return Q.point_read(own, asked, _SEVEN, TEMPLATE, "7", "o_orderkey").select("_id", "o_totalprice")


@query("""SELECT w.pos, w.id, d._id IS NOT NULL AS found, d.o_totalprice FROM (SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS pos, CAST(event_id % 300 AS VARCHAR) AS id FROM events) w
LEFT JOIN @docs d ON d.tenant = '7' AND d._id = '7:' || w.id""")
def mget_positional(spark: SparkSession, d: str) -> DataFrame:
    from tenmark.sources.ndjson import parse_multi_get

    ids = table(spark, d, "events").agg(F.array_sort(F.collect_list(F.struct("event_id", (F.col("event_id") % 300).cast("string").alias("i")))).alias("x"))
    body = ids.select(F.lit("r").alias("request_id"), F.to_json(F.struct(F.transform("x", lambda e: e["i"]).alias("ids"))).alias("body"))
    wanted = parse_multi_get(body, "orders").select(_long(F.col("pos")).alias("pos"), "id", S.to_physical(TEMPLATE, F.lit("7"), F.col("id")).alias("_id"))
    return Q.get_by_ids(documents(spark, d), wanted, _SEVEN).select("pos", "id", "found", "o_totalprice")


@query("""SELECT 0 AS ordinal, _id, CAST(NULL AS VARCHAR) AS error FROM (SELECT _id FROM @docs WHERE tenant = '7' ORDER BY _id LIMIT 3)
UNION ALL SELECT 1, NULL, 'suggest cannot be filtered' UNION ALL SELECT 2, _id, NULL FROM (SELECT _id FROM @docs WHERE tenant = '8' AND o_orderstatus = 'F' ORDER BY o_totalprice, _id LIMIT 2)""")
def msearch_union(spark: SparkSession, d: str) -> DataFrame:
    from tenmark.sources.ndjson import parse_multi_search

    body = '{}\n{"size":3}\n{"index":["orders"]}\n{"suggest":{}}\n\n{"index":"orders"}\n{"query":{"term":{"o_orderstatus":"F"}},"sort":["o_totalprice"],"size":2}\n'
    items = [(b, f) for (_, b), f in zip(parse_multi_search(body, "orders"), ({"_tenant": "7"}, {"_tenant": "7"}, {"_tenant": "8"}), strict=True)]
    return Q.multi_search(documents(spark, d), items, ["_id"]).select("ordinal", "_id", "error")


# --- writes -----------------------------------------------------------------------------------------------


@query("SELECT key, max(ordinal) AS ordinal, arg_max(source, ordinal) AS source FROM @ops WHERE action = 'index' GROUP BY key")
def index_last_writer_wins(spark: SparkSession, d: str) -> DataFrame:
    return writes.last_writes(operations(spark, d).filter("action = 'index'").select("key", _long(F.col("ordinal")).alias("ordinal"), "source"))


def _state(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.concat_ws(":", F.col("o_orderkey").cast("string"), F.lit("1")).alias("key"), F.lit("{}").alias("source"))


_STATE = "s AS (SELECT o_orderkey || ':1' AS key FROM orders WHERE o_orderkey % 2 = 0)"


@query(f"WITH {_STATE} SELECT o.request_id, o.ordinal, CASE WHEN row_number() OVER (PARTITION BY o.key ORDER BY ordinal) = 1 AND s.key IS NULL THEN 201 ELSE 409 END AS status FROM @ops o LEFT JOIN s ON o.key = s.key WHERE action = 'create'")
def create_conflict(spark: SparkSession, d: str) -> DataFrame:
    ops = operations(spark, d).filter("action = 'create'")
    return writes.create_results(ops, _state(spark, d)).select("request_id", _long(F.col("ordinal")).alias("ordinal"), "status")


@query(f"WITH {_STATE} SELECT o.request_id, o.ordinal, CASE WHEN row_number() OVER (PARTITION BY o.key ORDER BY ordinal) = 1 AND s.key IS NULL THEN 'created' ELSE 'updated' END AS result FROM @ops o LEFT JOIN s ON o.key = s.key WHERE action = 'index'")
def index_created_or_updated(spark: SparkSession, d: str) -> DataFrame:
    return writes.index_results(operations(spark, d).filter("action = 'index'"), _state(spark, d)).select("request_id", _long(F.col("ordinal")).alias("ordinal"), "result")


@query(f"WITH {_STATE}, x AS (SELECT key, arg_max(action, ordinal) AS last FROM @ops WHERE action <> 'create' GROUP BY key) SELECT coalesce(x.key, s.key) AS key FROM s FULL JOIN x ON s.key = x.key WHERE coalesce(x.last, 'index') = 'index'")
def delete_by_id(spark: SparkSession, d: str) -> DataFrame:
    ops = operations(spark, d).filter("action <> 'create'").withColumn("source", F.lit("{}"))
    return writes.next_state(_state(spark, d), writes.apply_ops(_state(spark, d), ops)).select("key")


@query("SELECT o_orderkey AS key, CAST(o_orderkey AS VARCHAR) AS a, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'up' END AS b FROM orders WHERE o_orderkey % 3 <> 0")
def update_merge(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    state = o.filter("k % 2 = 0").select(F.col("k").cast("string").alias("key"), F.to_json(F.struct(F.col("k").alias("a"), F.lit("old").alias("b"))).alias("source"))
    change = F.when(F.col("k") % 2 == 0, F.lit('{"doc":{"b":"new"}}')).otherwise(F.concat(F.lit('{"doc":{"b":"no"},"upsert":{"a":'), F.col("k").cast("string"), F.lit(',"b":"up"}}')))
    ops = o.select(F.col("k").cast("string").alias("key"), F.lit(0).alias("ordinal"), F.lit("update").alias("action"), change.alias("source"))
    drop = o.filter("k % 3 = 0").select(F.col("k").cast("string").alias("key"), F.lit(1).alias("ordinal"), F.lit("delete").alias("action"), F.lit(None).cast("string").alias("source"))
    after = writes.next_state(state, writes.apply_ops(state, ops.unionByName(drop)))
    return after.select(_long(F.col("key")).alias("key"), F.get_json_object("source", "$.a").alias("a"), F.get_json_object("source", "$.b").alias("b"))


@query("""WITH m AS (SELECT _id, row_number() OVER (ORDER BY _id) - 1 AS k, count(*) OVER () AS n FROM @docs WHERE o_custkey = 7)
SELECT 'few:' || k AS op_id, _id, 'delete' AS op_type FROM m UNION ALL SELECT 'all', NULL, 'rejected' FROM (SELECT count(*) AS n FROM orders) WHERE n > 100""")
def delete_by_query_cap(spark: SparkSession, d: str) -> DataFrame:
    own = documents(spark, d)
    few = writes.delete_by_query(Q.matched(own, {}, _SEVEN), "few")
    return few.unionByName(writes.delete_by_query(Q.matched(own, {}, None), "all", cap=100))


# --- bulk -------------------------------------------------------------------------------------------------


@query("SELECT request_id, ordinal, target, CAST(floor((row_number() OVER (PARTITION BY request_id, target ORDER BY ordinal) - 1) / 2) AS INTEGER) AS batch FROM @ops")
def bulk_demux_batches(spark: SparkSession, d: str) -> DataFrame:
    return bulk.count_batches(operations(spark, d), ["request_id", "target"], 2).select("request_id", _long(F.col("ordinal")).alias("ordinal"), "target", "batch")


@query("""WITH RECURSIVE x AS (SELECT target, request_id::BIGINT * 100 + ordinal AS ordinal, CAST(source % 1000 AS INTEGER) AS bytes, row_number() OVER (PARTITION BY target ORDER BY request_id::BIGINT * 100 + ordinal) AS k FROM @ops),
r AS (SELECT target, ordinal, bytes, k, 0 AS batch, 1 AS n, bytes::BIGINT AS size FROM x WHERE k = 1
  UNION ALL SELECT x.target, x.ordinal, x.bytes, x.k, CASE WHEN r.n >= 256 OR r.size >= 4096 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.n >= 256 OR r.size >= 4096 THEN 1 ELSE r.n + 1 END, CASE WHEN r.n >= 256 OR r.size >= 4096 THEN x.bytes ELSE r.size + x.bytes END FROM r JOIN x ON x.target = r.target AND x.k = r.k + 1)
SELECT target, ordinal, bytes, batch FROM r""")
def bulk_flush_by_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Greedy batches whose sum starts anew have no SQL form; tests hold them against a loop."""
    ops = operations(spark, d).withColumn("ordinal", _long(F.col("request_id")) * 100 + F.col("ordinal"))
    return bulk.flush_batches(ops.select("target", "ordinal", "bytes"), ["target"], 256, 4096)


@query("SELECT request_id, bool_or(action = 'delete') AS errors, string_agg(action || '/' || key, ',' ORDER BY ordinal) AS items FROM @ops GROUP BY request_id")
def bulk_reinterleave(spark: SparkSession, d: str) -> DataFrame:
    items = operations(spark, d).select("request_id", "ordinal", F.concat_ws("/", "action", "key").alias("line"), (F.col("action") == "delete").alias("is_error"))
    return bulk.interleaved(items)


@query("SELECT request_id, ordinal, action, key AS id, CAST(source AS VARCHAR) AS part FROM (SELECT request_id, ordinal, action, key, CASE WHEN action <> 'delete' THEN source END AS source FROM @ops)")
def bulk_parse(spark: SparkSession, d: str) -> DataFrame:
    from tenmark.sources.ndjson import parse_bulk

    meta = F.concat(F.lit('{"'), F.col("action"), F.lit('":{"_id":"'), F.col("key"), F.lit('"}}\n'))
    line = F.concat(meta, F.when(F.col("action") == "delete", "").otherwise(F.concat(F.lit('{"part":'), F.col("source").cast("string"), F.lit("}\r\n\n"))))
    own = operations(spark, d).groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("x"))
    sent = own.select(F.col("request_id").cast("string").alias("request_id"), F.array_join(F.transform("x", lambda x: x["line"]), "").alias("body"))
    return parse_bulk(sent).select(_long(F.col("request_id")).alias("request_id"), _long(F.col("ordinal")).alias("ordinal"), "action", "id", F.get_json_object("source", "$.part").alias("part"))


@query("""SELECT request_id, ordinal, CASE WHEN action = 'delete' AND ordinal % 2 = 0 THEN 'delete_without_id' WHEN action = 'create' AND ordinal % 3 = 0 THEN 'missing_source' END AS error,
CASE WHEN action = 'delete' AND ordinal % 2 = 0 OR action = 'create' AND ordinal % 3 = 0 THEN 400 WHEN action = 'create' THEN 201 ELSE 200 END AS status FROM @ops""")
def bulk_item_errors(spark: SparkSession, d: str) -> DataFrame:
    ident = F.when((F.col("action") != "delete") | (F.col("ordinal") % 2 != 0), F.col("key"))
    source = F.when((F.col("action") != "create") | (F.col("ordinal") % 3 != 0), F.col("source"))
    out = operations(spark, d).withColumn("error", bulk.item_error(F.col("action"), ident, source))
    return out.select("request_id", _long(F.col("ordinal")).alias("ordinal"), "error", bulk.item_status(F.col("error"), F.when(F.col("action") == "create", "created")).alias("status"))


# --- observability ----------------------------------------------------------------------------------------

_FNV = "list_reduce([14695981039346656037::HUGEINT] || list_transform(range(1, length(request_id) + 1), lambda i: ascii(substr(request_id, i::INTEGER, 1))::HUGEINT), lambda h, b: xor(h, b) * 1099511628211::HUGEINT % 18446744073709551616::HUGEINT)"


@query(f"SELECT request_id, CAST({_FNV} % 1000 AS INTEGER) < 250 AS quarter, false AS never, true AS always FROM @req")
def fnv_sampling(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("request_id")
    return requests(spark, d).select("request_id", *(observe.sampled(r, F.lit(n)).alias(a) for n, a in ((250, "quarter"), (0, "never"), (1000, "always"))))


DIRECTIVES = {
    "directives": [
        {"id": "a", "level": "Shape", "ttl_secs": 60},
        {"id": "b", "level": "ShapeRewriteDiff", "ttl_secs": 60, "tenant": "7", "ring_buffer": True},
        {"id": "c", "level": "ShapeTiming", "ttl_secs": 5, "endpoint": "Search"},
        {"id": "d", "level": "ShapeTiming", "ttl_secs": 60, "endpoint": "Search", "sample_per_mille": 500, "capture": True},
    ]
}


@query(f"""WITH x AS (SELECT request_id, CAST(user_id AS VARCHAR) = '7' AS b, endpoint = 'Search' AND CAST({_FNV} % 1000 AS INTEGER) < 500 AS d FROM @req)
SELECT request_id, CASE WHEN b THEN 'ShapeRewriteDiff' WHEN d THEN 'ShapeTiming' ELSE 'Shape' END AS level, b AS ring_buffer, d AS capture FROM x""")
def directive_level(spark: SparkSession, d: str) -> DataFrame:
    r = routing.classified(requests(spark, d)).select("request_id", F.col("user_id").cast("string").alias("tenant"), F.col("logical_index").alias("index"), F.lit("p").alias("principal"), "endpoint")
    return observe.diagnostics(r, observe.decode_directives(spark, json.dumps(DIRECTIVES), 1000.0), F.lit(1010.0))


@query("SELECT * FROM (VALUES ('a', false), ('b', false), ('c', true), ('d', false)) v(id, expired)")
def ttl_expiry(spark: SparkSession, d: str) -> DataFrame:
    return observe.decode_directives(spark, json.dumps(DIRECTIVES), 1000.0).select("id", (F.col("expires_at") <= 1010.0).alias("expired"))


@query("SELECT 'u' || user_id AS request_id, min(event_id) AS seq FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 1024) GROUP BY 1")
def explain_ring_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("request_id"), F.col("event_id").alias("seq"))
    return observe.ring_lookup(rows)


@query("SELECT request_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS outcome, endpoint, CASE WHEN event_type = 'error' THEN 'unsupported_endpoint' END AS error FROM @req")
def explain_document(spark: SparkSession, d: str) -> DataFrame:
    r = routing.classified(requests(spark, d)).withColumn("classify", F.struct("endpoint", "logical_index")).withColumn("error", F.when(F.col("endpoint") == "Admin", "unsupported_endpoint"))
    at = lambda p: F.get_json_object("document", p)
    return observe.explain(r).select("request_id", at("$.outcome").alias("outcome"), at("$.spans.classify.endpoint").alias("endpoint"), at("$.error").alias("error"))


@query("SELECT event_type, count(*) AS total, count(*) FILTER (WHERE event_id % 10 < 7) AS ok, count(*) FILTER (WHERE event_id % 10 >= 7) AS errors FROM events GROUP BY 1")
def request_metrics(spark: SparkSession, d: str) -> DataFrame:
    return observe.request_metrics(table(spark, d, "events").withColumn("status", F.when(F.col("event_id") % 10 < 7, 201).otherwise(503)), ["event_type"])


@query("SELECT o_custkey, CAST(sum(o_orderkey % 5) AS BIGINT) AS dispatched, CAST(sum(o_orderkey % 7) AS BIGINT) AS opened, CAST(greatest(sum(o_orderkey % 5) - sum(o_orderkey % 7), 0) AS BIGINT) AS reused FROM orders GROUP BY 1")
def pool_reuse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return observe.pool_reuse(table(spark, d, "orders").select("o_custkey", (k % 5).alias("dispatched"), (k % 7).alias("opened")), ["o_custkey"])


# --- statistics -------------------------------------------------------------------------------------------


def _latency(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_type", "user_id", "event_id", _long(F.col("event_id") * 7919 % 10007).alias("ns"))


@query("""SELECT event_type, count(ns) AS n, min(ns) AS least, max(ns) AS most, CAST(sum(ns) // count(ns) AS BIGINT) AS mean, quantile_disc(ns, 0.5) AS p50, quantile_disc(ns, 0.9) AS p90, quantile_disc(ns, 0.99) AS p99
FROM (SELECT event_type, CAST(event_id * 7919 % 10007 AS BIGINT) AS ns FROM events) GROUP BY 1""")
def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    return stats.latency_summary(_latency(spark, d), ["event_type"], "ns")


@query("""WITH l AS (SELECT event_type, event_id % 2 = 0 AS t, CAST(event_id * 7919 % 10007 AS BIGINT) AS ns FROM events)
SELECT event_type, greatest(quantile_disc(ns, 0.5) FILTER (WHERE t) - quantile_disc(ns, 0.5) FILTER (WHERE NOT t), 0) AS added_p50, greatest(quantile_disc(ns, 0.99) FILTER (WHERE t) - quantile_disc(ns, 0.99) FILTER (WHERE NOT t), 0) AS added_p99 FROM l GROUP BY 1""")
def added_latency(spark: SparkSession, d: str) -> DataFrame:
    return stats.added_latency(_latency(spark, d).withColumn("through", F.col("event_id") % 2 == 0), ["event_type"], "ns", "through")


def _sweep(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, d, "events").select("user_id", n.alias("pos"), (n % 97).cast("double").alias("p99"), (n % 89).cast("double").alias("rps"))


@query("""WITH s AS (SELECT user_id, event_id AS pos, CAST(event_id % 97 AS DOUBLE) AS p99, CAST(event_id % 89 AS DOUBLE) AS rps FROM events),
a AS (SELECT user_id, arg_min(p99, pos) AS f, arg_max(p99, pos) AS l, arg_min(rps, pos) AS r, max(rps) AS m FROM s GROUP BY 1),
v AS (SELECT user_id, CASE WHEN f > 0 THEN l / f ELSE 1.0 END AS tail, CASE WHEN r > 0 THEN m / r ELSE 0.0 END AS scaling FROM a)
SELECT user_id, round(tail, 6) AS tail, round(scaling, 6) AS scaling, tail <= 3.0 AND scaling >= 2.0 AS passed FROM v""")
def scale_verdict(spark: SparkSession, d: str) -> DataFrame:
    both = stats.tail_amplification(_sweep(spark, d), ["user_id"]).join(stats.throughput_scaling(_sweep(spark, d), ["user_id"]), "user_id")
    return stats.scale_verdict(both).select("user_id", F.round("tail", 6).alias("tail"), F.round("scaling", 6).alias("scaling"), "passed")


@query("""WITH f AS (SELECT p_partkey, p_size * 1000000 AS idle, p_size * 1000000 + p_partkey % 90 * 1000000 AS peak FROM part)
SELECT p_partkey, CAST(peak - idle AS BIGINT) AS growth, idle <= 268435456 AND (CASE WHEN idle > 0 THEN peak / idle ELSE 1.0 END <= 1.5 OR peak - idle <= 67108864) AS passed FROM f""")
def footprint_verdict(spark: SparkSession, d: str) -> DataFrame:
    idle = _long(F.col("p_size")) * 1000000
    return table(spark, d, "part").select("p_partkey", stats.footprint(idle, idle + F.col("p_partkey") % 90 * 1000000).alias("f")).select("p_partkey", _long(F.col("f.growth")).alias("growth"), "f.passed")


@query("SELECT event_type, bool_and(value < 400) AS passed, count(*) FILTER (WHERE NOT value < 400) AS failed FROM events GROUP BY 1")
def threshold_verdict(spark: SparkSession, d: str) -> DataFrame:
    return stats.verdict(table(spark, d, "events").select("event_type", (F.col("value") < 400).alias("holds")), ["event_type"])


# --- control ----------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE x AS (SELECT user_id AS u, event_id AS seq, ['set', 'begin', 'cutover', 'complete', 'abort'][event_id % 5 + 1] AS op, 'p' || event_id % 3 AS placement, CAST(floor(epoch(ts)) AS BIGINT) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
r AS (SELECT DISTINCT u, 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::VARCHAR AS phase, NULL::VARCHAR AS place, NULL::VARCHAR AS goal, NULL::BIGINT AS since, 0::BIGINT AS epoch, NULL::VARCHAR AS error FROM x
  UNION ALL SELECT u, k, seq, CASE WHEN op = 'set' THEN 'active' WHEN e IS NOT NULL THEN phase WHEN op = 'begin' THEN 'draining' WHEN op = 'cutover' THEN 'cutover' ELSE 'active' END,
    CASE WHEN op = 'set' THEN placement WHEN e IS NULL AND op = 'complete' THEN goal ELSE place END, CASE WHEN op = 'set' THEN NULL WHEN e IS NOT NULL THEN goal WHEN op = 'begin' THEN placement WHEN op IN ('complete', 'abort') THEN NULL ELSE goal END,
    CASE WHEN op = 'set' THEN NULL WHEN e IS NOT NULL THEN since WHEN op = 'cutover' THEN ts WHEN op IN ('complete', 'abort') THEN NULL ELSE since END, epoch + CASE WHEN e IS NULL THEN 1 ELSE 0 END, e
  FROM (SELECT x.*, r.phase, r.place, r.goal, r.since, r.epoch, CASE WHEN op = 'set' THEN NULL WHEN r.phase IS NULL THEN 'unknown_partition' WHEN op = 'begin' AND r.phase <> 'active' THEN 'already_migrating' WHEN op <> 'begin' AND r.phase = 'active' THEN 'not_migrating'
    WHEN op = 'cutover' AND r.phase <> 'draining' THEN 'not_draining' WHEN op = 'complete' AND r.phase <> 'cutover' THEN 'not_cutover' WHEN op = 'complete' AND x.ts - r.since < 30 THEN 'barrier_pending' END AS e FROM r JOIN x ON x.u = r.u AND x.k = r.k + 1))
SELECT phase, place AS read, CASE WHEN phase <> 'cutover' THEN place END AS write, error, CAST(u AS VARCHAR) AS partition, seq, epoch FROM r WHERE k > 0""")
def migration_fold(spark: SparkSession, d: str) -> DataFrame:
    """A state machine over a log; tests hold it against its invariants."""
    e = table(spark, d, "events")
    op = F.element_at(F.array(*map(F.lit, ("set", "begin", "cutover", "complete", "abort"))), (F.col("event_id") % 5 + 1).cast("int"))
    log = e.select(F.col("user_id").cast("string").alias("partition"), F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")).alias("placement"), _long(F.unix_timestamp("ts")).alias("ts"))
    return control.migration_states(log)


@query("""WITH x AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT event_id, coalesce(epoch(ts)::BIGINT - epoch(before)::BIGINT >= 30, false) AS passed FROM x""")
def drain_barrier(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id"))
    s = lambda c: F.floor(F.col(c).cast("timestamp").cast("double") + 0.5).cast("long")
    return e.withColumn("before", before).select("event_id", control.barrier_passed(s("before"), s("ts")).alias("passed"))


@query("""WITH x AS (SELECT user_id, event_id, event_type <> 'error' AS ok, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
SELECT event_id, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, b ORDER BY event_id) AS BIGINT) AS run FROM x""")
def failure_runs(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "events").select(F.col("user_id").cast("string").alias("cluster"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"))
    return control.failure_runs(calls).select(F.col("seq").alias("event_id"), _long(F.col("run")).alias("run"))


@query("""WITH RECURSIVE x AS (SELECT 'c' || user_id % 4 AS cluster, event_id AS seq, event_id AS ts, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS k FROM events),
r AS (SELECT DISTINCT cluster, NULL::BIGINT AS seq, NULL::BIGINT AS ts, NULL::BOOLEAN AS ok, 0::BIGINT AS k, NULL::BOOLEAN AS allowed, 0::BIGINT AS failures, NULL::BIGINT AS opened FROM x
  UNION ALL SELECT cluster, seq, ts, ok, k, may, CASE WHEN may AND ok THEN 0 WHEN may THEN failures + 1 ELSE failures END, CASE WHEN may AND ok THEN NULL WHEN may AND failures + 1 >= 2 THEN ts ELSE opened END
  FROM (SELECT x.*, r.failures, r.opened, r.opened IS NULL OR greatest(x.ts - r.opened, 0) >= 5 AS may FROM r JOIN x ON x.cluster = r.cluster AND x.k = r.k + 1))
SELECT cluster, seq, ts, ok, allowed, failures FROM r WHERE k > 0""")
def breaker_state(spark: SparkSession, d: str) -> DataFrame:
    """A fold with feedback (a refused call counts as none); tests hold it against a loop."""
    calls = table(spark, d, "events").select(F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("cluster"), F.col("event_id").alias("seq"), F.col("event_id").alias("ts"), (F.col("event_type") != "error").alias("ok"))
    return control.breaker_states(calls, threshold=2)


@query("""SELECT event_id, CAST(held AS BIGINT) AS held, held > 1000 AS over FROM (SELECT event_id, sum(CASE WHEN event_id % 2 = 0 THEN 100 ELSE -90 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS held FROM events)""")
def admission_running_sum(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("listener"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, 100).otherwise(-90).alias("delta"))
    return control.in_flight(e, 1000).select(F.col("seq").alias("event_id"), _long(F.col("held")).alias("held"), "over")


# --- cursors ----------------------------------------------------------------------------------------------


@query("SELECT event_id, 'c' || event_id % 3 AS cluster, 'cur.' || event_id AS cursor, CAST(NULL AS VARCHAR) AS error FROM events WHERE event_id % 4 <> 0 UNION ALL SELECT event_id, NULL, NULL, 'cursor_unresolvable' FROM events WHERE event_id % 4 = 0")
def cursor_tokens(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    cluster, cursor = F.concat(F.lit("c"), (n % 3).cast("string")), F.concat(F.lit("cur."), n.cast("string"))
    token = cursors.wrap(cluster, cursor, cursors.hmac_tag(b"key")(cluster, cursor))
    sent = table(spark, d, "events").select("event_id", F.when(n % 4 == 0, F.concat(token, F.lit("x"))).otherwise(token).alias("token"))
    return cursors.verified(sent, b"key").select("event_id", "cluster", "cursor", "error")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (ORDER BY user_id, event_id) AS k FROM events) WHERE k BETWEEN 21 AND 30")
def scroll_keyset_page(spark: SparkSession, d: str) -> DataFrame:
    """Pages go on from the last row of the page before; the third page of ten."""
    own, after = table(spark, d, "events").select("user_id", "event_id"), None
    for _ in range(2):
        last = cursors.page(own, "user_id", 10, after, "event_id").agg(F.max(F.struct("user_id", "event_id")).alias("m")).first()["m"]
        after = (last["user_id"], last["event_id"])
    return cursors.page(own, "user_id", 10, after, "event_id")


@query("SELECT 'c' || user_id % 4 AS cluster, string_agg(event_id, ',' ORDER BY event_id) AS ids, count(*) AS n FROM events GROUP BY 1")
def pit_close_group(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "events").select(F.col("event_id").alias("pos"), F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("cluster"), F.col("event_id").cast("string").alias("cursor"))
    return cursors.pit_close(ids).withColumn("ids", F.array_join("ids", ","))


@query("""WITH l AS (SELECT CAST(user_id AS VARCHAR) AS cursor, arg_max('c' || event_id % 3, event_id) AS cluster, max(event_id) AS pinned FROM events GROUP BY 1)
SELECT cursor, cluster FROM l WHERE pinned > (SELECT max(event_id) FROM events) - 300 ORDER BY pinned DESC, cursor LIMIT 50""")
def cursor_affinity_evict(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    pins = e.select(F.col("user_id").cast("string").alias("cursor"), F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("cluster"), F.col("event_id").alias("pinned_at"))
    now = e.agg(F.max("event_id").alias("m")).first()["m"]
    return cursors.affinity(pins, F.lit(now), 300, 50).select("cursor", "cluster")


from tenmark.plans import lifecycle_registry, surfaces_registry  # noqa: E402, F401  add their queries
