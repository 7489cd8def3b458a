"""Queries of the request lifecycle, of what is sent and answered, and of single functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenmark.functions import scalars as S
from tenmark.operators import bulk, control, cursors, delivery, lifecycle, observe, routing
from tenmark.plans import search as Q
from tenmark.plans.catalog import query
from tenmark.plans.policy import Policy
from tenmark.plans.tables import TEMPLATE, bodies, documents, numbered, placement_log, requests, table
from tenmark.streaming import oplog

_long = lambda c: c.cast("long")


# --- the write path ---------------------------------------------------------------------------------------


def bulk_items(spark: SparkSession, d: str) -> DataFrame:
    """One item per line item, with everything that can go wrong in turn."""
    li = numbered(table(spark, d, "lineitem"))
    n, own = F.col("l_linenumber"), F.concat_ws("-", F.col("request_id").cast("string"), F.col("l_linenumber").cast("string"))
    part = F.col("l_partkey").cast("string")
    action = F.when(F.col("l_returnflag") == "A", "index").when(F.col("l_returnflag") == "N", "create").when(n % 2 == 0, "update").otherwise("delete")
    source = F.when(F.col("l_quantity") < 3, None).when(F.col("l_quantity") < 5, F.lit("[1]")).when(F.col("l_quantity") < 7, F.lit('{"_tenant":"x"}')).when(F.col("l_quantity") < 9, F.lit('{"p":1}'))
    source = source.otherwise(F.when(action == "update", F.concat(F.lit('{"doc":{"p":'), part, F.lit("}}"))).otherwise(F.concat(F.lit('{"id":'), part, F.lit("}"))))
    return li.select(
        "request_id", _long(F.col("ordinal")).alias("ordinal"), action.alias("action"),
        F.when(n % 5 == 0, "other").alias("index"), F.when(F.col("l_partkey") % 3 != 0, own).alias("id"),
        F.when(F.col("l_quantity") > 0, F.when((F.col("l_quantity") < 3) | (action != "delete"), source)).alias("source"),
        F.when(F.col("l_partkey") % 13 != 0, (F.col("l_suppkey") * 20).cast("string")).alias("partition"),
        _long(F.when(F.col("l_partkey") % 17 == 0, 99).otherwise(1 + F.col("l_suppkey") * 20 % 5)).alias("stamped_epoch"),
    )


_ITEMS = """WITH i0 AS (SELECT l_orderkey AS request_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) - 1 AS ordinal,
    CASE WHEN l_returnflag = 'A' THEN 'index' WHEN l_returnflag = 'N' THEN 'create' WHEN l_linenumber % 2 = 0 THEN 'update' ELSE 'delete' END AS action, CASE WHEN l_linenumber % 5 = 0 THEN 'other' ELSE 'orders' END AS logical_index,
    CASE WHEN l_partkey % 3 <> 0 THEN l_orderkey || '-' || l_linenumber END AS id, CASE WHEN l_partkey % 13 <> 0 THEN CAST(l_suppkey * 20 AS VARCHAR) END AS partition,
    l_quantity AS q, l_partkey AS pk, CASE WHEN l_partkey % 17 = 0 THEN 99 ELSE 1 + l_suppkey * 20 % 5 END AS stamped FROM lineitem),
  i AS (SELECT i0.*, p.kind, p.cluster, coalesce(p.kind = 'SharedIndex', false) AS shared, CASE p.kind WHEN 'DedicatedCluster' THEN logical_index ELSE p.idx END AS target_index,
    action IN ('index', 'create') AS doc, p.cluster IS NOT NULL AND p.phase <> 'cutover' AND p.epoch = stamped AS ok FROM i0 LEFT JOIN @placement p ON i0.partition = p.partition),
  e AS (SELECT *, CASE WHEN partition IS NULL THEN 'partition_unresolved' WHEN cluster IS NULL THEN 'placement_missing' WHEN action = 'delete' AND id IS NULL THEN 'delete_without_id' WHEN action = 'update' AND id IS NULL THEN 'update_without_id'
    WHEN action <> 'delete' AND q < 3 THEN 'missing_source' WHEN (shared AND doc OR action = 'update') AND q < 5 THEN 'invalid_json' WHEN shared AND doc AND q >= 5 AND q < 7 THEN 'reserved_field_collision'
    WHEN shared AND doc AND id IS NULL AND q >= 7 AND q < 9 THEN 'id_construction' WHEN NOT ok THEN 'stale_epoch' END AS error,
    CASE WHEN NOT shared THEN id WHEN id IS NOT NULL THEN partition || ':' || id WHEN doc AND q >= 9 THEN partition || ':' || pk END AS physical_id,
    CASE WHEN id IS NOT NULL THEN id WHEN shared AND doc AND q >= 9 THEN CAST(pk AS VARCHAR) WHEN doc AND NOT shared THEN '' END AS logical_id FROM i),
  s AS (SELECT *, CASE WHEN error IS NULL THEN CASE WHEN action = 'create' THEN 201 ELSE 200 END WHEN error = 'placement_missing' THEN 404 WHEN error = 'stale_epoch' THEN 409 ELSE 400 END AS status FROM e) """


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.prepared(bulk_items(spark, d), routing.current_placements(placement_log(spark, d)), "orders", TEMPLATE)


@query(_ITEMS + """SELECT request_id, ordinal, cluster, target_index, error, CASE WHEN error IS NULL THEN physical_id END AS physical_id, CASE WHEN error IS NULL THEN logical_id END AS logical_id,
  CASE WHEN error IS NULL AND shared AND physical_id IS NOT NULL THEN partition END AS routing, CASE WHEN error IS NULL AND shared AND doc THEN partition WHEN error IS NULL AND (NOT shared OR action = 'update') AND action <> 'delete' AND q >= 5 AND q < 7 THEN 'x' END AS tenant FROM s""")
def bulk_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """Every item resolved, placed, given its id and body, and gated."""
    good = F.col("error").isNull()
    rows = _prepared(spark, d)
    return rows.select("request_id", "ordinal", "cluster", "target_index", "error", F.when(good, F.col("physical_id")).alias("physical_id"), F.when(good, F.col("logical_id")).alias("logical_id"), "routing", F.get_json_object("body", "$._tenant").alias("tenant"))


@query(_ITEMS + """SELECT request_id, ordinal, action, physical_id, logical_id FROM s WHERE cluster IS NOT NULL AND q >= 9""")
def item_id_rules(spark: SparkSession, d: str) -> DataFrame:
    items = bulk_items(spark, d).filter("source IS NOT NULL OR action = 'delete'")
    li = lifecycle.prepared(items, routing.current_placements(placement_log(spark, d)), "orders", TEMPLATE)
    whole = table(spark, d, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    wanted = whole.select(F.col("l_orderkey").alias("request_id"), _long(F.row_number().over(order) - 1).alias("ordinal"), "l_quantity").filter("l_quantity >= 9").drop("l_quantity")
    return li.filter("cluster IS NOT NULL").join(wanted, ["request_id", "ordinal"]).select("request_id", "ordinal", "action", "physical_id", "logical_id")


_LINE = """'{"' || action || '":{"_index":"' || logical_index || '","_id":' || coalesce('"' || shown || '"', 'null') || CASE WHEN error IS NOT NULL THEN ',"status":' || status || ',"error":{"type":"' || error || '"}' ELSE ',"status":' || status || ',"result":"' || CASE action WHEN 'create' THEN 'created' WHEN 'delete' THEN 'deleted' ELSE 'updated' END || '"' END || '}}'"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    failed = F.col("error").isNotNull()
    result = F.when(F.col("action") == "create", "created").when(F.col("action") == "delete", "deleted").otherwise("updated")
    shown = F.when(failed, F.col("id")).otherwise(F.col("logical_id"))
    status = bulk.item_status(F.col("error"), result)
    return _prepared(spark, d).select("request_id", "ordinal", lifecycle.bulk_line(F.col("action"), F.col("logical_index"), shown, status, result, F.lit(None).cast("string"), F.col("error")).alias("line"), failed.alias("is_error"))


@query(_ITEMS + f", l AS (SELECT *, CASE WHEN error IS NOT NULL THEN id ELSE logical_id END AS shown FROM s) SELECT request_id, ordinal, {_LINE} AS line, error IS NOT NULL AS is_error FROM l")
def bulk_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d)


@query(_ITEMS + f""", l AS (SELECT *, CASE WHEN error IS NOT NULL THEN id ELSE logical_id END AS shown FROM s), j AS (SELECT request_id, ordinal, {_LINE} AS line, error IS NOT NULL AS bad FROM l)
SELECT request_id, bool_or(bad) AS errors, '{{"took":0,"errors":' || CASE WHEN bool_or(bad) THEN 'true' ELSE 'false' END || ',"items":[' || string_agg(line, ',' ORDER BY ordinal) || ']}}' AS body FROM j GROUP BY request_id""")
def bulk_response(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.bulk_response(_lines(spark, d))


@query(_ITEMS + "SELECT cluster, target_index, count(*) AS n, CAST(ceil(count(*) / 256) AS BIGINT) AS batches FROM s WHERE error IS NULL GROUP BY ALL")
def bulk_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Admitted operations by target, 256 a batch at most."""
    return _prepared(spark, d).filter("error IS NULL").groupBy("cluster", "target_index").agg(F.count("*").alias("n"), _long(F.ceil(F.count("*") / bulk.MAX_OPS)).alias("batches"))


@query("""WITH w AS (SELECT q.request_id, q.partition, p.kind, p.cluster, did, CASE p.kind WHEN 'DedicatedCluster' THEN q.logical_index ELSE p.idx END AS target_index, coalesce(p.kind = 'SharedIndex', false) AS shared,
  CASE WHEN q.partition IS NULL THEN 'partition_unresolved' WHEN p.cluster IS NULL THEN 'placement_missing' WHEN p.phase = 'cutover' THEN 'stale_epoch' END AS error FROM @req q LEFT JOIN @placement p ON q.partition = p.partition WHERE endpoint = 'IngestDoc')
SELECT request_id, CASE WHEN error IS NULL THEN 'PUT' END AS method, CASE WHEN error IS NULL THEN '/' || target_index || '/_doc/' || CASE WHEN shared THEN partition || ':' || did ELSE did END || CASE WHEN shared THEN '?routing=' || partition ELSE '' END END AS uri,
  CASE WHEN error IS NULL THEN did END AS answered, error FROM w""")
def single_write(spark: SparkSession, d: str) -> DataFrame:
    """One document each: resolved, placed, transformed, gated, sent, and answered under the client's id."""
    r = routing.resolved(routing.classified(requests(spark, d)), routing.any_of(F.col("body_tenant"), S.header(F.col("headers"), "x-tenant")))
    r = r.filter("endpoint = 'IngestDoc'")
    items = r.select("request_id", F.lit(0).alias("ordinal"), F.lit("index").alias("action"), F.col("logical_index").alias("index"), F.col("doc_id").alias("id"), F.col("body").alias("source"), "partition")
    current = routing.current_placements(placement_log(spark, d))
    stamped = items.join(current.select("partition", F.col("epoch").alias("stamped_epoch")), "partition", "left")
    w = lifecycle.prepared(stamped, current, "orders", TEMPLATE)
    good, shared = F.col("error").isNull(), F.col("kind") == "SharedIndex"
    sent = delivery.upstream_request(F.lit("index"), F.col("target_index"), F.col("physical_id"), F.col("routing"))
    back = lifecycle.logical_write_id(TEMPLATE, shared, F.col("partition"), F.col("physical_id"))
    return w.select("request_id", F.when(good, sent["method"]).alias("method"), F.when(good, sent["uri"]).alias("uri"), F.when(good, back).alias("answered"), "error")


@query("SELECT count(*) AS n, count(*) AS ids, min(20) AS least FROM lineitem")
def auto_ids(spark: SparkSession, d: str) -> DataFrame:
    """Rows without an id get one that no other row has."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.lit(None).cast("string").alias("physical_id"), F.lit(None).cast("string").alias("error"))
    made = lifecycle.auto_ids(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return made.agg(F.count("*").alias("n"), F.countDistinct("physical_id").alias("ids"), F.min(F.length("physical_id")).alias("least"))


# --- answers ----------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS key, CASE WHEN o_orderkey % 4 = 0 THEN '{"_index":"orders","_id":"' || o_orderkey || '","found":false}' ELSE '{"_index":"orders","_id":"' || o_orderkey || '","found":true,"_source":{"a":1}}' END AS body,
  '{"_index":"orders","_id":"' || o_orderkey || '","result":"' || CASE WHEN o_orderkey % 4 = 0 THEN 'not_found' ELSE 'deleted' END || '"}' AS deleted, '{"_index":"orders","_id":"' || o_orderkey || '","error":{"type":"upstream_failed"}}' AS failed FROM orders""")
def document_responses(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    index, ident, there = F.lit("orders"), k.cast("string"), k % 4 != 0
    source = F.when(there, F.concat(F.lit('{"_tenant":"'), F.col("o_custkey").cast("string"), F.lit('","a":1}')))
    return table(spark, d, "orders").select(
        k.alias("key"), lifecycle.document_response(index, ident, source, ["_tenant"]).alias("body"),
        lifecycle.delete_response(index, ident, F.when(there, 200).otherwise(404)).alias("deleted"), lifecycle.multi_get_error(index, ident, F.lit("upstream_failed")).alias("failed"),
    )


@query("""WITH m AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, _id) AS k, count(*) OVER () AS total FROM @docs WHERE o_custkey = 7 AND o_orderstatus <> 'P')
SELECT total, string_agg(o_orderkey, ',' ORDER BY k) FILTER (WHERE k <= 3) AS page FROM m GROUP BY total""")
def search_totals(spark: SparkSession, d: str) -> DataFrame:
    """The exact number of matches beside a page of them."""
    body = {"query": {"bool": {"must_not": {"term": {"o_orderstatus": "P"}}}}, "sort": [{"o_totalprice": "desc"}], "size": 3}
    out = Q.response(documents(spark, d), body, {"_tenant": "7"})
    return out.select("total", F.array_join(F.transform("hits", lambda h: F.get_json_object(h, "$.o_orderkey")), ",").alias("page"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"took":1}' ELSE '{"_scroll_id":"w.' || event_id || '","took":1}' END AS body, CASE event_id % 4 WHEN 0 THEN 'p' || event_id WHEN 1 THEN 'a' || event_id WHEN 2 THEN 'a,b' ELSE '' END AS ids FROM events""")
def scroll_bodies(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    text = n.cast("string")
    body = F.when(n % 3 == 0, F.lit('{"took":1}')).otherwise(F.concat(F.lit('{"took":1,"_scroll_id":"c'), text, F.lit('"}')))
    sent = F.when(n % 4 == 1, F.concat(F.lit('{"scroll_id":"a'), text, F.lit('"}'))).when(n % 4 == 2, F.lit('{"scroll_id":["a","b"]}')).otherwise(F.lit("{}"))
    return table(spark, d, "events").select("event_id", lifecycle.with_scroll_id(body, F.concat(F.lit("w."), text)).alias("body"), F.array_join(lifecycle.scroll_ids(sent, F.when(n % 4 == 0, F.concat(F.lit("p"), text))), ",").alias("ids"))


@query("SELECT user_id, CAST(max(200 + event_id % 2 * 204) AS INTEGER) AS status, bool_and(event_id % 2 = 0) AS succeeded, sum(event_id % 5) AS num_freed FROM (SELECT user_id, CAST(event_id AS BIGINT) AS event_id FROM events) GROUP BY 1")
def close_status(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "events").select("user_id", (200 + F.col("event_id") % 2 * 204).cast("int").alias("status"), (F.col("event_id") % 5).alias("freed"))
    return lifecycle.merged_status(calls, ["user_id"])


# --- who, and what serves them ----------------------------------------------------------------------------


@query("""WITH a AS (SELECT request_id, seq, endpoint, CASE WHEN seq % 3 = 0 THEN NULL WHEN seq % 3 = 1 THEN 'p' || user_id END AS principal, CASE WHEN seq % 3 = 0 THEN 'missing_credentials' WHEN seq % 3 = 2 THEN 'invalid_credentials' END AS auth_error, user_id FROM @req)
SELECT request_id, principal, auth_error, coalesce(user_id % 2 = 0 OR endpoint = 'Search', false) AND principal IS NOT NULL AS granted FROM a""")
def authentication(spark: SparkSession, d: str) -> DataFrame:
    r, n = routing.classified(requests(spark, d)), F.col("seq")
    users = table(spark, d, "events").select("user_id").distinct()
    name = F.concat(F.lit("p"), F.col("user_id").cast("string"))
    tokens = users.select(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("token"), name.alias("principal"))
    header = F.when(n % 3 == 1, F.concat(F.lit("bearer t"), F.col("user_id").cast("string"))).when(n % 3 == 2, F.lit("Bearer nobody"))
    known = lifecycle.authenticated(r, tokens, S.bearer_token(header))
    grants = users.select(name.alias("principal"), F.when(F.col("user_id") % 2 != 0, "Search").alias("endpoint"))
    return lifecycle.authorized(known, grants).select("request_id", "principal", "auth_error", "granted")


@query("SELECT request_id, CASE seq % 3 WHEN 0 THEN 'cn=' || seq WHEN 1 THEN 't' ELSE 'anonymous' END AS principal, CAST(NULL AS VARCHAR) AS auth_error FROM @req")
def development_mode(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("seq")
    known = lifecycle.authenticated(requests(spark, d), None, F.when(n % 3 != 2, "t"), F.when(n % 3 == 0, F.concat(F.lit("cn="), n.cast("string"))))
    return known.select("request_id", "principal", "auth_error")


@query("""SELECT request_id, CASE WHEN logical_index LIKE 'ord%' AND seq % 2 = 0 THEN 'passthrough' ELSE CASE endpoint WHEN 'Search' THEN 'search' WHEN 'IngestBulk' THEN 'ingest_bulk' WHEN 'Admin' THEN 'admin' WHEN 'IngestDoc' THEN 'ingest_doc' WHEN 'DeleteById' THEN 'delete_by_id' WHEN 'GetById' THEN 'get_by_id' END END AS branch FROM @req""")
def dispatch_branch(spark: SparkSession, d: str) -> DataFrame:
    r = routing.classified(requests(spark, d))
    e, i = F.col("endpoint"), F.col("logical_index")
    return r.select("request_id", F.when(F.col("seq") % 2 == 0, lifecycle.branch(e, i, ("ord",))).otherwise(lifecycle.branch(e, i)).alias("branch"))


@query("""SELECT request_id, partition, CASE WHEN seq % 3 = 0 THEN 'BodyField' WHEN seq % 4 <> 1 THEN 'BodyField,Header' ELSE 'BodyField,Header,PrincipalAttr' END AS kinds FROM (SELECT request_id, seq, CASE WHEN seq % 3 = 0 OR seq % 4 <> 1 THEN CAST(user_id AS VARCHAR) WHEN seq % 5 = 0 THEN 'attr' END AS partition FROM @req)""")
def partition_sources(spark: SparkSession, d: str) -> DataFrame:
    """The partition, and which kinds of source were looked at for it."""
    sources = {"BodyField": F.col("body_tenant"), "Header": S.header(F.col("headers"), "x-tenant"), "PrincipalAttr": F.when(F.col("seq") % 5 == 0, "attr")}
    found = lifecycle.tried(sources)
    return requests(spark, d).select("request_id", found["partition"].alias("partition"), F.array_join(found["kinds"], ",").alias("kinds"))


@query("""SELECT request_id, CASE WHEN seq % 2 = 0 THEN 'team' || user_id END AS team, CASE WHEN seq % 4 <> 1 THEN CAST(user_id AS VARCHAR) END AS via, '7' AS fixed, CASE WHEN seq % 2 <> 0 THEN 'principal_attr_missing' WHEN seq % 4 = 1 THEN 'header_missing' END AS error FROM @req""")
def principal_fields(spark: SparkSession, d: str) -> DataFrame:
    attributes = F.when(F.col("seq") % 2 == 0, F.create_map(F.lit("team"), F.concat(F.lit("team"), F.col("user_id").cast("string")))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    values, error = lifecycle.context_fields({"team": ("principal", "team"), "via": ("header", "X-TENANT"), "fixed": ("constant", "7")}, attributes, F.col("headers"))
    plain = lambda c: F.regexp_replace(c, '^"|"$', "")
    return requests(spark, d).select("request_id", plain(values["team"]).alias("team"), plain(values["via"]).alias("via"), values["fixed"].alias("fixed"), error.alias("error"))


@query("SELECT o_orderkey AS key, CAST(o_custkey AS VARCHAR) AS partition, CAST(o_custkey AS VARCHAR) || ':' || o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS tenant, 'eu' AS region, CAST(o_custkey AS VARCHAR) AS routing FROM orders")
def policy_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The reference tenancy from document to stored form."""
    policy = Policy(constants={"_region": '"eu"'})
    rows = bodies(spark, d).select("key", policy.write_partition(F.col("body"), F.array().cast("array<struct<name:string,value:string>>")).alias("partition"), F.col("body").alias("_source"))
    out = policy.ingest(rows)
    return out.select("key", "partition", F.col("_id").alias("id"), F.get_json_object("_source", "$._tenant").alias("tenant"), F.get_json_object("_source", "$._region").alias("region"), F.col("_routing").alias("routing"))


@query("""WITH t AS (SELECT *, logical_index LIKE 'ord%' AND endpoint <> 'Admin' AS through FROM @req), w AS (SELECT *, CASE WHEN endpoint IN ('IngestDoc', 'IngestBulk', 'DeleteById') AND seq % 3 = 0 OR seq % 4 <> 1 THEN CAST(user_id AS VARCHAR) END AS whose FROM t)
SELECT request_id, through, CASE WHEN NOT through AND endpoint <> 'Admin' THEN whose END AS owner, CASE WHEN through THEN NULL WHEN endpoint = 'Admin' THEN 'unsupported_endpoint' WHEN whose IS NULL THEN 'partition_unresolved' WHEN p.cluster IS NULL THEN 'placement_missing' END AS error
FROM w LEFT JOIN @placement p ON CASE WHEN NOT through AND endpoint <> 'Admin' THEN whose END = p.partition""")
def policy_route(spark: SparkSession, d: str) -> DataFrame:
    """A deployment's policy from request to target, tenants' indexes beside one that passes through."""
    body = F.when(F.col("body_tenant").isNotNull(), F.to_json(F.struct(F.col("body_tenant").alias("tenant_id")))).otherwise(F.lit("{}"))
    rows = requests(spark, d).withColumn("body", body)
    out = Policy().route(rows, routing.current_placements(placement_log(spark, d)), ("ord",))
    return out.select("request_id", (F.col("branch") == "passthrough").alias("through"), F.col("partition").alias("owner"), "error")


# --- traces, headers, delivery ----------------------------------------------------------------------------


@query("""WITH h AS (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS m, sha256('req-' || event_id) AS g FROM events)
SELECT event_id, CASE WHEN event_id % 3 = 2 THEN substr(g, 1, 32) WHEN event_id % 3 = 1 THEN repeat('0', 16) || substr(m, 17, 16) ELSE m END AS trace_id, substr(g, 33, 16) AS span_id, CASE WHEN event_id % 3 <> 2 THEN substr(m, 1, 16) END AS parent_span_id,
  CASE WHEN event_id % 3 = 0 THEN 'a=b' END AS tracestate, event_id % 3 <> 0 OR event_id % 2 = 1 AS sampled FROM h""")
def trace_propagation(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    m = F.md5(n.cast("string").cast("binary"))
    w3c = F.when(n % 3 == 0, F.concat_ws("-", F.lit("00"), m, F.substring(m, 1, 16), F.concat(F.lit("0"), (n % 2).cast("string"))))
    b3 = F.when(n % 3 == 1, F.concat_ws("-", F.substring(m, 17, 16), F.substring(m, 1, 16)))
    c = S.trace_context(w3c, b3, F.concat(F.lit("req-"), n.cast("string")), F.lit(" a=b "))
    return table(spark, d, "events").select("event_id", *(c[k].alias(k) for k in ("trace_id", "span_id", "parent_span_id", "tracestate", "sampled")))


@query("""SELECT request_id, CAST(CASE WHEN seq % 4 <> 1 THEN 2 ELSE 1 END + CASE WHEN seq % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n, CASE WHEN seq % 2 = 0 THEN '00-' || substr(sha256(request_id), 1, 32) || '-' || substr(sha256(request_id), 33, 16) || '-01' END AS traceparent FROM @req""")
def trace_headers_sent(spark: SparkSession, d: str) -> DataFrame:
    """The upstream sees the request's own context, only while traces are exported; unsendable headers are dropped."""
    none = F.lit(None).cast("string")
    c = S.trace_context(none, none, F.col("request_id"))
    odd = S.add_header(S.add_header(F.col("headers"), "bad name", F.lit("x")), "x-bad", F.lit("a\nb"))
    sent = S.with_trace_headers(S.applicable_headers(odd), c, F.col("seq") % 2 == 0)
    return requests(spark, d).select("request_id", _long(F.size(sent)).alias("n"), S.header(sent, "traceparent").alias("traceparent"))


@query("""SELECT request_id, CASE WHEN seq % 3 = 0 THEN md5(request_id) || '-' || substr(md5(request_id), 1, 16) || CASE seq % 2 WHEN 0 THEN '-1' ELSE '-0' END END AS folded FROM @req""")
def b3_multi_header(spark: SparkSession, d: str) -> DataFrame:
    n, m = F.col("seq"), F.md5(F.col("request_id").cast("binary"))
    h = F.array(*(F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in (("X-B3-TraceId", m), ("X-B3-SpanId", F.when(n % 3 == 0, F.substring(m, 1, 16))), ("X-B3-Sampled", F.when(n % 2 == 0, "1").otherwise("false")))))
    return requests(spark, d).select("request_id", S.b3_single(F.filter(h, lambda x: x["value"].isNotNull())).alias("folded"))


@query("""SELECT request_id, ordinal, CASE WHEN action = 'delete' THEN 'DELETE' WHEN ordinal % 3 = 0 THEN 'POST' ELSE 'PUT' END AS method,
  '/' || target || CASE WHEN ordinal % 3 = 0 AND action <> 'delete' THEN '/_doc' || CASE WHEN action = 'create' THEN '?op_type=create&routing=r%2F1' ELSE '?routing=r%2F1' END ELSE CASE WHEN action = 'create' THEN '/_create/' ELSE '/_doc/' END || key || '?routing=r%2F1' END AS uri FROM @ops""")
def upstream_requests(spark: SparkSession, d: str) -> DataFrame:
    from tenmark.plans.tables import operations

    ident = F.when((F.col("ordinal") % 3 != 0) | (F.col("action") == "delete"), F.col("key"))
    out = delivery.upstream_request(F.col("action"), F.col("target"), ident, F.lit("r/1"))
    return operations(spark, d).select("request_id", _long(F.col("ordinal")).alias("ordinal"), out["method"].alias("method"), out["uri"].alias("uri"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'own' ELSE 'u' || event_id END AS id, event_id % 2 = 0 AS created FROM events")
def upstream_results(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    body = F.when(n % 3 == 0, F.when(n % 2 == 0, '{"result":"created"}').otherwise("no json")).otherwise(F.concat(F.lit('{"_id":"u'), n.cast("string"), F.lit('","result":"'), F.when(n % 2 == 0, "created").otherwise("updated"), F.lit('"}')))
    out = delivery.upstream_result(body, F.lit("own"))
    return table(spark, d, "events").select("event_id", out["id"].alias("id"), out["created"].alias("created"))


@query("""SELECT request_id || ':' || ordinal AS op_id, CASE WHEN action = 'create' THEN 'unsupported_async' END AS error, CASE WHEN action = 'create' THEN 400 WHEN ordinal % 2 = 0 THEN 422 WHEN ordinal % 3 = 0 THEN 503 ELSE 202 END AS status FROM @ops""")
def queued_items(spark: SparkSession, d: str) -> DataFrame:
    """Asynchronous items: their ids, what cannot be queued, and the answer."""
    from tenmark.plans.tables import operations

    n = F.col("ordinal")
    items = operations(spark, d).select(F.col("request_id").cast("string").alias("batch_id"), "ordinal", F.lit("index").alias("action"), (F.col("action") == "create").alias("cas"))
    out = delivery.bulk_op_ids(items)
    return out.select("op_id", "error", delivery.queued_answer(F.col("error").isNotNull(), n % 2 != 0, n % 3 != 0).alias("status"))


@query("""SELECT 'op-' || o_orderkey AS op_id, CAST(o_custkey AS VARCHAR) AS partition, CASE WHEN o_orderkey % 2 = 0 THEN 'delete' ELSE 'index' END AS op_type, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'application/json' END AS content_type, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '{}' END AS body, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 2 END AS INTEGER) AS body_bytes FROM orders""")
def log_envelopes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    ops = table(spark, d, "orders").select(F.concat(F.lit("op-"), k.cast("string")).alias("op_id"), F.col("o_custkey").cast("string").alias("partition"), F.lit("c").alias("cluster"), F.lit("i").alias("index"), F.lit(1).alias("epoch"), F.when(k % 2 == 0, "delete").otherwise("index").alias("action"), none.alias("id"), none.alias("routing"), F.lit("{}").alias("source"), F.current_timestamp().alias("ts"))
    return delivery.envelopes(ops).select("op_id", "partition", "op_type", "content_type", "body", S.body_bytes(F.col("body")).alias("body_bytes"))


@query("SELECT request_id, CAST(CASE WHEN seq % 4 <> 1 THEN 1 ELSE 0 END AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS authorization FROM @req")
def captured_headers(spark: SparkSession, d: str) -> DataFrame:
    return oplog.captured(requests(spark, d)).select("request_id", _long(F.size("headers")).alias("n"), S.header(F.col("headers"), "authorization").alias("authorization"))


@query("SELECT request_id, 'new' AS tenant, CAST(NULL AS VARCHAR) AS token, CAST(1 AS BIGINT) AS n FROM @req")
def header_operations(spark: SparkSession, d: str) -> DataFrame:
    h = S.replace_header(S.remove_header(F.col("headers"), "AUTHORIZATION"), "x-tenant", F.lit("new"))
    return requests(spark, d).select("request_id", S.header(h, "X-Tenant").alias("tenant"), S.header(h, "authorization").alias("token"), _long(F.size(h)).alias("n"))


@query("SELECT event_id, event_id % 4 <> 3 AS number, CASE event_id % 3 WHEN 0 THEN event_id END AS length FROM events")
def number_texts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    text = F.element_at(F.array(*map(F.lit, ("-0.5e+3", "10", "0", "01"))), (n % 4 + 1).cast("int"))
    size = F.when(n % 3 == 0, n.cast("string")).when(n % 3 == 1, F.lit("+1")).otherwise(F.lit("1x"))
    return table(spark, d, "events").select("event_id", S.is_json_number(text).alias("number"), S.content_length(size).alias("length"))


@query("SELECT event_id, 'req-' || row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS request_id FROM events")
def request_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Numbers by listener, as each counts for itself."""
    rows = table(spark, d, "events").select("event_id", F.col("user_id").alias("listener"), F.col("event_id").alias("seq"))
    return observe.numbered(rows, "listener").select("event_id", "request_id")


@query("SELECT key, n_keys, has_id, valid, ok_object FROM (SELECT o_orderkey AS key, CAST(5 AS BIGINT) AS n_keys, true AS has_id, o_orderkey % 2 = 0 AS valid, true AS ok_object FROM orders)")
def json_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Top-level keys, and whether a text is a JSON object at all."""
    b = F.col("body")
    cut = F.when(F.col("key") % 2 == 0, b).otherwise(F.substring(b, F.lit(1), F.length(b) - 1))
    return bodies(spark, d).select("key", _long(F.size(F.json_object_keys(b))).alias("n_keys"), S.has_key(b, "id").alias("has_id"), F.try_parse_json(cut).isNotNull().alias("valid"), S.is_json_object(b).alias("ok_object"))


@query(r"SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'x' || chr(10) WHEN 1 THEN chr(128512) WHEN 3 THEN '\ud83d' END AS a FROM events")
def json_escapes(spark: SparkSession, d: str) -> DataFrame:
    """Escapes in keys and strings: pairs are one character, half a pair is refused, an escaped backslash begins none."""
    forms = (r'{"\u0061":"x\n"}', r'{"a":"\ud83d\ude00"}', r'{"a":"\ud83d"}', r'{"a":"\\ud83d"}')
    body = F.element_at(F.array(*map(F.lit, forms)), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", S.json_text(body, "a").alias("a"))


@query("SELECT o_orderkey AS key, 'a-' || o_custkey || '-' AS before, '-z' AS after, true AS back FROM orders")
def template_frames(spark: SparkSession, d: str) -> DataFrame:
    """What a reversible template puts around the one value of the document."""
    before, after = S.id_frame("a-{partition}-{body.id}-z", F.col("partition"))
    own = S.to_physical("a-{partition}-{body.id}-z", F.col("partition"), F.col("key").cast("string"))
    return bodies(spark, d).select("key", before.alias("before"), after.alias("after"), (S.to_logical("a-{partition}-{body.id}-z", F.col("partition"), own) == F.col("key").cast("string")).alias("back"))


@query("SELECT request_id FROM @req WHERE seq % 4 <> 0")
def exported_traces(spark: SparkSession, d: str) -> DataFrame:
    level = F.element_at(F.array(*map(F.lit, observe.LEVELS)), (F.col("seq") % 4 + 1).cast("int"))
    return observe.exported(requests(spark, d).withColumn("level", level), True).select("request_id")


@query("SELECT request_id, substr(sha256(request_id), 1, 32) AS trace, CAST(NULL AS VARCHAR) AS parent, CAST(1 AS BIGINT) AS n, '/v' AS path FROM @req")
def otlp_spans(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    c = S.trace_context(none, none, F.col("request_id"))
    attributes = observe.allowed_attributes(F.create_map(F.lit("path"), F.lit("/v"), F.lit("tenant"), F.lit("secret")), ("path",))
    span = observe.otlp_span(c, c["parent_span_id"], F.lit("request"), F.lit(1), F.lit(2), {"path": F.try_element_at(attributes, F.lit("path")), "tenant": F.try_element_at(attributes, F.lit("tenant"))})
    held = requests(spark, d).select("request_id", span.alias("s"))
    at = lambda p: F.get_json_object("s", p)
    return held.select("request_id", at("$.traceId").alias("trace"), at("$.parentSpanId").alias("parent"), _long(F.size(F.from_json("s", "attributes array<struct<key:string>>")["attributes"])).alias("n"), at("$.attributes[0].value.stringValue").alias("path"))


@query("SELECT request_id, min(event_id) AS seq FROM (SELECT event_id, 'u' || user_id AS request_id FROM events ORDER BY event_id DESC LIMIT 256) GROUP BY 1")
def break_glass_ring(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("request_id"), F.col("event_id").alias("seq"))
    return observe.ring_lookup(rows, keep=256)


@query("SELECT user_id, CAST(sum(CASE WHEN event_id % 3 <> 0 AND event_id % 2 = 0 THEN 60 ELSE 0 END) AS BIGINT) AS held, count(*) FILTER (WHERE event_id % 3 = 0) AS too_large FROM events GROUP BY 1")
def admission_without_ceiling(spark: SparkSession, d: str) -> DataFrame:
    """The admission fold where nothing is released and the ceiling is never met: sums and oversized bodies."""
    n = F.col("event_id")
    log = table(spark, d, "events").select(F.col("user_id").cast("string").alias("listener"), n.alias("seq"), F.lit("reserve").alias("kind"), n.cast("string").alias("ref"), F.when(n % 3 == 0, 1000).when(n % 2 == 0, 60).otherwise(0).cast("long").alias("bytes"))
    out = control.admission(log, 1 << 40, 100)
    both = log.join(out.select("listener", "seq", "error"), ["listener", "seq"])
    return both.groupBy(F.col("listener").cast("long").alias("user_id")).agg(F.sum(F.when(F.col("error").isNull(), F.col("bytes")).otherwise(0)).alias("held"), F.count_if(F.col("error") == "payload_too_large").alias("too_large"))


@query("SELECT 'c' || event_id % 3 AS cluster, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1")
def scroll_by_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Wrapped ids of scroll requests, unwrapped and counted by the cluster that each is bound to."""
    n = F.col("event_id")
    cluster = F.concat(F.lit("c"), (n % 3).cast("string"))
    token = cursors.wrap(cluster, n.cast("string"), cursors.hmac_tag(b"key")(cluster, n.cast("string")))
    sent = table(spark, d, "events").select(F.explode(lifecycle.scroll_ids(F.concat(F.lit('{"scroll_id":'), S.json_string(F.when(n % 2 == 0, token).otherwise("forged")), F.lit("}")), F.lit(None).cast("string"))).alias("token"))
    return cursors.verified(sent, b"key").filter("error IS NULL").groupBy("cluster").agg(F.count("*").alias("n"))
