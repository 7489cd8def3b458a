import json
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tenmark.functions import scalars as S
from tenmark.operators import bulk, control, cursors, lifecycle, observe, rewrite, routing, writes
from tenmark.plans import registry
from tenmark.plans import search as Q
from tenmark.plans.tables import TEMPLATE, documents
from tenmark.sources import ndjson

from . import plain_bulk

DOCS = [{}, {"a": 1}, {"a": {"b": [1, {"c": "}"}]}, "é": "x\"\\"}, {"t": True, "n": None, "s": "{", "f": 1.5}, {"_tenant": "evil"}]


def frame(spark, docs):
    return spark.createDataFrame([(k, json.dumps(d, ensure_ascii=False)) for k, d in enumerate(docs)], "k int, body string")


def test_inject_then_strip_is_the_document(spark):
    fields = {"_tenant": S.json_string(F.lit('a"c\\me')), "_n": F.lit("3")}
    df = frame(spark, DOCS).select("k", "body", rewrite.inject(F.col("body"), fields).alias("i"), rewrite.inject_error(F.col("body"), fields).alias("e"))
    for r in df.select("*", rewrite.strip(F.col("i"), ["_tenant", "_n"]).alias("s")).collect():
        doc = DOCS[r.k]
        if "_tenant" in doc:
            assert r.i is None and r.e == "reserved_field_collision"
        else:
            assert json.loads(r.i) == {"_tenant": 'a"c\\me', "_n": 3, **doc} and json.loads(r.s) == doc and r.e is None


def test_no_object_is_an_error(spark):
    df = spark.createDataFrame([("[1]",), ("x",), (None,), ("",)], "body string")
    assert {r.e for r in df.select(rewrite.inject_error(F.col("body"), {"a": F.lit("1")}).alias("e")).collect()} <= {"invalid_json", None}
    assert all(r.i is None for r in df.select(rewrite.inject(F.col("body"), {"a": F.lit("1")}).alias("i")).collect())


def test_ids_invert_inside_their_frame_only(spark):
    df = spark.createDataFrame([("p", "1"), ("p:q", "x:y"), ("", "z")], "p string, i string")
    t = "a{partition}:{body.id}!"
    held = df.withColumn("id", S.to_physical(t, F.col("p"), F.col("i")))
    assert all(r.i == r.b for r in held.select("i", S.to_logical(t, F.col("p"), F.col("id")).alias("b")).collect())
    assert held.select(S.to_logical(t, F.lit("other"), F.col("id")).alias("b")).filter("b IS NOT NULL").count() == 0
    for bad in ("{body.a}{body.b}", "{partition}"):
        with pytest.raises(ValueError):
            S.id_frame(bad, F.lit("p"))
    with pytest.raises(ValueError):
        S.template_parts("{what}")


def test_fnv_is_fnv(spark):
    def fnv(b):
        h = S.FNV_OFFSET
        for x in b:
            h = ((h ^ x) * S.FNV_PRIME) % 2**64
        return h

    words = ["", "a", "req-42", "é", "x" * 50]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", S.fnv1a(F.col("w")).alias("h")).collect()
    assert all(int(r.h) == fnv(r.w.encode()) for r in got)


PATHS = [
    ("GET", "/o/_doc/1", "GetById", "o", "1"), ("HEAD", "/o/_doc/1", "GetById", "o", "1"), ("DELETE", "/o/_create/1", "DeleteById", "o", "1"), ("PUT", "/o/_create/1", "IngestDoc", "o", "1"),
    ("POST", "/o/_doc", "IngestDoc", "o", None), ("GET", "/o/_doc", "Unknown", "o", None), ("POST", "/_search/scroll", "Cursor", "", None), ("POST", "/_search/scroll/abc", "Cursor", "", "abc"),
    ("DELETE", "/_search/point_in_time", "Cursor", "", None), ("POST", "/o/_search/point_in_time", "Cursor", "o", None), ("POST", "/_search", "Search", "", None), ("POST", "//o//_search/", "Search", "o", None),
    ("POST", "/o/_count", "Count", "o", None), ("POST", "/_count", "Unknown", "_count", None), ("POST", "/_mget", "MultiGet", "", None), ("POST", "/o/_msearch", "MultiSearch", "o", None), ("POST", "/_bulk", "IngestBulk", "", None),
    ("POST", "/o/_delete_by_query", "DeleteByQuery", "o", None), ("GET", "/_cat/indices/a/b/c", "Admin", "", None), ("POST", "/o/_update/1", "Unknown", "o", None), ("GET", "/", "Unknown", "", None), ("GET", "/a/b/c/d", "Unknown", "a", None),
]


def test_classification(spark):
    got = routing.classified(spark.createDataFrame([p[:2] for p in PATHS], "method string, path string")).collect()
    assert [(r.method, r.path, r.endpoint, r.logical_index, r.doc_id) for r in got] == PATHS


def test_isolation_holds_for_any_query(spark):
    base = spark.createDataFrame([(f"{t}:{k}", t, k) for t in "ab" for k in range(3)], "_id string, _tenant string, n int")
    bodies = [{"query": {"bool": {"should": [{"match_all": {}}, {"term": {"_tenant": "b"}}]}}}, {"query": {"term": {"_tenant": "b"}}}, {"query": {"bool": {"must_not": [{"term": {"_tenant": "a"}}]}}}, {}, {"query": {"terms": {"n": [0, 1]}}}, {"query": {"ids": {"values": ["b:1"]}}}]
    for b in bodies:
        assert all(r._tenant == "a" for r in Q.search(base, b, {"_tenant": "a"}).collect())
    with pytest.raises(Q.Rejected):
        Q.search(base, {}, {})
    for bad in ({"suggest": {}}, {"aggs": {"x": {"terms": {"field": "n"}, "aggs": {"g": {"global": {}}}}}}):
        with pytest.raises(Q.Rejected):
            Q.search(base, bad, {"_tenant": "a"})
        Q.check(bad, False)
    for bad in ({"query": {"script": {}}}, {"sort": "_score"}, {"query": {"a": 1, "b": 2}}):
        with pytest.raises(Q.Rejected):
            Q.search(base, bad, None)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(ndjson.VERBS), st.integers(0, 9), st.dictionaries(st.text("abc{}\"", max_size=3), st.integers(), max_size=2)), max_size=8), st.sampled_from(["\n", "\r\n", "\n\n"]))
def test_bulk_bodies_keep_their_order(items, end):
    body = ""
    for verb, k, doc in items:
        body += json.dumps({verb: {"_id": str(k), "_index": k, "_routing": "r"}}) + end
        if verb != "delete":
            body += json.dumps(doc) + end
    got = plain_bulk.bulk_items(body)
    # an index that is no text is none, and so is a routing by its old name
    assert [(g[0], g[1], g[2], g[3], g[4]) for g in got] == [(n, v, None, str(k), None) for n, (v, k, _) in enumerate(items)]
    assert [None if g[6] is None else json.loads(g[6]) for g in got] == [None if v == "delete" else d for v, _, d in items]


def test_bulk_bodies_equal_a_plain_reader(spark):
    rng = random.Random(8)
    metas = [{"_id": "1"}, {"_id": 5, "_index": "i"}, {"_index": ["x"], "routing": "r"}, {"routing": None, "version": None}, {"if_seq_no": 3, "_id": ""}, {}, [1], "text", None, {"_routing": "r", "_id": "é\"\\"}]
    docs = [{"a": 1}, {"index": {}}, {"delete": {"_id": "1"}}, {}, {"s": "x\ty"}]
    bad = ["[]", "{", '{"index":{},"delete":{}}', '{"what":{}}', "7", '"index"']
    bodies = []
    for k in range(300):
        body = ""
        for _ in range(rng.randrange(0, 9)):
            verb = rng.choice(ndjson.VERBS)
            body += json.dumps({verb: rng.choice(metas)}) + rng.choice(["\n", "\r\n", "\n\n", "\n  \n"])
            if verb != "delete":
                body += json.dumps(rng.choice(docs)) + "\n"
            if rng.random() < 0.03:
                body += rng.choice(bad) + "\n"
        bodies.append((str(k), body[: len(body) - rng.randrange(0, 3)] if rng.random() < 0.2 else body))
    want = []
    for rid, body in bodies:
        try:
            want += [(rid, *item, None) for item in plain_bulk.bulk_items(body)]
        except ValueError:
            want.append((rid, None, None, None, None, None, None, None, "invalid_json"))
    got = [tuple(r) for r in ndjson.parse_bulk(spark.createDataFrame(bodies, "request_id string, body string")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(w[-1] for w in want) and sum(w[-1] is None for w in want) > 300


def test_bulk_lines_are_worked_out_once(spark):
    plan = ndjson.parse_bulk(spark.createDataFrame([("1", "")], "request_id string, body string"))._jdf.queryExecution().optimizedPlan().toString()
    # a body is split once, and neither its lines nor their roles are made anew for each line
    assert plan.count("coalesce(body#") == 1 and plan.count("regexp_replace(") == 1 and plan.count("json_object_keys(") + plan.count("jsonObjectKeys(") <= 2


def test_bulk_action_lines_of_any_form(spark):
    texts = ["", "1", "é😀\x7f\u2028", "a,b}", "{", "x" * 512, "x" * 513, 'q"', "b\\", "t\t", "n\n"]
    metas = [json.dumps({k: t for k in keys}, ensure_ascii=raw) for keys in (["_id"], ["_index", "_id"], ["_index", "_id", "routing"], ["_index", "routing"], ["routing", "_id"], ["_id", "version"], []) for t in texts for raw in (True, False)]
    metas += ['{ "_index" : "i" ,\t"_id" : "1" }', '{"_id":"1",}', '{,"_id":"1"}', '{"_index":"i""_id":"1"}', '{"_index":"i",,"_id":"1"}', '{"_id":"1" "2"}', '{"_id":"a\\u0041"}', '{"_id":1}', '{"_id":null}', '{"_id":{}}', "{", '{"_id":"1"', '{\x0b"_id":"1"}']
    bodies = [(f"{k}{verb}", f' {{ "{verb}" :{meta}}} \n' + ("" if verb == "delete" else '{"index":{}}')) for k, meta in enumerate(metas) for verb in ("index", "delete")]
    want = []
    for rid, body in bodies:
        try:
            want += [(rid, *item, None) for item in plain_bulk.bulk_items(body)]
        except ValueError:
            want.append((rid, None, None, None, None, None, None, None, "invalid_json"))
    got = [tuple(r) for r in ndjson.parse_bulk(spark.createDataFrame(bodies, "request_id string, body string")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(w[-1] is not None for w in want) == 16


def test_malformed_bulk_fails_whole(spark):
    bad = ['{"index":{}}\n', '{"index":{},"delete":{}}\n{}\n', '{"what":{}}\n{}', "no", '{"index":{}}\n[1]\n', '{"delete":{"_id":"1"}}\n{"index":{}}']
    got = ndjson.parse_bulk(spark.createDataFrame([(str(k), b) for k, b in enumerate([*bad, None, ""])], "request_id string, body string")).collect()
    assert sorted((r.request_id, r.error) for r in got) == [(str(k), "invalid_json") for k in range(len(bad))]


def _shuffled(spark, run):
    """What ``run`` gives while joins shuffle into 8 partitions."""
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        return run()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_requests_without_a_partition_are_spread(spark):
    rows = spark.range(8000).select(F.concat(F.lit("req-"), "id").alias("request_id"), F.when(F.col("id") % 10 == 0, (F.col("id") % 50).cast("string")).alias("partition"), F.lit("i").alias("logical_index"), F.lit(None).cast("string").alias("error"))
    # placements by the very names that rows without a partition are dealt by are not theirs
    slots = [r[0] for r in rows.filter("partition IS NULL").limit(20).select(F.pmod(F.xxhash64("request_id"), F.lit(routing.SLOTS)).cast("string")).collect()]
    placements = spark.createDataFrame([(k, "DedicatedIndex", "c", f"i{k}", 1, "active") for k in {"0", "10", "20", *slots}], "partition string, kind string, cluster string, index string, epoch long, phase string")
    for requests in (rows, rows.withColumnRenamed("request_id", "path")):
        got = _shuffled(spark, lambda r=requests: routing.placed(r, placements).withColumn("task", F.spark_partition_id()).collect())
        assert len(got) == 8000 and all((r.cluster == "c" and r.target_index == f"i{r.partition}") if r.partition in ("0", "10", "20") else (r.cluster is None and r.error == "placement_missing") for r in got)
        tasks = defaultdict(int)
        for r in got:
            tasks[r.task] += r.partition is None
        assert len(tasks) == 8 and max(tasks.values()) < 7200 / 4


def test_bulk_items_without_a_partition_are_spread(spark):
    items = spark.range(4000).select(F.col("id").alias("request_id"), F.lit(0).alias("ordinal"), F.lit("index").alias("action"), F.lit(None).cast("string").alias("index"), F.lit("1").alias("id"), F.lit("{}").alias("source"), F.when(F.col("id") < 0, "t").alias("partition"), F.lit(1).alias("stamped_epoch"))
    placements = spark.createDataFrame([("t", "DedicatedIndex", "c", "i", 1, "active")], "partition string, kind string, cluster string, index string, epoch long, phase string")
    got = _shuffled(spark, lambda: lifecycle.prepared(items, placements, "orders", TEMPLATE).groupBy(F.spark_partition_id().alias("task"), "error").count().collect())
    assert {r.error for r in got} == {"partition_unresolved"} and sum(r["count"] for r in got) == 4000
    assert len(got) == 8 and max(r["count"] for r in got) < 1000


def test_requests_are_not_sorted_for_their_placements(spark):
    requests = spark.range(3000).select(F.col("id").alias("request_id"), F.when(F.col("id") % 7 != 0, (F.col("id") % 90).cast("string")).alias("partition"), F.lit("i").alias("logical_index"), F.lit(None).cast("string").alias("error"))
    number = F.col("id").cast("string")
    placements = spark.range(60).select(number.alias("partition"), F.when(F.col("id") % 2 == 0, "DedicatedIndex").otherwise("DedicatedCluster").alias("kind"), F.lit("c").alias("cluster"), F.concat(F.lit("x"), number).alias("index"), F.lit(1).alias("epoch"), F.lit("active").alias("phase"))

    def run():
        found = routing.placed(requests, placements)
        return found._jdf.queryExecution().executedPlan().toString(), {r.request_id: (r.partition, r.target_index, r.error) for r in found.collect()}

    plan, got = _shuffled(spark, run)
    assert "ShuffledHashJoin" in plan and "Sort" not in plan
    assert len(got) == 3000
    for k, (p, target, error) in got.items():
        there = k % 7 != 0 and k % 90 < 60
        assert p == (str(k % 90) if k % 7 else None)
        assert (target, error) == ((f"x{p}" if k % 90 % 2 == 0 else "i", None) if there else (None, "placement_missing"))
    # a table that Spark may broadcast still is
    plan, again = run()
    assert "BroadcastHashJoin" in plan and again == got


def test_items_travel_to_their_placements_as_they_are(spark, sf_dir):
    def found(plan, kind):
        return [plan] if plan.nodeName() == kind else [x for k in range(plan.children().size()) for x in found(plan.children().apply(k), kind)]

    plan = _shuffled(spark, lambda: registry.QUERIES["bulk_lines"](spark, sf_dir)._jdf.queryExecution().executedPlan())
    assert not found(plan, "SortMergeJoin")
    sent = [x for j in found(plan, "ShuffledHashJoin") for x in found(j.left(), "Exchange")][0].output()
    assert sorted(sent.apply(k).name() for k in range(sent.size())) == sorted(["request_id", "ordinal", "action", "index", "id", "source", "partition", "stamped_epoch"])


@pytest.mark.parametrize("name", ["bulk_response", "bulk_lines"])
def test_answers_are_compiled(spark, sf_dir, name):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        made = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().debug().codegenToSeq()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    # the JVM interprets methods of more bytes, at several times the cost
    assert max(made.apply(k)._3().maxMethodCodeSize() for k in range(made.size())) < 8000


def test_bulk_lines_of_any_text(spark):
    texts = [None, "", "a b~", 'q"', "b\\", "é😀", "\x7f", "t\tn\n", "\u2028"]
    rows = [(n, i, k, o, e) for n, (i, k, o, e) in enumerate((i, k, o, e) for i in texts[1:] for k in texts for o in (None, "op", 'o"') for e in (None, "stale_epoch", 'e"', "what"))]
    df = spark.createDataFrame(rows, "n int, i string, k string, o string, e string")
    line = lifecycle.bulk_line(F.lit("create"), F.col("i"), F.col("k"), bulk.item_status(F.col("e"), F.lit("created")), F.lit("created"), F.col("o"), F.col("e"))
    for r in df.select("*", line.alias("line")).collect():
        status = 201 if r.e is None else {"stale_epoch": 409}.get(r.e, 500)
        rest = {"status": status, "error": {"type": r.e}} if r.e is not None else {"status": status, "result": "created"} if r.o is None else {"op_id": r.o, "status": status, "result": "queued"}
        want = {"create": {"_index": r.i, "_id": r.k, **rest}}
        assert json.loads(r.line) == want and list(json.loads(r.line)["create"]) == list(want["create"]), r


def test_writes_fold_like_a_dictionary(spark):
    rng = random.Random(4)
    state = {k: {"v": k} for k in "abc"}
    steps = [(rng.choice("abcdef"), n, rng.choice(["index", "create", "delete", "update"])) for n in range(60)]
    source = lambda a, n: None if a == "delete" else json.dumps({"doc": {"u": n}, **({"upsert": {"w": n}} if n % 2 else {})} if a == "update" else {"v": n})
    want, results = {k: dict(v) for k, v in state.items()}, {}
    for k, n, a in steps:
        if a == "create" and k in want:
            results[n] = "conflict"
        elif a in ("index", "create"):
            results[n], want[k] = "updated" if k in want else "created", {"v": n}
        elif a == "delete":
            results[n] = "deleted" if want.pop(k, None) is not None else "not_found"
        elif k in want:
            want[k] |= {"u": n}
            results[n] = "updated"
        else:
            results[n] = "created" if n % 2 else "not_found"
            if n % 2:
                want[k] = {"w": n}
    s = spark.createDataFrame([(k, json.dumps(v)) for k, v in state.items()], "key string, source string")
    o = spark.createDataFrame([(k, n, a, source(a, n)) for k, n, a in steps], "key string, ordinal int, action string, source string")
    applied = writes.apply_ops(s, o)
    assert {r.ordinal: r.result for r in applied.collect() if r.ordinal is not None} == results
    assert {r.key: json.loads(r.source) for r in writes.next_state(s, applied).collect()} == want


def test_flush_batches_equal_a_loop(spark):
    rng = random.Random(2)
    ops = [(t, n, rng.randrange(50)) for n, t in enumerate(rng.choices("xy", k=80))]
    got = {(r.target, r.ordinal): r.batch for r in bulk.flush_batches(spark.createDataFrame(ops, "target string, ordinal long, bytes int"), ["target"], 5, 90).collect()}
    for t in "xy":
        batch = n = size = 0
        for _, k, b in [o for o in ops if o[0] == t]:
            assert got[t, k] == batch
            n, size = n + 1, size + b
            if n >= 5 or size >= 90:
                batch, n, size = batch + 1, 0, 0


def test_migration_invariants(spark):
    rng = random.Random(9)
    log = [(p, n, rng.choice(["begin", "cutover", "complete", "abort"]) if n else "set", f"{p}{n % 3}", n * rng.choice([1, 20])) for p in "pqr" for n in range(60)]
    got = defaultdict(list)
    for r in control.migration_states(spark.createDataFrame(log, "partition string, seq long, op string, placement string, ts long")).collect():
        got[r.partition].append(r)
    for rows in got.values():
        rows.sort(key=lambda r: r.seq)
        for a, b in zip(rows, rows[1:], strict=False):
            assert b.epoch == a.epoch + (b.error is None)
            assert (b.write is None) == (b.phase == "cutover")
            assert b.read == a.read or (a.phase, b.phase) == ("cutover", "active")
            assert b.error is None or (b.phase, b.read) == (a.phase, a.read)
    assert control.migrate([("set", "a", 0), ("begin", "b", 1), ("cutover", None, 2), ("complete", None, 31), ("complete", None, 32)])[3:] == [("cutover", "a", "a", None, "barrier_pending"), ("active", "b", "b", "b", None)]
    assert [x[4] for x in control.migrate([("begin", "b", 0), ("set", "a", 0), ("cutover", None, 0), ("begin", "b", 0), ("begin", "c", 0), ("complete", None, 0), ("abort", None, 0), ("abort", None, 0)])] == ["unknown_partition", None, "not_migrating", None, "already_migrating", "not_cutover", None, "not_migrating"]


def test_breaker_and_admission(spark):
    calls = [("c", n, ts, ok) for n, (ts, ok) in enumerate([(0, False)] * 5 + [(3, True), (5, False), (9, True), (10, True), (11, False)])]
    got = sorted(control.breaker_states(spark.createDataFrame(calls, "cluster string, seq long, ts long, ok boolean")).collect(), key=lambda r: r.seq)
    assert [r.allowed for r in got] == [True] * 5 + [False, True, False, True, True]
    assert [r.failures for r in got] == [1, 2, 3, 4, 5, 5, 6, 6, 0, 1]
    events = [("l", 0, "reserve", "a", 60), ("l", 1, "reserve", "b", 50), ("l", 2, "release", "a", 0), ("l", 3, "reserve", "b", 50), ("l", 4, "reserve", "c", 90), ("l", 5, "release", "zz", 0)]
    got = sorted(control.admission(spark.createDataFrame(events, "listener string, seq long, kind string, ref string, bytes long"), 100, 80).collect(), key=lambda r: r.seq)
    assert [r.error for r in got] == [None, "overloaded", None, None, "payload_too_large", None]


def test_directives_fail_closed(spark):
    good = {"id": "a", "level": "ShapeTiming", "ttl_secs": 1}
    sent = lambda *ones, **more: json.dumps({"directives": list(ones), **more})
    assert observe.decode_directives(spark, sent(good), 0.0).count() == 1
    assert observe.decode_directives(spark, sent(), 0.0).count() == 0
    for change in ({"x": 1}, {"level": "loud"}, {"sample_per_mille": 1001}, {"sample_per_mille": True}, {"ttl_secs": 0}, {"ttl_secs": "1"}, {"ring_buffer": 1}, {"tenant": 3}, {"endpoint": "Serch"}):
        with pytest.raises(ValueError):
            observe.decode_directives(spark, sent({**good, **change}), 0.0)
    for whole in ("{}", json.dumps([good]), sent(good, more=1)):
        with pytest.raises(ValueError):
            observe.decode_directives(spark, whole, 0.0)


def test_signed_headers_and_cursors(spark):
    import hashlib
    import hmac

    data = b'{"id":"a"}'
    tag = hmac.new(b"k", data, hashlib.sha256).hexdigest()
    df = spark.createDataFrame([(f"{data.hex()}.{tag}",), (f"{data.hex()}.{tag[:-1]}0x",), ("zz.1",), (None,)], "v string")
    assert [r.p for r in df.select(observe.signed_directive(b"k")(F.col("v")).alias("p")).collect()] == [data.decode(), None, None, None]
    df = spark.createDataFrame([("a.b",), ("..",), ("zz.t.c",), (None,)], "token string")
    assert {r.error for r in cursors.verified(df, b"k").collect()} == {"cursor_unresolvable"}


def test_trace_precedence(spark):
    t, u, s = "1" * 32, "3" * 16, "2" * 16
    rows = [
        (f"00-{t}-{s}-01", f"{u}-{s}-1", " a=b "),
        ("00-" + "0" * 32 + f"-{s}-01", f"{u}-{s}-0", "a=b"),
        (f"01-{t}-{s}-01", f"{u}-{s}", "a=b"),
        (f"00-{t}-{s}-00", None, "x" * 513),
        (None, "1", "a=b"),
        (None, f"{u}-{s}-x", None),
    ]
    own = S.trace_context(F.col("w"), F.col("b"), F.lit("req-1"), F.col("s"))
    got = [r.c for r in spark.createDataFrame(rows, "w string, b string, s string").select(own.alias("c")).collect()]
    root = got[4]
    assert root == got[5] and root.sampled and root.parent_span_id is None and root.tracestate is None
    assert [r.trace_id for r in got[:4]] == [t, "0" * 16 + u, "0" * 16 + u, t]
    assert all(r.span_id == root.span_id != s and r.parent_span_id == s for r in got[:4])
    assert [r.sampled for r in got[:4]] == [True, False, True, False]
    assert [r.tracestate for r in got[:4]] == ["a=b", None, None, None]


def test_query_plans(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = registry.QUERIES["isolated_count"](spark, sf_dir)._jdf.queryExecution().toString()
    pushed = plan[plan.rindex("PushedFilters") :].split("]")[0]
    for part in ("EqualTo(o_custkey,7)", "GreaterThanOrEqual(o_totalprice,10000.0)", "LessThanOrEqual(o_totalprice,250000.0)", "IsNotNull(o_orderpriority)"):
        assert part in pushed
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "o_totalprice" in plan.split("ReadSchema")[1] and "o_orderdate" not in plan.split("ReadSchema")[1]


def test_point_reads_are_pruned(spark, sf_dir):
    docs = documents(spark, sf_dir)
    ids = [r.o_orderkey for r in docs.filter("_tenant = 7").select("o_orderkey").collect()]
    plan = Q.point_read(docs, str(ids[0]), {"_tenant": "7"}, TEMPLATE, "7", "o_orderkey")._jdf.queryExecution().toString()
    assert f"EqualTo(o_orderkey,{ids[0]})" in plan[plan.rindex("PushedFilters") :]
    read = lambda i, p="7": Q.point_read(docs, i, {"_tenant": p}, TEMPLATE, p, "o_orderkey").count()
    assert read(str(ids[0])) == 1 and read(f"0{ids[0]}") == 0 and read("x") == 0 and read(str(ids[0]), "8") == 0


def test_ill_typed_values_are_rejected(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for query in ({"term": {"o_totalprice": "abc"}}, {"range": {"o_orderkey": {"gt": "x"}}}, {"term": {"o_orderkey": True}}, {"term": {"o_orderdate": "never"}}, {"term": {"o_orderstatus": {"value": ["F"]}}}, {"terms": {"o_orderkey": [1, "q"]}}, {"prefix": {"o_orderstatus": 1}}):
        with pytest.raises(Q.Rejected):
            Q.count(docs, {"query": query}, {"_tenant": "7"})
    none = [{"term": {"o_orderstatus": 5}}, {"term": {"o_orderkey": 1.5}}, {"term": {"o_orderkey": 1 << 70}}, {"term": {"no_field": "x"}}]
    assert all(Q.count(docs, {"query": q}, {"_tenant": "7"}).first()[0] == 0 for q in none)
    own = docs.filter("_tenant = 7").count()
    assert Q.count(docs, {"query": {"bool": {"must_not": none}}}, {"_tenant": "7"}).first()[0] == own > 0
    assert Q.count(docs, {"query": {"range": {"o_orderkey": {"gt": 0.5, "lt": 1 << 70}}}}, {"_tenant": "7"}).first()[0] == own
    assert Q.count(docs, {}, {"_tenant": "no number"}).first()[0] == 0


def test_multi_search_equals_its_searches(spark, sf_dir):
    docs = documents(spark, sf_dir)
    bodies = [{"size": 3}, {"sort": [{"o_totalprice": "desc"}], "from": 2, "size": 4}, {"query": {"term": {"o_orderstatus": "F"}}, "sort": ["o_orderpriority", {"o_orderdate": "desc"}]}, {"suggest": {}}, {"size": 0}, {"query": {"range": {"o_totalprice": {"gt": "x"}}}}, {}]
    items = [(b, None if k == 6 else {"_tenant": str(7 + k % 2)}) for k, b in enumerate(bodies)]
    out = Q.multi_search(docs, items, ["_id"])
    assert out._jdf.queryExecution().toString().count("FileScan parquet") <= 2  # once in the plan, once in its adaptive form
    got = defaultdict(list)
    for r in out.collect():
        got[r.ordinal].append(r.error or r["_id"])
    for k, (body, fields) in enumerate(items):
        try:
            want = sorted(r["_id"] for r in Q.search(docs, body, fields).collect())
        except Q.Rejected as e:
            want = [str(e)]
        assert sorted(got[k]) == want, k
