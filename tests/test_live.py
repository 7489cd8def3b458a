import json

from pyspark.sql import functions as F

from tenmark.streaming import live


def test_bulk_bodies_are_ingested_as_they_arrive(spark, tmp_path):
    bodies, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    placements = spark.createDataFrame([("a", "SharedIndex", "c1", "shared", 3, "active"), ("b", "DedicatedIndex", "c2", "own", 1, "cutover")], "partition string, kind string, cluster string, index string, epoch long, phase string")

    def body(name, *docs):
        lines = [x for i, d in docs for x in (json.dumps({"index": {"_id": i} if i else {}}), json.dumps(d))]
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")

    start = lambda: live.ingest(live.bulk_bodies(spark, bodies), lambda: placements, out, mark, "orders", "{partition}:{body.id}").awaitTermination()
    body("r1", ("1", {"tenant_id": "a", "id": 9}), (None, {"tenant_id": "a", "id": 7}), ("2", {"tenant_id": "b", "id": 1}), ("3", {"id": 1}))
    start()
    body("r2", ("1", {"tenant_id": "zz"}))
    (tmp_path / "in" / "r3").write_text("no json\n")
    start()
    start()
    got = {(r.request_id, r.ordinal): r for r in spark.read.parquet(out).collect()}
    assert sorted(got) == [("r1", 0), ("r1", 1), ("r1", 2), ("r1", 3), ("r2", 0)]
    assert [got["r1", k].error for k in range(4)] == [None, None, "stale_epoch", "partition_unresolved"] and got["r2", 0].error == "placement_missing"
    assert (got["r1", 0].physical_id, got["r1", 1].physical_id, got["r1", 1].logical_id, got["r1", 0].routing) == ("a:1", "a:7", "7", "a")
    assert json.loads(got["r1", 0].body)["_tenant"] == "a" and got["r1", 2].body is None


def test_directives_are_those_in_force(spark, tmp_path):
    path = tmp_path / "directives.json"
    one = {"id": "x", "level": "Shape", "ttl_secs": 10, "endpoint": "Search"}
    view = live.DirectiveView(spark, str(path))
    level = lambda now: [r.level for r in view.refresh(now).collect()]
    assert level(0.0) == []
    path.write_text(json.dumps({"directives": [one]}))
    assert level(0.0) == ["Shape"]
    path.write_text("{")
    assert level(5.0) == ["Shape"] and view.current.first().expires_at == 10.0
    (tmp_path / "req").mkdir()
    path.write_text(json.dumps({"directives": [{**one, "level": "ShapeTiming"}]}))
    spark.createDataFrame([("r", None, "i", "p", "Search"), ("s", None, "i", "p", "Count")], "request_id string, tenant string, index string, principal string, endpoint string").write.parquet(str(tmp_path / "req/a"))
    requests = spark.readStream.schema(spark.read.parquet(str(tmp_path / "req/a")).schema).parquet(str(tmp_path / "req/*"))
    live.diagnosed(requests, view, lambda: 20.0, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.request_id, r.level) for r in got.collect()) == [("r", "ShapeTiming"), ("s", "Off")]
    path.unlink()
    assert level(30.0) == [] and got.filter(F.col("capture")).isEmpty()


def test_running_totals_of_any_chunk(spark):
    import random

    from tenmark.functions.running import with_running

    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.randrange(-5, 9)) for k in range(-100, 400)]
    want, held = {}, {}
    for key, k, v in rows:
        held[key] = held.get(key, 0) + v
        want[k] = held[key]
    df = spark.createDataFrame(rows, "key string, seq long, v long")
    for chunk in (1, 7, 1 << 16):
        assert {r.seq: r.t for r in with_running(df, ["key"], "seq", F.col("v"), "t", chunk).collect()} == want


def test_only_wanted_exchanges_are_captured(spark, tmp_path):
    from tenmark.streaming import oplog

    (tmp_path / "in").mkdir()
    rows = [("r1", True, [("Authorization", "x"), ("a", "b")]), ("r2", False, [("a", "b")])]
    spark.createDataFrame(rows, "request_id string, capture boolean, headers array<struct<name:string,value:string>>").write.parquet(str(tmp_path / "in/a"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in/a")).schema).parquet(str(tmp_path / "in/*"))
    for _ in range(2):  # a restart adds nothing
        oplog.tee(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination()
    got = spark.read.json(str(tmp_path / "out")).collect()
    assert [(r.request_id, [(h.name, h.value) for h in r.headers]) for r in got] == [("r1", [("a", "b")])]
