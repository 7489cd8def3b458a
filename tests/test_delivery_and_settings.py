import pytest
from pyspark.sql import functions as F

from tenmark.operators import delivery
from tenmark.plans.policy import Policy
from tenmark.sources import snapshots
from tenmark.sources.config import BadSetting, Settings

NAMES = ("listen", "tls_cert", "tls_key", "limit", "on", "list")


def test_upstream_requests(spark):
    rows = [("index", "a b", "t/1", "PUT", "/x/_doc/a%20b?routing=t%2F1"), ("index", None, None, "POST", "/x/_doc"), ("create", "1", None, "PUT", "/x/_create/1"), ("create", None, "r", "POST", "/x/_doc?op_type=create&routing=r"), ("update", "1", None, "POST", "/x/_update/1"), ("delete", "1", "r", "DELETE", "/x/_doc/1?routing=r")]
    df = spark.createDataFrame(rows, "action string, id string, routing string, method string, uri string")
    for r in df.withColumn("r", delivery.upstream_request(F.col("action"), F.lit("x"), F.col("id"), F.col("routing"))).collect():
        assert (r.r.method, r.r.uri) == (r.method, r.uri)


def test_answers(spark):
    df = spark.createDataFrame([(True, False, False), (False, False, True), (False, True, False), (False, True, True)], "u boolean, e boolean, s boolean")
    assert [r.x for r in df.select(delivery.queued_answer(F.col("u"), F.col("e"), F.col("s")).alias("x")).collect()] == [400, 422, 503, 202]


def test_layers_and_forms():
    s = Settings(NAMES, "T_").file("listen = 'a'\n# no\n[tls]\ncert = c\nlimit=5\n").environment({"T_LISTEN": "b", "T_LIMIT": ""}).flags(["--on=yes", "--list", "x, y,"])
    assert s.values == {"listen": "b", "tls_cert": "c", "limit": "5", "on": "yes", "list": "x, y,"}
    assert s.flag("on") and s.number("limit", 1) == 5 and s.parts("list") == ["x", "y"]
    with pytest.raises(BadSetting):
        s.together("tls_cert", "tls_key")
    for bad in (["what"], ["--what=1"], ["--on"]):
        with pytest.raises(BadSetting):
            Settings(NAMES).flags(bad)
    for bad in ("x", "what = 1"):
        with pytest.raises(BadSetting):
            Settings(NAMES).file(bad)
    with pytest.raises(BadSetting):
        Settings(NAMES).flags(["--on=maybe"]).flag("on")


def test_a_pinned_version_stays(spark, tmp_path):
    folder = str(tmp_path / "docs")
    one = spark.createDataFrame([("c", "i", 1)], "cluster string, index string, n int")
    with pytest.raises(LookupError):
        snapshots.open_point(spark, folder)
    snapshots.write_version(one, folder, 1)
    point = snapshots.open_point(spark, folder)
    snapshots.write_version(one.unionAll(one), folder, 2)
    assert snapshots.read_at(spark, folder, point, "c", "i").count() == 1
    assert snapshots.versions(spark, folder) == [1, 2]


def test_policy(spark):
    p = Policy(constants={"_region": '"eu"'})
    df = spark.createDataFrame([("t", '{"id":1}'), (None, "{}")], "partition string, _source string")
    got = p.ingest(df.filter("partition IS NOT NULL")).first()
    assert got._id == "t:1" and got._routing == "t" and got._source == '{"_tenant":"t","_region":"eu","id":1}'
    assert p.filters("t") == {"_tenant": "t"}
    with pytest.raises(ValueError):
        Policy(template="{body.id}")
