"""The engine's relations, bound to the driver's tables.

Documents are ``orders`` (tenant = customer), placements come from ``customer``, requests from ``events``,
bulk operations from ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TEMPLATE = "{partition}:{body.id}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents: typed columns beside the tenant, as it is stored, and the physical id."""
    o = table(spark, sf_dir, "orders")
    tenant = F.col("o_custkey").cast("string")
    return o.select(F.lit("orders").alias("_index"), F.concat_ws(":", tenant, F.col("o_orderkey").cast("string")).alias("_id"), F.col("o_custkey").alias("_tenant"), "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client documents as JSON text: ``key, partition, body``."""
    o = table(spark, sf_dir, "orders")
    nested = F.struct(F.col("o_orderpriority").alias("level"), (F.col("o_orderkey") % 7).alias("n"))
    body = F.to_json(F.struct(F.col("o_custkey").cast("string").alias("tenant_id"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), nested.alias("meta"), F.array(F.lit(1), F.lit(2)).alias("tags")))
    return o.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").cast("string").alias("partition"), body.alias("body"))


def placement_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key, cluster = F.col("c_custkey"), F.concat(F.lit("c"), (F.col("c_nationkey") % 4).cast("string"))
    kind = F.when(key % 3 == 0, "SharedIndex").when(key % 3 == 1, "DedicatedIndex").otherwise("DedicatedCluster")
    index = F.when(key % 3 == 0, F.concat(F.lit("shared-"), (F.col("c_nationkey") % 4).cast("string"))).when(key % 3 == 1, F.concat(F.lit("orders-"), key.cast("string")))
    phase = F.when(key % 7 == 0, "draining").when(key % 7 == 1, "cutover").otherwise("active")
    now = c.select(key.cast("string").alias("partition"), kind.alias("kind"), cluster.alias("cluster"), index.alias("index"), (1 + key % 5).cast("long").alias("epoch"), phase.alias("phase"))
    before = now.select("partition", F.lit("SharedIndex").alias("kind"), F.lit("c9").alias("cluster"), F.lit("old").alias("index"), F.lit(0).cast("long").alias("epoch"), F.lit("active").alias("phase"))
    return now.unionByName(before)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind, n = F.col("event_type"), F.col("event_id").cast("string")
    method = F.when(kind.isin("click", "signup"), "POST").when(kind == "purchase", "PUT").when((kind == "view") & (F.col("event_id") % 5 == 0), "DELETE").otherwise("GET")
    path = F.when(kind == "click", "/orders/_search").when(kind == "signup", "/_bulk").when(kind == "error", "/_cat/indices").otherwise(F.concat(F.lit("/orders/_doc/"), n))
    body_tenant = F.when(F.col("event_id") % 3 == 0, F.col("user_id").cast("string"))
    head_tenant = F.when(F.col("event_id") % 4 != 1, F.col("user_id").cast("string"))
    headers = F.filter(F.array(F.struct(F.lit("X-Tenant").alias("name"), head_tenant.alias("value")), F.struct(F.lit("Authorization").alias("name"), F.lit("Bearer t").alias("value"))), lambda h: h["value"].isNotNull())
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("req-"), n).alias("request_id"), "ts", method.alias("method"), path.alias("path"), body_tenant.alias("body_tenant"), headers.alias("headers"), "user_id", "event_type", F.col("props").alias("body"), "value")


def numbered(items: DataFrame) -> DataFrame:
    """Line items as a request's, ``request_id`` for their order, with ``ordinal``: dealt by the name that later steps group by, so that they need no second shuffle."""
    order = Window.partitionBy("request_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    return items.withColumnRenamed("l_orderkey", "request_id").withColumn("ordinal", F.row_number().over(order) - 1)


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk operations ``request_id, ordinal, action, key, target, source, bytes``; one request per order."""
    action = F.when(F.col("l_returnflag") == "A", "index").when(F.col("l_returnflag") == "N", "create").otherwise("delete")
    return numbered(table(spark, sf_dir, "lineitem")).select(
        "request_id", F.col("ordinal").cast("int").alias("ordinal"), action.alias("action"),
        F.concat_ws(":", F.col("request_id").cast("string"), F.col("l_linenumber").cast("string")).alias("key"),
        F.concat(F.lit("t"), (F.col("l_suppkey") % 8).cast("string")).alias("target"), F.col("l_partkey").alias("source"), (F.col("l_partkey") % 1000).cast("int").alias("bytes"),
    )
