"""Classification, partition resolution, placement and gating of request rows.

Requests are rows, decisions are columns, and errors are values in rows: a request that cannot be routed has
an ``error`` slug instead of a target.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenmark.functions import scalars as S

#: Endpoint kinds of (index, verb) paths without an id, by verb.
BY_VERB = {"_search": "Search", "_count": "Count", "_mget": "MultiGet", "_msearch": "MultiSearch", "_bulk": "IngestBulk"}
TENANCY_AWARE = ("IngestDoc", "IngestBulk", "GetById", "DeleteById", "Search", "Count", "MultiGet", "MultiSearch", "DeleteByQuery")
WRITES = ("IngestDoc", "IngestBulk", "DeleteById")
ENDPOINTS = (*TENANCY_AWARE, "Cursor", "Admin", "Unknown")
#: Error slug, HTTP status, whether a retry can help.
ERRORS = (
    ("partition_unresolved", 400, False),
    ("unsupported_endpoint", 400, False),
    ("auth_failed", 401, False),
    ("unauthorized", 403, False),
    ("placement_missing", 404, False),
    ("stale_epoch", 409, True),
    ("payload_too_large", 413, False),
    ("cursor_unresolvable", 500, False),
    ("upstream_failed", 502, True),
    ("placement_backend_unavailable", 503, True),
    ("overloaded", 503, True),
)


def error_table(spark: SparkSession) -> DataFrame:
    """The error dimension: ``error, status, retryable``; eleven rows."""
    return spark.createDataFrame(ERRORS, "error string, status int, retryable boolean")


def with_status(rows: DataFrame) -> DataFrame:
    """Adds ``status`` and ``retryable`` to rows with an ``error`` slug; 200 where it is null, 500 where unknown."""
    found = rows.join(F.broadcast(error_table(rows.sparkSession)), "error", "left")
    status = F.when(F.col("error").isNull(), 200).otherwise(F.coalesce("status", F.lit(500)))
    return found.withColumn("status", status).withColumn("retryable", F.coalesce("retryable", F.lit(False)))


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def endpoint_kind(method: Column, path: Column) -> Column:
    """The kind of endpoint that a method and a path without its query name."""
    s, n = segments(path), F.size(segments(path))
    at = lambda k: F.get(s, F.lit(k))
    rules = [
        ((n == 3) & at(1).isin("_doc", "_create"), F.when(method.isin("GET", "HEAD"), "GetById").when(method == "DELETE", "DeleteById").when(method.isin("PUT", "POST"), "IngestDoc").otherwise("Unknown")),
        ((n == 2) & (at(1) == "_doc"), F.when(method.isin("PUT", "POST"), "IngestDoc").otherwise("Unknown")),
        ((n == 2) & (at(0) == "_search") & at(1).isin("scroll", "point_in_time"), F.lit("Cursor")),
        ((n == 3) & (at(0) == "_search") & (at(1) == "scroll"), F.lit("Cursor")),
        ((n == 3) & (at(1) == "_search") & (at(2) == "point_in_time"), F.lit("Cursor")),
        *(((n == 1) & (at(0) == verb) & (verb != "_count"), F.lit(kind)) for verb, kind in BY_VERB.items() if verb != "_count"),
        *(((n == 2) & (at(1) == verb), F.lit(kind)) for verb, kind in BY_VERB.items()),
        ((n == 2) & (at(1) == "_delete_by_query"), F.lit("DeleteByQuery")),
        (at(0).isin("_cat", "_cluster", "_nodes"), F.lit("Admin")),
    ]
    return reduce(lambda c, r: c.when(r[0], r[1]), rules[1:], F.when(*rules[0])).otherwise("Unknown")


def classified(requests: DataFrame, method: str = "method", path: str = "path") -> DataFrame:
    """Adds ``endpoint``, ``logical_index`` and ``doc_id``."""
    s, n = segments(F.col(path)), F.size(segments(F.col(path)))
    at = lambda k: F.get(s, F.lit(k))
    kind = endpoint_kind(F.col(method), F.col(path))
    by_id = (n == 3) & at(1).isin("_doc", "_create")
    scroll = (n == 3) & (at(0) == "_search") & (at(1) == "scroll")
    cursor = (kind == "Cursor") & (at(0) == "_search") & at(1).isin("scroll", "point_in_time")
    bare = (n == 1) & at(0).isin(*BY_VERB) & (kind != "Unknown")
    index = F.when((kind == "Admin") | bare | cursor, "").otherwise(F.coalesce(at(0), F.lit("")))
    return requests.withColumn("endpoint", kind).withColumn("logical_index", index).withColumn("doc_id", F.when(by_id | scroll, at(2)))


def any_of(*candidates: Column) -> Column:
    """The first candidate that is there: the partition of a request."""
    return F.coalesce(*candidates)


def resolved(requests: DataFrame, partition: Column) -> DataFrame:
    """Adds ``partition`` and ``error``; endpoints without tenancy come before a missing partition."""
    aware = F.col("endpoint").isin(*TENANCY_AWARE)
    error = F.when(~aware, "unsupported_endpoint").when(partition.isNull(), "partition_unresolved")
    return requests.withColumn("partition", F.when(aware, partition)).withColumn("error", error)


def current_placements(log: DataFrame) -> DataFrame:
    """The latest row of each partition in an append-only log ``partition, epoch, ...``: a partial aggregate, no window."""
    rest = [c for c in log.columns if c != "partition"]
    return log.groupBy("partition").agg(F.max_by(F.struct(*rest), "epoch").alias("p")).select("partition", "p.*")


#: Fixed value: so many keys are shared by rows without a partition.
SLOTS = 1 << 20


def _broadcast(table: DataFrame) -> bool:
    """Whether Spark broadcasts a table in a join without a hint."""
    most = table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= most


def located(requests: DataFrame, placements: DataFrame) -> DataFrame:
    """Looks placements up by partition: adds ``kind, cluster, placed_index, epoch, phase``, null where there is none.

    Spark broadcasts the table while its size allows, and else shuffles both; then a task holds its share of the
    placements and reads its requests past them, without sorting these. Rows without a partition match nothing; they
    are dealt by ``request_id`` (without one, by all plain columns) and not, as one null key, to a single task.
    """
    by = ["request_id"] if "request_id" in requests.columns else [c for c, t in requests.dtypes if not t.startswith(("array", "map", "struct", "variant"))]
    p = placements.select(F.col("partition").alias("_placed"), F.col("kind"), F.col("cluster"), F.col("index").alias("placed_index"), "epoch", "phase")
    p = p if _broadcast(p) else p.hint("shuffle_hash")
    own = F.col("partition").cast("string")
    key = F.coalesce(own, F.pmod(F.xxhash64(*by), F.lit(SLOTS)).cast("string"))
    both = requests.join(p, (key == F.col("_placed").cast("string")) & own.isNotNull(), "left")
    return both.select("partition", *(c for c in both.columns if c not in ("partition", "_placed")))


def targeted(rows: DataFrame) -> DataFrame:
    """Adds the physical target to ``located`` rows with ``logical_index`` and ``error``, or ``placement_missing``."""
    target = F.when(F.col("kind") == "DedicatedCluster", F.col("logical_index")).otherwise(F.col("placed_index"))
    return rows.withColumn("error", F.coalesce("error", F.when(F.col("cluster").isNull(), "placement_missing"))).withColumn("target_index", target).drop("placed_index")


def placed(requests: DataFrame, placements: DataFrame) -> DataFrame:
    """Looks placements up by partition and adds the physical target, or ``placement_missing``."""
    return targeted(located(requests, placements))


def admitted(phase: Column, current: Column, stamped: Column) -> Column:
    """Whether a write passes the epoch gate: a write placement exists and the epoch is the stamped one."""
    return F.coalesce((phase != "cutover") & (current == stamped), F.lit(False))


def gated(writes: DataFrame, stamped: str = "stamped_epoch") -> DataFrame:
    """Turns writes that the gate refuses into ``stale_epoch`` errors."""
    ok = admitted(F.col("phase"), F.col("epoch"), F.col(stamped))
    return writes.withColumn("error", F.coalesce("error", F.when(~ok, "stale_epoch")))


def matches_prefix(value: Column, prefixes: tuple[str, ...]) -> Column:
    """Whether any prefix begins the value; no prefixes match everything."""
    return F.lit(True) if not prefixes else reduce(lambda a, p: a | value.startswith(p), prefixes, F.lit(False))


def climbs(path: Column) -> Column:
    return F.array_contains(F.split(path, "/"), "..")


def admin_allowed(path: Column, prefixes: tuple[str, ...]) -> Column:
    """An administrative path is allowed if listed and without a ``..`` segment; nothing listed allows nothing."""
    return ~climbs(path) & (matches_prefix(path, prefixes) if prefixes else F.lit(False))


def first_gate_error(is_write: Column, secure: Column, known: Column, granted: Column) -> Column:
    """The first failing gate: transport security for mutations, then who it is, then whether they may."""
    return F.when(is_write & ~secure, "unauthorized").when(~known, "auth_failed").when(~granted, "unauthorized")


def upstream_outcome(status: Column) -> Column:
    """``(error, retryable)`` of an upstream status: 5xx fail, of which 502 to 504 may be retried; 4xx pass through."""
    return F.struct(F.when(status >= 500, "upstream_failed").alias("error"), status.between(502, 504).alias("retryable"))
