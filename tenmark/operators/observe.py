"""Directives, sampling, explain documents, rings and request metrics."""

from __future__ import annotations

import hashlib
import hmac
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenmark.functions import scalars as S
from tenmark.functions.running import with_running
from tenmark.operators import routing

#: The levels, lowest first.
LEVELS = ("Off", "Shape", "ShapeTiming", "ShapeRewriteDiff")
#: A directive set is a list that an operator publishes; it is broadcast, and a larger one is refused.
MOST_DIRECTIVES = 10_000
FIELDS = ("tenant", "index", "principal", "endpoint")
DIRECTIVE = "id string, level string, tenant string, index string, principal string, endpoint string, sample_per_mille int, expires_at double, ring_buffer boolean, capture boolean"
_KEYS = {"id", "level", "ttl_secs", *FIELDS, "sample_per_mille", "ring_buffer", "capture"}


def sampled(request_id: Column, per_mille: Column) -> Column:
    """The same request is in or out wherever it is looked at; 0 is never and 1000 always."""
    return _within_rate(S.fnv1a_mod(request_id, 1000), per_mille)


def _within_rate(unit: Column, per_mille: Column) -> Column:
    return F.when(per_mille <= 0, F.lit(False)).when(per_mille >= 1000, F.lit(True)).otherwise(unit < per_mille)


def decode_directives(spark: SparkSession, text: str, now: float) -> DataFrame:
    """A directive set from JSON, ``{"directives": [...]}``; anything unknown or ill-typed fails the whole set."""
    found = json.loads(text)
    if not isinstance(found, dict) or set(found) != {"directives"} or not isinstance(found["directives"], list):
        raise ValueError("a directive set is an object with a list of directives alone")
    if len(found["directives"]) > MOST_DIRECTIVES:
        raise ValueError("too many directives")
    rows = []
    for one in found["directives"]:
        if not isinstance(one, dict) or set(one) - _KEYS or not isinstance(one.get("id"), str) or one.get("level") not in LEVELS:
            raise ValueError("not a directive")
        rate, ttl = one.get("sample_per_mille", 1000), one.get("ttl_secs")
        if type(rate) is not int or not 0 <= rate <= 1000 or type(ttl) is not int or ttl < 1:
            raise ValueError("a rate is 0 to 1000 and a life one second or more")
        if any(one.get(f) is not None and not isinstance(one[f], str) for f in FIELDS) or any(type(one.get(f, False)) is not bool for f in ("ring_buffer", "capture")):
            raise ValueError("a field has the wrong type")
        if one.get("endpoint") is not None and one["endpoint"] not in routing.ENDPOINTS:
            raise ValueError("an unknown endpoint")
        rows.append((one["id"], one["level"], *(one.get(f) for f in FIELDS), rate, float(now + ttl), one.get("ring_buffer", False), one.get("capture", False)))
    return spark.createDataFrame(rows, DIRECTIVE)


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level).cast("int") - 1


def applicable(requests: DataFrame, directives: DataFrame, now: Column) -> DataFrame:
    """Requests with each directive that applies: alive, every field equal or open, sampled.

    The set is broadcast to a theta join that keeps matches only; more than ``MOST_DIRECTIVES`` are refused. A
    request is hashed once, and only if a directive samples.
    """
    if directives.limit(MOST_DIRECTIVES + 1).count() > MOST_DIRECTIVES:
        raise ValueError("too many directives")
    samples = not directives.filter("sample_per_mille BETWEEN 1 AND 999").isEmpty()
    hashed = requests.withColumn("_unit", S.fnv1a_mod(F.col("request_id"), 1000) if samples else F.lit(0))
    d = directives.select(*(F.col(c).alias(f"d_{c}") for c in directives.columns))
    fits = (F.col("d_expires_at") > now) & _within_rate(F.col("_unit"), F.col("d_sample_per_mille"))
    for f in FIELDS:
        fits = fits & (F.col(f"d_{f}").isNull() | (F.col(f"d_{f}") == F.col(f)))
    return hashed.join(F.broadcast(d), fits).drop("_unit")


def diagnostics(requests: DataFrame, directives: DataFrame, now: Column) -> DataFrame:
    """Per request the highest level that applies (``Off`` if none), and whether a ring or capture is wanted."""
    on = applicable(requests, directives, now).groupBy("request_id").agg(F.max(level_rank(F.col("d_level"))).alias("rank"), F.bool_or("d_ring_buffer").alias("ring_buffer"), F.bool_or("d_capture").alias("capture"))
    both = requests.select("request_id").join(on, "request_id", "left")
    level = F.element_at(F.array(*map(F.lit, LEVELS)), F.coalesce("rank", F.lit(0)) + 1)
    return both.select("request_id", level.alias("level"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("ring_buffer", "capture")))


def signed_directive(key: bytes):
    """Verifies ``hex(payload).hex(hmac)`` headers; the payload's JSON, else null. SQL has no HMAC."""

    @F.pandas_udf("string")
    def verify(value: pd.Series) -> pd.Series:
        def one(v):
            try:
                payload, tag = v.split(".")
                data = bytes.fromhex(payload)
                return data.decode() if hmac.compare_digest(hmac.new(key, data, hashlib.sha256).hexdigest(), tag.lower()) else None
            except (AttributeError, ValueError):
                return None

        return pd.Series([one(v) for v in value], dtype=object)

    return verify


def ring(rows: DataFrame, keep: int = 1024, seq: str = "seq") -> DataFrame:
    """The last ``keep`` rows, the feature of a ring buffer: a top-k, no global sort."""
    return rows.orderBy(F.desc(seq)).limit(keep)


def ring_lookup(rows: DataFrame, keep: int = 1024) -> DataFrame:
    """Of each request id in the ring the oldest record: ``request_id, seq``."""
    return ring(rows, keep).groupBy("request_id").agg(F.min("seq").alias("seq"))


def explain(rows: DataFrame) -> DataFrame:
    """``request_id, document``: stages that never ran are not in the document."""
    spans = F.struct(*(F.col(c) for c in ("classify", "resolve", "rewrite", "dispatch", "egress") if c in rows.columns))
    outcome = F.when(F.col("error").isNull(), "ok").otherwise("error")
    return rows.select("request_id", F.to_json(F.struct("request_id", outcome.alias("outcome"), spans.alias("spans"), "error")).alias("document"))


def request_metrics(rows: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """Requests, successes (2xx) and errors."""
    ok = F.count_if(F.col(status).between(200, 299))
    return rows.groupBy(*by).agg(F.count("*").alias("total"), ok.alias("ok"), (F.count("*") - ok).alias("errors"))


def pool_reuse(rows: DataFrame, by: list[str]) -> DataFrame:
    """Dispatches that needed no new connection, not below 0."""
    return rows.groupBy(*by).agg(F.sum("dispatched").alias("dispatched"), F.sum("opened").alias("opened")).withColumn("reused", F.greatest(F.col("dispatched") - F.col("opened"), F.lit(0)))


def exported(rows: DataFrame, exporting: bool) -> DataFrame:
    """Traces to export: only while exporting, of level ``Shape`` or more."""
    return rows.filter(F.lit(exporting) & (level_rank(F.col("level")) >= 1))


def otlp_span(trace: Column, parent: Column, name: Column, start_ns: Column, end_ns: Column, attributes: dict[str, Column]) -> Column:
    """A span in OTLP JSON; the parent is there only if known, attributes as text and only if set."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.struct(v.cast("string").alias("stringValue")).alias("value")) for k, v in attributes.items()))
    return F.to_json(F.struct(trace["trace_id"].alias("traceId"), trace["span_id"].alias("spanId"), parent.alias("parentSpanId"), name.alias("name"), start_ns.cast("string").alias("startTimeUnixNano"), end_ns.cast("string").alias("endTimeUnixNano"), F.filter(pairs, lambda p: p["value"]["stringValue"].isNotNull()).alias("attributes")))


def allowed_attributes(attributes: Column, allowed: tuple[str, ...]) -> Column:
    """A map without what is not on the allow list: anything else may be sensitive."""
    return F.map_filter(attributes, lambda k, v: k.isin(*allowed))


def numbered(rows: DataFrame, by: str, prefix: str = "req-") -> DataFrame:
    """Adds ``request_id`` = prefix and position within ``by``'s listener."""
    held = with_running(rows, [by], "seq", F.lit(1), "_at")
    return held.withColumn("request_id", F.concat(F.lit(prefix), F.col("_at").cast("string"))).drop("_at")
