"""Latency summaries and the verdicts over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest_rank(value: Column | str, p: float) -> Column:
    """The value at rank ``ceil(p * n)``."""
    name = value if isinstance(value, str) else "value"
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{name}`)")


def latency_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, least, most, whole-number mean, and nearest-rank p50, p90, p99 of whole numbers."""
    v = F.col(value)
    ranks = [nearest_rank(value, p).alias(n) for p, n in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))]
    return rows.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.expr(f"sum(`{value}`) div count(`{value}`)").alias("mean"), *ranks)


def added_latency(rows: DataFrame, by: list[str], value: str, through: str) -> DataFrame:
    """p50 and p99 through the proxy less those of the baseline, not below 0."""
    at = lambda p, on: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`) FILTER (WHERE {'' if on else 'NOT '}`{through}`)")
    return rows.groupBy(*by).agg(F.greatest(at(0.5, True) - at(0.5, False), F.lit(0)).alias("added_p50"), F.greatest(at(0.99, True) - at(0.99, False), F.lit(0)).alias("added_p99"))


def tail_amplification(sweep: DataFrame, by: list[str]) -> DataFrame:
    """p99 at the last position of a sweep over that at the first; 1.0 if that is 0."""
    first, last = F.min_by("p99", "pos"), F.max_by("p99", "pos")
    return sweep.groupBy(*by).agg(F.when(first > 0, last / first).otherwise(F.lit(1.0)).alias("tail"))


def throughput_scaling(sweep: DataFrame, by: list[str]) -> DataFrame:
    """The best rate of a sweep over the first; 0.0 if that is 0."""
    first = F.min_by("rps", "pos")
    return sweep.groupBy(*by).agg(F.when(first > 0, F.max("rps") / first).otherwise(F.lit(0.0)).alias("scaling"))


def scale_verdict(rows: DataFrame, most_tail: float = 3.0, least_scaling: float = 2.0) -> DataFrame:
    return rows.withColumn("passed", (F.col("tail") <= most_tail) & (F.col("scaling") >= least_scaling))


def footprint(idle: Column, peak: Column, most_idle: int = 256 << 20, ratio: float = 1.5, growth: int = 64 << 20) -> Column:
    """``(growth, ratio, passed)``: idle within its bound, and growth within the ratio or the absolute bound."""
    grown = F.greatest(peak - idle, F.lit(0))
    times = F.when(idle > 0, peak / idle).otherwise(F.lit(1.0))
    return F.struct(grown.alias("growth"), times.alias("ratio"), ((idle <= most_idle) & ((times <= ratio) | (grown <= growth))).alias("passed"))


def verdict(findings: DataFrame, by: list[str]) -> DataFrame:
    """Whether all findings of a run hold, and how many do not."""
    return findings.groupBy(*by).agg(F.bool_and("holds").alias("passed"), F.count_if(~F.col("holds")).alias("failed"))
