"""What a deployment may supply: how a tenant is told, where it lives, what is injected.

A policy gives columns and tables, never row functions, so whatever it says is planned with the rest.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenmark.functions import scalars as S
from tenmark.operators import lifecycle, rewrite, routing


@dataclass(frozen=True)
class Policy:
    """The reference tenancy: key from the body's field, else a header; one injected field; one id template."""

    body_field: str = "tenant_id"
    header: str = "x-tenant"
    template: str | None = "{partition}:{body.id}"
    tenant_field: str = "_tenant"
    constants: dict[str, str] = field(default_factory=dict)
    set_routing: bool = True
    shared: bool = True

    def __post_init__(self) -> None:
        if self.shared and self.template and not any(k == "partition" for k, _ in S.template_parts(self.template)):
            raise ValueError("ids in a shared index must carry the partition")

    def write_partition(self, body: Column, headers: Column) -> Column:
        return routing.any_of(S.json_scalar(body, self.body_field), S.header(headers, self.header))

    def read_partition(self, headers: Column) -> Column:
        """Reads never take the tenant from what the client searches for."""
        return S.header(headers, self.header)

    def fields(self, partition: Column) -> dict[str, Column]:
        return {self.tenant_field: S.json_string(partition), **{k: F.lit(v) for k, v in self.constants.items()}}

    def filters(self, partition: str) -> dict[str, str] | None:
        """What isolates a search: only fields that hold the partition, nothing decorative."""
        return {self.tenant_field: partition} if self.shared else None

    def ingest(self, docs: DataFrame) -> DataFrame:
        """``partition, _source`` to stored form; see ``rewrite.for_write``."""
        return rewrite.for_write(docs, self.template, self.fields(F.col("partition")), self.set_routing)

    def route(self, requests: DataFrame, placements: DataFrame, passthrough: tuple[str, ...] | None = None) -> DataFrame:
        """Requests ``method, path, headers, body`` with what serves them, whose they are and where that lives, or an ``error``.

        A request that passes through has no partition and no error of tenancy.
        """
        rows = routing.classified(requests)
        rows = rows.withColumn("branch", lifecycle.branch(F.col("endpoint"), F.col("logical_index"), passthrough))
        whose = F.when(F.col("endpoint").isin(*routing.WRITES), self.write_partition(F.col("body"), F.col("headers"))).otherwise(self.read_partition(F.col("headers")))
        through = F.coalesce(F.col("branch") == "passthrough", F.lit(False))
        rows = routing.placed(routing.resolved(rows, F.when(~through, whose)), placements)
        return rows.withColumn("error", F.when(~through, F.col("error")))

    def admit(self, routed: DataFrame, stamped: str = "stamped_epoch") -> DataFrame:
        """Routed writes, those refused whose placement has moved since they were stamped."""
        return routing.gated(routed, stamped)
