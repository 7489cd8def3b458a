"""Migration, drain barrier, circuit breaker and admission as folds over ordered events.

Each fold runs per key in the order of the events and keeps only its own state, whatever a key's events.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenmark.functions.folds import folded
from tenmark.functions.running import with_running

BARRIER_S = 30
FAILURES, COOLDOWN_S = 5, 5
IN_FLIGHT, BODY = 256 << 20, 8 << 20

#: Operation, phases in which it is allowed, phase after it.
TRANSITIONS = {
    "begin": ({"active": "draining"}, "already_migrating"),
    "cutover": ({"draining": "cutover"}, "not_draining"),
    "complete": ({"cutover": "active"}, "not_cutover"),
    "abort": ({"draining": "active", "cutover": "active"}, "not_migrating"),
}


def transitions(events: Iterable[tuple[str, str | None, int]], barrier_s: int = BARRIER_S) -> Iterator[tuple]:
    """``(phase, placement, read, write, error)`` after each of ``(op, placement, seconds)``.

    Reads stay on the old placement until completion; there is no write placement during cutover; a
    completion before the barrier has passed since cutover is refused; an abort clears the barrier.
    """
    phase = at = to = since = None
    for op, placement, ts in events:
        error = None
        if op == "set":
            phase, at, to, since = "active", placement, None, None
        elif phase is None:
            error = "unknown_partition"
        elif phase not in TRANSITIONS[op][0]:
            error = "not_migrating" if phase == "active" else TRANSITIONS[op][1]
        elif op == "complete" and ts - since < barrier_s:
            error = "barrier_pending"
        else:
            phase = TRANSITIONS[op][0][phase]
            if op == "begin":
                to = placement
            elif op == "cutover":
                since = ts
            elif op == "complete":
                at, to, since = to, None, None
            else:
                to = since = None
        yield phase, at, at, None if phase == "cutover" else at, error


def migrate(events: Iterable[tuple[str, str | None, int]], barrier_s: int = BARRIER_S) -> list[tuple]:
    return list(transitions(events, barrier_s))


def migration_states(log: DataFrame, barrier_s: int = BARRIER_S) -> DataFrame:
    """State after each row of ``partition, seq, op, placement, ts`` (seconds).

    ``epoch`` counts the accepted transitions of the partition, so it grows with every one.
    """

    def run(held: Iterator[tuple]):
        epoch = 0
        rows, events = itertools.tee(held)
        for row, (phase, _, read, write, error) in zip(rows, transitions((r[2:] for r in events), barrier_s), strict=True):
            epoch += error is None
            yield phase, read, write, error, row[0], row[1], epoch

    rows = log.select("partition", F.col("seq").cast("long"), "op", "placement", F.col("ts").cast("long"))
    return folded(rows, ["partition"], ["seq"], run, "phase string, read string, write string, error string, partition string, seq long, epoch long")


def barrier_passed(cutover: Column, now: Column, barrier_s: int = BARRIER_S) -> Column:
    return F.coalesce(now - cutover >= barrier_s, F.lit(False))


def breaker_states(calls: DataFrame, threshold: int = FAILURES, cooldown_s: int = COOLDOWN_S) -> DataFrame:
    """Adds ``allowed`` and ``failures`` to ``cluster, seq, ts, ok``, where a refused call counts as none.

    Opens after ``threshold`` failures in a row; after the cooldown a call is let through, and its outcome
    closes the breaker or starts the cooldown again.
    """

    def run(held: Iterator[tuple]):
        failures, opened = 0, None
        for row in held:
            _, _, ts, ok = row
            may = opened is None or max(0, ts - opened) >= cooldown_s
            if may and ok:
                failures, opened = 0, None
            elif may:
                failures += 1
                opened = ts if failures >= threshold else opened
            yield *row, may, failures

    rows = calls.select("cluster", F.col("seq").cast("long"), F.col("ts").cast("long"), "ok")
    return folded(rows, ["cluster"], ["seq"], run, "cluster string, seq long, ts long, ok boolean, allowed boolean, failures long")


def failure_runs(calls: DataFrame) -> DataFrame:
    """Adds ``run``: failures in a row up to and with this call, per cluster. Two running totals, as nothing resets but success."""
    held = with_running(calls, ["cluster"], "seq", F.when(F.col("ok"), 1).otherwise(0), "_b")
    return with_running(held, ["cluster", "_b"], "seq", F.when(F.col("ok"), 0).otherwise(1), "run").drop("_b")


def in_flight(events: DataFrame, ceiling: int = IN_FLIGHT) -> DataFrame:
    """Adds ``held`` (bytes reserved less released so far, per listener) and ``over`` to ``listener, seq, delta``."""
    return with_running(events, ["listener"], "seq", F.col("delta"), "held").withColumn("over", F.col("held") > ceiling)


def admission(requests: DataFrame, ceiling: int = IN_FLIGHT, body_cap: int = BODY) -> DataFrame:
    """Adds ``error`` to ``listener, seq, kind (reserve or release), ref, bytes``.

    A body above the cap is ``payload_too_large``; one that does not fit under the ceiling is ``overloaded``
    and holds nothing; a release returns what its ``ref`` holds.
    """

    def run(held: Iterator[tuple]):
        in_use, total = {}, 0
        for row in held:
            _, _, kind, ref, size = row
            error = None
            if kind == "release":
                total -= in_use.pop(ref, 0)
            elif size > body_cap:
                error = "payload_too_large"
            elif total + size > ceiling:
                error = "overloaded"
            else:
                in_use[ref] = size
                total += size
            yield *row, error

    rows = requests.select("listener", F.col("seq").cast("long"), "kind", "ref", F.col("bytes").cast("long"))
    return folded(rows, ["listener"], ["seq"], run, "listener string, seq long, kind string, ref string, bytes long, error string")
