"""Quality scores by a sparse rule ensemble.

Statistics of each whole text come from one pass over its bytes. On a bounded sample of labelled rows, small
boosted trees are grown over them; every path from a root to a node becomes a conjunctive rule; a logistic
regression with an L1 penalty keeps few of the rules. The rules and their weights are compiled into one
Spark column, so scoring is an expression over the statistics.
"""

from __future__ import annotations

from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

STATISTICS = ("log_bytes", "upper", "digit", "symbol", "bang", "bar", "stop", "space", "line", "other", "word_bytes", "line_bytes", "long_words", "distinct", "again")
PIECE = 1 << 20
_UPPER, _LOWER, _DIGIT, _SYMBOL, _BANG, _BAR, _STOP, _SPACE, _LINE, _OTHER, _REST = range(11)


def _classes() -> np.ndarray:
    table = np.full(256, _REST, np.uint8)
    for chars, kind in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"abcdefghijklmnopqrstuvwxyz", _LOWER), (b"0123456789", _DIGIT), (b"#$%&*@^~=+<>{}[]\\_", _SYMBOL), (b"!", _BANG), (b"|", _BAR), (b".,;:?", _STOP), (b" \t", _SPACE), (b"\n\r\v\f", _LINE)):
        table[list(chars)] = kind
    table[128:] = _OTHER
    return table


_TABLE = _classes()
_BLANK = np.isin(_TABLE, (_SPACE, _LINE))


def statistics(found: list[str]) -> np.ndarray:
    """A row of ``STATISTICS`` for each text."""
    out = np.zeros((len(found), len(STATISTICS)))
    for row, text in zip(out, found, strict=True):
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        n, words, long, blank, run = np.zeros(11, np.int64), 0, 0, True, 0
        for lo in range(0, len(data), PIECE):
            part = data[lo : lo + PIECE]
            n += np.bincount(_TABLE[part], minlength=11)
            is_blank = _BLANK[part]
            begins = np.flatnonzero(~is_blank & np.r_[blank, is_blank[:-1]])
            words += len(begins)
            gaps = np.flatnonzero(is_blank)
            lengths = np.diff(np.r_[-1 - run, gaps, len(part)]) - 1
            long += int((lengths[:-1] > 20).sum())
            run, blank = int(lengths[-1]), bool(is_blank[-1])
        long += run > 20
        own = text.split()
        pairs = max(1, len(own) - 1)
        size, letters = len(data), n[_UPPER] + n[_LOWER] + n[_OTHER]
        lines = n[_LINE] + 1
        share = lambda k: n[k] / max(1, size)
        row[:] = (np.log1p(size), n[_UPPER] / max(1, letters), share(_DIGIT), share(_SYMBOL), share(_BANG), share(_BAR), share(_STOP), share(_SPACE), share(_LINE), share(_OTHER), (size - n[_SPACE] - n[_LINE]) / max(1, words), size / lines, long / max(1, words), len(set(own)) / max(1, len(own)), sum(map(eq, own, own[1:])) / pairs)
    return out


class Rule(NamedTuple):
    """Conditions ``(statistic, upper bound?, threshold)`` that all hold."""

    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, below, t in self.conditions:
            out &= x[:, k] <= t if below else x[:, k] > t
        return out


class Ensemble(NamedTuple):
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float


def _tree(x, residual, weight, rng, depth: int, least: int = 10):
    """Paths of a regression tree and its fitted values."""
    paths, value = [], np.zeros(len(x))

    def grow(rows, conditions):
        value[rows] = np.average(residual[rows], weights=weight[rows])
        if conditions:
            paths.append(Rule(tuple(conditions)))
        if len(conditions) >= depth or len(rows) < 2 * least:
            return
        best = (1e-9, None, None)
        for k in rng.choice(x.shape[1], size=max(3, x.shape[1] // 2), replace=False):
            own = x[rows, k]
            order = np.argsort(own, kind="stable")
            v, w, r = own[order], weight[rows][order], residual[rows][order]
            cw, cr = np.cumsum(w), np.cumsum(w * r)
            cut = np.flatnonzero(v[1:] > v[:-1])
            cut = cut[(cut >= least - 1) & (cut < len(v) - least)]
            if not len(cut):
                continue
            left, right = cw[cut], cw[-1] - cw[cut]
            gain = cr[cut] ** 2 / left + (cr[-1] - cr[cut]) ** 2 / right - cr[-1] ** 2 / cw[-1]
            g = int(gain.argmax())
            if gain[g] > best[0]:
                best = (gain[g], int(k), float((v[cut[g]] + v[cut[g] + 1]) / 2))
        if best[1] is None:
            return
        _, k, t = best
        below = x[rows, k] <= t
        grow(rows[below], [*conditions, (k, True, t)])
        grow(rows[~below], [*conditions, (k, False, t)])

    grow(np.arange(len(x)), [])
    return paths, value


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 1e-3, steps: int = 800, seed: int = 11) -> Ensemble:
    """Rules from boosted trees, weights by a logistic lasso (accelerated proximal gradient)."""
    if len(y) == 0 or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
        return Ensemble((), (), float(np.log(p / (1 - p))))
    rng, weight = np.random.default_rng(seed), weight / weight.sum()
    prior = float((weight * y).sum())
    bias = float(np.log(prior / (1 - prior)))
    f, found = np.full(len(y), bias), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        rows = rng.permutation(len(y))[: max(20, 2 * len(y) // 3)]
        paths, _ = _tree(x[rows], (y - p)[rows], weight[rows], rng, depth)
        leaves = [r for r in paths if not any(o.conditions[: len(r.conditions)] == r.conditions and o is not r for o in paths)]
        for r in leaves:
            on = r.holds(x)
            h = (weight * p * (1 - p))[on].sum() + 1e-6
            f[on] += rate * np.clip((weight * (y - p))[on].sum() / h, -4, 4)
        for r in paths:
            on = r.holds(x)
            found.setdefault(np.packbits(on).tobytes(), (r, on))
    rules = [r for r, on in found.values() if 0 < on.sum() < len(y)]
    a = np.array([on for _, on in found.values() if 0 < on.sum() < len(y)], np.float64).T.reshape(len(y), len(rules))
    w, b, v, c, t = np.zeros(len(rules)), bias, np.zeros(len(rules)), bias, 1.0
    step = 4.0 / (1 + (weight[:, None] * a * a).sum())
    for _ in range(steps):
        g = weight * (1 / (1 + np.exp(-(a @ v + c))) - y)
        new = v - step * (a.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = c - step * g.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return Ensemble(tuple(rules[k] for k in kept), tuple(float(w[k]) for k in kept), float(b))


def compiled(model: Ensemble, column=F.col) -> Column:
    """The ensemble's probability as an expression over columns named as ``STATISTICS``."""
    total = F.lit(model.bias)
    for rule, w in zip(model.rules, model.weights, strict=True):
        on = F.lit(True)
        for k, below, t in rule.conditions:
            on = on & ((column(STATISTICS[k]) <= t) if below else (column(STATISTICS[k]) > t))
        total = total + F.when(on, F.lit(w)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", text: str = "text", id_column: str = "doc_id", per_label: int = 2000) -> Ensemble:
    """An ensemble from at most about ``per_label`` rows of each label among those where ``train`` holds.

    Each class weighs as in all labelled rows. Null labels and other values than 0 and 1 are left out.
    """
    known = labels.filter(train & F.col(label).isin(0, 1)).select(F.col(id_column).alias("key"), F.col(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, per_label / n))).otherwise(share)
    unit = F.pmod(F.xxhash64("key", F.lit("quality")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.filter(unit < share).orderBy(F.xxhash64("key"), "y").limit(4 * per_label)
    rows = docs.select(F.col(id_column).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key").orderBy(F.xxhash64("key"), "y", "text").limit(4 * per_label)
    found = with_statistics(rows, "text").select("y", *STATISTICS).collect()
    y = np.array([r["y"] for r in found], np.float64)
    x = np.array([r[1:] for r in found], np.float64).reshape(len(found), len(STATISTICS))
    drawn = {v: max(1, int((y == v).sum())) for v in counts}
    return fit(x, y, np.array([counts[int(v)] / drawn[int(v)] for v in y]))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the text by its ``STATISTICS``; other columns stay. A null text counts as empty."""
    position = docs.columns.index(text)
    rest = [k for k in range(len(docs.columns)) if k != position]
    fields = [f"`{docs.schema[k].name}` {docs.schema[k].dataType.simpleString()}" for k in rest] + [f"{s} double" for s in STATISTICS]

    def run(it):
        for b in it:
            x = statistics(texts(b.column(position)))
            yield pa.RecordBatch.from_arrays([b.column(k) for k in rest] + [pa.array(c) for c in np.ascontiguousarray(x.T)], names=[b.schema.names[k] for k in rest] + list(STATISTICS))

    return docs.mapInArrow(run, ", ".join(fields))


def quality_scores(docs: DataFrame, model: Ensemble, held_out: Column, least: float = 0.7, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per document: id, ``held_out``, ``score`` and ``predicted`` (score >= ``least``).

    Null and empty texts are scored like any other; repeated rows each; other columns are dropped.
    """
    kept = docs.select(F.col(id_column), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    return with_statistics(kept).select(id_column, "held_out", compiled(model).alias("score")).withColumn("predicted", (F.col("score") >= least).cast("int"))
