"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

IDF is counted over all labelled rows. Fitting takes at most about ``per_language`` of them of each language,
chosen by a hash of the row; weights and temperature come from that sample alone. Weights are trained by follow-the-regularised-leader
with elastic-net penalties, then one temperature is set on a fifth of the sample that training has not seen.

A text's features are hashed n-grams of its lower-cased letters (characters of Unicode's letter categories; digits,
other numbers, marks and symbols are one space), as shares of
all its n-grams times IDF. The logits are therefore a mean over positions, so whole texts of any length are
scored piece by piece in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import resident, slices, texts, unused

BITS = 16
ORDERS = (1, 2, 3)
PIECE = 1 << 18
_OTHER = regex.compile(r"\P{L}+")


class Model(NamedTuple):
    classes: tuple[str, ...]
    table: np.ndarray  # a row of logits' shares for each hashed n-gram, IDF and temperature included
    temperature: float


def _letters(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def _codes(run: np.ndarray):
    """Hashed n-grams of code points, one array for each order."""
    x = run.astype(np.uint64)
    h = np.zeros(len(x), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(x) < n:
            return
        h = (h[: len(x) - n + 1] + x[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in ORDERS:
            yield (h >> np.uint64(64 - BITS)).astype(np.int64)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def _pieces(points: np.ndarray):
    """Overlapping cuts that give every n-gram of each order once."""
    for lo in range(0, len(points), PIECE):
        for n, codes in zip(ORDERS, _codes(points[lo : lo + PIECE + max(ORDERS) - 1]), strict=False):
            yield codes[: max(0, min(PIECE, len(points) - n + 1 - lo))]


def _shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    found = np.concatenate([*_pieces(_points(_letters(text))), np.empty(0, np.int64)])
    codes, n = np.unique(found, return_counts=True)
    return codes, n / max(1, n.sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, str]], epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 2e-4, l2: float = 1e-3, scale: float = 30.0, seed: int = 7, frequencies: tuple[np.ndarray, int] | None = None) -> Model:
    """A model from ``(text, language)`` rows; rows without letters are left out. Needs at least one row.

    ``frequencies``: how many texts have each hashed n-gram, and of how many; if left out, ``rows`` are counted.
    """
    rows = [(t, c) for t, c in rows if t and c is not None and _letters(t)]
    classes = tuple(sorted({c for _, c in rows})) or ("und",)
    at = {c: k for k, c in enumerate(classes)}
    feats = [(*_shares(t), at[c]) for t, c in rows]
    seen, whole = frequencies or (np.zeros(1 << BITS), len(feats))
    if frequencies is None:
        for codes, _, _ in feats:
            seen[codes] += 1
    idf = np.log((1 + whole) / (1 + seen)) + 1
    order = np.random.default_rng(seed).permutation(len(feats))
    held, used = (order[: len(order) // 5], order[len(order) // 5 :]) if len(order) >= 10 else (order, order)
    z, n = np.zeros((1 << BITS, len(classes))), np.zeros((1 << BITS, len(classes)))

    def weights(k):
        own = z[k]
        return np.where(np.abs(own) > l1, -(own - np.sign(own) * l1) / ((beta + np.sqrt(n[k])) / alpha + l2), 0.0)

    for epoch in range(epochs):
        for k in np.random.default_rng(seed + epoch).permutation(used):
            codes, share, c = feats[k]
            x, w = share * idf[codes] * scale, weights(codes)
            p = _softmax(x @ w)
            p[c] -= 1
            g = np.outer(x, p)
            sigma = (np.sqrt(n[codes] + g * g) - np.sqrt(n[codes])) / alpha
            z[codes] += g - sigma * w
            n[codes] += g * g
    table = weights(slice(None)) * idf[:, None] * scale
    logits = np.array([share @ table[codes] for k in held for codes, share, _ in [feats[k]]]).reshape(len(held), len(classes))
    gold = np.array([feats[k][2] for k in held], np.int64)
    loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(gold)), gold] + 1e-12).mean() if len(gold) else 0.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 241))
    temperature = float(grid[int(np.argmin([loss(t) for t in grid]))])
    return Model(classes, (table / temperature).astype(np.float32), temperature)


def predict(model: Model, found: list[str]) -> tuple[list[str], np.ndarray]:
    """Class and probability of each text; ``und`` and 0 without a letter."""
    logits = np.zeros((len(found), len(model.classes)))
    letters = [_letters(t) for t in found]
    lo = 0
    while lo < len(found):
        hi, size = lo, 0
        while hi < len(found) and (hi == lo or size + len(letters[hi]) <= PIECE):
            size += len(letters[hi]) + 2
            hi += 1
        if hi == lo + 1:
            total, n = np.zeros(len(model.classes)), 0
            for codes in _pieces(_points(letters[lo])):
                total += model.table[codes].sum(axis=0)
                n += len(codes)
            logits[lo] = total / max(1, n)
        else:
            runs = [_points(t) for t in letters[lo:hi]]
            lengths = np.array([len(r) for r in runs])
            starts = np.r_[0, np.cumsum(lengths)[:-1]]
            joined = np.concatenate(runs)
            total, n = np.zeros((hi - lo, len(model.classes))), np.zeros(hi - lo)
            for order, codes in zip(ORDERS, _codes(joined), strict=False):
                sums = np.concatenate([np.zeros((1, len(model.classes))), np.cumsum(model.table[codes], axis=0, dtype=np.float64)])
                own = np.maximum(lengths - order + 1, 0)
                total += sums[starts + own] - sums[starts]
                n += own
            logits[lo:hi] = total / np.maximum(1, n)[:, None]
        lo = hi
    p = _softmax(logits)
    best = p.argmax(axis=1)
    names = [model.classes[b] if t else "und" for b, t in zip(best, letters, strict=True)]
    return names, np.where([bool(t) for t in letters], p.max(axis=1), 0.0)


def sample(rows: DataFrame, label: str, per_class: int, key: Column) -> list:
    """About ``per_class`` rows of each value of ``label``, all of them where there are fewer; by a hash of ``key``."""
    counts = {r[label]: r["n"] for r in rows.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == value, F.lit(min(1.0, per_class / n))).otherwise(share)
    unit = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.filter(F.col(label).isNotNull() & (unit < share))
    return chosen.orderBy(F.xxhash64(key), "text").limit(2 * per_class * max(1, len(counts))).collect()


def _once(t: str):
    """The distinct hashed n-grams of a long text."""
    own = np.zeros(1 << BITS, bool)
    for codes in _pieces(_points(t)):
        own[codes] = True
    yield np.flatnonzero(own)


def document_frequencies(rows: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """How many texts of ``rows`` have each hashed n-gram, and how many have letters: one vector per task, added up by blocks."""
    block = 1 << 12

    def count(it):
        resident("language")
        seen, n = np.zeros(1 << BITS, np.int64), 0
        for part in (part for b in it for part in slices(b)):
            for t in map(_letters, texts(part.column(0))):
                if t:
                    for codes in [np.unique(np.concatenate([*_pieces(_points(t))]))] if len(t) <= PIECE else _once(t):
                        seen[codes] += 1
                    n += 1
        if n:
            parts = [seen[k : k + block] for k in range(0, len(seen), block)] + [np.array([n])]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "counts"])

    def add(it):
        held: dict[int, np.ndarray] = {}
        for b in it:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(data, np.int64)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    found = rows.select(text).mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect()  # 17 rows, 512 KB
    seen, n = np.zeros(1 << BITS, np.int64), 0
    for r in found:
        own = np.frombuffer(r["counts"], np.int64)
        if r["block"] * block == len(seen):
            n = int(own[0])
        else:
            seen[r["block"] * block : (r["block"] + 1) * block] = own
    return seen, n


def fit_languages(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", id_column: str = "doc_id", per_language: int = 600) -> Model:
    """A model from the rows of ``docs`` where ``train`` holds."""
    rows = docs.filter(train).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(id_column).cast("string").alias("key")).filter("text IS NOT NULL")
    chosen = sample(rows, "lang", per_language, F.coalesce("key", F.lit("")))
    return fit([(r["text"], r["lang"]) for r in chosen], frequencies=document_frequencies(rows.filter("lang IS NOT NULL")))


def scored(model: Model, text: Column) -> Column:
    """``lang_pred`` and ``score`` of a text. Only the text goes to Python, and only these two come back."""
    sent = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        resident("language")
        for b in batches:
            pred, score = [], []
            for lo in range(0, len(b), 512):
                names, p = predict(sent.value, texts(b.slice(lo, 512)))
                pred += names
                score.append(p)
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(np.concatenate([*score, np.empty(0)]), pa.float64())], names=["lang_pred", "score"])

    return of(text)


def with_language(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the language of each whole text and its probability; other columns stay, but for any of these names.

    A null, empty or letterless text is ``und`` with score 0.
    """
    (whole,) = unused(docs.columns, "_language")
    taken = {n.lower() for n in names}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]
    both = docs.withColumn(whole, scored(model, F.col(text).cast("string")))
    return both.select(*kept, F.col(whole)["lang_pred"].alias(names[0]), F.col(whole)["score"].alias(names[1]))


def languages(docs: DataFrame, model: Model, held_out: Column, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per document: id, ``held_out``, ``lang_pred`` and ``score``."""
    kept = docs.select(F.col(id_column), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    return with_language(kept, model).drop("text")


def identified(docs: DataFrame, model: Model, least: float = 0.35, text: str = "text") -> DataFrame:
    """The documents whose language is known with at least ``least`` probability; columns as they were."""
    found = scored(model, F.col(text).cast("string"))
    return docs.filter((found["lang_pred"] != "und") & (found["score"] >= least))
