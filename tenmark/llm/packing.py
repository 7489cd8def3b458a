"""Best-fit packing of token sequences by exact-complement hashing.

Three steps. ``pieces`` tokenises each text once and keeps, for each piece, its length and the CRC of its
ids. ``plan`` sees only how many pieces have each length, at most ``capacity`` numbers however large the
corpus is, and returns slots: pieces number ``first`` to ``first + many - 1`` of a length go to sequences
``sequence`` onwards at ``offset``. ``packed`` numbers the pieces of a length by salted counts, so that no
task ever holds a whole length, and looks each number up among the slots.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts, written
from .wordbpe import segmenter


class Slot(NamedTuple):
    length: int
    first: int
    many: int
    sequence: int
    offset: int


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end: int = 1, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Rows ``(id, piece, start, length, ids_crc32)``: texts as ids with ``end`` appended, cut every ``capacity`` ids."""
    kind = docs.schema[id_column].dataType.simpleString()
    width, tail = 4 * capacity, int(end).to_bytes(4, "little")

    def run(it):
        ids = segmenter(vocabulary).ids
        for b in it:
            at, piece, start, length, crc = [], [], [], [], []
            found = texts(b.column(1))
            for i, own in enumerate(ids(found)):
                packed = own + tail
                for k, lo in enumerate(range(0, len(packed), width)):
                    part = packed[lo : lo + width]
                    at.append(i)
                    piece.append(k)
                    start.append(lo // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=[id_column, "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(id_column, docs[text].cast("string").alias("text")).mapInArrow(run, f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long")


class _Lengths:
    """How many pieces of each length are left, and an index of the sums of one, two and three lengths.

    The index tells for every gap whether lengths that were left when it was built fill it exactly. Using
    lengths up can only make it claim too much; it is built anew when a claim does not hold.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self._index()

    def _index(self) -> None:
        """Sums as bits of whole numbers: shifting the pair sums by each length gives the triple sums, and so on."""
        every = (1 << (self.capacity + 1)) - 1
        lengths = np.flatnonzero(self.left).tolist()
        one = sum(1 << x for x in lengths)
        sums = [one]
        for _ in range(2):
            more = 0
            for x in lengths:
                more |= sums[-1] << x
            sums.append(more & every)
        size = self.capacity // 8 + 1
        self.single, self.double, self.triple = (np.unpackbits(np.frombuffer(x.to_bytes(size, "little"), np.uint8), bitorder="little") > 0 for x in sums)

    def largest(self, most: int) -> int:
        there = np.flatnonzero(self.left[1 : most + 1])
        return int(there[-1]) + 1 if len(there) else 0

    def pair(self, gap: int, held: tuple[int, ...]) -> tuple[int, ...]:
        """Two lengths that sum to ``gap`` beside those ``held``, the most uneven first."""
        left = self.left
        if held:
            left = left.copy()
            np.subtract.at(left, list(held), 1)
        low = np.arange(1, gap // 2 + 1)
        fits = low[(left[low] > 0) & (left[gap - low] > (2 * low == gap))]
        return (gap - int(fits[0]), int(fits[0])) if len(fits) else ()

    def _three(self, gap: int, held: tuple[int, ...]) -> tuple[int, ...]:
        there = np.flatnonzero(self.left[: gap - 1])
        for a in there[self.double[gap - there]][::-1].tolist():
            if 3 * a < gap:
                break
            if self.left[a] > held.count(a) and (rest := self.pair(gap - a, (*held, a))):
                return (a, *rest)
        return ()

    def complement(self, gap: int, held: tuple[int, ...]) -> tuple[int, ...]:
        """One, two or three lengths that are left beside those ``held`` and sum to ``gap`` exactly, or none."""
        if self.left[gap] > held.count(gap):
            return (gap,)
        stale = False
        for sums, find in ((self.double, self.pair), (self.triple, self._three)):
            if sums[gap]:
                if found := find(gap, held):
                    return found
                stale = True
        if stale and self.single[: self.capacity + 1][self.left == 0].any():  # lengths of the index are used up
            self._index()
        return ()


def plan(counts: dict[int, int], capacity: int = 4096) -> list[Slot]:
    """Slots for ``counts`` pieces of each length.

    Takes the largest length left, completes its gap by an exact single, pair or triple, and repeats that
    combination as often as the counts allow. A gap without one takes the largest length that fits (best
    fit) and is looked up again. A combination uses up a length, so their number is bounded by
    ``capacity`` and not by the pieces.
    """
    lengths, used, slots, sequence = _Lengths(counts, capacity), {}, [], 0
    while top := lengths.largest(capacity):
        bin_, gap = (top,), capacity - top
        while gap:
            if more := lengths.complement(gap, bin_):
                bin_, gap = bin_ + more, 0
                break
            fit = lengths.largest(gap)
            while fit and lengths.left[fit] <= bin_.count(fit):
                fit = lengths.largest(fit - 1)
            if not fit:
                break
            bin_, gap = (*bin_, fit), gap - fit
        many = min(int(lengths.left[x]) // bin_.count(x) for x in set(bin_))
        offset = 0
        for x in bin_:
            slots.append(Slot(x, used.get(x, 0), many, sequence, offset))
            used[x] = used.get(x, 0) + many
            lengths.left[x] -= many
            offset += x
        sequence += many
    return slots


def packed(found: DataFrame, capacity: int = 4096, id_column: str = "doc_id") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows of ``pieces`` (a written table, as it is read three times)."""
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    slots = sorted(plan(histogram, capacity))
    keys = np.array([(s.length << 44) | s.first for s in slots], np.int64)
    first, sequence, offset = (np.array([s[k] for s in slots], np.int64) for k in (1, 3, 4))
    salts = int(min(4096, max(64, sum(histogram.values()) // 100_000)))

    salted = found.withColumn("salt", F.pmod(F.xxhash64(id_column, "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "salt").orderBy(id_column, "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within)).join(bases, ["length", "salt"])
    names = [id_column, "piece", "start", "length", "ids_crc32"]
    kind = found.schema[id_column].dataType.simpleString()

    def run(it):
        for b in it:
            k = (b.column("length").to_numpy() << 44) | b.column("number").to_numpy()
            at = np.searchsorted(keys, k, "right") - 1
            number = b.column("number").to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(sequence[at] + number - first[at]), pa.array(offset[at])], names=[*names, "sequence_id", "offset"])

    numbered = ranked.select(*names, (F.col("base") + F.col("rank") - 1).cast("long").alias("number"))
    return numbered.mapInArrow(run, f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, vocabulary: str, capacity: int = 4096, end: int = 1, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Packs every text into sequences of at most ``capacity`` ids, few of them.

    Returns one row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``,
    ``offset``. A null or empty text is the single id ``end``. Repeated rows are packed each; a null id is
    kept; other columns are dropped. An empty table gives no row.
    """
    return packed(written(pieces(docs, vocabulary, capacity, end, text, id_column), "pieces"), capacity, id_column)
