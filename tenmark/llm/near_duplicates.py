"""N-gram Jaccard join and the groups that its links connect; exact.

1. Each text becomes a set of word shingles. Equal sets are one class from here on, so exact copies cost one
   row each and are never paired.
2. Two sets that link share a shingle among the first ``n - ceil(t * n) + 1`` of each, in any one order of
   all shingles. The order is by frequency, rare first, so that passages which many documents share seldom
   route anything. Frequencies are counted over the whole corpus in a sketch of fixed size; its errors change
   the order for all documents alike and no result.
3. Sizes of sets that link differ by a factor of t at most. Each class is in the size band of its own and the
   next one, so such sets share a band. Classes with a shingle and a band in common form a group; groups with
   the same members are one.
4. Prefixes are kept a little longer than needed, so sets that link must share more than one shingle of them.
   In each group a T-occurrence search (DivideSkip, see ``shingles``) over the prefixes finds candidates. This
   looks at a tenth or a fifth of a text in 32-bit values and clears nearly all that one passage has brought
   together. Only pairs that connect something are put out.
5. Classes that candidates connect form a bucket. There the same search over the whole sets finds links. For
   components alone, links that connect are enough, at most one per class; where links are counted, every link
   is verified and added up in its task, so that rows stay in proportion to classes and not to links.
6. A group or bucket beyond ``BUCKET`` classes or ``BUCKET_SHINGLES`` shingles is dealt into chunks and every
   two chunks meet in a task of their own, so no task holds one of any size and no pair is lost.
7. Components by least label with pointer jumping; each round is a written table.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, discard, raw, resident, slices, small, small_batches, unused, written
from .shingles import candidates, counted_links, digest, least_overlap, links, shingle_runs, shingle_sets, spare

SKETCH_BITS = 21
_BLOCK = 1 << 14
BUCKET = 1024
BUCKET_SHINGLES = 400_000


def _levels(rows: DataFrame, size: int) -> np.ndarray:
    """How frequent each sketch counter's shingles are, in half powers of two: 2 MB whatever the input."""

    def count(it):
        resident("shingles")
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in it:
            for part in slices(b):
                for h in shingle_runs(raw(part.column(0)), size):
                    np.add.at(total, h >> np.uint64(64 - SKETCH_BITS), 1)
        for k in range(0, len(total), _BLOCK):
            part = total[k : k + _BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // _BLOCK], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["block", "counts"])

    def add(it):
        held: dict[int, np.ndarray] = {}
        for b in it:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(zlib.decompress(data), np.uint32).astype(np.uint64)
        for k, total in held.items():
            level = np.floor(2 * np.log2(np.maximum(total, 1))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in rows.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect():  # at most 128 rows of 16 KB
        levels[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["counts"], np.uint8)
    return levels


def _signed(rows: DataFrame, size: int, percent: int, id_column: str) -> DataFrame:
    """``id, th, n, node, prefix, more``: the set's size and name, the shingles by which it is routed, and some after them."""
    spark = rows.sparkSession
    kind = rows.schema[id_column].dataType.simpleString()
    sent = spark.sparkContext.broadcast(_levels(rows, size))

    def run(it):
        resident("shingles")
        levels = sent.value
        for part in (part for b in it for part in slices(b)):
            n, node, first, more = [], [], [], []
            for s in shingle_sets(raw(part.column(2)), size):
                n.append(len(s))
                node.append(digest(s) if len(s) else None)
                most = len(s) - least_overlap(len(s), percent) + 1 if len(s) else 0
                level = levels[s >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64)
                order = np.argsort((level << np.uint64(56)) | (s >> np.uint64(8)), kind="stable")
                first.append(s[order[:most]].view(np.int64))
                more.append((s[order[most : most + spare(len(s), percent)]] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(node, pa.binary()), _lists(first, np.int64), _lists(more, np.int32)], names=[id_column, "th", "n", "node", "prefix", "more"])

    return written(rows.select(id_column, "th", "text").mapInArrow(run, f"`{id_column}` {kind}, th long, n long, node binary, prefix array<long>, more array<int>"), "signed")


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    values = np.concatenate(parts) if parts else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)), pa.array(values.astype(kind)))


def _groups(signed: DataFrame, percent: int) -> DataFrame:
    """``bucket, nid, n``: classes that share a shingle of their prefixes and a size band, groups of one set once.

    ``nid`` is a class's name as 64 bits. Two classes of one name would be looked at together, and no harm.
    """
    post = signed.select(F.explode("prefix").alias("token"), "nid", F.col("n").cast("int").alias("n"))
    shared = written(post.groupBy("token").agg(F.min("nid").alias("lo"), F.max("nid").alias("hi")).filter("lo < hi").select("token"), "shared")
    band = F.floor(F.log(F.col("n").cast("double")) / -math.log(percent / 100) + 1e-9).cast("int") if percent < 100 else F.col("n")
    placed = post.join(small(shared, 48), "token").select(F.explode(F.array(band, band + 1)).alias("band"), "token", "nid", "n")
    placed = written(placed.select(F.xxhash64("token", "band").alias("token"), "nid", "n").distinct(), "placed")
    same = placed.groupBy("token").agg(F.count("*").alias("c"), F.bit_xor("nid").alias("x")).filter("c > 1").groupBy("c", "x").agg(F.min("token").alias("token"))
    groups = written(placed.join(same.select("token"), "token").withColumnRenamed("token", "bucket"), "groups")
    discard(shared, placed)
    return groups


def _dealt(members: DataFrame) -> DataFrame:
    """``bucket, q, i, j, nid``: every two chunks ``i <= j`` of a bucket are a task; ``q`` is a row's own chunk."""
    chunks = F.greatest(F.ceil(F.col("c") / BUCKET), F.ceil(F.col("shingles") / BUCKET_SHINGLES)).cast("int")
    sizes = members.groupBy("bucket").agg(F.count("*").alias("c"), F.sum("n").alias("shingles")).select("bucket", chunks.alias("chunks")).filter("chunks > 1")
    large = written(sizes, "large")  # few, so members need not be dealt by bucket, which one bucket can fill
    own = members.join(small(large, 64), "bucket", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = own.withColumn("q", F.pmod(F.xxhash64("nid"), F.col("chunks")).cast("int"))
    own = own.select("bucket", "q", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o"), "nid")
    return own.select("bucket", "q", F.least("q", "o").alias("i"), F.greatest("q", "o").alias("j"), "nid")


def _first_rows(rows: DataFrame, classes: DataFrame, members: DataFrame, id_column: str, columns: list[str]) -> DataFrame:
    """``nid, node, m`` and ``columns`` of one row of ``rows`` for each class in ``members``."""
    wanted = classes.join(members.select("nid").distinct(), "nid", "left_semi").select("nid", "node", "m", F.col("first._id").alias("_id"), F.col("first._th").alias("_th"))
    wanted = written(wanted, "wanted")
    match = (F.col("th") == F.col("_th")) & F.col(id_column).eqNullSafe(F.col("_id"))
    own = rows.select(F.col(id_column), "th", *columns)
    return own.join(small(wanted, 112), match).select("nid", F.col("node"), "m", *columns)


def _values(column: pa.Array) -> list:
    """Python values; lists as arrays of their own, texts as UTF-8."""
    if pa.types.is_list(column.type):
        flat, at = column.values.to_numpy(), column.offsets.to_pylist()
        return [flat[lo:hi].copy() for lo, hi in zip(at, at[1:], strict=False)]
    return raw(column) if pa.types.is_string(column.type) else column.to_pylist()


def _in_tasks(dealt: DataFrame, found: DataFrame, columns: list[str], search, kind: str) -> DataFrame:
    """Pairs ``(a, b)`` that ``search(rows, split)`` finds in each task, read as a stream of sorted rows; ``n`` is summed."""
    # no hint: what is found has no bound
    both = dealt.join(found, "nid").select("bucket", "i", "j", "q", *columns).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    own = pa.binary() if kind == "binary" else pa.int64()
    schema = pa.schema([("a", own), ("b", own), ("n", pa.int64())])

    def run(it):
        resident("shingles")

        def pairs():
            last, held = None, []
            for b in it:
                for bucket, i, j, *row in (row for part in slices(b) for row in zip(*map(_values, part.columns), strict=True)):
                    if (bucket, i, j) != last:
                        if len(held) > 1:
                            yield from search(held, last[1] != last[2])
                        last, held = (bucket, i, j), []
                    held.append(row)
            if len(held) > 1:
                yield from search(held, last[1] != last[2])

        yield from batches(pairs(), schema)

    return both.mapInArrow(run, f"a {kind}, b {kind}, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _links(rows: DataFrame, signed: DataFrame, classes: DataFrame, percent: int, size: int, id_column: str, counted: bool) -> DataFrame:
    """Rows ``(a, b, n)``: links between classes that connect all that links connect.

    If ``counted``, also ``(a, a, n)``: the documents of other classes that those of ``a`` link with, if any.
    """
    groups = _groups(signed.select("nid", "n", "prefix"), percent)
    short = F.concat(F.transform("prefix", lambda x: F.shiftright(x, 32).cast("int")), F.col("more"))
    prefixes = _first_rows(signed.drop("nid", "node").withColumn("short", short), classes, groups, id_column, ["n", "short"])

    def may_link(held: list[list], split: bool):
        held.sort(key=lambda r: r[2])
        sets = [np.unique(r[3]) for r in held]
        lost = np.array([len(r[3]) - len(s) for r, s in zip(held, sets, strict=True)])
        side = np.array([r[0] for r in held]) if split else None
        for x, y in candidates(sets, lost, np.array([r[2] for r in held], np.int64), percent, side):
            if held[x][1] != held[y][1]:
                yield held[x][1], held[y][1], 0

    near = written(_in_tasks(_dealt(groups), prefixes, ["nid", "n", "short"], may_link, "long"), "near")
    buckets = components(near).select(F.col("label").alias("bucket"), F.col("node").alias("nid")).join(classes.select("nid", "n").groupBy("nid").agg(F.max("n").alias("n")), "nid")
    buckets = written(buckets, "buckets")
    discard(groups, near)
    found = _first_rows(rows, classes, buckets, id_column, ["text"])

    def do_link(held: list[list], split: bool):
        sets, first = shingle_sets([r[3] for r in held], size), {}
        for k, s in enumerate(sets):
            if digest(s) == held[k][1]:
                first.setdefault(held[k][1], k)  # repeated rows
        order = sorted(first.values(), key=lambda k: len(sets[k]))
        side = np.array([held[k][0] for k in order]) if split else None
        sets = [sets[k] for k in order]
        if counted:
            pairs, total = counted_links(sets, np.array([held[k][2] for k in order], np.int64), percent, side)
            yield from ((held[k][1], held[k][1], n) for k, n in zip(order, total.tolist(), strict=True) if n)
        else:
            pairs = links(sets, percent, side)
        for x, y in pairs:
            yield held[order[x]][1], held[order[y]][1], 0

    return written(_in_tasks(_dealt(buckets), found, ["node", "m", "text"], do_link, "binary"), "links")


def components(pairs: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``pairs (a, b)``: the least node that it is connected with."""
    edges = written(pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        step = written(step, "step")
        if step.filter("label <> was").isEmpty():
            discard(edges, labels)
            return step.select("node", "label")
        up = step.select(F.col("node").alias("p"), F.col("label").alias("up"))
        next_labels = written(step.join(up, F.col("label") == F.col("p"), "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        discard(labels, step)
        labels = next_labels


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", id_column: str = "doc_id", counted: bool = False) -> DataFrame:
    """One row per document: id, ``th`` (xxhash64 of the text, null as empty), ``n_shingles``, ``component`` and ``component_id``.

    If ``counted``, also ``n_links``: the other documents that it links with, those of equal sets among them.

    Documents link when ``100 * intersection >= percent * union`` of their sets of ``size``-word shingles.
    ``component`` names the set of linked documents, ``component_id`` is its smallest id. A null, empty or
    blank text has no shingle, no component, and its own id. Rows with a null id take part; a component of
    them alone has a null id. Repeated rows each get their row. An empty table gives no row.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, size, percent, text, id_column, counted)


def _near_duplicates(docs: DataFrame, size: int, percent: int, text: str, id_column: str, counted: bool) -> DataFrame:
    rows = docs.select(F.col(id_column), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    signed = _signed(rows, size, percent, id_column)
    who = F.struct(F.col(id_column).alias("_id"), F.col("th").alias("_th"))
    classes = signed.filter("node IS NOT NULL").groupBy("node").agg(F.min(id_column).alias("least"), F.min(who).alias("first"), F.max("n").alias("n"), F.count("*").alias("m"))
    classes = written(classes.withColumn("nid", F.xxhash64("node")), "classes")
    named_rows = signed.filter("node IS NOT NULL").withColumn("nid", F.xxhash64("node"))
    found = _links(rows, named_rows, classes, percent, size, id_column, counted)
    labels = components(found.filter("a <> b"))

    # from here on only classes of several rows or with links, the others name themselves
    linked = written(labels.join(classes.select("node", "least"), "node"), "linked")
    whole = written(linked.groupBy("label").agg(F.min("least").alias("component_id")), "whole")
    linked = linked.join(small(whole, 96), "label").select("node", F.col("label").alias("component"), "component_id")
    copies = classes.filter("m > 1").select("node", "least", "m")
    named = copies.join(linked, "node", "full").select("node", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "least").alias("component_id"), F.coalesce("m", F.lit(1)).alias("m"))
    if counted:
        named = named.join(found.filter("a = b").select(F.col("a").alias("node"), F.col("n").alias("others")), "node", "left")
        named = named.withColumn("n_links", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).cast("long"))
    named = small(written(named.drop("m", "others"), "named"), 128)
    own = signed.select(id_column, "th", F.col("n").alias("n_shingles"), "node")
    out = own.filter("node IS NOT NULL").join(named, "node", "left")
    alone = F.col("component").isNull()
    more = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if counted else []
    kind = signed.schema[id_column].dataType
    out = out.select(id_column, "th", "n_shingles", F.coalesce("component", "node").alias("component"), F.when(alone, F.col(id_column)).otherwise(F.col("component_id")).alias("component_id"), *more)
    blank = own.filter("node IS NULL").select(id_column, "th", "n_shingles", F.lit(None).cast("binary").alias("component"), F.col(id_column).cast(kind).alias("component_id"), *([F.lit(0).cast("long").alias("n_links")] if counted else []))
    return out.unionAll(blank)


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One document of each component, that with the smallest id; columns as they were, whatever their names.

    Texts without words stay. Of rows that repeat the smallest id of a component, one stays.
    """
    found = written(near_duplicates(docs, size, percent, text, id_column), "near")
    # a component's smallest id and its least text hash, for components of several rows; no row is dealt by component alone
    first = found.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.when(F.col(id_column).eqNullSafe(F.col("component_id")), F.col("th"))).alias("keep"), F.count("*").alias("rows"), F.sum(F.col(id_column).eqNullSafe(F.col("component_id")).cast("long")).alias("n"))
    first = written(first.filter("rows > 1").select("component", "keep", "n"), "first")
    own_id, th, stays, again, of = unused(docs.columns, "_id", "_th", "_stays", "_again", "_of")
    same = F.col(id_column).eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("keep"))
    verdict = found.join(small(first, 96), "component").select(F.col(id_column).alias(own_id), F.col("th").alias(th), same.alias(stays), (F.col("n") > 1).alias(again), F.hex("component").alias(of))
    verdict = written(verdict.filter(~F.col(stays) | F.col(again)).distinct(), "verdict")
    match = docs[id_column].eqNullSafe(F.col(own_id)) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col(th))
    gone = written(verdict.filter(~F.col(stays)).select(own_id, th), "gone")
    left = docs.join(small(gone, 64), match, "left_anti")
    twice = written(verdict.filter(F.col(stays) & F.col(again)), "twice")
    discard(found, first, verdict)
    if twice.isEmpty():
        return left
    some = small(twice, 128)
    once = left.join(some, match).dropDuplicates([of]).select(*docs.columns)
    return left.join(some, match, "left_anti").unionAll(once)
