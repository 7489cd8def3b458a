"""Canonical exact digests. DataFrame functions only.

Canonical text: Unicode normalisation (NFKC), full case folding, NFKC again, and every run of white space
as one space with none at the ends. Its fingerprint is four 64-bit xxhash values with different seeds.
Equal fingerprints are not taken on trust: inside each bucket of two or more rows the canonical bytes are
compared, and where a bucket holds different ones, all but the first in byte order get a suffix.

The normaliser is that of the ICU library which Spark itself ships for its collations, called in the JVM.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import written

_ICU = "com.ibm.icu.text.Normalizer"
_CASE = "com.ibm.icu.lang.UCharacter"
#: Bytes of everything that Unicode calls white space, after normalisation.
_SPACE = r"[\s\u0085   ]+"
BLOCKS = 65_536
RANGES = 256


def canonical(text: Column) -> Column:
    """The canonical form of a text (null: empty)."""
    call = lambda name, f, s: F.reflect(F.lit(name), F.lit(f), s, F.lit(True))
    own = F.coalesce(text, F.lit(""))
    folded = call(_ICU, "compose", call(_CASE, "foldCase", call(_ICU, "compose", own)))
    plain = F.lower(own)  # for ASCII the same, and cheaper
    return F.trim(F.regexp_replace(F.when(F.octet_length(own) == F.length(own), plain).otherwise(folded), _SPACE, " "))


def wide_hash(canon: Column) -> Column:
    """Four seeded xxhash values as 64 hexadecimal digits."""
    return F.lower(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(seed), canon)), 16, "0") for seed in range(4))))


def compared(rows: DataFrame, pairs: list[tuple[str, str]], id_texts: DataFrame) -> DataFrame:
    """Adds suffixes where buckets hold different bytes.

    ``rows`` has hash columns, ``id_texts`` rows ``(h, canon)`` of every bucket to compare. ``pairs`` names
    each hash column of ``rows`` with its canonical text's SHA-512, by which a text finds its own suffix.
    """
    # min and max of the bytes are kept for each bucket and task, so a hot bucket is small before it is shuffled
    mixed = written(id_texts.groupBy("h").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).filter("a <> b").select("h"), "mixed")
    if mixed.isEmpty():
        return rows
    order = id_texts.join(mixed, "h", "left_semi").distinct().withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("canon")) - 1)
    order = written(order.filter("k > 0").select("h", F.sha2("canon", 512).alias("s"), "k"), "suffixes")
    for h, s in pairs:
        own = order.select(F.col("h").alias("_h"), F.col("s").alias("_s"), "k")
        rows = rows.join(own, (F.col(h) == F.col("_h")) & (F.col(s) == F.col("_s")), "left").withColumn(h, F.when(F.col("k").isNull(), F.col(h)).otherwise(F.concat_ws("-", h, F.col("k").cast("string")))).drop("_h", "_s", "k")
    return rows


def _dups(hashed: DataFrame) -> DataFrame:
    """``hashed`` rows ``(h)``; the values that occur twice or more."""
    return hashed.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")


def fingerprints(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per document: id and ``fingerprint``. Null texts count as empty; repeated rows keep theirs."""
    base = docs.select(id_column, canonical(F.col(text)).alias("canon"))
    rows = written(base.select(id_column, wide_hash(F.col("canon")).alias("fingerprint"), F.sha2("canon", 512).alias("s")), "fp")
    dups = written(_dups(rows.select(F.col("fingerprint").alias("h"))), "dups")
    again = base.select(wide_hash(F.col("canon")).alias("h"), "canon")
    return compared(rows, [("fingerprint", "s")], _within(again, dups)).select(id_column, "fingerprint")


def _within(again: DataFrame, dups: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Rows of ``again`` in the buckets of ``dups``: broadcast up to ``most`` of them, shuffled beyond."""
    return again.join(F.broadcast(dups) if dups.count() <= most else dups, "h", "left_semi")


def exact_groups(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Adds to each id the ``group_id``: the smallest id with the same fingerprint."""
    found = fingerprints(docs, text, id_column)
    first = found.groupBy("fingerprint").agg(F.min(id_column).alias("group_id"))
    return found.join(first, "fingerprint").select(id_column, "group_id", "fingerprint")


def _range_of(at: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are below or equal to a number: a tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        mid = (lo + hi) // 2
        return F.lit(lo) if lo == hi else F.when(at < bounds[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def with_next(docs: DataFrame, columns: list[str], id_column: str = "doc_id") -> DataFrame:
    """Adds ``next_<column>`` of the next row by ascending id (after the last: the first). Ids are whole numbers.

    A quantile sketch of the ids cuts them into ``RANGES`` parts of about equally many rows, and each part into
    equal ranges of about 256 rows, at most ``RANGES`` of them. The first row of each range also goes, as a guest, to
    the range before; then one shuffle by range is enough. What is broadcast is one row per range. Equal ids are
    ordered by the columns. Rows with a null id come first, by a hash of the columns, in ranges of that hash.
    """
    if not isinstance(docs.schema[id_column].dataType, IntegralType):
        raise TypeError("the next document is that of the next whole number")
    at, own = F.col(id_column), "_" * (1 + max(len(c) for c in docs.columns))
    block, first, guest, order_, part = (own + n for n in ("block", "first", "guest", "order", "part"))
    quantiles = F.percentile_approx(at, [k / RANGES for k in range(1, RANGES)], 10_000)
    cut = docs.agg(quantiles.alias("q"), F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias("n"), F.count(at).alias("known")).first()
    bounds = sorted({int(x) for x in cut["q"] or [] if x > cut["lo"]})
    edges = [int(cut["lo"] or 0), *bounds, int(cut["hi"] or 0) + 1]
    parts = max(1, min(RANGES, cut["n"] // 256 // (len(edges) - 1)))
    wide = lambda xs: F.array(*(F.lit(Decimal(x)).cast("decimal(20,0)") for x in xs))
    starts, widths = wide(edges[:-1]), wide((b - a) // parts + 1 for a, b in zip(edges, edges[1:], strict=False))
    within = F.floor((at.cast("decimal(20,0)") - F.get(starts, F.col(part))) / F.get(widths, F.col(part))).cast("int")
    unknown = max(1, min(BLOCKS, (cut["n"] - cut["known"]) // 256))
    hashed = F.xxhash64(*columns)
    of_null = F.shiftrightunsigned(hashed.bitwiseXOR(F.lit(-(1 << 63))), 33) * unknown  # 31 bits
    placed = docs.select(id_column, *columns, _range_of(at, bounds).alias(part))
    placed = placed.select(id_column, *columns, F.when(at.isNull(), F.shiftright(of_null, 31).cast("int") - unknown).otherwise(F.col(part) * (RANGES + 1) + within).alias(block), F.when(at.isNull(), hashed).alias(order_))
    who = F.struct(id_column, order_)
    firsts = placed.groupBy(block).agg(F.min(who).alias(first))
    chain = Window.partitionBy(F.lit(0)).orderBy(block)
    last = F.max(block).over(Window.partitionBy(F.lit(0)))
    firsts = firsts.select(block, first, F.coalesce(F.lag(block).over(chain), last).alias("_before"))
    here, before = F.struct(F.col(block), F.lit(False).alias(guest)), F.struct(F.col("_before").alias(block), F.lit(True).alias(guest))
    rows = placed.join(F.broadcast(firsts), block).withColumn("_to", F.explode(F.when(who.eqNullSafe(F.col(first)), F.array(here, before)).otherwise(F.array(here))))
    rows = rows.select(id_column, *columns, order_, f"_to.{block}", f"_to.{guest}")
    order = Window.partitionBy(block).orderBy(guest, id_column, order_, *columns)
    return rows.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns)).filter(~F.col(guest)).drop(block, guest, order_)


def edit_fingerprints(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Fingerprints of each text and of its edited form, and their likeness (1.0 if equal, else 0.0).

    The edited form has the last ``n_chars div 2`` code points replaced by the first as many of the next
    document. Null texts count as empty. A single document is its own next one.
    """
    base = docs.select(id_column, F.coalesce(F.col(text), F.lit("")).alias("text"))
    pairs = with_next(base, ["text"], id_column).withColumn("n", F.length("text").cast("long"))
    half = F.floor(F.col("n") / 2).cast("int")
    pairs = pairs.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    pairs = pairs.withColumn("c", canonical(F.col("text"))).withColumn("e", canonical(F.col("edited"))).withColumn("x", F.sha2(canonical(F.col("next_text")), 512))
    rows = written(
        pairs.select(id_column, F.col("n").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), wide_hash(F.col("c")).alias("fingerprint"), F.sha2("c", 512).alias("s"), wide_hash(F.col("e")).alias("edited_fingerprint"), F.sha2("e", 512).alias("es"), "x"), "edited"
    )
    dups = written(_dups(rows.select(F.col("fingerprint").alias("h")).unionAll(rows.filter("s <> es").select(F.col("edited_fingerprint").alias("h")))), "dups")
    again = base.select(canonical(F.col("text")).alias("canon")).select(wide_hash(F.col("canon")).alias("h"), "canon")
    # edited forms are compared by SHA-512; their bytes are made again only for buckets in which it differs
    forms = rows.select(F.col("fingerprint").alias("h"), "s").unionAll(rows.select(F.col("edited_fingerprint").alias("h"), F.col("es").alias("s")))
    differ = written(_within(forms, dups).groupBy("h").agg(F.min("s").alias("a"), F.max("s").alias("b")).filter("a <> b").select("h"), "differ")
    if not differ.isEmpty():
        edits = pairs.select(wide_hash(F.col("e")).alias("h"), F.col("e").alias("canon"))
        again = again.unionAll(_within(edits, differ))
    done = compared(rows, [("fingerprint", "s"), ("edited_fingerprint", "es")], _within(again, dups))
    like = lambda a, b: F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))
    return done.select(id_column, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), like(F.col("s"), F.col("x")).alias("near_next"))
