"""Benchmark decontamination with a broadcast hash set of test n-grams. DataFrame functions only.

A window is ``size`` consecutive words of a benchmark item, or the whole item if it has fewer. Documents are
scanned in two steps, both exact. A run of ``size`` document words always holds a whole chunk of
``(size + 1) // 2`` words that starts at a multiple of that number, whatever its own start is; so the first
step looks only at the non-overlapping chunks of each document and keeps documents where one of them lies
inside a window. The second step verifies every window of those documents word by word, and keeps the
positions hit.

What is broadcast are 64-bit hashes of the benchmark's n-grams, while they fit into ``BROADCAST_BYTES``; beyond that
the same joins are left to shuffle. A hash alone decides nothing: chunks only propose documents, and what the hashes
of windows let through meets the windows' own words. Documents are told apart by id and text hash together, so
repeated rows and repeated ids keep their own results.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, unused, written

#: What the contract calls no part of a word once A-Z are lower-case.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for text as it stands.
WORD_AS_IS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normal(text: Column) -> Column:
    """Words of lower-cased text with one space between and none around."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.trim(F.regexp_replace(low, NOT_WORD, " "))


def count_words(normal_text: Column) -> Column:
    return F.when(normal_text == "", F.lit(0)).otherwise(F.length(normal_text) - F.length(F.replace(normal_text, F.lit(" "))) + 1).cast("long")


def _grams(words: Column, size: int) -> Column:
    """All runs of ``size`` words, joined, in order; none if there are fewer."""
    run = lambda i: F.array_join(F.slice(words, i + 1, size), " ")
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), run)).otherwise(F.array().cast("array<string>"))


def find_hits(docs: DataFrame, benchmark: DataFrame, size: int = 13, text: str = "text", id_column: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents in which a benchmark window occurs.

    Returns ``id, th, intervals, items``: the text's hash, the sorted ``(start, stop)`` word positions of
    the occurrences and the sorted item ids as strings. Documents and items that are null, empty or have no
    word match nothing. An item without an id matches and is not among the ids. An empty benchmark gives no row.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), normal(F.col(item_text)).alias("words")).filter("words <> ''")
    items = items.select("item", F.split("words", " ").alias("words")).withColumn("size", F.least(F.size("words"), F.lit(size))).transform(lambda d: written(d, "items"))
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most ``size`` rows

    key = F.col(id_column).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th")
    plain = docs.select(*key, normal(F.col(text)).alias("words"))
    none = F.array().cast("array<string>")
    chunk = {n: (n + 1) // 2 for n in sizes}
    spot = "array<struct<c:long,k:int,at:int>>"
    pieces = lambda k: F.transform(F.regexp_extract_all(F.concat("words", F.lit(" ")), F.lit(f"(?:[^ ]++ ){{{k}}}"), F.lit(0)), lambda c, i: F.struct(F.xxhash64(c).alias("c"), F.lit(k).alias("k"), (i * k).alias("at")))
    cut = reduce(lambda a, b: F.concat(a, b), map(pieces, sorted(set(chunk.values()))), F.array().cast(spot))
    inside = reduce(lambda a, b: F.concat(a, b), (F.when(F.col("size") == n, _grams(F.col("words"), k)).otherwise(none) for n, k in chunk.items()), none)
    chunks = written(items.select(F.explode(inside).alias("c")).select(F.xxhash64(F.concat("c", F.lit(" "))).alias("c")).distinct(), "chunks")
    near = plain.select("id", "th", F.explode(cut).alias("s")).select("id", "th", "s.*").join(small(chunks, 48), "c", "left_semi")
    maybe = written(near.groupBy("id", "th").agg(F.collect_set(F.struct("k", "at")).alias("spots")), "maybe")

    grams = reduce(lambda a, b: F.concat(a, b), (F.when(F.col("size") == n, _grams(F.col("words"), n)).otherwise(none) for n in sizes), none)
    windows = written(items.select("item", F.explode(grams).alias("gram")).distinct().withColumns({"wid": F.xxhash64("gram"), "gid": F.md5("gram")}), "windows")
    hashes = written(windows.select("wid").distinct(), "hashes")
    both = plain.join(small(maybe, 256).withColumnsRenamed({"id": "mid", "th": "mth"}), F.col("id").eqNullSafe(F.col("mid")) & (F.col("th") == F.col("mth")))
    picked = both.select("id", "th", "spots", F.split("words", " ").alias("words")).dropDuplicates(["id", "th"])

    def runs(n):
        """The windows of ``n`` words that hold one of the chunks found."""
        k, last = chunk[n], F.size("words") - n
        own = F.filter("spots", lambda s: (s["k"] == k) & (F.greatest(s["at"] - (n - k), F.lit(0)) <= F.least(s["at"], last)))
        starts = F.flatten(F.transform(own, lambda s: F.sequence(F.greatest(s["at"] - (n - k), F.lit(0)), F.least(s["at"], last))))
        gram = lambda i: F.array_join(F.slice("words", i + 1, n), " ")
        return F.transform(F.array_distinct(starts), lambda i: F.struct(i.alias("start"), (i + n).alias("stop"), gram(i).alias("gram")))

    every = reduce(lambda a, b: F.concat(a, b), map(runs, sizes)) if sizes else F.array().cast("array<struct<start:int,stop:int,gram:string>>")
    hits = picked.select("id", "th", F.explode(every).alias("w")).select("id", "th", "w.start", "w.stop", "w.gram", F.xxhash64("w.gram").alias("wid"))
    hits = written(hits.join(small(hashes, 48), "wid", "left_semi"), "likely").join(windows.select("gram", "wid", "gid").distinct(), ["wid", "gram"])
    by_doc = hits.groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("intervals"), F.collect_set("gid").alias("gids"))
    by_doc = written(by_doc, "hits")
    named = by_doc.select("id", "th", F.explode("gids").alias("gid")).join(windows.select("gid", "item"), "gid")
    names = named.groupBy("id", "th").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumnsRenamed({"id": "nid", "th": "nth"})
    return by_doc.join(names, F.col("id").eqNullSafe(F.col("nid")) & (F.col("th") == F.col("nth"))).select("id", "th", "intervals", "items")


def covered(intervals: Column) -> Column:
    """Words inside the union of sorted intervals."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(a["upto"], x["start"]))).alias("n"), F.greatest(a["upto"], x["stop"]).alias("upto"))
    return F.aggregate(intervals, start, step)["n"].cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, text: str = "text", id_column: str = "doc_id", **names) -> DataFrame:
    """One row per document: ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``.

    A document is contaminated when a word is hit and ``share`` times the words hit reach its words. Null
    and empty texts have no words and are clean. Repeated rows are judged each; other columns are dropped.
    """
    hits = find_hits(docs, benchmark, size, text, id_column, **names)
    hits = hits.select(F.col("id").alias("hid"), F.col("th").alias("hth"), covered(F.col("intervals")).alias("hit"), F.size("items").cast("long").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("sha"))
    own = docs.select(F.col(id_column), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), count_words(normal(F.col(text))).alias("n_words"))
    out = own.join(hits, F.col(id_column).eqNullSafe(F.col("hid")) & (F.col("th") == F.col("hth")), "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    return out.select(id_column, "n_words", n_hit.alias("n_hit"), F.coalesce("n", F.lit(0).cast("long")).alias("n_items"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, spans: bool = False, text: str = "text", id_column: str = "doc_id", **names) -> DataFrame:
    """The documents without contamination, columns as they were.

    Drops contaminated documents. With ``spans``, keeps them and cuts every word that is hit, with what
    follows it up to the next word, from all documents. Null and empty texts stay.
    """
    hits = find_hits(docs, benchmark, size, text, id_column, **names)
    hid, hth, found = unused(docs.columns, "_hid", "_hth", "_found")
    hit = hits.select(F.col("id").alias(hid), F.col("th").alias(hth), (F.col("intervals") if spans else covered(F.col("intervals"))).alias(found))
    match = docs[id_column].eqNullSafe(F.col(hid)) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col(hth))
    both = docs.join(hit, match, "left")
    if not spans:
        return both.filter(F.coalesce(~((F.col(found) > 0) & (share * F.col(found) >= count_words(normal(F.col(text))))), F.lit(True))).select(*docs.columns)
    words, gaps = F.regexp_extract_all(F.col(text), F.lit(WORD_AS_IS), F.lit(0)), F.split(F.col(text), WORD_AS_IS)
    kept = F.transform(words, lambda w, i: F.when(F.exists(found, lambda x: (x["start"] <= i) & (i < x["stop"])), F.lit("")).otherwise(F.concat(w, F.element_at(gaps, i + 2))))
    cut = F.when(F.col(found).isNull(), F.col(text)).otherwise(F.concat(F.element_at(gaps, 1), F.array_join(kept, "")))
    return both.withColumn(text, cut).select(*docs.columns)
