import math
import random
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tenmark.llm import decontaminate, fingerprints, registry, secrets

from . import brute


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


NAMES8 = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_contamination_equals_brute_force(spark, sf_dir):
    items = [(r.item_id, r.text) for r in registry.table(spark, sf_dir, "benchmark").collect()]
    docs = brute.documents(registry.table(spark, sf_dir, "documents"))
    got = rows(registry.QUERIES["op8_decontamination"](spark, sf_dir), *NAMES8)
    assert got == sorted(brute.contamination(docs, items), key=str)
    assert any(r[5] for r in got)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_contamination_of_awkward_rows(spark, monkeypatch, limit):
    monkeypatch.setattr("tenmark.llm.common.BROADCAST_BYTES", limit)
    docs = brute.awkward(spark)
    items = [(1, "three FOUR five"), (2, None), (3, "!!"), (4, "nine ten one two three four five six seven eight nine ten one two three"), (5, "under"), (1, "four five")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows(decontaminate.contamination(docs, bench), *NAMES8)
    assert got == sorted(brute.contamination(brute.documents(docs), items), key=str)
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_decontaminated_keeps_or_cuts(spark):
    docs = brute.awkward(spark)
    bench = spark.createDataFrame([(1, "another text under the same id"), (2, "three lines")], "item_id long, text string")
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 1
    cut = decontaminate.decontaminated(docs, bench, spans=True)
    assert cut.count() == docs.count() and {r.text for r in cut.filter("text = ''").collect()} == {""}
    assert sorted(r.text for r in cut.filter("doc_id = 3").collect()) == sorted(r.text for r in docs.filter("doc_id = 3").collect())


def test_base_spans_equal_brute_force(spark, sf_dir):
    for docs in (registry.table(spark, sf_dir, "documents"), brute.awkward(spark, [(77, "token=token:abcdefgh12 SECRET = 'x' api_key: ÄÖ AKIA0 token: \U0001f44d password=12345678", "en", "s", 1, 1)])):
        found = {}
        for r in secrets.secret_scan(docs).collect():
            found.setdefault(r.doc_id, []).append((r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans))
        for d, t in brute.documents(docs):
            base = brute.base_spans(t)
            n = Counter(k for _, k, _ in base)
            named = [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base]
            match = [x for x in found[d] if x[:4] == (n[0], n[1], n[2], brute.sha(",".join(named)))]
            assert match and set(named) <= set(match[0][4].split(",")) | {""}


def entropy(s, w):
    best = 0.0
    for k in range(max(1, len(s) - w + 1)):
        part = s[k : k + w]
        best = max(best, -sum(c / len(part) * math.log2(c / len(part)) for c in Counter(part).values()))
    return best


def test_entropy_equals_recount(spark):
    rng = random.Random(5)
    strings = ["".join(rng.choice("abcDEF0123/+") for _ in range(n)) for n in (1, 5, 19, 20, 21, 40, 90)] + ["a" * 30]
    got = spark.createDataFrame([(s,) for s in strings], "s string").select("s", secrets.peak_entropy(F.col("s")).alias("h")).collect()
    for r in got:
        assert abs(r.h - entropy(r.s, secrets.WINDOW)) < 1e-6


def test_entropy_adds_spans_and_allows(spark):
    text = "key gJ7xQ2vT9bLk4RzWm1Yc8PdH and id 123e4567-e89b-12d3-a456-426614174000 or thewordsthatarelongerthantwenty"
    r = secrets.secret_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.spans == f"entropy:{text.index('gJ7')}:{text.index(' and')}"
    assert secrets.redacted(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").first().text.startswith("key [SECRET] and id 123e")


def canon(t):
    nfkc = lambda s: unicodedata.normalize("NFKC", s)
    return " ".join(nfkc(nfkc(t or "").casefold()).split())


def test_fingerprints_follow_canonical_text(spark, sf_dir):
    docs = registry.table(spark, sf_dir, "documents").select("doc_id", "text").union(spark.createDataFrame([(-1, "A  ﬁne É"), (-2, "a fine é "), (-3, None), (-4, ""), (-4, "")], "doc_id long, text string"))
    texts = brute.documents(docs)
    found = fingerprints.exact_groups(docs).collect()
    least = {}
    for d, t in texts:
        least[canon(t)] = min(d, least.get(canon(t), d))
    assert sorted((r.doc_id, r.group_id) for r in found) == sorted((d, least[canon(t)]) for d, t in texts)


def test_edited_texts(spark, sf_dir):
    docs = registry.table(spark, sf_dir, "documents")
    texts = sorted((d, t or "") for d, t in brute.documents(docs))
    got = {r.doc_id: r for r in fingerprints.edit_fingerprints(docs).collect()}
    for k, (d, t) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), brute.sha(edited))
        assert got[d].near_edited == float(canon(t) == canon(edited)) and got[d].near_next == float(canon(t) == canon(after))


def test_edited_awkward(spark):
    docs = brute.awkward(spark)
    assert fingerprints.edit_fingerprints(docs).count() == docs.count()
    assert fingerprints.edit_fingerprints(docs.limit(0)).count() == 0
    one = fingerprints.edit_fingerprints(docs.filter("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_bytes_decide_inside_a_bucket(spark):
    mixed = spark.createDataFrame([("h", "a"), ("h", "b"), ("h", "a"), ("g", "c")], "h string, canon string")
    own = mixed.select(F.col("h").alias("fingerprint"), F.sha2("canon", 512).alias("s"), "canon")
    got = fingerprints.compared(own, [("fingerprint", "s")], mixed).collect()
    assert sorted((r.canon, r.fingerprint) for r in got) == [("a", "h"), ("a", "h"), ("b", "h-1"), ("c", "g")]
