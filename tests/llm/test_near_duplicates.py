import random

import numpy as np
import pytest

from tenmark.llm import near_duplicates as nd
from tenmark.llm import registry, shingles

from . import brute


def near_copies(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out = []
    for group in range(n // 12):
        base = [rng.choice(words) for _ in range(rng.choice([4, 12, 60, 200]))]
        for k in range(12):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(own) // 30))):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append((1000 * group + rng.randrange(900) + k, " ".join(own), "en", "s", 1, 1))
    return out


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize(("size", "percent", "bucket"), [(3, 90, 1024), (5, 80, 1024), (5, 80, 4)])
def test_components_equal_brute_force(spark, monkeypatch, size, percent, bucket):
    monkeypatch.setattr(nd, "BUCKET", bucket)
    docs = brute.awkward(spark, near_copies(size))
    want = brute.components(brute.documents(docs), size, percent)
    assert got(nd.near_duplicates(docs, size, percent)) == sorted(want, key=str)
    assert len({c for _, _, c in want}) < len(want)


def brute_links(docs, size, percent):
    sets = brute.shingle_sets(docs, size)
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= percent * len(a | b)
    return [(d, sum(linked(sets[i], other) for j, other in enumerate(sets) if j != i)) for i, (d, _) in enumerate(docs)]


@pytest.mark.parametrize("bucket", [1024, 4])
def test_every_link_is_counted(spark, monkeypatch, bucket):
    monkeypatch.setattr(nd, "BUCKET", bucket)
    docs = brute.awkward(spark, near_copies(5))
    texts = brute.documents(docs)
    found = nd.near_duplicates(docs, 5, 80, counted=True)
    want = brute_links(texts, 5, 80)
    assert sorted(((r.doc_id, r.n_links) for r in found.collect()), key=str) == sorted(want, key=str)
    assert got(found) == sorted(brute.components(texts, 5, 80), key=str)
    assert sum(n for _, n in want) > 4 * len(want)  # far more than a forest has


def test_links_query_equals_its_oracle(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(registry.ORACLES["op2_ngram_jaccard_links"])
    df = registry.QUERIES["op2_ngram_jaccard_links"](spark, sf_dir)
    assert df.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())


def test_query_on_documents(spark, sf_dir):
    docs = brute.documents(registry.table(spark, sf_dir, "documents"))
    assert got(registry.QUERIES["op2_ngram_jaccard_join"](spark, sf_dir)) == sorted(brute.components(docs, 3, 90), key=str)


def test_empty_table(spark):
    docs = brute.awkward(spark)
    assert nd.near_duplicates(docs.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    docs = brute.awkward(spark, near_copies(7, 24))
    kept = nd.deduplicated(docs)
    assert kept.columns == docs.columns
    texts = brute.documents(docs)
    blank = sum(not (t or "").split() for _, t in texts)
    ids = [c for _, n, c in brute.components(texts, 5, 80) if n]
    rows = kept.collect()
    # the one document with a null id is its own group; two groups have the id 4, which two texts share
    assert len(rows) == blank + len(set(ids)) + 1
    assert sorted(r.doc_id for r in rows if r.text and r.text.split() and r.doc_id is not None) == sorted([c for c in set(ids) if c is not None] + [4])


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(3)
    for _ in range(50):
        lists = [np.unique(rng.integers(0, 40, rng.integers(1, 30))) for _ in range(12)]
        for need in (1, 3, 6, 11, 12, 13):
            members, counts = np.unique(np.concatenate(lists), return_counts=True)
            want = dict(zip(members[counts >= need].tolist(), counts[counts >= need].tolist(), strict=True))
            m, c = shingles.divide_skip(list(lists), need, lambda x: np.ones(len(x), bool))
            assert dict(zip(m.tolist(), c.tolist(), strict=True)) == want
