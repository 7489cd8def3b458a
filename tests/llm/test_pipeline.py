import corpus_pipeline
from tenmark.llm import registry

from . import brute


def test_stages_keep_clean_documents(spark, sf_dir):
    docs = registry.table(spark, sf_dir, "documents")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, seen, sf_dir)
        assert after.columns == docs.columns, name
        after = registry_written(after, name)
        if name == "language":
            assert after.count() == seen.filter("text rlike '[a-zA-Z]'").count()
        if name == "near_duplicates":
            want = brute.components(brute.documents(seen), 5, 80)
            assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, n, c in want if not n or d == c)
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in registry.table(spark, sf_dir, "benchmark").collect()]
            assert sorted(r.doc_id for r in after.collect()) == sorted(r[0] for r in brute.contamination(brute.documents(seen), items) if not r[5])
        if name == "secrets":
            assert after.count() == seen.count()
            assert not any(brute.base_spans(t) for _, t in brute.documents(after))
            assert after.filter("n_chars <> length(text)").count() == 0
        seen = after
    pieces = corpus_pipeline.STAGES[4][1](spark, seen, sf_dir)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in seen.collect()}


def registry_written(df, name):
    from tenmark.llm.common import written

    return written(df, name)


def test_awkward_rows_pass(spark, sf_dir):
    docs = brute.awkward(spark).drop("n")
    for _, stage in corpus_pipeline.STAGES:
        docs = registry_written(stage(spark, docs, sf_dir), "awkward")
    assert docs.count() >= 5
    empty = brute.awkward(spark).drop("n").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = registry_written(stage(spark, empty, sf_dir), "empty")
    assert empty.count() == 0


def test_run_leaves_its_result_alone(spark, sf_dir):
    from tenmark.llm import common

    before = set(common._written)
    out = corpus_pipeline.run(spark, sf_dir)
    assert [path for _, path in set(common._written) - before] == [out.folder]
    first = sorted(map(tuple, out.collect()))
    assert first and first == sorted(map(tuple, out.collect()))
    docs = {d for d, _ in brute.documents(registry.table(spark, sf_dir, "documents"))}
    assert {r[0] for r in first} < docs
