from tenmark.llm import decontaminate

from . import brute


def test_items_without_an_id_count_words(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four five six"), (3, "seven")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "one two"), (None, "four five"), (7, "five six")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {1: (2, 0, brute.sha(""), True), 2: (3, 1, brute.sha("7"), True), 3: (0, 0, brute.sha(""), False)}
    assert [r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()] == [3]
