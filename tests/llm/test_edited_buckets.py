from pyspark.sql import functions as F

from tenmark.llm import fingerprints


def test_bytes_decide_for_edited_texts_too(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "wide_hash", lambda c: F.substring(F.sha2(c, 256), 1, 1))
    docs = spark.createDataFrame([(k, f"text {k % 7} of {k % 11}") for k in range(60)], "doc_id long, text string")
    texts = [f"text {k % 7} of {k % 11}" for k in range(60)]
    edited = [t[: len(t) - len(t) // 2] + texts[(k + 1) % 60][: len(t) // 2] for k, t in enumerate(texts)]
    forms: dict = {}
    for r in fingerprints.edit_fingerprints(docs).collect():
        assert r.near_edited == float(texts[r.doc_id] == edited[r.doc_id])
        for name, text in ((r.fingerprint, texts[r.doc_id]), (r.edited_fingerprint, edited[r.doc_id])):
            forms.setdefault(name, set()).add(" ".join(text.split()))
    assert all(len(x) == 1 for x in forms.values())
