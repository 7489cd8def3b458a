import hashlib
import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenmark.llm import chat, language, quality, registry, warc

from . import brute


def test_language_of_held_out_documents(spark, sf_dir):
    docs = registry.table(spark, sf_dir, "documents")
    got = registry.QUERIES["op3_language_id"](spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_awkward_rows(spark):
    model = language.fit([("hello there all of you", "en"), ("guten tag zusammen und auf wiedersehen", "de")] * 10)
    docs = brute.awkward(spark, [(50, "123 !!", "en", "s", 1, 1)])
    got = language.with_language(docs, model).collect()
    assert len(got) == docs.count()
    for r in got:
        no_letter = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == no_letter and 0 <= r.score <= 1
    assert {r.text for r in language.identified(docs, model).collect()} == {r.text for r in got if r.lang_pred != "und"}
    assert language.languages(docs.limit(0), model, F.lit(True)).count() == 0
    assert language.fit([]).classes == ("und",)


def test_long_texts_are_scored_whole(monkeypatch):
    model = language.fit([("hello there all of you", "en"), ("guten tag zusammen und auf wiedersehen", "de")] * 10)
    text = "hello und there tag all zusammen " * 50
    whole = language.predict(model, [text, "und"])
    monkeypatch.setattr(language, "PIECE", 37)
    cut = language.predict(model, [text, "und"])
    assert whole[0] == cut[0] and np.allclose(whole[1], cut[1], atol=1e-6)


def test_quality_of_held_out_documents(spark, sf_dir):
    labels = registry.table(spark, sf_dir, "labels")
    got = registry.QUERIES["op7_quality"](spark, sf_dir).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.quality == r.predicted for r in got]) >= 0.85
    assert all(r.predicted == int(r.score >= 0.7) for r in got)


def test_rules_compile_to_what_they_hold(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, len(quality.STATISTICS)))
    y = ((x[:, 1] > 0.5) & (x[:, 3] < 0.6)).astype(float)
    model = quality.fit(x, y, np.ones(400))
    assert model.rules
    z = model.bias + sum(w * r.holds(x) for r, w in zip(model.rules, model.weights, strict=True))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{s} double" for s in quality.STATISTICS))
    got = [r.s for r in df.select(quality.compiled(model).alias("s")).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-z)))
    assert np.mean((np.array(got) > 0.5) == y) > 0.95


def test_quality_of_awkward_rows(spark, monkeypatch):
    docs = brute.awkward(spark)
    model = quality.Ensemble((quality.Rule(((0, True, 1.0),)),), (-3.0,), 1.0)
    got = quality.quality_scores(docs, model, F.lit(None).cast("boolean")).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.held_out is False for r in got)
    text = "Ab cd!! \n" * 60 + "x" * 50
    whole = quality.statistics([text, ""])
    monkeypatch.setattr(quality, "PIECE", 7)
    assert np.allclose(whole, quality.statistics([text, ""]))
    assert quality.fit(np.zeros((0, 3)), np.zeros(0), np.zeros(0)).rules == ()


def test_archives_round_trip(spark):
    long, big = "<p>" + "é" * 100, "z" * (3 << 17)
    rows = [(1, "u", long), (2, None, long), (3, "u\r\nX: y", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", big), (8, "u", big), (None, "u", long), (8, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    least = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 100 and i is not None:
            least[h] = min(i, least.get(h, i))
    want = []
    for i, _, h in rows:
        first = least.get(h)
        again = first is not None and i is not None and i > first
        want.append((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if again else "response", first if again else None))
    assert sorted(map(tuple, warc.through_archives(pages).collect()), key=str) == sorted(want, key=str)
    assert warc.through_archives(pages.limit(0)).count() == 0


def test_reader_verifies():
    data = warc.record_bytes("response", "http://a", "urn:page:1", b"abc" * 100) + warc.record_bytes("revisit", "http://b", "urn:page:2", b"abc" * 100, "urn:page:1")
    found = list(warc.read_records(io.BytesIO(data)))
    assert [r.kind for r in found] == ["response", "revisit"] and found[0].payload == b"abc" * 100
    plain = b"".join(zlib.decompressobj(31).decompress(warc.record_bytes("response", "http://a", "urn:page:1", b"abc" * 100)) for _ in (1,))
    for old, new in ((b"abcabc\r\n\r\n", b"abcabd\r\n\r\n"), (b"Content-Length: 3", b"Content-Length: 9"), (b"WARC/1.1", b"HTTP/1.1")):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        with pytest.raises(warc.DamagedRecord):
            list(warc.read_records(io.BytesIO(z.compress(plain.replace(old, new)) + z.flush())))
    with pytest.raises(warc.DamagedRecord):
        list(warc.read_records(io.BytesIO(data[:-20])))


def test_preference_pairs(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", None), (3, 0, "user", ""), (4, 0, None, "x"), (None, 0, "user", "lost"), (6, 0, "user", "a"), (6, 0, "user", "a"), (7, 0, "user", "a")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").withColumn("side", F.lit(1))
    got = {r.pair_id: r for r in chat.preference_pairs(df, F.floor(F.col("conv_id") / 2), F.pmod("conv_id", F.lit(2)) == 0).collect()}
    assert set(got) == {0, 1, 2, 3}
    r = got[0]
    assert (r.n_prompt_turns, r.prompt) == (1, "<|im_start|>user\nhi<|im_end|>\n")
    assert (r.chosen, r.rejected) == ("<|im_start|>assistant\nyes<|im_end|>\n", "<|im_start|>assistant\nno<|im_end|>\n")
    a, b = map(int, r.chosen_mask.split(":"))
    assert r.chosen[a:b] == "yes<|im_end|>"
    assert (got[1].n_prompt_turns, got[1].chosen, got[1].rejected) == (1, "", "")
    assert (got[2].n_prompt_turns, got[2].prompt, got[2].rejected) == (0, "", "")
    assert got[3].n_prompt_turns == 1 and got[3].chosen == "<|im_start|>user\na<|im_end|>\n"
    assert chat.preference_pairs(df.limit(0), F.col("conv_id"), F.lit(True)).count() == 0
