import numpy as np
from pyspark.sql import functions as F

from tenmark.llm import language


def test_idf_counts_every_training_row(spark, monkeypatch):
    rows = [(k, f"wort {chr(97 + k % 26)}{chr(97 + k // 26 % 26)} text" if k % 9 else None, "de" if k % 4 else None) for k in range(300)] + [(900, "123 456", "de"), (901, "", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    used = {}
    monkeypatch.setattr(language, "fit", lambda rows, **more: used.update(more, n=len(rows)))
    language.fit_languages(docs, F.col("doc_id") % 5 != 0, per_language=20)
    want, n = np.zeros(1 << language.BITS, np.int64), 0
    for k, t, lang in rows:
        if k % 5 and lang and t and language._letters(t):
            want[language._shares(t)[0]] += 1
            n += 1
    assert used["n"] < 60 < n == used["frequencies"][1]
    assert (used["frequencies"][0] == want).all()
