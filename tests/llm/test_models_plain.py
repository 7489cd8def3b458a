"""The two trained models held against plain versions of what they minimise."""

import math
from collections import defaultdict

import numpy as np
import pytest

from tenmark.llm import language, quality

TEXTS = [("the house and the tree stand here", "en"), ("das haus und der baum stehen hier", "de"), ("la maison et les arbres sont la", "fr"), ("a tree with green leaves", "en"), ("ein baum mit blättern", "de"), ("un arbre et des feuilles", "fr")] * 3


def plain_ftrl(rows, epochs, alpha, beta, l1, l2, scale, seed):
    """Follow-the-regularised-leader, one coordinate at a time."""
    classes = sorted({c for _, c in rows})
    feats = [(dict(zip(*(x.tolist() for x in language._shares(t)), strict=True)), classes.index(c)) for t, c in rows]
    seen = defaultdict(int)
    for f, _ in feats:
        for k in f:
            seen[k] += 1
    idf = {k: math.log((1 + len(feats)) / (1 + n)) + 1 for k, n in seen.items()}
    order = np.random.default_rng(seed).permutation(len(feats))
    used = order[len(order) // 5 :]
    z, n = defaultdict(lambda: [0.0] * len(classes)), defaultdict(lambda: [0.0] * len(classes))

    def weight(k, c):
        if abs(z[k][c]) <= l1:
            return 0.0
        return -(z[k][c] - math.copysign(l1, z[k][c])) / ((beta + math.sqrt(n[k][c])) / alpha + l2)

    for epoch in range(epochs):
        for row in np.random.default_rng(seed + epoch).permutation(used):
            f, gold = feats[row]
            x = {k: share * idf[k] * scale for k, share in f.items()}
            w = {k: [weight(k, c) for c in range(len(classes))] for k in x}
            logits = [sum(x[k] * w[k][c] for k in x) for c in range(len(classes))]
            e = [math.exp(v - max(logits)) for v in logits]
            p = [v / sum(e) - (c == gold) for c, v in enumerate(e)]
            for k, v in x.items():
                for c in range(len(classes)):
                    g = v * p[c]
                    z[k][c] += g - (math.sqrt(n[k][c] + g * g) - math.sqrt(n[k][c])) / alpha * w[k][c]
                    n[k][c] += g * g
    return {k: [weight(k, c) * idf[k] * scale for c in range(len(classes))] for k in z}


@pytest.mark.parametrize("l1", [0.0, 0.05])
def test_language_weights_equal_a_plain_fit(l1):
    args = {"epochs": 3, "alpha": 0.5, "beta": 1.0, "l1": l1, "l2": 1e-2, "scale": 30.0, "seed": 3}
    model, want = language.fit(TEXTS, **args), plain_ftrl(TEXTS, **args)
    table = model.table * model.temperature
    assert np.flatnonzero(np.abs(table).sum(axis=1)).tolist() == sorted(k for k, w in want.items() if any(w))
    for k, w in want.items():
        assert table[k] == pytest.approx(w, rel=1e-4, abs=1e-5)


def test_temperature_is_the_best_of_a_grid():
    model = language.fit(TEXTS)
    assert 0.05 <= model.temperature <= 20


def test_lasso_weights_meet_the_optimality_conditions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.2) & (x[:, 1] < 0.5) | (rng.random(400) < 0.1)).astype(float)
    weight, penalty = np.ones(400), 1e-3
    model = quality.fit(x, y, weight, trees=10, penalty=penalty, steps=4000)
    assert model.rules
    a = np.array([r.holds(x) for r in model.rules], float).T
    p = 1 / (1 + np.exp(-(a @ np.array(model.weights) + model.bias)))
    slope = a.T @ ((p - y) / 400)
    # of the lasso's minimum: a weight's slope balances the penalty, the bias has none
    assert slope == pytest.approx(-penalty * np.sign(model.weights), abs=1e-4)
    assert ((p - y) / 400).sum() == pytest.approx(0, abs=1e-4)


def test_repeated_labels_and_classes_without_texts(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, ("good words in a row " if k % 2 else "x! ") * (1 + k % 5)) for k in range(40)] + [(100, None)], "doc_id long, text string")
    labels = [(k, k % 2) for k in range(40)] * 3 + [(7, 0), (None, 1), (3, None), (100, 1), (5, 9)]
    known = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    for some in (labels, [(k, k % 2 if k < 20 else 1) for k in range(20)] + [(500 + k, 0) for k in range(5)], [(900, 1), (901, 0)], [(1, 1)], []):
        model = quality.fit_quality(docs, known(some), F.lit(True))
        got = quality.quality_scores(docs, model, F.lit(False)).collect()
        assert len(got) == 41 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    scores = {r.doc_id: r.score for r in quality.quality_scores(docs, quality.fit_quality(docs, known(labels), F.lit(True)), F.lit(False)).collect()}
    assert min(scores[k] for k in range(1, 40, 2)) > max(scores[k] for k in range(0, 40, 2))
