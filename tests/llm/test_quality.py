import random

import numpy as np
from helpers import odd_frame, prose

from folioseek.llm.quality import FEATURES, Forest, boost, constant, document_statistics, features_of, score, train


def walked(forest: Forest, row):
    """One row down the trees, node by node."""
    total = forest.base
    for f, t, v in zip(forest.feature, forest.threshold, forest.value):
        at = 0
        for _ in range(forest.depth):
            at = 2 * at + 1 + (row[f[at]] > t[at])
        total += v[at - (2**forest.depth - 1)]
    return 1 / (1 + np.exp(-total))


def test_flat_arrays_walk_as_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)).round(1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    forest = boost(x, y, trees=20, depth=3)
    assert np.allclose(forest.scores(x), [walked(forest, r) for r in x])
    assert ((forest.scores(x) > 0.5) == y).mean() > 0.97


def test_single_class_and_no_rows():
    x = np.zeros((4, 3))
    assert boost(x, np.ones(4)).scores(x).min() > 0.99 and boost(x, np.zeros(4)).scores(x).max() < 0.01
    assert boost(np.zeros((0, 3)), np.zeros(0)).scores(x).tolist() == [0.5] * 4 and constant(0.5).scores(x[:0]).shape == (0,)
    tied = boost(x, np.array([0.0, 1, 0, 1]))
    assert np.allclose(tied.scores(x), 0.5)


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(800):
        text = prose(rng, rng.randint(20, 80))
        good = i % 4 != 0
        if not good:
            text = rng.choice([str.upper, lambda t: t.replace(" ", "$$$ "), lambda t: t.replace(" ", " | "), lambda t: "\n".join([t[:40]] * 12)])(text)
        docs.append((i, text, "s", 1, "z")), labels.append((i, int(good)))
    statistics = document_statistics(odd_frame(spark, docs))
    known = spark.createDataFrame([x for x in labels if x[0] % 3] + [(None, 1), (5, None), (6, 0)], "doc_id long, quality int")
    rows = score(statistics, train(statistics, known)).collect()
    right = [(r["score"] >= 0.5) == (r["doc_id"] % 4 != 0) for r in rows if r["doc_id"] % 3 == 0]
    assert np.mean(right) > 0.95


def test_odd_rows_and_empty_tables(spark):
    assert features_of(None) == features_of(b"") == features_of(b" \n") == [0.0] * len(FEATURES)
    statistics = document_statistics(odd_frame(spark))
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = score(statistics, train(statistics, none), to="items").collect()
    assert len(rows) == 11 and {r["items"] for r in rows} == {0.5}
    labels = spark.createDataFrame([(1, 0), (4, 1), (5, 1), (6, 1), (2, 0)], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in score(statistics, train(statistics, labels)).collect())
    empty = document_statistics(odd_frame(spark, []))
    assert score(empty, train(empty, labels)).count() == 0
