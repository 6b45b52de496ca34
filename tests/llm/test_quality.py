import random

import numpy as np

from rankforge.llm import quality as q


def texts(seed, n):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(500)]
    good = lambda: (" ".join(r.choice(vocab) for _ in range(r.randint(5, 80))) + ".").capitalize()
    bad = lambda: r.choice([
        " ".join(r.choice(vocab).upper() + "!!" for _ in range(r.randint(5, 60))), " ".join([r.choice(vocab)] * r.randint(10, 60)), " | ".join(r.choice(vocab) for _ in range(40)),
    ])
    return [(good() if i % 2 else bad(), i % 2 == 1) for i in range(n)]


def test_held_out_accuracy():
    rows, other = texts(1, 600), texts(2, 300)
    m = q.fit([q.features(t) for t, _ in rows], np.array([y for _, y in rows]))
    right = [(m.score(q.features(t)) >= q.THRESHOLD) == y for t, y in other]
    assert np.mean(right) > 0.97


def test_dual_coordinate_descent_meets_the_optimality_conditions():
    r = np.random.default_rng(3)
    rows = [np.sort(r.choice(50, 8, replace=False)) for _ in range(80)]
    values = [np.ones(8) for _ in rows]
    signs = np.where([0 in x or 1 in x or 2 in x for x in rows], 1.0, -1.0)
    w = q.dual_coordinate_descent(rows, values, signs, np.full(80, 0.5), epochs=2000)

    def loss(w):
        return w @ w / 2 + 0.5 * sum(max(0, 1 - s * w[x].sum()) for x, s in zip(rows, signs))

    base = loss(w)
    for _ in range(200):
        step = np.zeros(q.FEATURES)
        step[:50] = r.normal(0, 1e-2, 50)
        assert loss(w + step) >= base - 1e-4


def test_features_of_slices(monkeypatch):
    assert len(q.features("")) == 0 and len(q.features(" ")) == 0
    a = q.features("Hello hello world *** 12")
    assert (np.diff(a) > 0).all() and a.max() < q.FEATURES


def test_one_class_and_hard_rows(spark):
    docs = spark.createDataFrame([(1, "good words here", 1.0), (2, None, 2.0), (3, "", 2.0), (3, "", 2.0), (None, "x " * 100_000, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    rows = q.score_documents(docs, labels).collect()
    assert len(rows) == 5 and len({r.score for r in rows}) == 1 and all(0 < r.score < 1 and r.predicted == 1 for r in rows)
    none = q.score_documents(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert q.keep_good(docs, labels).columns == docs.columns


def test_bound_on_labelled_rows(spark):
    rows = texts(4, 200)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, (_, y) in enumerate(rows)], "doc_id long, quality int")
    a, b = q.train(docs, labels, max_labelled=40), q.train(docs.repartition(3), labels.repartition(2), max_labelled=40)
    assert np.array_equal(a.weights, b.weights) and a.slope == b.slope
    assert not np.array_equal(a.weights, q.train(docs, labels).weights)
