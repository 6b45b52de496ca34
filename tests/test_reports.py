import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.operators import explaining as xp
from rankforge.operators import paired, summary


def pairs(spark, diffs, baseline="b"):
    return spark.createDataFrame([(baseline, i, float(d), 0.0, float(d)) for i, d in enumerate(diffs)], "baseline string, run int, a double, b double, diff double")


def test_fifty_wins(spark):
    got = paired.wilcoxon(pairs(spark, [0.01 * (i + 1) for i in range(50)])).first()
    z = 1275 / 2 / math.sqrt(50 * 51 * 101 / 24)
    assert got.w_plus == 1275.0
    assert got.p_greater == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-9)


def test_wilcoxon_ties_and_zeros(spark):
    got = paired.wilcoxon(pairs(spark, [1, 1, -1, 2, 0])).first()
    # |d| = 1, 1, 1, 2: average rank 2 for the ones, 4 for the two.
    assert (got.w_plus, got.tie_term, got.n_nonzero) == (8.0, 24.0, 4)


def test_all_zero_differences(spark):
    w = paired.wilcoxon(pairs(spark, [0, 0, 0])).first()
    t = paired.paired_t(pairs(spark, [0, 0, 0]), guard=True).first()
    assert (w.w_plus, w.p_greater) == (0.0, 1.0)
    assert (t.t_stat, t.p_value, t.cohen_d, t.significant) == (0.0, 1.0, 0.0, False)


@pytest.mark.parametrize("t, df, p", [(2.0, 10, 0.0733880348), (1.0, 1, 0.5), (0.0, 5, 1.0), (12.706204736, 1, 0.05), (2.0095752, 49, 0.05)])
def test_student_tail(t, df, p):
    assert paired._t_tail(t, df) == pytest.approx(p, rel=1e-6)


def test_student_tail_far_out():
    # 36.1738 with 49 degrees of freedom, a published value.
    assert paired._t_tail(36.1738, 49) == pytest.approx(5.24e-37, rel=0.01)


def test_paired_t(spark):
    d = np.array([0.3, 0.1, 0.25, -0.05, 0.2])
    got = paired.paired_t(pairs(spark, d), n_tests=4).first()
    assert got.t_stat == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(5)))
    assert got.cohen_d == pytest.approx(d.mean() / d.std(ddof=1))
    assert (got.wins, got.ties, got.losses, got.bonferroni_alpha) == (4, 0, 1, 0.0125)


def test_the_order_of_a_sum_makes_no_loss(spark):
    """0.1 + 0.2 against 0.3: a tie, whatever the last bits say."""
    got = paired.paired_t(pairs(spark, [0.3 - (0.1 + 0.2), 0.0, 0.5]), round_digits=9).first()
    assert (got.wins, got.ties, got.losses) == (1, 2, 0)


def test_summaries(spark):
    x = np.random.default_rng(0).random(30)
    df = spark.createDataFrame([("m", i, float(v)) for i, v in enumerate(x)], "method string, run int, f1 double")
    for out in (summary.summarize(df, "f1", ["method"], raw=True, order="run"), summary.summarize_large(df, "f1", ["method"])):
        r = out.first()
        assert (r["mean"], r["std"]) == (pytest.approx(x.mean()), pytest.approx(x.std()))
        assert (r.ci_lo, r.ci_hi) == (pytest.approx(np.percentile(x, 2.5)), pytest.approx(np.percentile(x, 97.5)))
    assert summary.summarize(df, "f1", ["method"], raw=True, order="run").first().raw == pytest.approx(x.tolist())


def test_best_by_prefers_smaller_label(spark):
    df = spark.createDataFrame([(0.2, 0.9), (0.1, 0.9), (0.3, 0.5)], "lam double, f1 double")
    assert summary.best_by(df, "lam", "f1").first().lam == 0.1


@pytest.fixture(scope="module")
def surrogate(spark):
    rng = np.random.default_rng(6)
    x = rng.random((600, 3))
    y = 2 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=600)
    rows = [(i, *map(float, x[i]), float(y[i])) for i in range(600)]
    df = spark.createDataFrame(rows, "item_id long, a double, b double, c double, hybrid double")
    return xp.surrogate_frame(df, ["item_id"], 1, ["a", "b", "c"]).cache()


def test_ridge_matches_closed_form(surrogate):
    ridge = xp.RidgeSurrogate(surrogate, ["a", "b", "c"], alpha=1.0)
    train = surrogate.filter("NOT is_test").toPandas()
    x = train[["a", "b", "c"]].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    y = train["label"].to_numpy()
    want = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean()))
    np.testing.assert_allclose(ridge.coef, want, atol=1e-9)
    scores = {r.is_test: r.r2 for r in xp.r2(ridge.predict(surrogate), ["is_test"]).collect()}
    assert scores[True] > 0.9


def test_shapley_adds_up_and_permutation_finds_the_signal(surrogate):
    forest = xp.forest_surrogate(surrogate, 1, trees=10)
    got = xp.shapley_values(forest, surrogate, ["item_id"], ["a", "b", "c"], rows=40, permutations=3)
    sums = got.groupBy("item_id").agg((F.sum("attribution") + F.first("base")).alias("s"))
    both = sums.join(forest.transform(surrogate), "item_id").select("s", "prediction").collect()
    assert len(both) == 40
    assert all(r.s == pytest.approx(r.prediction, abs=1e-9) for r in both)
    imp = {r.feature: r.permutation_mean for r in xp.permutation_importance(forest, surrogate, ["item_id"], ["a", "b", "c"], repeats=2).collect()}
    assert imp["a"] > imp["b"] > abs(imp["c"])


def test_antithetic_pairs_and_residuals(spark, surrogate):
    forest = xp.forest_surrogate(surrogate, 1, trees=10)
    got = xp.shapley_values(forest, surrogate, ["item_id"], ["a", "b", "c"], rows=40, permutations=4)
    assert all(r.std_error is not None and r.std_error >= 0 for r in got.collect())
    one = xp.shapley_values(forest, surrogate, ["item_id"], ["a", "b", "c"], rows=40, permutations=2)
    assert all(r.std_error is None for r in one.collect())
    assert max(abs(r.residual) for r in xp.additivity(got, forest, surrogate, ["item_id"]).collect()) < 1e-9
    # of two features, both orders are seen by one pair, so the attribution is exact
    two = surrogate.drop("features")
    from pyspark.ml.feature import VectorAssembler

    pair = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(two)
    small = xp.forest_surrogate(pair, 1, trees=5)
    exact = {(r.item_id, r.feature): r.attribution for r in xp.shapley_values(small, two, ["item_id"], ["a", "b"], rows=1000, permutations=2).collect()}
    again = {(r.item_id, r.feature): r.attribution for r in xp.shapley_values(small, two, ["item_id"], ["a", "b"], rows=1000, permutations=8, seed=5).collect()}
    assert all(abs(exact[k] - again[k]) < 1e-9 for k in exact if k in again) and set(exact) & set(again)


def test_every_row_has_attributions(spark, surrogate):
    """No sample by default: rows beyond the 5,000 of the reference are explained as well."""
    forest = xp.forest_surrogate(surrogate, 1, trees=2, depth=3)
    many = surrogate.drop("features").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(8))))
    got = xp.shapley_values(forest, many, ["item_id", "copy"], ["a", "b", "c"], permutations=2)
    assert got.select("item_id", "copy").distinct().count() == 5400 and got.count() == 5400 * 3


def test_exact_signed_ranks(spark):
    from itertools import product

    rng = np.random.default_rng(3)
    groups = {f"g{n}": rng.normal(0.2, 1, n).tolist() for n in (1, 2, 5, 11)}
    rows = [(g, d) for g, ds in groups.items() for d in ds]
    rows += [("tied", 1.0), ("tied", -1.0), ("tied", 2.0), ("zero", 0.0), ("zero", 1.0)] + [("many", float(d)) for d in rng.normal(size=51)]
    got = {r.baseline: r for r in paired.wilcoxon_exact(spark.createDataFrame(rows, "baseline string, diff double").repartition(3)).collect()}
    for g, ds in groups.items():
        order = np.argsort(np.abs(ds))
        ranks = np.empty(len(ds))
        ranks[order] = np.arange(1, len(ds) + 1)
        w = ranks[np.array(ds) > 0].sum()
        tail = np.mean([sum(r for r, keep in zip(ranks, signs) if keep) >= w for signs in product((0, 1), repeat=len(ds))])
        assert got[g].w_plus == w and abs(got[g].p_exact - tail) < 1e-12
    assert got["tied"].p_exact is None and got["zero"].p_exact is None and got["many"].p_exact is None
    fifty = spark.createDataFrame([("b", float(i + 1) * (1 if i % 3 else -1)) for i in range(50)], "baseline string, diff double")
    r = paired.wilcoxon_exact(fifty).first()
    assert abs(r.p_exact - r.p_greater) < 0.01
