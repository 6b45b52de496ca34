import math
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.functions import profiles as pf
from rankforge.plans import external

N = len(external.EPOCHS)


@pytest.fixture(scope="module")
def scored(spark):
    """Users with 3 to 30 candidates and many equal scores, side by side in their task."""
    rng = np.random.default_rng(4)
    rows = []
    for u in range(25):
        for i in rng.permutation(40)[: 3 + u + u // 5].tolist():
            few = lambda n=N: [float(v) for v in rng.integers(0, 4, n) / 4]
            x = few(5)
            rows.append((u, i, bool(rng.random() < 0.3), few(1)[0], few(1)[0], *x, few(1)[0], rng.integers(0, 3, N).tolist(), [0.0] * N, [0.0] + [0.1 + u / 50] * (N - 1)))
    names = ", ".join(f"{c} double" for c in ("topsis", "t_norm", *pf.FEATURES))
    df = spark.createDataFrame(rows, f"user_id long, item_id long, is_truth boolean, {names}, hidden double, visits array<long>, q_lo array<double>, q_hi array<double>")
    return rows, df.repartition(3, "user_id").sortWithinPartitions("user_id")


def brute(rows, user, score, truth):
    mine = sorted((r for r in rows if r[0] == user), key=lambda r: (score(r), r[1]))[: pf.TOP_K]
    tp = sum(r[2] for r in mine)
    dcg = sum(1 / math.log2(n + 2) for n, r in enumerate(mine) if r[2])
    ideal = sum(1 / math.log2(n + 2) for n in range(min(truth, pf.TOP_K)))
    apart = [math.dist(a[5:10], b[5:10]) for n, a in enumerate(mine) for b in mine[n + 1 :]]
    return len(mine), truth, tp, 2 * tp / (len(mine) + truth) if truth else 0.0, dcg / ideal if truth else 0.0, sum(apart) / len(apart)


@pytest.mark.parametrize("batch", [7, 10000])
def test_lists_are_ranked_in_the_users_task(spark, scored, batch):
    """A row per candidate, not per candidate and epoch; ties, short lists and users across batches."""
    rows, df = scored
    truth = df.filter("is_truth").select("user_id", "item_id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {tuple(r[:3]): r[3:] for r in external.evaluate(df, truth).collect()}
        curve = {tuple(r[:2]): r[2:] for r in external.blend_curve(df, truth).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pop = 5 + pf.FEATURES.index("popularity_pct")
    assert len(got) == 25 * N * 6 and len(curve) == 25 * len(pf.LAMBDA_GRID)
    def value(r, n):
        return r[10] * (1 - 0.95 ** r[11][n])

    def norm(r, n):
        return 0.5 if r[13][n] <= r[12][n] else (value(r, n) - r[12][n]) / (r[13][n] - r[12][n] + 1e-10)

    def blend(w, r, n):
        return -round(w * norm(r, n) + (1 - w) * r[4], 9)

    for u in range(25):
        n_truth = sum(r[2] for r in rows if r[0] == u)
        for n, e in enumerate(external.EPOCHS):
            by = {
                "random": lambda r: md5(f"random|{u}|{e}|{r[1]}".encode()).hexdigest(), "popularity": lambda r: -r[pop], "topsis_only": lambda r: -r[3],
                "rl_only": lambda r: -round(value(r, n), 9), "hybrid": lambda r: blend(0.5, r, n),
                "gated": lambda r: blend(0.5 * (1 - math.exp(-r[11][n] / 8)), r, n),
            }
            for m, score in by.items():
                assert got[u, e, m] == pytest.approx(brute(rows, u, score, n_truth))
        for w in pf.LAMBDA_GRID:
            assert curve[u, w] == pytest.approx(brute(rows, u, lambda r: blend(w, r, -1), n_truth)[:5])


def test_candidates_are_not_repeated_per_epoch(spark):
    from rankforge.workload import interaction_queries as iq

    sf = "/root/testdata/sf0.001"
    scores = iq.external_scores(spark, sf)
    assert scores.count() == iq.eval_pairs(spark, sf).count() > 0 and "epoch" not in scores.columns
    assert scores.filter(F.size("visits") != N).isEmpty()
