import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankforge.functions import profiles as pf
from rankforge.operators import drift, utility
from rankforge.operators import feedback as fb
from rankforge.streaming.ordered import ordered_values, start
from rankforge.streaming.values import streaming_values


def fold(rewards, alpha=0.05):
    q = 0.0
    for r in rewards:
        q += alpha * (r - q)
    return q


@pytest.fixture(scope="module")
def log(spark):
    """600 events; one key holds a third of them."""
    rng = np.random.default_rng(5)
    n = 600
    pdf = pd.DataFrame({
        "event_id": np.arange(n), "ts": np.arange(n) // 2, "event_no": np.arange(1, n + 1),
        "state": np.where(np.arange(n) % 3 == 0, 0, rng.integers(0, 3, n)).astype("int32"),
        "item_id": np.where(np.arange(n) % 3 == 0, 7, rng.integers(0, 20, n)), "reward": rng.normal(size=n),
    })
    return pdf, spark.createDataFrame(pdf)


def test_three_rewards(spark):
    df = spark.createDataFrame([(0, 1, i, i, r) for i, r in enumerate([1.0, 0.0, 1.0])], "state int, item_id long, ts int, event_id int, reward double")
    assert fb.q_values(df).first().q == pytest.approx(0.095125)


def test_q_values_equal_the_fold(log):
    pdf, df = log
    got = fb.q_values(df).toPandas().set_index(["state", "item_id"])
    for key, part in pdf.groupby(["state", "item_id"]):
        assert got.loc[key, "q"] == pytest.approx(fold(part["reward"]), abs=1e-12)
        assert got.loc[key, "visits"] == len(part)


def test_snapshots_equal_the_fold_of_a_prefix(log):
    pdf, df = log
    marks = (5, 50, 200, 1000)
    got = fb.snapshots(df, marks).toPandas().set_index(["checkpoint", "state", "item_id"])
    n = 0
    for m in marks:
        for key, part in pdf[pdf.event_no <= m].groupby(["state", "item_id"]):
            n += 1
            assert got.loc[(m, *key), "q"] == pytest.approx(fold(part["reward"]), abs=1e-12)
            assert got.loc[(m, *key), "visits"] == len(part)
    assert len(got) == n


def test_rewards(spark):
    df = spark.createDataFrame([(0, 1, False, False), (0, 1, True, False), (0, 2, True, True), (0, 2, False, True)], "state int, item_id long, engaged boolean, converted boolean")
    truth = spark.createDataFrame([(0, 2)], "state int, item_id long")
    got = [round(r.reward, 6) for r in fb.rewards(df, truth, 0.2).orderBy("item_id", "engaged").collect()]
    assert got == [-0.02, 0.28, 0.18, 1.48]


def test_contextual_ridge_equals_rank_one_updates(spark, log):
    pdf, df = log
    rng = np.random.default_rng(9)
    x = rng.normal(size=(20, 4))
    contexts = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(20)], "item_id long, x array<double>")
    models = {r.state: r for r in fb.contextual_ridge(df, contexts, 4).collect()}
    for state, part in pdf.groupby("state"):
        a_inv, b = np.eye(4), np.zeros(4)
        for item, r in zip(part["item_id"], part["reward"]):
            v = a_inv @ x[item]
            a_inv -= np.outer(v, v) / (1 + x[item] @ v)
            b += r * x[item]
        np.testing.assert_allclose(models[state].theta, a_inv @ b, atol=1e-9)
        np.testing.assert_allclose(np.reshape(models[state].a_inv, (4, 4)), a_inv, atol=1e-9)
    frame = spark.createDataFrame([(int(s), list(m.theta), list(m.a_inv)) for s, m in models.items()], "state int, theta array<double>, a_inv array<double>")
    row = fb.contextual_scores(contexts, frame, 4).filter("state = 0 AND item_id = 3").first()
    ai = np.reshape(models[0].a_inv, (4, 4))
    assert row.score == pytest.approx(x[3] @ np.array(models[0].theta))
    assert row.ucb == pytest.approx(row.score + 0.6 * np.sqrt(x[3] @ ai @ x[3]))


def test_stream_ends_at_the_batch_state(spark, log, tmp_path):
    pdf, df = log
    for i in range(3):
        df.filter((F.col("event_id") >= 200 * i) & (F.col("event_id") < 200 * (i + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    q = streaming_values(stream).writeStream.outputMode("update").foreachBatch(
        lambda b, i: seen.extend((i, *r) for r in b.collect())
    ).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for i, state, item, value, visits in sorted(seen):
        last[(state, item)] = (value, visits)
    assert len({s[0] for s in seen}) == 3
    for r in fb.q_values(df).collect():
        assert last[(r.state, r.item_id)] == (pytest.approx(r.q, abs=1e-12), r.visits)


def test_ordered_stream_equals_the_batch_fold_over_files_out_of_order_and_a_restart(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):  # minutes in order; a third of the events comes up to two files late
        rows.append((int(rng.integers(2)), int(rng.integers(6)), pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i // 3), i, float(rng.normal()), min(9, i // 60 + int(rng.choice([0, 0, 0, 0, 1, 2])))))
    pdf = pd.DataFrame(rows, columns=["state", "item_id", "ts", "event_id", "reward", "file"])
    schema = "state int, item_id long, ts timestamp, event_id long, reward double"
    folder, seen = tmp_path / "in", []

    def add(files):
        for i in files:
            part = pdf[pdf["file"] == i].drop(columns="file").sample(frac=1.0, random_state=i)
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        out = ordered_values(stream, "60 minutes").writeStream.outputMode("update").foreachBatch(lambda b, i: seen.extend((i, *r) for r in b.collect()))
        start(spark, out.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)).awaitTermination()

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    for first, end in ((0, 5), (5, 10)):  # the second run goes on from the checkpoint
        add(range(first, end))
        run()
        last = {}
        for _, state, item, q, visits, settled in sorted(seen):
            last[(state, item)] = (q, visits)
            assert settled <= visits
        log = spark.createDataFrame(pdf[pdf["file"] < end].drop(columns="file"), schema)
        want = fb.q_values(log).collect()
        assert len(want) == len(last) == 12
        for r in want:
            assert last[(r.state, r.item_id)] == (pytest.approx(r.q, abs=1e-12), r.visits)
    assert len({s[0] for s in seen}) >= 10 and any(s[5] for s in seen)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_exploration_rate(spark):
    row = spark.range(1).select(fb.exploration_rate(F.lit(0)).alias("a"), fb.exploration_rate(F.lit(10)).alias("b"), fb.exploration_rate(F.lit(10**6)).alias("c")).first()
    assert (row.a, row.b, row.c) == (0.3, pytest.approx(0.3 * 0.9997**10), 0.05)


def test_drift_phase_rounds_half_to_even(spark):
    rows = spark.createDataFrame([(9_000,), (10_000,), (17_500,), (25_000,), (10_188,), (10_187,)], "n int")
    got = [r.p for r in rows.select(drift.drift_phase(F.col("n")).alias("p")).collect()]
    assert got == [0, 0, 20, 40, 1, 0]
    # phase 0.5 and 1.5 exactly
    half = spark.createDataFrame([(1,), (3,)], "n int").select(drift.drift_phase(F.col("n"), 0, 80, 40).alias("p"))
    assert [r.p for r in half.collect()] == [0, 2]


def test_flip_and_interpolate(spark):
    prefs = spark.createDataFrame([("a", "lo", 0.1), ("a", "mid", 0.3), ("a", "hi", 0.6)], "owner string, key string, w double")
    flipped = drift.flip_extremes(prefs, ["owner"], "key", "w")
    assert {r.key: r.w for r in flipped.collect()} == {"lo": 0.6, "mid": 0.3, "hi": 0.1}
    mixed = drift.interpolate(prefs.filter("key <> 'mid'"), flipped, ["owner"], "key", "w", [0.5])
    assert {r.key: round(r.w, 9) for r in mixed.collect()} == {"lo": 0.35, "mid": 0.15, "hi": 0.35}


def test_truth_at_follows_the_latest_version(spark):
    versions = [(g, t, 10 * t + g) for g in (0, 1) for t in (0, 5, 9, 30)] + [(2, 50, 1)]
    marks = [(g, c) for g in (0, 1, 2) for c in (0, 4, 5, 8, 9, 29, 30, 100)]
    got = drift.truth_at(
        spark.createDataFrame(marks, "state int, checkpoint long").repartition(3),
        spark.createDataFrame(versions, "state int, phase_start long, item_id int").repartition(3), ["state"],
    )
    want = set()
    for g, c in marks:
        started = [t for h, t, _ in versions if h == g and t <= c]
        want |= {(g, c, i) for h, t, i in versions if started and h == g and t == max(started)}
    assert {tuple(r) for r in got.collect()} == want


def test_phases_of_a_gradual_drift(spark):
    starts = drift.phase_starts(200, 900, 40)
    got = spark.range(0, 1000).select(F.col("id"), drift.drift_phase(F.col("id"), 200, 900, 40).alias("p")).collect()
    for r in got:
        assert r.p == max(i for i, s in enumerate(starts) if s <= r.id)


def test_shifted_and_mixed_profiles(spark):
    columns = [F.col("p")[f].alias(f) for f in utility.PROFILE_FIELDS]
    pre = spark.range(1).select(F.explode(pf.profile_array()).alias("p")).select(*columns)
    post = {r.profile_idx: r for r in drift.shifted_profile(pre).collect()}
    budget = post[0]
    assert budget.brand_pref == {"budget_brand": 0.05, "mid_brand": 0.15, "premium_brand": 0.80}
    assert (budget.price_lo, budget.price_hi, budget.recency_weight) == (260.0, 410.0, 0.9)
    mixed = {(r.profile_idx, r.phase): r for r in drift.profile_phases(pre, drift.shifted_profile(pre), 4).collect()}
    assert len(mixed) == 25
    half = mixed[0, 2]
    assert half.price_lo == 135.0 and abs(half.recency_weight - 0.5) < 1e-12 and abs(half.brand_pref["budget_brand"] - 0.425) < 1e-12
    assert mixed[0, 0].brand_pref == {"budget_brand": 0.80, "mid_brand": 0.15, "premium_brand": 0.05}
