"""Best items per user by bounds, against scoring every item; draws by permutation."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.operators import sampling, threshold, utility
from rankforge.plans import external


@pytest.fixture(scope="module")
def catalog(spark):
    rng = random.Random(3)
    rows = [(i, f"c{rng.randrange(5)}", f"l{rng.randrange(9)}", round(rng.lognormvariate(3, 1), 2), rng.randrange(40) / 40) for i in range(3000)]
    rows += [(3000 + i, "c0", "l0", 10.0, 0.5) for i in range(50)]  # ties
    rows += [(4000, "c1", "l1", None, 0.5), (4001, None, None, 5.0, 0.1)]
    return rows, spark.createDataFrame(rows, "item_id long, cat_lvl2 string, cat_leaf string, price double, recency_pct double").cache()


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(4)
    rows = []
    for u in range(60):
        shares = lambda letter, n: {f"{letter}{j}": rng.random() for j in rng.sample(range(n), rng.randint(0, 3))}
        rows.append((u, shares("c", 5), shares("l", 9), rng.uniform(2, 4), rng.choice([0.15, 0.5, 2.0]), rng.random()))
    rows.append((97, {}, {}, 100.0, 0.15, 0.0))  # every item alike
    rows.append((98, {"gone": 1.0}, {"l0": 1.0}, 0.0, 0.15, 1.0))
    rows.append((99, {"c0": 1.0}, {"l0": 1.0}, None, None, None))  # no taste
    kinds = "user_id long, cat_lvl2_affinity map<string,double>, cat_leaf_affinity map<string,double>, log_price_center double, log_price_spread double, recency_pref double"
    return rows, spark.createDataFrame(rows, kinds).repartition(3)


def brute(items, user, k):
    _, l2, lf, center, spread, pref = user
    top2, topf = max(l2.values(), default=0) or 1, max(lf.values(), default=0) or 1
    raw = {}
    for i, c2, cf, price, recency in items:
        if price is not None:
            fit = min(max(1 - abs(np.log1p(price) - center) / spread, 0), 1)
            raw[i] = 0.45 * l2.get(c2, 0) / top2 + 0.25 * lf.get(cf, 0) / topf + 0.2 * fit + 0.1 * (recency * pref + (1 - pref) * 0.5)
    lo, hi = min(raw.values()), max(raw.values())
    scaled = {i: 0.5 if hi <= lo else (x - lo) / (hi - lo + 1e-10) for i, x in raw.items()}
    return sorted(scaled, key=lambda i: (-round(scaled[i], 9), i))[:k], scaled, (lo, hi)


@pytest.mark.parametrize("k", [1, 40, 5000])
def test_lists_and_ranges_equal_scoring_everything(spark, catalog, people, k):
    (rows, items), (users, frame) = catalog, people
    best, ranged = external.best_hidden(items, frame, k)
    lists = {}
    for r in sorted(best.collect(), key=lambda r: r["rank"]):
        lists.setdefault(r.user_id, []).append((r.item_id, r.hidden))
    ranges = {r.user_id: (r.raw_lo, r.raw_hi) for r in ranged.collect()}
    assert set(lists) == set(ranges) == {u[0] for u in users} - {99}
    for user in users[:-1]:
        want, scaled, span = brute(rows, user, k)
        got = lists[user[0]]
        assert span == pytest.approx(ranges[user[0]], abs=1e-12)
        assert [scaled[i] for i, _ in got] == pytest.approx([scaled[i] for i in want], abs=1e-9)
        if span[1] - span[0] > 1e-6:
            assert sorted(i for i, _ in got) == sorted(want)


@pytest.mark.parametrize("most", [1, 8])
def test_coarser_pairs_give_the_same_lists(spark, catalog, people, most):
    (_, items), (_, frame) = catalog, people
    relative = utility.relative_shares(frame)
    out = []
    for m in (most, threshold.MOST_BLOCKS):
        blocks = threshold.item_blocks(items, most=m)
        assert blocks.exact == (m > 8)
        found = threshold.scored_candidates(relative, blocks, 30)
        out.append(sorted(map(tuple, threshold.best_items(found, threshold.utility_ranges(found), 30).collect())))
    assert out[0] == out[1]


def test_most_items_stay_closed_and_users_are_not_bounded(spark):
    n_items, n_users, k = 4000, 150_000, 5
    h = lambda c, m: F.pmod(F.xxhash64("id", F.lit(c)), F.lit(m))
    items = spark.range(n_items).select(
        F.col("id").alias("item_id"), F.concat(F.lit("c"), h(1, 10)).alias("cat_lvl2"), F.concat(F.lit("l"), h(2, 20)).alias("cat_leaf"),
        (h(3, 1000) / 10.0 + 1).alias("price"), (h(4, 1000) / 1000.0).alias("recency_pct"),
    )
    users = spark.range(n_users).select(
        F.col("id").alias("user_id"), F.create_map(F.concat(F.lit("c"), h(5, 10)), F.lit(1.0)).alias("cat_lvl2_affinity"),
        F.create_map(F.concat(F.lit("l"), h(6, 20)), F.lit(1.0)).alias("cat_leaf_affinity"),
        (h(7, 40) / 10.0 + 1).alias("log_price_center"), F.lit(0.8).alias("log_price_spread"), F.lit(0.5).alias("recency_pref"),
    )
    blocks = threshold.item_blocks(items)
    asked = threshold.open_blocks(users, blocks, k)
    scored = asked.join(blocks.rows, "block").agg(F.sum(F.size("items")), F.countDistinct("user_id")).first()
    assert scored[1] == n_users and scored[0] / n_users < n_items / 20


def test_no_items(spark, catalog, people):
    best, ranged = external.best_hidden(catalog[1].limit(0), people[1], 5)
    assert best.count() == 0 and ranged.count() == 0


def test_permutation_is_one(spark):
    for rows, columns in ((1, 1), (3, 4), (45, 44), (200, 200)):
        keys = [F.lit(k).cast("long") for k in (7, 123456789, 2147483646, 31)]
        got = [r[0] for r in spark.range(rows * columns).select(sampling.permuted(F.col("id"), keys, rows, columns)).collect()]
        assert sorted(got) == list(range(rows * columns))


def test_draws_are_even(spark):
    asks = spark.range(20000).select(F.lit(1).alias("user_id"), F.col("id").alias("request"))
    items = spark.range(50).select(F.col("id").alias("item_id"))
    seen = spark.createDataFrame([(1, i) for i in range(10)], "user_id int, item_id long")
    drawn = sampling.draw_unseen(asks, seen, sampling.item_index(items), 2, 5)
    first = Counter(r.item_id for r in drawn.filter("draw_rank = 1").collect())
    assert set(first) == set(range(10, 50)) and all(abs(n - 500) < 6 * 500**0.5 for n in first.values())
    pairs = Counter(tuple(r.l) for r in drawn.groupBy("request").agg(F.array_sort(F.collect_list("item_id")).alias("l")).collect())
    assert sum(pairs.values()) == 20000 and len(pairs) > 770  # of 780 pairs


def test_walk_goes_on_for_users_who_saw_nearly_all(spark):
    items = spark.range(1000).select(F.col("id").alias("item_id"))
    seen = spark.range(997).select(F.lit(1).alias("user_id"), F.col("id").alias("item_id")).unionByName(spark.createDataFrame([(2, 5)], "user_id int, item_id long"))
    asks = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (3, 0 + 1)], "user_id int, request long")
    got = {}
    for r in sampling.draw_unseen(asks, seen, sampling.item_index(items), 5, 1).collect():
        got.setdefault((r.user_id, r.request), []).append((r.draw_rank, r.item_id))
    assert {i for _, i in got[1, 0]} == {997, 998, 999} and sorted(n for n, _ in got[1, 0]) == [1, 2, 3]
    assert all(len(got[x]) == 5 for x in ((2, 0), (3, 0), (3, 1))) and got[3, 0] != got[3, 1]


def test_visits_follow_the_users_log(spark):
    log = spark.createDataFrame([(1, 10 + i % 2, i, i) for i in range(30)] + [(2, 5, 0, 0)], "user_id long, item_id long, ts long, event long")
    got = {(r.user_id, r.item_id): r.visits for r in external.visits_by_epoch(log).collect()}
    assert got == {(1, 10): [1, 1, 3, 5, 10, 15], (1, 11): [0, 1, 2, 5, 10, 15], (2, 5): [0, 0, 0, 0, 0, 1]}


def test_every_pair_is_scored(spark, catalog, people):
    """Users and items are dealt into several blocks; no pair is left out."""
    (rows, items), (users, frame) = catalog, people
    ranged = external.best_hidden(items, frame, 5)[1]
    few = items.filter("item_id % 50 = 0 and price is not null")
    got = {(r.user_id, r.item_id): r.hidden for r in threshold.utility_of_all(few, ranged, user_block=7, item_block=9).collect()}
    want = {}
    for user in users[:-1]:
        scaled = brute(rows, user, 1)[1]
        want |= {(user[0], i): x for i, x in scaled.items() if i % 50 == 0}
    assert got == pytest.approx(want, abs=1e-9)


def test_users_are_dealt_by_count_and_not_by_the_size_of_their_table(spark, catalog, people, monkeypatch):
    monkeypatch.setattr(threshold, "USERS_PER_TASK", 5)
    users = utility.relative_shares(people[1]).coalesce(1)
    asked = threshold.open_blocks(users, threshold.item_blocks(catalog[1]), 3)
    assert asked.select(F.spark_partition_id()).distinct().count() > 8


def test_the_product_of_users_and_items_is_not_shuffled(spark, catalog, people):
    """Blocks of both are written once and meet where they are read; items without a category or
    a price are there too."""
    (rows, items), (users, frame) = catalog, people
    ranged = external.with_ranges(items, frame)
    wide = external.best_hidden(items, frame, 40)[1]
    spans = lambda df: {r.user_id: pytest.approx((r.raw_lo, r.raw_hi), abs=1e-12) for r in df.collect()}
    assert spans(wide) == {r.user_id: (r.raw_lo, r.raw_hi) for r in ranged.collect()}
    few = items.filter("item_id >= 3040")
    pairs = threshold.utility_of_all(few, ranged, user_block=7, item_block=3)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Broadcast" not in plan
    got = {(r.user_id, r.item_id): r.hidden for r in pairs.collect()}
    assert len(got) == pairs.count() == 12 * (len(users) - 1)
    for user in users[:-1]:
        assert got.pop((user[0], 4000)) == (0.5 if user[0] == 97 else None)  # to whom every item is alike
        scaled = brute(rows, user, 1)[1]
        assert {i: got[user[0], i] for i in [*range(3040, 3050), 4001]} == pytest.approx({i: scaled[i] for i in [*range(3040, 3050), 4001]}, abs=1e-9)
