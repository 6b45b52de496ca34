import random

from pyspark.sql import functions as F

from rankforge.functions import profiles as pf
from rankforge.operators import drift, grid_targets, utility
from rankforge.operators.ranking import from_cut, top_k, with_cuts

ITEM = "item_id {}, brand string, category string, price double, recency_pct double, observable double"


def catalog(spark, kind="long", n=300):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        row = (rng.choice(["budget_brand", "premium_brand", None, "none"]), rng.choice(["Electronics", "Computers", "other", None]),
               rng.choice([None, 50.0, 300.0, 900.0]), rng.choice([0.0, 0.5, 1.0]), rng.choice([0.0, 0.7, 1.0]))
        rows.append((i if kind == "long" else f"B{i}", *row))
    return spark.createDataFrame(rows, ITEM.format(kind))


def phases(spark):
    pre = spark.range(1).select(F.explode(pf.profile_array()).alias("p")).select(*[F.col("p")[f].alias(f) for f in utility.PROFILE_FIELDS])
    return drift.profile_phases(pre, drift.shifted_profile(pre), 4)


def in_rows(items, grid, by, k):
    frame = utility.with_each(items, grid)
    target = utility.blend_target(utility.hidden_utility(frame, by), by, noise_sd=0.0)
    return top_k(target, "target", k, by)


def listed(df):
    return sorted((r.profile_idx, r.phase, r["rank"], r.item_id, None if r.target is None else round(r.target, 9)) for r in df.collect())


def test_equals_a_row_per_item_and_profile(spark, monkeypatch):
    monkeypatch.setattr(grid_targets, "BLOCK", 16)
    grid, by = phases(spark), ["profile_idx", "phase"]
    for items, k in ((catalog(spark), 7), (catalog(spark, "string"), 7), (catalog(spark, n=5), 7), (catalog(spark).filter("price is null"), 3)):
        assert listed(grid_targets.best_targets(items, grid, by, k)) == listed(in_rows(items, grid, by, k))


def test_rows_leave_tasks_by_profile_and_not_by_item(spark):
    """No stage carries the product of items and profiles."""
    grid, items = phases(spark), catalog(spark, n=50)
    plan = grid_targets.best_targets(items, grid, ["profile_idx", "phase"], 7)._jdf.queryExecution().toString()
    assert "Generate" not in plan
    assert grid_targets.best_targets(items, grid, ["profile_idx", "phase"], 7).count() == grid.count() * 7


def test_cuts_keep_every_list_and_sort_few_rows(spark):
    rows = spark.range(4000).select(
        (F.col("id") % 2).alias("g"), F.col("id").alias("item_id"), (F.pmod(F.xxhash64("id"), F.lit(500)) / 500).alias("a"),
        F.when(F.col("id") % 400 < 2, F.rand(3)).alias("b"), F.lit(0.5).alias("c"),
    ).localCheckpoint()
    cut = with_cuts(rows, ("a", "b", "c"), 7, ["g"])
    for score in ("a", "b", "c"):
        kept = from_cut(cut, score)
        assert [tuple(r) for r in top_k(kept, score, 7, ["g"]).select("g", "rank", "item_id").orderBy("g", "rank").collect()] == [
            tuple(r) for r in top_k(rows, score, 7, ["g"]).select("g", "rank", "item_id").orderBy("g", "rank").collect()]
    assert from_cut(cut, "a").count() < 300
    assert from_cut(with_cuts(rows.filter("item_id < 6"), ("a",), 7, ["g"]), "a").count() == 6
