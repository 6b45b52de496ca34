import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankforge.operators import ordering as o
from rankforge.operators.ranking import full_rank, keep_first, top_k, top_k_of_unit_scores


@pytest.fixture(scope="module")
def skewed(spark):
    """3000 rows, a third of them in one group, values with many ties."""
    rng = np.random.default_rng(3)
    g = np.where(np.arange(3000) % 3 == 0, 0, rng.integers(1, 40, 3000))
    pdf = pd.DataFrame({"id": np.arange(3000), "g": g, "x": rng.integers(0, 25, 3000).astype(float)})
    pdf.loc[pdf.id % 11 == 0, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    return pdf, df


def test_positions_in_hot_group(skewed):
    pdf, df = skewed
    got = o.ordered_position(df.select("id", "g"), ["g"], ["id"]).toPandas().sort_values("id")
    want = pdf.sort_values("id").groupby("g").cumcount() + 1
    assert (got["pos"].to_numpy() == want.to_numpy()).all()
    assert (got["n"].to_numpy() == pdf.groupby("g")["id"].transform("size").to_numpy()).all()


def test_hot_group_is_split_over_slices(spark):
    df = spark.range(20_000).withColumn("g", F.lit(1))
    placed = o.ordered_position(df, ["g"], ["id"])
    assert placed.agg(F.max("pos"), F.countDistinct("pos")).first()[:] == (20_000, 20_000)
    parts = df.repartitionByRange("g", "id").withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(parts) > 1


@pytest.mark.parametrize("by", [[], ["g"]])
def test_percentile_ranks_match_average_ranks(skewed, by):
    pdf, df = skewed
    got = o.percentile_ranks(df, {"p": ("x", False), "q": ("x", True)}, ["id"], by).toPandas().sort_values("id")
    ranks = (pdf.groupby("g")["x"] if by else pdf["x"]).rank(pct=True, method="average")
    np.testing.assert_allclose(got["p"].to_numpy(float), ranks.to_numpy(), atol=1e-12)
    np.testing.assert_allclose(got["q"].to_numpy(float), 1 - ranks.to_numpy(), atol=1e-12)


def test_percentile_literals(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 3.0), (5, None)], "id int, x double")
    rows = {r.id: (r.p, r.q) for r in o.percentile_ranks(df, {"p": ("x", False), "q": ("x", True)}, ["id"]).collect()}
    assert rows == {1: (0.25, 0.75), 2: (0.625, 0.375), 3: (0.625, 0.375), 4: (1.0, 0.0), 5: (None, None)}


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_interpolate(skewed, by):
    pdf, df = skewed
    got = o.quantiles(df, "x", {"a": 0.25, "b": 0.5, "c": 0.975}, by).toPandas()
    if not by:
        np.testing.assert_allclose(got.iloc[0].to_numpy(float), np.nanpercentile(pdf["x"], [25, 50, 97.5]))
        return
    want = pdf.dropna().groupby("g")["x"].quantile([0.25, 0.5, 0.975]).unstack()
    got = got.set_index("g").loc[want.index]
    np.testing.assert_allclose(got[["a", "b", "c"]].to_numpy(), want.to_numpy())


def test_join_unique_serves_hot_and_rare_keys(spark):
    left = spark.range(1000).select("id", F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("k"))
    right = left.groupBy("k").count().filter("k <> 999").withColumn("v", F.col("k") * 2)
    out = o.join_unique(left, right, ["k"], F.col("count") >= 10, ["id"])
    assert out.count() == 1000
    assert out.filter("v = k * 2").count() == 999
    assert out.filter("v IS NULL").count() == 1


def test_min_max_of_constant_is_half(spark):
    df = spark.range(5).withColumn("c", F.lit(3.0))
    assert {r.s for r in o.min_max(df, {"s": "c"}).collect()} == {0.5}


def test_explode_range_in_blocks(spark):
    df = spark.createDataFrame([(1, 0, 24), (2, 5, 4), (3, 7, 7)], "id int, lo long, hi long")
    rows = o.explode_range(df, "i", F.col("lo"), F.col("hi"), block=10).groupBy("id").agg(
        F.count("*").alias("n"), F.countDistinct("i").alias("d"), F.min("i").alias("a"), F.max("i").alias("b")
    )
    assert {r.id: (r.n, r.d, r.a, r.b) for r in rows.collect()} == {1: (25, 25, 0, 24), 3: (1, 1, 7, 7)}


def test_top_k_large_equals_small_path(spark):
    df = spark.range(3000).select(F.col("id").alias("item_id"), (F.col("id") % 3).alias("g"), (F.col("id") * 7 % 101).cast("double").alias("s"))
    big = top_k(df, "s", 1200, ["g"])
    assert big.filter("g = 0").count() == 1000
    full = full_rank(df, "s", ["g"])
    assert big.select("g", "item_id", "rank").exceptAll(full.select("g", "item_id", "rank")).count() == 0


def test_keep_first(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("b", 1, 1)], "k string, x int, y int")
    assert sorted(map(tuple, keep_first(df, ["k"], [-F.col("x")]).collect())) == [("a", 2, 4), ("b", 1, 1)]


@pytest.mark.parametrize("k", [1, 7, 40, 5000])
def test_histogram_top_k_equals_top_k(spark, k):
    df = spark.range(3000).select(
        F.col("id").alias("item_id"), (F.col("id") % 2).alias("g"), ((F.col("id") * 37 % 500) / 499.0).alias("s")
    )
    got = top_k_of_unit_scores(df, "s", k, ["g"], buckets=10)
    assert got.select("g", "item_id", "rank").exceptAll(top_k(df, "s", k, ["g"]).select("g", "item_id", "rank")).count() == 0
    assert got.count() == 2 * min(k, 1500)


def test_short_groups_are_summed_in_one_piece_and_long_ones_in_slices(spark):
    rows = [(0, i, i % 7) for i in range(200)] + [(u, i, u + i) for u in range(1, 40) for i in range(u % 6 + 1)]
    df = spark.createDataFrame(rows, "u long, o long, a long").repartition(5)
    key = lambda d: sorted(tuple(sorted(r.asDict().items())) for r in d.collect())
    for amount in (None, "a"):
        want = key(o.running_totals(df, ["u"], ["o"], amount))
        for most in (1, 50, 1000):
            got = o.grouped_totals(df, ["u"], ["o"], amount, most)
            assert key(got) == want and len(want) == len(rows)
            sliced = "_rt_slice" in got._jdf.queryExecution().optimizedPlan().toString()
            assert sliced == (most < 200)
    assert o.grouped_totals(df.limit(0), ["u"], ["o"]).count() == 0
