import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankforge.functions import hashing, scalars, text
from rankforge.operators import blending, catalog, mcdm, metrics
from rankforge.operators.mcdm import CRITERIA


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("raw, want", [("₹1,099.50", 1099.5), ("64%", 64.0), ("|", None), ("24,269", 24269.0), ("-3", -3.0), (".5x", 0.5), (None, None)])
def test_parse_number(spark, raw, want):
    assert one(spark, text.parse_number, raw) == want


@pytest.mark.parametrize("raw, want", [(" 4.2 ", 4.2), ("|", None), ("", None), (None, None)])
def test_parse_rating(spark, raw, want):
    assert one(spark, text.parse_rating, raw) == want


@pytest.mark.parametrize("raw, want", [("a,b, ,c,", 3), ("", 0), (None, 0), ("x", 1)])
def test_reviewer_count(spark, raw, want):
    assert one(spark, text.reviewer_count, raw) == want


@pytest.mark.parametrize("raw, want", [("Home&Kitchen|X", "HomeKitchen"), ("OfficeProducts", "Computers"), ("Toys", "Electronics"), (None, "Electronics")])
def test_coarse_category(spark, raw, want):
    assert one(spark, text.coarse_category, raw) == want


@pytest.mark.parametrize("raw, want", [("boAt, Rockerz", "boAt"), ("  ", "Unknown"), ("(AT&T) phone", "AT&T"), ("!!! x", "Unknown"), (None, "Unknown"), ("y" * 60, "y" * 40)])
def test_brand_label(spark, raw, want):
    assert one(spark, text.brand_label, raw) == want


def test_text_richness(spark):
    df = spark.createDataFrame([("ab", None, "c"), ("x" * 3000, "", "")], "a string, b string, c string")
    assert [r.r for r in df.select(text.text_richness(F.col("a"), F.col("b"), F.col("c")).alias("r")).collect()] == [5.0, 2000.0]


def test_clip_keeps_null_and_clean_finite(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (float("nan"),), (float("inf"),), (0.4,)], "v double")
    assert df.select(scalars.clip(F.col("v"), 0, 1).alias("r")).first().r is None
    assert [r.r for r in df.select(scalars.clean_finite(F.col("v")).alias("r")).collect()] == [0.0, -1.0, 0.0, 0.0, 0.4]


def test_hash_normal_moments(spark):
    row = spark.range(4000).select(hashing.hash_normal(1, F.col("id")).alias("z")).agg(F.avg("z"), F.stddev_pop("z")).first()
    assert abs(row[0]) < 0.06 and abs(row[1] - 1) < 0.05


def frame(spark, n=200, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(rng.random((n, 4)), columns=CRITERIA)
    pdf["item_id"] = np.arange(n)
    pdf["run"] = np.arange(n) % 2
    return pdf, spark.createDataFrame(pdf)


def direct(x):
    """Plain restatement of the published formulas."""
    x = np.maximum(x, 1e-10)
    p = np.clip(x / x.sum(0), 1e-10, 1)
    d = 1 + (p * np.log(p)).sum(0) / math.log(len(x))
    w = np.maximum(0.1 + d / d.sum() * 0.6, 0.1)
    w = w / w.sum()
    v = x / np.sqrt((x * x).sum(0)) * w
    up, down = np.linalg.norm(v - v.max(0), axis=1), np.linalg.norm(v - v.min(0), axis=1)
    return w, down / (up + down)


def test_topsis_overall_and_by_run(spark):
    pdf, df = frame(spark)
    w, score = direct(pdf[list(CRITERIA)].to_numpy())
    got = mcdm.topsis(df, keep_weights=True).toPandas().sort_values("item_id")
    np.testing.assert_allclose(got["topsis"], score, atol=1e-12)
    np.testing.assert_allclose(got[[f"w_{c}" for c in CRITERIA]].iloc[0], w, atol=1e-12)
    by = mcdm.topsis(df, by=["run"]).toPandas().sort_values("item_id")
    for run in (0, 1):
        part = pdf[pdf.run == run]
        np.testing.assert_allclose(by[by.run == run]["topsis"], direct(part[list(CRITERIA)].to_numpy())[1], atol=1e-12)


def test_weights_are_bounded_and_degenerate_cases_equal(spark):
    pdf, df = frame(spark, 50, 4)
    w = mcdm.entropy_weights(df).first()
    assert abs(sum(w) - 1) < 1e-12 and min(w) > 0.0999
    flat = spark.range(4).select(*[F.lit(0.5).alias(c) for c in CRITERIA])
    assert list(mcdm.entropy_weights(flat).first()) == [0.25] * 4
    assert list(mcdm.entropy_weights(flat.limit(1)).first()) == [0.25] * 4


def test_blending_counts_missing_values_as_zero(spark):
    df = spark.createDataFrame([(1, 2.0, 0.1, 900), (2, None, 0.3, None), (3, 1.0, 0.2, 300)], "item_id int, q double, topsis double, visits int")
    got = {r.item_id: r for r in blending.confidence_gated(df.withColumn("g", F.lit(0)), ["g"]).collect()}
    assert got[2].q_norm == 0.0 and got[2].lambda_q == 0.0 and got[2].gated == got[2].t_norm
    assert abs(got[1].lambda_q - 0.5 * (1 - math.exp(-3))) < 1e-12


def lists(spark, rows):
    return spark.createDataFrame(rows, "g int, rank int, item_id long")


def test_list_metrics_literals(spark):
    truth = spark.createDataFrame([(0, 10), (0, 11), (0, 12)], "g int, item_id long")
    rows = lists(spark, [(0, 1, 10), (0, 2, 5), (0, 3, 11), (1, 1, 10)])
    got = {r.g: r for r in metrics.list_metrics(rows, truth, ["g"], ["g"]).collect()}
    assert got[0].f1 == pytest.approx(2 * 2 / 6)
    ideal = 1 + 1 / math.log2(3) + 0.5
    assert got[0].ndcg == pytest.approx((1 + 0.5) / ideal)
    assert (got[1].f1, got[1].ndcg) == (0.0, 0.0)


def test_rank_metrics_at_two(spark):
    truth = spark.createDataFrame([(0, 5)], "g int, item_id long")
    ranks = metrics.best_hit_rank(lists(spark, [(0, 1, 10), (0, 2, 5), (1, 1, 5)]), truth, ["g"], ["g"])
    got = {r.g: (r.hit, round(r.ndcg, 5), r.mrr) for r in metrics.rank_metrics(ranks).collect()}
    assert got == {0: (1.0, 0.63093, 0.5), 1: (0.0, 0.0, 0.0)}


def test_intra_list_distance(spark):
    items = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 0.0, 1.0)], "item_id long, a double, b double")
    rows = lists(spark, [(0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 1, 2)])
    got = {r.g: r.ild for r in metrics.intra_list_distance(rows, items, ["g"], features=["a", "b"]).collect()}
    assert got[0] == pytest.approx((5 + 1 + math.sqrt(18)) / 3) and got[1] == 0.0


def test_dedupe_keeps_most_rated(spark):
    df = spark.createDataFrame([("p", 4.0, 10.0, "x"), ("p", 4.5, 10.0, "y"), ("p", 5.0, 9.0, "z")], "product_id string, rating double, rating_count double, name string")
    assert catalog.dedupe_catalog(df).first().name == "y"


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="price_pct"):
        catalog.require_columns(spark.range(1), ["id", "price_pct"])
