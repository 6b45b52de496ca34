"""Metrics of ranked lists. A list is a set of rows (group..., rank, item_id)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.functions.profiles import FEATURES, TOP_K
from rankforge.functions.scalars import discount
from rankforge.operators.ordering import attach


def hits(lists: DataFrame, truth: DataFrame, truth_by: Sequence[str]) -> DataFrame:
    """The list rows that are in the truth."""
    return lists.join(truth.select(*truth_by, "item_id").distinct(), [*truth_by, "item_id"], "left_semi")


def _ideal(n: Column) -> Column:
    ranks = F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1)))
    return F.aggregate(ranks, F.lit(0.0), lambda acc, r: acc + discount(r))


def f1_and_ndcg(n_pred: Column, n_truth: Column, tp: Column, dcg: Column, k: int = TOP_K) -> tuple[Column, Column]:
    """F1 and NDCG from counts and the discounted hits; zero without a truth."""
    f1 = F.when(n_truth == 0, 0.0).otherwise(2.0 * tp / (n_pred + n_truth))
    return f1, F.when(n_truth == 0, 0.0).otherwise(dcg / _ideal(F.least(n_truth, F.lit(k))))


def list_metrics(
    lists: DataFrame, truth: DataFrame, by: Sequence[str], truth_by: Sequence[str], k: int = TOP_K
) -> DataFrame:
    """F1 and NDCG of every list against the truth of its group; zero when one of
    the two is empty. ``truth_by`` is a subset of ``by``."""
    by, truth_by = list(by), list(truth_by)
    facts = truth.select(*truth_by, "item_id").distinct()
    sizes = facts.groupBy(*truth_by).agg(F.count("*").alias("n_truth"))
    marked = lists.filter(F.col("rank") <= k).join(
        facts.withColumn("_hit", F.lit(1)), [*truth_by, "item_id"], "left"
    )
    hit = F.coalesce("_hit", F.lit(0))
    per_list = marked.groupBy(*by).agg(
        F.count("*").alias("n_pred"),
        F.sum(hit).alias("tp"),
        F.sum(F.when(hit == 1, discount(F.col("rank"))).otherwise(0.0)).alias("_dcg"),
    )
    if truth_by:
        joined = per_list.join(sizes, truth_by, "left")
    else:
        joined = attach(per_list, sizes)
    n_truth = F.coalesce("n_truth", F.lit(0))
    f1, ndcg = f1_and_ndcg(F.col("n_pred"), n_truth, F.col("tp"), F.col("_dcg"), k)
    return joined.select(*by, "n_pred", n_truth.alias("n_truth"), "tp", f1.alias("f1"), ndcg.alias("ndcg"))


def intra_list_distance(
    lists: DataFrame, items: DataFrame, by: Sequence[str], item_by: Sequence[str] = (),
    features: Sequence[str] = FEATURES,
) -> DataFrame:
    """Mean pairwise Euclidean distance inside each list (top-k, so at most k
    vectors per group); zero below two items."""
    vectors = items.select(*item_by, "item_id", F.array(*features).alias("_x"))
    grouped = (
        lists.join(vectors, [*item_by, "item_id"])
        .groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct("item_id", "_x"))).alias("_l"))
    )

    def distance(a: Column, b: Column) -> Column:
        square = F.zip_with(a["_x"], b["_x"], lambda x, y: (x - y) * (x - y))
        return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, v: s + v))

    rows = F.col("_l")
    pairs = F.flatten(
        F.transform(
            rows, lambda a, i: F.transform(F.slice(rows, i + 2, F.size(rows)), lambda b: distance(a, b))
        )
    )
    total = F.aggregate("_d", F.lit(0.0), lambda s, v: s + v)
    mean = F.try_divide(total, F.size("_d").cast("double"))
    return grouped.withColumn("_d", pairs).select(*by, F.coalesce(mean, F.lit(0.0)).alias("ild"))


def best_hit_rank(lists: DataFrame, truth: DataFrame, by: Sequence[str], truth_by: Sequence[str]) -> DataFrame:
    """Smallest rank of a relevant item per list, null without one."""
    facts = truth.select(*truth_by, "item_id").distinct().withColumn("_hit", F.lit(True))
    marked = lists.join(facts, [*truth_by, "item_id"], "left")
    return marked.groupBy(*by).agg(F.min(F.when(F.col("_hit"), F.col("rank"))).alias("best_rank"))


def rank_metrics(ranks: DataFrame, rank: str = "best_rank") -> DataFrame:
    """hit, ndcg and mrr of a single rank; zero when there is none."""
    r = F.col(rank)
    return ranks.select(
        "*",
        r.isNotNull().cast("double").alias("hit"),
        F.coalesce(discount(r), F.lit(0.0)).alias("ndcg"),
        F.coalesce(1.0 / r.cast("double"), F.lit(0.0)).alias("mrr"),
    )


def coverage(lists: DataFrame, catalog: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct recommended items over catalog size."""
    size = catalog.agg(F.countDistinct("item_id").alias("_size"))
    seen = lists.groupBy(*by).agg(F.countDistinct("item_id").alias("n_listed"))
    return attach(seen, size).select(*by, "n_listed", (F.col("n_listed") / F.col("_size")).alias("coverage"))


def leaderboard(
    lists: DataFrame, truth: DataFrame, users: DataFrame, catalog: DataFrame, by: Sequence[str] = ("model",)
) -> DataFrame:
    """Mean hit, ndcg, mrr over all users, and coverage, per model. Users without
    a list of a model count as misses."""
    n_users = users.select("user_id").distinct().agg(F.count("*").alias("_users"))
    ranks = rank_metrics(best_hit_rank(lists, truth, [*by, "user_id"], ["user_id"]))
    sums = ranks.groupBy(*by).agg(*[F.sum(m).alias(m) for m in ("hit", "ndcg", "mrr")])
    means = attach(sums, n_users).select(
        *by, *[(F.col(m) / F.col("_users")).alias(m) for m in ("hit", "ndcg", "mrr")]
    )
    return means.join(coverage(lists, catalog, by).drop("n_listed"), list(by))
