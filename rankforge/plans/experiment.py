"""The main experiment as tables: samples, scores, lists, metrics and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.functions import profiles as pf
from rankforge.functions.hashing import hash_key
from rankforge.operators import blending, mcdm, metrics, utility
from rankforge.operators.ranking import top_k

GROUP = ("run", "profile_idx")
BASELINES = ("random", "popularity", "topsis_only", "rl_only")


def scored_frame(
    samples: DataFrame, profiles=pf.PROFILES, noise_sd: float = 0.0, by: Sequence[str] = ("run",)
) -> DataFrame:
    """Items of every run next to every profile with closeness, observable and
    hidden utility and target. Closeness is computed once per run."""
    ranked = mcdm.topsis(samples, by=by, keep_weights=True)
    frame = utility.with_profiles(utility.observable_utility(ranked, by), profiles)
    group = [*by, "profile_idx"]
    frame = utility.hidden_utility(frame, group)
    seed = pf.profile_seed(F.col("seed"), F.col("profile_idx")) if noise_sd else None
    return utility.blend_target(frame, group, noise_sd=noise_sd, seed=seed)


def truth_lists(scored: DataFrame, by: Sequence[str] = GROUP, k: int = pf.TOP_K) -> DataFrame:
    return top_k(scored, "target", k, by).select(*by, "rank", "item_id")


def fixed_lists(scored: DataFrame, by: Sequence[str] = GROUP, k: int = pf.TOP_K) -> DataFrame:
    """Lists that need no feedback: random, popularity and closeness."""
    h = hash_key("random", *[F.col(c) for c in by], F.col("item_id"))
    rnd = top_k(scored, "topsis", k, by, order=[h, F.col("item_id")])
    pop = top_k(scored, "popularity_pct", k, by)
    top = top_k(scored, "topsis", k, by)
    out = None
    for name, lists in (("random", rnd), ("popularity", pop), ("topsis_only", top)):
        part = lists.select(*by, F.lit(name).alias("method"), "rank", "item_id")
        out = part if out is None else out.unionByName(part)
    return out


def learned_scores(scored: DataFrame, values: DataFrame, checkpoints: Sequence[int] | None, by: Sequence[str] = GROUP) -> DataFrame:
    """Every item with q and visits of its profile's state at each checkpoint,
    normalized parts, hybrid and gated scores."""
    group = list(by)
    frame = scored
    if checkpoints:
        frame = utility.with_grid(frame, "checkpoint", [int(c) for c in checkpoints]).withColumn(
            "checkpoint", F.col("checkpoint").cast("long")
        )
        group = [*group, "checkpoint"]
    on = ["profile_idx", "item_id"] + (["checkpoint"] if checkpoints else [])
    joined = frame.join(values.withColumnRenamed("state", "profile_idx"), on, "left")
    out = blending.confidence_gated(joined, group)
    return out.withColumn("hybrid", blending.hybrid_score())


def learned_lists(learned: DataFrame, by: Sequence[str], k: int = pf.TOP_K) -> DataFrame:
    out = None
    for name, score in (("rl_only", "q"), ("hybrid", "hybrid"), ("gated", "gated")):
        part = top_k(learned, score, k, by).select(*by, F.lit(name).alias("method"), "rank", "item_id")
        out = part if out is None else out.unionByName(part)
    return out


def checkpoint_report(fixed: DataFrame, learned: DataFrame, truth: DataFrame, checkpoints: Sequence[int]) -> DataFrame:
    """F1 and NDCG per (run, profile, method, checkpoint)."""
    repeated = utility.with_grid(fixed, "checkpoint", [int(c) for c in checkpoints]).withColumn(
        "checkpoint", F.col("checkpoint").cast("long")
    )
    lists = repeated.unionByName(learned)
    return metrics.list_metrics(lists, truth, [*GROUP, "method", "checkpoint"], list(GROUP))


def blend_sensitivity(learned: DataFrame, truth: DataFrame, grid=pf.LAMBDA_GRID) -> DataFrame:
    """F1 per (run, profile, lambda_q)."""
    frame = utility.with_grid(learned, "lambda_q", grid).withColumn(
        "score", blending.hybrid_score(F.col("lambda_q"))
    )
    lists = top_k(frame, "score", pf.TOP_K, [*GROUP, "lambda_q"])
    return metrics.list_metrics(lists, truth, [*GROUP, "lambda_q"], list(GROUP))


def split_sensitivity(scored: DataFrame, lists: DataFrame, grid=pf.ALPHA_GRID) -> DataFrame:
    """F1 of fixed lists against targets rebuilt with other observable shares."""
    group = [*GROUP, "alpha"]
    frame = utility.with_grid(scored, "alpha", grid)
    targets = utility.blend_target(frame.drop("target"), group, alpha=F.col("alpha"), noise_sd=0.0)
    truth = top_k(targets, "target", pf.TOP_K, group).select(*group, "item_id")
    repeated = utility.with_grid(lists, "alpha", grid)
    return metrics.list_metrics(repeated, truth, [*group, "method"], group)


def diagnostics(scored: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """Per group: F1 of closeness, hidden and observable lists against the target,
    and the correlation of closeness with the target."""
    truth = truth_lists(scored, by)
    lists = None
    for name in ("topsis", "hidden", "observable"):
        part = top_k(scored, name, pf.TOP_K, by).select(*by, F.lit(name).alias("method"), "rank", "item_id")
        lists = part if lists is None else lists.unionByName(part)
    f1 = metrics.list_metrics(lists, truth, [*by, "method"], list(by))
    wide = f1.groupBy(*by).agg(
        *[F.max(F.when(F.col("method") == m, F.col("f1"))).alias(f"f1_{m}") for m in ("topsis", "hidden", "observable")]
    )
    corr = scored.groupBy(*by).agg(F.corr("topsis", "target").alias("corr_topsis_target"))
    return wide.join(corr, list(by))
