"""Profiles, utilities and the blended target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.functions import profiles as pf
from rankforge.functions.hashing import hash_normal
from rankforge.functions.scalars import clip
from rankforge.operators.ordering import attach, min_max
from rankforge.operators.ranking import top_k

PROFILE_FIELDS = (
    "profile_idx", "profile", "brand_pref", "cat_affinity", "price_lo", "price_hi", "recency_weight",
)


def with_grid(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    """Repeat every row for each value of a parameter grid."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def with_runs(df: DataFrame, n_runs: int) -> DataFrame:
    """Repeat every row per run, with the seed of the run."""
    out = df.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(n_runs - 1))))
    return out.withColumn("seed", pf.run_seed(F.col("run")))


def with_profiles(df: DataFrame, profiles=pf.PROFILES) -> DataFrame:
    """The item x profile scoring frame: one row per item and profile."""
    out = df.withColumn("_p", F.explode(pf.profile_array(profiles)))
    return out.select(*df.columns, *[F.col("_p")[f].alias(f) for f in PROFILE_FIELDS])


# Most rows that with_each lets travel with every row.
FEW = 100_000


def with_each(df: DataFrame, few: DataFrame, most: int = FEW) -> DataFrame:
    """Repeat every row for each row of ``few``, whose size is a parameter of the
    caller (selected users, states, grid cells). The few rows travel as one array
    value; more than ``most`` of them are an error."""
    listed = F.collect_list(F.struct(*few.columns))
    rows = few.limit(most + 1).select(
        F.when(F.size(listed) > most, F.raise_error(F.lit(f"more than {most} rows to repeat"))).otherwise(listed).alias("r")
    ).scalar()
    out = df.withColumn("_r", F.explode(rows))
    return out.select(*df.columns, *[F.col("_r")[c].alias(c) for c in few.columns])


def price_fit(price: Column, lo: Column, hi: Column) -> Column:
    return clip(1.0 - F.abs(price - (lo + hi) / 2.0) / ((hi - lo) / 2.0 + 1.0), 0, 1)


def _recency(pct: Column, weight: Column) -> Column:
    return pct * weight + (1.0 - weight) * 0.5


def hidden_components(frame: DataFrame, by: Sequence[str] = ("profile_idx",)) -> DataFrame:
    """brand_score, price_fit, cat_score (relative to the best of the frame) and
    recency_score of a scoring frame; ``by`` names the frame's groups."""
    c = F.col
    scored = frame.select(
        "*",
        F.coalesce(F.try_element_at("brand_pref", c("brand")), F.lit(pf.DEFAULT_BRAND)).alias("brand_score"),
        price_fit(c("price"), c("price_lo"), c("price_hi")).alias("price_fit"),
        F.coalesce(F.try_element_at("cat_affinity", c("category")), F.lit(pf.DEFAULT_CATEGORY)).alias("_cat"),
        _recency(c("recency_pct"), c("recency_weight")).alias("recency_score"),
    )
    best = scored.groupBy(*by).agg(F.max("_cat").alias("_best"))
    return attach(scored, best, by).withColumn("cat_score", c("_cat") / c("_best")).drop("_cat", "_best")


def hidden_utility(frame: DataFrame, by: Sequence[str] = ("profile_idx",), out: str = "hidden") -> DataFrame:
    c = F.col
    raw = (
        0.45 * c("brand_score") + 0.30 * c("price_fit") + 0.15 * c("cat_score") + 0.10 * c("recency_score")
    )
    parts = ("brand_score", "price_fit", "cat_score", "recency_score")
    scored = hidden_components(frame, by).withColumn("_raw", raw).drop(*parts)
    return min_max(scored, {out: "_raw"}, by).drop("_raw")


def observable_utility(frame: DataFrame, by: Sequence[str] = (), out: str = "observable") -> DataFrame:
    c = F.col
    mean = (c("price_pct") + c("quality_pct") + c("popularity_pct") + c("rating_pct")) / 4.0
    return min_max(frame.withColumn("_mean", mean), {out: "_mean"}, by).drop("_mean")


def blend_target(
    frame: DataFrame,
    by: Sequence[str] = ("profile_idx",),
    alpha: float | Column = pf.ALPHA,
    noise_sd: float = pf.NOISE_SD,
    seed: Column | None = None,
    item: str = "item_id",
    out: str = "target",
) -> DataFrame:
    """alpha * observable + (1 - alpha) * hidden + noise, min-max scaled. The frame
    carries ``observable`` and ``hidden``; ``seed`` may differ per group."""
    a = F.lit(alpha) if isinstance(alpha, float) else alpha
    blended = a * F.col("observable") + (1.0 - a) * F.col("hidden")
    if noise_sd:
        seed = F.lit(pf.SEED_BASE) if seed is None else seed
        blended = blended + noise_sd * hash_normal(seed + 7777, F.col(item))
    return min_max(frame.withColumn("_blend", blended), {out: "_blend"}, by).drop("_blend")


def engagement_probabilities(frame: DataFrame, threshold: float = 0.999999) -> DataFrame:
    """p_engage and p_convert of an item under a profile. "In range" asks for a
    price fit above ``threshold`` (almost the range's centre), and the category
    match is one, because it is relative to the item alone."""
    c = F.col
    brand = F.coalesce(F.try_element_at("brand_pref", c("brand")), F.lit(pf.DEFAULT_BRAND))
    fit = price_fit(c("price"), c("price_lo"), c("price_hi"))
    in_range = (fit > threshold).cast("double")
    recency = _recency(c("recency_pct"), c("recency_weight"))
    engage = 0.40 * brand + 0.35 * in_range + F.lit(0.15) + 0.10 * recency
    convert = 0.50 * brand + 0.30 * in_range + F.lit(0.20)
    return frame.withColumn("p_engage", clip(engage, 0, 1)).withColumn("p_convert", clip(convert, 0, 1))


def relative_shares(profiles: DataFrame) -> DataFrame:
    """Category shares relative to the user's largest share, once per user."""
    def scale(c: str) -> Column:
        best = F.array_max(F.map_values(c))
        return F.transform_values(c, lambda _, x: F.when(best > 0, x / best).otherwise(x))

    return profiles.withColumn("cat_lvl2_affinity", scale("cat_lvl2_affinity")).withColumn(
        "cat_leaf_affinity", scale("cat_leaf_affinity")
    )


def candidate_pool(
    scored: DataFrame, by: Sequence[str] = (), k: int = pf.TOP_K, n_hidden: int = 30
) -> DataFrame:
    """Distinct items of every profile's target list and best hidden utilities."""
    group = [*by, "profile_idx"]
    target = top_k(scored, "target", k, group).select(*by, "item_id")
    hidden = top_k(scored, "hidden", n_hidden, group).select(*by, "item_id")
    return target.union(hidden).distinct()


def candidate_pool_for_users(
    hidden: DataFrame, topsis: DataFrame, train: DataFrame, users: DataFrame, n_topsis: int = 120
) -> DataFrame:
    """Per user: best hidden utilities (``threshold.best_items``), best overall closeness,
    and own items."""
    best = top_k(topsis, "topsis", n_topsis).select("item_id")
    listed = users.select("user_id").withColumn(
        "item_id", F.explode(best.select(F.collect_list("item_id")).scalar())
    )
    return (
        hidden.select("user_id", "item_id")
        .union(listed)
        .union(train.select("user_id", "item_id"))
        .distinct()
    )
