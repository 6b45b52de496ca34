"""Explanations: signal attribution, counterfactual ranks and surrogate models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.functions import profiles as pf
from rankforge.functions.hashing import hash_key
from rankforge.functions.scalars import argmax_label, attribution_text, clean_finite, clip
from rankforge.operators.blending import hybrid_score
from rankforge.operators.mcdm import CRITERIA, closeness
from rankforge.operators.ordering import attach, min_max, ordered_position
from rankforge.operators.ranking import full_rank, top_k
from rankforge.operators.sampling import row_sample, train_test
from rankforge.operators.utility import with_grid

# Labels of the criteria and features of the surrogate models.
CRITERION_LABELS = {
    "price_pct": "Price", "quality_pct": "Quality", "popularity_pct": "Popularity", "rating_pct": "Rating",
}
SURROGATE_FEATURES = (
    "price_pct", "quality_pct", "popularity_pct", "rating_pct", "recency_pct", "discount_pct",
    "rating_count", "inferred_reviewer_count", "review_text_richness",
)
NOT_SAMPLED = "not_sampled"
DELTA = 0.10


def criterion_label() -> Column:
    """Criterion with the largest weighted value."""
    return argmax_label(
        [CRITERION_LABELS[c] for c in CRITERIA], [F.col(c) * F.col(f"w_{c}") for c in CRITERIA]
    )


def behavior_label() -> Column:
    """Largest of brand, price range, category and recency components. On a
    single item the category component is relative to itself, hence one."""
    return argmax_label(
        [F.col("brand"), F.lit("PriceRange"), F.col("category"), F.lit("Recency")],
        [F.col("brand_score"), F.col("price_fit"), F.lit(1.0), F.col("recency_score")],
    )


def signal_explanations(frame: DataFrame, truth: DataFrame, by: Sequence[str], k: int = pf.TOP_K) -> DataFrame:
    """The k best items per group with both contributions, the stronger signal
    (ties count as observable), its label and whether the item is in the truth.
    ``frame`` carries q_norm, t_norm, weights and hidden components."""
    scored = frame.withColumn("hybrid", hybrid_score())
    best = top_k(scored, "hybrid", k, by)
    facts = truth.select(*by, "item_id", F.lit(True).alias("_hit"))
    c_t, c_q = (1 - pf.LAMBDA_Q) * F.col("t_norm"), pf.LAMBDA_Q * F.col("q_norm")
    observable = c_t >= c_q
    return best.join(facts, [*by, "item_id"], "left").select(
        *by, "rank", "item_id",
        F.round(c_t, 3).alias("c_t"), F.round(c_q, 3).alias("c_q"),
        F.when(observable, "Observable").otherwise("Behavioral").alias("dominant_signal"),
        F.when(observable, criterion_label()).otherwise(behavior_label()).alias("dominant_label"),
        F.coalesce("_hit", F.lit(False)).alias("in_truth"),
    )


def branch_frame(frame: DataFrame, truth: DataFrame, by: Sequence[str], k: int = pf.TOP_K) -> DataFrame:
    """Every item of every group with its components, full rank and flags."""
    scored = frame.withColumn("hybrid", hybrid_score())
    ranked = full_rank(scored, "hybrid", by, rank="hybrid_rank")
    facts = truth.select(*by, "item_id", F.lit(True).alias("_hit"))
    return ranked.join(facts, [*by, "item_id"], "left").select(
        *ranked.columns,
        (pf.LAMBDA_Q * F.col("q_norm")).alias("q_component"),
        ((1 - pf.LAMBDA_Q) * F.col("t_norm")).alias("topsis_component"),
        (F.col("hybrid_rank") <= k).alias("in_top"),
        F.coalesce("_hit", F.lit(False)).alias("in_truth"),
    )


def branch_summary(branches: DataFrame) -> DataFrame:
    """Mean components, share where the learned part dominates, and hit share,
    over all rows and over top rows."""
    q, t = F.col("q_component"), F.col("topsis_component")
    out = None
    for name, rows in (("all_items", branches), ("top_items", branches.filter("in_top"))):
        part = rows.agg(
            F.lit(name).alias("scope"), F.avg(q).alias("mean_q_component"), F.avg(t).alias("mean_topsis_component"),
            F.avg((q >= t).cast("double")).alias("q_dominant_share"),
            F.avg(F.col("in_truth").cast("double")).alias("hit_share"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def counterfactual_ranks(
    frame: DataFrame, tracked: DataFrame, by: Sequence[str], delta: float = DELTA, normalize: bool = False
) -> DataFrame:
    """Rank and score of tracked items when one criterion of all items grows.

    ``frame`` carries the criteria, weights ``w_*``, q_norm and t_norm per group.
    The perturbed closeness weights the criteria without vector normalization
    unless ``normalize``; the base ranking has it.
    """
    by = list(by)
    base = full_rank(frame.withColumn("base_score", hybrid_score()), "base_score", by, rank="base_rank")
    base = base.select(*by, "item_id", "base_rank", "base_score")
    moved = with_grid(frame, "feature", CRITERIA)
    xs = []
    for c in CRITERIA:
        up = clip(F.col(c) + delta, 0.0, 1.0)
        moved = moved.withColumn(f"_x_{c}", F.when(F.col("feature") == c, up).otherwise(F.col(c)) * F.col(f"w_{c}"))
        xs.append(f"_x_{c}")
    group = [*by, "feature"]
    if normalize:
        norms = moved.groupBy(*group).agg(*[F.sqrt(F.sum(F.col(x) * F.col(x) / F.col(f"w_{x[3:]}") / F.col(f"w_{x[3:]}"))).alias(f"_n{x}") for x in xs])
        moved = attach(moved, norms, group)
        for x in xs:
            moved = moved.withColumn(x, F.coalesce(F.try_divide(F.col(x), F.col(f"_n{x}")), F.col(x)))
    bounds = moved.groupBy(*group).agg(
        *[F.max(x).alias(f"_hi{x}") for x in xs], *[F.min(x).alias(f"_lo{x}") for x in xs]
    )
    one = {x: F.lit(1.0) for x in xs}
    scored = closeness(
        attach(moved, bounds, group), xs, one,
        {x: F.col(f"_hi{x}") for x in xs}, {x: F.col(f"_lo{x}") for x in xs}, "_topsis",
    )
    blended = min_max(scored, {"t_norm": "_topsis"}, group) if "t_norm" not in scored.columns else min_max(
        scored.drop("t_norm"), {"t_norm": "_topsis"}, group
    )
    ranked = full_rank(blended.withColumn("perturbed_score", hybrid_score()), "perturbed_score", group, rank="perturbed_rank")
    kept = ranked.join(tracked.select(*by, "item_id").distinct(), [*by, "item_id"], "left_semi")
    return kept.join(base, [*by, "item_id"]).select(
        *by, "item_id", F.col("feature").alias("feature_perturbed"), "base_rank", "perturbed_rank",
        (F.col("base_rank") - F.col("perturbed_rank")).alias("rank_shift"),
        "base_score", "perturbed_score", (F.col("perturbed_score") - F.col("base_score")).alias("score_delta"),
    )


def counterfactual_summary(shifts: DataFrame) -> DataFrame:
    from rankforge.operators.ordering import quantiles

    shift = F.col("rank_shift")
    means = shifts.groupBy("feature_perturbed").agg(
        F.avg(shift).alias("mean_rank_shift"), F.avg("score_delta").alias("mean_score_delta"),
        F.avg((shift > 0).cast("double")).alias("share_improved"),
        F.avg((shift < 0).cast("double")).alias("share_worsened"),
    )
    medians = quantiles(shifts, "rank_shift", {"median_rank_shift": 0.5}, ["feature_perturbed"])
    return means.join(medians, "feature_perturbed")


# Surrogate models -------------------------------------------------------------

def surrogate_frame(
    branches: DataFrame, key: Sequence[str], seed: int, features: Sequence[str] = SURROGATE_FEATURES,
    target: str = "hybrid",
) -> DataFrame:
    """Cleaned features, label, and a stable 75/25 split."""
    cleaned = branches.select(
        *key, F.col(target).cast("double").alias("label"),
        *[clean_finite(F.col(f).cast("double")).alias(f) for f in features],
    )
    split = train_test(cleaned, seed, key)
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(split)


def moments(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, mean, std_pop, std_samp) in long form."""
    wide = df.agg(
        *[F.struct(F.lit(f).alias("feature"), F.avg(f).alias("mean"), F.stddev_pop(f).alias("std_pop"),
                   F.stddev_samp(f).alias("std_samp")).alias(f"_{i}") for i, f in enumerate(features)]
    )
    return wide.select(F.inline(F.array(*[f"_{i}" for i in range(len(features))])))


class RidgeSurrogate:
    """Ridge regression on standardized features; coefficients refer to z-scores."""

    def __init__(self, frame: DataFrame, features: Sequence[str] = SURROGATE_FEATURES, alpha: float = 1.0):
        train = frame.filter(~F.col("is_test"))
        self.features = list(features)
        # A few numbers per feature: the parameters of the model.
        row = train.agg(
            F.count("*").alias("n"), F.stddev_pop("label").alias("sd"),
            *[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features],
        ).first()
        self.mean = [row[f"m_{f}"] for f in features]
        self.scale = [row[f"s_{f}"] or 1.0 for f in features]
        # Spark divides the label by its standard deviation and the loss by n.
        fit = LinearRegression(
            featuresCol="z", solver="normal", standardization=False, elasticNetParam=0.0,
            regParam=alpha * row["sd"] / row["n"],
        ).fit(self.standardize(train))
        self.coef = [float(v) for v in fit.coefficients]
        self.intercept = float(fit.intercept)

    def z(self, i: int) -> Column:
        return (F.col(self.features[i]) - self.mean[i]) / self.scale[i]

    def standardize(self, df: DataFrame) -> DataFrame:
        return df.withColumn("z", array_to_vector(F.array(*[self.z(i) for i in range(len(self.features))])))

    def contributions(self) -> list[Column]:
        return [self.z(i) * self.coef[i] for i in range(len(self.features))]

    def predict(self, df: DataFrame) -> DataFrame:
        parts = self.contributions()
        return df.withColumn("prediction", sum(parts[1:], parts[0]) + self.intercept)


def r2(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Coefficient of determination of (label, prediction) per group, from sums."""
    err = F.sum((F.col("label") - F.col("prediction")) * (F.col("label") - F.col("prediction")))
    spread = F.var_pop("label") * F.count("*")
    return df.groupBy(*by).agg((1.0 - err / spread).alias("r2"))


def forest_surrogate(frame: DataFrame, seed: int, trees: int = 250, min_leaf: int = 10, depth: int = 16):
    return RandomForestRegressor(
        numTrees=trees, minInstancesPerNode=min_leaf, maxDepth=depth, seed=seed, subsamplingRate=1.0,
        featureSubsetStrategy="all", maxMemoryInMB=1024,
    ).fit(frame.filter(~F.col("is_test")).select("features", "label"))


def permutation_importance(
    model, frame: DataFrame, key: Sequence[str], features: Sequence[str] = SURROGATE_FEATURES,
    repeats: int = 10, seed: int = 0,
) -> DataFrame:
    """Drop of the test R2 when one feature is shuffled, mean and population std
    over repeats. A shuffle joins every row to the row at the same place of a
    hash order; all (feature, repeat) pairs are scored by one transform."""
    test = frame.filter("is_test").select(*key, "label", *features)
    base = r2(model.transform(VectorAssembler(inputCols=list(features), outputCol="features").transform(test)))
    grid = with_grid(test, "repeat", range(repeats))
    order = hash_key(seed, F.col("repeat"), *[F.col(k) for k in key])
    own = ordered_position(grid, ["repeat"], list(key), "place", "_n")
    donor = ordered_position(
        grid.select("repeat", *key, *[F.col(f).alias(f"_d_{f}") for f in features]).withColumn("_h", order),
        ["repeat"], ["_h", *key], "place", "_n",
    ).select("repeat", "place", *[f"_d_{f}" for f in features])
    shuffled = with_grid(own.join(donor, ["repeat", "place"]), "feature", features)
    columns = [
        F.when(F.col("feature") == f, F.col(f"_d_{f}")).otherwise(F.col(f)).alias(f) for f in features
    ]
    ready = shuffled.select("feature", "repeat", "label", *columns)
    scored = model.transform(VectorAssembler(inputCols=list(features), outputCol="features").transform(ready))
    drops = attach(r2(scored, ["feature", "repeat"]), base.select(F.col("r2").alias("_base")))
    drop = F.col("_base") - F.col("r2")
    return drops.groupBy("feature").agg(
        F.avg(drop).alias("permutation_mean"), F.stddev_pop(drop).alias("permutation_std")
    )


def shapley_values(
    model, frame: DataFrame, key: Sequence[str], features: Sequence[str] = SURROGATE_FEATURES,
    rows: int | None = None, permutations: int = 4, seed: int = 0,
) -> DataFrame:
    """Sampled Shapley attributions (key, feature, value, attribution, std_error, base) of every
    row; with ``rows`` of at most that many, chosen by a hash of the key.

    Features of the mean row are replaced by the row's own in a random order per
    permutation; the change of the prediction at each step belongs to the feature
    of that step. The steps telescope, so attributions plus base equal the
    prediction. Every step of every row is scored by one transform.

    Permutations come in antithetic pairs: the second of a pair runs backwards, so the
    errors of a feature that is early in one and late in the other cancel. ``std_error`` is
    that of the mean over pairs (null for one pair): how far an attribution has converged.
    """
    m = len(features)
    means = frame.agg(*[F.avg(f).alias(f"_b_{f}") for f in features])
    asked = frame.select(*key, *features)
    sample = attach(asked if rows is None else row_sample(asked, rows, seed, key), means)
    grid = with_grid(sample, "permutation", range(permutations))
    order = F.transform(
        F.array_sort(F.array(*[
            F.struct(hash_key(seed, F.floor(F.col("permutation") / 2), *[F.col(k) for k in key], f).alias("h"), F.lit(f).alias("f"))
            for f in features
        ])),
        lambda s: s["f"],
    )
    order = F.when(F.col("permutation") % 2 == 0, order).otherwise(F.reverse(order))
    # Permutation and steps form one row each: at most permutations x (m + 1).
    steps = grid.withColumn("_order", order).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(m))))
    mixed = steps.select(
        *key, "permutation", "step", "_order", *[F.col(f).alias(f"_v_{f}") for f in features],
        *[F.when(F.array_position("_order", F.lit(f)) <= F.col("step"), F.col(f)).otherwise(F.col(f"_b_{f}")).alias(f)
          for f in features],
    )
    scored = model.transform(VectorAssembler(inputCols=list(features), outputCol="features").transform(mixed))
    chains = scored.groupBy(*key, "permutation").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("step", "prediction"))), lambda s: s["prediction"]).alias("_p"),
        F.first("_order").alias("_order"), *[F.first(f"_v_{f}").alias(f"_v_{f}") for f in features],
    )
    jumps = F.transform(
        F.sequence(F.lit(1), F.lit(m)),
        lambda i: F.struct(F.element_at("_order", i).alias("feature"),
                           (F.element_at("_p", i + 1) - F.element_at("_p", i)).alias("jump")),
    )
    values = F.create_map(*[x for f in features for x in (F.lit(f), F.col(f"_v_{f}"))])
    long = chains.select(*key, "permutation", F.col("_p")[0].alias("base"), values.alias("_vals"), F.explode(jumps).alias("_j"))
    jump = F.col("_j.jump")
    # The mean of a pair is half the sum of its jumps; squares of pair means need both jumps,
    # so pairs are put together first.
    paired = long.groupBy(*key, F.col("_j.feature").alias("feature"), F.floor(F.col("permutation") / 2).alias("_pair")).agg(
        F.first(F.try_element_at("_vals", F.col("_j.feature"))).alias("value"), F.avg(jump).alias("_mean"), F.count("*").alias("_n"),
        F.avg("base").alias("base"),
    )
    return paired.groupBy(*key, "feature").agg(
        F.first("value").alias("value"), (F.sum(F.col("_mean") * F.col("_n")) / F.sum("_n")).alias("attribution"),
        F.try_divide(F.stddev_samp("_mean"), F.sqrt(F.count("*").cast("double"))).alias("std_error"), F.avg("base").alias("base"),
    )


def additivity(attributions: DataFrame, model, frame: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, residual): the prediction less base and attributions; zero but for rounding."""
    sums = attributions.groupBy(*key).agg((F.sum("attribution") + F.first("base")).alias("_s"))
    return model.transform(frame).join(sums, list(key)).select(*key, (F.col("prediction") - F.col("_s")).alias("residual"))


def ridge_residual(ridge: RidgeSurrogate, frame: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(feature, residual): the gradient of the ridge loss at the fitted coefficients over the
    training rows, per row; zero at the optimum."""
    error = F.col("label") - F.col("prediction")
    train = ridge.predict(frame.filter(~F.col("is_test")))
    sums = [F.struct(F.lit(f).alias("feature"), ((F.sum(ridge.z(i) * error) - alpha * ridge.coef[i]) / F.count("*")).alias("residual")) for i, f in enumerate(ridge.features)]
    sums.append(F.struct(F.lit("intercept").alias("feature"), (F.sum(error) / F.count("*")).alias("residual")))
    return train.agg(F.array(*sums).alias("r")).select(F.inline("r"))


def attribution_columns(attributions: DataFrame, key: Sequence[str], features: Sequence[str] = SURROGATE_FEATURES) -> DataFrame:
    """One row per key with the text of the five strongest attributions."""
    wide = attributions.groupBy(*key).agg(
        *[F.max(F.when(F.col("feature") == f, F.col("attribution"))).alias(f"_a_{f}") for f in features]
    )
    return wide.select(*key, attribution_text(features, [F.col(f"_a_{f}") for f in features]).alias("top_attributions"))


def local_explanations(
    branches: DataFrame, ridge: RidgeSurrogate, attributions: DataFrame, key: Sequence[str], run: int | None = None,
) -> DataFrame:
    """Top rows with the dominant branch (ties count as RL here), truth flag, the
    strongest sampled attributions (or 'not_sampled') and linear contributions."""
    top = branches.filter("in_top")
    if run is not None:
        top = top.filter(F.col("run") == run)
    for f in ridge.features:
        top = top.withColumn(f, clean_finite(F.col(f).cast("double")))
    linear = attribution_text(ridge.features, ridge.contributions())
    joined = top.join(attribution_columns(attributions, key, ridge.features), list(key), "left")
    rl = F.col("q_component") >= F.col("topsis_component")
    return joined.select(
        *key, "hybrid_rank", "hybrid", "q_component", "topsis_component",
        F.when(rl, "RL").otherwise("TOPSIS").alias("dominant_branch"), "in_truth",
        F.coalesce("top_attributions", F.lit(NOT_SAMPLED)).alias("top_attributions"),
        linear.alias("linear_contributions"),
    )


def global_importance(frame: DataFrame, ridge: RidgeSurrogate, forest, permutation: DataFrame, attributions: DataFrame) -> DataFrame:
    """One row per feature with every measure, strongest mean attribution first."""
    mean_abs = attributions.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs_attribution"))
    spark = frame.sparkSession
    # One row per feature: parameters of the fitted models.
    rows = [
        (f, ridge.coef[i], abs(ridge.coef[i]), float(forest.featureImportances[i]), ridge.mean[i], ridge.scale[i])
        for i, f in enumerate(ridge.features)
    ]
    params = spark.createDataFrame(
        rows, "feature string, ridge_coefficient double, ridge_abs_coefficient double, impurity_importance double, scaler_mean double, scaler_scale double",
    )
    stats = moments(frame, ridge.features).select(
        "feature", F.col("mean").alias("feature_mean"), F.col("std_samp").alias("feature_std")
    )
    return params.join(stats, "feature").join(permutation, "feature").join(mean_abs, "feature", "left").orderBy(
        F.col("mean_abs_attribution").desc_nulls_last(), "feature"
    )
