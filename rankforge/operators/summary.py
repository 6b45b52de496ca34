"""Summaries over runs, profiles and users."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.operators.ordering import quantiles


def summarize(df: DataFrame, value: str, by: Sequence[str], raw: bool = False, order: str | None = None) -> DataFrame:
    """mean, population std, 2.5 and 97.5 percentiles (linear) and n per group of
    run-level values (one row per run, so groups are small). ``raw`` adds the
    values, in the order of ``order``."""
    v = F.col(value)
    aggs = [
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.percentile(v, F.lit(0.025)).alias("ci_lo"),
        F.percentile(v, F.lit(0.975)).alias("ci_hi"),
        F.count(v).alias("n"),
    ]
    if raw:
        rows = F.array_sort(F.collect_list(F.struct(order or value, value)))
        aggs.append(F.transform(rows, lambda r: r[value]).alias("raw"))
    return df.groupBy(*by).agg(*aggs)


def summarize_large(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """The same without ``raw`` for groups of any size (user-level values)."""
    v = F.col(value)
    moments = df.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("n"))
    bounds = quantiles(df, value, {"ci_lo": 0.025, "ci_hi": 0.975}, by)
    return moments.join(bounds, list(by)).select(*by, "mean", "std", "ci_lo", "ci_hi", "n")


def two_level_mean(df: DataFrame, value: str, inner: Sequence[str], outer: Sequence[str]) -> DataFrame:
    """Mean inside ``inner`` groups (run), then over ``outer``."""
    return df.groupBy(*inner).agg(F.avg(value).alias(value)).groupBy(*outer).agg(F.avg(value).alias(value))


def profile_gap(df: DataFrame, value: str = "f1", by: Sequence[str] = ("profile",)) -> DataFrame:
    wide = df.groupBy(*by).pivot("method", ["hybrid", "rl_only", "topsis_only"]).agg(F.avg(value))
    return wide.select(
        *by, "hybrid", "rl_only", "topsis_only",
        (F.col("hybrid") - F.col("rl_only")).alias("hybrid_minus_rl"),
        (F.col("hybrid") - F.col("topsis_only")).alias("hybrid_minus_topsis"),
    )


def best_by(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Label of the highest score; the smallest label wins ties."""
    best = F.min_by(F.struct(label, score), F.struct(-F.col(score), F.col(label))).alias("_b")
    return df.groupBy(*by).agg(best).select(*by, "_b.*")


def final_summary(finals: DataFrame, lambdas: DataFrame, drift: DataFrame) -> DataFrame:
    """One row: last-checkpoint mean per method, deltas, best blend weight, and
    the end of the drift curve. Inputs are small report tables: (method, f1),
    (lambda_q, f1) and (method, f1)."""
    from rankforge.operators.ordering import attach

    def mean(m: str, name: str):
        return F.avg(F.when(F.col("method") == m, F.col("f1"))).alias(name)

    methods = ("random", "popularity", "topsis_only", "rl_only", "hybrid")
    main = finals.agg(*[mean(m, m) for m in methods])
    main = main.withColumn("hybrid_minus_topsis", F.col("hybrid") - F.col("topsis_only")).withColumn(
        "hybrid_minus_rl", F.col("hybrid") - F.col("rl_only")
    )
    best = best_by(
        lambdas.groupBy("lambda_q").agg(F.round(F.avg("f1"), 9).alias("best_f1")), "lambda_q", "best_f1"
    ).withColumnRenamed("lambda_q", "best_lambda_q")
    end = drift.agg(mean("rl_only", "drift_rl_only"), mean("hybrid", "drift_hybrid"))
    return attach(attach(main, best), end)


def tagged_export(parts: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """One long table (experiment, group, method, checkpoint, mean, std, ci_lo,
    ci_hi) from summary tables keyed by (experiment, group)."""
    columns = ("method", "checkpoint", "mean", "std", "ci_lo", "ci_hi")
    out = None
    for (experiment, group), df in parts.items():
        tagged = df.select(F.lit(experiment).alias("experiment"), F.lit(group).alias("grp"), *columns)
        out = tagged if out is None else out.unionByName(tagged)
    return out
