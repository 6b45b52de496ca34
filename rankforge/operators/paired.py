"""Paired tests between a method and its baselines."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from rankforge.operators.ordering import attach, running_totals

FLAT = 1e-12
LEVEL = 0.05


def pair_up(values: DataFrame, method: str, unit: Sequence[str], by: Sequence[str] = (), value: str = "f1") -> DataFrame:
    """(by, unit, baseline, a, b, diff): the method's value next to each baseline's
    value of the same unit."""
    keys = [*by, *unit]
    mine = values.filter(F.col("method") == method).select(*keys, F.col(value).alias("a"))
    others = values.filter(F.col("method") != method).select(
        *keys, F.col("method").alias("baseline"), F.col(value).alias("b")
    )
    return others.join(mine, keys).withColumn("diff", F.col("a") - F.col("b"))


def _t_tail(t: float, df: float) -> float:
    """Two-sided Student tail by integrating the density in the angle
    t = sqrt(df) tan(x); smooth, so Simpson's rule is accurate."""
    if math.isnan(t) or df <= 0:
        return 1.0
    start = math.atan(abs(t) / math.sqrt(df))
    if math.pi / 2 - start < 1e-12:
        return 0.0
    scale = 2.0 * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    # The mass sits next to the start for a large df: stop where it is gone.
    width = math.pi / 2 - start
    steps = 4000
    h = width / steps
    total = 0.0
    for i in range(steps + 1):
        c = math.cos(start + i * h)
        f = c ** (df - 1) if c > 0 else 0.0
        total += f * (1 if i in (0, steps) else 4 if i % 2 else 2)
    return min(1.0, scale * total * h / 3)


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """p-value per test: one row per (group, baseline)."""
    return pd.Series([_t_tail(float(a), float(b)) for a, b in zip(t, df)])


@F.pandas_udf(DoubleType())
def normal_upper(z: pd.Series) -> pd.Series:
    return z.map(lambda v: 0.5 * math.erfc(v / math.sqrt(2)))


def paired_t(pairs: DataFrame, by: Sequence[str] = ("baseline",), guard: bool = False,
             n_tests: int | None = None, p_values: bool = True, round_digits: int | None = None) -> DataFrame:
    """t, Cohen's d and Bonferroni decision per group of pairs.

    Without spread: ``guard`` reports t = 0, p = 1, d = 0, otherwise d is
    infinite. ``n_tests`` (default: the number of groups) divides the level. Differences of
    averages are taken at ``round_digits``, or the order of a sum decides on ties.
    """
    d = F.col("diff") if round_digits is None else F.round("diff", round_digits)
    stats = pairs.groupBy(*by).agg(
        F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(d).alias("mean_diff"),
        F.stddev_samp(d).alias("std_diff"), F.count(d).alias("n"),
        F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d < 0).alias("losses"),
    )
    sd = F.coalesce(F.col("std_diff"), F.lit(0.0))
    flat = sd <= FLAT
    infinite = F.when(F.abs("mean_diff") <= FLAT, 0.0).otherwise(F.signum("mean_diff") * F.lit(float("inf")))
    t = F.try_divide(F.col("mean_diff"), sd / F.sqrt(F.col("n").cast("double")))
    out = stats.withColumn("t_stat", F.when(flat, 0.0 if guard else infinite).otherwise(t)).withColumn(
        "cohen_d", F.when(flat, 0.0 if guard else infinite).otherwise(F.try_divide(F.col("mean_diff"), sd))
    )
    if not p_values:
        return out
    tests = stats.agg(F.count("*").alias("_m")) if n_tests is None else None
    out = out.withColumn("p_value", t_two_sided("t_stat", (F.col("n") - 1).cast("double")))
    out = attach(out, tests) if tests is not None else out.withColumn("_m", F.lit(n_tests))
    return (
        out.withColumn("bonferroni_alpha", LEVEL / F.col("_m"))
        .withColumn("significant", (F.col("p_value") < F.col("bonferroni_alpha")) & (F.col("mean_diff") > 0))
        .drop("_m")
    )


def wilcoxon(pairs: DataFrame, by: Sequence[str] = ("baseline",), round_digits: int | None = None,
             p_values: bool = True) -> DataFrame:
    """Signed-rank statistic W+ and its one-sided (greater) tie-corrected normal
    p-value. Zero differences are dropped; a group without others gets W = 0,
    p = 1. Absolute differences are counted first and ranked with a distributed
    running total, so user-level groups may be large."""
    by = list(by)
    d = F.col("diff") if round_digits is None else F.round("diff", round_digits)
    moved = pairs.select(*by, d.alias("_d"))
    sizes = (
        moved.filter(F.col("_d") != 0)
        .groupBy(*by, F.abs("_d").alias("_size"))
        .agg(F.count("*").alias("_peers"), F.count_if(F.col("_d") > 0).alias("_up"))
    )
    ranked = running_totals(sizes, by, ["_size"], "_peers")
    rank = F.col("before") + (F.col("_peers") + 1) / 2
    peers = F.col("_peers").cast("double")
    sums = ranked.groupBy(*by).agg(
        F.sum(rank * F.col("_up")).alias("w_plus"),
        F.sum(peers * peers * peers - peers).alias("tie_term"),
        F.first("total").alias("n_nonzero"),
    )
    out = moved.select(*by).distinct().join(sums, by, "left").select(
        *by,
        *[F.coalesce(c, F.lit(0)).cast(t).alias(c) for c, t in (("w_plus", "double"), ("tie_term", "double"), ("n_nonzero", "long"))],
    )
    if not p_values:
        return out
    n = F.col("n_nonzero").cast("double")
    mean = n * (n + 1) / 4
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("tie_term") / 48
    z = F.coalesce(F.try_divide(F.col("w_plus") - mean, F.sqrt(var)), F.lit(-40.0))
    return out.withColumn("p_greater", F.when(n == 0, 1.0).otherwise(normal_upper(z)))


def signed_rank_tail(n: Column, w: Column) -> Column:
    """P(W+ >= w) for n differences without ties or zeros: the null distribution of the rank
    sum, built rank by rank (a rank is in or out with one half)."""
    def longer(chances: Column, rank: Column) -> Column:
        none = F.array_repeat(F.lit(0.0), rank)
        return F.zip_with(F.concat(chances, none), F.concat(none, chances), lambda a, b: (a + b) / 2.0)

    chances = F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.array(F.lit(1.0)), longer)
    return F.aggregate(F.slice(chances, w.cast("int") + 1, F.size(chances)), F.lit(0.0), lambda s, x: s + x)


EXACT_MOST = 50


def wilcoxon_exact(pairs: DataFrame, by: Sequence[str] = ("baseline",), round_digits: int | None = None, most: int = EXACT_MOST) -> DataFrame:
    """``wilcoxon`` with ``p_exact``, the exact one-sided p-value: for groups of at most ``most``
    pairs without ties or zero differences; null for others, which have ``p_greater``."""
    by = list(by)
    tested = wilcoxon(pairs, by, round_digits)
    sizes = pairs.groupBy(*by).agg(F.count("diff").alias("n_pairs"))
    plain = (F.col("n_pairs") == F.col("n_nonzero")) & (F.col("tie_term") == 0) & (F.col("n_pairs").between(1, most))
    return tested.join(sizes, by).withColumn("p_exact", F.when(plain, signed_rank_tail(F.col("n_nonzero"), F.col("w_plus"))))


def test_battery(values: DataFrame, method: str, unit: Sequence[str], by: Sequence[str] = (), value: str = "f1",
                 p_values: bool = True) -> DataFrame:
    """Every baseline of every group: paired t, signed rank, wins/ties/losses and
    median difference."""
    from rankforge.operators.ordering import quantiles
    from rankforge.session import materialize

    pairs = materialize(pair_up(values, method, unit, by, value))
    keys = [*by, "baseline"]
    return (
        paired_t(pairs, keys, p_values=p_values)
        .join(quantiles(pairs, "diff", {"median_diff": 0.5}, keys), keys)
        .join(wilcoxon(pairs, keys, p_values=p_values), keys)
    )
