"""Blending learned values with observable closeness, and its sensitivity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.functions import profiles as pf
from rankforge.operators.ordering import min_max


def normalized_parts(
    frame: DataFrame, by: Sequence[str], q: str = "q", topsis: str = "topsis", grid: bool = True
) -> DataFrame:
    """q_norm and t_norm per group. Items without a value count as zero before the
    scaling, so every item takes part in it."""
    filled = frame.withColumn(q, F.coalesce(F.col(q), F.lit(0.0)))
    return min_max(filled, {"q_norm": q, "t_norm": topsis}, by, grid)


def hybrid_score(weight: float | Column = pf.LAMBDA_Q) -> Column:
    w = F.lit(weight) if isinstance(weight, float) else weight
    return w * F.col("q_norm") + (1.0 - w) * F.col("t_norm")


def gate(visits: Column, tau: float = pf.CONFIDENCE_TAU, most: float = pf.CONFIDENCE_MAX) -> Column:
    """Weight of the learned value, growing with the number of visits."""
    return most * (1.0 - F.exp(-visits / F.lit(float(tau))))


def hybrid(frame: DataFrame, by: Sequence[str], weight: float | Column = pf.LAMBDA_Q, grid: bool = True) -> DataFrame:
    return normalized_parts(frame, by, grid=grid).withColumn("hybrid", hybrid_score(weight))


def confidence_gated(
    frame: DataFrame, by: Sequence[str], tau: float = pf.CONFIDENCE_TAU,
    most: float = pf.CONFIDENCE_MAX, grid: bool = True,
) -> DataFrame:
    """Item-wise blend with weight ``lambda_q`` and score ``gated``."""
    counts = F.coalesce(F.col("visits"), F.lit(0)).cast("double")
    return (
        normalized_parts(frame, by, grid=grid)
        .withColumn("lambda_q", gate(counts, tau, most))
        .withColumn("gated", hybrid_score(F.col("lambda_q")))
    )
