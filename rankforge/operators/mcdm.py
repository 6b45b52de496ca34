"""Entropy weights and closeness to the ideal point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.operators.ordering import attach

CRITERIA = ("price_pct", "quality_pct", "popularity_pct", "rating_pct")
SMALLEST = 1e-10


def _positive(c: str) -> Column:
    return F.greatest(F.col(c), F.lit(SMALLEST))


def column_totals(df: DataFrame, columns: Sequence[str] = CRITERIA, by: Sequence[str] = ()) -> DataFrame:
    """One row per group: size, sum, sum of squares, max and min of each
    (clipped) column, and its entropy sum -sum(p ln p)."""
    first = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.sum(_positive(c)).alias(f"sum_{c}") for c in columns],
    )
    share = {
        c: F.least(F.greatest(_positive(c) / F.col(f"sum_{c}"), F.lit(SMALLEST)), F.lit(1.0))
        for c in columns
    }
    return attach(df, first, by).groupBy(*by).agg(
        F.first("n").alias("n"),
        *[F.first(f"sum_{c}").alias(f"sum_{c}") for c in columns],
        *[F.sum(_positive(c) * _positive(c)).alias(f"sq_{c}") for c in columns],
        *[F.max(_positive(c)).alias(f"max_{c}") for c in columns],
        *[F.min(_positive(c)).alias(f"min_{c}") for c in columns],
        *[(-F.sum(share[c] * F.ln(share[c]))).alias(f"ent_{c}") for c in columns],
    )


def weights_from_totals(
    totals: DataFrame, columns: Sequence[str] = CRITERIA, floor: float = 0.10
) -> DataFrame:
    """Add ``w_<column>`` to the totals. Without any contrast (one row, or all
    columns uniform) the weights are equal."""
    m = len(columns)
    for c in columns:
        totals = totals.withColumn(
            f"d_{c}", 1 - F.coalesce(F.try_divide(F.col(f"ent_{c}"), F.ln("n")), F.lit(1.0))
        )
    spread = sum((F.col(f"d_{c}") for c in columns[1:]), F.col(f"d_{columns[0]}"))
    no_contrast = (F.col("n") <= 1) | (F.abs(F.col("d_sum")) < 1e-12)
    totals = totals.withColumn("d_sum", spread)
    for c in columns:
        raw = F.lit(floor) + F.try_divide(F.col(f"d_{c}"), F.col("d_sum")) * F.lit(1 - floor * m)
        totals = totals.withColumn(
            f"r_{c}",
            F.when(no_contrast, F.lit(1.0 / m)).otherwise(F.greatest(raw, F.lit(floor))),
        )
    r_sum = sum((F.col(f"r_{c}") for c in columns[1:]), F.col(f"r_{columns[0]}"))
    for c in columns:
        totals = totals.withColumn(f"w_{c}", F.col(f"r_{c}") / r_sum)
    return totals.drop("d_sum", *[f"{p}_{c}" for p in ("d", "r") for c in columns])


def entropy_weights(
    df: DataFrame, columns: Sequence[str] = CRITERIA, by: Sequence[str] = (), floor: float = 0.10
) -> DataFrame:
    out = weights_from_totals(column_totals(df, columns, by), columns, floor)
    return out.select(*by, *[f"w_{c}" for c in columns])


def closeness(df: DataFrame, columns: Sequence[str], scale: dict[str, Column],
              top: dict[str, Column], low: dict[str, Column], score: str) -> DataFrame:
    """Distance to the worst point over the sum of both distances."""
    def distance(to: dict[str, Column]) -> Column:
        parts = [(F.col(c) * scale[c] - to[c]) * (F.col(c) * scale[c] - to[c]) for c in columns]
        return F.sqrt(sum(parts[1:], parts[0]))

    out = df.withColumn("_up", distance(top)).withColumn("_down", distance(low))
    both = F.col("_up") + F.col("_down")
    return out.withColumn(
        score, F.col("_down") / F.when(both == 0, F.lit(SMALLEST)).otherwise(both)
    ).drop("_up", "_down")


def topsis(
    df: DataFrame,
    columns: Sequence[str] = CRITERIA,
    by: Sequence[str] = (),
    score: str = "topsis",
    floor: float = 0.10,
    keep_weights: bool = False,
) -> DataFrame:
    """Entropy-weighted closeness of every row inside its group.

    Two small aggregates per group are sent back to the rows; the rows
    themselves are never shuffled.
    """
    stats = weights_from_totals(column_totals(df, columns, by), columns, floor)
    small = stats.select(
        *by,
        *[F.col(f"w_{c}") for c in columns],
        *[
            (F.col(f"w_{c}") / F.when(F.col(f"sq_{c}") == 0, F.lit(1.0)).otherwise(F.sqrt(f"sq_{c}"))).alias(f"_f_{c}")
            for c in columns
        ],
        *[F.col(f"max_{c}").alias(f"_hi_{c}") for c in columns],
        *[F.col(f"min_{c}").alias(f"_lo_{c}") for c in columns],
    )
    clipped = {c: _positive(c) for c in columns}
    out = attach(df, small, by)
    for c in columns:
        out = out.withColumn(f"_x_{c}", clipped[c])
    xs = [f"_x_{c}" for c in columns]
    scale = {f"_x_{c}": F.col(f"_f_{c}") for c in columns}
    top = {f"_x_{c}": F.col(f"_hi_{c}") * F.col(f"_f_{c}") for c in columns}
    low = {f"_x_{c}": F.col(f"_lo_{c}") * F.col(f"_f_{c}") for c in columns}
    out = closeness(out, xs, scale, top, low, score)
    drop = [f"_{p}_{c}" for p in ("x", "f", "hi", "lo") for c in columns]
    if not keep_weights:
        drop += [f"w_{c}" for c in columns]
    return out.drop(*drop)
