"""Top-k lists, full ranks and keep-first selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.operators.ordering import ordered_position

# Float sums depend on how rows were partitioned. Scores are compared at this
# many decimals so that a list does not change with the cluster layout.
TIE_DIGITS = 9
# Above this size Spark no longer limits a ranking window before its shuffle.
WINDOW_LIMIT = 1000


def score_order(score: str, item: str, digits: int = TIE_DIGITS) -> list[Column]:
    return [F.round(F.col(score), digits).desc(), F.col(item).asc()]


def top_k(
    df: DataFrame,
    score: str,
    k: int,
    by: Sequence[str] = (),
    item: str = "item_id",
    rank: str = "rank",
    order: Sequence[Column] | None = None,
) -> DataFrame:
    """The k best rows per group with their rank; ties go to the smaller item."""
    order = list(order) if order is not None else score_order(score, item)
    if not by:
        # At most k rows leave each task; the window sees k rows.
        return df.orderBy(*order).limit(k).withColumn(
            rank, F.row_number().over(Window.orderBy(*order))
        )
    if k <= WINDOW_LIMIT:
        # Spark limits each task to k rows per group before the shuffle.
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)
    return ordered_position(df, by, order, rank, "_size").filter(F.col(rank) <= k).drop("_size")


def top_k_of_unit_scores(
    df: DataFrame, score: str, k: int, by: Sequence[str], item: str = "item_id", rank: str = "rank", buckets: int = 1000
) -> DataFrame:
    """``top_k`` for long lists of scores in [0, 1]: a histogram per group finds the
    bucket that holds the k-th best, and only rows from there up are sorted."""
    bucket = F.floor(F.round(F.col(score), TIE_DIGITS) * buckets)
    counts = df.groupBy(*by, bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    best_first = Window.partitionBy(*by).orderBy(F.col("_bucket").desc())
    reached = counts.withColumn("_above", F.sum("_n").over(best_first) - F.col("_n"))
    # The last bucket that still has fewer than k rows above it.
    cut = reached.filter(F.col("_above") < k).groupBy(*by).agg(F.min("_bucket").alias("_cut"))
    kept = df.join(cut, list(by)).filter(bucket >= F.col("_cut")).drop("_cut")
    return top_k(kept, score, k, by, item, rank)


def with_cuts(df: DataFrame, scores: Sequence[str], k: int, by: Sequence[str], item: str = "item_id", buckets: int = 256) -> DataFrame:
    """Add ``_cut_<score>``: a bound that the k best of each of a few large groups reach, so
    that only rows from there up need to be sorted (``from_cut``). The best of each bucket of
    items are different items, so k of them reach the k-th best of the buckets. Groups with
    fewer buckets have no bound. One aggregate serves all scores."""
    best = df.groupBy(*by, F.pmod(F.xxhash64(item), F.lit(buckets)).alias("_bucket")).agg(*[F.max(c).alias(c) for c in scores])
    cuts = best.groupBy(*by).agg(*[F.try_element_at(F.sort_array(F.collect_list(c), asc=False), F.lit(k)).alias(f"_cut_{c}") for c in scores])
    return df.join(F.broadcast(cuts), list(by))


def from_cut(df: DataFrame, score: str) -> DataFrame:
    """The rows of ``with_cuts`` that may be in the list of ``score``."""
    cut = F.col(f"_cut_{score}")
    return df.filter(cut.isNull() | (F.col(score) >= cut - 10.0**-TIE_DIGITS))


def full_rank(
    df: DataFrame,
    score: str,
    by: Sequence[str] = (),
    item: str = "item_id",
    rank: str = "rank",
) -> DataFrame:
    """Rank 1..n of every row in its group, for groups of any size."""
    return ordered_position(df, by, score_order(score, item), rank, "_size").drop("_size")


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key under ``order`` (expressions whose smallest value wins).

    An aggregate, so each task reduces its copies of a key before the shuffle.
    """
    rest = [c for c in df.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(best).select(*key, "_row.*").select(*df.columns)


def nulls_low(c: str) -> Column:
    return F.col(c).asc_nulls_first()
