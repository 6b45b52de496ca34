"""Interaction logs: filtering, sequences, splits and per-item or per-user statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.operators.ordering import (
    attach,
    grouped_totals,
    join_unique,
    ordered_position,
    percentile_ranks,
    quantiles,
)
from rankforge.operators.ranking import top_k
from rankforge.session import materialize

MIN_RATING = 4.0
MIN_SPREAD = 0.15
DEFAULT_RATING = 3.5


def positive_reviews(
    reviews: DataFrame, valid_items: DataFrame, min_rating: float = MIN_RATING
) -> DataFrame:
    """Reviews of known items at or above a rating."""
    return (
        reviews.filter(F.col("rating") >= min_rating)
        .join(valid_items.select("item_id").distinct().hint("merge"), "item_id", "left_semi")
        .select("user_id", "item_id", "rating", "ts")
    )


def unique_sequences(reviews: DataFrame) -> DataFrame:
    """First interaction of every (user, item) with its position ``pos`` (1-based)
    in the user's time order and the user's length ``n``."""
    # Few pairs come twice, so rows are sorted once rather than reduced one by one on the way.
    placed = F.row_number().over(Window.partitionBy("user_id", "item_id").orderBy("ts", "rating"))
    first = reviews.withColumn("_copy", placed).filter("_copy = 1").drop("_copy")
    return ordered_position(first, ["user_id"], ["ts", "item_id"], totals=grouped_totals)


def split_last_k(sequences: DataFrame, k: int) -> DataFrame:
    """The last k of every sequence are 'test', earlier ones 'train'."""
    return sequences.withColumn(
        "split", F.when(F.col("pos") > F.col("n") - k, "test").otherwise("train")
    )


def activity(edges: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    return edges.groupBy(user).agg(F.countDistinct(item).alias("n_items"))


def eligible(edges: DataFrame, min_items: int) -> DataFrame:
    """Edges of users with at least ``min_items`` distinct items."""
    users = activity(edges).filter(F.col("n_items") >= min_items)
    return edges.join(users.select("user_id").hint("merge"), "user_id", "left_semi")


def busiest_users(sequences: DataFrame, max_users: int | None, min_items: int) -> DataFrame:
    """The ``max_users`` longest eligible sequences (all of them for None), with the
    order of selection."""
    users = (
        sequences.groupBy("user_id")
        .agg(F.count("*").alias("n_items"))
        .filter(F.col("n_items") >= min_items)
    )
    order = [F.col("n_items").desc(), F.col("user_id").asc()]
    if max_users is None:
        return ordered_position(users, [], order, "selected", "_users").drop("_users")
    return top_k(users, "n_items", max_users, item="user_id", rank="selected", order=order)


def pseudonym(selected: Column) -> Column:
    """Public user id from the order of selection (1-based)."""
    return F.format_string("user_%04d", selected - 1)


def select_sequences(
    sequences: DataFrame, items: DataFrame, max_users: int | None, min_items: int
) -> DataFrame:
    """Sequences of the busiest users (of all eligible users for None), then without
    items that are not in the item table, then without users that fell below the
    minimum; positions are renumbered. ``sequences`` hold an item of a user once, as
    ``unique_sequences`` gives them, so a user's rows are its distinct items."""
    users = busiest_users(sequences, max_users, min_items).select("user_id", "selected")
    kept = (
        sequences.drop("pos", "n")
        .join(users.hint("merge"), "user_id")
        .join(items.select("item_id").distinct().hint("merge"), "item_id", "left_semi")
    )
    placed = ordered_position(kept, ["user_id"], ["ts", "item_id"], totals=grouped_totals)
    return placed.filter(F.col("n") >= min_items)


def item_stats(train: DataFrame) -> DataFrame:
    """Interactions, mean rating and last time per item."""
    return train.groupBy("item_id").agg(
        F.count("*").alias("popularity"),
        F.avg("rating").alias("rating_mean"),
        F.max("ts").alias("last_train_time"),
    )


def fill_cold_items(items: DataFrame) -> DataFrame:
    """Items without training rows: popularity 0, rating the median of the known
    means, time the earliest of the known times."""
    known_rating = quantiles(items, "rating_mean", {"rating_fill": 0.5})
    known_time = items.agg(F.min("last_train_time").alias("time_fill"))
    out = attach(attach(items, known_rating), known_time)
    return (
        out.withColumn("popularity", F.coalesce("popularity", F.lit(0)).cast("double"))
        .withColumn(
            "rating_mean", F.coalesce("rating_mean", "rating_fill", F.lit(DEFAULT_RATING))
        )
        .withColumn("last_train_time", F.coalesce("last_train_time", "time_fill", F.lit(0.0)))
        .drop("rating_fill", "time_fill")
    )


def item_table(meta: DataFrame, sequences: DataFrame, test_k: int) -> DataFrame:
    """Metadata of the items in the sequences with training statistics, fills and
    the five percentile columns. ``ts`` must be numeric."""
    train = split_last_k(sequences, test_k).filter(F.col("split") == "train")
    used = sequences.select("item_id").distinct()
    joined = meta.join(used, "item_id", "left_semi").join(item_stats(train), "item_id", "left")
    filled = materialize(fill_cold_items(materialize(joined)))
    return percentile_ranks(
        filled,
        {
            "price_pct": ("price", True),
            "quality_pct": ("sales_rank", True),
            "popularity_pct": ("popularity", False),
            "rating_pct": ("rating_mean", False),
            "recency_pct": ("last_train_time", False),
        },
        ["item_id"],
    )


def category_shares(train_items: DataFrame, category: str) -> DataFrame:
    """Share of every category among a user's items; counts come first, so the
    total runs over at most the number of categories."""
    counts = train_items.groupBy("user_id", category).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("user_id"))
    return counts.select("user_id", category, (F.col("n") / total).alias("share"))


def price_taste(train_items: DataFrame) -> DataFrame:
    """Median and interquartile range (at least 0.15) of log1p(price), and mean
    recency percentile, per user."""
    logged = train_items.withColumn("log_price", F.log1p("price"))
    q = quantiles(logged, "log_price", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["user_id"], grouped_totals)
    recency = train_items.groupBy("user_id").agg(F.avg("recency_pct").alias("recency_pref"))
    return q.join(recency, "user_id").select(
        "user_id",
        F.col("q50").alias("log_price_center"),
        F.greatest(F.col("q75") - F.col("q25"), F.lit(MIN_SPREAD)).alias("log_price_spread"),
        "recency_pref",
    )


def user_profiles(train_items: DataFrame) -> DataFrame:
    """One row per user: two category-share maps and the price taste. A map holds
    at most one entry per category of the catalog."""
    train_items = materialize(train_items.select("user_id", "price", "recency_pct", "cat_lvl2", "cat_leaf"))

    def as_map(category: str, name: str) -> DataFrame:
        return (
            category_shares(train_items, category)
            .groupBy("user_id")
            .agg(F.map_from_entries(F.collect_list(F.struct(category, "share"))).alias(name))
        )

    return (
        price_taste(train_items)
        .join(as_map("cat_lvl2", "cat_lvl2_affinity"), "user_id")
        .join(as_map("cat_leaf", "cat_leaf_affinity"), "user_id")
    )


def edges_from_lists(
    rows: DataFrame, users: str, item: str, valid_items: DataFrame | None = None
) -> DataFrame:
    """Distinct (user_id, item_id) from a comma-separated user column."""
    out = (
        rows.select(
            F.explode(F.split(F.col(users), ",")).alias("user_id"), F.col(item).alias("item_id")
        )
        .withColumn("user_id", F.trim("user_id"))
        .filter(F.col("user_id") != "")
        .distinct()
    )
    if valid_items is not None:
        out = out.join(valid_items.select("item_id").distinct(), "item_id", "left_semi")
    return out


def popularity(edges: DataFrame) -> DataFrame:
    return edges.groupBy("item_id").agg(F.countDistinct("user_id").alias("popularity"))


def with_degree(edges: DataFrame, node: str, name: str) -> DataFrame:
    """Edges with the degree of one end point, hot nodes handled separately."""
    degrees = edges.groupBy(node).agg(F.count("*").alias(name))
    total = edges.agg(F.count("*").alias("_total"))
    marked = attach(degrees, total).withColumn("_hot", F.col(name) * 1000 >= F.col("_total"))
    others = [c for c in edges.columns if c != node]
    return join_unique(edges, marked.drop("_total"), [node], F.col("_hot"), others).drop("_hot")


def prefix_windows(sequences: DataFrame, max_len: int, block: int = 4096) -> DataFrame:
    """For every position from the second on: the previous ``max_len`` items
    (oldest first) and the next item.

    A sequence is cut into blocks of ``block`` positions and each block carries
    the last ``max_len`` rows of the one before, so no window holds a whole
    long sequence.
    """
    block = max(block, max_len)
    own = F.floor((F.col("pos") - 1) / block)
    rows = sequences.select("user_id", "item_id", "pos", F.explode(
        F.when(
            F.pmod(F.col("pos") - 1, F.lit(block)) >= block - max_len, F.array(own, own + 1)
        ).otherwise(F.array(own))
    ).alias("_block"), own.alias("_own"))
    w = Window.partitionBy("user_id", "_block").orderBy("pos").rowsBetween(-max_len, -1)
    return (
        rows.withColumn("prefix", F.collect_list("item_id").over(w))
        .filter((F.col("_block") == F.col("_own")) & (F.col("pos") > 1))
        .select("user_id", "pos", "prefix", F.col("item_id").alias("next_item"))
    )


def left_pad(c: Column, length: int) -> Column:
    """The last ``length`` ids plus one, zeros on the left."""
    shifted = F.transform(c, lambda x: x.cast("long") + 1)
    kept = F.slice(shifted, F.greatest(F.size(shifted) - length + 1, F.lit(1)), length)
    return F.concat(F.array_repeat(F.lit(0).cast("long"), length - F.size(kept)), kept)


def latest_items(sequences: DataFrame, max_len: int) -> DataFrame:
    """The last ``max_len`` items of every user as a padded array."""
    tail = sequences.filter(F.col("pos") > F.col("n") - max_len)
    lists = tail.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "item_id"))).alias("_rows")
    )
    return lists.select(
        "user_id", left_pad(F.transform("_rows", lambda r: r["item_id"]), max_len).alias("padded")
    )


def known_rows(rows: DataFrame, items: DataFrame, users_need: Sequence[str] = ("train", "test")) -> DataFrame:
    """Rows of known items, for users that keep at least one row in every split."""
    found = rows.join(items.select("item_id").distinct(), "item_id")
    complete = (
        found.groupBy("user_id")
        .agg(*[F.max(F.col("split") == s).alias(s) for s in users_need])
        .filter(" and ".join(users_need))
        .select("user_id")
    )
    return found.join(complete, "user_id", "left_semi")
