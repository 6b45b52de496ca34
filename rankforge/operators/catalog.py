"""From raw catalog rows to percentile criteria."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.functions import text
from rankforge.functions.scalars import clip
from rankforge.operators.ordering import percentile_ranks
from rankforge.operators.ranking import keep_first
from rankforge.session import materialize

# The published columns of an enriched catalog, in order.
CATALOG_COLUMNS = (
    "product_id", "product_name", "category_raw", "category", "brand_label", "brand",
    "price", "actual_price", "discount_pct", "rating", "rating_count",
    "inferred_reviewer_count", "review_text_richness", "quality", "popularity", "recency",
    "price_pct", "quality_pct", "popularity_pct", "rating_pct", "recency_pct",
)
COMPOSITE_DIGITS = 9


def parse_raw(raw: DataFrame) -> DataFrame:
    """Typed columns from a raw catalog whose columns are all text."""
    c = F.col
    return raw.select(
        "product_id",
        "product_name",
        c("category").cast("string").alias("category_raw"),
        text.coarse_category(c("category")).alias("category"),
        text.brand_label(c("product_name")).alias("brand_label"),
        text.parse_number(c("discounted_price")).alias("price"),
        text.parse_number(c("actual_price")).alias("actual_price"),
        clip(text.parse_number(c("discount_percentage")), 0, 100).alias("discount_pct"),
        text.parse_rating(c("rating")).alias("rating"),
        text.parse_number(c("rating_count")).alias("rating_count"),
        text.reviewer_count(c("user_id")).alias("inferred_reviewer_count"),
        text.text_richness(c("review_title"), c("review_content"), c("about_product")).alias(
            "review_text_richness"
        ),
    )


def clean_catalog(items: DataFrame, key: str = "product_id") -> DataFrame:
    return items.dropna(subset=[key, "price", "rating", "rating_count"]).filter(
        (F.col("price") > 0) & F.col("rating").between(1.0, 5.0)
    )


def dedupe_catalog(items: DataFrame, key: str = "product_id") -> DataFrame:
    """One row per product: most ratings, then best rating; remaining ties by
    the other columns, so that the choice is reproducible."""
    rest = [F.col(c) for c in items.columns if c not in (key, "rating_count", "rating")]
    return keep_first(items, [key], [-F.col("rating_count"), -F.col("rating"), *rest])


def price_tier(rank: Column) -> Column:
    return (
        F.when(rank <= F.lit(1 / 3), "budget_brand")
        .when(rank >= F.lit(2 / 3), "premium_brand")
        .otherwise("mid_brand")
    )


def composite_criteria(items: DataFrame, key: str = "product_id") -> DataFrame:
    """quality, popularity, recency, price tier and the percentile columns that
    need no second pass. The rank of log1p(count) is the rank of the count."""
    ranked = percentile_ranks(
        items,
        {
            "price_rank": ("price", False),
            "count_rank": ("rating_count", False),
            "richness_rank": ("review_text_richness", False),
            "reviewer_rank": ("inferred_reviewer_count", False),
            "discount_rank": ("discount_pct", False),
            "rating_pct": ("rating", False),
        },
        [key],
    )
    c = F.col
    rating_norm = (c("rating") - 1.0) / 4.0
    quality = 100.0 * (0.70 * rating_norm + 0.20 * c("count_rank") + 0.10 * c("richness_rank"))
    recency = 100.0 * (0.65 * c("reviewer_rank") + 0.35 * c("discount_rank"))
    return (
        ranked.withColumn("quality", F.round(quality, COMPOSITE_DIGITS))
        .withColumn("popularity", F.round(100.0 * c("count_rank"), COMPOSITE_DIGITS))
        .withColumn("recency", F.round(recency, COMPOSITE_DIGITS))
        .withColumn("brand", price_tier(c("price_rank")))
        .withColumn("price_pct", 1 - c("price_rank"))
        .withColumn("popularity_pct", c("count_rank"))
        .drop("price_rank", "count_rank", "richness_rank", "reviewer_rank", "discount_rank")
    )


def enrich(items: DataFrame, key: str = "product_id") -> DataFrame:
    """Typed, cleaned rows to the full set of criteria and percentiles. The rows
    are read several times, so both passes start from a written table."""
    composed = materialize(composite_criteria(materialize(items), key))
    return percentile_ranks(
        composed, {"quality_pct": ("quality", False), "recency_pct": ("recency", False)}, [key]
    )


def enrich_catalog(raw: DataFrame) -> DataFrame:
    """Raw text rows to the published catalog columns."""
    items = dedupe_catalog(clean_catalog(parse_raw(raw)))
    return enrich(items).select(*CATALOG_COLUMNS)


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df
