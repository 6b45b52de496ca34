"""Parsing of raw catalog text into typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first number in a text, the characters kept in a brand
# label, its length, the length cap of review text, and the coarse categories.
NUMBER = r"[-+]?\d*\.?\d+"
NOT_IN_LABEL = r"[^A-Za-z0-9&+-]"
LABEL_LENGTH = 40
RICHNESS_CAP = 2000
COARSE_CATEGORIES = {
    "Computers&Accessories": "Computers",
    "OfficeProducts": "Computers",
    "Home&Kitchen": "HomeKitchen",
    "HomeImprovement": "HomeKitchen",
}
OTHER_CATEGORY = "Electronics"
UNKNOWN = "Unknown"


def parse_number(c: Column) -> Column:
    """First number in the text, commas ignored; null when there is none."""
    found = F.regexp_extract(F.regexp_replace(c.cast("string"), ",", ""), NUMBER, 0)
    return found.try_cast("double")


def parse_rating(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


def reviewer_count(c: Column) -> Column:
    """Number of non-blank parts of a comma-separated list."""
    parts = F.filter(F.split(c, ","), lambda x: F.trim(x) != "")
    return F.coalesce(F.size(parts), F.lit(0)).cast("long")


def text_richness(*columns: Column) -> Column:
    """Length of the space-joined texts, capped; a null counts as empty."""
    joined = F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.least(F.length(joined), F.lit(RICHNESS_CAP)).cast("double")


def coarse_category(c: Column) -> Column:
    head = F.split(c.cast("string"), r"\|")[0]
    out = F.lit(OTHER_CATEGORY)
    for label in sorted(set(COARSE_CATEGORIES.values())):
        names = [n for n, v in COARSE_CATEGORIES.items() if v == label]
        out = F.when(head.isin(names), F.lit(label)).otherwise(out)
    return out


def brand_label(c: Column) -> Column:
    """First word of a name without punctuation."""
    token = F.split(F.trim(c.cast("string")), r"\s+|,")[0]
    cleaned = F.substring(F.regexp_replace(token, NOT_IN_LABEL, ""), 1, LABEL_LENGTH)
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(UNKNOWN))


def display_name(c: Column, length: int = 160) -> Column:
    return F.substring(F.coalesce(c.cast("string"), F.lit("")), 1, length)
