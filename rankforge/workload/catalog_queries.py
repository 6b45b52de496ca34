"""Parsing, cleaning, criteria and percentile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankforge.functions import profiles as pf
from rankforge.functions import scalars, text
from rankforge.operators import catalog as cat
from rankforge.operators import contexts as cx
from rankforge.operators import ordering, sampling, utility
from rankforge.operators.ranking import keep_first
from rankforge.sources.writers import publish
from rankforge.workload import shapes as s
from rankforge.workload import views as v
from rankforge.workload.registry import cte, query

NUM = r"[-+]?\d*\.?\d+"


def number_sql(c: str) -> str:
    return f"try_cast(nullif(regexp_extract(replace({c}, ',', ''), '{NUM}'), '') AS DOUBLE)"


@query(
    "parse_number", "P1",
    f"""SELECT doc_id, {number_sql('text')} AS number FROM documents
UNION ALL SELECT -1 AS doc_id, {number_sql('discounted_price')} AS number FROM raw_catalog""",
    "raw_catalog",
)
def parse_number(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", text.parse_number(F.col("text")).alias("number"))
    prices = v.raw_catalog(spark, sf).select(
        F.lit(-1).cast("long").alias("doc_id"), text.parse_number(F.col("discounted_price")).alias("number")
    )
    return docs.unionByName(prices)


@query("parse_rating", "P2", "SELECT product_id, rating AS raw, try_cast(trim(rating) AS DOUBLE) AS rating FROM raw_catalog", "raw_catalog")
def parse_rating(spark, sf):
    return v.raw_catalog(spark, sf).select("product_id", F.col("rating").alias("raw"), text.parse_rating(F.col("rating")).alias("rating"))


@query(
    "reviewer_count", "P3",
    "SELECT doc_id, coalesce(len(list_filter(string_split(text, ','), lambda x: trim(x, ' ') <> '')), 0)::BIGINT AS reviewers FROM documents",
)
def reviewer_count(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", text.reviewer_count(F.col("text")).alias("reviewers"))


@query(
    "text_richness", "P4",
    "SELECT doc_id, least(length(coalesce(lang, '') || ' ' || coalesce(text, '') || ' ' || coalesce(source, '')), 2000)::DOUBLE AS richness FROM documents",
)
def text_richness(spark, sf):
    return v.table(spark, sf, "documents").select(
        "doc_id", text.text_richness(F.col("lang"), F.col("text"), F.col("source")).alias("richness")
    )


COARSE_SQL = """CASE WHEN string_split(category, '|')[1] IN ('Computers&Accessories', 'OfficeProducts') THEN 'Computers'
  WHEN string_split(category, '|')[1] IN ('Home&Kitchen', 'HomeImprovement') THEN 'HomeKitchen' ELSE 'Electronics' END"""


@query("coarse_category", "P5", f"SELECT product_id, {COARSE_SQL} AS category FROM raw_catalog", "raw_catalog")
def coarse_category(spark, sf):
    return v.raw_catalog(spark, sf).select("product_id", text.coarse_category(F.col("category")).alias("category"))


def label_sql(c: str) -> str:
    token = rf"regexp_extract({c}, '^[^\s,]*')"
    return f"coalesce(nullif(substring(regexp_replace({token}, '[^A-Za-z0-9&+-]', '', 'g'), 1, 40), ''), 'Unknown')"


@query(
    "brand_label", "P6",
    f"SELECT doc_id, {label_sql('trim(text)')} AS label FROM documents UNION ALL SELECT -1 AS doc_id, {label_sql('trim(product_name)')} AS label FROM raw_catalog",
    "raw_catalog",
)
def brand_label(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", text.brand_label(F.col("text")).alias("label"))
    names = v.raw_catalog(spark, sf).select(
        F.lit(-1).cast("long").alias("doc_id"), text.brand_label(F.col("product_name")).alias("label")
    )
    return docs.unionByName(names)


@query(
    "clip_values", "P7",
    f"SELECT product_id, least(greatest({number_sql('discount_percentage')}, 0), 100)::DOUBLE AS discount_pct FROM raw_catalog", "raw_catalog",
)
def clip_values(spark, sf):
    return v.raw_catalog(spark, sf).select(
        "product_id", scalars.clip(text.parse_number(F.col("discount_percentage")), 0, 100).alias("discount_pct")
    )


@query("price_tier", "P8 W1", "SELECT item_id, price, brand FROM items", "items")
def price_tier(spark, sf):
    ranked = ordering.percentile_ranks(v.catalog(spark, sf), {"r": ("price", False)}, ["item_id"])
    return ranked.select("item_id", "price", cat.price_tier(F.col("r")).alias("brand"))


@query("composite_criteria", "P9", "SELECT item_id, quality, popularity, recency FROM items", "items")
def composite_criteria(spark, sf):
    return cat.composite_criteria(v.catalog(spark, sf), "item_id").select("item_id", "quality", "popularity", "recency")


@query("observable_utility", "P10 P14", f"SELECT item_id, round({s.mm('(price_pct + quality_pct + popularity_pct + rating_pct) / 4')}, 6) AS observable FROM items", "items")
def observable_utility(spark, sf):
    return s.rounded(utility.observable_utility(v.items(spark, sf)).select("item_id", "observable"))


def _frame(spark, sf):
    return utility.with_profiles(v.items(spark, sf), v.FIXTURE_PROFILES)


@query(
    "item_profile_frame", "J5",
    "SELECT item_id, profile, price_lo, price_hi, recency_weight, price FROM items CROSS JOIN profiles", "items profiles",
)
def item_profile_frame(spark, sf):
    return _frame(spark, sf).select("item_id", "profile", "price_lo", "price_hi", "recency_weight", "price")


@query(
    "hidden_components", "P11",
    "SELECT item_id, profile, round(brand_score, 9) AS brand_score, round(price_fit, 9) AS price_fit, round(cat_score, 9) AS cat_score, round(recency_score, 9) AS recency_score FROM item_profiles",
    "item_profiles",
)
def hidden_components(spark, sf):
    return s.rounded(
        utility.hidden_components(_frame(spark, sf)).select("item_id", "profile", "brand_score", "price_fit", "cat_score", "recency_score"), 9
    )


@query("hidden_utility", "P12 P14", "SELECT item_id, profile, round(hidden, 6) AS hidden FROM item_profiles", "item_profiles")
def hidden_utility(spark, sf):
    return s.rounded(utility.hidden_utility(_frame(spark, sf)).select("item_id", "profile", "hidden"))


@query("blend_target", "P16", "SELECT item_id, profile, round(target, 6) AS target FROM item_profiles", "item_profiles")
def blend_target(spark, sf):
    frame = utility.hidden_utility(utility.with_profiles(utility.observable_utility(v.items(spark, sf)), v.FIXTURE_PROFILES))
    return s.rounded(utility.blend_target(frame, noise_sd=0.0).select("item_id", "profile", "target"))


HEX = "('0x' || substring(md5(concat_ws('|', 17042 + 101 + 97 * profile_idx + 7777, item_id, '{}')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query(
    "blend_target_with_noise", "P16",
    f"""SELECT item_id, profile, round({s.mm('b', 'profile_idx')}, 6) AS target FROM (SELECT *, 0.5 * observable + 0.5 * hidden
  + 0.015 * (sqrt(-2.0 * ln(greatest({HEX.format('a')}, pow(2.0::DOUBLE, -52)))) * cos(2.0 * pi() * ({HEX.format('b')}))) AS b FROM item_profiles)""",
    "item_profiles",
)
def blend_target_with_noise(spark, sf):
    frame = s.item_profiles(spark, sf).drop("target")
    seed = pf.profile_seed(F.lit(pf.SEED_BASE), F.col("profile_idx"))
    return s.rounded(utility.blend_target(frame, seed=seed).select("item_id", "profile", "target"))


@query(
    "engagement_probabilities", "P15",
    """SELECT item_id, profile, round(least(greatest(0.40 * brand_score + 0.35 * (price_fit > 0.95)::INTEGER + 0.15 + 0.10 * recency_score, 0), 1), 9) AS p_engage,
  round(least(greatest(0.50 * brand_score + 0.30 * (price_fit > 0.95)::INTEGER + 0.20, 0), 1), 9) AS p_convert FROM item_profiles""",
    "item_profiles",
)
def engagement_probabilities(spark, sf):
    # A looser threshold than the default, which only the exact centre passes.
    return s.rounded(utility.engagement_probabilities(_frame(spark, sf), 0.95).select("item_id", "profile", "p_engage", "p_convert"), 9)


cte(
    "contexts",
    """SELECT item_id, list_concat([1.0::DOUBLE, price_pct, quality_pct, popularity_pct, rating_pct, recency_pct],
  list_transform(categories, lambda l: (l = category)::INTEGER::DOUBLE), list_transform(brands, lambda l: (l = brand)::INTEGER::DOUBLE)) AS x
FROM items, (SELECT list(DISTINCT category ORDER BY category) AS categories, list(DISTINCT brand ORDER BY brand) AS brands FROM items)""",
    "items",
)


@query(
    "context_matrix", "P17",
    f"SELECT item_id, list_transform(x, lambda e: {s.half_up_sql('e')}) AS x FROM contexts",
    "contexts",
)
def context_matrix(spark, sf):
    return contexts(v.items(spark, sf))[0].select("item_id", F.transform("x", lambda e: s.half_up(e)).alias("x"))


def contexts(items):
    """[1, five percentiles, one-hot category, one-hot price tier] with the labels that the
    catalog has, in order, and the length."""
    labels = cx.label_dictionary(items, ["category", "brand"])
    size = cx.context_size(pf.FEATURES, labels)
    return cx.dense(cx.sparse_contexts(items, pf.FEATURES, labels), size), size


@query(
    "l2_normalize", "P18",
    """SELECT vec_id, list_transform(embedding, lambda e: round(e::DOUBLE / CASE WHEN nrm = 0 THEN 1 ELSE nrm END, 6) + 0.0) AS unit
FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda e: e::DOUBLE * e::DOUBLE))) AS nrm FROM embeddings)""",
)
def l2_normalize(spark, sf):
    return v.table(spark, sf, "embeddings").select(
        "vec_id", F.transform(scalars.l2_normalize(F.col("embedding")), lambda e: F.round(e, 6)).alias("unit")
    )


@query(
    "clean_nonfinite", "P19",
    "SELECT event_id, CASE WHEN value > 20 THEN 0.0 ELSE coalesce(value, 0) END AS cleaned FROM events",
)
def clean_nonfinite(spark, sf):
    value = F.when(F.col("value") > 20, F.lit(float("inf"))).otherwise(F.col("value"))
    return v.table(spark, sf, "events").select("event_id", scalars.clean_finite(value).alias("cleaned"))


@query(
    "round_and_truncate", "P24",
    "SELECT doc_id, substring(text, 1, 160) AS display_name, round(n_chars / 7.0::DOUBLE, 3) AS rounded FROM documents",
)
def round_and_truncate(spark, sf):
    return v.table(spark, sf, "documents").select(
        "doc_id", text.display_name(F.col("text")).alias("display_name"), F.round(F.col("n_chars") / 7.0, 3).alias("rounded")
    )


cte(
    "parsed",
    f"""SELECT product_id, product_name, category AS category_raw, {COARSE_SQL} AS category, {label_sql('trim(product_name)')} AS brand_label,
  {number_sql('discounted_price')} AS price, {number_sql('actual_price')} AS actual_price,
  least(greatest({number_sql('discount_percentage')}, 0), 100)::DOUBLE AS discount_pct, try_cast(trim(rating) AS DOUBLE) AS rating,
  {number_sql('rating_count')} AS rating_count,
  coalesce(len(list_filter(string_split(user_id, ','), lambda x: trim(x, ' ') <> '')), 0)::BIGINT AS inferred_reviewer_count,
  least(length(coalesce(review_title, '') || ' ' || coalesce(review_content, '') || ' ' || coalesce(about_product, '')), 2000)::DOUBLE AS review_text_richness
FROM raw_catalog""",
    "raw_catalog",
)
cte("cleaned", "SELECT * FROM parsed WHERE product_id IS NOT NULL AND rating_count IS NOT NULL AND price > 0 AND rating BETWEEN 1 AND 5", "parsed")
cte("deduped", "SELECT * FROM cleaned QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY rating_count DESC, rating DESC) = 1", "cleaned")


@query("clean_catalog", "F1", "SELECT product_id, price, rating, rating_count FROM cleaned", "cleaned")
def clean_catalog(spark, sf):
    return cat.clean_catalog(cat.parse_raw(v.raw_catalog(spark, sf))).select("product_id", "price", "rating", "rating_count")


@query("keep_first_listing", "W2", "SELECT product_id, price, rating, rating_count, category FROM deduped", "deduped")
def keep_first_listing(spark, sf):
    rows = cat.dedupe_catalog(cat.clean_catalog(cat.parse_raw(v.raw_catalog(spark, sf))))
    return rows.select("product_id", "price", "rating", "rating_count", "category")


cte("deduped_composed", v.COMPOSED_SQL.format(source="deduped"), "deduped")
cte(
    "published",
    f"SELECT {', '.join(cat.CATALOG_COLUMNS)} FROM (SELECT *, {v.pct_sql('quality')} AS quality_pct, {v.pct_sql('recency')} AS recency_pct FROM deduped_composed)",
    "deduped_composed",
)
PUBLISHED = ", ".join(
    f"round({c}, 9) AS {c}" if c not in ("product_id", "product_name", "category_raw", "category", "brand_label", "brand", "inferred_reviewer_count") else c
    for c in cat.CATALOG_COLUMNS
)


@query("enrich_catalog", "P25 S11 P8 P9 F1 W1 W2", f"SELECT {PUBLISHED} FROM published", "published")
def enrich_catalog(spark, sf):
    return s.rounded(cat.enrich_catalog(v.raw_catalog(spark, sf)), 9)


@query(
    "publication_projection", "S11",
    "SELECT product_id, product_name, category, rating_count FROM raw_catalog", "raw_catalog",
)
def publication_projection(spark, sf):
    return publish(v.raw_catalog(spark, sf), ["product_id", "product_name", "category", "rating_count"])


PCT = ("price_pct", "quality_pct", "popularity_pct", "rating_pct", "recency_pct")


@query("percentile_rank", "W1", "SELECT item_id, " + ", ".join(f"round({c}, 9) AS {c}" for c in PCT) + " FROM items", "items")
def percentile_rank(spark, sf):
    ranked = ordering.percentile_ranks(
        v.items(spark, sf).drop(*PCT),
        {"price_pct": ("price", True), **{f"{c}_pct": (c, False) for c in ("quality", "popularity", "rating", "recency")}},
        ["item_id"],
    )
    return s.rounded(ranked.select("item_id", *PCT), 9)


@query(
    "percentile_rank_with_nulls", "W1",
    f"""SELECT item_id, category, CASE WHEN x IS NOT NULL THEN round({v.pct_sql('x', 'category')}, 9) END AS pct
FROM (SELECT item_id, category, CASE WHEN price >= 950 THEN rating END AS x FROM items)""",
    "items",
)
def percentile_rank_with_nulls(spark, sf):
    rows = v.items(spark, sf).select("item_id", "category", F.when(F.col("price") >= 950, F.col("rating")).alias("x"))
    ranked = ordering.percentile_ranks(rows, {"pct": ("x", False)}, ["item_id"], ["category"])
    return s.rounded(ranked.select("item_id", "category", "pct"), 9)


@query("min_max", "P14", f"SELECT item_id, category, round({s.mm('price', 'category')}, 6) AS scaled, round({s.mm('item_id * 0.0')}, 6) AS flat FROM items", "items")
def min_max(spark, sf):
    scaled = ordering.min_max(v.items(spark, sf), {"scaled": "price"}, ["category"])
    flat = ordering.min_max(scaled.withColumn("_c", F.lit(0.0)), {"flat": "_c"})
    return s.rounded(flat.select("item_id", "category", "scaled", "flat"))


@query("median_octants", "W8", "SELECT item_id, octant::BIGINT AS octant FROM octants", "octants")
def median_octants(spark, sf):
    return s.rounded(sampling.octants(v.items(spark, sf)).select("item_id", "octant"))


@query(
    "exact_quantiles", "A3 A11 W8 P20",
    "SELECT l_partkey, " + ", ".join(
        f"round(quantile_cont(l_extendedprice, {p}::DOUBLE), 7) AS {n}" for n, p in (("q25", 0.25), ("q50", 0.5), ("q97", 0.975))
    ) + " FROM lineitem GROUP BY l_partkey",
)
def exact_quantiles(spark, sf):
    q = ordering.quantiles(v.table(spark, sf, "lineitem"), "l_extendedprice", {"q25": 0.25, "q50": 0.5, "q97": 0.975}, ["l_partkey"])
    return s.rounded(q, 7)


@query(
    "first_shipment", "W2",
    "SELECT l_partkey, epoch(l_shipdate)::BIGINT AS shipped, l_suppkey FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_suppkey) = 1)",
)
def first_shipment(spark, sf):
    lines = v.table(spark, sf, "lineitem").select("l_partkey", F.unix_timestamp("l_shipdate").alias("shipped"), "l_suppkey")
    return keep_first(lines, ["l_partkey"], [F.col("shipped"), F.col("l_suppkey")])
