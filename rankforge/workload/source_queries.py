"""Reader and writer queries: tables go out in a source format and come back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rankforge.operators.catalog import CATALOG_COLUMNS
from rankforge.session import shared_dir
from rankforge.sources import readers, writers
from rankforge.workload import shapes as s
from rankforge.workload import views as v
from rankforge.workload.registry import cte, query

CATALOG_FIELDS = {
    "product_id": "'P' || item_id", "product_name": "product_name", "category_raw": "category_raw", "category": "category",
    "brand_label": "brand_label", "brand": "brand", "price": "price", "actual_price": "price * 2", "discount_pct": "discount_pct",
    "rating": "rating", "rating_count": "rating_count", "inferred_reviewer_count": "inferred_reviewer_count",
    "review_text_richness": "review_text_richness", "quality": "quality", "popularity": "popularity", "recency": "recency",
    "price_pct": "price_pct", "quality_pct": "quality_pct", "popularity_pct": "popularity_pct", "rating_pct": "rating_pct", "recency_pct": "recency_pct",
}


def path(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def published(spark, sf):
    items = v.items(spark, sf)
    return items.withColumn("product_id", F.format_string("P%d", F.col("item_id"))).withColumn(
        "actual_price", F.col("price") * 2
    ).select(*CATALOG_COLUMNS)


@query(
    "read_catalog", "S1 S7",
    "SELECT " + ", ".join(f"{e} AS {c}" for c, e in CATALOG_FIELDS.items()) + " FROM items", "items",
)
def read_catalog(spark, sf):
    where = path(spark, "catalog")
    writers.write_csv(published(spark, sf), where)
    return readers.read_catalog(spark, where)


def record_lines(spark, sf):
    """Metadata as one Python literal per line: single quotes and None, as shops'
    dumps have them."""
    part = v.table(spark, sf, "part")
    c = F.col
    rank = F.when(c("p_size") == 7, F.lit("{}")).otherwise(F.format_string("{'Home': %d, 'Other': %d}", c("p_size"), c("p_size") + 100))
    price = F.when(c("p_size") == 9, F.lit("None")).otherwise(c("p_retailprice").cast("string"))
    brand = F.when(c("p_size") == 11, F.lit("None")).otherwise(F.concat(F.lit("'"), c("p_brand"), F.lit("'")))
    cats = (
        F.when(c("p_type") == "SMALL", F.lit("[]"))
        .when(c("p_type") == "LARGE", F.lit("[['Only']]"))
        .otherwise(F.format_string("[['Root', '%s', '%s'], ['Second']]", c("p_type"), c("p_brand")))
    )
    return part.select(
        F.concat(
            F.lit("{'asin': 'A"), c("p_partkey"), F.lit("', 'price': "), price, F.lit(", 'brand': "), brand,
            F.lit(", 'salesRank': "), rank, F.lit(", 'categories': "), cats, F.lit("}"),
        ).alias("value")
    )


cte(
    "meta_rows",
    """SELECT 'A' || p_partkey AS asin, p_retailprice AS price, p_size::DOUBLE AS sales_rank, CASE WHEN p_size = 11 THEN 'Unknown' ELSE p_brand END AS brand,
  CASE p_type WHEN 'SMALL' THEN 'Unknown' WHEN 'LARGE' THEN 'Only' ELSE p_type END AS cat_lvl2,
  CASE p_type WHEN 'SMALL' THEN 'Unknown' WHEN 'LARGE' THEN 'Only' ELSE p_brand END AS cat_leaf FROM part WHERE p_size NOT IN (7, 9)""",
)


@query("load_metadata", "S2 S3", "SELECT * FROM meta_rows", "meta_rows")
def load_metadata(spark, sf):
    where = path(spark, "meta")
    record_lines(spark, sf).write.option("compression", "gzip").text(where)
    return readers.load_metadata(spark, where)


@query(
    "load_reviews", "S2 S4",
    "SELECT 'U' || user_id AS user_id, 'A' || item_id AS item_id, rating, ts FROM reviews", "reviews",
)
def load_reviews(spark, sf):
    """The whole log goes out; liked reviews of items with metadata come back."""
    where = path(spark, "reviews")
    lines = v.interactions(spark, sf).select(
        F.format_string(
            "{'reviewerID': 'U%d', 'asin': 'A%d', 'overall': %.1f, 'unixReviewTime': %d, 'helpful': None}",
            "user_id", "item_id", "rating", "ts",
        ).alias("value")
    )
    lines.write.option("compression", "gzip").text(where)
    known = v.metadata(spark, sf).select(F.format_string("A%d", "item_id").alias("item_id"))
    return readers.load_reviews(spark, where, known)


def user_payloads(spark, sf):
    """Nested documents, one per user: the whole train list and the whole test list in
    the order of the sequence. A user's document is one value, as the format asks."""
    part = lambda name: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("split") == name, F.struct("pos", "item_id", "rating", "ts")))),
        lambda r: F.struct(r["item_id"].cast("string").alias("asin"), r["rating"].alias("rating"), r["ts"].alias("time")),
    )
    docs = v.selected(spark, sf).groupBy("user_id").agg(F.count("*").alias("n_unique_items"), part("train").alias("train"), part("test").alias("test"))
    profile = v.learned_profiles(spark, sf).select(
        "user_id", F.struct("cat_lvl2_affinity", "cat_leaf_affinity", "log_price_center", "log_price_spread", "recency_pref").alias("profile")
    )
    return docs.join(profile, "user_id").withColumn("user_id", F.format_string("user_%06d", "user_id"))


@query(
    "load_users", "S5 S8",
    "SELECT format('user_{:06d}', user_id) AS user_id, split, CASE WHEN split = 'train' THEN pos ELSE pos - (n - 7) END AS pos, item_id::VARCHAR AS item_id, rating, ts FROM selected_users",
    "selected_users",
)
def load_users(spark, sf):
    where = path(spark, "users")
    writers.write_json(user_payloads(spark, sf), where)
    return s.rounded(readers.user_rows(readers.load_users(spark, where, lines=True)))


@query("load_first_users", "S5", "SELECT user_id FROM (SELECT DISTINCT format('user_{:06d}', user_id) AS user_id FROM selected_users) ORDER BY user_id LIMIT 100", "selected_users")
def load_first_users(spark, sf):
    where = path(spark, "users")
    writers.write_json(user_payloads(spark, sf), where)
    return readers.load_users(spark, where, max_users=100, lines=True).select("user_id")


@query(
    "flatten_report", "S6 S8",
    "SELECT run::BIGINT AS run, 'p' || profile_idx AS profile, method, checkpoint, round(f1, 6) AS f1 FROM report", "report",
)
def flatten_report(spark, sf):
    """The nested report of the experiment (a few rows per run), written and
    flattened again."""
    where = path(spark, "report")
    rows = s.report(spark, sf)
    per_method = rows.groupBy("run", "profile_idx", "method").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("checkpoint").cast("string"), "f1"))).alias("m")
    )
    per_profile = per_method.groupBy("run", "profile_idx").agg(F.map_from_entries(F.collect_list(F.struct("method", "m"))).alias("f1"))
    per_run = per_profile.groupBy("run").agg(
        F.collect_list(F.struct(F.concat(F.lit("p"), F.col("profile_idx").cast("string")).alias("profile_name"), "f1")).alias("profile_results")
    )
    nested = per_run.groupBy().agg(F.collect_list(F.struct(F.col("run").alias("run_index"), "profile_results")).alias("artifacts"))
    writers.write_json(nested, where, single=True)
    return s.rounded(readers.flatten_report(spark, where))


@query("csv_sink", "S7", "SELECT category, count(*) AS n FROM items GROUP BY category", "items")
def csv_sink(spark, sf):
    where = path(spark, "summary")
    writers.write_csv(v.items(spark, sf).groupBy("category").agg(F.count("*").alias("n")), where, single=True)
    return spark.read.schema("category string, n long").option("header", True).csv(where)


@query("json_sink", "S8", "SELECT category, count(*) AS n FROM items GROUP BY category", "items")
def json_sink(spark, sf):
    where = path(spark, "summary")
    writers.write_json(v.items(spark, sf).groupBy("category").agg(F.count("*").alias("n")), where)
    return spark.read.schema("category string, n long").json(where)


@query("materialize_runs", "S9", "SELECT run::BIGINT AS run, count(*) AS n FROM samples GROUP BY run", "samples")
def materialize_runs(spark, sf):
    """Three runs first, then all: only the missing two are added."""
    where = path(spark, "runs")
    drawn = s.samples(spark, sf)
    writers.materialize_runs(spark, drawn.filter("run < 3"), where)
    out = writers.materialize_runs(spark, drawn, where)
    return s.rounded(out.groupBy("run").agg(F.count("*").alias("n")))
