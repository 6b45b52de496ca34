"""Readers for catalogs, line records, user files and nested reports."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankforge.functions.text import UNKNOWN
from rankforge.operators.catalog import CATALOG_COLUMNS, require_columns
from rankforge.operators.interactions import MIN_RATING, positive_reviews
from rankforge.operators.ranking import keep_first

# Which catalog columns are text, and which are whole numbers.
TEXT_COLUMNS = ("product_id", "product_name", "category_raw", "category", "brand_label", "brand")
INTEGER_COLUMNS = ("inferred_reviewer_count",)

CATALOG_SCHEMA = T.StructType([
    T.StructField(c, T.StringType() if c in TEXT_COLUMNS else T.LongType() if c in INTEGER_COLUMNS else T.DoubleType())
    for c in CATALOG_COLUMNS
])
METADATA_SCHEMA = (
    "asin string, price double, brand string, salesRank map<string,double>, categories array<array<string>>"
)
#: A record without nesting whose texts hold no quote, backslash, colon or control character, and
#: whose numbers are written as Python and JSON write them: it is JSON but for its quotes and names.
_TEXT = r"'[^'\"\\:\x00-\x1f\x7f]*'"
_VALUE = rf"(?:{_TEXT}|0|-?[1-9][0-9]{{0,14}}|(?:0|[1-9][0-9]{{0,8}})\.(?:0|[0-9]{{0,3}}[1-9])|None|True|False)"
FLAT = rf"\A\{{{_TEXT}: {_VALUE}(?:, {_TEXT}: {_VALUE})*\}}\z"
REVIEW_SCHEMA = "reviewerID string, asin string, overall double, unixReviewTime long"
USERS_SCHEMA = (
    "user_id string, n_unique_items long, train array<struct<asin:string,rating:double,time:long>>, "
    "test array<struct<asin:string,rating:double,time:long>>, profile struct<cat_lvl2_affinity:map<string,double>, "
    "cat_leaf_affinity:map<string,double>, log_price_center:double, log_price_spread:double, recency_pref:double>"
)
REPORT_SCHEMA = (
    "artifacts array<struct<run_index:int, profile_results:array<struct<profile_name:string, "
    "f1:map<string,map<string,double>>>>>>"
)


def read_catalog(spark: SparkSession, path: str, required=CATALOG_COLUMNS, fmt: str = "csv") -> DataFrame:
    """An enriched catalog; a missing column is an error that names it."""
    if fmt == "parquet":
        return require_columns(spark.read.parquet(path), required)
    header = spark.read.option("header", True).csv(path)
    require_columns(header, required)
    types = {f.name: f.dataType for f in CATALOG_SCHEMA}
    schema = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header.columns])
    return spark.read.schema(schema).option("header", True).csv(path)


def read_records(spark: SparkSession, path: str, schema: str, partitions: int | None = None) -> DataFrame:
    """Text files (also gzip) with one Python literal per line.

    A gzip file cannot be split, so its lines are spread over the cluster before
    they are parsed, one after the other in turn. Flat records (``FLAT``) are rewritten as
    JSON a batch at a time, all others are parsed. Lines that do not parse give no
    record; ``bad_lines`` counts them.
    """
    return _parsed(spark, path, partitions).filter("json IS NOT NULL").select(F.from_json("json", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")


def bad_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """One row (n_lines, n_bad): the lines of the files, and those that do not parse."""
    parsed = _parsed(spark, path, partitions)
    return parsed.agg(F.count("*").alias("n_lines"), F.count_if(F.col("json").isNull()).alias("n_bad"))


def _parsed(spark: SparkSession, path: str, partitions: int | None) -> DataFrame:
    lines = spark.read.text(path).repartition(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))

    def convert(line: str) -> str | None:
        try:
            return json.dumps(ast.literal_eval(line))
        except (ValueError, SyntaxError, TypeError):
            return None

    def to_json(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = batch.column(0)
            flat = pc.fill_null(pc.match_substring_regex(value, FLAT), False)
            out = pc.replace_substring(value, "'", '"')
            for word, name in (("None", "null"), ("True", "true"), ("False", "false")):
                out = pc.replace_substring_regex(out, f": {word}([,}}])", f": {name}\\1")
            other = pc.filter(value, pc.invert(flat))
            if len(other):
                parsed = pa.array([convert(line) for line in other.to_pylist()], value.type)
                out = pc.replace_with_mask(out, pc.invert(flat), parsed)
            yield pa.record_batch([out], names=["json"])

    return lines.mapInArrow(to_json, "json string")


def project_metadata(records: DataFrame) -> DataFrame:
    """asin, price, smallest sales rank, brand and two category levels of the
    first path; records without price or rank are dropped, one row per asin."""
    path = F.try_element_at("categories", F.lit(1))
    depth = F.coalesce(F.size(path), F.lit(0))
    ranks = F.filter(F.map_values("salesRank"), lambda v: v.isNotNull())
    level2 = F.when(depth >= 2, F.try_element_at(path, F.lit(2))).when(depth == 1, F.try_element_at(path, F.lit(1)))
    rows = records.select(
        "asin",
        F.col("price").cast("double").alias("price"),
        F.array_min(ranks).alias("sales_rank"),
        F.coalesce(F.nullif(F.col("brand"), F.lit("")), F.lit(UNKNOWN)).alias("brand"),
        F.coalesce(level2, F.lit(UNKNOWN)).alias("cat_lvl2"),
        F.coalesce(F.when(depth > 0, F.try_element_at(path, F.lit(-1))), F.lit(UNKNOWN)).alias("cat_leaf"),
    ).filter(F.col("price").isNotNull() & F.col("sales_rank").isNotNull())
    # Files carry no row order on a cluster; the first by content is kept.
    return keep_first(rows, ["asin"], [F.col(c) for c in rows.columns if c != "asin"])


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    return project_metadata(read_records(spark, path, METADATA_SCHEMA))


def load_reviews(spark: SparkSession, path: str, valid_items: DataFrame, min_rating: float = MIN_RATING) -> DataFrame:
    """Reviews of known items (``valid_items`` carries item_id) at or above a rating."""
    reviews = read_records(spark, path, REVIEW_SCHEMA).select(
        F.col("reviewerID").alias("user_id"), F.col("asin").alias("item_id"),
        F.col("overall").alias("rating"), F.col("unixReviewTime").alias("ts"),
    )
    return positive_reviews(reviews, valid_items, min_rating)


def load_users(spark: SparkSession, path: str, max_users: int | None = None, lines: bool = False) -> DataFrame:
    """Nested user payloads; ``max_users`` keeps the first ones by id. A JSON array
    is one document, so large user tables should be written as lines."""
    users = spark.read.schema(USERS_SCHEMA).option("multiLine", not lines).json(path)
    return users.orderBy("user_id").limit(max_users) if max_users else users


def user_rows(users: DataFrame) -> DataFrame:
    """Long (user_id, split, pos, item_id, rating, ts) from nested payloads. Both lists are
    opened in one pass over the files."""
    lists = F.array(*[F.struct(F.lit(split).alias("split"), F.col(split).alias("_list")) for split in ("train", "test")])
    rows = users.select("user_id", F.inline(lists)).select("user_id", "split", F.posexplode("_list").alias("_p", "_r"))
    return rows.select(
        "user_id", "split", (F.col("_p") + 1).alias("pos"), F.col("_r.asin").alias("item_id"),
        F.col("_r.rating").alias("rating"), F.col("_r.time").alias("ts"),
    )


def flatten_report(spark: SparkSession, path: str) -> DataFrame:
    """Long (run, profile, method, checkpoint, f1) from a nested run report."""
    report = spark.read.schema(REPORT_SCHEMA).option("multiLine", True).json(path)
    runs = report.select(F.explode("artifacts").alias("a")).select(
        F.col("a.run_index").alias("run"), F.explode("a.profile_results").alias("p")
    )
    methods = runs.select("run", F.col("p.profile_name").alias("profile"), F.explode("p.f1").alias("method", "_m"))
    return methods.select("run", "profile", "method", F.explode("_m").alias("checkpoint", "f1")).withColumn(
        "checkpoint", F.col("checkpoint").cast("long")
    )
