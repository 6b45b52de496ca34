"""Views over the given tables that stand in for catalog, log and profile inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.functions.profiles import PROFILES, rescale_prices
from rankforge.operators import interactions as ix
from rankforge.operators.catalog import enrich
from rankforge.operators.ordering import ordered_position
from rankforge.workload.registry import cte, shared

MIN_ITEMS = 15
MAX_USERS = 1000  # of the capped selections F3 and S11 alone
TEST_K = 7
LINES_PER_TASK = 500_000
# The reference profiles speak of prices 10..1000; the parts cost 900..1000.
FIXTURE_PROFILES = rescale_prices(PROFILES, (10.0, 1000.0), (900.0, 1000.0))
# Category paths for the six part types.
PATHS = {
    "STANDARD": "Computers&Accessories|Standard",
    "ECONOMY": "OfficeProducts|Economy",
    "MEDIUM": "Home&Kitchen|Medium|Pan",
    "PROMO": "HomeImprovement|Promo",
    "LARGE": "Electronics|Large",
    "SMALL": "Toys&Games|Small",
}
COARSE = {
    "STANDARD": "Computers", "ECONOMY": "Computers",
    "MEDIUM": "HomeKitchen", "PROMO": "HomeKitchen",
    "LARGE": "Electronics", "SMALL": "Electronics",
}


def draws_sql(asks: str, seen: str, numbered: str, k: int, seed: int) -> str:
    """(user_id, request, item_id, draw_rank): the first k unseen items of each request's keyed
    permutation, which lie within k + seen + spare places."""
    def key(i: int) -> str:
        return f"('0x' || substring(h, {8 * i + 1}, 8))::BIGINT % 2147483647"

    def moved(k: str, x: str) -> str:
        t = f"(({x} + {k}) % 2147483647)"
        return f"(({t} * {t} % 2147483647 * 48271 + {k}) % 2147483647)"

    return f"""WITH size AS (SELECT n, a, ceil(n / a)::BIGINT AS b FROM (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM {numbered})),
q AS (SELECT q.user_id, q.request, a, b, least(a * b, {k} + coalesce(n_seen, 0) + a * b - n) AS w, md5(concat_ws('|', {seed}, q.user_id, q.request)) AS h
  FROM {asks} q CROSS JOIN size LEFT JOIN (SELECT user_id, count(DISTINCT item_id) AS n_seen FROM {seen} GROUP BY user_id) c ON c.user_id = q.user_id),
p0 AS (SELECT user_id, request, a, b, {key(0)} AS k0, {key(1)} AS k1, {key(2)} AS k2, {key(3)} AS k3, unnest(range(w)) AS place FROM q),
p1 AS (SELECT *, (place // b + {moved('k0', '(place % b)')}) % a AS r1, place % b AS c0 FROM p0),
p2 AS (SELECT *, (c0 + {moved('k1', 'r1')}) % b AS c1 FROM p1),
p3 AS (SELECT *, (r1 + {moved('k2', 'c1')}) % a AS r2 FROM p2),
p4 AS (SELECT user_id, request, place, r2 * b + (c1 + {moved('k3', 'r2')}) % b AS idx FROM p3),
f AS (SELECT p4.user_id, p4.request, i.item_id, place FROM p4 JOIN {numbered} i ON i.idx = p4.idx
  WHERE NOT EXISTS (SELECT 1 FROM {seen} s WHERE s.user_id = p4.user_id AND s.item_id = i.item_id))
SELECT user_id, request, item_id, draw_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, request ORDER BY place) AS draw_rank FROM f) WHERE draw_rank <= {k}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(column: str, values: dict[str, str]):
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(F.col(column) == k, F.lit(v)).otherwise(out)
    return out


def _sql_case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def line_tasks(lines: DataFrame) -> int:
    """Tasks that the order lines are dealt to: more lines give more tasks, so what one of
    them sorts or aggregates stays the same."""
    return max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // LINES_PER_TASK))


def order_lines(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    tasks = line_tasks(lines)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.repartition(tasks, "l_orderkey").join(orders.repartition(tasks, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))


def sales_by_part(spark, sf_dir) -> DataFrame:
    """Per part: order lines, buyers, mean discount, kept share, last shipment."""
    lines = order_lines(spark, sf_dir).select("l_partkey", "o_custkey", "l_discount", "l_returnflag", "l_shipdate")
    # Buyers are told apart in tasks of bounded size; a part's sums meet after that.
    dealt = lines.repartition(line_tasks(table(spark, sf_dir, "lineitem")), "l_partkey", "o_custkey")
    return dealt.groupBy(F.col("l_partkey").alias("item_id")).agg(
        F.count("*").cast("double").alias("rating_count"),
        F.countDistinct("o_custkey").alias("inferred_reviewer_count"),
        F.round(100 * F.avg("l_discount"), 6).alias("discount_pct"),
        F.round(1 + 4 * F.avg((F.col("l_returnflag") != "R").cast("double")), 6).alias("rating"),
        F.unix_timestamp(F.max("l_shipdate")).alias("last_time"),
        F.min("o_custkey").alias("first_buyer"),
        F.max("o_custkey").alias("last_buyer"),
    )


@shared
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part that was ever ordered."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category_raw"),
        _case("p_type", COARSE).alias("category"),
        F.col("p_brand").alias("brand_label"),
        F.col("p_retailprice").alias("price"),
        (F.length("p_name") + F.col("p_size")).cast("double").alias("review_text_richness"),
    ).join(sales_by_part(spark, sf_dir), "item_id")


@shared
def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched catalog."""
    return enrich(catalog(spark, sf_dir), "item_id")


def raw_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog written the way shops export it: prices with a symbol and
    commas, percent signs, a junk rating, and two listings of some products."""
    c = F.col
    base = catalog(spark, sf_dir).select(
        F.format_string("P%d", c("item_id")).alias("product_id"),
        F.concat(c("product_name"), F.lit(", "), c("brand_label")).alias("product_name"),
        _case("category_raw", PATHS).alias("category"),
        F.concat(F.lit("₹"), F.format_number(c("price") * 10, 2)).alias("discounted_price"),
        F.concat(F.lit("₹"), F.format_number(c("price") * 12, 2)).alias("actual_price"),
        F.concat(F.round(c("discount_pct") * 12).cast("long").cast("string"), F.lit("%")).alias(
            "discount_percentage"
        ),
        F.when(c("rating") >= 4.9, F.lit("|"))
        .otherwise(F.concat(F.lit(" "), F.format_number(c("rating"), 1)))
        .alias("rating"),
        F.format_number(c("rating_count") * 1000, 0).alias("rating_count"),
        F.concat_ws(
            ",",
            c("first_buyer").cast("string"),
            F.lit(" "),
            F.when(c("last_buyer") > c("inferred_reviewer_count") * 40, c("last_buyer").cast("string")),
        ).alias("user_id"),
        c("product_name").alias("review_title"),
        F.when(c("discount_pct") >= 5, c("category_raw")).alias("review_content"),
        c("brand_label").alias("about_product"),
    )
    relisted = base.filter(F.col("category").startswith("Home")).withColumn(
        "rating_count", F.lit("1,0")
    )
    return base.unionByName(relisted)


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_lines(spark, sf_dir).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        F.unix_timestamp("o_orderdate").alias("ts"),
        (1.0 + F.floor((F.col("l_quantity") - 1) / 10)).alias("rating"),
    )


@shared
def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct liked (user, item) pairs."""
    return (
        interactions(spark, sf_dir)
        .filter(F.col("rating") >= ix.MIN_RATING)
        .select("user_id", "item_id")
        .distinct()
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item metadata; size 7 stands for a missing sales rank."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_retailprice").alias("price"),
        F.nullif(F.col("p_size"), F.lit(7)).cast("double").alias("sales_rank"),
        F.col("p_type").alias("cat_lvl2"),
        F.col("p_brand").alias("cat_leaf"),
    ).filter(F.col("sales_rank").isNotNull())


@shared
def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = ix.positive_reviews(interactions(spark, sf_dir), metadata(spark, sf_dir))
    return ix.unique_sequences(reviews)


@shared
def selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of all eligible users with their split."""
    return ix.split_last_k(
        ix.select_sequences(sequences(spark, sf_dir), metadata(spark, sf_dir), None, MIN_ITEMS),
        TEST_K,
    )


@shared
def external_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.item_table(metadata(spark, sf_dir), selected(spark, sf_dir), TEST_K)


def train_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = selected(spark, sf_dir).filter("split = 'train'").select("user_id", "item_id", "ts", "pos")
    return train.join(external_items(spark, sf_dir), "item_id")


@shared
def learned_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.user_profiles(train_items(spark, sf_dir))


@shared
def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged reactions, numbered per state in event order."""
    events = table(spark, sf_dir, "events").filter(
        F.col("event_type").isin("view", "click", "purchase")
    )
    log = events.select(
        (F.col("user_id") % 5).cast("int").alias("state"),
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        "ts",
        "event_id",
        F.col("event_type").isin("click", "purchase").alias("engaged"),
        (F.col("event_type") == "purchase").alias("converted"),
    )
    return ordered_position(log, ["state"], ["ts", "event_id"], "event_no", "n_events").drop("n_events")


# SQL counterparts -------------------------------------------------------------

def pct_sql(column: str, group: str = "", invert: bool = False) -> str:
    part = f"PARTITION BY {group}" if group else ""
    peers = f"{group}, {column}" if group else column
    out = (
        f"((rank() OVER ({part} ORDER BY {column}) + (count({column}) OVER (PARTITION BY {peers}) - 1) / 2)"
        f" / count({column}) OVER ({part}))"
    )
    return f"(1 - {out})" if invert else out


cte("order_lines", "SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
cte(
    "catalog",
    f"""SELECT p_partkey AS item_id, any_value(p_name) AS product_name, any_value(p_type) AS category_raw,
  any_value({_sql_case('p_type', COARSE)}) AS category, any_value(p_brand) AS brand_label,
  any_value(p_retailprice) AS price, any_value(length(p_name) + p_size)::DOUBLE AS review_text_richness,
  count(*)::DOUBLE AS rating_count, count(DISTINCT o_custkey) AS inferred_reviewer_count,
  round(100 * avg(l_discount), 6) AS discount_pct,
  round(1 + 4 * avg(CASE WHEN l_returnflag <> 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS rating,
  epoch(max(l_shipdate))::BIGINT AS last_time, min(o_custkey) AS first_buyer, max(o_custkey) AS last_buyer
FROM part JOIN order_lines ON p_partkey = l_partkey GROUP BY p_partkey""",
    "order_lines",
)
COMPOSED_SQL = f"""SELECT * EXCLUDE (price_rank, count_rank, richness_rank, reviewer_rank, discount_rank),
  round(100.0::DOUBLE * (0.7::DOUBLE * ((rating - 1.0::DOUBLE) / 4.0::DOUBLE) + 0.2::DOUBLE * count_rank + 0.1::DOUBLE * richness_rank), 9) AS quality,
  round(100.0::DOUBLE * count_rank, 9) AS popularity,
  round(100.0::DOUBLE * (0.65::DOUBLE * reviewer_rank + 0.35::DOUBLE * discount_rank), 9) AS recency,
  CASE WHEN price_rank <= 1::DOUBLE / 3 THEN 'budget_brand' WHEN price_rank >= 2::DOUBLE / 3 THEN 'premium_brand' ELSE 'mid_brand' END AS brand,
  1 - price_rank AS price_pct, count_rank AS popularity_pct
FROM (SELECT *, {pct_sql('price')} AS price_rank, {pct_sql('rating_count')} AS count_rank,
  {pct_sql('review_text_richness')} AS richness_rank, {pct_sql('inferred_reviewer_count')} AS reviewer_rank,
  {pct_sql('discount_pct')} AS discount_rank, {pct_sql('rating')} AS rating_pct FROM {{source}})"""
cte("composed", COMPOSED_SQL.format(source="catalog"), "catalog")
cte(
    "items",
    f"SELECT *, {pct_sql('quality')} AS quality_pct, {pct_sql('recency')} AS recency_pct FROM composed",
    "composed",
)
cte(
    "raw_base",
    f"""SELECT 'P' || item_id AS product_id, product_name || ', ' || brand_label AS product_name,
  {_sql_case('category_raw', PATHS)} AS category,
  '₹' || format('{{:,.2f}}', price * 10) AS discounted_price, '₹' || format('{{:,.2f}}', price * 12) AS actual_price,
  round(discount_pct * 12)::BIGINT || '%' AS discount_percentage,
  CASE WHEN rating >= 4.9 THEN '|' ELSE ' ' || format('{{:,.1f}}', rating) END AS rating,
  format('{{:,.0f}}', rating_count * 1000) AS rating_count,
  concat_ws(',', first_buyer::VARCHAR, ' ', CASE WHEN last_buyer > inferred_reviewer_count * 40 THEN last_buyer::VARCHAR END) AS user_id,
  product_name AS review_title, CASE WHEN discount_pct >= 5 THEN category_raw END AS review_content,
  brand_label AS about_product FROM catalog""",
    "catalog",
)
cte(
    "raw_catalog",
    "SELECT * FROM raw_base UNION ALL SELECT * REPLACE ('1,0' AS rating_count) FROM raw_base WHERE category LIKE 'Home%'",
    "raw_base",
)
cte(
    "interactions",
    "SELECT o_custkey AS user_id, l_partkey AS item_id, epoch(o_orderdate)::BIGINT AS ts, 1 + floor((l_quantity - 1) / 10) AS rating FROM order_lines",
    "order_lines",
)
cte("edges", "SELECT DISTINCT user_id, item_id FROM interactions WHERE rating >= 4", "interactions")
cte(
    "metadata",
    "SELECT p_partkey AS item_id, p_retailprice AS price, p_size::DOUBLE AS sales_rank, p_type AS cat_lvl2, p_brand AS cat_leaf FROM part WHERE p_size <> 7",
)
cte(
    "reviews",
    "SELECT user_id, item_id, rating, ts FROM interactions WHERE rating >= 4 AND item_id IN (SELECT item_id FROM metadata)",
    "interactions", "metadata",
)
cte(
    "sequences",
    """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n
FROM (SELECT user_id, item_id, rating, ts FROM reviews QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts, rating) = 1)""",
    "reviews",
)
cte(
    "ranked_users",
    f"""SELECT user_id, n_items, row_number() OVER (ORDER BY n_items DESC, user_id) AS selected
FROM (SELECT user_id, count(*) AS n_items FROM sequences GROUP BY user_id HAVING count(*) >= {MIN_ITEMS})""",
    "sequences",
)
cte("busiest", f"SELECT * FROM ranked_users WHERE selected <= {MAX_USERS}", "ranked_users")
cte(
    "selected_users",
    f"""SELECT s.*, CASE WHEN pos > n - {TEST_K} THEN 'test' ELSE 'train' END AS split FROM (
SELECT q.user_id, q.item_id, q.rating, q.ts, b.selected,
  row_number() OVER (PARTITION BY q.user_id ORDER BY q.ts, q.item_id) AS pos, count(*) OVER (PARTITION BY q.user_id) AS n
FROM sequences q JOIN ranked_users b USING (user_id) WHERE q.item_id IN (SELECT item_id FROM metadata)) s WHERE n >= {MIN_ITEMS}""",
    "sequences", "ranked_users", "metadata",
)
cte(
    "item_stats",
    """SELECT item_id, count(*) AS popularity, avg(rating) AS rating_mean, max(ts) AS last_train_time
FROM selected_users WHERE split = 'train' GROUP BY item_id""",
    "selected_users",
)
cte(
    "filled",
    """SELECT m.*, coalesce(s.popularity, 0)::DOUBLE AS popularity,
  coalesce(s.rating_mean, (SELECT median(rating_mean) FROM item_stats), 3.5) AS rating_mean,
  coalesce(s.last_train_time, (SELECT min(last_train_time) FROM item_stats), 0)::DOUBLE AS last_train_time
FROM metadata m LEFT JOIN item_stats s USING (item_id) WHERE m.item_id IN (SELECT item_id FROM selected_users)""",
    "metadata", "item_stats", "selected_users",
)
cte(
    "external_items",
    f"""SELECT *, {pct_sql('price', invert=True)} AS price_pct, {pct_sql('sales_rank', invert=True)} AS quality_pct,
  {pct_sql('popularity')} AS popularity_pct, {pct_sql('rating_mean')} AS rating_pct, {pct_sql('last_train_time')} AS recency_pct FROM filled""",
    "filled",
)
cte(
    "train_items",
    "SELECT s.user_id, s.ts, s.pos, e.* FROM selected_users s JOIN external_items e USING (item_id) WHERE s.split = 'train'",
    "selected_users", "external_items",
)
cte(
    "feedback",
    """SELECT (user_id % 5)::INTEGER AS state, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, ts, event_id,
  event_type IN ('click', 'purchase') AS engaged, event_type = 'purchase' AS converted,
  row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS event_no
FROM events WHERE event_type IN ('view', 'click', 'purchase')""",
)
cte(
    "profiles",
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"({p.index}, '{p.name}', {p.price_range[0]!r}::DOUBLE, {p.price_range[1]!r}::DOUBLE, {p.recency_weight}::DOUBLE)"
        for p in FIXTURE_PROFILES
    )
    + ") t(profile_idx, profile, price_lo, price_hi, recency_weight)",
)
cte(
    "profile_brand",
    "SELECT * FROM (VALUES "
    + ", ".join(f"({p.index}, '{b}', {w}::DOUBLE)" for p in FIXTURE_PROFILES for b, w in p.brand_pref.items())
    + ") t(profile_idx, brand, w)",
)
cte(
    "profile_cat",
    "SELECT * FROM (VALUES "
    + ", ".join(f"({p.index}, '{b}', {w}::DOUBLE)" for p in FIXTURE_PROFILES for b, w in p.cat_affinity.items())
    + ") t(profile_idx, category, w)",
)
