"""Multi-criteria ranking, top-k, pools, set operations and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankforge.functions import profiles as pf
from rankforge.functions.hashing import hash_key
from rankforge.operators import explaining, mcdm, metrics, ordering, recommend, sampling, utility
from rankforge.operators.mcdm import CRITERIA
from rankforge.operators.ranking import full_rank, top_k
from rankforge.plans import experiment as ex
from rankforge.sources import writers
from rankforge.workload import shapes as s
from rankforge.workload import views as v
from rankforge.workload.registry import cte, query

LONG_RANK = "run, profile_idx::BIGINT AS profile_idx"


@query(
    "criteria_totals", "A7",
    "SELECT n, " + ", ".join(f"round({p}_{c}, 4) AS {p}_{c}" for c in CRITERIA for p in ("sum", "sq", "max", "min", "ent")) + " FROM item_totals",
    "item_totals",
)
def criteria_totals(spark, sf):
    return s.rounded(mcdm.column_totals(v.items(spark, sf)), 4)


@query("entropy_weights", "D1 A7", "SELECT " + ", ".join(f"round(w_{c}, 6) AS w_{c}" for c in CRITERIA) + " FROM item_weights", "item_weights")
def entropy_weights(spark, sf):
    return s.rounded(mcdm.entropy_weights(v.items(spark, sf)))


@query("entropy_weights_by_run", "D1 A7", "SELECT run::BIGINT AS run, " + ", ".join(f"round(w_{c}, 6) AS w_{c}" for c in CRITERIA) + " FROM run_weights", "run_weights")
def entropy_weights_by_run(spark, sf):
    return s.rounded(mcdm.entropy_weights(s.samples(spark, sf), by=["run"]))


@query("topsis", "D2", "SELECT item_id, round(topsis, 6) AS topsis FROM item_topsis", "item_topsis")
def topsis(spark, sf):
    return s.rounded(mcdm.topsis(v.items(spark, sf)).select("item_id", "topsis"))


@query("topsis_by_run", "D2 M8", "SELECT run::BIGINT AS run, item_id, round(topsis, 6) AS topsis FROM run_topsis", "run_topsis")
def topsis_by_run(spark, sf):
    return s.rounded(mcdm.topsis(s.samples(spark, sf), by=["run"]).select("run", "item_id", "topsis"))


@query(
    "topsis_top_by_category", "T1 D2 D1 W1",
    "SELECT category, rank, item_id, round(topsis, 6) AS topsis FROM (" + s.top_sql("item_topsis", "topsis", 7, "category") + ")", "item_topsis",
)
def topsis_top_by_category(spark, sf):
    """The flagship: sales to criteria to weights to closeness to lists."""
    ranked = mcdm.topsis(v.items(spark, sf))
    return s.rounded(top_k(ranked, "topsis", pf.TOP_K, ["category"]).select("category", "rank", "item_id", "topsis"))


@query("top_k_overall", "T1", "SELECT rank, item_id, round(topsis, 6) AS topsis FROM (" + s.top_sql("item_topsis", "topsis", 10) + ")", "item_topsis")
def top_k_overall(spark, sf):
    return s.rounded(top_k(s.item_topsis(spark, sf), "topsis", 10).select("rank", "item_id", "topsis"))


@query(
    "popularity_top_k", "T2",
    "SELECT category, rank, item_id FROM (" + s.top_sql("items", "popularity_pct", 7, "category") + ")", "items",
)
def popularity_top_k(spark, sf):
    return s.rounded(top_k(v.items(spark, sf), "popularity_pct", 7, ["category"]).select("category", "rank", "item_id"))


@query(
    "random_top_k", "T3",
    "SELECT category, rank, item_id FROM (" + s.top_sql("items", "", 7, "category", order="md5(concat_ws('|', 17, item_id)), item_id") + ")", "items",
)
def random_top_k(spark, sf):
    order = [hash_key(17, F.col("item_id")), F.col("item_id")]
    return s.rounded(top_k(v.items(spark, sf), "price", 7, ["category"], order=order).select("category", "rank", "item_id"))


cte("visited", "SELECT DISTINCT item_id FROM feedback", "feedback")


@query(
    "top_k_of_candidates", "T4",
    "SELECT profile, rank, item_id FROM (" + s.top_sql("(SELECT * FROM item_profiles WHERE item_id IN (SELECT item_id FROM visited))", "target", 7, "profile") + ")",
    "item_profiles visited",
)
def top_k_of_candidates(spark, sf):
    seen = v.feedback(spark, sf).select("item_id").distinct()
    inside = s.item_profiles(spark, sf).join(seen, "item_id", "left_semi")
    return s.rounded(top_k(inside, "target", 7, ["profile"]).select("profile", "rank", "item_id"))


@query(
    "masked_top_k", "T5 J4",
    "SELECT user_id, rank, item_id FROM (" + s.top_sql(
        "(SELECT c.user_id, i.item_id, i.topsis FROM (SELECT DISTINCT user_id, category FROM edges JOIN items USING (item_id)) c JOIN item_topsis i USING (category) WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.user_id = c.user_id AND e.item_id = i.item_id))",
        "topsis", 10, "user_id",
    ) + ")",
    "edges items item_topsis",
)
def masked_top_k(spark, sf):
    """Best unseen item lists over the categories a user has bought from."""
    items = s.item_topsis(spark, sf).select("item_id", "category", "topsis")
    likes = v.edges(spark, sf).join(items.select("item_id", "category"), "item_id")
    # k + seen of a category are enough: a list per category, then per user.
    lists = []
    for name in ("Computers", "Electronics", "HomeKitchen"):
        users = likes.filter(F.col("category") == name).select("user_id").distinct()
        best = recommend.masked_global_top_k(items.filter(F.col("category") == name), v.edges(spark, sf), users, "topsis")
        lists.append(best.select("user_id", "item_id", "topsis"))
    merged = lists[0].unionByName(lists[1]).unionByName(lists[2])
    return s.rounded(top_k(merged, "topsis", 10, ["user_id"]).select("user_id", "rank", "item_id"))


@query(
    "ordered_report", "T6 A5",
    "SELECT category, count(*) AS n, round(avg(price), 6) AS mean_price FROM items GROUP BY category ORDER BY mean_price DESC", "items",
)
def ordered_report(spark, sf):
    out = v.items(spark, sf).groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("price"), 6).alias("mean_price"))
    return out.orderBy(F.col("mean_price").desc())


@query(
    "full_rank", "W5",
    "SELECT profile, item_id, row_number() OVER (PARTITION BY profile ORDER BY round(target, 9) DESC, item_id) AS rank FROM item_profiles", "item_profiles",
)
def full_rank_query(spark, sf):
    return full_rank(s.item_profiles(spark, sf), "target", ["profile"]).select("profile", "item_id", "rank")


cte("catalog_truth", s.top_sql("item_profiles", "target", 7, "profile_idx", "profile_idx, rank, item_id"), "item_profiles")
cte("hidden30", s.top_sql("item_profiles", "hidden", 30, "profile_idx", "profile_idx, rank, item_id"), "item_profiles")


@query("candidate_pool", "U1", "SELECT item_id FROM catalog_truth UNION SELECT item_id FROM hidden30", "catalog_truth hidden30")
def candidate_pool(spark, sf):
    return utility.candidate_pool(s.item_profiles(spark, sf))


@query(
    "tracked_items", "U3",
    "SELECT run::BIGINT AS run, profile_idx::BIGINT AS profile_idx, item_id FROM (SELECT run, profile_idx, item_id FROM final_lists WHERE method = 'hybrid' UNION SELECT run, profile_idx, item_id FROM truth)",
    "final_lists truth",
)
def tracked_items(spark, sf):
    return s.rounded(tracked(spark, sf))


def tracked(spark, sf):
    mine = s.final_lists(spark, sf).filter("method = 'hybrid'").select(*ex.GROUP, "item_id")
    return mine.union(s.truth(spark, sf).select(*ex.GROUP, "item_id")).distinct()


@query(
    "list_hits", "U4",
    "SELECT f.run::BIGINT AS run, f.profile_idx::BIGINT AS profile_idx, method, f.rank, f.item_id FROM final_lists f JOIN truth t ON t.run = f.run AND t.profile_idx = f.profile_idx AND t.item_id = f.item_id",
    "final_lists truth",
)
def list_hits(spark, sf):
    return s.rounded(metrics.hits(s.final_lists(spark, sf), s.truth(spark, sf), ex.GROUP).select("run", "profile_idx", "method", "rank", "item_id"))


@query(
    "unseen_items", "U5 J4",
    "SELECT s.state::BIGINT AS state, i.item_id FROM items i CROSS JOIN (SELECT DISTINCT state FROM feedback) s WHERE NOT EXISTS (SELECT 1 FROM feedback f WHERE f.state = s.state AND f.item_id = i.item_id)",
    "items feedback",
)
def unseen_items(spark, sf):
    log = v.feedback(spark, sf)
    states = log.select("state").distinct()
    pairs = utility.with_each(v.items(spark, sf).select("item_id"), states)
    return s.rounded(pairs.join(log.select("state", "item_id").distinct(), ["state", "item_id"], "left_anti").select("state", "item_id"))


@query("run_grid", "M8", "SELECT item_id, run::BIGINT AS run, (17042 + 17 * run)::BIGINT AS seed, profile_idx::BIGINT AS profile_idx, (17042 + 17 * run + 101 + 97 * profile_idx)::BIGINT AS profile_seed FROM items CROSS JOIN range(5) g(run) CROSS JOIN profiles", "items profiles")
def run_grid(spark, sf):
    grid = utility.with_profiles(utility.with_runs(v.items(spark, sf).select("item_id"), 5), v.FIXTURE_PROFILES)
    return s.rounded(
        grid.select("item_id", "run", "seed", "profile_idx", pf.profile_seed(F.col("seed"), F.col("profile_idx")).alias("profile_seed"))
    )


SAMPLE_COLS = "run::BIGINT AS run, seed::BIGINT AS seed, item_id, octant::BIGINT AS octant, " + ", ".join(
    f"round({c}, 9) AS {c}" for c in pf.FEATURES
)


@query("stratified_sample", "M1 W8 W1 M8", f"SELECT {SAMPLE_COLS} FROM samples", "samples")
def stratified_sample(spark, sf):
    drawn = sampling.stratified_sample(v.items(spark, sf), None, s.SAMPLE, s.N_RUNS)
    return s.rounded(drawn.select("run", "seed", "item_id", "octant", *pf.FEATURES), 9)


@query("row_sample", "M7", "SELECT item_id, price FROM (SELECT * FROM items ORDER BY md5(concat_ws('|', 42, item_id)), item_id LIMIT 100)", "items")
def row_sample(spark, sf):
    return sampling.row_sample(v.items(spark, sf), 100, 42, ["item_id"]).select("item_id", "price")


@query(
    "train_test_split", "M6",
    "SELECT item_id, ('0x' || substring(md5(concat_ws('|', 42, item_id)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < 0.25 AS is_test FROM items", "items",
)
def train_test_split(spark, sf):
    return sampling.train_test(v.items(spark, sf), 42, ["item_id"]).select("item_id", "is_test")


@query(
    "leave_one_out", "M2",
    "SELECT user_id, item_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY md5(concat_ws('|', 42, user_id, item_id)), item_id) = 1 THEN 'test' ELSE 'train' END AS split FROM edges",
    "edges",
)
def leave_one_out(spark, sf):
    return sampling.leave_one_out(v.edges(spark, sf), 42)


@query("run_manifest", "S10", "SELECT run::BIGINT AS run, count(*) AS n_rows, count(DISTINCT item_id) AS n_items FROM samples GROUP BY run", "samples")
def run_manifest(spark, sf):
    # The fingerprint is an engine hash; rows and items are comparable.
    return s.rounded(writers.manifest(s.samples(spark, sf)).select("run", "n_rows", "n_items"))


MANIFEST = ("run", "seed", "item_id", "brand", "category", "price", "rating_count")
_SHOWN = ", ".join(f"coalesce(({f'round({c} * 1e6)::BIGINT' if c in ('price', 'rating_count') else c})::VARCHAR, '~')" for c in MANIFEST)
_WORDS = " || ".join(f"format('{{:08x}}', (sum(('0x' || substring(h, {8 * i + 1}, 8))::BIGINT) % 4294967296)::BIGINT)" for i in range(writers.WORDS))


@query(
    "run_manifest_fingerprint", "S10",
    f"SELECT run::BIGINT AS run, max(seed)::BIGINT AS seed, count(*) AS n_rows, count(DISTINCT item_id) AS n_items, {_WORDS} AS fingerprint FROM (SELECT *, md5(concat_ws('|', {_SHOWN})) AS h FROM samples) GROUP BY run",
    "samples",
)
def run_manifest_fingerprint(spark, sf):
    """The manifest of the first runs, and of the others added to it."""
    rows = s.samples(spark, sf)
    parts = [writers.manifest_parts(rows.filter(cut), columns=MANIFEST) for cut in ("run < 2", "run >= 2")]
    return s.rounded(writers.with_fingerprint(writers.merge_manifests(*parts)))


@query(
    "item_position", "W5",
    "SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx, count(*) OVER () AS n_items FROM items", "items",
)
def item_position(spark, sf):
    return sampling.item_index(v.items(spark, sf))


@query(
    "criterion_labels", "P21",
    "SELECT item_id, CASE greatest(a, b, c, d) WHEN a THEN 'Price' WHEN b THEN 'Quality' WHEN c THEN 'Popularity' ELSE 'Rating' END AS label "
    "FROM (SELECT item_id, round(price_pct * w_price_pct, 9) AS a, round(quality_pct * w_quality_pct, 9) AS b, round(popularity_pct * w_popularity_pct, 9) AS c, round(rating_pct * w_rating_pct, 9) AS d FROM item_topsis)",
    "item_topsis",
)
def criterion_labels(spark, sf):
    frame = s.item_topsis(spark, sf)
    return frame.select("item_id", explaining.criterion_label().alias("label"))


@query(
    "behavior_labels", "P22",
    "SELECT item_id, profile, CASE greatest(brand_score, price_fit, 1, recency_score) WHEN brand_score THEN brand WHEN price_fit THEN 'PriceRange' WHEN 1 THEN category ELSE 'Recency' END AS label FROM item_profiles",
    "item_profiles",
)
def behavior_labels(spark, sf):
    frame = utility.hidden_components(s.item_profiles(spark, sf))
    return frame.select("item_id", "profile", explaining.behavior_label().alias("label"))


@query(
    "attribution_text", "P23",
    """SELECT item_id, string_agg(printf('%s=%+.4f', name, val), '; ' ORDER BY abs(val) DESC, i) AS txt FROM (
SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY abs(val) DESC, i) AS r FROM (
SELECT item_id, unnest([0, 1, 2, 3, 4]) AS i, unnest(['price', 'quality', 'popularity', 'rating', 'recency']) AS name,
  unnest([(price_pct - 0.5) * 0.777, (quality_pct - 0.5) * 0.777, (popularity_pct - 0.5) * 0.777, (rating_pct - 0.5) * 0.777, (recency_pct - 0.5) * 0.777]) AS val FROM items)) WHERE r <= 3 GROUP BY item_id""",
    "items",
)
def attribution_text(spark, sf):
    from rankforge.functions.scalars import attribution_text as render

    return v.items(spark, sf).select(
        "item_id",
        render([c[:-4] for c in pf.FEATURES], [(F.col(c) - 0.5) * 0.777 for c in pf.FEATURES], 3).alias("txt"),
    )


@query("running_totals", "W1", "SELECT l_suppkey, l_partkey, n, before, total FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY l_suppkey ORDER BY l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, sum(n) OVER (PARTITION BY l_suppkey)::BIGINT AS total FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_partkey))")
def running_totals(spark, sf):
    counts = v.table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return ordering.running_totals(counts, ["l_suppkey"], ["l_partkey"], "n").select("l_suppkey", "l_partkey", "n", "before", "total")
