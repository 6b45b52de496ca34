"""Recommender queries on liked edges with one held-out item per user."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankforge.functions.profiles import FEATURES, LIST_K
from rankforge.operators import interactions as ix
from rankforge.operators import inner_product, metrics, recommend, sampling
from rankforge.operators.neighbours import unseen_sums
from rankforge.operators.ranking import top_k
from rankforge.workload import shapes as s
from rankforge.workload import views as v
from rankforge.workload.registry import cte, query, shared

MIN_EDGES = 3
K = LIST_K
DIM = 64

cte(
    "loo",
    f"""SELECT user_id, item_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY md5(concat_ws('|', 42, user_id, item_id)), item_id) = 1 THEN 'test' ELSE 'train' END AS split
FROM edges WHERE user_id IN (SELECT user_id FROM edges GROUP BY user_id HAVING count(*) >= {MIN_EDGES})""",
    "edges",
)
cte("tr", "SELECT user_id, item_id FROM loo WHERE split = 'train'", "loo")
cte("te", "SELECT user_id, item_id FROM loo WHERE split = 'test'", "loo")


@shared
def loo(spark, sf):
    return sampling.leave_one_out(ix.eligible(v.edges(spark, sf), MIN_EDGES), 42)


@shared
def train(spark, sf):
    return loo(spark, sf).filter("split = 'train'").select("user_id", "item_id")


def test(spark, sf):
    return loo(spark, sf).filter("split = 'test'").select("user_id", "item_id")


@shared
def pairs(spark, sf):
    return recommend.co_occurrence(train(spark, sf))


def user_top(source: str, score: str = "score", order: str | None = None) -> str:
    return "SELECT user_id, rank, item_id FROM (" + s.top_sql(source, score, K, "user_id", order=order) + ")"


def out(df):
    return s.rounded(df.select("user_id", "rank", "item_id"))


cte("numbered", "SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM items", "items")
cte("random_asks", "SELECT DISTINCT user_id, 0 AS request FROM tr", "tr")
cte("random_lists", f"SELECT user_id, draw_rank AS rank, item_id FROM ({v.draws_sql('random_asks', 'tr', 'numbered', K, 9042)})", "random_asks", "tr", "numbered")


@shared
def random_lists(spark, sf):
    seen = train(spark, sf)
    asks = seen.select("user_id").distinct().withColumn("request", F.lit(0).cast("long"))
    drawn = sampling.draw_unseen(asks, seen, sampling.item_index(v.items(spark, sf)), K, 9042)
    return drawn.select("user_id", F.col("draw_rank").cast("long").alias("rank"), "item_id")


@query("random_recommender", "R1 T3 T5", "SELECT user_id, rank, item_id FROM random_lists", "random_lists")
def random_recommender(spark, sf):
    return out(random_lists.__wrapped__(spark, sf))


def global_sql(scores: str, score: str, seen: str = "tr") -> str:
    return user_top(
        f"(SELECT u.user_id, p.item_id, p.{score} AS score FROM (SELECT DISTINCT user_id FROM {seen}) u CROSS JOIN {scores} p WHERE NOT EXISTS (SELECT 1 FROM {seen} s WHERE s.user_id = u.user_id AND s.item_id = p.item_id))"
    )


cte("train_popularity", "SELECT item_id, count(DISTINCT user_id) AS popularity FROM tr GROUP BY item_id", "tr")
cte("popularity_lists", global_sql("train_popularity", "popularity"), "tr", "train_popularity")
cte("topsis_lists", global_sql("item_topsis", "topsis"), "tr", "item_topsis")


def popularity_lists(spark, sf):
    seen = train(spark, sf)
    return recommend.masked_global_top_k(ix.popularity(seen), seen, seen, "popularity", K)


@query("popularity_recommender", "R2 A16 J4 T5", "SELECT user_id, rank, item_id FROM popularity_lists", "popularity_lists")
def popularity_recommender(spark, sf):
    return out(popularity_lists(spark, sf))


def topsis_lists(spark, sf):
    seen = train(spark, sf)
    return recommend.masked_global_top_k(s.item_topsis(spark, sf), seen, seen, "topsis", K)


@query("topsis_recommender", "R3 J4 T5", "SELECT user_id, rank, item_id FROM topsis_lists", "topsis_lists")
def topsis_recommender(spark, sf):
    return out(topsis_lists(spark, sf))


UNIT = [f"{c} / nrm AS x{i}" for i, c in enumerate(FEATURES)]
cte(
    "unit",
    f"SELECT item_id, {', '.join(UNIT)} FROM (SELECT *, sqrt({' + '.join(f'{c} * {c}' for c in FEATURES)}) AS nrm FROM items)", "items",
)
cte("centroid", f"SELECT user_id, {', '.join(f'avg(x{i}) AS m{i}' for i in range(5))} FROM tr JOIN unit USING (item_id) GROUP BY user_id", "tr", "unit")
DOT = " + ".join(f"m{i} * x{i}" for i in range(5))
NORM = "sqrt(" + " + ".join(f"m{i} * m{i}" for i in range(5)) + ")"
cte(
    "content_lists",
    user_top(f"(SELECT c.user_id, u.item_id, ({DOT}) / {NORM} AS score FROM centroid c CROSS JOIN unit u WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.user_id = c.user_id AND tr.item_id = u.item_id))"),
    "centroid", "unit", "tr",
)


@shared
def content_lists(spark, sf):
    return recommend.content_top_k(train(spark, sf), v.items(spark, sf), K)


@query("content_recommender", "R4 P18", "SELECT user_id, rank, item_id FROM content_lists", "content_lists")
def content_recommender(spark, sf):
    return out(recommend.content_top_k(train(spark, sf), v.items(spark, sf), K))


cte("du", "SELECT user_id, count(*) AS nu FROM tr GROUP BY user_id", "tr")
cte("di", "SELECT item_id, count(*) AS ni FROM tr GROUP BY item_id", "tr")
cte(
    "co_counts",
    "SELECT a.item_id AS a, b.item_id AS b, count(*) AS n_shared, sum(1 / sqrt(nu::DOUBLE)) AS w_shared FROM tr a JOIN tr b ON a.user_id = b.user_id AND a.item_id < b.item_id JOIN du ON du.user_id = a.user_id GROUP BY a.item_id, b.item_id",
    "tr", "du",
)


@query("co_occurrence", "J7", "SELECT a, b, n_shared, round(w_shared, 6) AS w_shared FROM co_counts", "co_counts")
def co_occurrence(spark, sf):
    return s.rounded(recommend.co_occurrence(train(spark, sf)))


cte(
    "item_sims",
    """SELECT a, b, n_shared / sqrt((x.ni * y.ni)::DOUBLE) AS sim FROM (SELECT a, b, n_shared FROM co_counts UNION ALL SELECT b AS a, a AS b, n_shared FROM co_counts) c
JOIN di x ON x.item_id = a JOIN di y ON y.item_id = b""",
    "co_counts", "di",
)


@query("item_similarity", "R5 J7", "SELECT a AS item_id, b AS other, round(sim, 6) AS sim FROM item_sims", "item_sims")
def item_similarity(spark, sf):
    return s.rounded(recommend.item_similarity(train(spark, sf), pairs(spark, sf)))


cte(
    "item_knn_scores",
    "SELECT * FROM (SELECT user_id, b AS item_id, sum(sim) AS score FROM tr JOIN item_sims ON a = item_id GROUP BY user_id, b) k WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.user_id = k.user_id AND tr.item_id = k.item_id)",
    "tr", "item_sims",
)
cte("item_knn_lists", user_top("item_knn_scores"), "item_knn_scores")
cte(
    "user_sims",
    "SELECT a.user_id AS u, b.user_id AS v, count(*) / (sqrt(x.nu::DOUBLE) * sqrt(y.nu::DOUBLE)) AS sim FROM tr a JOIN tr b ON a.item_id = b.item_id AND a.user_id <> b.user_id JOIN du x ON x.user_id = a.user_id JOIN du y ON y.user_id = b.user_id GROUP BY a.user_id, b.user_id, x.nu, y.nu",
    "tr", "du",
)
cte(
    "user_knn_lists",
    user_top("(SELECT * FROM (SELECT u AS user_id, item_id, sum(sim) AS score FROM user_sims JOIN tr ON tr.user_id = v GROUP BY u, item_id) k WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.user_id = k.user_id AND tr.item_id = k.item_id))"),
    "user_sims", "tr",
)


@shared
def item_knn_lists(spark, sf):
    return recommend.neighbour_top_k(train(spark, sf), "item", K, pairs(spark, sf))


@shared
def user_knn_lists(spark, sf):
    return recommend.neighbour_top_k(train(spark, sf), "user", K, pairs(spark, sf))


@query("item_knn_recommender", "R5 J7 T5", "SELECT user_id, rank, item_id FROM item_knn_lists", "item_knn_lists")
def item_knn_recommender(spark, sf):
    return out(item_knn_lists.__wrapped__(spark, sf))


@query("user_knn_recommender", "R6 J7 T5", "SELECT user_id, rank, item_id FROM user_knn_lists", "user_knn_lists")
def user_knn_recommender(spark, sf):
    return out(user_knn_lists.__wrapped__(spark, sf))


@shared
def factor_lists(spark, sf):
    seen = train(spark, sf)
    return recommend.factor_top_k(recommend.implicit_factors(seen), seen, K)


@query("factor_recommender", "R7")
def factor_recommender(spark, sf):
    return out(factor_lists(spark, sf))


cte(
    "bipartite",
    """SELECT 'u' || tr.user_id AS src, 'i' || tr.item_id AS dst, nu AS src_degree, 1 / sqrt((nu * ni)::DOUBLE) AS weight FROM tr JOIN du USING (user_id) JOIN di USING (item_id)
UNION ALL SELECT 'i' || tr.item_id AS src, 'u' || tr.user_id AS dst, ni AS src_degree, 1 / sqrt((nu * ni)::DOUBLE) AS weight FROM tr JOIN du USING (user_id) JOIN di USING (item_id)""",
    "tr", "du", "di",
)


@query("bipartite_edges", "R8", "SELECT src, dst, src_degree, round(weight, 6) AS weight FROM bipartite", "bipartite")
def bipartite_edges(spark, sf):
    return s.rounded(recommend.bipartite_edges(train(spark, sf)))


def node_vectors(spark, sf):
    """Vectors of the embedding table, dealt to users and items by id."""
    vectors = v.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    size = vectors.agg(F.count("*").alias("n"))
    seen = train(spark, sf)
    from rankforge.operators.ordering import attach

    def side(column, letter):
        ids = attach(seen.select(F.col(column).alias("id")).distinct(), size)
        return ids.select(F.concat(F.lit(letter), F.col("id").cast("string")).alias("node"), (F.col("id") % F.col("n")).alias("vec_id"))

    nodes = side("user_id", "u").unionByName(side("item_id", "i"))
    return nodes.join(vectors, "vec_id").select("node", "x")


@shared
def propagated(spark, sf):
    return recommend.propagate(recommend.bipartite_edges(train(spark, sf)), node_vectors(spark, sf), DIM, 2)


cte(
    "node_vectors",
    """SELECT node, dim, list_extract(embedding, dim)::DOUBLE AS x FROM (SELECT 'u' || user_id AS node, user_id % (SELECT count(*) FROM embeddings) AS vec_id FROM du
UNION ALL SELECT 'i' || item_id AS node, item_id % (SELECT count(*) FROM embeddings) AS vec_id FROM di) JOIN embeddings USING (vec_id) CROSS JOIN range(1, 65) d(dim)""",
    "du", "di",
)
cte("layer1", "SELECT dst AS node, dim, sum(weight * x) AS x FROM bipartite JOIN node_vectors ON node = src GROUP BY dst, dim", "bipartite", "node_vectors")
cte("layer2", "SELECT dst AS node, dim, sum(weight * x) AS x FROM bipartite JOIN layer1 ON node = src GROUP BY dst, dim", "bipartite", "layer1")
cte(
    "propagated",
    "SELECT node, list(x ORDER BY dim) AS x FROM (SELECT node, dim, sum(x) / 3 AS x FROM (SELECT * FROM node_vectors UNION ALL SELECT * FROM layer1 UNION ALL SELECT * FROM layer2) GROUP BY node, dim) GROUP BY node",
    "node_vectors", "layer1", "layer2",
)


@query("graph_propagation", "R9 R8", "SELECT node, list_transform(x, lambda e: round(e, 6) + 0.0) AS x FROM propagated", "propagated")
def graph_propagation(spark, sf):
    final = recommend.propagate(recommend.bipartite_edges(train(spark, sf)), node_vectors(spark, sf), DIM, 2)
    return final.select("node", F.transform("x", lambda e: F.round(e, 6) + 0.0).alias("x"))


cte(
    "dot_lists",
    user_top("""(SELECT u.user_id, t.item_id, list_dot_product(u.x, t.x) AS score FROM (SELECT user_id, x FROM du JOIN propagated ON node = 'u' || user_id) u
CROSS JOIN (SELECT item_id, x FROM di JOIN propagated ON node = 'i' || item_id) t WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.user_id = u.user_id AND tr.item_id = t.item_id))"""),
    "propagated", "du", "di", "tr",
)


def dot_lists(spark, sf):
    vectors = propagated(spark, sf)
    pick = lambda letter, name: vectors.filter(F.col("node").startswith(letter)).select(
        F.substring("node", 2, 40).cast("long").alias(name), "x"
    )
    return inner_product.largest_inner_products(pick("u", "user_id"), pick("i", "item_id"), train(spark, sf), K, DIM)


@query("dot_product_recommender", "R10 R9 J6", "SELECT user_id, rank, item_id FROM dot_lists", "dot_lists")
def dot_product_recommender(spark, sf):
    return out(dot_lists(spark, sf))


MODELS = ("random", "popularity", "topsis", "content", "item_knn", "user_knn")
cte(
    "model_lists",
    " UNION ALL ".join(f"SELECT '{m}' AS model, user_id, rank, item_id FROM {m}_lists" for m in MODELS),
    *[f"{m}_lists" for m in MODELS],
)


@shared
def model_lists(spark, sf):
    parts = {
        "random": random_lists(spark, sf), "popularity": popularity_lists(spark, sf), "topsis": topsis_lists(spark, sf),
        "content": content_lists(spark, sf),
        "item_knn": item_knn_lists(spark, sf), "user_knn": user_knn_lists(spark, sf),
    }
    rows = None
    for m in MODELS:
        part = parts[m].select(F.lit(m).alias("model"), "user_id", F.col("rank").cast("long").alias("rank"), "item_id")
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query(
    "single_truth_metrics", "E4",
    """SELECT l.user_id, coalesce(max(CASE WHEN t.item_id IS NOT NULL THEN 1.0 END), 0)::DOUBLE AS hit, round(coalesce(max(CASE WHEN t.item_id IS NOT NULL THEN 1 / log2(rank + 1.0::DOUBLE) END), 0), 6) AS ndcg,
  round(coalesce(max(CASE WHEN t.item_id IS NOT NULL THEN 1.0::DOUBLE / rank END), 0), 6) AS mrr FROM item_knn_lists l LEFT JOIN te t ON t.user_id = l.user_id AND t.item_id = l.item_id GROUP BY l.user_id""",
    "item_knn_lists te",
)
def single_truth_metrics(spark, sf):
    ranks = metrics.best_hit_rank(item_knn_lists(spark, sf), test(spark, sf), ["user_id"], ["user_id"])
    return s.rounded(metrics.rank_metrics(ranks).select("user_id", "hit", "ndcg", "mrr"))


cte("last7", "SELECT user_id, item_id FROM selected_users WHERE split = 'test'", "selected_users")
cte("last7_train", "SELECT user_id, item_id FROM selected_users WHERE split = 'train'", "selected_users")
cte("last7_popularity", "SELECT item_id, count(DISTINCT user_id) AS popularity FROM last7_train GROUP BY item_id", "last7_train")
cte("last7_lists", global_sql("last7_popularity", "popularity", "last7_train"), "last7_train", "last7_popularity")


@query(
    "best_hit_metrics", "E5 W9",
    """SELECT user_id, best_rank, (best_rank IS NOT NULL)::INTEGER::DOUBLE AS hit, round(coalesce(1 / log2(best_rank + 1.0::DOUBLE), 0), 6) AS ndcg, round(coalesce(1.0::DOUBLE / best_rank, 0), 6) AS mrr FROM (
SELECT l.user_id, min(CASE WHEN t.item_id IS NOT NULL THEN rank END) AS best_rank FROM last7_lists l LEFT JOIN last7 t ON t.user_id = l.user_id AND t.item_id = l.item_id GROUP BY l.user_id)""",
    "last7_lists last7",
)
def best_hit_metrics(spark, sf):
    """Lists from the train part, truth from the test part of one split; every user of
    the split has seven test items."""
    rows = v.selected(spark, sf)
    seen = rows.filter("split = 'train'").select("user_id", "item_id")
    truth = rows.filter("split = 'test'").select("user_id", "item_id")
    lists = recommend.masked_global_top_k(ix.popularity(seen), seen, seen, "popularity", K)
    ranks = metrics.best_hit_rank(lists, truth, ["user_id"], ["user_id"])
    return s.rounded(metrics.rank_metrics(ranks))


@query(
    "leaderboard", "E6 E4 A10 R1 R2 R3 R4 R5 R6",
    """SELECT model, round(sum(hit) / (SELECT count(DISTINCT user_id) FROM tr), 6) AS hit, round(sum(ndcg) / (SELECT count(DISTINCT user_id) FROM tr), 6) AS ndcg, round(sum(mrr) / (SELECT count(DISTINCT user_id) FROM tr), 6) AS mrr,
  any_value(round(cov, 6)) AS coverage FROM (SELECT l.model, CASE WHEN t.item_id IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END AS hit, CASE WHEN t.item_id IS NOT NULL THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END AS ndcg,
  CASE WHEN t.item_id IS NOT NULL THEN 1.0::DOUBLE / rank ELSE 0 END AS mrr FROM model_lists l LEFT JOIN te t ON t.user_id = l.user_id AND t.item_id = l.item_id) m
JOIN (SELECT model, count(DISTINCT item_id) / (SELECT count(*) FROM items) AS cov FROM model_lists GROUP BY model) c USING (model) GROUP BY model""",
    "model_lists te tr items",
)
def leaderboard(spark, sf):
    seen = train(spark, sf)
    return s.rounded(metrics.leaderboard(model_lists(spark, sf), test(spark, sf), seen, v.items(spark, sf)))


@query("leaderboard_with_factors", "E6 E4 A10 R7")
def leaderboard_with_factors(spark, sf):
    """All seven models; a trained model is beyond SQL."""
    seen = train(spark, sf)
    factor = factor_lists(spark, sf).select(F.lit("factor").alias("model"), "user_id", F.col("rank").cast("long").alias("rank"), "item_id")
    lists = model_lists(spark, sf).unionByName(factor)
    return s.rounded(metrics.leaderboard(lists, test(spark, sf), seen, v.items(spark, sf)))


@query("user_item_pairs", "J6 R10", "SELECT user_id, item_id FROM item_knn_scores", "item_knn_scores")
def user_item_pairs(spark, sf):
    seen = train(spark, sf)
    found = unseen_sums(seen, recommend.neighbour_matrix(seen, "item", pairs(spark, sf)))
    return found.select("user_id", "item_id")


@query("masked_scores", "J4 T5", "SELECT user_id, rank, item_id FROM item_knn_lists", "item_knn_lists")
def masked_scores(spark, sf):
    """All co-occurrence scores first, seen items masked at the end."""
    seen = train(spark, sf)
    summed = unseen_sums(seen, recommend.neighbour_matrix(seen, "item", pairs(spark, sf)), K)
    return out(top_k(summed, "score", K, ["user_id"]))
