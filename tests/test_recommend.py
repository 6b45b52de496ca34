import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.operators import interactions as ix
from rankforge.operators import recommend as rec
from rankforge.operators import sampling


@pytest.fixture(scope="module")
def data(spark):
    """60 items, 40 users; user 0 owns most items and item 0 has most users."""
    rng = np.random.default_rng(2)
    edges = {(0, i) for i in range(45)} | {(u, 0) for u in range(30)}
    edges |= {(int(u), int(i)) for u, i in zip(rng.integers(0, 40, 200), rng.integers(0, 60, 200))}
    rows = sorted(edges)
    return rows, spark.createDataFrame(rows, "user_id long, item_id long")


def baskets(rows):
    out = defaultdict(set)
    for u, i in rows:
        out[u].add(i)
    return out


@pytest.mark.parametrize("chunk", [3, 1000])
def test_pairs_do_not_depend_on_chunks(data, chunk):
    rows, edges = data
    got = Counter((r.a, r.b) for r in rec.basket_pairs(edges, chunk=chunk).collect())
    want = Counter(p for b in baskets(rows).values() for p in itertools.combinations(sorted(b), 2))
    assert got == want


def test_neighbourhood_scores(data):
    rows, edges = data
    own = baskets(rows)
    users = sorted(own)
    a = np.zeros((40, 60))
    for u, i in rows:
        a[u, i] = 1
    norm_i = np.where(a.any(0), np.sqrt(a.sum(0)), 1)
    item_sim = (a / norm_i).T @ (a / norm_i)
    np.fill_diagonal(item_sim, 0)
    nu = np.sqrt(a.sum(1, keepdims=True))
    nu[nu == 0] = 1
    user_sim = (a / nu) @ (a / nu).T
    np.fill_diagonal(user_sim, 0)
    item = {(r.user_id, r.item_id): r.score for r in rec.item_knn(edges, rec.item_similarity(edges)).collect()}
    user = {(r.user_id, r.item_id): r.score for r in rec.user_knn(edges).collect()}
    for u in users:
        for j in range(60):
            if j in own[u]:
                assert (u, j) not in item and (u, j) not in user
                continue
            assert item.get((u, j), 0.0) == pytest.approx(item_sim[j, sorted(own[u])].sum(), abs=1e-12)
            assert user.get((u, j), 0.0) == pytest.approx(user_sim[u] @ a[:, j], abs=1e-12)


@pytest.mark.parametrize("kind", ["item", "user"])
@pytest.mark.parametrize("share", [0.0, 0.03, 2.0])
def test_hot_items_do_not_change_lists(data, kind, share):
    """All, some or no items treated as hot: the same lists as scoring everything."""
    rows, edges = data
    got = defaultdict(list)
    for r in rec.neighbour_top_k(edges, kind, 5, most_hot=4, hot_share=share, least_hot=1).orderBy("user_id", "rank").collect():
        got[r.user_id].append(r.item_id)
    scores = rec.item_knn(edges, rec.item_similarity(edges)) if kind == "item" else rec.user_knn(edges)
    per = defaultdict(list)
    for r in scores.collect():
        per[r.user_id].append((-round(r.score, 9), r.item_id))
    assert dict(got) == {u: [i for _, i in sorted(v)[:5]] for u, v in per.items()}


def test_masked_global_lists(data, spark):
    rows, edges = data
    ranked = spark.range(60).select(F.col("id").alias("item_id"), (60 - F.col("id")).cast("double").alias("score"))
    got = defaultdict(list)
    for r in rec.masked_global_top_k(ranked, edges, edges, "score", 5).orderBy("user_id", "rank").collect():
        got[r.user_id].append(r.item_id)
    for u, own in baskets(rows).items():
        assert got[u] == [i for i in range(60) if i not in own][:5]


def test_content_lists_are_exact(data, spark):
    rows, edges = data
    rng = np.random.default_rng(8)
    x = rng.random((60, 5))
    names = ["a", "b", "c", "d", "e"]
    items = spark.createDataFrame([(i, *map(float, x[i])) for i in range(60)], "item_id long, " + ", ".join(f"{n} double" for n in names))
    got = defaultdict(list)
    for r in rec.content_top_k(edges, items, 4, names).orderBy("user_id", "rank").collect():
        got[r.user_id].append(r.item_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for u, own in baskets(rows).items():
        c = unit[sorted(own)].mean(0)
        score = unit @ (c / np.linalg.norm(c))
        best = sorted((i for i in range(60) if i not in own), key=lambda i: (-round(score[i], 9), i))[:4]
        assert got[u] == best


def test_content_lists_are_exact_in_many_blocks_with_a_heavy_user_and_zero_vectors(spark):
    rng = np.random.default_rng(11)
    n_items, names = 300, ["a", "b", "c"]
    x = np.round(rng.random((n_items, 3)), 2)  # ties
    x[7] = 0
    rows = {(u, int(i)) for u in range(40) for i in rng.integers(n_items, size=rng.integers(1, 9))} | {(99, i) for i in range(290)} | {(50, 7)}
    edges = spark.createDataFrame(sorted(rows), "user_id long, item_id long")
    items = spark.createDataFrame([(i, *map(float, x[i])) for i in range(n_items)], "item_id long, a double, b double, c double")
    got = defaultdict(list)
    lists = rec.content_top_k(edges, items, 12, names, user_grid=2, block=3, item_block=4, seen_block=20)
    for r in lists.orderBy("user_id", "rank").collect():
        got[r.user_id].append(r.item_id)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    unit = x / np.where(length == 0, 1, length)
    for u, own in baskets(sorted(rows)).items():
        c = unit[sorted(own)].mean(0)
        score = unit @ (c / (np.linalg.norm(c) or 1))
        best = sorted((i for i in range(n_items) if i not in own), key=lambda i: (-round(score[i], 9), i))[:12]
        assert got[u] == best, u
    assert len(got[99]) == 10


def test_propagation(spark):
    edges = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "user_id long, item_id long")
    bip = rec.bipartite_edges(edges)
    assert bip.count() == 6
    nodes = ["u1", "u2", "i1", "i2"]
    x = np.arange(8.0).reshape(4, 2)
    vec = spark.createDataFrame([(n, x[k].tolist()) for k, n in enumerate(nodes)], "node string, x array<double>")
    a = np.zeros((4, 4))
    for u, i, d in ((0, 2, 2 * 1), (0, 3, 2 * 2), (1, 3, 1 * 2)):
        a[u, i] = a[i, u] = 1 / math.sqrt(d)
    want = (x + a @ x + a @ a @ x) / 3
    got = {r.node: r.x for r in rec.propagate(bip, vec, 2, 2).collect()}
    for k, n in enumerate(nodes):
        np.testing.assert_allclose(got[n], want[k])


def test_draws_are_unseen_distinct_and_complete(data, spark):
    rows, edges = data
    items = spark.range(60).select(F.col("id").alias("item_id"))
    asks = edges.select("user_id").distinct().withColumn("request", F.lit(0).cast("long"))
    drawn = sampling.draw_unseen(asks, edges, sampling.item_index(items), 10, 1).collect()
    per = defaultdict(list)
    for r in drawn:
        per[r.user_id].append(r.item_id)
    for u, own in baskets(rows).items():
        assert len(per[u]) == len(set(per[u])) == min(10, 60 - len(own))
        assert not set(per[u]) & own


def test_negatives_exist_for_every_positive(data, spark):
    rows, edges = data
    items = spark.range(60).select(F.col("id").alias("item_id"))
    got = sampling.negative_samples(edges, sampling.item_index(items), 3).collect()
    assert len(got) == len(rows)
    own = baskets(rows)
    assert all(r.negative not in own[r.user_id] and r.positive in own[r.user_id] for r in got)


def test_draws_walk_the_permutation_in_one_task_per_user(spark, monkeypatch):
    """The draws are those of the column expression, also where a user's rows cross batches and
    parts; places that were looked at are not shuffled one by one."""
    monkeypatch.setattr(sampling, "ASKED", 7)
    n, k, seed = 40, 3, 5
    items = spark.range(n).select((F.col("id") * 3).alias("item_id"))
    seen = spark.createDataFrame([(u, 3 * i) for u in range(4) for i in range(u * 11)] + [(2, 1)], "user_id long, item_id long")
    asks = spark.createDataFrame([(u, r) for u in range(4) for r in range(3 + 9 * (u % 3))], "user_id long, request long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        got = sorted(map(tuple, sampling.draw_unseen(asks, seen, sampling.item_index(items), k, seed).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = math.isqrt(n - 1) + 1
    columns = -(-n // rows)
    walk = spark.range(rows * columns).crossJoin(asks).withColumn("idx", sampling.permuted(F.col("id"), sampling.round_keys(seed, F.col("user_id"), F.col("request")), rows, columns))
    own = baskets([(r.user_id, r.item_id) for r in seen.collect()])
    want, taken = [], Counter()
    for r in walk.orderBy("user_id", "request", "id").collect():
        if r.idx < n and 3 * r.idx not in own.get(r.user_id, ()) and taken[r.user_id, r.request] < k:
            taken[r.user_id, r.request] += 1
            want.append((r.user_id, r.request, 3 * r.idx, taken[r.user_id, r.request]))
    assert got == sorted(want)
    plan = sampling.draw_unseen(asks, seen, sampling.item_index(items), k, seed)._jdf.queryExecution().optimizedPlan().toString()
    assert "_place" not in plan and "MapInArrow" in plan


def test_user_without_unseen_items_gets_none(spark):
    edges = spark.createDataFrame([(1, i) for i in range(5)] + [(2, 0)], "user_id long, item_id long")
    items = spark.range(5).select(F.col("id").alias("item_id"))
    got = sampling.negative_samples(edges, sampling.item_index(items), 3).collect()
    assert {(r.user_id, r.positive) for r in got} == {(2, 0)}


@pytest.mark.parametrize("block", [3, 4096])
def test_prefix_windows_cross_blocks(spark, block):
    seqs = spark.range(1, 21).select(F.lit(1).alias("user_id"), (F.col("id") * 10).alias("item_id"), F.col("id").alias("pos"))
    got = {r.pos: (r.prefix, r.next_item) for r in ix.prefix_windows(seqs, 3, block).collect()}
    assert got == {p: ([10 * q for q in range(max(1, p - 3), p)], 10 * p) for p in range(2, 21)}


def test_left_pad(spark):
    df = spark.createDataFrame([([5, 6],), ([1, 2, 3, 4, 5],), ([],)], "l array<long>")
    assert [r.p for r in df.select(ix.left_pad(F.col("l"), 4).alias("p")).collect()] == [[0, 0, 6, 7], [3, 4, 5, 6], [0, 0, 0, 0]]


def test_sequences_and_split(spark):
    df = spark.createDataFrame([(1, 9, 5.0, 3), (1, 8, 5.0, 3), (1, 9, 4.0, 7), (1, 7, 5.0, 1), (2, 7, 5.0, 1)], "user_id long, item_id long, rating double, ts long")
    seqs = ix.split_last_k(ix.unique_sequences(df), 1)
    assert sorted((r.user_id, r.pos, r.item_id, r.split) for r in seqs.collect()) == [(1, 1, 7, "train"), (1, 2, 8, "train"), (1, 3, 9, "test"), (2, 1, 7, "test")]


def test_stratified_sample_sizes(spark):
    rng = np.random.default_rng(1)
    names = ["price", "quality", "popularity", "rating", "recency"]
    rows = [(i, *map(float, rng.random(5))) for i in range(500)]
    df = spark.createDataFrame(rows, "item_id long, " + ", ".join(f"{n} double" for n in names))
    for n in names:
        df = df.withColumn(f"{n}_pct", F.col(n))
    got = sampling.stratified_sample(df, None, 80, 3)
    counts = got.groupBy("run").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("d")).collect()
    assert {(r.n, r.d) for r in counts} == {(80, 80)}
    assert got.groupBy("run", "octant").count().agg(F.min("count")).first()[0] >= 10
    assert got.agg(F.max("quality_pct")).first()[0] == 1.0


def test_bootstrap_draws_n_users(spark):
    metrics = spark.range(50).select(F.col("id").alias("user_id"), F.col("id").cast("double").alias("m"))
    got = [r.m for r in sampling.user_bootstrap(metrics, "m", [], 20).collect()]
    assert len(got) == 20 and abs(np.mean(got) - 24.5) < 2 and np.std(got) > 0.5


def test_samples_sort_ids_up_to_the_cut_only(spark, monkeypatch):
    """Neither other columns of the items nor hashes beyond the cut are sorted."""
    from rankforge.operators import sampling as sp

    pct = [f"{c}_pct" for c in ("price", "quality", "popularity", "rating", "recency")]
    items = spark.range(20000).select(
        F.col("id").alias("item_id"), *[(F.col("id") * (i + 3) % 97).cast("double").alias(c) for i, c in enumerate(("price", "quality", "popularity", "rating", "recency"))],
        *[(F.col("id") * (i + 3) % 97 / 97).alias(c) for i, c in enumerate(pct)], F.lit("w" * 100).alias("wide"),
    )
    seen, real = [], sp.top_k
    monkeypatch.setattr(sp, "top_k", lambda df, *a, **k: seen.append((df.columns, df.count())) or real(df, *a, **k))
    got = sp.stratified_sample(items, None, 40, 3)
    (columns, n), = seen
    assert "wide" not in columns and n < 3 * 20000 / 4
    assert got.columns[-3:] != [] and "wide" in got.columns and {r["count"] for r in got.groupBy("run").count().collect()} == {40}


def test_order_lines_get_more_tasks_with_more_lines(spark, monkeypatch):
    from rankforge.workload import views

    folder = "/root/testdata/sf0.001"
    rows = lambda: sorted(map(tuple, views.sales_by_part(spark, folder).collect()))
    few = rows()
    monkeypatch.setattr(views, "LINES_PER_TASK", 100)
    lines = views.table(spark, folder, "lineitem")
    assert views.line_tasks(lines) == -(-lines.count() // 100)
    assert rows() == few


def test_a_cell_of_many_users_meets_its_items_once(spark, monkeypatch):
    """3000 users of one cell are one block, multiplied in parts; items travel to it once."""
    rng = np.random.default_rng(5)
    vectors = {int(i): (0.6 + 0.01 * rng.random(2)).tolist() for i in range(60)}
    items = spark.createDataFrame([(i, *x) for i, x in vectors.items()], "item_id long, a double, b double")
    edges = spark.range(3000).select(F.col("id").alias("user_id"), (F.col("id") % 60).alias("item_id"))
    moved, real = spark.sparkContext.accumulator(0), rec._best_first

    def counted(k, dim):
        run = real(k, dim)

        def watch(batches):
            def each():
                for b in batches:
                    moved.add(sum(len(i) for i, is_item in zip(b.column(5).to_pylist(), b.column(2).to_pylist()) if is_item))
                    yield b

            return run(each())

        return watch

    monkeypatch.setattr(rec, "_best_first", counted)
    got = {}
    for r in rec.content_top_k(edges, items, 3, ["a", "b"]).collect():
        got.setdefault(r.user_id, []).append((r["rank"], r.item_id))
    assert moved.value == 60
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x in vectors.items()}
    for u in (0, 1023, 1024, 2999):
        order = sorted((-round(float(unit[u % 60] @ x), 9), i) for i, x in unit.items() if i != u % 60)
        assert [i for _, i in sorted(got[u])] == [i for _, i in order[:3]]
    assert len(got) == 3000
