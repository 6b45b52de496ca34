"""Recommender scoring over sparse interaction edges."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.functions.profiles import FEATURES, LIST_K
from rankforge.functions.scalars import dot
from rankforge.operators.interactions import with_degree
from rankforge.operators.ordering import attach, explode_range, join_unique, ordered_position
from rankforge.operators.inner_product import MARGIN, best_of_block, dense_ids, largest_inner_products
from rankforge.operators.neighbours import unseen_sums
from rankforge.operators.propagation import propagate  # noqa: F401
from rankforge.operators.ranking import TIE_DIGITS, score_order, top_k
from rankforge.operators.utility import with_each
from rankforge.session import materialize

# Rows of a global list that may be broadcast.
HEAD = 10_000
# Largest side of one co-occurrence group.
CHUNK = 1_000
# Items that a block of users meets at once, users multiplied at once, and tasks that share an item cell.
STRETCH = 2_048
ROWS = 1_024
CELL_SHARES = 8


def mask_seen(scores: DataFrame, seen: DataFrame) -> DataFrame:
    return scores.join(seen.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_anti")


def masked_top_k(scores: DataFrame, seen: DataFrame, score: str = "score", k: int = LIST_K) -> DataFrame:
    return top_k(mask_seen(scores, seen), score, k, ["user_id"])


def masked_global_top_k(
    ranked: DataFrame, seen: DataFrame, users: DataFrame, score: str, k: int = LIST_K, by: Sequence[str] = ()
) -> DataFrame:
    """The k best unseen items of one global ranking, for every user. With ``by``
    there are a few rankings and ``users`` says which one each user gets.

    With a user's seen items at positions p1 < p2 < ..., the list must reach to
    position k + c, where c counts the j with p_j - j < k. Only those positions
    are listed, so the work is k rows per user plus the seen rows.
    """
    by = list(by)
    users = users.select("user_id", *by).distinct()
    placed = materialize(
        ordered_position(
            ranked.select(*by, "item_id", score), by, score_order(score, "item_id"), "place", "_listed"
        )
    )
    seen = seen.select("user_id", "item_id").distinct()
    own = seen.join(users, "user_id") if by else seen
    met = ordered_position(
        own.join(placed.select(*by, "item_id", "place"), [*by, "item_id"]), ["user_id"], ["place"], "_j", "_s"
    )
    blocking = materialize(met.filter(F.col("place") - F.col("_j") < k).select("user_id", "place"))
    ends = users.join(
        blocking.groupBy("user_id").agg(F.count("*").alias("_c")), "user_id", "left"
    ).withColumn("_end", k + F.coalesce("_c", F.lit(0)))
    reach = explode_range(ends, "place", F.lit(1), F.col("_end")).select("user_id", *by, "place")
    free = reach.join(blocking, ["user_id", "place"], "left_anti")
    # Everyone needs the first places, so these are broadcast (HEAD rows per
    # ranking at most); later places are asked for by few users each.
    places = placed.drop("_listed")
    head = free.filter(F.col("place") <= HEAD).join(
        F.broadcast(places.filter(F.col("place") <= HEAD)), [*by, "place"]
    )
    tail = free.filter(F.col("place") > HEAD).join(places.filter(F.col("place") > HEAD), [*by, "place"])
    found = head.unionByName(tail)
    return top_k(found, score, k, ["user_id"], order=[F.col("place").asc()]).drop("place", *by)


def basket_pairs(edges: DataFrame, user: str = "user_id", item: str = "item_id", chunk: int = CHUNK) -> DataFrame:
    """Item pairs (a < b) that share a user, one row per shared user.

    A long basket is cut into chunks of about ``chunk`` items and every pair of
    chunks is its own join group, so no group exceeds chunk x chunk rows however
    many rows one user holds.
    """
    sized = with_degree(edges.select(user, item), user, "_deg").withColumn(
        "_parts", F.ceil(F.col("_deg") / chunk).cast("int")
    )
    own = F.pmod(F.hash(item), F.col("_parts"))
    every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    a = sized.select(user, F.col(item).alias("a"), own.alias("_ca"), every.alias("_cb"), "_deg")
    b = sized.select(user, F.col(item).alias("b"), own.alias("_cb"), every.alias("_ca"))
    return a.join(b, [user, "_ca", "_cb"]).filter(F.col("a") < F.col("b")).select(
        user, "a", "b", F.col("_deg").alias("user_degree")
    )


def co_occurrence(edges: DataFrame) -> DataFrame:
    """Per item pair (a < b): shared users, and the sum of 1/sqrt(basket size)
    over them. Pairs are summed in each task before they are shuffled."""
    return basket_pairs(edges).groupBy("a", "b").agg(
        F.count("*").alias("n_shared"),
        F.sum(1.0 / F.sqrt(F.col("user_degree").cast("double"))).alias("w_shared"),
    )


def mirrored(pairs: DataFrame, value: str) -> DataFrame:
    both = F.explode(
        F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("a").alias("j")))
    )
    return pairs.select(both.alias("_p"), value).select(
        F.col("_p.i").alias("item_id"), F.col("_p.j").alias("other"), value
    )


def item_similarity(edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Cosine of items over their users, both directions, no diagonal."""
    pairs = co_occurrence(edges) if pairs is None else pairs
    degree = edges.groupBy("item_id").agg(F.count("*").alias("n"))
    scored = (
        pairs.join(degree.select(F.col("item_id").alias("a"), F.col("n").alias("na")), "a")
        .join(degree.select(F.col("item_id").alias("b"), F.col("n").alias("nb")), "b")
        .withColumn("sim", F.col("n_shared") / F.sqrt((F.col("na") * F.col("nb")).cast("double")))
    )
    return mirrored(scored, "sim")


def _sum_over_seen(edges: DataFrame, matrix: DataFrame, value: str) -> DataFrame:
    """score(user, other) = sum of matrix[item, other] over the user's items."""
    return (
        edges.select("user_id", "item_id")
        .join(matrix, "item_id")
        .groupBy("user_id", F.col("other").alias("item_id"))
        .agg(F.sum(value).alias("score"))
    )


def neighbour_matrix(edges: DataFrame, kind: str, pairs: DataFrame | None = None) -> DataFrame:
    """matrix[item, other] whose row sums over a user's items are the scores.

    ``item``: cosine of two items over their users. ``user``: shared users weighted
    by 1/sqrt(basket size). The latter serves user neighbourhoods, because
    sum_v cos(u, v) A_vj equals 1/sqrt(n_u) times the sum, over the items i of u,
    of sum_v A_vi A_vj / sqrt(n_v). So user similarity is never formed and a
    popular item does not pair all of its users. Own items are masked at the end,
    which removes v = u.
    """
    pairs = co_occurrence(edges) if pairs is None else pairs
    if kind == "item":
        return item_similarity(edges, pairs).withColumnRenamed("sim", "w")
    return mirrored(pairs, "w_shared").withColumnRenamed("w_shared", "w")


def item_knn(edges: DataFrame, similarity: DataFrame) -> DataFrame:
    """Score of every item that is similar to something the user has."""
    return mask_seen(_sum_over_seen(edges, similarity, "sim"), edges)


def user_knn(edges: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Score of every item of a similar user."""
    scores = mask_seen(_sum_over_seen(edges, neighbour_matrix(edges, "user", pairs), "w"), edges)
    return _per_user_scale(scores, edges)


def _per_user_scale(scores: DataFrame, edges: DataFrame) -> DataFrame:
    sizes = edges.groupBy("user_id").agg(F.count("*").alias("_n"))
    return scores.join(sizes, "user_id").withColumn(
        "score", F.col("score") / F.sqrt(F.col("_n").cast("double"))
    ).drop("_n")


def neighbour_top_k(
    edges: DataFrame, kind: str = "item", k: int = LIST_K, pairs: DataFrame | None = None,
    most_hot: int = 6, hot_share: float = 0.001, least_hot: int = 1_000,
) -> DataFrame:
    """The k best unseen items per user by item or user neighbourhood, exactly.

    An item that a large share of users own would give each of them its whole row
    of the matrix. The few such items (at most ``most_hot``, each with at least
    ``hot_share`` of all edges and ``least_hot`` users) are taken out of the join. Users who own the same
    of them share one vector of scores from them: a candidate found through other
    items looks its part up in that vector, and items found in no other way can
    only come from the vector's own best unseen ones. Together these contain every
    winner with its full score.
    """
    edges = edges.select("user_id", "item_id")
    total = edges.agg(F.count("*").alias("_total"))
    degree = attach(edges.groupBy("item_id").agg(F.count("*").alias("_n")), total)
    top = top_k(
        degree.filter((F.col("_n") >= hot_share * F.col("_total")) & (F.col("_n") >= least_hot)), "_n", most_hot
    )
    hot = materialize(top.select("item_id", F.pow(F.lit(2.0), F.col("rank") - 1).cast("int").alias("bit")))
    matrix = neighbour_matrix(edges, kind, pairs)
    if hot.isEmpty():
        return top_k(unseen_sums(edges, matrix, k, scale=kind == "user"), "score", k, ["user_id"])
    # ``hot`` has at most most_hot rows, so these sides are broadcast.
    marked = edges.join(F.broadcast(hot), "item_id", "left")
    owners = marked.filter("bit IS NOT NULL").groupBy("user_id").agg(F.sum("bit").cast("int").alias("pattern"))
    own = materialize(edges.select("user_id").distinct().join(owners, "user_id", "left").fillna(0, ["pattern"]))
    found = unseen_sums(edges, matrix, skip=hot).join(own, "user_id")

    patterns = own.filter("pattern > 0").select("pattern").distinct()
    rows = matrix.join(F.broadcast(hot), "item_id")
    vectors = materialize(
        with_each(rows, patterns, most=1 << most_hot)
        .filter(F.col("pattern").bitwiseAND(F.col("bit")) > 0)
        .groupBy("pattern", F.col("other").alias("item_id"))
        .agg(F.sum("w").alias("shared"))
    )
    full = found.join(vectors, ["pattern", "item_id"], "left").select(
        "user_id", "item_id", (F.col("score") + F.coalesce("shared", F.lit(0.0))).alias("score")
    )
    best = masked_global_top_k(vectors, edges, own.filter("pattern > 0"), "shared", k, ["pattern"])
    both = full.unionByName(best.select("user_id", "item_id", F.col("shared").alias("score")))
    scores = both.groupBy("user_id", "item_id").agg(F.max("score").alias("score"))
    if kind == "user":
        scores = _per_user_scale(scores, edges)
    return top_k(scores, "score", k, ["user_id"])


def content_profiles(edges: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Unit mean of the unit vectors of each user's items, as u0, u1, ... with the
    number of items. ``vectors`` carries x0, x1, ..."""
    means = (
        edges.select("user_id", "item_id").join(vectors, "item_id")
        .groupBy("user_id")
        .agg(*[F.avg(f"x{d}").alias(f"m{d}") for d in range(dim)], F.count("*").alias("n_seen"))
    )
    return means.select("user_id", "n_seen", *_unit(dim, "m", "u"))


def _sum(parts: Sequence[Column]) -> Column:
    return sum(parts[1:], parts[0])


def _unit(dim: int, source: str, out: str) -> list[Column]:
    length = F.sqrt(_sum([F.col(f"{source}{d}") * F.col(f"{source}{d}") for d in range(dim)]))
    safe = F.when(length == 0, F.lit(1.0)).otherwise(length)
    return [(F.col(f"{source}{d}") / safe).alias(f"{out}{d}") for d in range(dim)]


def _angle(dim: int, a: str, b: str) -> Column:
    cosine = _sum([F.col(f"{a}{d}") * F.col(f"{b}{d}") for d in range(dim)])
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def _cells(placed: DataFrame, level: int, dim: int) -> DataFrame:
    """Per cell of one level: parent cell, size, centre direction and radius."""
    name = f"cell{level}"
    parent = [f"cell{level - 1}"] if level else []
    centres = placed.groupBy(name, *parent).agg(
        *[F.avg(f"x{d}").alias(f"m{d}") for d in range(dim)], F.count("*").alias("n_cell")
    ).select(name, *parent, "n_cell", *_unit(dim, "m", "c"))
    radius = placed.join(centres.drop("n_cell", *parent), name).groupBy(name).agg(
        (F.max(_angle(dim, "x", "c")) + 1e-6).alias("radius")
    )
    return materialize(centres.join(radius, name))


def _user_cells(users: DataFrame, k: int, dim: int, block: int, seen_block: int) -> DataFrame:
    """Per cell of users: centre direction, radius (reach), how many items surely hold k unseen
    ones for each member (need), and the number of blocks its members are dealt into."""
    centres = users.groupBy("uc").agg(
        *[F.avg(f"u{d}").alias(f"m{d}") for d in range(dim)], (F.max("n_seen") + k).alias("need"),
        F.ceil(F.greatest(F.count("*") / block, F.sum("n_seen") / seen_block)).cast("int").alias("parts"),
    ).select("uc", "need", "parts", *_unit(dim, "m", "c"))
    reach = users.join(centres.drop("need", "parts"), "uc").groupBy("uc").agg((F.max(_angle(dim, "u", "c")) + 1e-6).alias("reach"))
    return materialize(centres.join(reach, "uc").select("uc", "need", "parts", "reach", *[F.col(f"c{d}").alias(f"u{d}") for d in range(dim)]))


def _open(bounds: DataFrame, level: int, dim: int) -> DataFrame:
    """Item cells of one level that can still hold one of the best unseen items of a member of
    a user cell, with the highest score any of their pairs can have.

    All items of a cell lie within its radius of its centre, and all users within reach of
    theirs. The item cells whose worst pairs are best, taken until they hold what the user cell
    needs, set a bar; an item cell whose best pair cannot reach the bar is closed for all
    members at once. The window of a user cell sees the cells of one level, not items.
    """
    spread = F.col("radius") + F.col("reach")
    near = bounds.withColumn("_angle", _angle(dim, "u", "c")).select(
        *[c for c in bounds.columns if c not in {f"c{d}" for d in range(dim)}],
        F.cos(F.least(F.col("_angle") + spread, F.lit(3.141592653589793))).alias("_low"),
        F.cos(F.greatest(F.col("_angle") - spread, F.lit(0.0))).alias("high"),
    )
    surest = Window.partitionBy("uc").orderBy(F.col("_low").desc(), f"cell{level}")
    held = near.withColumn("_held", F.sum("n_cell").over(surest))
    bar = F.max(F.when(F.col("_held") >= F.col("need"), F.col("_low"))).over(Window.partitionBy("uc"))
    barred = held.withColumn("_bar", bar)
    return barred.filter(F.col("_bar").isNull() | (F.col("high") >= F.col("_bar") - 1e-6)).select(
        "uc", "need", "reach", *[f"u{d}" for d in range(dim)], f"cell{level}", "high"
    )


class _Block:
    """A block of users that meets item cells, the most promising first."""

    def __init__(self, k: int, dim: int):
        self.k, self.dim, self.done = k, dim, False
        self.users: dict[int, int] = {}
        self.x: list[np.ndarray] = []
        self.seen: list[tuple[np.ndarray, np.ndarray]] = []
        self.held: list[tuple[float, np.ndarray, np.ndarray]] = []
        self.n_held, self.bar = 0, None
        self.best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def add_user(self, user: int, x: np.ndarray, seen: np.ndarray) -> None:
        row = self.users.setdefault(user, len(self.users))
        if row == len(self.x):
            self.x.append(x)
        self.seen.append((np.full(len(seen), row), seen))

    def add_items(self, high: float, ids: np.ndarray, y: np.ndarray) -> None:
        if self.done:
            return
        self.held.append((high, ids, y))
        self.n_held += len(ids)
        if self.n_held >= STRETCH:
            self.score()

    def score(self) -> None:
        if not self.held:
            return
        if self.bar is None:
            self.x, self.bar = np.array(self.x), np.full(len(self.users), -np.inf)
            self.seen = tuple(np.concatenate(c) for c in zip(*self.seen))
        # All later cells are bounded by the first one held, so a user above it has its list.
        here = np.flatnonzero(self.bar <= self.held[0][0] + MARGIN)
        if not len(here):
            self.done = True
        else:
            ids, y = np.concatenate([h[1] for h in self.held]), np.concatenate([h[2] for h in self.held])
            found = [self.best]
            for lo in range(0, len(here), ROWS):
                rows = here[lo:lo + ROWS]
                spot = np.minimum(np.searchsorted(rows, self.seen[0]), len(rows) - 1)
                mine = rows[spot] == self.seen[0]
                seen = (spot[mine], self.seen[1][mine])
                u, i, s, _ = best_of_block(self.x[rows], self.bar[rows], y.reshape(-1, self.dim), ids, seen, self.k)
                found.append((rows[u], i, s))
            u, i, s = (np.concatenate(c) for c in zip(*found))
            by = np.lexsort((i, -np.round(s, TIE_DIGITS), u))
            u, i, s = u[by], i[by], s[by]
            place = np.arange(len(u)) - np.searchsorted(u, u, "left")
            self.best = (u[place < self.k], i[place < self.k], s[place < self.k])
            full = place == self.k - 1
            self.bar[u[full]] = s[full]
        self.held, self.n_held = [], 0

    def lists(self, schema: pa.Schema) -> pa.RecordBatch:
        self.score()
        users = np.fromiter(self.users, np.int64, len(self.users))
        u, i, s = self.best
        return pa.record_batch([pa.array(users[u]), pa.array(i), pa.array(s)], schema=schema)


def _best_first(k: int, dim: int):
    """Rows (uc, part, items?, high, id, ids, values), users of a block before its item cells,
    to lists of (user_id, item_id, score)."""
    schema = pa.schema([("user_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        for batch in batches:
            uc, part, items, high, ids = (batch.column(c).to_pylist() for c in range(5))
            for n in range(batch.num_rows):
                if (uc[n], part[n]) != now:
                    if block:
                        yield block.lists(schema)
                    now, block = (uc[n], part[n]), _Block(k, dim)
                many, values = (batch.column(c)[n].values.to_numpy(zero_copy_only=False) for c in (5, 6))
                if items[n]:
                    block.add_items(high[n], many, values)
                else:
                    block.add_user(ids[n], values, many)
        if block:
            yield block.lists(schema)

    return run


def content_top_k(
    edges: DataFrame, items: DataFrame, k: int = LIST_K, features: Sequence[str] = FEATURES,
    grids: Sequence[int] = (4, 12), user_grid: int = 4, block: int = 8192, item_block: int = 4096,
    seen_block: int = 1_000_000,
) -> DataFrame:
    """The k unseen items of highest cosine to each user's content profile, exactly,
    without scoring every (user, item).

    Unit vectors of items are put into nested grid cells, and profiles into cells of
    direction and number of seen items. One bound closes a pair of cells for all their
    members; only item cells that can hold a winner are opened into the next finer level.
    What is left is multiplied in blocks: a block of a user cell meets its item cells by
    falling bound and stops when the bound is below the k-th score of all its users.
    """
    dim = len(features)
    raw = items.select("item_id", *[F.col(f).alias(f"f{d}") for d, f in enumerate(features)])
    vectors = raw.select(F.col("item_id").cast("long").alias("item_id"), *_unit(dim, "f", "x"))

    def steps(prefix: str, g: int) -> Column:
        return _sum([F.floor(F.greatest(F.least(F.col(f"{prefix}{d}"), F.lit(1 - 1e-12)), F.lit(0.0)) * g) * (g**d) for d in range(dim)]).cast("long")

    for level, g in enumerate(grids):
        vectors = vectors.withColumn(f"cell{level}", steps("x", g))
    placed = materialize(vectors)
    profiles = content_profiles(edges, placed.select("item_id", *[f"x{d}" for d in range(dim)]), dim)
    activity = F.floor(F.log2(F.col("n_seen").cast("double"))).cast("long")
    users = materialize(profiles.withColumn("uc", steps("u", user_grid) + activity * (user_grid**dim)))
    user_cells = _user_cells(users, k, dim, block, seen_block)
    cells = [_cells(placed, level, dim) for level in range(len(grids))]
    opened = _open(with_each(user_cells.drop("parts"), cells[0]), 0, dim)
    for level in range(1, len(grids)):
        finer = opened.drop("high").join(cells[level], f"cell{level - 1}").drop(f"cell{level - 1}")
        opened = _open(finer, level, dim)
    last = f"cell{len(grids) - 1}"
    vector = lambda name: F.array(*[f"{name}{d}" for d in range(dim)])
    chunk = F.pmod(F.xxhash64("item_id"), F.ceil(F.col("n_cell") / item_block))
    packed = (
        placed.join(cells[-1].select(last, "n_cell"), last).groupBy(last, chunk.alias("chunk"))
        .agg(F.collect_list(F.struct("item_id", vector("x").alias("x"))).alias("l"))  # at most about item_block
        .select(last, F.col("l.item_id").alias("ids"), F.flatten("l.x").alias("vs"))
        .withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(CELL_SHARES - 1))))
    )
    dealt = opened.select("uc", last, "high").join(user_cells.select("uc", "parts"), "uc").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    offers = dealt.withColumn("share", F.pmod(F.xxhash64("uc", "part"), F.lit(CELL_SHARES)).cast("int")).join(packed, [last, "share"]).select(
        "uc", "part", F.lit(True).alias("items"), "high", F.lit(None).cast("long").alias("id"), "ids", "vs"
    )
    member = users.join(user_cells.select("uc", "parts"), "uc").withColumn("part", F.pmod(F.xxhash64("user_id"), "parts").cast("int"))
    own = edges.select("user_id", F.col("item_id").cast("long").alias("item_id")).distinct()
    asked = (  # what a user has seen, in pieces of bounded size
        member.join(own, "user_id").groupBy("uc", "part", "user_id", F.pmod(F.xxhash64("item_id"), F.ceil(F.col("n_seen") / seen_block)).alias("piece"))
        .agg(F.first(vector("u")).alias("vs"), F.collect_list("item_id").alias("ids"))
        .select("uc", "part", F.lit(False).alias("items"), F.lit(2.0).alias("high"), F.col("user_id").cast("long").alias("id"), "ids", "vs")
    )
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by work, not by size
    rows = asked.unionByName(offers).repartition(tasks, "uc", "part").sortWithinPartitions("uc", "part", "items", F.desc("high"))
    found = rows.mapInArrow(_best_first(k, dim), "user_id long, item_id long, score double")
    kept = found.select(F.col("user_id").cast(edges.schema["user_id"].dataType), F.col("item_id").cast(items.schema["item_id"].dataType), "score")
    return top_k(kept, "score", k, ["user_id"])


def implicit_factors(edges: DataFrame, rank: int = 16, iterations: int = 5, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Alternating least squares on implicit feedback: (user_id, x) and (item_id, x). Ids of
    any integer size are numbered first."""
    pairs = edges.select("user_id", "item_id").distinct()
    users, items = (materialize(dense_ids(pairs, c)) for c in ("user_id", "item_id"))
    numbered = pairs.join(users.withColumnRenamed("number", "u"), "user_id").join(items.withColumnRenamed("number", "i"), "item_id")
    als = ALS(
        userCol="u", itemCol="i", ratingCol="r", implicitPrefs=True, rank=rank,
        maxIter=iterations, regParam=0.05, alpha=10.0, seed=seed, coldStartStrategy="drop",
    )
    # The order of the rows decides how sums of single floats are rounded.
    ordered = materialize(numbered.select("u", "i", F.lit(1.0).alias("r")).repartitionByRange("u", "i").sortWithinPartitions("u", "i"))
    model = als.fit(ordered)
    named = lambda factors, ids, c: factors.join(ids, factors["id"] == ids["number"]).select(c, F.col("features").cast("array<double>").alias("x"))
    return materialize(named(model.userFactors, users, "user_id")), materialize(named(model.itemFactors, items, "item_id"))


def factor_top_k(factors: tuple[DataFrame, DataFrame], seen: DataFrame, k: int = LIST_K, rank: int = 16) -> DataFrame:
    """Each user's k unseen items of the highest factor score, among all items."""
    return largest_inner_products(*factors, seen, k, rank)


def bipartite_edges(edges: DataFrame) -> DataFrame:
    """Both directions of every distinct edge with weight 1/sqrt(deg deg).
    Nodes are (kind, id): 'u' users and 'i' items."""
    pairs = edges.select("user_id", "item_id").distinct()
    sized = with_degree(with_degree(pairs, "user_id", "_du"), "item_id", "_di")
    weight = 1.0 / F.sqrt((F.col("_du") * F.col("_di")).cast("double"))
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    item = F.concat(F.lit("i"), F.col("item_id").cast("string"))
    both = F.array(
        F.struct(user.alias("src"), item.alias("dst"), F.col("_du").alias("src_degree")),
        F.struct(item.alias("src"), user.alias("dst"), F.col("_di").alias("src_degree")),
    )
    return sized.select(F.explode(both).alias("_e"), weight.alias("weight")).select("_e.*", "weight")
