"""Per-user external evaluation on learned profiles and logged visits.

Only pairs that are candidates, or that the log has, are ever formed: a user's utility
over all items enters through its range, which bounds give (``operators.threshold``), and
items that were never visited have the value zero. A candidate is one row with its scores as of
every epoch; lists are ranked and measured in the task that holds the user's candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rankforge.functions import profiles as pf
from rankforge.functions.hashing import hash_key
from rankforge.operators import blending, feedback, metrics, threshold, utility
from rankforge.operators.ordering import attach, ordered_position
from rankforge.operators.ranking import TIE_DIGITS
from rankforge.session import materialize

EPOCHS = (1, 2, 5, 10, 20, 30)
N_HIDDEN = 250


def best_hidden(items: DataFrame, profiles: DataFrame, k: int = N_HIDDEN) -> tuple[DataFrame, DataFrame]:
    """Each user's k items of the highest utility, and the profiles with relative shares and
    the range of the utility over all items."""
    relative = materialize(utility.relative_shares(profiles))
    candidates = materialize(threshold.scored_candidates(relative, threshold.item_blocks(items), k))
    ranges = threshold.utility_ranges(candidates)
    ranged = materialize(relative.join(ranges, "user_id"))
    return threshold.best_items(candidates, ranged.select("user_id", "raw_lo", "raw_hi"), k), ranged


def with_ranges(items: DataFrame, profiles: DataFrame) -> DataFrame:
    """The profiles that ``best_hidden`` gives, without its lists: the range goes from the worst
    to the best of all items, so no item below a user's best needs to be scored for it."""
    return best_hidden(items, profiles, 1)[1]


def counted_log(items: DataFrame, ranged: DataFrame, log: DataFrame) -> DataFrame:
    """The log of users with a profile and of items of the table."""
    return log.join(ranged.select("user_id"), "user_id", "left_semi").join(items.select("item_id"), "item_id", "left_semi")


def visits_by_epoch(log: DataFrame, epochs: Sequence[int] = EPOCHS) -> DataFrame:
    """(user_id, item_id, visits): visits of each pair as of every epoch, an array.

    The last epoch ends with the user's last logged event, and the others at the same
    share of the user's events: a log of n events reaches epoch e at event n * e / last.
    Rows of ``log`` are (user_id, item_id, ts, event)."""
    placed = ordered_position(log.select("user_id", "item_id", "ts", "event"), ["user_id"], ["ts", "event", "item_id"], "_at", "_n")
    seen = [F.count_if(F.col("_at") * epochs[-1] <= F.col("_n") * e) for e in epochs]
    return placed.groupBy("user_id", "item_id").agg(F.array(*seen).alias("visits"))


def value_ranges(visited: DataFrame, items: DataFrame, users: DataFrame, tau: float = pf.CONFIDENCE_TAU_EXTERNAL, epochs: Sequence[int] = EPOCHS) -> DataFrame:
    """(user_id, q_lo, q_hi, mean_lambda) over all items, arrays over the epochs, from the visited pairs
    with their ``hidden``. Unvisited items have value and weight zero."""
    facts = []
    for i in range(len(epochs)):
        q, weight = feedback.constant_reward_value(F.col("hidden"), F.col("visits")[i]), blending.gate(F.col("visits")[i], tau)
        facts.append(F.struct(F.min(q).alias("lo"), F.max(q).alias("hi"), F.sum(weight).alias("sum")))
    sums = visited.groupBy("user_id").agg(F.count("*").alias("n"), F.array(*facts).alias("_e"))
    sized = attach(users.select("user_id"), items.agg(F.count("*").alias("_items"))).join(sums, "user_id", "left")
    each = lambda made: F.array(*[made(F.col("_e")[i]) for i in range(len(epochs))])
    zero = F.lit(0.0)
    return sized.select(
        "user_id", each(lambda e: F.when(F.col("n") >= F.col("_items"), e["lo"]).otherwise(zero)).alias("q_lo"),
        each(lambda e: F.coalesce(e["hi"], zero)).alias("q_hi"), each(lambda e: F.coalesce(e["sum"], zero) / F.col("_items")).alias("mean_lambda"),
    )


def candidate_scores(
    items: DataFrame, ranged: DataFrame, visits: DataFrame, ranges: DataFrame, topsis: DataFrame, candidates: DataFrame
) -> DataFrame:
    """What the scores of each user's candidates (user_id, item_id, is_truth) are made of, a row per candidate with
    arrays over the epochs. Values and closeness are scaled over all items. A user's rows are in one task, side by side."""
    closest = topsis.agg(F.min("topsis").alias("_t_lo"), F.max("topsis").alias("_t_hi"))
    facts = threshold.item_facts(items).drop("recency").join(items.select("item_id", *pf.FEATURES), "item_id").join(topsis.select("item_id", "topsis"), "item_id")
    pairs = candidates.select("user_id", "item_id", "is_truth").join(visits, ["user_id", "item_id"], "left").join(facts, "item_id")
    # Tasks by name and number: no user's rows are split, however many there are.
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    people = ranged.join(ranges, "user_id").hint("merge")
    met = attach(pairs.repartition(tasks, "user_id").join(people, "user_id").withColumn("recency", F.col("recency_pct")), closest)
    lo, hi = F.col("_t_lo"), F.col("_t_hi")
    return met.select(
        "user_id", "item_id", "is_truth", threshold.scaled(threshold.raw_utility(threshold.category_score())).alias("hidden"),
        F.coalesce("visits", F.array(*[F.lit(0).cast("long") for _ in EPOCHS])).alias("visits"), "q_lo", "q_hi",
        "topsis", F.when(hi <= lo, F.lit(0.5)).otherwise((F.col("topsis") - lo) / (hi - lo + F.lit(1e-10))).alias("t_norm"), *pf.FEATURES,
    ).sortWithinPartitions("user_id")  # as the join leaves them


class _People:
    """The candidates of some users as one padded table: a row per user, items in order."""

    def __init__(self, batch: pa.Table, n_epochs: int):
        column = lambda c: batch.column(c).combine_chunks()
        first = column("user_id").dictionary_encode()
        code, item = first.indices.to_numpy(zero_copy_only=False).astype(np.int64), column("item_id").to_numpy()
        self.users, self.items = first.dictionary, item
        self.order = np.lexsort((item, code))
        count = np.bincount(code, minlength=len(first.dictionary))
        place = np.arange(len(code)) - np.repeat(np.cumsum(count) - count, count)
        self.at = (code[self.order], place)
        self.shape, self.count, self.n_epochs = (len(count), max(count.max(), pf.TOP_K)), count, n_epochs
        self.batch, self.column = batch, column
        self.truth = self.table(column("is_truth").to_numpy(zero_copy_only=False), False)
        self.x = np.stack([self.table(column(c).to_numpy(), 0.0) for c in pf.FEATURES], axis=-1)

    def table(self, values: np.ndarray, empty) -> np.ndarray:
        out = np.full((*self.shape, *values.shape[1:]), empty, values.dtype)
        out[self.at] = values[self.order]
        return out

    def scores(self, name: str) -> np.ndarray:
        return self.table(self.column(name).to_numpy(), 0.0)

    def by_epoch(self, name: str) -> np.ndarray:
        return self.table(self.column(name).flatten().to_numpy().reshape(-1, self.n_epochs), 0.0)

    def values(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Value, scaled value and weight per epoch (``feedback.constant_reward_value``, ``blending.gate``)."""
        visits, lo, hi = (self.by_epoch(c) for c in ("visits", "q_lo", "q_hi"))
        q = self.scores("hidden")[..., None] * (1.0 - (1.0 - pf.LEARNING_RATE) ** visits)
        norm = np.where(hi <= lo, 0.5, (q - lo) / (hi - lo + 1e-10))
        return q, norm, pf.CONFIDENCE_MAX * (1.0 - np.exp(-visits / pf.CONFIDENCE_TAU_EXTERNAL))

    def best(self, scores: np.ndarray) -> np.ndarray:
        """Places of each user's first items by score; ties go to the smaller item."""
        width = self.shape[1]
        key = -np.rint(scores * 10.0**TIE_DIGITS).astype(np.int64) * width + np.arange(width)
        key[np.arange(width)[None, :] >= self.count[:, None]] = np.iinfo(np.int64).max
        some = np.argpartition(key, pf.TOP_K - 1, axis=1)[:, :pf.TOP_K]
        return np.take_along_axis(some, np.argsort(np.take_along_axis(key, some, 1), axis=1), 1)

    def drawn(self) -> Iterator[np.ndarray]:
        """Places of each user's first items by the hashes of an epoch, for all epochs."""
        words = self.column("hashes").flatten()
        chars = np.frombuffer(words.buffers()[2], "S32", len(words), words.offset * 32).view(">u8").astype(np.uint64)
        key = self.table(chars.reshape(-1, self.n_epochs, 4), np.iinfo(np.uint64).max)
        for i in range(self.n_epochs):
            yield np.lexsort(tuple(key[..., i, w] for w in (3, 2, 1, 0)), axis=1)[:, :pf.TOP_K]

    def measures(self, best: np.ndarray) -> list[np.ndarray]:
        """n_pred, tp, dcg and mean pairwise distance of lists (users, k)."""
        held = np.minimum(self.count, pf.TOP_K)
        inside = np.arange(pf.TOP_K)[None, :] < held[:, None]
        hit = np.take_along_axis(self.truth, best, 1) & inside
        x = np.take_along_axis(self.x, best[..., None], 1)
        a, b = np.triu_indices(pf.TOP_K, 1)
        apart = np.sqrt(((x[:, a] - x[:, b]) ** 2).sum(-1))
        both = inside[:, a] & inside[:, b]
        return [held, hit.sum(1), (hit / np.log2(np.arange(pf.TOP_K) + 2.0)).sum(1), (apart * both).sum(1) / np.maximum(both.sum(1), 1)]


def _lists_of(people: _People) -> Iterator[tuple[tuple[int, str], np.ndarray]]:
    """Lists of six methods, per epoch."""
    fixed = {m: people.best(people.scores(c)) for m, c in (("popularity", "popularity_pct"), ("topsis_only", "topsis"))}
    q, q_norm, weight = people.values()
    t_norm = people.scores("t_norm")
    for i, (epoch, drawn) in enumerate(zip(EPOCHS, people.drawn())):
        yield (epoch, "random"), drawn
        for method, best in fixed.items():
            yield (epoch, method), best
        yield (epoch, "rl_only"), people.best(q[..., i])
        for method, w in (("hybrid", pf.LAMBDA_Q), ("gated", weight[..., i])):
            yield (epoch, method), people.best(w * q_norm[..., i] + (1.0 - w) * t_norm)


def _blends_of(people: _People) -> Iterator[tuple[tuple[float], np.ndarray]]:
    """Lists of every blend weight at the last epoch."""
    q_norm, t_norm = people.values()[1][..., -1], people.scores("t_norm")
    for w in pf.LAMBDA_GRID:
        yield (float(w),), people.best(w * q_norm + (1.0 - w) * t_norm)


def _measured(scores: DataFrame, truth: DataFrame, lists: Callable[[_People], Iterator], names: str) -> DataFrame:
    """n_pred, n_truth, tp, f1, ndcg and ild of the lists of every user, ranked and measured where the
    user's candidates are. ``names`` are the columns that tell a user's lists apart."""
    kinds = T._parse_datatype_string(names).fields
    facts = [T.StructField("n_pred", T.LongType()), T.StructField("tp", T.LongType()), T.StructField("_dcg", T.DoubleType()), T.StructField("ild", T.DoubleType())]
    schema = T.StructType([scores.schema["user_id"], *kinds, *facts])
    arrow = to_arrow_schema(schema)

    def report(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        people = _People(rows, len(EPOCHS))
        for key, best in lists(people):
            same = [pa.array([v] * len(people.users), arrow.field(1 + i).type) for i, v in enumerate(key)]
            yield pa.record_batch([people.users, *same, *[pa.array(m) for m in people.measures(best)]], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the rows of the last user, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            user = rows.column("user_id")
            begin = pc.index(user, user[-1]).as_py()
            if begin:
                yield from report(rows.slice(0, begin))
            held = rows.slice(begin)
        if held is not None:
            yield from report(held)

    found = scores.mapInArrow(run, schema)
    sizes = truth.select("user_id", "item_id").distinct().groupBy("user_id").agg(F.count("*").alias("_t"))
    n_truth = F.coalesce("_t", F.lit(0).cast("long"))
    f1, ndcg = metrics.f1_and_ndcg(F.col("n_pred"), n_truth, F.col("tp"), F.col("_dcg"))
    return found.join(sizes, "user_id", "left").select(
        "user_id", *[k.name for k in kinds], "n_pred", n_truth.alias("n_truth"), "tp", f1.alias("f1"), ndcg.alias("ndcg"), "ild"
    )


def evaluate(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """F1, NDCG and ILD per (user, epoch, method) of lists inside each user's candidates."""
    hashes = [hash_key("random", F.col("user_id"), F.lit(e), F.col("item_id")) for e in EPOCHS]
    return _measured(scores.withColumn("hashes", F.array(*hashes)), truth, _lists_of, "epoch int, method string")


def blend_curve(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """F1 per (user, lambda_q) at the last epoch."""
    return _measured(scores, truth, _blends_of, "lambda_q double").drop("ild")
