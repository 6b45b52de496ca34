"""The best targets of all items under a grid of profiles, without a row per item and profile.

The profiles of the grid are few (a parameter of the caller), the items many. A task takes its
items a block at a time and scores the block under all profiles in numpy, so what leaves a task
is one row of extremes per profile, and a few candidates per profile at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rankforge.functions import profiles as pf
from rankforge.operators.ranking import top_k
from rankforge.operators.utility import FEW

#: Items scored at once, and items per task.
BLOCK = 2048
ITEMS_PER_TASK = 100_000
#: Targets nearer than this may tie at the decimals that decide.
MARGIN = 1e-8


def _numbers(b: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of doubles; null becomes NaN."""
    return b.column(name).to_numpy(zero_copy_only=False)


class Grid:
    """The profiles as arrays; ``best`` is the largest category share under each."""
    def __init__(self, rows: list, categories: list[str | None]) -> None:
        self.brands, self.categories = [r.brand_pref for r in rows], [r.cat_affinity for r in rows]
        self.lo, self.hi, self.recency = (np.array([r[c] for r in rows], float)[:, None] for c in ("price_lo", "price_hi", "recency_weight"))
        self.best = self._shares(categories, self.categories, pf.DEFAULT_CATEGORY).max(1, keepdims=True) if categories else None

    @staticmethod
    def _shares(names: list, maps: list[dict], default: float) -> np.ndarray:
        return np.array([[default if m.get(n) is None else m[n] for n in names] for m in maps])

    def _looked_up(self, column: pa.Array, maps: list[dict], default: float) -> np.ndarray:
        coded = column.dictionary_encode(null_encoding="encode")
        return self._shares(coded.dictionary.to_pylist(), maps, default)[:, coded.indices.to_numpy(zero_copy_only=False)]

    def raw(self, b: pa.RecordBatch) -> np.ndarray:
        """``utility.hidden_utility`` before its scaling: a row per profile, a column per item."""
        price, pct = _numbers(b, "price"), _numbers(b, "recency_pct")
        brand = self._looked_up(b.column("brand"), self.brands, pf.DEFAULT_BRAND)
        share = self._looked_up(b.column("category"), self.categories, pf.DEFAULT_CATEGORY) / self.best
        fit = np.clip(1.0 - np.abs(price - (self.lo + self.hi) / 2.0) / ((self.hi - self.lo) / 2.0 + 1.0), 0.0, 1.0)
        return 0.45 * brand + 0.30 * fit + 0.15 * share + 0.10 * (pct * self.recency + (1.0 - self.recency) * 0.5)


def _scale(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lo, hi = ends
    return np.where(hi <= lo, 0.5, (x - lo) / (hi - lo + 1e-10))


def _best(target: np.ndarray, ids: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, float]:
    """Places of all items that may be among the k best, and the bound they reach; of equal
    targets only the k smallest ids."""
    known = np.flatnonzero(target >= floor - MARGIN)
    if len(known) > k:
        floor = max(floor, float(np.partition(target[known], -k)[-k]))
        known = known[target[known] >= floor - MARGIN]
    order = known[np.lexsort((ids[known], -target[known]))]
    at = np.arange(len(order))
    first = np.r_[True, target[order][1:] != target[order][:-1]][: len(order)]
    return order[at - np.maximum.accumulate(np.where(first, at, 0)) < k], floor


def best_targets(items: DataFrame, profiles: DataFrame, by: Sequence[str], k: int, alpha: float = pf.ALPHA) -> DataFrame:
    """(by, item_id, target, rank): the k items of the highest target of every profile of a
    grid. ``items`` carry item_id, brand, category, price, recency_pct and observable, and
    ``profiles`` the columns ``by`` and the fields of a profile. Equals ``top_k`` of
    ``blend_target`` of ``hidden_utility`` without noise over the product of both."""
    spark, by = items.sparkSession, list(by)
    few = profiles.limit(FEW + 1).collect()
    if len(few) > FEW:
        raise ValueError(f"more than {FEW} profiles")
    n = len(few)
    numbers = [F.col(c).cast("double").alias(c) for c in ("price", "recency_pct", "observable")]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-items.count() // ITEMS_PER_TASK))
    dealt = items.select("item_id", "brand", "category", *numbers).repartition(tasks, "item_id")
    # The largest share under each profile needs the names that have one, and whether there are others.
    names = sorted({c for r in few for c in r.cat_affinity})
    seen = items.groupBy(F.when(F.col("category").isin(*names), F.col("category")).alias("c")).count().collect()
    grid = spark.sparkContext.broadcast(Grid(few, [r.c for r in seen]))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                yield b.slice(at, BLOCK)

    def blended(b: pa.RecordBatch, ends: np.ndarray) -> np.ndarray:
        return alpha * _numbers(b, "observable") + (1.0 - alpha) * _scale(grid.value.raw(b), ends)

    def extremes(score: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lo, hi = np.full(n, np.nan), np.full(n, np.nan)
            for b in blocks(batches):
                x = score(b)
                lo, hi = np.fmin(lo, np.fmin.reduce(x, axis=1)), np.fmax(hi, np.fmax.reduce(x, axis=1))
            yield pa.record_batch([pa.array(np.arange(n)), *[pa.array(e, from_pandas=True) for e in (lo, hi)]], names=["g", "lo", "hi"])

        out = np.full((2, n, 1), np.nan)
        for r in dealt.mapInArrow(run, "g long, lo double, hi double").groupBy("g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
            out[:, r.g, 0] = [np.nan if e is None else e for e in (r.lo, r.hi)]  # a row per profile
        return out

    hidden = extremes(lambda b: grid.value.raw(b))
    ends = extremes(lambda b: blended(b, hidden))
    schema = T.StructType([T.StructField("_g", T.LongType()), items.schema["item_id"], T.StructField("target", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors = np.full(n, -np.inf)
        for b in blocks(batches):
            ids, target = b.column("item_id"), _scale(blended(b, hidden), ends)
            place = ids.to_numpy(zero_copy_only=False) if pa.types.is_integer(ids.type) else pc.rank(ids, tiebreaker="dense").to_numpy()
            order = np.where(np.isnan(target), -np.inf, target)  # nulls come last
            groups, here = [], []
            for g in np.flatnonzero((order >= floors[:, None] - MARGIN).any(1)):
                found, floors[g] = _best(order[g], place, k, floors[g])
                groups.append(np.full(len(found), g))
                here.append(found)
            if groups:
                g, at = np.concatenate(groups), np.concatenate(here)
                yield pa.record_batch([pa.array(g), ids.take(pa.array(at)), pa.array(target[g, at], from_pandas=True)], schema=arrow)

    keys = spark.createDataFrame([(g, *[r[c] for c in by]) for g, r in enumerate(few)], T.StructType([T.StructField("_g", T.LongType()), *[profiles.schema[c] for c in by]]))
    best = top_k(dealt.mapInArrow(candidates, schema), "target", k, ["_g"])
    return best.join(F.broadcast(keys), "_g").select(*by, "item_id", "target", "rank")
