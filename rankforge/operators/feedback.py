"""Values learned from a feedback log."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.functions import profiles as pf
from rankforge.functions.scalars import dot
from rankforge.operators.ordering import ordered_position
from rankforge.operators.ranking import top_k
from rankforge.operators.utility import with_each

KEY = ("state", "item_id")


def rewards(
    events: DataFrame,
    truth: DataFrame | None = None,
    bonus: float | Column = 0.0,
    on: Sequence[str] = KEY,
) -> DataFrame:
    """Reward of each event. ``truth`` holds top-k lists by state; Spark broadcasts it
    only if it measures few of them."""
    engaged, converted = F.col("engaged"), F.col("engaged") & F.col("converted")
    reward = (
        F.lit(pf.REWARD_BASE)
        + F.when(engaged, pf.REWARD_ENGAGE).otherwise(0.0)
        + F.when(converted, pf.REWARD_CONVERT).otherwise(0.0)
    )
    if truth is None:
        return events.withColumn("reward", reward)
    flags = truth.select(*on).distinct().withColumn("_hit", F.lit(True))
    extra = bonus if isinstance(bonus, Column) else F.lit(float(bonus))
    joined = events.join(flags, list(on), "left")
    in_truth = F.coalesce("_hit", F.lit(False))
    return joined.withColumn("reward", reward + F.when(in_truth, extra).otherwise(0.0)).drop("_hit")


def visits(events: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    return events.groupBy(*by).agg(F.count("*").alias("visits"))


def _decay(alpha: float, steps: Column) -> Column:
    return F.pow(F.lit(1.0 - alpha), steps)


def q_values(
    events: DataFrame,
    by: Sequence[str] = KEY,
    order: Sequence[str] = ("ts", "event_id"),
    alpha: float = pf.LEARNING_RATE,
) -> DataFrame:
    """The fold q += alpha (reward - q) from zero, in event order, per key.

    The i-th of n rewards ends up with weight alpha (1 - alpha)^(n - i), so the
    fold is a position and a sum. Both are distributed inside a key.
    """
    placed = ordered_position(events, by, order, "_i", "_n")
    weight = alpha * _decay(alpha, F.col("_n") - F.col("_i"))
    return placed.groupBy(*by).agg(
        F.sum(weight * F.col("reward")).alias("q"), F.count("*").alias("visits")
    )


def snapshots(
    events: DataFrame,
    checkpoints: Sequence[int],
    by: Sequence[str] = KEY,
    clock: str = "event_no",
    alpha: float = pf.LEARNING_RATE,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """q and visits as of every checkpoint (events with ``clock`` <= checkpoint).
    ``clock`` is an event number, or a time with ``tie_break`` columns.

    Each event belongs to one interval between checkpoints and is folded there
    once; only the folded intervals, at most one per checkpoint and key, are
    repeated and combined.
    """
    marks = sorted(checkpoints)
    interval = sum(
        ((F.col(clock) > m).cast("int") for m in marks[1:]), (F.col(clock) > marks[0]).cast("int")
    )
    inside = events.filter(F.col(clock) <= marks[-1]).withColumn("_interval", interval)
    placed = ordered_position(inside, [*by, "_interval"], [clock, *tie_break], "_i", "_n")
    folded = placed.groupBy(*by, "_interval").agg(
        F.sum(alpha * _decay(alpha, F.col("_n") - F.col("_i")) * F.col("reward")).alias("_fold"),
        F.count("*").alias("_count"),
    )
    running = Window.partitionBy(*by).orderBy("_interval")
    folded = folded.withColumn("_seen", F.sum("_count").over(running))
    later = F.explode(F.sequence(F.col("_interval"), F.lit(len(marks) - 1))).alias("_at")
    spread = folded.select("*", later)
    last = F.max("_seen").over(Window.partitionBy(*by, "_at"))
    aged = spread.withColumn("_visits", last).withColumn(
        "_aged", F.col("_fold") * _decay(alpha, F.col("_visits") - F.col("_seen"))
    )
    mark = F.element_at(F.array(*[F.lit(int(m)).cast("long") for m in marks]), F.col("_at") + 1)
    return aged.groupBy(*by, mark.alias("checkpoint")).agg(
        F.sum("_aged").alias("q"), F.max("_visits").alias("visits")
    )


def constant_reward_value(utility: Column, visits: Column, alpha: float = pf.LEARNING_RATE) -> Column:
    """Value after ``visits`` updates with the same reward."""
    return utility * (1.0 - _decay(alpha, visits))


def exploration_rate(
    updates: Column, eps0: float = pf.EPS_INIT, decay: float = pf.EPS_DECAY, eps_min: float = pf.EPS_MIN
) -> Column:
    return F.greatest(F.lit(eps_min), eps0 * F.pow(F.lit(decay), updates))


def greedy_action(pool: DataFrame, q: DataFrame, by: Sequence[str] = ("state",)) -> DataFrame:
    """The pool item of highest value per state; items never tried count as zero."""
    joined = pool.join(q.select(*by, "item_id", "q"), [*by, "item_id"], "left")
    return top_k(joined.withColumn("q", F.coalesce("q", F.lit(0.0))), "q", 1, by).drop("rank")


def contextual_ridge(
    events: DataFrame, contexts: DataFrame, dim: int, state: str = "state", ridge: float = 1.0
) -> DataFrame:
    """Per state: theta = A^-1 b and A^-1 with A = ridge I + sum x x', b = sum r x.

    The context depends on the item only, so events collapse to counts and reward
    sums per (state, item). Each task adds its outer products in numpy, the
    partial sums are added per matrix cell, and the d x d solve sees d^2 numbers.
    """
    collapsed = (
        events.groupBy(state, "item_id")
        .agg(F.count("*").cast("double").alias("n"), F.sum("reward").alias("r"))
        .join(contexts.select("item_id", "x"), "item_id")
        .select(state, "n", "r", "x")
    )

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for s, part in pdf.groupby(state):
                x = np.stack(part["x"].to_numpy())
                a = (x * part["n"].to_numpy()[:, None]).T @ x
                b = part["r"].to_numpy() @ x
                flat = np.concatenate([a.ravel(), b])
                sums[s] = sums[s] + flat if s in sums else flat
        for s, flat in sums.items():
            yield pd.DataFrame({state: s, "cell": np.arange(flat.size), "v": flat})

    cells = (
        collapsed.mapInPandas(partial, f"{state} int, cell int, v double")
        .groupBy(state, "cell")
        .agg(F.sum("v").alias("v"))
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        flat = np.zeros(dim * dim + dim)
        flat[pdf["cell"].to_numpy()] = pdf["v"].to_numpy()
        a_inv = np.linalg.inv(flat[: dim * dim].reshape(dim, dim) + ridge * np.eye(dim))
        theta = a_inv @ flat[dim * dim :]
        return pd.DataFrame(
            {state: [int(pdf[state].iloc[0])], "theta": [theta.tolist()], "a_inv": [a_inv.ravel().tolist()]}
        )

    return cells.groupBy(state).applyInPandas(
        solve, f"{state} int, theta array<double>, a_inv array<double>"
    )


def contextual_scores(
    contexts: DataFrame, models: DataFrame, dim: int, alpha: float = 0.60, state: str = "state"
) -> DataFrame:
    """score = x . theta and ucb = score + alpha sqrt(x' A^-1 x) for every item and
    state (one model per state, a few states)."""
    scored = with_each(contexts.select("item_id", "x"), models)
    # A^-1 is symmetric: row i of it is the i-th slice of the flat array.
    ax = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: dot(F.slice("a_inv", i * dim + 1, F.lit(dim)), F.col("x"))
    )
    width = F.sqrt(F.greatest(dot(F.col("x"), ax), F.lit(0.0)))
    return scored.withColumn("score", dot(F.col("x"), F.col("theta"))).select(
        state, "item_id", "score", (F.col("score") + alpha * width).alias("ucb")
    )
