"""Learned values kept over a stream of feedback."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rankforge.functions.profiles import LEARNING_RATE

OUTPUT = "state int, item_id long, q double, visits long"
STATE = "q double, visits long"


def streaming_values(
    events: DataFrame, alpha: float = LEARNING_RATE, idle_ms: int | None = None
) -> DataFrame:
    """(state, item_id, q, visits) after every micro-batch.

    ``events`` is a stream with state, item_id, ts, event_id and reward. Events of
    a key are applied in (ts, event_id) order inside a micro-batch; an event that
    arrives in a later batch than a younger one is applied late. The memory per
    key is two numbers, and rows of a key arrive in Arrow batches. ``idle_ms``
    forgets keys without events for that long (processing time).
    """

    def update(
        key: tuple[int, int], batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        q, n = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        reward = rows["reward"].to_numpy(float)
        kept = (1.0 - alpha) ** np.arange(len(reward), -1, -1)  # what is left of q, and of each reward
        q = q * kept[0] + alpha * float(kept[1:] @ reward)
        n += len(reward)
        state.update((float(q), int(n)))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"state": [key[0]], "item_id": [key[1]], "q": [q], "visits": [n]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return events.select("state", "item_id", "ts", "event_id", "reward").groupBy(
        "state", "item_id"
    ).applyInPandasWithState(update, OUTPUT, STATE, "update", timeout)
