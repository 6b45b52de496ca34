"""Learned values over a stream whose events arrive out of order.

``values.streaming_values`` applies what a micro-batch brings and cannot undo it. Here an
event waits in the state of its key until the watermark has passed its time; only then is it
folded for good. Events of a key are so folded in (ts, event_id) order over all batches, and
the value reported after each batch is the settled one with the waiting events folded on top,
also in order: the fold of everything seen so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from rankforge.functions.profiles import LEARNING_RATE

OUTPUT = "state int, item_id long, q double, visits long, settled long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedFold(StatefulProcessor):
    """Settled value of a key, and its events that are younger than the watermark."""

    def __init__(self, alpha: float):
        self.alpha = alpha

    def init(self, handle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "q double, visits long")
        self.waiting = handle.getListState("waiting", "at long, event_id long, reward double")

    def _fold(self, q: float, rewards: np.ndarray) -> float:
        kept = (1.0 - self.alpha) ** np.arange(len(rewards), -1, -1)  # what is left of q, and of each reward
        return float(q * kept[0] + self.alpha * float(kept[1:] @ rewards))

    def _settle(self, events: list[tuple], watermark_ms: int) -> tuple[float, int, list[tuple]]:
        """Fold the waiting events that the watermark has passed; the rest waits on."""
        q, n = self.settled.get() if self.settled.exists() else (0.0, 0)
        events.sort()
        due = sum(1 for at, _, _ in events if at <= watermark_ms * 1000)
        if due:
            q, n = self._fold(q, np.array([e[2] for e in events[:due]])), n + due
            self.settled.update((q, n))
        rest = events[due:]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        return q, n, rest

    def _held(self) -> list[tuple]:
        return [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new: list[tuple] = []
        for part in rows:
            new += zip(part["at"].tolist(), part["event_id"].tolist(), part["reward"].tolist())
        q, n, rest = self._settle(self._held() + new, timerValues.getCurrentWatermarkInMs())
        if rest:  # a key without further events is settled by its timer
            self.handle.registerTimer(rest[-1][0] // 1000 + 1)
        seen = self._fold(q, np.array([e[2] for e in rest])) if rest else q
        yield pd.DataFrame({"state": [key[0]], "item_id": [key[1]], "q": [seen], "visits": [n + len(rest)], "settled": [n]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        q, n, rest = self._settle(self._held(), timerValues.getCurrentWatermarkInMs())
        seen = self._fold(q, np.array([e[2] for e in rest])) if rest else q
        yield pd.DataFrame({"state": [key[0]], "item_id": [key[1]], "q": [seen], "visits": [n + len(rest)], "settled": [n]})

    def close(self) -> None:
        pass


def ordered_values(events: DataFrame, delay: str, alpha: float = LEARNING_RATE) -> DataFrame:
    """(state, item_id, q, visits, settled) of the keys that a micro-batch or the watermark touched.

    ``events`` is a stream with state, item_id, ts, event_id and reward. An event may arrive up
    to ``delay`` behind the youngest one seen in earlier batches; older ones are dropped by the
    watermark. ``q`` and ``visits`` hold all events seen, ``settled`` counts those that no later
    event can precede. A key keeps two numbers and its events of the last ``delay``. Start the
    stream with ``start``, which selects the state store that timers and lists need.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).select(
        "state", "item_id", "ts", F.unix_micros("ts").alias("at"), "event_id", F.col("reward").cast("double").alias("reward")
    )
    return timed.groupBy("state", "item_id").transformWithStateInPandas(
        OrderedFold(alpha), outputStructType=OUTPUT, outputMode="update", timeMode="eventTime"
    )


def start(spark, writer: DataStreamWriter) -> StreamingQuery:
    """Start a stream on the RocksDB state store and leave the session's setting as it was."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return writer.start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
