"""Quality classifier: naive Bayes support vectors.

A document is the set of its n-grams: byte trigrams, and runs of word shapes (the
classes of a word's characters, its last class, whether it repeats the word before).
Every indicator is scaled by the log of the ratio of its rates in good and bad
documents, vectors get unit length, and a linear hinge-loss model is fitted by dual
coordinate descent. A held-back fifth of the sample turns margins into
probabilities.

The fit takes a bounded sample of labelled rows (``max_labelled``, both classes in
equal numbers as far as they go), so one task fits it whatever the table's size.
Scores are computed for all documents where they are; no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rankforge.llm.shared import free_name, col, fold, text_of

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
MAX_LABELLED = 8000
TRIGRAMS, SHAPES = 57_344, 8192
FEATURES = TRIGRAMS + SHAPES
SMOOTHING, COST, EPOCHS = 1.0, 1.0, 20


def _classes() -> np.ndarray:
    """A bit for each byte: space 0, lower 1, upper 2, digit 4, sentence mark 8, other mark 16, beyond ASCII 32."""
    out = np.full(256, 16, np.uint8)
    for name, bit in ((b" \t\n\x0b\x0c\r", 0), (b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 4), (b".,;:?!'\"()-", 8)):
        out[list(name)] = bit
    out[128:] = 32
    return out


_CLASS = _classes()
_MIX = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


def features(text: str) -> np.ndarray:
    """The sorted numbers of a text's n-grams."""
    raw = np.frombuffer(text.encode(), np.uint8)
    here = np.zeros(FEATURES, bool)
    for lo in range(0, len(raw), 1 << 20):  # bounds the memory of very long texts
        b = raw[lo:lo + (1 << 20) + 2].astype(np.uint32)
        if len(b) > 2:
            code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
            here[(code >> np.uint32(8)) % np.uint32(TRIGRAMS)] = True
    kinds = _CLASS[raw]
    inside = kinds > 0
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    if len(starts):
        ends = np.flatnonzero(inside & ~np.r_[inside[1:], False])
        mask = np.bitwise_or.reduceat(kinds, starts).astype(np.uint32)
        last = np.log2(kinds[ends]).astype(np.uint32)
        # Words are told apart by a sum over their bytes and their length: enough for "same as before".
        name = np.add.reduceat(np.where(inside, _MIX[raw], np.uint64(0)), starts) + (ends - starts).astype(np.uint64)
        same = np.r_[False, name[1:] == name[:-1]].astype(np.uint32)
        shape = mask << 4 | last << 1 | same
        here[TRIGRAMS + shape * np.uint32(2654435761) % np.uint32(SHAPES)] = True
        pair = shape[:-1] << 10 | shape[1:]
        here[TRIGRAMS + (pair * np.uint32(2246822519) >> np.uint32(7)) % np.uint32(SHAPES)] = True
    return np.flatnonzero(here)


@dataclass(frozen=True)
class Model:
    ratios: np.ndarray  # log-count ratio of every feature
    weights: np.ndarray
    slope: float
    offset: float

    def margin(self, at: np.ndarray) -> float:
        r = self.ratios[at]
        norm = float(r @ r) ** 0.5
        return float(r @ self.weights[at]) / norm if norm else 0.0

    def score(self, at: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(at) + self.offset, -30, 30))))


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    counts = np.full((2, FEATURES), SMOOTHING)
    for at, y in zip(rows, good):
        counts[int(y), at] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, costs: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> np.ndarray:
    """Weights of the hinge-loss model min |w|^2/2 + sum cost * max(0, 1 - sign * w.x)."""
    w, dual = np.zeros(FEATURES), np.zeros(len(rows))
    square = np.array([float(v @ v) for v in values])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(rows)):
            if not square[i]:
                continue
            gradient = signs[i] * float(w[rows[i]] @ values[i]) - 1
            new = min(max(dual[i] - gradient / square[i], 0.0), costs[i])
            if new != dual[i]:
                w[rows[i]] += (new - dual[i]) * signs[i] * values[i]
                most = max(most, abs(new - dual[i]))
                dual[i] = new
        if most < 1e-3:
            break
    return w


def calibrated(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins, with smoothed targets."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(good, 0.5 / max(n1, 1), 0.5 / max(n0, 1)) * len(good)  # classes count alike
    x = np.c_[margins, np.ones(len(margins))]
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), x.T @ (weight * (target - p)) - 1e-4 * beta)
        beta = beta + step
        if abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(rows: list[np.ndarray], good: np.ndarray) -> Model:
    """Without both classes every text gets the rate of the class there is, or one half."""
    good = np.asarray(good, bool)
    if not good.any() or good.all():
        rate = (good.sum() + 1) / (len(good) + 2)
        return Model(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, float(np.log(rate / (1 - rate))))
    held = np.arange(len(rows)) % 5 == 4
    if len(set(good[~held])) < 2 or len(set(good[held])) < 2:
        held = np.zeros(len(rows), bool)
    used = np.flatnonzero(~held)
    ratios = log_count_ratios([rows[i] for i in used], good[used])
    values = [(r / n if (n := float(r @ r) ** 0.5) else r) for r in (ratios[rows[i]] for i in used)]
    share = good[used].mean()
    costs = COST * np.where(good[used], 0.5 / share, 0.5 / (1 - share)) * 10
    weights = dual_coordinate_descent([rows[i] for i in used], values, np.where(good[used], 1.0, -1.0), costs)
    model = Model(ratios, weights, 1.0, 0.0)
    check = np.flatnonzero(held) if held.any() else used
    slope, offset = calibrated(np.array([model.margin(rows[i]) for i in check]), good[check])
    return Model(ratios, weights, max(slope, 0.0), offset)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on at most ``max_labelled`` labelled rows outside the held-out fold, chosen by
    a hash of the key. Of several labels of a key the highest counts; null labels and
    keys are not used."""
    known = (
        labels.filter(col(label).isNotNull() & col(key).isNotNull() & (fold(key, FOLDS) != HELD_OUT))
        .groupBy(col(key).alias("_key")).agg(F.max(col(label)).cast("int").alias("_good"))
    )
    order = [F.xxhash64("_key"), F.col("_key")]
    picked = None
    for y in (0, 1):
        part = known.filter(F.col("_good") == y).orderBy(*order).limit(max_labelled // 2)
        picked = part if picked is None else picked.unionByName(part)
    chosen = docs.select(col(key).alias("_key"), text_of(text).alias("_text")).join(F.broadcast(picked), "_key")  # at most max_labelled rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [features(t.as_py()).astype("<u2").tobytes() for t in b.column(1)]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(at, pa.binary())], names=["k", "good", "at"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, rows = [], []
        for b in batches:
            good += b.column(1).to_pylist()
            rows += [np.frombuffer(x.as_py(), "<u2").astype(np.int32) for x in b.column(2)]
        m = fit(rows, np.array(good, bool))
        yield pa.record_batch([pa.array([x.astype("<f4").tobytes()]) for x in (m.ratios, m.weights)] + [pa.array([m.slope]), pa.array([m.offset])],
                              names=["ratios", "weights", "slope", "offset"])

    kind = docs.schema[key].dataType.simpleString()
    found = (
        chosen.select("_key", "_text", "_good").mapInArrow(extract, f"k {kind}, good int, at binary")
        .repartition(1).sortWithinPartitions(F.xxhash64("k"), "k", "at")
        .mapInArrow(fitted, "ratios binary, weights binary, slope double, offset double").first()
    )
    if found is None:  # no labelled rows, no task
        return fit([], np.zeros(0, bool))
    return Model(np.frombuffer(found["ratios"], "<f4").astype(float), np.frombuffer(found["weights"], "<f4").astype(float), found["slope"], found["offset"])


def with_score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with one more column, the score of ``text`` between 0 and 1."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    arrow, at = to_arrow_schema(schema), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score(features(t.as_py() or "")) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], schema=arrow)

    return docs.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per input row: key, held_out, score, predicted.

    Defined cases: a null or empty text has no n-grams and gets the score of margin
    zero; without labels every score is one half; rows that repeat are scored one by one;
    an empty table gives no rows; other columns are ignored.
    """
    model = train(docs, labels, key, text, max_labelled=max_labelled)
    scored = with_score(docs.select(col(key).alias("key"), text_of(text).alias("text")), model)
    return scored.select(
        F.col("key").alias(key), (fold("key", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches ``threshold``, with their own columns, whatever their
    names. Null and empty texts have the score of margin zero."""
    score = free_name("score", docs.columns)
    return with_score(docs, train(docs, labels, key, text), text, score).filter(F.col(score) >= threshold).select(*docs.columns)
