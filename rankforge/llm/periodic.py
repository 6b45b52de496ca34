"""Runs of periodic repetition, by maximal-pair enumeration.

A maximal pair is a stretch of words that occurs at two places, with different words (or
the edge of the text) before and after the two. Two places that are ``q`` words apart, with
a stretch several times as long as ``q``, overlap: together they cover a run of period
``q``, and as the pair is maximal the run can't be extended either way. A pair at a
multiple of the period covers the same run; of equal runs the least period stays.

Suffixes are ordered by prefix doubling, for all texts of a slice together: the text is
part of the order, so suffixes of two texts never mix, and a suffix leaves the work as
soon as no other of its text begins like it. The lengths of common prefixes form a tree of
intervals, built bottom-up with a stack. An interval holds the places of its suffixes in
order, all together and by the word before them. Where two children meet, the places of
the smaller one look for places of the other within the allowed distance that have another
word before, and pass over stretches with the same word before in one leap.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rankforge.llm.shared import col, text_of, words_of

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Words whose suffixes are ordered at once; a longer text is a slice of its own.
SLICE = 300_000
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"

Run = tuple[int, int, int]  # start, length, period


# suffixes

def _inside(places: np.ndarray, own: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether places lie in the texts ``own``."""
    return (places < len(text)) & (text[np.minimum(places, len(text) - 1)] == own)


def repeated_suffixes(words: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the suffixes that share their first ``least`` words with another suffix of
    their text, in suffix order, and the number of words shared with the suffix before
    (0 where a group begins). ``words`` are numbers, ``text`` their texts in ascending order."""
    n, head = len(words), least.bit_length() - 1
    codes = text * (int(words.max(initial=0)) + 1) + words
    live = np.argsort(codes)
    # levels[k][i]: equal for two suffixes of a text exactly where their first 2^k words are
    levels, rank, old, key, found = [], np.zeros(n, np.int64), np.zeros(n, np.int64), codes[live], live[:0]
    while True:
        first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.empty(0, bool)
        start, group = np.flatnonzero(first), np.cumsum(first) - 1
        size = np.diff(np.r_[start, len(key)])
        whole = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], np.arange(len(old)), 0)) if len(old) else old
        rank = rank.copy()
        rank[live] = old + (start[group] - whole)
        levels.append(rank)
        live = live[size[group] > 1]
        if len(levels) - 1 == head:
            found = live
        if not len(live):
            break
        step = 1 << (len(levels) - 1)
        follows = np.where(_inside(live + step, text[live], text), rank[np.minimum(live + step, n - 1)], -1)
        key = rank[live] * (n + 1) + follows + 1
        order = np.argsort(key)
        live, key = live[order], key[order]
        old = rank[live]
    if not len(found):
        return found, found
    found = found[np.argsort(rank[found])]
    shared = np.r_[0, _shared(found[:-1], found[1:], levels, text)]
    shared[shared < least] = 0
    keep = shared > 0
    keep[:-1] |= keep[1:]
    return found[keep], shared[keep]


def _shared(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray], text: np.ndarray) -> np.ndarray:
    """The number of first words that suffixes have in common, by falling powers of two."""
    own, other, a, b = text[a], text[b], a.copy(), b.copy()
    out, last = np.zeros(len(a), np.int64), len(text) - 1
    for k in range(len(levels) - 1, -1, -1):
        same = (own == other) & _inside(a, own, text) & _inside(b, own, text)
        same &= levels[k][np.minimum(a, last)] == levels[k][np.minimum(b, last)]
        for x in (a, b, out):
            x[same] += 1 << k
    return out


# maximal pairs

class _Interval:
    """Places in order: all, and by the word before."""

    __slots__ = ("places", "by")

    def __init__(self, place: int, before: int):
        self.places, self.by = [place], {before: [place]}

    def take(self, other: _Interval) -> None:
        if len(other.places) == 1:
            insort(self.places, other.places[0])
        else:
            self.places += other.places
            self.places.sort()
        for before, places in other.by.items():
            own = self.by.get(before)
            if own is None:
                self.by[before] = places
            elif len(places) == 1:
                insort(own, places[0])
            else:
                own += places
                own.sort()

    def others(self, before: int, low: int, high: int) -> Iterator[int]:
        """Places from ``low`` to ``high`` with another word before."""
        places, own = self.places, self.by.get(before, ())
        k, end = bisect_left(places, low), len(places)
        m = bisect_left(own, low)
        while k < end and places[k] <= high:
            if m == len(own) or places[k] != own[m]:
                yield places[k]
                k += 1
                continue
            reach, most = 1, min(end - k, len(own) - m)  # equal up to an index: equal at all before
            while reach < most and places[k + reach] == own[m + reach]:
                reach = min(2 * reach, most)
            low_at, high_at = reach // 2, reach
            while low_at < high_at:
                middle = (low_at + high_at) // 2
                if middle < most and places[k + middle] == own[m + middle]:
                    low_at = middle + 1
                else:
                    high_at = middle
            k, m = k + low_at, m + low_at


def _meet(a: _Interval, b: _Interval, shared: int, before, least_length: int, least_exponent: int, out: dict) -> _Interval:
    """One interval of two whose suffixes have ``shared`` words in common; the runs of their
    pairs go to ``out``: (start, length) -> least period."""
    small, big = (a, b) if len(a.places) <= len(b.places) else (b, a)
    reach = shared // (least_exponent - 1)
    low, high = big.places[0] - reach, big.places[-1] + reach
    for place in small.places:
        if low <= place <= high:
            for other in big.others(before[place], place - reach, place + reach):
                period = abs(place - other)
                if shared + period >= least_length:
                    run = (min(place, other), shared + period)
                    out[run] = min(period, out.get(run, period))
    big.take(small)
    return big


def maximal_pair_runs(places: list[int], shared: list[int], before, least_length: int, least_exponent: int) -> dict[tuple[int, int], int]:
    """(start, length) -> period of all runs among suffixes in order; ``before[place]`` is the
    word before a place, a number of its own at the edge of a text."""
    out: dict[tuple[int, int], int] = {}
    open_, depths = [], []
    for place, depth in zip([*places, -1], [*shared, 0]):
        while depths and depths[-1] >= depth:
            b, a = open_.pop(), open_.pop()
            open_.append(_meet(a, b, depths.pop(), before, least_length, least_exponent, out))
        if depth:
            depths.append(depth)
        else:
            open_ = []
        if place >= 0:
            open_.append(_Interval(place, before[place]))
    return out


def runs_of_texts(texts: list[list[bytes]], least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[list[Run]]:
    """The runs of each text, by start and period."""
    numbers: dict[bytes, int] = {}
    for words in texts:
        for w in words:
            numbers.setdefault(w, len(numbers))
    sizes = np.array([len(words) for words in texts], np.int64)
    starts = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    ids = np.fromiter((numbers[w] for words in texts for w in words), np.int64, int(starts[-1]))
    out: list[list[Run]] = [[] for _ in texts]
    if not len(ids):
        return out
    # A run of period q has a pair of length - q shared words: the least number for any q.
    least = min(max((least_exponent - 1) * q, least_length - q) for q in range(1, least_length + 1))
    text = np.repeat(np.arange(len(texts)), sizes)
    places, shared = repeated_suffixes(ids, text, least)
    before = np.r_[-1, ids[:-1]]
    before[starts[:-1][sizes > 0]] = -1  # one suffix of a text has no word before it
    near = before[places].tolist()
    found = maximal_pair_runs(places.tolist(), shared.tolist(), dict(zip(places.tolist(), near)), least_length, least_exponent)
    for (start, length), period in found.items():
        at = int(text[start])
        out[at].append((start - int(starts[at]), length, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those behind the first period of a run, joined by spaces."""
    if runs:
        dropped = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            dropped[start + period] += 1
            dropped[start + length] -= 1
        words = [w for w, d in zip(words, np.cumsum(dropped[:-1]).tolist()) if not d]
    return b" ".join(words)


def find_runs(
    docs: DataFrame, key: str = "doc_id", text: str | Column = "text", least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT,
) -> DataFrame:
    """One row per input row: key, n_words, runs (start, length, period; by start, then
    period) and collapsed (the text with each run cut to its first period, its words joined
    by one space).

    A run is a stretch of words with smallest period q, of ``least_length`` words or more
    and ``least_exponent`` times q or more, that can't be extended with that period. Texts
    are worked on where they are read; nothing is shuffled.

    Defined cases: a null text is the empty text and has no runs; rows that repeat and rows
    with a null key are worked on one by one; runs may overlap, and a word goes if any of
    them drops it; other columns are ignored; an empty table gives no rows.
    """
    if least_exponent < 2:
        raise ValueError("runs are found from two periods on")
    runs_type = T.StructType.fromDDL(f"runs {RUNS}")["runs"].dataType
    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", runs_type), T.StructField("collapsed", T.StringType()),
    ])
    arrow = to_arrow_schema(schema)

    def rows(keys: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        runs = runs_of_texts(texts, least_length, least_exponent)
        named = [[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs]
        whole = [collapsed(w, r).decode() for w, r in zip(texts, runs)]
        columns = [pa.array([len(w) for w in texts]), pa.array(named, arrow[2].type), pa.array(whole, arrow[3].type)]
        return pa.record_batch([keys, *columns], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, first, total = [], 0, 0
            for i in range(b.num_rows):
                words = b.column(1)[i].as_py().encode().split()
                if texts and total + len(words) > SLICE:
                    yield rows(b.column(0)[first:i], texts)
                    texts, first, total = [], i, 0
                texts.append(words)
                total += len(words)
            if texts:
                yield rows(b.column(0)[first:], texts)

    return docs.select(col(key).alias(key), text_of(text).alias("_text")).mapInArrow(run, schema)


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with the end of every tenth text (by crc32 of the key) made periodic: from
    a word that the key names on, the first words there repeat."""
    c = F.col
    h = F.crc32(col(key).cast("string").cast("binary"))
    cut = docs.select(col(key).alias(key), text_of(text).alias("_text"), h.alias("_h"), F.floor(h / 10).alias("_g"),
                      F.when(h % 10 == 0, words_of(text)).alias("_words"))
    n = F.size("_words")
    spots = cut.withColumn("_n", n).withColumn("_a", F.when(n > 0, c("_g") % n).cast("int"))
    spots = spots.withColumn("_p", (1 + F.floor((c("_n") - c("_a")) / (3 + c("_g") % 8))).cast("int"))
    times = F.ceil((c("_n") - c("_a")) / c("_p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("_words", c("_a") + 1, c("_p")), times)), F.lit(1), c("_n") - c("_a"))
    made = F.array_join(F.concat(F.slice("_words", F.lit(1), c("_a")), tail), " ")
    return spots.select(key, F.when(c("_n") > 0, made).otherwise(c("_text")).alias("text"))


def run_digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``find_runs`` to counts, the run with the greatest length over period (ties: the
    smallest start, then period) and digests. Quotients are exact below 10^8 words."""
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-(r["length"] / r["period"])).alias("e"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"),
    )))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.withColumn("_best", best).select(
        key, F.size("runs").cast("long").alias("n_runs"), *[F.col("_best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
