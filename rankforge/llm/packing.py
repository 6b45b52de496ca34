"""Packing by concatenate and cut.

Pass one turns every document into token ids, in the order in which the table is
read, and writes them with the position inside the task. The totals of the tasks,
one number each, are summed up to global offsets. Pass two cuts the endless stream
at multiples of the sequence length; a document that crosses a cut leaves one
record on each side. Nothing is shuffled: both passes run where the rows are, and
padding is at most one sequence.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankforge.llm.shared import col, text_of
from rankforge.session import materialize

SEQUENCE = 2048
END = 1
TOKENIZER = "word_bpe_49k.json"
MARKS = b".,;:!?*#$%&|\"')("
#: Words and parts kept with their ids in a Python worker, and the longest one kept.
CACHED_WORDS, CACHED_PARTS, CACHED_BYTES = 400_000, 800_000, 64
_CACHES: dict[str, "WordIds"] = {}


class WordIds:
    """Ids of texts, word by word. The tokenizer treats white space as a border and
    nothing else, so a text's ids are the ids of its words in a row. It also cuts a run
    of marks off the letters before it, so many words share their letters' ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}  # whole words
        self.parts: dict[bytes, bytes] = {}  # letters and marks

    def __call__(self, text: str) -> bytes:
        words = text.encode().split()
        try:
            return b"".join([self.known[w] for w in words])
        except KeyError:
            if len(self.known) > CACHED_WORDS:
                self.known = {}
            if len(self.parts) > CACHED_PARTS:
                self.parts = {}
        known, parts = self.known, self.parts
        cut = {w: _letters_and_marks(w) for w in dict.fromkeys(words) if w not in known}
        new = [p for p in dict.fromkeys(p for both in cut.values() for p in both) if p not in parts]
        found = self.tokenizer.encode_batch_fast([p.decode() for p in new], add_special_tokens=False)
        fresh = {p: array("I", e.ids).tobytes() for p, e in zip(new, found)}
        ids = {w: b"".join([fresh[p] if p in fresh else parts[p] for p in both]) for w, both in cut.items()}
        parts.update((p, i) for p, i in fresh.items() if len(p) <= CACHED_BYTES)
        known.update((w, i) for w, i in ids.items() if len(w) <= CACHED_BYTES)
        return b"".join([ids[w] if w in ids else known[w] for w in words])


def _letters_and_marks(word: bytes) -> tuple[bytes, ...]:
    """The word, or its letters and the marks behind them. A special token stays whole.
    Only an ASCII word may be folded here: H with a line below is one letter in lower
    case alone."""
    low = word.lower() if word.isascii() else word
    letters = low.rstrip(MARKS)
    if b"<|" in word or not letters or not letters[-1:].isalnum():
        return (word,)
    return (letters, low[len(letters):]) if len(letters) < len(low) else (letters,)


def word_ids(path: str) -> WordIds:
    if path not in _CACHES:
        _CACHES[path] = WordIds(path)
    return _CACHES[path]


def _tokenized(path: str, end: int, schema: pa.Schema):
    """Rows of (key, text) to rows of (key, part, at, n, ids)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = word_ids(path), TaskContext.get().partitionId(), 0
        tail = np.asarray([end], "<u4").tobytes()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for lo in range(0, batch.num_rows, 256):  # ids are four times as large as texts at most
                ids = [np.frombuffer(encode(t.as_py()) + tail, "<u4") for t in texts[lo:lo + 256]]
                n = np.fromiter((len(i) for i in ids), np.int64, len(ids))
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                packed = [i.astype("<u2").tobytes() if i.max() < 65536 else i.tobytes() for i in ids]
                yield pa.record_batch([
                    keys[lo:lo + 256], pa.array(np.full(len(n), part), pa.int32()), pa.array(starts), pa.array(n), pa.array(packed, pa.binary()),
                ], schema=schema)

    return run


def _cut(length: int, with_ids: bool, schema: pa.Schema):
    """Rows of (key, at, n, ids) with global positions to one row per piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Small parts of a batch, as ids are larger than all else.
        for batch in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
            at, n = (batch.column(i).to_numpy() for i in (1, 2))
            first, pieces = at // length, (at + n - 1) // length - at // length + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            seq = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            lo, hi = np.maximum(at[doc], seq * length), np.minimum((at + n)[doc], (seq + 1) * length)
            crcs, parts, current, ids = np.empty(len(doc), np.int64), [], -1, None
            for j, (d, a, b) in enumerate(zip(doc.tolist(), (lo - at[doc]).tolist(), (hi - at[doc]).tolist())):
                if d != current:
                    raw, current = batch.column(3)[d].as_py(), d
                    ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n[d] else "<u4").astype("<u4")
                piece = ids[a:b].tobytes()
                crcs[j] = zlib.crc32(piece)
                if with_ids:
                    parts.append(piece)
            arrays = [batch.column(0).take(pa.array(doc)), *map(pa.array, (lo - at[doc], hi - lo, crcs, n[doc], seq, lo - seq * length))]
            yield pa.record_batch(arrays + [pa.array(parts, pa.binary())] * with_ids, schema=schema)

    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def pack(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = SEQUENCE, end: int = END, with_ids: bool = True
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset
    and, with ``with_ids``, the piece's ids (little-endian 32 bits).

    Sequences are full but for the last one. ``tokenizer`` is the path of the tokenizer
    file, which every executor has.

    Defined cases: a null or empty text is its end id alone; repeated rows and rows with
    a repeated or null key are packed one by one; an empty table gives no rows; other
    columns are ignored. A text is tokenized whole, whatever its length.
    """
    kind = docs.schema[key].dataType
    made = T.StructType([T.StructField("key", kind), T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()),
                         T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
    tokens = materialize(docs.select(col(key).alias("key"), text_of(text).alias("text")).mapInArrow(_tokenized(tokenizer, end, _arrow(made)), made))
    # One row per task of pass one.
    totals = tokens.groupBy("part").agg(F.sum("n").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    placed = tokens.join(F.broadcast(offsets), "part").select("key", (F.col("_base") + F.col("at")).alias("at"), "n", "ids")
    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    out = T.StructType([T.StructField(key, kind), *[T.StructField(c, T.LongType()) for c in names], *[T.StructField("ids", T.BinaryType())] * with_ids])
    return placed.mapInArrow(_cut(length, with_ids, _arrow(out)), out)


def sequences(pieces: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """(sequence_id, n_tokens, ids): the ids of every sequence, padded with id 0."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most one piece per token
    joined = F.aggregate(ordered, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids")).withColumn(
        "ids", F.rpad("ids", 4 * length, b"\0")
    )
