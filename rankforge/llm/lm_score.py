"""Language-model scores by deleted interpolation.

A token is a lower-cased word or the end of its text. Its probability after the token
before it mixes three estimates: the pair's share of its context, the token's share
of all tokens, and one over the number of known tokens plus one. The mixture weights
depend on how often the context was seen, and expectation maximisation learns them
on held-out counts: every training occurrence is judged by the counts that are left
when it is deleted.

Counts of all training texts are gathered without a row per token. Each task turns
its texts into chunks of some hundred thousand tokens and counts the different tokens and pairs
in a chunk once. Sorted hashes, packed, go to buckets by their leading bits; a bucket
adds up its share of all chunks and sends the totals back in the same order, so a
frequent word is one number per chunk wherever it goes, and no bucket is larger than
another. Tokens have 64-bit hashes, pairs ``PAIR_BITS``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rankforge.llm.shared import col, fold, text_of
from rankforge.session import materialize

FOLDS, HELD_OUT = 5, 1
CHUNK = 400_000  # tokens of a chunk
BUCKET = 2_000_000  # tokens of the corpus for each bucket
PAIR_BITS = 48
SLICE = 1 << 20  # bytes of a text that are split at once
ROUNDS = 60
END, START = b"", b"\n"  # no word is empty or white space


# packed integers

def packed(values: np.ndarray) -> bytes:
    """Unsigned integers, byte by byte in planes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


# texts to chunks

class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def word_slices(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text in slices that bound the memory of very long ones."""
    at = 0
    while at < len(raw):
        end = at + SLICE
        if end < len(raw):  # on to the next white space
            while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
                end += 1
        yield raw[at:end].split()
        at = end


def _chunks(size: int, schema: pa.Schema):
    """Rows of (key, train, text) to one row per chunk: its documents and their tokens as
    numbers, and the hash of every number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        numbers, ids, keys, train, sizes, total = _Numbers({END: 0, START: 1}), [], [], [], [], 0

        def chunk() -> pa.RecordBatch:
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in numbers), np.uint64, len(numbers))
            values = [[part << 32 | made], [pa.concat_arrays(keys)], [train], [sizes], [packed(np.concatenate(ids))], [packed(hashes)]]
            return pa.record_batch([
                pa.ListArray.from_arrays(pa.array([0, len(train)], pa.int32()), v[0]) if isinstance(v[0], pa.Array) else pa.array(v, f.type)
                for v, f in zip(values, schema)
            ], schema=schema)

        for b in batches:
            for i in range(b.num_rows):
                words = [list(map(numbers.__getitem__, s)) for s in word_slices(b.column(2)[i].as_py().encode().lower())]
                words.append([0])
                doc = np.concatenate([np.asarray(w, np.uint32) for w in words])
                ids.append(doc)
                keys.append(b.column(0)[i:i + 1])
                train.append(b.column(1)[i].as_py())
                sizes.append(len(doc))
                total += len(doc)
                if total >= size:
                    yield chunk()
                    made += 1
                    numbers, ids, keys, train, sizes, total = _Numbers({END: 0, START: 1}), [], [], [], [], 0
        if sizes:
            yield chunk()

    return run


def pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = before * np.uint64(0x9E3779B97F4A7C15) ^ (after << np.uint64(31) | after >> np.uint64(33)) * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(32)) >> np.uint64(64 - PAIR_BITS)


def _tokens(sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The number of the token before each token; START at the head of a text."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(sizes) - sizes] = 1
    return before


def _counted(kind: int, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray, train: np.ndarray):
    """Sorted keys of a chunk, the place of every token's key, and how often training texts
    have each key. kind 0: tokens, kind 1: pairs."""
    words, keys = ids.astype(np.int64), hashes
    if kind:
        keys = pair_keys(hashes[_tokens(sizes, ids)], hashes[ids])
        keys, words = np.unique(keys, return_inverse=True)
    else:
        keys, place = np.unique(keys, return_inverse=True)
        words = place[words]
    return keys, words, np.bincount(words, weights=np.repeat(train, sizes), minlength=len(keys)).astype(np.int64)


def _bucket(keys: np.ndarray, kind: int, buckets: int) -> np.ndarray:
    """Rises with the key, so buckets in order hold the keys in order."""
    return ((keys >> np.uint64((PAIR_BITS if kind else 64) - 32)) * np.uint64(buckets)) >> np.uint64(32)


def _read(row: dict):
    sizes = np.asarray(row["sizes"], np.int64)
    return sizes, unpacked(row["ids"]).astype(np.int64), np.asarray(row["train"], bool)


def _emit(buckets: int):
    """Chunks to (chunk, kind, bucket, keys, counts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                sizes, ids, train = _read(row)
                for kind in (0, 1):
                    keys, _, counts = _counted(kind, unpacked(row["hashes"]), sizes, ids, train)
                    at = _bucket(keys, kind, buckets)
                    cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True])
                    out = []
                    for a, z in zip(cuts[:-1], cuts[1:]):
                        step = np.diff(keys[a:z], prepend=np.uint64(0))
                        out.append((row["chunk"], kind, int(at[a]), packed(step), packed(counts[a:z])))
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                                          names=["chunk", "kind", "bucket", "keys", "counts"])

    return run


def _merge(pdf):
    """All rows of a bucket to each chunk's totals in the order of its keys. The first row
    also has the number of different keys in training texts and the sum of their counts."""
    import pandas as pd

    keys = [np.cumsum(unpacked(k), dtype=np.uint64) for k in pdf["keys"]]
    counts = np.concatenate([unpacked(c) for c in pdf["counts"]]).astype(np.int64)
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(place, weights=counts).astype(np.int64)
    cuts = np.cumsum([0, *map(len, keys)])
    first = np.arange(len(pdf)) == 0
    return pd.DataFrame({
        "chunk": pdf["chunk"], "kind": pdf["kind"], "bucket": pdf["bucket"], "totals": [packed(total[place[a:z]]) for a, z in zip(cuts[:-1], cuts[1:])],
        "types": np.where(first, (total > 0).sum(), 0), "tokens": np.where(first, total.sum(), 0),
    })


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their totals to per-token counts: of the token before, the token, the pair."""
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1).to_pylist()[0]
            sizes, ids, train = _read(row)
            hashes, out = unpacked(row["hashes"]), []
            for kind in (0, 1):
                total = np.concatenate([unpacked(t["totals"]) for t in row["found"] if t["kind"] == kind]).astype(np.int64)
                if kind == 0:
                    _, place = np.unique(hashes, return_inverse=True)
                    count = total[place]
                    count[1] = count[0]  # as many texts start as end
                    out += [count]
                else:
                    out += [total[_counted(1, hashes, sizes, ids, train)[1]]]
            yield pa.record_batch([b.column(0)[i:i + 1], b.column(1)[i:i + 1], b.column(2)[i:i + 1], b.column(3)[i:i + 1], b.column(4)[i:i + 1],
                                   *[pa.array([packed(x)], pa.binary()) for x in out]], names=["chunk", "keys", "train", "sizes", "ids", "counts", "pairs"])


# mixture weights

PRIOR = 10.0  # occurrences with the weights of all buckets that each bucket starts from
STEPS = 4  # bins of a probability for each halving
BINS = 256
CONTEXTS = 40


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one plus the whole logarithm of its count."""
    return np.minimum(np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0), CONTEXTS - 1).astype(np.int64)


def _bin(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.round(-STEPS * np.log2(np.maximum(p, 1e-300))) + 1, 1, BINS - 1), 0).astype(np.int64)


def _counts_of(row: dict):
    sizes, ids, train = _read(row)
    count, pair = unpacked(row["counts"]).astype(np.int64), unpacked(row["pairs"]).astype(np.int64)
    return sizes, train, count[_tokens(sizes, ids)], count[ids], pair


def _deleted(tokens: int):
    """Histogram of the training occurrences by context bucket and the bins of what the pair
    and the token have left when the occurrence is deleted: (code, n, sum of each)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                sizes, train, before, token, pair = _counts_of(b.slice(i, 1).to_pylist()[0])
                own = np.repeat(train, sizes)
                before, token, pair = before[own] - 1, token[own] - 1, pair[own] - 1
                two, one = pair / np.maximum(before, 1), token / max(tokens - 1, 1)
                code, place = np.unique((context_bucket(before) * BINS + _bin(two)) * BINS + _bin(one), return_inverse=True)
                sums = [np.bincount(place, x, len(code)) for x in (np.ones(len(two)), two, one)]
                yield pa.record_batch([pa.array(x) for x in (code, *sums)], names=["code", "n", "two", "one"])

    return run


def mixture_weights(code: np.ndarray, n: np.ndarray, two: np.ndarray, one: np.ndarray, types: int, rounds: int = ROUNDS) -> np.ndarray:
    """(context bucket, estimate) weights of the pair, the token and the uniform estimate.
    Every bucket leans on the weights of all of them together as on ``PRIOR`` occurrences."""
    where, p = code // (BINS * BINS), np.stack([two / n, one / n, np.full(len(code), 1 / (types + 1))], axis=1)

    def learned(rows: np.ndarray, prior: np.ndarray) -> np.ndarray:
        w = np.array([1 / 3, 1 / 3, 1 / 3])
        for _ in range(rounds):
            share = p[rows] * w
            share /= share.sum(axis=1, keepdims=True)
            w = prior + (share * n[rows][:, None]).sum(axis=0)
            w /= w.sum()
        w = np.maximum(w, (0.0, 1e-6, 1e-6))
        return w / w.sum()

    everywhere = learned(np.arange(len(code)), np.zeros(3)) if len(code) else np.array([0.0, 0.0, 1.0])
    return np.array([learned(np.flatnonzero(where == c), PRIOR * everywhere) for c in range(CONTEXTS)])


def _scored(tokens: int, types: int, weights: np.ndarray, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                sizes, train, before, token, pair = _counts_of(b.slice(i, 1).to_pylist()[0])
                w = weights[context_bucket(before)]
                mixed = w[:, 0] * pair / np.maximum(before, 1) + w[:, 1] * token / max(tokens, 1) + w[:, 2] / (types + 1)
                base = np.log10((token + 0.5) / (tokens + 0.5 * (types + 1)))
                at = np.cumsum(sizes) - sizes
                sums = [np.add.reduceat(x, at) for x in ((token > 0).astype(np.int64), base, np.log10(mixed))]
                yield pa.record_batch([
                    b.column(1)[i].values, pa.array(~train), pa.array(sizes), pa.array(sums[0]), pa.array(np.full(len(sizes), tokens)), pa.array(sums[1]), pa.array(sums[2]),
                ], schema=schema)

    return run


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """One row per input row: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Counts come from the rows outside the held-out fold. ``base_score`` is the sum of
    log10((c + 0.5) / (N + 0.5 (V + 1))), ``score`` the model's log10 probability.

    Defined cases: a null or empty text is its end alone; rows that repeat are counted and
    scored one by one; a null key counts as the empty text in the fold; without training
    texts the uniform estimate is left; an empty table gives no rows; other columns are
    ignored.
    """
    kind = docs.schema[key].dataType
    made = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("train", T.ArrayType(T.BooleanType())),
        T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("ids", T.BinaryType()), T.StructField("hashes", T.BinaryType()),
    ])
    chunks = materialize(
        docs.select(col(key).alias("key"), (fold(key, FOLDS) != HELD_OUT).alias("train"), text_of(text).alias("text")).mapInArrow(_chunks(chunk, to_arrow_schema(made)), made)
    )
    size = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(1, -(-size // bucket))
    emitted = chunks.mapInArrow(_emit(buckets), "chunk long, kind int, bucket int, keys binary, counts binary")
    totals = materialize(emitted.groupBy("kind", "bucket").applyInPandas(_merge, "chunk long, kind int, bucket int, totals binary, types long, tokens long"))
    known = totals.filter("kind = 0").agg(F.sum("types"), F.sum("tokens")).first()
    types, tokens = known[0] or 0, known[1] or 0
    found = totals.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("kind", "bucket", "totals"))).alias("found"))  # a chunk's own counts
    counted = T.StructType([*made.fields[:5], T.StructField("counts", T.BinaryType()), T.StructField("pairs", T.BinaryType())])
    aligned = materialize(chunks.join(found, "chunk").mapInArrow(_aligned, counted))
    bins = aligned.mapInArrow(_deleted(tokens), "code long, n double, two double, one double").groupBy("code").agg(
        *[F.sum(c).alias(c) for c in ("n", "two", "one")]
    ).orderBy("code").toPandas()  # at most CONTEXTS * BINS * BINS rows
    weights = mixture_weights(*[bins[c].to_numpy() for c in ("code", "n", "two", "one")], types)
    out = T.StructType([
        T.StructField(key, kind), T.StructField("held_out", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")],
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])
    return aligned.mapInArrow(_scored(tokens, types, weights, to_arrow_schema(out)), out)
