"""Near copies by SimHash fingerprints of words, found through Golay indices.

Two texts are near copies if shingles of ``SHINGLE`` words that both have cover at least
``COVERED`` of all their words. A word edited in every fifteen leaves half of the shingles
alike but covers more than nine tenths of the words, so edited copies are reached; texts
that only share passages are not.

A fingerprint has 156 bits, each the sign of a sum over the different words of the text, so
an edit moves few bits. Four segments of 23 bits are decoded to Golay indices, up
to six each (``simhash.golay_indices``), and a key is one index of two segments: the wrong
bits would have to spoil three segments of four to hide a pair. Texts meet in the buckets
of their keys, and those at most ``BITS`` of the other 64 bits apart are near and verified on
their words.

Pairs stay in proportion to texts. In a bucket every text is first tried with the first
text that is near it. What is verified becomes one group, and where near texts of a
bucket are still in several groups, one text of each is tried with the first of another
choice, round after round while these tries bear fruit. Then the near pairs left
between groups are tried one by one, so none is left out. All keys are shuffled once; what
follows works on the texts that are near another one in a bucket.

A bucket that holds very many texts is found on a sample of texts and dealt into cells
before anything is shuffled; cells of one bucket come together through their groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.shared import col, free_name, text_of
from rankforge.llm.simhash import components, golay_indices
from rankforge.session import materialize

SHINGLE, COVERED = 5, 0.8
BITS, SEGMENTS, SEED = 14, 4, 42
#: Bits of a key: the number of the two segments, and an index of each.
KEY_BITS = 27
#: Texts of a cell of a large bucket.
CELL = 2048
#: Rounds go on while more than one try in FRUITFUL makes a link; all other pairs are tried after.
FRUITFUL = 10
#: One text in SAMPLE is counted to find large buckets. At most MOST of them are dealt into cells;
#: the others hold less than one in MOST of all keys each.
SAMPLE, MOST = 16, 1 << 16
PAIR = "a long, b long"
SIGNED = "row long, d0 long, d1 long, s0 long, s1 long, f long"
KEYED = "key long, row long, f long"
MET = "key long, row long, f long, first long"


# fingerprints

def word_bits(words: list[bytes]) -> np.ndarray:
    """192 signs, -1 or 1, of every word."""
    raw = np.frombuffer(b"".join(h(w, SEED) for w in words for h in (xxhash.xxh3_128_digest, xxhash.xxh64_digest)), np.uint8)
    return np.unpackbits(raw).reshape(-1, 192).astype(np.int8) * 2 - 1


def fingerprints(texts: list[list[bytes]]) -> np.ndarray:
    """Three 64-bit numbers for every text, the signs of its different words' sums (zero without):
    two that hold the segments, and the one to compare."""
    numbers: dict[bytes, int] = {}
    ids = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)) for words in texts]
    signs = word_bits(list(numbers)) if numbers else np.empty((0, 192), np.int8)
    sums = np.zeros((len(texts), 192), np.int64)
    for i, own in enumerate(ids):
        if len(own):
            sums[i] = signs[np.unique(own)].sum(axis=0, dtype=np.int32)
    return np.packbits(sums > 0, axis=1).view(">i8").astype(np.int64)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, text) to rows of SIGNED: a digest of the words, and the fingerprint."""
    for batch in batches:
        for lo in range(0, len(batch), 256):
            texts = [_words(t.as_py()) for t in batch.column(1)[lo:lo + 256]]
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(w)) for w in texts), np.int64).reshape(-1, 2)
            prints = fingerprints(texts)
            yield pa.record_batch([batch.column(0)[lo:lo + 256], *(pa.array(np.ascontiguousarray(c)) for x in (digests, prints) for c in x.T)], names=["row", "d0", "d1", "s0", "s1", "f"])


def copy_keys(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all different keys of every pair of numbers that hold the segments."""
    low, high = low.view(np.uint64), high.view(np.uint64)
    mask = np.uint64((1 << 23) - 1)
    indices = [golay_indices((x >> np.uint64(s) & mask).astype(np.int64)) for x, s in ((low, 0), (low, 23), (high, 0), (high, 23))]
    keys = np.concatenate([
        n << 24 | (indices[i][:, :, None] << 12 | indices[j][:, None, :]).reshape(len(low), 36) for n, (i, j) in enumerate(combinations(range(SEGMENTS), 2))
    ], axis=1)
    keys.sort(axis=1)
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.nonzero(new)[0], keys[new]


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ x >> np.uint64(32)


def _keyed(large):
    """Rows (row, s0, s1, f) to rows of KEYED; in large buckets the cell stands above the key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cells = large.value if large is not None else (np.empty(0, np.int64), np.empty(0, np.int64))
        for batch in batches:
            row, s0, s1, f = (batch.column(i).to_numpy() for i in range(4))
            for lo in range(0, len(row), 2048):
                s = slice(lo, lo + 2048)
                at, keys = copy_keys(s0[s], s1[s])
                if len(known):
                    spot = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    hit = known[spot] == keys
                    cell = _mixed(row[s][at[hit]]) % cells[spot[hit]].astype(np.uint64)
                    keys[hit] |= (cell.astype(np.int64) + 1) << KEY_BITS
                yield pa.record_batch([pa.array(x) for x in (keys, row[s][at], f[s][at])], names=["key", "row", "f"])

    return run


# pairs

def _apart(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    return np.bitwise_count((f ^ g).view(np.uint64))  # of signed numbers it counts the absolute value's bits


def led(row: np.ndarray, f: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first row left takes all near rows with it, until none is left: whom each row left
    with, and whether it is near any other row."""
    first, near_any, left = row.copy(), np.zeros(len(row), bool), np.arange(len(row))
    while len(left):
        near = _apart(f, f[left[0]]) <= bits
        near_any[left[0]] = np.count_nonzero(near) > 1
        mine = near[left]
        first[left[mine]] = row[left[0]]
        near_any[left[mine][1:]] = True
        left = left[~mine]
    return first, near_any


def crossed(root: np.ndarray, row: np.ndarray, f: np.ndarray, bits: int) -> np.ndarray:
    """All near pairs of different roots; the root with most rows meets the others only."""
    roots, at, sizes = np.unique(root, return_inverse=True, return_counts=True)
    found = [np.empty((0, 2), np.int64)]
    for r in np.argsort(sizes, kind="stable")[:-1]:
        for x in np.flatnonzero(at == r):
            near = np.flatnonzero((at != r) & (_apart(f, f[x]) <= bits))
            found.append(np.c_[np.full(len(near), row[x]), row[near]])
        keep = at != r
        row, f, at = row[keep], f[keep], at[keep]
    return np.concatenate(found)


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Columns, starts and sizes of whole groups from batches sorted by the first columns."""
    def cut(cols):
        starts = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in cols[:n_keys]], axis=0)])
        return cols, starts, np.diff(np.r_[starts, len(cols[0])])

    kept = None
    for batch in batches:
        if not len(batch):
            continue
        own = [c.to_numpy() for c in batch.columns]
        cols = own if kept is None else [np.concatenate(x) for x in zip(kept, own)]
        last = int(np.argmax(np.logical_and.reduce([k == k[-1] for k in cols[:n_keys]])))  # the last group may go on
        if last:
            yield cut([x[:last] for x in cols])
        kept = [x[last:] for x in cols]
    if kept is not None:
        yield cut(kept)


def _met(bits: int):
    """Rows of KEYED, sorted by key, to the rows that are near another one in their bucket, or
    lie in a large bucket, with the row each left with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, row, f), starts, sizes in _groups(batches, 1):
            first, take = row.copy(), key >> KEY_BITS > 0
            two = starts[sizes == 2]
            two = two[_apart(f[two], f[two + 1]) <= bits]
            first[two + 1], take[two], take[two + 1] = row[two], True, True
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                g = slice(s, s + n)
                first[g], near = led(row[g], f[g], bits)
                take[g] |= near
            yield pa.record_batch([pa.array(x[take]) for x in (key & ((1 << KEY_BITS) - 1), row, f, first)], names=["key", "row", "f", "first"])

    return run


def _paired(n_keys: int, bits: int, every: bool):
    """Rows (keys, root, row, f), sorted by the keys, to pairs of near rows with different
    roots: all, or those of a row and the one it left with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, starts, sizes in _groups(batches, n_keys):
            root, row, f = cols[n_keys:]
            found = [np.empty((0, 2), np.int64)]
            for s, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
                g = slice(s, s + n)
                if every:
                    found.append(crossed(root[g], row[g], f[g], bits))
                else:
                    first, _ = led(np.arange(n), f[g], bits)
                    other = root[g] != root[g][first]
                    found.append(np.c_[row[g][first][other], row[g][other]])
            pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


# verification

def shingle_sequence(words: list[bytes], size: int) -> np.ndarray:
    """The hashes of a text's shingles, in order; of a shorter text one for all words."""
    if not words:
        return np.empty(0, np.uint32)
    single = np.fromiter((xxhash.xxh3_64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    count = max(1, len(words) - size + 1)
    out = single[:count].copy()
    for i in range(1, min(size, len(words))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + single[i:i + count]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        out = (out ^ out >> np.uint64(shift)) * np.uint64(factor)
    return (out >> np.uint64(32)).astype(np.uint32)


def covered(a: np.ndarray, b: np.ndarray, size: int) -> float:
    """The share of all words of two texts that common shingles cover."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    words = 0
    for own, other in ((a, b), (b, a)):
        common = np.isin(own, other)
        edge = np.zeros(len(own) + size, np.int32)
        edge[:len(own)] += common
        edge[size:] -= common
        words += np.count_nonzero(np.cumsum(edge)[:-1])
    return words / (len(a) + len(b) + 2 * (size - 1))


def _sequences(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                made = [shingle_sequence(_words(t.as_py()), size).tobytes() for t in batch.column(1)[lo:lo + 512]]
                yield pa.record_batch([batch.column(0)[lo:lo + 512], pa.array(made, pa.binary())], names=["row", "shingles"])

    return run


def _verified(least: float, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(v.as_buffer() or b"", np.uint32) for v in batch.column(i)] for i in (2, 3))
            ok = [covered(a, b, size) >= least for a, b in zip(x, y)]
            kept = batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))
            yield pa.record_batch(kept.columns, names=["a", "b"])

    return run


# groups

def _large_buckets(sets: DataFrame, cell: int):
    """Broadcast of the keys of large buckets, in order, and their numbers of cells."""
    sample = sets.filter(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0)
    counts = sample.mapInArrow(_keyed(None), KEYED).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") * SAMPLE > cell)
    rows = counts.orderBy(F.desc("n"), "key").limit(MOST).toPandas().sort_values("key")
    # Powers of two, so that cells of different keys hold the same texts and lead to the same pairs.
    cells = 1 << np.ceil(np.log2(np.maximum(rows["n"].to_numpy(np.float64) * SAMPLE / cell, 2))).astype(np.int64)
    return sets.sparkSession.sparkContext.broadcast((rows["key"].to_numpy(np.int64), cells))


def near_roots(texts: DataFrame, least: float = COVERED, size: int = SHINGLE, bits: int = BITS, cell: int = CELL) -> DataFrame:
    """(row, root) for every row of (row, text): equal for rows that near copies connect."""
    signed = materialize(texts.select("row", "text").mapInArrow(_signed, SIGNED))
    prints = [F.first(c).alias(c) for c in ("s0", "s1", "f")]
    sets = materialize(signed.groupBy("d0", "d1").agg(F.min("row").alias("row"), *prints))
    plain = sets.select("row", "s0", "s1", "f")
    keyed = plain.mapInArrow(_keyed(_large_buckets(plain, cell)), KEYED)
    met = materialize(keyed.repartition("key").sortWithinPartitions("key", "row").mapInArrow(_met(bits), MET))

    def verified(pairs: DataFrame) -> DataFrame:
        involved = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
        read = materialize(texts.select("row", "text").join(involved, "row", "left_semi").mapInArrow(_sequences(size), "row long, shingles binary"))
        both = (
            pairs.join(read.select(F.col("row").alias("b"), F.col("shingles").alias("y")), "b")
            .join(read.select(F.col("row").alias("a"), F.col("shingles").alias("x")), "a").select("a", "b", "x", "y")
        )
        return materialize(both.mapInArrow(_verified(least, size), PAIR))

    def grouped(roots: DataFrame, links: DataFrame) -> DataFrame:
        """(row, root) after more links: groups that these connect become one."""
        ends = links
        for end in ("a", "b"):
            ends = ends.join(roots.select(F.col("row").alias(end), F.col("root").alias("_root")), end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
        merged = materialize(components(ends).select(F.col("node").alias("root"), F.col("root").alias("_to")))
        known = roots.unionByName(merged.select(F.col("root").alias("row"), "root").join(roots, "row", "left_anti"))
        return materialize(known.join(merged, "root", "left").select("row", F.coalesce("_to", "root").alias("root")))

    def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return rows.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))

    def dealt(rows: DataFrame, keys: list[str], order: list, every: bool) -> DataFrame:
        ready = rows.select(*keys, "root", "row", "f").repartition(*keys).sortWithinPartitions(*keys, *order)
        return ready.mapInArrow(_paired(len(keys), bits, every), PAIR).distinct()

    tried = materialize(met.filter("first <> row").select(F.least("first", "row").alias("a"), F.greatest("first", "row").alias("b")).distinct())
    none = met.limit(0).select("row", F.col("row").alias("root"))
    roots, open_, turn = grouped(none, verified(tried)), met.select("key", "row", "f"), 0
    while True:  # one row of each group in a bucket, in another order each time
        turn += 1
        now = with_roots(open_, roots).select("key", "row", "f", "root")
        ends = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
        named = materialize(now.join(ends, "key", "left_semi"))
        open_ = named.select("key", "row", "f")
        ones = named.groupBy("key", "root").agg(F.min_by(F.struct("row", "f"), F.xxhash64("row", F.lit(turn))).alias("one")).select("key", "root", "one.*")
        # A bucket of very many groups is dealt into cells, anew in every turn.
        parts = ones.groupBy("key").agg(F.ceil(F.count("*") / cell).cast("int").alias("n"))
        ones = ones.join(parts, "key").withColumn("cell", F.pmod(F.xxhash64("root", F.lit(turn)), "n"))
        pairs = materialize(dealt(ones, ["key", "cell"], [F.xxhash64("row", F.lit(turn))], False).join(tried, ["a", "b"], "left_anti"))
        more = verified(pairs)
        tried = tried.unionByName(pairs)
        n_pairs, n_more = pairs.count(), more.count()
        if n_more:
            roots = grouped(roots, more)
        if n_more * FRUITFUL <= n_pairs:
            break
    named = materialize(with_roots(open_, roots).select("key", "row", "f", "root"))
    blocks = named.groupBy("key").agg(F.ceil(F.count("*") / cell).cast("int").alias("n"))
    last = (
        named.join(blocks, "key").withColumn("i", F.pmod(F.xxhash64("row"), "n").cast("int"))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .withColumns({"i": F.least("i", "j"), "j": F.greatest("i", "j")})
    )
    rest = materialize(dealt(last, ["key", "i", "j"], ["row"], True).join(tried, ["a", "b"], "left_anti"))
    more = verified(rest)
    roots = roots if more.isEmpty() else grouped(roots, more)
    low = with_roots(sets.select("row", "d0", "d1"), roots).select("d0", "d1", "root")
    return signed.select("row", "d0", "d1").join(low, ["d0", "d1"]).select("row", "root")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = COVERED, shingle: int = SHINGLE) -> DataFrame:
    """The documents with one row per group of near copies left, the one with the smallest key.

    Defined cases: a null text has no words, and texts without words are copies of each
    other; shorter texts than a shingle are copies only if their words are the same; rows
    that repeat are copies; a null key is never the smallest unless there is no other; other
    columns, of any name, stay as they are; an empty table gives no rows.
    """
    row = free_name("row", docs.columns)
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    order = F.struct(col(key).isNull().alias("u"), col(key).alias("k"), F.col(row).alias("r"))
    facts = rows.select(F.col(row).alias("row"), order.alias("order"))
    roots = near_roots(rows.select(F.col(row).alias("row"), text_of(text).alias("text")), least, shingle)
    stay = facts.join(roots, "row").groupBy("root").agg(F.min("order").alias("low")).select(F.col("low.r").alias(row))
    return rows.join(stay, row, "left_semi").select(*docs.columns)
