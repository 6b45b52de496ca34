"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The perfect binary
Golay code splits the 23-bit words into 4096 balls of radius 3. A word's indices are
the codewords nearest to it or to a word one bit away: one index if the word lies
deep in its ball, else six. Words at most two bits apart share an index.

Three wrong bits spread over the segments in few ways, and each has a key:

- none in the third segment: one of the first two is whole too (a key of the whole
  segments), or both have one or two (both indices and half of the third segment);
- one in the third: one half of it is whole, and both indices agree;
- two or three in the third: a first segment is whole, the other's index agrees.

So fingerprints at three bits or fewer share a key of 33 bits or more. They meet in the
key's bucket, are compared, and leave a spanning forest of the links there instead
of all pairs; components are then found by contracting stars.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rankforge.llm.shared import col, text_of
from rankforge.session import materialize

SHINGLE = 3
BITS = 3
SEED = 42
#: Generator polynomial of the binary Golay code (23, 12, 7).
GENERATOR = 0xAE3
#: Members of a bucket that one call compares; larger buckets are dealt out in blocks.
BLOCK = 4096
KEYS = 2 + 2 * 6 + 2 * 36


# fingerprints

def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash as a signed 64-bit integer."""
    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(words))
    starts, ends = starts[:len(words) - k + 1], ends[k - 1:]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for lo in range(0, len(starts), 1 << 15):
        hashes = np.array(
            [digest(joined[a:b], seed) for a, b in zip(starts[lo:lo + (1 << 15)].tolist(), ends[lo:lo + (1 << 15)].tolist())], ">u8"
        )
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(starts)).view(">i8")[0])


def with_fingerprint(docs: DataFrame, mark: Callable[[str], int], text: str = "text", name: str = "_fp") -> DataFrame:
    """``docs`` with one more column, the fingerprint ``mark`` of ``text``."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    arrow, at = to_arrow_schema(schema), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [mark(t.as_py() or "") for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps, pa.int64())], schema=arrow)

    return docs.mapInArrow(run, schema)


# Golay indices and keys

def _remainder(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        v ^= np.where(v >> bit & 1, GENERATOR << (bit - 11), 0)
    return v


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the upper 12 and the lower 11 bits, and for every remainder the error
    patterns that lead to the indices of a word: its own ball's, and the neighbours'."""
    upper, lower = _remainder(np.arange(1 << 12) << 11), _remainder(np.arange(1 << 11))
    found: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)])
        for p, r in zip(patterns.tolist(), _remainder(patterns).tolist()):
            if weight <= 3 or len(found[r]) and found[r][0].bit_count() == 3:
                found[r].append(p)
    return upper, lower, np.array([(f + f[:1] * 6)[:6] for f in found])


def golay_indices(words: np.ndarray) -> np.ndarray:
    """Six codeword indices per 23-bit word; the first is repeated where there are fewer."""
    upper, lower, errors = _tables()
    words = words.astype(np.int64)
    return (words[:, None] ^ errors[upper[words >> 11] ^ lower[words & 0x7FF]]) >> 11


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all different keys of every fingerprint."""
    u = fps.view(np.uint64)
    a, b, c = ((u >> np.uint64(s) & np.uint64(m)).astype(np.int64) for s, m in ((0, (1 << 23) - 1), (23, (1 << 23) - 1), (46, (1 << 18) - 1)))
    ia, ib = golay_indices(a), golay_indices(b)
    both = (ia[:, :, None] << 12 | ib[:, None, :]).reshape(len(u), 36)
    kinds = [
        (a << 18 | c)[:, None], (b << 18 | c)[:, None], a[:, None] << 12 | ib, b[:, None] << 12 | ia,
        both << 9 | (c & 511)[:, None], both << 9 | (c >> 9)[:, None],
    ]
    keys = np.sort(np.concatenate([k | n << 60 for n, k in enumerate(kinds)], axis=1), axis=1)
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.nonzero(new)[0], keys[new]


# links

def forest(fps: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Spanning forest of the links among different fingerprints."""
    left, links = fps, []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count((left ^ at).view(np.uint64)) <= bits
            if near.any():
                todo.extend(left[near])
                links += [(int(at), int(x)) for x in left[near]]
                left = left[~near]
    return links


LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("key", T.LongType())])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy()
        for lo in range(0, len(fps), 2048):
            rows, keys = fuzzy_keys(fps[lo:lo + 2048])
            yield pa.record_batch([pa.array(keys), pa.array(fps[lo:lo + 2048][rows])], names=["key", "fp"])


def _bucket_links(bits: int, block: int):
    """Rows sorted by key to links (a, b, null); of a bucket of more than ``block`` members
    its members (a, null, key) instead."""
    arrow = to_arrow_schema(LINK)

    def out(a, b, keys):
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keys, pa.int64())], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, large = np.empty(0, np.int64), np.empty(0, np.int64), None
        for batch in batches:
            keys, fps = np.concatenate([keys, batch.column(0).to_numpy()]), np.concatenate([fps, batch.column(1).to_numpy()])
            if large is not None:  # the rest of a large bucket passes through
                more = int(np.searchsorted(keys, large, "right"))
                yield out(fps[:more], [None] * more, keys[:more])
                keys, fps = keys[more:], fps[more:]
            if not len(keys):
                continue
            large = None
            last = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
            yield from groups(keys[:last], fps[:last])
            keys, fps = keys[last:], fps[last:]
            if len(keys) > block:
                yield out(fps, [None] * len(fps), keys)
                large, keys, fps = int(keys[0]), keys[:0], fps[:0]
        yield from groups(keys, fps)

    def groups(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys) < 2:
            return
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        two = starts[sizes == 2]
        near = two[np.bitwise_count((fps[two] ^ fps[two + 1]).view(np.uint64)) <= bits]
        if len(near):
            yield out(fps[near], fps[near + 1], [None] * len(near))
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            if n > block:
                yield out(fps[s:s + n], [None] * n, keys[s:s + n])
            elif links := forest(fps[s:s + n], bits):
                yield out([x for x, _ in links], [x for _, x in links], [None] * len(links))

    return run


def links(fps: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all different fingerprints of column ``fp`` at ``bits``
    or fewer differing bits, as far as they are connected.

    A bucket of more than ``block`` members, which only families of near copies make, is
    dealt into blocks; every two blocks meet in a task of their own, so its work is
    spread and no member is left out.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the keys cover three differing bits")
    keyed = fps.select("fp").mapInArrow(_keyed, "key long, fp long")
    found = materialize(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_links(bits, block), LINK))
    members = found.filter("b is null").select("key", F.col("a").alias("fp"))
    blocks = members.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    met = (
        members.join(blocks, "key")
        .withColumn("i", F.pmod(F.xxhash64("fp"), "n").cast("int"))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "fp")
    )

    def compared(pdf):
        import pandas as pd

        return pd.DataFrame(forest(np.unique(pdf["fp"].to_numpy()), bits), columns=["a", "b"], dtype="int64")

    return found.filter("b is not null").select("a", "b").unionByName(met.groupBy("key", "i", "j").applyInPandas(compared, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the edges (a, b): root is the smallest node reachable.

    Alternates large and small stars: every node's larger neighbours, then its smaller
    ones, are tied to its smallest neighbour, until nothing changes. Each round is
    written to the shared folder.
    """
    def stars(low: DataFrame, rows: DataFrame) -> DataFrame:
        return rows.join(low, "u")

    def mark(e: DataFrame):
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    edge = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    seen = mark(edge)
    while seen[0]:
        both = edge.unionByName(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = stars(low, both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = stars(low, large)
        edge = materialize(
            tied.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        now = mark(edge)
        if now == seen:
            break
        seen = now
    return edge.select(F.col("u").alias("node"), F.col("v").alias("root"))


def fingerprint_roots(fps: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(fp, root) for the different fingerprints of column ``fp`` that have links."""
    return components(links(fps.select("fp").distinct(), bits, block)).select(F.col("node").alias("fp"), "root")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """One row per input row: key, fingerprint, component_id (the smallest key reachable).

    Defined cases: a null text and a text without words have fingerprint zero, linked
    like any other; a null key is never the smallest unless the component has no other;
    rows that repeat are one node; an empty table gives no rows; other columns are
    ignored.
    """
    rows = materialize(with_fingerprint(docs.select(col(key).alias("key"), text_of(text).alias("text")), lambda t: fingerprint(t, shingle), "text", "fp").select("key", "fp"))
    nodes = materialize(rows.groupBy("fp").agg(F.min("key").alias("low")))
    rooted = nodes.join(fingerprint_roots(nodes, bits, block), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted)
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# near copies by similarity of their shingles

COPY_SHINGLE, COPY_SIMILARITY = 5, 0.8
PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
#: Bits of the parity map of a shingle set, in words of 64.
MAP_WORDS = 8
#: One text in SAMPLE is counted to find frequent shingles; those in at least FREQUENT of the
#: counted texts come last in the order of shingles. The order decides on the work, not on the pairs.
SAMPLE, FREQUENT, MOST_FREQUENT = 16, 8, 1 << 20
#: Keys of a set, and cells of a key, by which sets are chained before the complete join.
CHAIN_KEYS, CHAIN_CELLS = 4, 16
#: Members of a key's bucket that one task compares; larger ones are dealt out in blocks.
COPY_BLOCK = 8192
SIGNED = "row long, digest binary, n long, prefix array<long>, map binary, wide binary"


def shingles(text: str, size: int = COPY_SHINGLE) -> set[bytes]:
    """The different shingles of a text; of a shorter text all words; without words none."""
    words = text.encode().lower().split()
    return {b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def shingle_hashes(text: str, size: int = COPY_SHINGLE, seed: int = SEED) -> np.ndarray:
    """The hashes of ``shingles``, in order."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    single = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    count = max(1, len(words) - size + 1)
    out = single[:count].copy()
    for i in range(1, min(size, len(words))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + single[i:i + count]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        out = (out ^ out >> np.uint64(shift)) * np.uint64(factor)
    return np.unique(out ^ out >> np.uint64(31))


def prefix(hashes: np.ndarray, least: float, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in an order that all sets share: two sets whose similarity
    is ``least`` or more have one of these in common."""
    if not len(hashes):
        return hashes
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        often = np.where(frequent[at] == hashes, counts[at], 0)
        if often.any():
            hashes = hashes[np.lexsort((hashes, often))]
    return hashes[:len(hashes) - int(np.ceil(least * len(hashes) - 1e-9)) + 1]


def parity_map(hashes: np.ndarray, words: int = MAP_WORDS) -> np.ndarray:
    """``words`` words whose bits are parities of the set's members: the bits in which two
    maps differ are never more than the members in which the sets do. For powers of two, a
    map folded with xor is the map of half as many words."""
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def wide_map(hashes: np.ndarray) -> np.ndarray:
    """The parity map with at least a bit for each member."""
    return parity_map(hashes, max(MAP_WORDS, 1 << (max(1, -(-len(hashes) // 64)) - 1).bit_length()))


def _may_be_similar(n: np.ndarray, maps: np.ndarray, m: np.ndarray, others: np.ndarray, least: float) -> np.ndarray:
    """Whether sizes and maps leave room for a similarity of ``least``."""
    apart = np.bitwise_count(maps ^ others).sum(axis=-1, dtype=np.int64)
    return (apart * (1 + least) <= (1 - least) * (n + m) + 1e-6) & (np.minimum(n, m) >= least * np.maximum(n, m) - 1e-6)


def _frequent(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                found = [shingle_hashes(t.as_py() or "", size) for t in batch.column(0)[lo:lo + 256]]
                keys, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(counts)], names=["key", "n"])

    return run


def _signed(least: float, size: int, frequent):
    """Rows (row, text) to (row, digest of the shingle set, its its size, prefix and parity maps)."""
    schema = to_arrow_schema(T.StructType.fromDDL(SIGNED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for batch in batches:
            for lo in range(0, len(batch), 512):
                sets = [shingle_hashes(t.as_py() or "", size) for t in batch.column(1)[lo:lo + 512]]
                yield pa.record_batch([
                    batch.column(0)[lo:lo + 512], pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()), pa.array([prefix(s, least, *known).view(np.int64) for s in sets], pa.list_(pa.int64())),
                    pa.array([parity_map(s).tobytes() for s in sets], pa.binary()), pa.array([wide_map(s).tobytes() for s in sets], pa.binary()),
                ], schema=schema)

    return run


def _maps(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, MAP_WORDS)


def _chained(least: float):
    """Rows (key, cell, row, n, map) sorted by key and cell to pairs of a row and each of the
    two before it in its cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not len(batch):
                continue
            own = [*(batch.column(i).to_numpy() for i in range(4)), _maps(batch.column(4))]
            key, cell, row, n, maps = own if kept is None else [np.concatenate(x) for x in zip(kept, own)]
            found = []
            for step in (1, 2):
                same = (key[step:] == key[:-step]) & (cell[step:] == cell[:-step]) & _may_be_similar(n[step:], maps[step:], n[:-step], maps[:-step], least)
                found.append(np.c_[row[:-step][same], row[step:][same]])
            kept = [x[-2:] for x in (key, cell, row, n, maps)]
            pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _undecided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, root, row) sorted by key and root, without the keys that have one root."""
    key, root, row, passed = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), None
    names = ["key", "root", "row"]
    for batch in batches:
        key, root, row = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((key, root, row)))
        if not len(key):
            continue
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        several = root[starts] != root[ends - 1]
        several[0] |= key[0] == passed
        if several[-1]:  # the rest of this key passes as it comes
            passed = key[-1]
        take = np.repeat(several, ends - starts)
        yield pa.record_batch([pa.array(x[take]) for x in (key, root, row)], names=names)
        rest = len(key) if several[-1] else starts[-1]
        key, root, row = key[rest:], root[rest:], row[rest:]


def _compared(least: float):
    """Rows (key, i, j, root, row, n, map) sorted by key, i and j to the pairs of different
    roots that may be similar."""
    def inside(root, row, n, maps):
        roots, at, sizes = np.unique(root, return_inverse=True, return_counts=True)
        for r in np.argsort(sizes, kind="stable")[:-1]:  # each root's rows meet all roots that come later
            for x in np.flatnonzero(at == r):
                near = np.flatnonzero((at != r) & _may_be_similar(n[x], maps[x], n, maps, least))
                if len(near):
                    yield np.c_[np.full(len(near), row[x]), row[near]]
            keep = at != r
            root, row, n, maps, at = root[keep], row[keep], n[keep], maps[keep], at[keep]

    def groups(cols):
        key, i, j, root, row, n, maps = cols
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        sizes = np.diff(np.r_[starts, len(key)])
        two = starts[sizes == 2]
        near = two[(root[two] != root[two + 1]) & _may_be_similar(n[two], maps[two], n[two + 1], maps[two + 1], least)]
        found = [np.c_[row[near], row[near + 1]]]
        for s, m in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            found += inside(*(x[s:s + m] for x in (root, row, n, maps)))
        pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not len(batch):
                continue
            own = [*(batch.column(c).to_numpy() for c in range(6)), _maps(batch.column(6))]
            cols = own if kept is None else [np.concatenate(x) for x in zip(kept, own)]
            key, i, j = cols[:3]
            last = int(np.argmax((key == key[-1]) & (i == i[-1]) & (j == j[-1])))  # may go on in the next batch
            if last:
                yield groups([x[:last] for x in cols])
            kept = [x[last:] for x in cols]
        if kept is not None:
            yield groups(kept)

    return run


def _narrowed(least: float):
    """Rows (a, b, n a, n b, wide map a, wide map b) to the pairs that may be similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                x, y = (np.frombuffer(z, np.uint64) for z in (x, y))
                words = min(len(x), len(y))
                x, y = (np.bitwise_xor.reduce(z.reshape(-1, words), axis=0) for z in (x, y))
                ok.append(bool(_may_be_similar(n, x, m, y, least)))
            kept = batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))
            yield pa.record_batch(kept.columns, names=["a", "b"])

    return run


def _similar(least: float, size: int):
    """Rows (a, b, text a, text b), those of one a together as far as they come so, to the
    pairs whose shingles have a Jaccard similarity of ``least`` or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, set()
        for batch in batches:
            ok = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != at:
                    at, own = a, shingles(x.as_py(), size)
                other = shingles(y.as_py(), size)
                common = len(own & other)
                ok.append(common >= least * (len(own) + len(other) - common))
            kept = batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))
            yield pa.record_batch(kept.columns, names=["a", "b"])

    return run


def similar_links(texts: DataFrame, least: float = COPY_SIMILARITY, size: int = COPY_SHINGLE, block: int = COPY_BLOCK) -> DataFrame:
    """Links (a, b) that connect all rows of (row, text) whose shingle sets have a Jaccard
    similarity of ``least`` or more, as far as they are connected.

    Equal sets are linked at once and go on as one. The others meet by prefix filter: two
    similar sets share one of the first shingles of each. Sets are first chained in cells
    of few of these, so that a family of near copies becomes one component without its
    square of pairs; then all keys are joined, and in each bucket every two sets of
    different components are compared, by sizes and parity maps, which lose no similar
    pair, and then by whole texts. A bucket of more than ``block`` members is dealt into blocks,
    and every two blocks meet in a task of their own.
    """
    sc = texts.sparkSession.sparkContext
    counted = texts.filter(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(_frequent(size), "key long, n long")
    often = counted.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "key").limit(MOST_FREQUENT).toPandas()
    keys, counts = often["key"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    signed = materialize(texts.select("row", "text").mapInArrow(_signed(least, size, sc.broadcast((keys[order], counts[order]))), SIGNED))

    low = signed.groupBy("digest").agg(F.min("row").alias("a"), F.count("*").alias("c")).filter("c > 1").select("digest", "a")
    equal = materialize(signed.select("digest", F.col("row").alias("b")).join(low, "digest").filter("b > a").select("a", "b"))
    sets = materialize(signed.join(equal.select(F.col("b").alias("row")), "row", "left_anti").select("row", "n", "prefix", "map", "wide"))

    def verified(pairs: DataFrame) -> DataFrame:
        wide = (
            pairs.distinct().join(sets.select(F.col("row").alias("a"), F.col("n").alias("n"), F.col("wide").alias("x")), "a")
            .join(sets.select(F.col("row").alias("b"), F.col("n").alias("m"), F.col("wide").alias("y")), "b")
        )
        pairs = materialize(wide.select("a", "b", "n", "m", "x", "y").mapInArrow(_narrowed(least), PAIR))
        involved = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()
        t = materialize(texts.join(involved, "row", "left_semi"))
        both = (
            pairs.join(t.select(F.col("row").alias("b"), F.col("text").alias("y")), "b")
            .join(t.select(F.col("row").alias("a"), F.col("text").alias("x")), "a").select("a", "b", "x", "y")
        )
        return materialize(both.mapInArrow(_similar(least, size), PAIR))

    cells = sets.select(F.explode(F.slice("prefix", 1, CHAIN_KEYS)).alias("key"), "row", "n", "map")
    cells = cells.select("key", F.pmod(F.xxhash64("row", "key"), F.lit(CHAIN_CELLS)).alias("cell"), "row", "n", "map")
    chained = cells.repartition("key", "cell").sortWithinPartitions("key", "cell", F.xxhash64("key", "row")).mapInArrow(_chained(least), PAIR)
    rooted = materialize(components(verified(chained)))

    named = sets.join(rooted.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    keyed = named.select(F.explode("prefix").alias("key"), "root", "row")
    open_ = materialize(keyed.repartition("key").sortWithinPartitions("key", "root").mapInArrow(_undecided, "key long, root long, row long"))
    blocks = open_.groupBy("key").agg(F.ceil(F.count("*") / block).cast("long").alias("k")).filter("k > 1")
    met = (
        open_.join(blocks, "key", "left").withColumn("k", F.coalesce("k", F.lit(1)))
        .withColumn("i", F.pmod(F.xxhash64("row"), "k"))
        .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
        .select("key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "root", "row")
        .join(sets.select("row", "n", "map"), "row").select("key", "i", "j", "root", "row", "n", "map")
    )
    compared = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compared(least), PAIR)
    return equal.unionByName(rooted.select(F.col("root").alias("a"), F.col("node").alias("b"))).unionByName(verified(compared))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = COPY_SIMILARITY, shingle: int = COPY_SHINGLE) -> DataFrame:
    """The documents with one row per group of near copies left, the one with the smallest key.

    Near copies have a Jaccard similarity of ``similarity`` or more in shingles of
    ``shingle`` words; groups are what they connect. No pair of near copies is left out
    (``similar_links``), and only near copies are dropped.

    Defined cases: a null text has no words, and texts without words are copies of each
    other; rows that repeat are copies; a null key is never the smallest unless there is
    no other; an empty table gives no rows.
    """
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = similar_links(rows.select(F.col("_row").alias("row"), text_of(text).alias("text")), similarity, shingle)
    roots = components(found).select(F.col("node").alias("_row"), "root")
    order = F.struct(col(key).isNull().alias("u"), col(key).alias("k"), F.col("_row").alias("r"))
    labelled = rows.select("_row", key).join(roots, "_row", "left").withColumn("root", F.coalesce("root", "_row"))
    stay = labelled.groupBy("root").agg(F.min(order).alias("_low")).select(F.col("_low.r").alias("_row"))
    return rows.join(stay, "_row", "left_semi").select(*docs.columns)
