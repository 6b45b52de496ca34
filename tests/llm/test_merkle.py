"""Manifest and proofs against a brute-force tree."""

import hashlib
import zlib

import pytest

from rankforge.llm import merkle

LOW = str.maketrans(merkle.UPPER, merkle.LOWER)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def paths(nodes, width):
    """The top of a tree and, per leaf, the siblings before and after on each level."""
    out, at, index = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(at) > 1:
        runs = [at[i:i + width] for i in range(0, len(at), width)]
        for leaf_no, i in enumerate(index):
            run = runs[i // width]
            out[leaf_no].append(("".join(run[:i % width]), "".join(run[i % width + 1:])))
            index[leaf_no] = i // width
        at = [h(*run) for run in runs]
    return at[0], out


def brute(rows, width=16):
    groups = {}
    for r in rows:
        groups.setdefault("" if r[1] is None else "s" + r[1], []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is None, r[0] or 0, leaf(r)))
    order = sorted(groups, key=lambda s: s.encode())
    trees = {s: paths([leaf(r) for r in groups[s]], width) for s in order}
    root, above = paths([trees[s][0] for s in order], width)
    out = []
    for s, up in zip(order, above):
        for r, own in zip(groups[s], trees[s][1]):
            path = own + up
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            node = leaf((*r[:4], r[4].translate(LOW))) if changed else leaf(r)
            for a, b in path:
                node = h(a, node, b)
            out.append((r[0], leaf(r), trees[s][0], root, h(*[a + b for a, b in path]), node, node == root))
    return out


def check(spark, rows, width=16):
    docs = spark.createDataFrame([(*r, "z", "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, rank string").repartition(3)
    got = [tuple(r) for r in merkle.verify(docs, width=width).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows, width)))


@pytest.mark.parametrize("sizes", [[1], [17], [1, 16, 2, 300], [257, 0, 1] + [1] * 20])
def test_equals_brute_force(spark, sizes):
    rows = [(1000 * s + i, f"src{s}", "en", i, f"Text {i} of {s}") for s, n in enumerate(sizes) for i in range(n)]
    check(spark, rows)


def test_narrow_runs(spark):
    check(spark, [(i, None if i % 3 == 0 else "abé"[i % 3], None, None, "A" * i) for i in range(50)], width=2)


def test_hard_rows(spark):
    check(spark, [
        (None, None, None, None, None), (None, "", "", 0, ""), (5, None, "en", 3, None), (5, None, "en", 3, None), (5, None, "en", 3, "B"), (6, "é", "x", -1, "Ä" * 99999),
        (7, "z", "x", 1, "-"), (7, "~", "x", 1, "A"), *[(8, "same", "en", 1, "COPY")] * 40,
    ])


def test_empty(spark):
    assert merkle.verify(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")).collect() == []


def test_some_requests_follow_only_their_nodes(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"T{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    m = merkle.build_manifest(docs)
    asked = m.leaves.filter("key in (0, 77)").select("tree", "rank", "key", "leaf")
    got = {r.key: r for r in merkle.proofs(m, asked).withColumn("ends", merkle.folded(merkle.F.col("leaf"), merkle.F.col("path"))).collect()}
    assert set(got) == {0, 77} and all(r.ends == r.root for r in got.values())
    records = {r.digest: r.children for r in m.records.collect()}
    assert all(h(*c) == d for d, c in records.items())
