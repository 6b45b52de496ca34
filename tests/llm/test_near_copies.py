"""The pipeline's near-copy stage against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

from rankforge.llm import near_copies as nc


def shingles(words, size=5):
    return [tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def covered(a, b, size=5):
    """Share of the words of both texts in common shingles, word by word."""
    if not a or not b:
        return float(a == b)
    n = 0
    for own, other in ((a, b), (b, a)):
        known = set(shingles(other, size))
        marked = set()
        for i, s in enumerate(shingles(own, size)):
            if s in known:
                marked |= set(range(i, min(i + size, len(own))))
        n += len(marked)
    return n / (len(a) + len(b))


def groups(rows):
    words = [tuple((t or "").encode().lower().split()) for _, t in rows]
    comp = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if comp[i] != comp[j] and (words[i] == words[j] or min(len(words[i]), len(words[j])) >= 5 and covered(words[i], words[j]) >= 0.8):
            old, new = comp[j], comp[i]
            comp = [new if c == old else c for c in comp]
    out = {}
    for i, c in enumerate(comp):
        out.setdefault(c, []).append(rows[i][0])
    return list(out.values())


def texts(r, families, edits):
    vocab = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(3000)]
    rows = []
    for _ in range(families):
        words = [r.choice(vocab) for _ in range(r.choice([1, 4, 30, 200, 500]))]
        for _ in range(r.choice([1, 1, 2, 5])):
            own = list(words)
            for _ in range(r.choice([0, 1, len(own) // edits])):
                own[r.randrange(len(own))] = r.choice(vocab)
            rows.append((len(rows), " ".join(own)))
    return rows


def test_coverage_by_hashes():
    r = random.Random(1)
    for _ in range(200):
        a = [r.choice("abcdefghijklmnopqrstuvwxyz").encode() for _ in range(r.randint(5, 60))]
        b = list(a)
        for _ in range(r.randint(0, 6)):
            b[r.randrange(len(b))] = r.choice([b"x", b"y", b"new"])
        assert nc.covered(nc.shingle_sequence(a, 5), nc.shingle_sequence(b, 5), 5) == pytest.approx(covered(a, b))


def test_fingerprint_is_the_sign_of_sums():
    words = [b"a", b"b", b"a", b"c", b"d", b"a"]
    sums = sum(nc.word_bits([w])[0].astype(int) for w in set(words))
    got = np.unpackbits(nc.fingerprints([words, []])[0].astype(">i8").view(np.uint8))
    assert len(got) == 192
    assert (got == (sums > 0)).all() and not nc.fingerprints([[]]).any()


@pytest.mark.parametrize("cell", [nc.CELL, 3])
def test_left_documents_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(nc, "SAMPLE", 2 if cell == 3 else nc.SAMPLE)
    r = random.Random(6)
    rows = texts(r, 70, 20)
    base = rows[2][1].split() * 3 + [f"w{i}" for i in range(300)]
    rows += [(1000 + c, " ".join([*base[:7 * c], "edit", *base[7 * c + 1:]])) for c in range(40)]
    rows += [(2000, None), (2001, ""), (2002, rows[3][1].upper()), (None, rows[5][1]), (3000, "y"), (3000, "y")]
    df = spark.createDataFrame([(t, k, 1, 2) for k, t in rows], "text string, doc_id long, row int, root int").repartition(3)
    got_rows = nc.near_roots(_numbered(spark, rows), cell=cell).collect()
    got = {}
    for x in got_rows:
        got.setdefault(x.root, []).append(x.row)
    want = groups([(i, t) for i, (_, t) in enumerate(rows)])
    assert len(got_rows) == len(rows)
    pairs = lambda gs: {p for g in gs for p in combinations(sorted(g), 2)}
    found, true = pairs(got.values()), pairs(want)
    assert found <= true and len(found) >= 0.98 * len(true)
    if cell == nc.CELL:
        left = nc.drop_near_copies(df)
        assert left.columns == df.columns
        kept = sorted(str(x.doc_id) for x in left.collect())
        best = sorted(str(min((k for k in g if k is not None), default=None)) for g in groups(rows))
        assert set(best) <= set(kept) and len(kept) - len(best) <= 0.02 * len(rows)


def _numbered(spark, rows):
    return spark.createDataFrame([(i, t or "") for i, (_, t) in enumerate(rows)], "row long, text string").repartition(3)


def test_one_word_set_in_different_orders(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(100)]
    lead, a, c = (r.sample(words, 100) for _ in range(3))
    b = [*a[:50], a[51], a[50], *a[52:]]  # one fingerprint; only a and b are near copies
    orders = [r.sample(words, 100) for _ in range(30)]
    rows = [(k, " ".join(w)) for k, w in enumerate((lead, a, c, b, *orders))]
    left = nc.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert sorted(x.doc_id for x in left.collect()) == [0, 1, 2, *range(4, 34)]


def test_a_group_whose_first_text_is_far_from_the_rest(spark):
    """Chains of edits: only neighbours are near copies, and all are one group."""
    r = random.Random(8)
    at = [f"w{r.randrange(10**6)}" for _ in range(300)]
    rows = []
    for k in range(25):
        rows.append((k, " ".join(at)))
        spot = 30 * (k % 10)
        at = [*at[:spot], *(f"n{k}x{i}" for i in range(4)), *at[spot + 4:]]
    left = nc.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert [x.doc_id for x in left.collect()] == [0]


def test_shared_passages_do_not_make_copies(spark):
    r = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = [(k, " ".join(passage + [f"w{r.randrange(10**6)}" for _ in range(60)])) for k in range(60)]
    left = nc.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert left.count() == 60


def test_empty_table(spark):
    assert nc.drop_near_copies(spark.createDataFrame([], "doc_id long, text string, row long")).count() == 0
