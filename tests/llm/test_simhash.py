import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from rankforge.llm import simhash


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\f\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    """rows of (key, fingerprint) to component by key list."""
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
            comp[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    low = {r: min((rows[i][0] for i in g if rows[i][0] is not None), default=None) for r, g in groups.items()}
    return [low[root(i)] for i in range(len(rows))]


@given(st.text(alphabet="ab \nÉÀZ\xa0\x1c", max_size=60))
@settings(max_examples=150, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) % 2**64 == slow_fingerprint(text)


def test_fingerprint_of_a_long_text():
    r = random.Random(1)
    text = " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(70_000))
    assert simhash.fingerprint(text) % 2**64 == slow_fingerprint(text)


def test_golay_indices_meet_within_two_bits():
    r = np.random.default_rng(2)
    words = r.integers(0, 1 << 23, 3000)
    own = [set(x) for x in simhash.golay_indices(words).tolist()]
    assert {len(x) for x in own} == {1, 6}
    for flips in (1, 2):
        for i, w in enumerate(words.tolist()):
            other = w ^ sum(1 << int(b) for b in r.choice(23, flips, replace=False))
            assert own[i] & set(simhash.golay_indices(np.array([other]))[0].tolist())


def test_keys_meet_within_three_bits():
    r = np.random.default_rng(3)
    base = r.integers(-2**63, 2**63, 4000)
    flips = np.array([sum(1 << int(b) for b in r.choice(64, r.integers(1, 4), replace=False)) for _ in base], np.uint64).view(np.int64)
    both = [{}, {}]
    for side, fps in zip(both, (base, base ^ flips)):
        for row, key in zip(*(x.tolist() for x in simhash.fuzzy_keys(fps))):
            side.setdefault(row, set()).add(key)
    assert all(both[0][i] & both[1][i] for i in range(len(base)))
    assert max(map(len, both[0].values())) <= simhash.KEYS


@pytest.mark.parametrize("block", [simhash.BLOCK, 3])
def test_near_groups_equal_brute_force(spark, block):
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdefg") for _ in range(4)) for _ in range(300)]
    rows = []
    for k in range(60):
        words = [r.choice(vocab) for _ in range(r.choice([2, 5, 40, 400]))]
        for c in range(r.choice([1, 1, 2, 6])):
            edited = list(words)
            for _ in range(c):
                edited[r.randrange(len(edited))] = r.choice(vocab)
            rows.append((len(rows), " ".join(edited)))
    base = [r.choice(vocab) for _ in range(900)]  # a family of near copies
    for c in range(60):
        rows.append((len(rows), " ".join([*base[:c], "edit", *base[c + 1:]])))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (None, "x"), (None, "x"), (1003, rows[0][1]), (1003, rows[0][1])]
    df = spark.createDataFrame([(k, t, k, "z") for k, t in rows], "doc_id long, text string, fp long, key string")
    got = sorted((str(x.doc_id), x.fingerprint, str(x.component_id)) for x in simhash.near_groups(df, block=block).collect())
    fps = [(k, slow_fingerprint(t)) for k, t in rows]
    want = sorted((str(k), f"{f:016x}", str(c)) for (k, f), c in zip(fps, slow_components(fps)))
    assert got == want


def test_near_copies_against_brute_force(spark):
    r = random.Random(6)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(3000)]
    rows = []
    for k in range(80):
        words = [r.choice(vocab) for _ in range(r.choice([1, 4, 30, 200, 500]))]
        for c in range(r.choice([1, 1, 2, 5])):
            edited = list(words)
            for _ in range(c * r.choice([0, 1, 2, 6])):
                edited[r.randrange(len(edited))] = r.choice(vocab)
            rows.append((len(rows), " ".join(edited)))
    base = [r.choice(vocab) for _ in range(400)]
    rows += [(1000 + c, " ".join([*base[:4 * c], "edit", *base[4 * c + 1:]])) for c in range(70)]
    rows += [(2000, None), (2001, ""), (2002, rows[3][1].upper()), (None, rows[5][1]), (3000, "y"), (3000, "y")]
    sets = [simhash.shingles(t or "") for _, t in rows]
    comp = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and comp[i] != comp[j]:
            old, new = comp[j], comp[i]
            comp = [new if c == old else c for c in comp]
    groups = {}
    for i, c in enumerate(comp):
        groups.setdefault(c, []).append(rows[i][0])
    want = sorted(str(min((k for k in g if k is not None), default=None)) for g in groups.values())
    df = spark.createDataFrame([(t, k, 1) for k, t in rows], "text string, doc_id long, _n int").repartition(3)
    left = simhash.drop_near_copies(df)
    got = sorted(str(x.doc_id) for x in left.collect())
    assert left.columns == df.columns and set(want) <= set(got)  # no group is lost
    assert len(got) - len(want) <= 0.02 * (len(rows) - len(want))  # and near copies are found


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert {k for k, v in got.items() if v == 0} | {0} == set(range(201)) and got[501] == 500


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_groups(df).count() == 0 and simhash.drop_near_copies(df).count() == 0


def left_by_brute_force(rows):
    """Keys that stay: the smallest of each group of (key, text) connected by similarity 0.8."""
    sets, comp = [simhash.shingles(t) for _, t in rows], list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and comp[i] != comp[j]:
            old, new = comp[j], comp[i]
            comp = [new if c == old else c for c in comp]
    return sorted(min(rows[k][0] for k in range(len(rows)) if comp[k] == c) for c in set(comp))


def test_near_copies_with_one_word_set(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(100)]
    lead, a, c = (r.sample(words, 100) for _ in range(3))
    b = [*a[:50], a[51], a[50], *a[52:]]  # one word set; only a and b are near copies
    rows = [(k, " ".join(w)) for k, w in enumerate((lead, a, c, b))]
    left = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert sorted(x.doc_id for x in left.collect()) == left_by_brute_force(rows) == [0, 1, 2]


def appended_and_removed(r, groups):
    rows = []
    for _ in range(groups):
        n = r.choice([30, 100, 200, 400])
        base = [f"w{r.randrange(10**6)}" for _ in range(n)]
        more = [f"w{r.randrange(10**6)}" for _ in range(n // 2)]
        at = r.randrange(n // 2)
        texts = [base, base + more[:int((n - 4) * r.uniform(0.18, 0.26))], base[:at] + base[at + int(n * r.uniform(0.13, 0.2)):]]
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate(texts)]
    return rows


def test_near_copies_with_appended_and_removed_passages(spark):
    rows = appended_and_removed(random.Random(8), 60)
    left = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(x.doc_id for x in left.collect()) == left_by_brute_force(rows)  # every near copy is found


def test_large_buckets_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "FREQUENT", 10**9)
    r = random.Random(9)
    shared = [f"s{i}" for i in range(60)]
    rows = [(k, " ".join(shared + [f"w{r.randrange(10**6)}" for _ in range(60)])) for k in range(40)]
    rows += [(100 + k, " ".join([*t.split()[:-8], *(f"x{k}y{i}" for i in range(8))])) for k, t in rows]
    df = spark.createDataFrame(rows, "row long, text string")
    got = {x.node: x.root for x in simhash.components(simhash.similar_links(df, block=7)).collect()}
    assert sorted({got.get(k, k) for k, _ in rows}) == left_by_brute_force(rows)


def test_parity_maps_lose_no_similar_pair():
    import numpy as np

    r = np.random.default_rng(1)
    for n in (1, 5, 200, 3000):
        a = r.integers(0, 2**63, n).astype(np.uint64)
        b = np.r_[a[n // 10:], r.integers(0, 2**63, n // 10).astype(np.uint64)]
        small, large = simhash.wide_map(a[:n // 2 + 1]), simhash.wide_map(b)
        folded = np.bitwise_xor.reduce(large.reshape(-1, len(small)), axis=0)
        assert (folded == simhash.parity_map(b, len(small))).all()
        apart = len(set(a.tolist()) ^ set(b.tolist()))
        assert np.bitwise_count(simhash.parity_map(a) ^ simhash.parity_map(b)).sum() <= apart
        assert np.bitwise_count(simhash.wide_map(a) ^ simhash.wide_map(b)).sum() <= apart


def test_the_sign_bit_is_a_bit_like_others():
    import numpy as np

    fps = np.array([0b1, -(1 << 63), -(1 << 63) + 0b110, -1], np.int64)
    assert {frozenset(x) for x in simhash.forest(fps)} == {frozenset((1, -(1 << 63))), frozenset((-(1 << 63), -(1 << 63) + 6))}
