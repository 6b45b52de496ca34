"""Runs by maximal pairs against a brute-force search."""

import hashlib
import random
import zlib

import pytest

from rankforge.llm import periodic


def brute(w, least=6, times=4):
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and j > i:
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def made(rng):
    words = []
    for _ in range(rng.randint(0, 6)):
        unit = [rng.choice("abcd"[: rng.randint(1, 4)]).encode() for _ in range(rng.randint(1, 6))]
        words += unit * rng.choice([1, 1, 2, 4, 5, 9])
        words += unit[: rng.randint(0, len(unit))]
    return words


@pytest.mark.parametrize("least,times", [(6, 4), (2, 2), (10, 3)])
def test_runs_equal_brute_force(least, times):
    rng = random.Random(5)
    for _ in range(400):
        texts = [made(rng) for _ in range(rng.randint(0, 5))]
        assert periodic.runs_of_texts(texts, least, times) == [brute(w, least, times) for w in texts]


def test_long_texts_are_not_quadratic():
    rng = random.Random(6)
    one = [b"a"] * 60000
    marked = [w for i in range(10000) for w in (b"p", b"q", b"r", b"s", b"t", str(i).encode())]
    assert periodic.runs_of_texts([one, marked]) == [[(0, 60000, 1)], []]
    noise = [rng.choice([b"a", b"b"]) for _ in range(3000)]
    assert periodic.runs_of_texts([noise]) == [brute(noise)]


def expected(key, text):
    """The contract's digest row, by brute force."""
    words = [w for w in (text or "").encode().split()]
    h = None if key is None else zlib.crc32(str(key).encode())
    if h is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    shown = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (key, len(runs), *shown, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query_rows(spark, monkeypatch):
    rng = random.Random(7)
    texts = [None, "", " \n\t", "a", "a a a a a a", "    x\x0b\x0cx\r", "é " * 300, "w" * 50000, *[" ".join(w.decode() for w in made(rng)) for _ in range(150)]]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts * 3)] + [(None, "b " * 9, "x", "y")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, _words string").repartition(3)
    got = [tuple(r) for r in periodic.run_digests(periodic.find_runs(periodic.planted(docs))).collect()]
    assert sorted(map(str, got)) == sorted(str(expected(k, t)) for k, t, *_ in rows)
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, *_ in rows if k is not None) > 10
    assert periodic.run_digests(periodic.find_runs(periodic.planted(docs.limit(0)))).collect() == []


def test_slices_and_plain_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x y " * 5 + "end of it") for i in range(20)], "doc_id long, text string").coalesce(1)
    rows = periodic.find_runs(docs).collect()
    assert all(r.collapsed == "x y end of it" and [tuple(x) for x in r.runs] == [(0, 10, 2)] and r.n_words == 13 for r in rows)
    monkeypatch.setattr(periodic, "SLICE", 20)
    assert [tuple(r) for r in periodic.find_runs(docs).collect()] == [tuple(r) for r in rows]
