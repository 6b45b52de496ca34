import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from rankforge.llm import lm_score as lm


def tokens_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w] + [None]


def plain(rows):
    """Dictionary counts, and weights by EM on every occurrence without bins."""
    train = [tokens_of(t) for k, t in rows if zlib.crc32(("" if k is None else str(k)).encode()) % 5 != 1]
    one, two = Counter(w for d in train for w in d), Counter(p for d in train for p in zip(["<s>", *d[:-1]], d))
    n, v = sum(one.values()), len(one)
    context = lambda u: len(train) if u == "<s>" else one[u]
    held = {}
    for (u, w), c in two.items():
        c1 = context(u) - 1
        held.setdefault(int(lm.context_bucket(np.array([c1]))[0]), []).append((c, (c - 1) / max(c1, 1), (one[w] - 1) / max(n - 1, 1), 1 / (v + 1)))

    def em(rows, prior=0.0):
        a = np.array(rows)
        w = np.full(3, 1 / 3)
        for _ in range(lm.ROUNDS):
            s = a[:, 1:] * w
            s /= s.sum(axis=1, keepdims=True)
            w = prior + (s * a[:, :1]).sum(axis=0)
            w /= w.sum()
        w = np.maximum(w, (0, 1e-6, 1e-6))
        return w / w.sum()

    rest = em([r for x in held.values() for r in x]) if held else np.array([0.0, 0.0, 1.0])
    weights = {b: em(x, lm.PRIOR * rest) for b, x in held.items()}
    out = []
    for k, t in rows:
        d = tokens_of(t)
        base = sum(math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in d)
        score = 0
        for u, w in zip(["<s>", *d[:-1]], d):
            c1 = context(u)
            m = weights.get(int(lm.context_bucket(np.array([c1]))[0]), rest)
            score += math.log10(m[0] * two[u, w] / max(c1, 1) + m[1] * one[w] / max(n, 1) + m[2] / (v + 1))
        out.append((k, zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 1, len(d), sum(one[w] > 0 for w in d), n, base, score))
    return out


@pytest.mark.parametrize("chunk,bucket", [(lm.CHUNK, lm.BUCKET), (50, 300)])
def test_scores_equal_plain_counts(spark, chunk, bucket):
    r = random.Random(5)
    vocab = ["The", "of", "é", "É"] + ["w" + str(int(r.paretovariate(0.6))) for _ in range(200)]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 60)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "\n\t "), (503, "a b\x0bc\x0cd\re\x1cf\xa0g"), (504, rows[0][1]), (504, rows[0][1]), (None, "of the"), (505, "long text " * 4000)]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, key string, chunk int").repartition(3, "doc_id")
    got = sorted(map(tuple, lm.score_documents(df, chunk=chunk, bucket=bucket).collect()), key=repr)
    want = sorted(plain(rows), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9)
    assert [g[6] for g in got] == pytest.approx([w[6] for w in want], rel=0.02)  # weights come from bins


def test_weights_improve_on_single_estimates():
    two, one, n = np.array([0.5, 0.0, 0.1, 0.0]), np.array([0.01, 0.02, 0.0, 0.0]), np.array([50.0, 30.0, 10.0, 10.0])
    code = (3 * lm.BINS + lm._bin(two)) * lm.BINS + lm._bin(one)
    w = lm.mixture_weights(code, n, two * n, one * n, 100)
    assert w.shape == (lm.CONTEXTS, 3) and np.allclose(w.sum(axis=1), 1) and (w[:, 2] > 0).all() and w[3, 0] > 0.3


def test_slices_hold_the_same_words(monkeypatch):
    monkeypatch.setattr(lm, "SLICE", 7)
    for raw in (b"", b" ", b"a" * 50, b"ab cd\nefghijklmnop  q " * 9):
        assert [w for s in lm.word_slices(raw) for w in s] == raw.split()


def test_packed_integers():
    for a in ([], [0], [2**64 - 1, 0, 5]):
        assert lm.unpacked(lm.packed(np.array(a, np.uint64))).tolist() == a


def test_no_training_texts_and_empty_table(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    df = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    assert [tuple(r) for r in lm.score_documents(df).collect()] == [(held, True, 3, 0, 0, 0.0, pytest.approx(0, abs=1e-5))]
    assert lm.score_documents(df.limit(0)).count() == 0
