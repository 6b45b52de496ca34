"""The pipeline against a plain version, stage by stage on the stage's own input."""

import hashlib
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
pytest.importorskip("public_tokenizers")

import corpus_pipeline as pipeline  # noqa: E402
from rankforge.llm import exact_dedup, mixing, quality  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(7)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(800)]
    good = lambda n: " ".join(r.choice(vocab) for _ in range(n)).capitalize() + "."
    bad = lambda n: " ".join(r.choice(vocab).upper() + "!!" for _ in range(n))
    docs = [(i, good(r.randint(3, 300)) if i % 4 else bad(r.randint(20, 200))) for i in range(160)]
    docs += [(200 + i, docs[i][1].replace(" ", "  ")) for i in range(1, 12)]
    long = good(900).split(" ")
    docs += [(300 + i, " ".join([*long[:40 * i], "edit", *long[40 * i + 1:]])) for i in range(6)]
    docs += [(400, None), (401, ""), (402, good(40_000)), (402, docs[1][1]), (None, good(50)), (1, docs[1][1])]
    folder = tmp_path_factory.mktemp("pipeline")
    rows = [(k, t, "en", ["a", "b", None, "a", "a"][n % 5], len(t or "")) for n, (k, t) in enumerate(docs)]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 4 > 0), 0) for i in range(160)] + [(3, None, 0), (5, 1, 0), (999, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def bare(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def test_stages_decide_as_the_plain_version(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = [tuple(x) for x in docs.collect()]

    kept = pipeline.good_documents(spark, docs, folder)
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = [x for x in before if model.score(quality.features(x[1] or "")) >= quality.THRESHOLD]
    assert kept.columns == docs.columns and Counter(map(tuple, kept.collect())) == Counter(want)
    held = [x for x in before if x[0] is not None and x[0] < 160 and zlib.crc32(str(x[0]).encode()) % 5 == 0]
    assert all((x in want) == (x[0] % 4 > 0) for x in held)

    kept = kept.cache()
    rows = [tuple(x) for x in kept.collect()]
    groups = {}
    for x in rows:
        groups.setdefault(bare(x[1]), []).append(x)
    best = [min(g, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0)) for g in groups.values()]
    unique = pipeline.different_texts(spark, kept, folder)
    assert unique.columns == docs.columns and Counter(map(tuple, unique.collect())) == Counter(best)

    unique = unique.cache()
    near = pipeline.without_near_copies(spark, unique, folder)
    left = [tuple(x) for x in near.collect()]
    assert near.columns == docs.columns and not Counter(left) - Counter(best)
    gone = {x[0] for x in best} - {x[0] for x in left}
    assert {301, 302, 303, 304, 305} == gone

    near = near.cache()
    taken = Counter({k: 0 for k in left})
    for x in mixing.weighted_fair_mix(near).collect():
        same = [k for k in left if k[0] == x.doc_id and k[3] == x.source and len((k[1] or "").split()) == x["size"]]
        assert len(same) == 1
        taken[same[0]] += x.copies
    mixed = pipeline.mixed_sources(spark, near, folder)
    assert mixed.columns == docs.columns and Counter(map(tuple, mixed.collect())) == +taken
    words = sum(len((x[1] or "").split()) for x in left)
    total = sum(len((k[1] or "").split()) * n for k, n in taken.items())
    assert abs(total - 1.5 * words) <= max(len((x[1] or "").split()) for x in left)

    packed = pipeline.packed_sequences(spark, mixed.cache(), folder).collect()
    assert Counter(x.doc_id for x in packed if x.start == 0) == Counter(k[0] for k in taken.elements())


def test_run(spark, folder):
    rows = pipeline.run(spark, folder).collect()
    assert sum(x.length for x in rows) > 0 and {x.offset + x.length <= 2048 for x in rows} == {True}


def test_weak_hash_does_not_merge_blocks(spark):
    from pyspark.sql import functions as F

    texts = ["abcdefgh", "abcdefgx", "abcd", "abcdefgh ", "", None, "x", "efgh", "abcdefghi" * 5, "abcdefghi" * 5]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for hashed in (F.lit(1).cast("long"), F.length("block").cast("long"), None):
        rows = exact_dedup.exact_groups(df, block=3, hashed=hashed).collect()
        assert {r.doc_id: r.keep_id for r in rows} == {0: 3, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 8}
        assert all(r.text_sha256 == hashlib.sha256(bare(texts[r.doc_id]).encode()).hexdigest() for r in rows)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    assert quality.score_documents(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).count() == 0


CLASHES = ("_score", "score", "copies", "_copies", "_copy", "_i", "_k", "_s", "_e", "_size", "size", "_sha", "_nth", "_null", "_chars", "row", "_row", "root", "key")


def test_columns_of_any_name_stay_as_they_are(spark, folder):
    plain = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id is not null and length(text) < 9000").dropDuplicates(["doc_id"])
    docs = plain.select("*", *[(plain.doc_id * 100 + n).alias(c) for n, c in enumerate(CLASHES)]).cache()
    for name, stage in pipeline.STAGES[:-1]:
        left = stage(spark, docs, folder)
        assert left.columns == docs.columns
        rows = left.collect()
        assert rows and all(r[c] == r.doc_id * 100 + n for r in rows for n, c in enumerate(CLASHES)), name
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in stage(spark, plain.cache(), folder).collect()), name
