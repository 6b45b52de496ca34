"""Hash-tree placement: proportions, movement, slots and hard rows."""

import zlib
from collections import Counter
from math import sqrt

import pytest
from pyspark.sql import functions as F

from rankforge.llm import sharding
from rankforge.llm.sharding import Shard


@pytest.fixture(scope="module")
def keys(spark):
    return spark.range(20000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("t")).cache()


def placed(keys, shards):
    return {r.doc_id: (r.region, r.rack, r.shard) for r in sharding.place(keys, shards, "doc_id").collect()}


def test_rows_follow_weights(keys):
    shards = [Shard(0, 1.0, 0, 0), Shard(1, 2.0, 0, 0), Shard(2, 3.0, 1, 0), Shard(3, 0.5, 2, 1), Shard(4, 3.5, 3, 1), Shard(5, 0.0, 4, 2)]
    counts = Counter(s for *_, s in placed(keys, shards).values())
    for s in shards:
        share = s.weight / 10
        assert abs(counts[s.shard] - 20000 * share) <= 5 * sqrt(20000 * share * (1 - share)) + 1e-9


def test_movement_stays_in_subtrees_whose_weight_changed(keys):
    before = sharding.tree()
    after = [s._replace(weight=2.5) if s.shard == 5 else s for s in before]
    a, b = placed(keys, before), placed(keys, after)
    moved = {k for k in a if a[k] != b[k]}
    assert moved
    for k in moved:  # shard 5 is in rack 1 of region 0
        (r0, k0, s0), (r1, k1, s1) = a[k], b[k]
        assert r1 == 0 if r0 != r1 else r0 == 0
        if r0 == r1 and k0 != k1:
            assert k1 == 1
        if r0 == r1 and k0 == k1:
            assert k0 == 1 and s1 == 5
    light = [s._replace(weight=0.0) if s.shard == 5 else s for s in before]
    c = placed(keys, light)
    assert all(a[k][0] == 0 for k in a if a[k] != c[k]) and not any(v[2] == 5 for v in c.values())


@pytest.mark.parametrize("n", [1, 3, 16, 20])
def test_one_more_shard_takes_rows_only_into_itself(keys, n):
    rows = sharding.assign_shards(keys, shards=n).collect()
    again = {r.doc_id: r.shard for r in sharding.assign_shards(keys, shards=n + 1).collect()} if n != 16 else None
    moved = [r for r in rows if r.grown_shard != r.shard]
    assert {r.grown_shard for r in moved} == {n}
    share = 1 / (n + 1)
    assert abs(len(moved) - 20000 * share) <= 5 * sqrt(20000 * share * (1 - share))
    if n >= 16 and again:
        assert len(again) == len(rows)


def test_hard_rows(spark, tmp_path):
    long = "wörd " * 50000
    docs = spark.createDataFrame(
        [(None, None, 1, "x"), (None, "", 2, "x"), (7, "same", 3, "x"), (7, "same", 3, "x"), (8, "same", 4, "x"), (9, long, 5, "x")],
        "doc_id long, text string, shard int, _key string",
    ).repartition(3)
    rows = sharding.assign_shards(docs).collect()
    assert sorted(r["size"] for r in rows) == sorted([1, 1, 5, 5, 5, len(long.encode()) + 1])
    for r in rows:
        if r.doc_id == 9:
            assert r.text_crc32 == zlib.crc32(long.encode())
    assert len({r.shard for r in rows if r.doc_id == 7}) == 1
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append((r.slot, r.doc_id is None))
    for slots in by.values():
        assert [s for s, _ in sorted(slots)] == list(range(len(slots))) and [n for _, n in sorted(slots)] == sorted(n for _, n in slots)
    assert sharding.assign_shards(docs.limit(0)).collect() == []
    names = sharding.write_shards(docs, str(tmp_path / "out"), files=3)
    assert names == ["region", "rack", "shard_"]
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert {(r.doc_id, r.shard_) for r in back.collect()} == {(r.doc_id, r.shard) for r in rows}


def test_weights_are_needed():
    with pytest.raises(ValueError):
        sharding._children([Shard(0, 0.0, 0, 0)])
