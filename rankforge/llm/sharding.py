"""Sharding by a hierarchical weighted hash tree.

Shards hang under racks, racks under regions. A row descends: at every level each child
draws ``-ln(u) / weight`` from a hash of the child and the row's key, and the least draw
takes the row. A child is taken in proportion to its weight, and a draw depends on no
sibling: when a weight changes, rows move only into, out of or inside the subtrees whose
weights changed. Nothing is looked up or shuffled to place a row.

A shard added to a full rack would raise the weights above it, and its neighbours would
get some of the rows that this draws in. So a new shard opens a region of its own: all
other draws stay, and rows move to the new shard only.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.functions.hashing import HEX_DIGITS, hash_long
from rankforge.llm.shared import col, free_name, text_of
from rankforge.operators.ordering import running_totals

SHARDS, RACKS, PER_RACK = 16, 2, 4
LEVELS = ("region", "rack", "shard")
SEED = "tree"


class Shard(NamedTuple):
    shard: int
    weight: float
    rack: int
    region: int


def tree(shards: int = SHARDS, base: int = SHARDS, racks: int = RACKS, per_rack: int = PER_RACK) -> list[Shard]:
    """Shards of weight one: the first ``base`` of them fill regions of ``racks`` racks of
    ``per_rack`` shards, each later one has a region of its own."""
    out = [Shard(s, 1.0, s // per_rack, s // per_rack // racks) for s in range(min(shards, base))]
    rack, region = (-(-base // per_rack), -(-base // (per_rack * racks)))
    return out + [Shard(s, 1.0, rack + i, region + i) for i, s in enumerate(range(base, shards))]


def _children(shards: Sequence[Shard]) -> dict[str, dict[int, dict[int, float]]]:
    """level -> parent -> child -> weight; subtrees without weight are left out."""
    out: dict[str, dict[int, dict[int, float]]] = {level: {} for level in LEVELS}
    for s in shards:
        if s.weight > 0:
            for level, parent, child in (("region", 0, s.region), ("rack", s.region, s.rack), ("shard", s.rack, s.shard)):
                group = out[level].setdefault(parent, {})
                group[child] = group.get(child, 0.0) + s.weight
    if not out["region"]:
        raise ValueError("no shard has a weight")
    return out


def _pick(level: str, groups: dict[int, dict[int, float]], parent: Column, key: Column, seed: str) -> Column:
    """The child of ``parent`` with the least draw."""
    listed = F.create_map(*[
        x for p, group in groups.items()
        for x in (F.lit(p), F.array(*[F.struct(F.lit(n).alias("node"), F.lit(float(w)).alias("weight")) for n, w in group.items()]))
    ])

    def draw(child: Column) -> Column:
        u = (hash_long(seed, level, child["node"], key) + 0.5) / F.lit(float(16**HEX_DIGITS))
        return F.struct((-F.ln(u) / child["weight"]).alias("draw"), child["node"].alias("node"))

    return F.array_min(F.transform(F.element_at(listed, parent), draw))["node"]


def place(rows: DataFrame, shards: Sequence[Shard], key: str | Column, names: Sequence[str] = LEVELS, seed: str = SEED) -> DataFrame:
    """Add the region, the rack and the shard of every row, under ``names``."""
    parent = F.lit(0)
    for level, groups, name in zip(LEVELS, _children(shards).values(), names):
        rows = rows.withColumn(name, _pick(level, groups, parent, col(key), seed))
        parent = F.col(name)
    return rows


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """One row per input row: key, size (bytes of the text plus 1), text_crc32, law ("key"),
    region, rack, shard, slot (gapless from 0 in the shard, by key) and grown_shard (the
    shard if there were one more).

    Defined cases: a null text has no bytes and the crc32 of none; a null key is a key of
    its own and the last of its shard; rows with one key lie in one shard, in slots that
    follow each other; equal texts under different keys are placed apart; other columns
    are ignored; an empty table gives no rows.
    """
    raw = text_of(text).cast("binary")
    rows = docs.select(
        col(key).alias("_key"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = place(place(rows, tree(shards, shards), "_key", seed=seed), tree(shards + 1, shards), "_key", ("_region", "_rack", "grown_shard"), seed)
    slots = running_totals(rows.drop("_region", "_rack"), ["shard"], [F.col("_key").isNull(), "_key", "text_crc32", "size", "_row"])
    return slots.select(
        F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), *LEVELS, F.col("before").alias("slot"), "grown_shard",
    )


def write_shards(docs: DataFrame, path: str, shards: Sequence[Shard] | None = None, key: str = "doc_id", files: int = 1, seed: str = SEED) -> list[str]:
    """Write the documents to ``path`` in folders region, rack and shard, ``files`` files or
    more a shard, and return the names of the folder columns.

    A name that the documents have is not taken: the folder column gets underscores behind
    it. Rows of one key go to one file."""
    names = []
    for level in LEVELS:
        names.append(free_name(level, [*docs.columns, *names]))
    part = free_name("part", [*docs.columns, *names])
    placed = place(docs, tree() if shards is None else shards, key, names, seed)
    spread = placed.withColumn(part, F.pmod(F.xxhash64(col(key)), F.lit(files)))
    spread.repartition(names[-1], part).drop(part).write.partitionBy(*names).parquet(path)
    return names


def _level_sql(name: str, level: str, before: str, keep: str = "") -> str:
    return f"""
{name} AS (SELECT doc_id, row, {keep} arg_min(node, -ln((('0x' || substr(md5(concat_ws('|', '{SEED}', '{level}', node, doc_id)), 1, {HEX_DIGITS}))::BIGINT
           + 0.5::DOUBLE) / 16::DOUBLE ** {HEX_DIGITS}) / weight) AS {level} FROM {before} GROUP BY ALL)"""


SQL = f"""
WITH fix AS (SELECT n, list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n) AS c FROM range(256) t(n)),
crc AS (SELECT list(c ORDER BY n) AS fixes FROM fix),
d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents),
b AS (SELECT doc_id, row, strlen(text) + 1 AS size,
             list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM d),
c AS (SELECT doc_id, row, size, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, fixes[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32
      FROM b, crc),
{_level_sql("r1", "region", "d, (VALUES (0, 8), (1, 8)) v(node, weight)")},
{_level_sql("r2", "rack", "r1, (VALUES (0, 4), (1, 4), (2, 4), (3, 4)) v(node, weight) WHERE node // 2 = region", "region,")},
{_level_sql("r3", "shard", "r2, (SELECT range AS node, 1 AS weight FROM range(16)) WHERE node // 4 = rack", "region, rack,")},
{_level_sql("g", "region", "d, (VALUES (0, 8), (1, 8), (2, 1)) v(node, weight)")}
SELECT doc_id, c.size::BIGINT AS size, c.text_crc32::BIGINT AS text_crc32, 'key' AS law, r3.region::INT AS region, r3.rack::INT AS rack, r3.shard::INT AS shard,
       row_number() OVER (PARTITION BY r3.shard ORDER BY doc_id NULLS LAST, c.text_crc32, c.size) - 1 AS slot,
       (CASE WHEN g.region = 2 THEN 16 ELSE r3.shard END)::INT AS grown_shard
FROM c JOIN r3 USING (doc_id, row) JOIN g USING (doc_id, row)
"""
