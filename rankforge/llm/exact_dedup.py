"""Exact deduplication by deterministic block naming.

A text without its white space is cut into blocks of fixed size. Sorting the
different blocks gives each an integer name. Then two neighbouring names at a time
are named again, by sorting the different pairs, until one name is left for every
document. Names are equal exactly where the texts are: no fingerprint decides.

Blocks are sorted by a 64-bit hash first and by their text second. Texts meet only
where blocks are told apart: each task sends one copy of a block, so a passage
that a third of all documents repeat is sent once per task. If no two different
blocks share a hash (this is checked on all of them, every time), the hash finds a
block's name; if some do, those blocks are found by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.llm.shared import col, free_name, text_of, without_spaces
from rankforge.operators.ordering import running_totals
from rankforge.session import materialize

BLOCK = 1 << 14


def blocks_of(text: Column, size: int) -> Column:
    """The text as an array of blocks of ``size`` code points; at least one block."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(pieces)


def name_keys(rows: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """Replace integer ``keys`` by one integer: the place of the keys among the
    different keys in sorted order. Each task sends a key once."""
    distinct = rows.select(*keys).distinct()
    named = running_totals(distinct, [], keys).select(*keys, F.col("before").alias(name))
    return rows.join(named, keys).drop(*keys)


def _clashes(blocks: DataFrame) -> DataFrame | None:
    """(h, block, ordinal) of different blocks with one hash, or None if there are none."""
    different = blocks.select("h", "block").distinct()
    shared = materialize(different.groupBy("h").count().filter("count > 1").select("h"))
    if shared.isEmpty():
        return None
    numbered = different.join(shared, "h").withColumn(
        "ordinal", F.row_number().over(Window.partitionBy("h").orderBy("block")).cast("long")
    )
    return materialize(numbered)


def text_identities(docs: DataFrame, text: Column, keep: dict[str, Column], block: int = BLOCK, hashed: Column | None = None) -> DataFrame:
    """One row per input row: the columns of ``keep``, a row number ``row``, and
    ``identity`` (levels, name), equal exactly for equal texts."""
    hashed = F.xxhash64("block") if hashed is None else hashed
    # The row number comes before the blocks are exploded: all blocks of a row share it.
    cut = docs.select(
        F.monotonically_increasing_id().alias("row"), *[c.alias(n) for n, c in keep.items()], blocks_of(text, block).alias("_blocks")
    )
    blocks = cut.select("row", *keep, F.size("_blocks").alias("n"), F.posexplode("_blocks").alias("i", "block")).withColumn("h", hashed)
    clashes = _clashes(blocks)
    if clashes is None:
        blocks = blocks.withColumn("ordinal", F.lit(0).cast("long"))
    else:
        blocks = blocks.join(clashes, ["h", "block"], "left").withColumn("ordinal", F.coalesce("ordinal", F.lit(0).cast("long")))
    first = F.col("i") == 0
    level = materialize(blocks.select(
        "row", "n", "i", "h", "ordinal", *[F.when(first, F.col(c)).alias(c) for c in keep]
    ))
    about = level.filter(first).select("row", *keep)
    named = materialize(name_keys(level.select("row", "n", "i", "h", "ordinal"), ["h", "ordinal"]))
    depth, done = 0, []
    while True:
        done.append(named.filter("n = 1").select("row", F.struct(F.lit(depth).alias("levels"), "name").alias("identity")))
        open_rows = named.filter("n > 1")
        if open_rows.isEmpty():
            break
        pairs = (
            open_rows.groupBy("row", F.expr("i div 2").cast("int").alias("j"), F.expr("(n + 1) div 2").cast("int").alias("m"))
            .agg(
                F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1).cast("long")).alias("right"),
            )
            .withColumnsRenamed({"j": "i", "m": "n"})
        )
        named = materialize(name_keys(pairs, ["left", "right"]))
        depth += 1
    identities = done[0]
    for more in done[1:]:
        identities = identities.unionByName(more)
    return about.join(identities, "row")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK, hashed: Column | None = None) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after all white space is deleted; of equal texts
    the one with most code points stays, then the one with the smallest key.

    Defined cases: a null text is the empty text; empty texts are one group; rows that
    agree in text and key count one by one and exactly one of them is kept; a null key
    comes after all others; other columns are ignored; an empty table gives no rows.
    """
    bare = without_spaces(text)
    rows = materialize(text_identities(
        docs, bare,
        {"key": col(key), "chars": F.length(text_of(text)).cast("long"), "text_sha256": F.sha2(bare.cast("binary"), 256)},
        block, hashed,
    ))
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("key").isNull().alias("u"), F.col("key").alias("k"), F.col("row").alias("r")))
    groups = rows.groupBy("identity").agg(best.alias("_best"), F.count("*").alias("group_size"))
    return rows.join(groups, "identity").select(
        F.col("key").alias(key), F.col("_best.k").alias("keep_id"), "group_size",
        (F.col("row") == F.col("_best.r")).alias("kept"), "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The documents with one row of every group of equal texts left, the one that
    ``exact_groups`` keeps. A row is found by key, digest and length; rows that agree in
    all three are the same to the rule, and one of them is left. Other columns may have any
    names and stay as they are."""
    bare = without_spaces(text)
    k, null, sha, chars, nth = (free_name(n, docs.columns) for n in ("_k", "_null", "_sha", "_chars", "_nth"))
    about = {k: F.coalesce(col(key).cast("string"), F.lit("")), null: col(key).isNull(), sha: F.sha2(bare.cast("binary"), 256),
             chars: F.length(text_of(text)).cast("long")}
    rows = materialize(text_identities(docs, bare, {"key": col(key), **about}, block))
    best = F.min_by(F.struct(*about), F.struct((-F.col(chars)).alias("c"), F.col(null).alias("u"), F.col("key").alias("k"), F.col("row").alias("r")))
    stay = rows.groupBy("identity").agg(best.alias("_best")).select("_best.*")
    first = Window.partitionBy(*about).orderBy(F.lit(0))
    return docs.withColumns(about).join(stay, list(about)).withColumn(nth, F.row_number().over(first)).filter(F.col(nth) == 1).select(*docs.columns)


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
           FROM documents),
w AS (SELECT *, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size FROM d
      WINDOW g AS (PARTITION BY bare ORDER BY chars DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM w
"""
