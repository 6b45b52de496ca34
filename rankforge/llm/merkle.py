"""A Merkle manifest of a dataset as a content-addressed graph.

Every row has a leaf digest. In each source, runs of ``WIDTH`` neighbouring nodes become
one parent, up to a subroot; subroots, ordered by source, become the root in the same
way. The manifest stores one record per parent: its digest and those of its children.

A proof is found by descent. A leaf is requested by its source and rank; the rank's
digits to the base ``WIDTH`` say which child to follow from the root, and the children
not followed are collected. Requests that agree in their leading digits travel as one
row until the digits part, so a level of the descent has a row per node, not per leaf, and
requests meet their path at the last step only. Segments are put in front of the path as
they are found, so a path reads from the leaf to the root.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.llm.shared import col
from rankforge.operators.ordering import running_totals
from rankforge.session import materialize

WIDTH = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<before:string,after:string>>"


class Manifest(NamedTuple):
    """``leaves``: key, tree, rank, n, leaf, altered. ``records``: part ("source" or "root"),
    height above the leaves of its part, digest, children; a digest once per height.
    ``subroots``: tree, rank of the source, digest, height."""
    leaves: DataFrame
    records: DataFrame
    subroots: DataFrame
    root: DataFrame
    heights: dict[str, int]


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(fields: Sequence[Column]) -> Column:
    """The digest of a row: each field its UTF-8 length, a colon and its text, or - for null."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return digest(F.concat(*[part(c) for c in fields]))


def _parents(nodes: DataFrame, by: Sequence[str], width: int) -> DataFrame:
    """Nodes (by, rank, digest, n) to their parents, with the digests of the children."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "digest")))  # at most ``width`` of them
    return (
        nodes.groupBy(*by, F.expr(f"rank div {width}").alias("rank"), F.expr(f"(n + {width - 1}) div {width}").alias("n"))
        .agg(F.transform(listed, lambda s: s["digest"]).alias("children"))
        .withColumn("digest", digest(F.array_join("children", "")))
    )


def _grown(nodes: DataFrame, by: Sequence[str], width: int, part: str) -> tuple[DataFrame, DataFrame, int]:
    """The records over ``nodes``, the top node of every tree with its height, and the
    greatest height."""
    names = [*by, "rank", "n", "digest"]
    tops = nodes.filter("n = 1").select(*names, F.lit(0).alias("height"))
    records = nodes.limit(0).select(F.lit(part).alias("part"), F.lit(0).alias("height"), "digest", F.array("digest").alias("children"))
    height, open_nodes = 0, nodes.filter("n > 1").select(*names)
    while not open_nodes.isEmpty():
        height += 1
        level = materialize(_parents(open_nodes, by, width).withColumn("height", F.lit(height)))
        records = records.unionByName(level.select(F.lit(part).alias("part"), "height", "digest", "children"))
        tops = tops.unionByName(level.filter("n = 1").select(*names, "height"))
        open_nodes = level.filter("n > 1").select(*names)
    return records, tops, height


def build_manifest(
    docs: DataFrame, fields: Sequence[str | Column] = FIELDS, key: str = "doc_id", source: str = "source", altered: Column | None = None, width: int = WIDTH,
) -> Manifest:
    """The manifest of a table. ``altered`` may give the digest of a changed row, null for
    rows that did not change; it takes no part in the tree."""
    rows = docs.select(
        col(key).alias("key"),
        # the empty text for no source, which sorts first, else a letter before its name
        F.when(col(source).isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), col(source).cast("string"))).alias("tree"),
        leaf_digest([col(f) for f in fields]).alias("leaf"),
        (F.lit(None).cast("string") if altered is None else altered).alias("altered"),
        F.monotonically_increasing_id().alias("_row"),
    )
    leaves = materialize(
        running_totals(rows, ["tree"], [F.col("key").isNull(), "key", "leaf", "_row"]).drop("_row").withColumnsRenamed({"before": "rank", "total": "n"})
    )
    inside, tops, height = _grown(leaves.withColumnRenamed("leaf", "digest"), ["tree"], width, "source")
    tops = tops.select("tree", "digest", "height")
    subroots = materialize(running_totals(tops, [], ["tree"]).withColumnsRenamed({"before": "rank", "total": "n"}))
    above, root, top = _grown(subroots.select("rank", "n", "digest"), [], width, "root")
    records = materialize(inside.unionByName(above).dropDuplicates(["part", "height", "digest"]))
    return Manifest(leaves, records, subroots, root.select(F.col("digest").alias("root")), {"source": height, "root": top})


def _step(at: DataFrame, records: DataFrame, keep: Sequence[str], width: int) -> DataFrame:
    """From nodes (keep, rank, digest, path) to their children, one segment longer."""
    met = at.join(records.select("digest", "children"), "digest")
    return met.select(*keep, "rank", "path", "children", F.posexplode("children").alias("_digit", "digest")).select(
        *keep, (F.col("rank") * width + F.col("_digit")).alias("rank"), "digest",
        _path(F.col("children"), F.col("_digit"), F.col("path")).alias("path"),
    )


def _path(children: Column, digit: Column, path: Column) -> Column:
    """The path with the siblings of the child in front."""
    before, after = F.slice(children, F.lit(1), digit), F.slice(children, digit + 2, F.size(children))
    return F.concat(F.array(F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))), path)


def proofs(manifest: Manifest, requests: DataFrame, width: int = WIDTH) -> DataFrame:
    """``requests`` (tree, rank, more columns) with ``subroot``, ``root`` and ``path``: the
    siblings before and after the node on every level, from the leaf to the root."""
    records = {p: {h: manifest.records.filter((F.col("part") == p) & (F.col("height") == h)) for h in range(1, top + 1)} for p, top in manifest.heights.items()}
    asked = requests.select("tree", (F.col("rank").cast("long")).alias("rank"))

    # Over the subroots; only sources that are asked for are followed further.
    at = manifest.root.select(F.lit(0).cast("long").alias("rank"), F.col("root").alias("digest"), "root", F.array().cast(PATH).alias("path"))
    for height in range(manifest.heights["root"], 0, -1):
        at = _step(at, records["root"][height], ["root"], width)
    starts = (
        at.select("rank", "root", "path")
        .join(manifest.subroots.select("rank", "tree", "digest", "height"), "rank")
        .join(asked.select("tree").distinct(), "tree", "left_semi")
        .select("tree", F.lit(0).cast("long").alias("rank"), "digest", "height", F.col("digest").alias("subroot"), "root", "path")
    )
    starts = materialize(starts)
    keep, names = ["tree", "subroot", "root"], ["tree", "subroot", "root", "rank", "digest", "path"]
    at = starts.limit(0).select(*names)
    for height in range(manifest.heights["source"], 1, -1):
        at = _step(at.unionByName(starts.filter(F.col("height") == height).select(*names)), records["source"][height], keep, width)
        below = asked.select("tree", F.expr(f"rank div {width ** (height - 1)}").alias("rank")).distinct()
        at = at.join(below, ["tree", "rank"], "left_semi")
    at = at.unionByName(starts.filter("height = 1").select(*names))
    if manifest.heights["source"]:
        last = at.join(records["source"][1].select("digest", "children"), "digest")
    else:
        last = at.withColumn("children", F.array().cast("array<string>"))
    last = last.select(*keep, F.col("rank").alias("_run"), "children", "path").unionByName(
        starts.filter("height = 0").select(*keep, F.col("rank").alias("_run"), F.lit(None).cast("array<string>").alias("children"), "path")
    )
    digit = F.pmod(F.col("rank"), F.lit(width)).cast("int")
    return requests.withColumn("_run", F.expr(f"rank div {width}")).join(last, ["tree", "_run"]).select(
        *requests.columns, "subroot", "root",
        F.when(F.col("children").isNull(), F.col("path")).otherwise(_path(F.col("children"), digit, F.col("path"))).alias("path"),
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, s: digest(F.concat(s["before"], node, s["after"])))


def siblings(path: Column) -> Column:
    """All digests of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def verify(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", fields: Sequence[str] = FIELDS, width: int = WIDTH) -> DataFrame:
    """One row per input row: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    Every row is proved against the manifest of the table; rows whose key's crc32 is
    divisible by five are altered before (capitals of the text lowered), so their proof
    fails where the text has capitals.

    Defined cases: nulls are marked in the leaf, apart from empty texts; a null source is a
    source of its own, the first; a null key comes last in its source and is not altered;
    repeated rows are leaves of their own, next to each other; rows with one key are ordered
    by leaf; a table of one row has an empty proof; an empty table gives no rows; other
    columns are ignored.
    """
    tampered = F.pmod(F.crc32(col(key).cast("string").cast("binary")), F.lit(5)) == 0
    lowered = [F.translate(col(f), UPPER, LOWER) if f == text else col(f) for f in fields]
    manifest = build_manifest(docs, fields, key, source, F.when(tampered, leaf_digest(lowered)), width)
    proved = proofs(manifest, manifest.leaves.select("tree", "rank", "key", "leaf", "altered"), width)
    return proved.select(
        F.col("key").alias(key), "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"),
        folded(F.coalesce("altered", "leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels_sql(name: str, first: str, by: str, levels: int) -> str:
    return ",\n".join(
        f"{name}{k} AS (SELECT {by} r // 16 AS r, list(h ORDER BY r) AS kids, sha256(array_to_string(list(h ORDER BY r), '')) AS h, (n + 15) // 16 AS n\n"
        f"       FROM {first if k == 1 else f'{name}{k - 1}'} WHERE n > 1 GROUP BY {by} r // 16, (n + 15) // 16)"
        for k in range(1, levels + 1)
    )


def _folds_sql(name: str, first: str, nodes: str, rank: str, on: str, levels: int) -> str:
    out = []
    for k in range(1, levels + 1):
        before = f"array_to_string(kids[1:(p.{rank} // {16 ** (k - 1)}) % 16], '')"
        after = f"array_to_string(kids[(p.{rank} // {16 ** (k - 1)}) % 16 + 2:], '')"
        out.append(
            f"{name}{k} AS (SELECT p.* EXCLUDE (proof, fold), CASE WHEN kids IS NULL THEN proof ELSE proof || {before} || {after} END AS proof,\n"
            f"       CASE WHEN kids IS NULL THEN fold ELSE sha256({before} || fold || {after}) END AS fold\n"
            f"       FROM {first if k == 1 else f'{name}{k - 1}'} p LEFT JOIN {nodes}{k} q ON {on} q.r = p.{rank} // {16 ** k})"
        )
    return ",\n".join(out)


def _leaf_sql(text: str) -> str:
    return "sha256(concat(" + ", ".join(
        f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in ("doc_id", "source", "lang", "n_chars", text)
    ) + "))"


_DEEP, _TOP = 5, 3  # a million rows a source, four thousand sources

SQL = f"""
WITH fix AS (SELECT n, list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n) AS c FROM range(256) t(n)),
crc AS (SELECT list(c ORDER BY n) AS fixes FROM fix),
d AS (SELECT *, coalesce('s' || source, '') AS s, {_leaf_sql("text")} AS leaf, xor(list_reduce(
        list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT),
        lambda a, x: xor(a >> 8, fixes[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) % 5 = 0 AS tampered FROM documents, crc),
l AS (SELECT doc_id, s, leaf, leaf AS h, CASE WHEN tampered THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE leaf END AS fold, '' AS proof,
             row_number() OVER (PARTITION BY s ORDER BY doc_id, leaf) - 1 AS r, count(*) OVER (PARTITION BY s) AS n FROM d),
{_levels_sql("a", "l", "s,", _DEEP)},
subs AS (SELECT s, h FROM l WHERE n = 1 {" ".join(f"UNION ALL SELECT s, h FROM a{k} WHERE n = 1" for k in range(1, _DEEP + 1))}),
t AS (SELECT s, h, row_number() OVER (ORDER BY s) - 1 AS r, count(*) OVER () AS n FROM subs),
{_levels_sql("b", "t", "", _TOP)},
root AS (SELECT h AS root FROM t WHERE n = 1 {" ".join(f"UNION ALL SELECT h FROM b{k} WHERE n = 1" for k in range(1, _TOP + 1))}),
{_folds_sql("p", "l", "a", "r", "q.s = p.s AND", _DEEP)},
w AS (SELECT p.doc_id, p.leaf, p.proof, p.fold, t.h AS subroot, t.r AS sr FROM p{_DEEP} p JOIN t USING (s)),
{_folds_sql("v", "w", "b", "sr", "", _TOP)}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM v{_TOP}, root
"""
