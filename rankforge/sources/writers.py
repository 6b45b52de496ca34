"""Writers for tables, reports, per-run samples and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


#: Error conditions of a path that is absent or holds no table yet.
NOTHING_THERE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header. ``single`` is for small report tables."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").json(path)


def materialize_runs(spark: SparkSession, samples: DataFrame, path: str, overwrite: bool = False, run: str = "run") -> DataFrame:
    """Per-run partitions under ``path``: runs that are missing are written, others
    only with ``overwrite``."""
    if overwrite:
        samples.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)
        return spark.read.parquet(path)
    existing = None
    try:
        existing = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in NOTHING_THERE:
            raise
    if existing is not None:
        samples = samples.join(existing.select(run).distinct(), run, "left_anti")
    samples.write.mode("append").partitionBy(run).parquet(path)
    return spark.read.parquet(path)


#: Words of 32 bits in a row's digest, and the size of a word.
WORDS, WORD = 4, 1 << 32


def row_digest(table: DataFrame, columns: Sequence[str]) -> Column:
    """A digest of 128 bits of the named columns, in order. Fractions count in millionths, so
    engines agree; null is apart from every text."""
    fractions = {c for c, kind in table.dtypes if kind in ("double", "float")}
    shown = [F.round(F.col(c) * 1e6).cast("long") if c in fractions else F.col(c) for c in columns]
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in shown]).cast("binary"))


def manifest_parts(table: DataFrame, by: Sequence[str] = ("run",), item: str = "item_id", columns: Sequence[str] | None = None) -> DataFrame:
    """Per run: seed (if the table has one), rows, unique items, and the digests of the rows
    added up word by word. Sums don't depend on the order of rows, count a row that occurs
    twice twice, and can be added to those of other rows (``merge_manifests``)."""
    columns = sorted(table.columns) if columns is None else list(columns)
    digest = row_digest(table, columns)
    words = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)") for i in range(WORDS)]
    seed = F.max("seed").cast("long") if "seed" in table.columns else F.lit(None).cast("long")
    return table.groupBy(*by).agg(
        seed.alias("seed"), F.count("*").alias("n_rows"), F.countDistinct(item).alias("n_items"),
        *[(F.sum(w) % WORD).cast("long").alias(f"w{i}") for i, w in enumerate(words)],
    )


def merge_manifests(old: DataFrame, new: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """The parts of two tables put together, without reading the tables. A run that is in
    both has its rows and digests added; how many different items it has then isn't known,
    and is null."""
    both = old.unionByName(new)
    return both.groupBy(*by).agg(
        F.max("seed").alias("seed"), F.sum("n_rows").alias("n_rows"),
        F.when(F.count("*") == 1, F.max("n_items")).alias("n_items"),
        *[(F.sum(f"w{i}") % WORD).alias(f"w{i}") for i in range(WORDS)],
    )


def with_fingerprint(parts: DataFrame) -> DataFrame:
    """Parts with their words written as one fingerprint of 32 digits."""
    words = [F.lower(F.lpad(F.hex(f"w{i}"), 8, "0")) for i in range(WORDS)]
    return parts.withColumn("fingerprint", F.concat(*words)).drop(*[f"w{i}" for i in range(WORDS)])


def manifest(table: DataFrame, by: Sequence[str] = ("run",), item: str = "item_id", columns: Sequence[str] | None = None) -> DataFrame:
    """Seed, rows, unique items and an order-free content fingerprint per run."""
    return with_fingerprint(manifest_parts(table, by, item, columns))


def publish(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Only the columns that may leave the house; one that is missing is an error."""
    if missing := [c for c in allowed if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*allowed)


def policy_tables(lists: DataFrame, policy: DataFrame, path: str) -> None:
    """Recommendation lists (run, profile, method, rank, item) and policy rows
    (run, profile, item, q, visits, score), partitioned by run."""
    lists.write.mode("overwrite").partitionBy("run").parquet(f"{path}/lists")
    policy.write.mode("overwrite").partitionBy("run").parquet(f"{path}/policy")
