"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order. A document's virtual
finish time is the number of words its source has sent up to and including it,
divided by the target of the source. All queues are merged by one global sort on
the finish time, and the merged stream is cut at the total budget. At the cut all
queues stand at the same virtual time, so each source has sent its share.

Sizes and order keys leave the texts in one narrow table. Both prefix sums (inside
a source, and over the merged stream) run over range-partitioned slices, so one
source with a third of all rows is spread over a third of the slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.functions.hashing import hash_key
from rankforge.llm.shared import col, free_name, words_sql, word_count
from rankforge.operators.ordering import attach, ordered_position, running_totals
from rankforge.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
PASSES = 2
SEED = "mix"


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, passes: int = PASSES
) -> DataFrame:
    """(source, source_size, weight, target) from one (source, source_size) row per source.

    Sources in code point order, null last, take the weights in turn. A target is at
    most ``passes`` times the size of its source; what is cut off goes to the others by
    weight. With the sources ordered by limit over weight, those at their limit are the
    first ones, and each can be told from the sums before it.
    """
    ranked = ordered_position(sizes, [], [F.col("source").isNull(), "source"], pos="_rank", size="_n").withColumn(
        "weight", F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    )
    limited = ranked.withColumn("_limit", passes * F.col("source_size"))
    order = [F.col("_limit") / F.col("weight"), F.col("_rank")]
    limited = running_totals(limited, [], order, "_limit").withColumnsRenamed({"before": "_limits", "total": "_all"})
    limited = running_totals(limited, [], order, "weight").withColumnsRenamed({"before": "_weights", "total": "_weight"})
    budget = F.col("_all").cast("double") / passes * share
    full = F.col("_limit") * (F.col("_weight") - F.col("_weights")) <= F.col("weight") * (budget - F.col("_limits"))
    marked = limited.select("source", "source_size", "weight", "_limit", budget.alias("_budget"), full.alias("_full"))
    sums = marked.agg(
        F.coalesce(F.sum(F.when(F.col("_full"), F.col("_limit"))), F.lit(0)).alias("_taken"),
        F.coalesce(F.sum(F.when(~F.col("_full"), F.col("weight"))), F.lit(1)).alias("_rest"),
    )
    return attach(marked, sums).select(
        "source", "source_size", "weight",
        F.when(F.col("_full"), F.col("_limit").cast("double"))
        .otherwise(F.col("weight") * (F.col("_budget") - F.col("_taken")) / F.col("_rest")).alias("target"),
        F.col("_budget").alias("budget"),
    )


def weighted_fair_mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    size: Column | None = None,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    passes: int = PASSES,
    seed: str = SEED,
) -> DataFrame:
    """One row per input row: key, source, size, source_size, target, copies, taken.

    ``copies`` is how often the mix takes the document (at most ``passes``), ``taken``
    copies times size. The budget is ``share`` times all sizes.

    Defined cases: a null text has size 0 and takes nothing; a source without words
    has target 0; a null source is a source of its own, the last in order; rows with a
    repeated or null key are mixed as separate rows; an empty table gives no rows;
    other columns are ignored. Order is a hash of seed and key, then key and size, so
    reruns and other partitionings agree.
    """
    size = word_count("text") if size is None else size
    rows = materialize(
        docs.select(
            col(key).alias("key"), col(source).cast("string").alias("source"), size.cast("long").alias("size"),
            hash_key(seed, col(key)).alias("_order"), F.monotonically_increasing_id().alias("_row"),
        )
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, share, passes))
    # Two plain keys in place of a source that may be null: joins drop nulls, and a
    # null-safe join of a hot source can't be split.
    plain = {"_name": F.coalesce("source", F.lit("")), "_absent": F.col("source").isNull()}
    queued = (
        running_totals(rows.withColumns(plain), list(plain), ["_order", "key", "size", "_row"], "size").drop("total")
        .join(targets.withColumns(plain).drop("source"), list(plain)).drop(*plain)
    )
    sent = F.col("pass") * F.col("source_size") + F.col("before") + F.col("size")
    copies = queued.withColumn("pass", F.explode(F.array(*[F.lit(i) for i in range(passes)]))).select(
        "key", "source", "size", "source_size", "target", "budget", "_row", "_order", "pass",
        F.when(F.col("target") > 0, sent / F.col("target")).otherwise(0.0).alias("finish"),
    )
    merged = running_totals(
        copies, [], ["finish", F.col("source").isNull(), "source", "pass", "_order", "key", "size", "_row"], "size"
    )
    fits = F.col("before") + F.col("size") <= F.col("budget")
    return (
        merged.groupBy("_row")
        .agg(
            *[F.first(c).alias(c) for c in ("key", "source", "size", "source_size", "target")],
            F.sum(F.when(fits & (F.col("size") > 0), 1).otherwise(0)).alias("copies"),
        )
        .select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "copies",
                (F.col("copies") * F.col("size")).alias("taken"))
    )


def repeat_documents(docs: DataFrame, mix: DataFrame, key: str = "doc_id", source: str = "source", size: Column | None = None) -> DataFrame:
    """The documents as often as ``mix`` takes them, with their own columns only.

    Rows that agree in key, source and size are interchangeable for the mix; they are
    numbered on both sides, and the rows with more copies go to the smaller texts. Other
    columns of the documents may have any names.
    """
    size = word_count("text") if size is None else size
    named = {}
    for n in ("k", "s", "e", "size", "i", "copies", "copy"):
        named[n] = free_name(f"_{n}", [*docs.columns, *mix.columns])
    parts = {named["k"]: F.coalesce(col(key).cast("string"), F.lit("")), named["s"]: F.coalesce(col(source).cast("string"), F.lit("")),
             named["e"]: col(key).isNull().cast("int") * 2 + col(source).isNull().cast("int")}
    names = [*parts, named["size"]]
    left = docs.withColumns({**parts, named["size"]: size.cast("long")}).withColumn(
        named["i"], F.row_number().over(Window.partitionBy(*names).orderBy(F.xxhash64(*[F.col(c) for c in docs.columns])))
    )
    right = mix.withColumns({**parts, named["size"]: F.col("size"), named["copies"]: F.col("copies")}).withColumn(
        named["i"], F.row_number().over(Window.partitionBy(*names).orderBy(F.desc(named["copies"])))
    )
    taken = right.filter(F.col(named["copies"]) > 0).select(*names, named["i"], named["copies"])
    return (
        left.join(taken, [*names, named["i"]])
        .withColumn(named["copy"], F.explode(F.sequence(F.lit(1), F.col(named["copies"]).cast("int"))))
        .select(*docs.columns)
    )


SQL = f"""
WITH d AS (
    SELECT doc_id, source, len({words_sql()})::BIGINT AS size, md5(concat_ws('|', '{SEED}', doc_id::VARCHAR)) AS o
    FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight,
             row_number() OVER (ORDER BY source NULLS LAST) AS rk, 2 * source_size AS lim FROM s),
p AS (SELECT *, coalesce(sum(lim) OVER w, 0)::BIGINT AS lims, coalesce(sum(weight) OVER w, 0)::BIGINT AS ws,
             (sum(lim) OVER ())::BIGINT AS al, (sum(weight) OVER ())::BIGINT AS aw,
             (sum(lim) OVER ())::DOUBLE / 2 * 1.5::DOUBLE AS budget FROM r
      WINDOW w AS (ORDER BY lim / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, lim * (aw - ws) <= weight * (budget - lims) AS atlimit FROM p),
t AS (SELECT source, source_size, budget, CASE WHEN atlimit THEN lim::DOUBLE ELSE weight * (budget
             - coalesce(sum(CASE WHEN atlimit THEN lim END) OVER (), 0)::BIGINT)
             / coalesce(sum(CASE WHEN NOT atlimit THEN weight END) OVER (), 1)::BIGINT END AS target FROM f),
q AS (SELECT d.*, source_size, target, budget,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING
                                      AND 1 PRECEDING), 0)::BIGINT AS sent
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CASE WHEN target > 0 THEN (pass * source_size + sent + size) / target ELSE 0 END AS finish
      FROM q, (VALUES (0), (1)) AS v(pass)),
m AS (SELECT *, coalesce(sum(size) OVER (ORDER BY finish, source NULLS LAST, pass, o, doc_id, size
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS mixed FROM c)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       (sum(CASE WHEN mixed + size <= budget THEN size ELSE 0 END))::BIGINT AS taken
FROM m GROUP BY doc_id
"""
