"""Running totals, positions and exact quantiles over data of any size and skew.

An unpartitioned window, or a window over one hot group, ends in a single task.
Here the rows are range-partitioned on (group, order) instead, so a group that
holds a third of all rows is spread over a third of the slices. The slice number
is frozen in a written table, slice sums give each slice its offset, and the
window inside a slice finishes the job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.session import materialize

SLICE = "_rt_slice"
#: Rows of a group that one task sums in one piece.
LONG = 100_000


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    amount: str | Column | None = None,
    grand: str | None = None,
) -> DataFrame:
    """Add ``before`` (sum of ``amount`` over strictly earlier rows of the group)
    and ``total`` (sum over the group). ``order`` must be total inside a group.
    ``amount`` defaults to one per row. ``grand`` names a column for the sum over
    all groups."""
    by = list(by)
    order = [_col(c) for c in order]
    amount = F.lit(1).cast("long") if amount is None else _col(amount)
    sliced = materialize(
        df.withColumn("_rt_amount", amount)
        .repartitionByRange(*[F.col(c) for c in by], *order)
        .withColumn(SLICE, F.spark_partition_id())
    )
    in_group = Window.partitionBy(*by)
    earlier = in_group.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    # One row per (group, slice): the input of this window is at most
    # groups + slices rows, whatever the size of df.
    offsets = (
        sliced.groupBy(*by, SLICE)
        .agg(F.sum("_rt_amount").alias("_rt_part"))
        .select(
            *by,
            SLICE,
            F.coalesce(F.sum("_rt_part").over(earlier), F.lit(0)).alias("_rt_base"),
            F.sum("_rt_part").over(in_group).alias("total"),
        )
    )
    inside = (
        Window.partitionBy(*by, SLICE)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    out = (
        sliced.join(offsets, [*by, SLICE])
        .withColumn(
            "before", F.col("_rt_base") + F.coalesce(F.sum("_rt_amount").over(inside), F.lit(0))
        )
        .drop(SLICE, "_rt_amount", "_rt_base")
    )
    return attach(out, sliced.agg(F.sum("_rt_amount").alias(grand))) if grand else out


def grouped_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    amount: str | Column | None = None,
    most: int = LONG,
) -> DataFrame:
    """``running_totals`` for many groups that are mostly short, such as users.

    Rows are written once and shuffled once, by group; there is no sampling of a range and no
    join of offsets. Groups of more than ``most`` rows (at most rows / ``most`` of them)
    are cut into slices by ``running_totals``."""
    by = list(by)
    amount = F.lit(1).cast("long") if amount is None else _col(amount)
    rows = materialize(df.withColumn("_gt_amount", amount))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_gt_rows"))
    long = materialize(sizes.filter(F.col("_gt_rows") > most).select(*by))

    def in_one_piece(part: DataFrame) -> DataFrame:
        group = Window.partitionBy(*by)
        earlier = group.orderBy(*[_col(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("_gt_amount").over(earlier), F.lit(0)).alias("before")
        return part.select(*df.columns, before, F.sum("_gt_amount").over(group).alias("total"))

    if long.isEmpty():
        return in_one_piece(rows)
    few = F.broadcast(long)
    cut = running_totals(rows.join(few, by, "left_semi"), by, order, "_gt_amount")
    return in_one_piece(rows.join(few, by, "left_anti")).unionByName(cut.drop("_gt_amount"))


def ordered_position(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    pos: str = "pos",
    size: str = "n",
    totals: Callable[..., DataFrame] = running_totals,
) -> DataFrame:
    """1-based position of every row in its group, and the group size. ``totals`` is
    ``running_totals``, or ``grouped_totals`` where groups are many and mostly short."""
    return (
        totals(df, by, order)
        .withColumn(pos, F.col("before") + 1)
        .withColumnRenamed("total", size)
        .drop("before")
    )


def join_unique(
    left: DataFrame, right: DataFrame, on: Sequence[str], hot: Column, spread: Sequence[str]
) -> DataFrame:
    """Left join to a table with one row per key, safe for keys that hold a large
    share of ``left``.

    ``hot`` marks the right rows of frequent keys. The caller guarantees that
    their number is bounded (at most 1000 keys can hold 1/1000 of all rows each),
    so they are broadcast. Left rows
    already served are spread over all tasks by ``spread`` instead of meeting in
    the task of their key.
    """
    on = list(on)
    payload = [c for c in right.columns if c not in on]
    frequent = right.filter(hot).select(
        *on, F.struct(*payload).alias("_hot")
    )
    rest = right.filter(~hot).select(
        *on, F.lit(0).alias("_salt"), F.struct(*payload).alias("_cold")
    )
    salted = left.join(F.broadcast(frequent), on, "left").withColumn(
        "_salt",
        F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(
            1 + F.pmod(F.hash(*spread), F.lit(1 << 20))
        ),
    )
    joined = salted.join(rest, [*on, "_salt"], "left")
    return joined.select(
        *left.columns,
        *[
            F.coalesce(F.col("_hot")[c], F.col("_cold")[c]).alias(c)
            for c in payload
        ],
    )


def value_counts(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(group, column number, value, n): the pre-aggregated input of ranks and
    quantiles. Nulls are not counted."""
    return (
        df.select(
            *by,
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(i).alias("ord"), F.col(c).cast("double").alias("value"))
                        for i, c in enumerate(columns)
                    ]
                )
            ).alias("_v"),
        )
        .select(*by, "_v.ord", "_v.value")
        .filter(F.col("value").isNotNull())
        .groupBy(*by, "ord", "value")
        .agg(F.count("*").alias("n"))
    )


def percentile_ranks(
    df: DataFrame,
    specs: dict[str, tuple[str, bool]],
    key: Sequence[str],
    by: Sequence[str] = (),
) -> DataFrame:
    """Average-rank percentiles: ``specs`` maps output name to (column, inverted).

    rank = average position of the value's peers, divided by the number of
    non-null values; inverted gives one minus that; null stays null. All columns
    are ranked in one pass. ``key`` names columns that identify a row (together
    with ``by``).
    """
    by, key = list(by), [k for k in key if k not in by]
    columns = sorted({c for c, _ in specs.values()})
    counted = value_counts(df, by, columns)
    ranked = running_totals(counted, [*by, "ord"], ["value"], "n", grand="_all").select(
        *by,
        "ord",
        "value",
        "n",
        "_all",
        ((F.col("before") + (F.col("n") + 1) / 2) / F.col("total")).alias("pct"),
    )
    long = df.select(
        *by,
        *key,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("ord"), F.col(c).cast("double").alias("value"))
                    for i, c in enumerate(columns)
                ]
            )
        ).alias("_v"),
    ).select(*by, *key, "_v.ord", "_v.value")
    matched = join_unique(
        long, ranked, [*by, "ord", "value"], F.col("n") * 1000 >= F.col("_all"), key
    )
    pct = {
        c: F.max(F.when(F.col("ord") == i, F.col("pct"))) for i, c in enumerate(columns)
    }
    wide = matched.groupBy(*by, *key).agg(
        *[
            ((1 - pct[c]) if invert else pct[c]).alias(out)
            for out, (c, invert) in specs.items()
        ]
    )
    return df.drop(*[o for o in specs if o in df.columns]).join(wide, [*by, *key])


def quantiles(
    df: DataFrame,
    columns: str | Sequence[str],
    probs: dict[str, float],
    by: Sequence[str] = (),
    totals: Callable[..., DataFrame] = running_totals,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    Values are counted before they move; no task holds a whole group. For one
    column the outputs carry the names in ``probs``, for several
    ``<name>_<column>``. ``totals`` as in ``ordered_position``.
    """
    by = list(by)
    single = isinstance(columns, str)
    columns = [columns] if single else list(columns)
    covered = totals(value_counts(df, by, columns), [*by, "ord"], ["value"], "n")
    aggs = []
    for i, column in enumerate(columns):
        mine = F.col("ord") == i
        for name, p in probs.items():
            spot = (F.col("total") - 1) * F.lit(float(p))

            def value_at(index: Column, mine: Column = mine) -> Column:
                inside = (F.col("before") <= index) & (index < F.col("before") + F.col("n"))
                return F.max(F.when(mine & inside, F.col("value")))

            lo, hi = value_at(F.floor(spot)), value_at(F.ceil(spot))
            frac = F.max(F.when(mine, spot - F.floor(spot)))
            aggs.append((lo + (hi - lo) * frac).alias(name if single else f"{name}_{column}"))
    return covered.groupBy(*by).agg(*aggs)


def percentile_ranks_bounded(
    df: DataFrame, specs: dict[str, tuple[str, bool]], by: Sequence[str]
) -> DataFrame:
    """``percentile_ranks`` for groups whose size is a parameter (a sample of n
    items per run), where one window per group is enough."""
    out = df
    for name, (c, invert) in specs.items():
        group = Window.partitionBy(*by)
        value = F.col(c)
        mid = F.rank().over(group.orderBy(value.asc_nulls_last())) + (
            F.count(value).over(Window.partitionBy(*by, c)) - 1
        ) / 2
        pct = F.when(value.isNotNull(), mid / F.count(value).over(group))
        out = out.withColumn(f"_new_{name}", (1 - pct) if invert else pct)
    return out.drop(*specs).withColumnsRenamed({f"_new_{n}": n for n in specs})


def explode_range(df: DataFrame, name: str, lo: Column, hi: Column, block: int = 1 << 16) -> DataFrame:
    """One row per integer lo..hi, in two steps so that no array exceeds ``block``
    entries by much."""
    steps = df.withColumn("_lo", lo.cast("long")).withColumn("_hi", hi.cast("long")).filter("_lo <= _hi")
    starts = steps.withColumn(
        "_start", F.explode(F.sequence(F.col("_lo"), F.col("_hi"), F.lit(block).cast("long")))
    )
    return starts.withColumn(
        name, F.explode(F.sequence(F.col("_start"), F.least(F.col("_start") + block - 1, F.col("_hi"))))
    ).drop("_lo", "_hi", "_start")


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str] = (), grid: bool = True) -> DataFrame:
    """Give every row the statistics of its group.

    No ``by``: a single row, inlined as a scalar subquery. ``grid=True``: the
    groups come from a driver-side grid (runs, profiles, parameters), so there
    are few and they are broadcast. ``grid=False``: groups grow with the data
    (users), and Spark picks the join.
    """
    by = list(by)
    if by:
        return df.join(F.broadcast(stats) if grid else stats, by)
    one = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    return (
        df.withColumn("_s", one)
        .select(*df.columns, *[F.col("_s")[c].alias(c) for c in stats.columns])
    )


def min_max(
    df: DataFrame, columns: dict[str, str], by: Sequence[str] = (), grid: bool = True
) -> DataFrame:
    """Min-max scaling per group: ``columns`` maps output name to input column.
    A constant column becomes 0.5."""
    stats = df.groupBy(*by).agg(
        *[F.min(c).alias(f"_lo_{o}") for o, c in columns.items()],
        *[F.max(c).alias(f"_hi_{o}") for o, c in columns.items()],
    )
    out = attach(df, stats, by, grid)
    for o, c in columns.items():
        lo, hi = F.col(f"_lo_{o}"), F.col(f"_hi_{o}")
        scaled = (F.col(c) - lo) / (hi - lo + F.lit(1e-10))
        out = out.withColumn(o, F.when(hi <= lo, F.lit(0.5)).otherwise(scaled))
    return out.drop(*[f"_{e}_{o}" for o in columns for e in ("lo", "hi")])
