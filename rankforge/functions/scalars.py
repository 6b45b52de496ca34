"""Small numeric and array expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Limit to [lo, hi]; null stays null."""
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def clean_finite(c: Column, default: float = 0.0) -> Column:
    """NaN, infinities and null become ``default``."""
    bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.coalesce(F.when(bad, None).otherwise(c), F.lit(default))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = l2_norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def argmax_label(labels: Sequence[Column | str], values: Sequence[Column]) -> Column:
    """Label of the largest value; the first one wins ties."""
    names = F.array(*[F.lit(x) if isinstance(x, str) else x for x in labels])
    array = F.array(*values)
    return F.element_at(names, F.array_position(array, F.array_max(array)).cast("int"))


def attribution_text(names: Sequence[str], values: Sequence[Column], n: int = 5) -> Column:
    """The n entries of largest absolute value as ``name=+0.1234; ...``."""
    entries = F.array(
        *[
            F.struct((-F.abs(v)).alias("k"), F.lit(i).alias("i"), F.lit(name).alias("name"), v.alias("v"))
            for i, (name, v) in enumerate(zip(names, values))
        ]
    )
    best = F.slice(F.array_sort(entries), 1, n)
    return F.array_join(
        F.transform(best, lambda e: F.format_string("%s=%+.4f", e["name"], e["v"])), "; "
    )


def discount(rank: Column) -> Column:
    """1 / log2(rank + 1)."""
    return F.lit(1.0) / F.log2(rank.cast("double") + 1.0)
