"""Context vectors of items: a constant, numbers, and one column per label found in the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labels of all columns together; their dictionary is gathered and broadcast.
MOST_LABELS = 4096


def label_dictionary(items: DataFrame, columns: Sequence[str], most: int = MOST_LABELS) -> list[tuple[str, str, int]]:
    """(column, label, rows) of every label, by column as given and then by label.

    Labels are counted in the tasks before they meet. Nulls are no label. More than ``most``
    labels are an error, never a cut: a column of ids is not a label.
    """
    pairs = F.array(*[F.struct(F.lit(n).alias("n"), F.col(c).cast("string").alias("label")) for n, c in enumerate(columns)])
    counted = items.select(F.explode(pairs).alias("p")).select("p.*").filter("label IS NOT NULL").groupBy("n", "label").agg(F.count("*").alias("rows"))
    found = counted.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} labels in {', '.join(columns)}")
    return [(columns[r.n], r.label, r.rows) for r in sorted(found, key=lambda r: (r.n, r.label.encode()))]


def context_size(numbers: Sequence[str], dictionary: Sequence[tuple[str, str, int]]) -> int:
    return 1 + len(numbers) + len(dictionary)


def sparse_contexts(
    items: DataFrame, numbers: Sequence[str], dictionary: Sequence[tuple[str, str, int]], key: str = "item_id"
) -> DataFrame:
    """(key, indices, values): the places of a vector that may differ from zero, ascending.

    Place 0 is the constant, then come ``numbers``, then the labels of the dictionary. A label
    that the dictionary lacks, and a null, have no place.
    """
    indices: list[Column] = [F.lit(i) for i in range(1 + len(numbers))]
    values: list[Column] = [F.lit(1.0), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numbers]]
    rows = items.select(key, *numbers, *{c for c, _, _ in dictionary})
    for c in dict.fromkeys(c for c, _, _ in dictionary):
        own = [(label, 1 + len(numbers) + n) for n, (d, label, _) in enumerate(dictionary) if d == c]
        # At most MOST_LABELS rows.
        places = items.sparkSession.createDataFrame(own, f"`{c}` string, `_at_{c}` int")
        rows = rows.withColumn(c, F.col(c).cast("string")).join(F.broadcast(places), c, "left")
        indices.append(F.col(f"_at_{c}"))
        values.append(F.when(F.col(f"_at_{c}").isNotNull(), F.lit(1.0)))
    return rows.select(key, F.array_compact(F.array(*indices)).alias("indices"), F.array_compact(F.array(*values)).alias("values"))


def dense(vectors: DataFrame, size: int, key: str = "item_id") -> DataFrame:
    """(key, x) with x of ``size`` doubles, from sparse vectors."""
    value = F.map_from_arrays("indices", "values")
    x = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    return vectors.select(key, value.alias("_m")).select(key, x.alias("x"))
