import duckdb
import pytest
from pyspark.sql import functions as F

from rankforge.operators import contexts as cx
from rankforge.workload import load, shapes

SQL = load()[1]


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, 0.5, "b", "x"), (2, None, "a", None), (3, 0.25, None, "y"), (4, 1.0, "a", "x")]
    return spark.createDataFrame(rows, "item_id long, price double, kind string, tier string")


def test_labels_come_from_the_data(items):
    labels = cx.label_dictionary(items, ["kind", "tier"])
    assert labels == [("kind", "a", 2), ("kind", "b", 1), ("tier", "x", 2), ("tier", "y", 1)]
    size = cx.context_size(["price"], labels)
    sparse = {r.item_id: (r.indices, r["values"]) for r in cx.sparse_contexts(items, ["price"], labels).collect()}
    assert sparse[1] == ([0, 1, 3, 4], [1.0, 0.5, 1.0, 1.0]) and sparse[2] == ([0, 1, 2], [1.0, 0.0, 1.0]) and sparse[3] == ([0, 1, 5], [1.0, 0.25, 1.0])
    got = {r.item_id: r.x for r in cx.dense(cx.sparse_contexts(items, ["price"], labels), size).collect()}
    assert got == {1: [1, 0.5, 0, 1, 1, 0], 2: [1, 0, 1, 0, 0, 0], 3: [1, 0.25, 0, 0, 0, 1], 4: [1, 1, 1, 0, 1, 0]}


def test_a_new_label_gets_a_column_and_an_unknown_one_none(spark, items):
    more = items.unionByName(spark.createDataFrame([(5, 0.0, "c", "x")], items.schema))
    labels = cx.label_dictionary(more, ["kind", "tier"])
    assert [x for _, x, _ in labels] == ["a", "b", "c", "x", "y"]
    old = cx.label_dictionary(items, ["kind", "tier"])
    got = {r.item_id: r.x for r in cx.dense(cx.sparse_contexts(more, ["price"], old), 6).collect()}
    assert got[5] == [1, 0, 0, 0, 1, 0]


def test_too_many_labels_are_an_error(items):
    with pytest.raises(ValueError, match="more than 3 labels"):
        cx.label_dictionary(items, ["kind", "tier"], 3)


def test_halves_are_rounded_alike_by_both_engines(spark):
    values = [0.9664875, 1 - 0.0335125, 0.2519875, 0.0000125, 1.0, 0.0]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "x double").select(shapes.half_up(F.col("x")).alias("x")).collect()]
    want = [duckdb.connect().execute(f"SELECT {shapes.half_up_sql(f'{v!r}::DOUBLE')}").fetchone()[0] for v in values]
    assert got == want == [0.966488, 0.966488, 0.251988, 0.000013, 1.0, 0.0]


def test_sql_of_unit_vectors_has_no_negative_zero():
    con = duckdb.connect()
    con.execute("create table embeddings as select 1 as vec_id, [1.0::FLOAT, -0.0000001::FLOAT] as embedding")
    assert str(con.execute(SQL["l2_normalize"]).fetchone()[1]) == "[1.0, 0.0]"
