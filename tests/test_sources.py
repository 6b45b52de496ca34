import gzip
import json

import pytest

from rankforge.operators.catalog import CATALOG_COLUMNS
from rankforge.sources import readers, writers


def test_gzip_literals(spark, tmp_path):
    lines = [
        "{'asin': 'A', 'price': 3.5, 'brand': None, 'salesRank': {'X': 9, 'Y': 4}, 'categories': [['Root', 'Mid', 'Leaf']]}",
        "{'asin': 'A', 'price': 3.5, 'brand': None, 'salesRank': {'X': 9, 'Y': 4}, 'categories': [['Root', 'Mid', 'Leaf']]}",
        "{'asin': 'B', 'price': 1.0, 'salesRank': {}, 'categories': []}",
        "{'asin': 'C', 'salesRank': {'X': 1}}",
        "{'asin': 'D', 'price': 2, 'brand': \"O'Neil\", 'salesRank': {'X': 1}, 'categories': [['Only']]}",
        "not a record",
    ]
    with gzip.open(tmp_path / "meta.json.gz", "wt") as f:
        f.write("\n".join(lines))
    got = sorted(map(tuple, readers.load_metadata(spark, str(tmp_path / "meta.json.gz")).collect()))
    assert got == [("A", 3.5, 4.0, "Unknown", "Mid", "Leaf"), ("D", 2.0, 1.0, "O'Neil", "Only", "Only")]


def test_read_catalog_names_missing_columns(spark, tmp_path):
    spark.range(3).withColumnRenamed("id", "price").write.option("header", True).csv(str(tmp_path / "c"))
    with pytest.raises(ValueError, match="product_id"):
        readers.read_catalog(spark, str(tmp_path / "c"))
    assert readers.read_catalog(spark, str(tmp_path / "c"), ["price"]).dtypes == [("price", "double")]
    assert len(CATALOG_COLUMNS) == 21


def test_nested_report_and_users(spark, tmp_path):
    report = {"artifacts": [{"run_index": 0, "profile_results": [{"profile_name": "p", "f1": {"hybrid": {"500": 0.5, "1000": 0.75}}}]}]}
    (tmp_path / "r.json").write_text(json.dumps(report, indent=2))
    got = sorted(map(tuple, readers.flatten_report(spark, str(tmp_path / "r.json")).collect()))
    assert got == [(0, "p", "hybrid", 500, 0.5), (0, "p", "hybrid", 1000, 0.75)]
    users = [{"user_id": f"user_000{u}", "n_unique_items": 2, "train": [{"asin": "a", "rating": 5.0, "time": 1}],
              "test": [{"asin": "b", "rating": 4.0, "time": 2}], "profile": {"cat_lvl2_affinity": {"x": 1.0}}} for u in (1, 0)]
    (tmp_path / "u.json").write_text(json.dumps(users, indent=2))
    first = readers.load_users(spark, str(tmp_path / "u.json"), max_users=1)
    assert [tuple(r) for r in readers.user_rows(first).orderBy("split").collect()] == [
        ("user_0000", "test", 1, "b", 4.0, 2), ("user_0000", "train", 1, "a", 5.0, 1)]


def test_runs_are_written_once(spark, tmp_path):
    where = str(tmp_path / "runs")
    base = spark.range(10).selectExpr("id AS item_id", "0 AS run")
    assert writers.materialize_runs(spark, base, where).count() == 10
    more = base.unionByName(spark.range(5).selectExpr("id AS item_id", "1 AS run"))
    out = writers.materialize_runs(spark, more, where)
    assert {r.run: r["count"] for r in out.groupBy("run").count().collect()} == {0: 10, 1: 5}
    fewer = spark.range(3).selectExpr("id AS item_id", "1 AS run")
    out = writers.materialize_runs(spark, fewer, where, overwrite=True)
    assert {r.run: r["count"] for r in out.groupBy("run").count().collect()} == {0: 10, 1: 3}


def test_manifest_ignores_row_order(spark):
    a = spark.range(20).selectExpr("id AS item_id", "id % 2 AS run")
    b = a.orderBy(a.item_id.desc()).repartition(3)
    key = lambda df: sorted(map(tuple, writers.manifest(df).collect()))
    assert key(a) == key(b)
    assert key(a) != key(a.filter("item_id <> 4"))


def test_manifests_add_up(spark):
    rows = [(r, 17 + r, i % 7, i / 3, None if i % 5 == 0 else f"t{i}") for r in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "run int, seed int, item_id int, x double, t string")
    key = lambda d: sorted(map(str, writers.with_fingerprint(d).collect()))
    whole = writers.manifest_parts(df)
    assert key(writers.merge_manifests(writers.manifest_parts(df.filter("run = 1")), writers.manifest_parts(df.filter("run <> 1")))) == key(whole)
    split = writers.merge_manifests(writers.manifest_parts(df.filter("item_id < 3")), writers.manifest_parts(df.filter("item_id >= 3")))
    got, want = ({r.run: r for r in writers.with_fingerprint(d).collect()} for d in (split, whole))
    assert all(got[r].fingerprint == want[r].fingerprint and got[r].n_rows == want[r].n_rows and got[r].n_items is None for r in want)
    twice = {r.run: r.fingerprint for r in writers.manifest(df.unionByName(df)).collect()}
    nulls = {r.run: r.fingerprint for r in writers.manifest(df.fillna("~x")).collect()}
    assert all(len({want[r].fingerprint, twice[r], nulls[r]}) == 3 for r in want) and want[0].seed == 17


def test_flat_records_are_not_parsed_one_by_one(spark, tmp_path, monkeypatch):
    """Flat lines go around the Python parser and give what it gives; others still meet it."""
    flat = ["{'a': 'x, y {é}', 'b': 4.0, 'c': -12, 'd': None}", "{'a': 'None', 'b': 0.25, 'c': 0, 'd': True}", "{'a': '', 'a': 'z', 'd': False}"]
    other = ["{'a': 'x: None, y', 'b': 1.50}", "{'a': 'p' 'q', 'c': 1_0}", "{'a': \"it's\"}", "{'a': u'v'}", "{'a': 1.50}", "{'c': 01}", "{'b': [1.0]}", "x"]
    (tmp_path / "r.txt").write_text("\n".join(flat + other), encoding="utf-8")
    schema = "a string, b double, c long, d boolean"
    rows = lambda: sorted(map(repr, readers.read_records(spark, str(tmp_path / "r.txt"), schema).collect()))
    got = rows()
    monkeypatch.setattr(readers, "FLAT", "a^")
    assert got == rows() and len(got) == 9
    assert not readers.pc.match_substring_regex(readers.pa.array(other), readers.FLAT).to_pylist().count(True)
    monkeypatch.undo()
    assert all(readers.pc.match_substring_regex(readers.pa.array(flat), readers.FLAT).to_pylist())
    assert not any(readers.pc.match_substring_regex(readers.pa.array(other), readers.FLAT).to_pylist())


def test_users_files_are_read_once(spark, tmp_path):
    line = {"user_id": "a", "train": [{"asin": "x", "rating": 5.0, "time": 1}, {"asin": "y", "rating": 4.0, "time": 2}], "test": None}
    (tmp_path / "u.json").write_text("\n".join(json.dumps(r) for r in (line, {"user_id": "b", "train": [], "test": line["train"]})))
    rows = readers.user_rows(readers.load_users(spark, str(tmp_path / "u.json"), lines=True))
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted(map(tuple, rows.collect())) == [
        ("a", "train", 1, "x", 5.0, 1), ("a", "train", 2, "y", 4.0, 2), ("b", "test", 1, "x", 5.0, 1), ("b", "test", 2, "y", 4.0, 2)]


def test_reviews_are_of_known_items_and_liked(spark, tmp_path):
    rows = [("u", "a", 4.0), ("u", "b", 5.0), ("v", "a", 3.9), ("v", "x", 5.0), ("w", "b", None)]
    lines = [f"{{'reviewerID': '{u}', 'asin': '{i}', 'overall': {r}, 'unixReviewTime': 7}}" for u, i, r in rows]
    with gzip.open(tmp_path / "reviews.json.gz", "wt") as f:
        f.write("\n".join(lines))
    known = spark.createDataFrame([("a",), ("b",), ("b",)], "item_id string")
    read = lambda *least: sorted(map(tuple, readers.load_reviews(spark, str(tmp_path / "reviews.json.gz"), known, *least).collect()))
    assert read() == [("u", "a", 4.0, 7), ("u", "b", 5.0, 7)]
    assert read(3.5) == [("u", "a", 4.0, 7), ("u", "b", 5.0, 7), ("v", "a", 3.9, 7)]


def test_load_reviews_query_filters(spark):
    """The query asks for what the positive reviews are, not for the whole log."""
    from rankforge.workload import load

    assert " FROM reviews" in load()[1]["load_reviews"]
    queries = load()[0]
    sf = "/root/testdata/sf0.001"
    got = sorted((r.user_id, r.item_id, r.rating, r.ts) for r in queries["load_reviews"](spark, sf).collect())
    want = sorted((f"U{r.user_id}", f"A{r.item_id}", r.rating, r.ts) for r in queries["positive_reviews"](spark, sf).collect())
    assert got == want and got
