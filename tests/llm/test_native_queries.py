"""Queries against their SQL over the smallest tables and over rows with hard cases."""

from pathlib import Path

import duckdb
import pytest

from rankforge.llm import queries

FOLDER = Path("/root/testdata/sf0.001")
LONG = "lorem ipsum dolor " * 3000


def plain(v):
    return "nan" if isinstance(v, float) and v != v else repr(v)


def same(spark, folder, name):
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}{'/*.parquet' if f.is_dir() else ''}'")
    cur = con.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    df = queries.QUERIES[name](spark, str(folder))
    assert sorted(df.columns) == sorted(names)
    got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    assert got == sorted(tuple(map(plain, r)) for r in cur.fetchall())
    return got


@pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert same(spark, FOLDER, name)


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    """Nulls, empty and long texts, ties, repeated texts, columns with clashing names."""
    folder = tmp_path_factory.mktemp("hard")
    texts = [None, "", " \n\t", "one", "one two", "a b a b a b a b", "x " * 200, "line\nline\nline\n\n", "É é ü #$%\n\x0b\x0c\r z", LONG, LONG + " ",
             "on e", "o n e", "\n".join(["same line here"] * 40), "&&& *** <b>|</b>", "one two three one two three", LONG.replace(" ", ""), LONG + "a", LONG + "b", "a" + LONG]
    docs = [(i, t, "en", [None, "", "a", "b", "hot", "hot", "hot"][i % 7], 0, "k", "s", 1, "n") for i, t in enumerate(texts * 3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, key string, host string, size int, name string").repartition(4, "doc_id").write.parquet(f"{folder}/documents.parquet")
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, None, "user", "<|im_start|> <\\|im_end|> <<SYS>> [\\\\/INST] </s>"), (2, 0, None, "%0A%25"),
             (2, 0, "a%0A\nb", "x\n"), (3, 5, "assistant", ""), (3, 5, "assistant", ""), (3, 4, "assistant", LONG), (None, 0, "user", "<"), (4, 0, "<|x", "<<|im_end|>\n|>")]
    spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, body string").write.parquet(f"{folder}/conversations.parquet")
    urls = [None, "", "not a url", "HTTP://User:pw@M.Ex.COM:80/en//a?x#y", "http://blog.ex.com/en", "http://ex.com", "http://ex.com/english", "ftp://a.b.c.d.e/en/" + "p/" * 500, "http://ex.com"]
    pages = [(i, u, "h", "z", "z") for i, u in enumerate(urls * 30)]
    spark.createDataFrame(pages, "page_id long, url string, html string, host string, entry string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_hard_rows_equal_sql(spark, hard, name):
    assert same(spark, hard, name)


@pytest.fixture(scope="module")
def empty(spark, hard, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for t in ("documents", "conversations", "pages"):
        spark.read.parquet(f"{hard}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_empty_tables(spark, empty, name):
    assert len(queries.QUERIES[name](spark, str(empty)).collect()) == (1 if name.startswith("op1_") else 0)
