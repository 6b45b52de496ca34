"""Text columns and SQL fragments that the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores behind it as no column of ``taken`` has (columns are
    told apart without regard to case)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def text_of(c: str | Column = "text") -> Column:
    """The text, or the empty text for null."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def words_of(c: str | Column = "text") -> Column:
    """The words of a text as an array, repeats included."""
    return F.array_remove(F.split(text_of(c), SPACE), "")


def word_count(c: str | Column = "text") -> Column:
    return F.regexp_count(text_of(c), F.lit(WORD)).cast("long")


def without_spaces(c: str | Column = "text") -> Column:
    out = text_of(c)
    for s in SPACES:
        out = F.replace(out, F.lit(s), F.lit(""))
    return out


def fold(key: str | Column, folds: int = 5) -> Column:
    """crc32 of the key as text, modulo ``folds``; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(col(key).cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def words_sql(text: str = "text") -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '{WORD}')"
