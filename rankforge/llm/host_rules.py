"""Host-level quality rules.

Each document is measured and held against rules. The failures of every rule are
counted by host, and a host's failure rate is shrunk towards the rate of all hosts:
a beta prior is fitted by moments to the rates of the hosts, so a host with three
documents is not judged by three documents. A host over a rule's limit is rejected,
and the verdict is joined back to its documents.

Measures are array and string functions inside the scan; no text is shuffled. The
narrow table of measures is counted by host with partial sums and joined to one row
per host, which Spark may split or broadcast by measured size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.llm.shared import SPACES, col, text_of, words_of, words_sql
from rankforge.operators.ordering import attach
from rankforge.session import materialize

WINDOW = 3
SYMBOLS = "[#*$%&|<>]"
BASE_WORDS, BASE_REPEATED = 50, 50
#: The prior counts as so many documents at least, however far the hosts lie apart.
LEAST_PRIOR = 10.0


@dataclass(frozen=True)
class Rule:
    """``failed`` is SQL over the measures; a host whose shrunk rate is over ``limit`` is rejected."""
    name: str
    failed: str
    limit: float


RULES = (
    Rule("short", f"n_words < {BASE_WORDS}", 0.8),
    Rule("repeated", f"100 * n_repeat_words > {BASE_REPEATED} * n_words", 0.5),
    Rule("symbols", "10 * n_symbols > n_words", 0.5),
    Rule("lines", "100 * n_dup_lines > 30 * n_lines", 0.5),
    Rule("letters", "word_chars < 2 * n_words OR word_chars > 20 * n_words", 0.5),
)


def measures(docs: DataFrame, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """The columns of ``keep`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines
    and n_repeat_words of each text."""
    t = text_of(text)
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    cut = docs.select(
        *[c.alias(n) for n, c in keep.items()], words_of(text).alias("_words"), lines.alias("_lines"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    n = F.size("_words").cast("long")
    window = lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)])
    hashed = cut.select(
        *keep, "n_symbols", n.alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), window))
        .otherwise(F.array().cast("array<bigint>")).alias("_hashes"),
    )
    plain = [c for c in hashed.columns if c != "_hashes"]
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    ordered = hashed.select(
        *plain,
        F.when(F.size(F.array_distinct("_hashes")) == F.size("_hashes"), none)
        .otherwise(F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_order"),
    )
    order = F.col("_order")
    twice = lambda x, i: F.coalesce(x["h"] == F.get(order, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(order, i + 1)["h"], F.lit(False))
    placed = ordered.select(*plain, F.sort_array(F.transform(F.filter(order, twice), lambda x: x["i"])).alias("_at"))
    covered = F.aggregate(
        F.transform("_at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", i + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    return placed.select(*plain, covered.alias("n_repeat_words"))


def host_verdicts(measured: DataFrame, host: str = "host", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per host: n_docs, the shrunk rate of every rule, and host_kept."""
    counted = materialize(measured.groupBy(host).agg(
        F.count("*").alias("n_docs"), *[F.sum(F.expr(r.failed).cast("long")).alias(r.name) for r in rules]
    ))
    moments = []
    for r in rules:
        rate, mean = F.col(r.name) / F.col("n_docs"), F.sum(r.name) / F.sum("n_docs")
        spread = F.sum(F.col("n_docs") * rate * rate) / F.sum("n_docs") - mean * mean
        moments += [mean.alias(f"_m_{r.name}"), F.greatest(spread, F.lit(1e-9)).alias(f"_v_{r.name}")]
    prior = counted.agg(*moments)  # one row
    rates = {}
    for r in rules:
        m, v = F.col(f"_m_{r.name}"), F.col(f"_v_{r.name}")
        weight = F.greatest(m * (1 - m) / v - 1, F.lit(LEAST_PRIOR))
        rates[r.name] = (F.col(r.name) + m * weight) / (F.col("n_docs") + weight)
    over = F.lit(False)
    for r in rules:
        over = over | (rates[r.name] > r.limit)
    return attach(counted, prior).select(
        host, "n_docs", *[x.alias(f"{n}_rate") for n, x in rates.items()], (~over).alias("host_kept")
    )


def judge_documents(
    docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """One row per input row: key, the measures, base_failed and kept.

    A document is kept unless it fails the base or its host is rejected.

    Defined cases: a null text has no words and fails the base; a null host is a host of
    its own; rows that repeat are judged and counted one by one; a null key stays null;
    an empty table gives no rows; other columns are ignored. Windows are compared by
    64-bit hash inside one document.
    """
    rows = materialize(measures(docs, {"key": col(key), "host": col(host).cast("string")}, text))
    verdicts = host_verdicts(rows, "host", rules)
    name = {"_name": F.coalesce("host", F.lit("")), "_absent": F.col("host").isNull()}
    base = F.expr(f"n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEATED} * n_words")
    return rows.withColumns(name).join(verdicts.withColumns(name).drop("host"), list(name)).select(
        F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & F.col("host_kept")).alias("kept"),
    )


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same for a table ``documents``, with the same rules."""
    sums, priors, rates, over = [], [], [], []
    for r in rules:
        n = r.name
        sums.append(f"sum(({r.failed})::INT)::DOUBLE AS {n}")
        priors.append(f"sum({n}) / sum(n) AS m_{n}, greatest(sum(n * ({n} / n) * ({n} / n)) / sum(n) - (sum({n}) / sum(n)) ** 2, 1e-9) AS v_{n}")
        rates.append(f"greatest(m_{n} * (1 - m_{n}) / v_{n} - 1, {LEAST_PRIOR}) AS w_{n}")
        over.append(f"({n} + m_{n} * w_{n}) / (n + w_{n}) > {r.limit}")
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {words_sql()} AS ws FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS n FROM g WHERE w3 IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM c, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT l.doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols, len(ls) AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM l LEFT JOIN r USING (doc_id)),
h AS (SELECT source, count(*) AS n, {', '.join(sums)} FROM m GROUP BY source),
p AS (SELECT {', '.join(priors)} FROM h),
q AS (SELECT *, {', '.join(rates)} FROM p),
v AS (SELECT source, NOT ({' OR '.join(over)}) AS host_kept FROM h, q),
b AS (SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""


SQL = sql()
