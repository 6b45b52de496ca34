"""URL filters with a temporal list join.

A list is a log of dated entries: a pattern is put on it or taken off it. Entries
become validity intervals, and every capture is held against the entries that were
active when it was fetched: what was listed a year later does not count.

A pattern is a host, a domain (the host and all below it) or a prefix (a host and the
first parts of its path). A capture is looked up under each of its own keys of these
kinds, only as deep as the list goes. Intervals and captures meet in (key, month):
the months deal out a host with a third of all captures, and an interval is sent
to the months that it covers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.functions.hashing import hash_long
from rankforge.llm.shared import col
from rankforge.session import materialize

KINDS = ("host", "domain", "prefix")
DAYS = 30
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)(?::[0-9]*)?([^?#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case; empty for what is not a URL."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def validity(entries: DataFrame) -> DataFrame:
    """(kind, pattern, since, until) from (kind, pattern, listed, at): an entry holds until
    the pattern's next entry; ``until`` is null for the last. On one day the entry that
    takes the pattern off is the later one. Rows with a null are not entries."""
    clean = entries.select("kind", "pattern", "listed", "at").dropna().filter(F.col("kind").isin(*KINDS)).distinct()
    order = Window.partitionBy("kind", "pattern").orderBy("at", F.desc("listed"))
    return (
        clean.withColumn("until", F.lead("at").over(order)).filter("listed")
        .filter("until is null or until > at").select("kind", "pattern", F.col("at").alias("since"), "until")
    )


def capture_keys(host: Column, path: Column, labels: int, parts: int) -> Column:
    """All (kind, pattern) under which a capture may be listed: its host, its domains of
    at most ``labels`` labels, its prefixes of at most ``parts`` parts."""
    names = F.split(host, r"\.")
    n = F.size(names)
    domains = F.transform(
        F.sequence(F.lit(1), F.least(n, F.lit(max(labels, 1)))),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(names, n - i + 1, i), ".").alias("pattern")),
    )
    steps = F.slice(F.array_remove(F.split(path, "/"), ""), 1, max(parts, 1))
    prefixes = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(steps)), lambda i: i > 0),
        lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")).alias("pattern")),
    )
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern")))
    return F.when(host == "", F.array().cast("array<struct<kind:string,pattern:string>>")).otherwise(F.concat(own, domains, prefixes))


def judge_captures(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", at: str = "captured") -> DataFrame:
    """One row per capture: key, url, host, captured, n_active, blocked, entry.

    ``n_active`` counts the entries active on the day of the capture, ``entry`` is the most
    specific of them (the longest pattern, then by kind).

    Defined cases: a null or malformed URL has an empty host and no entry; a null date is
    before every entry; captures that repeat are judged one by one; an empty list blocks
    nothing; an empty table gives no rows; other columns are ignored.
    """
    intervals = materialize(validity(entries))
    depth = intervals.agg(
        F.max(F.when(F.col("kind") == "domain", F.size(F.split("pattern", r"\.")))).alias("labels"),
        F.max(F.when(F.col("kind") == "prefix", F.size(F.split("pattern", "/")) - 1)).alias("parts"),
    ).first()
    rows = materialize(captures.select(
        col(key).alias("key"), col(url).alias("url"), host_of(col(url)).alias("host"), path_of(col(url)).alias("_path"),
        col(at).cast("date").alias("captured"), F.monotonically_increasing_id().alias("_row"),
    ))
    month = lambda d: F.floor(F.unix_date(d) / DAYS).cast("int")
    last = rows.agg(F.max("captured")).first()[0]
    end = F.coalesce(F.least(F.date_sub("until", 1), F.lit(last)), F.lit(last))
    spread = intervals.filter(F.col("since") <= F.lit(last)).withColumn("_month", F.explode(F.sequence(month(F.col("since")), month(end))))
    keyed = rows.select("_row", "captured", F.explode(capture_keys(F.col("host"), F.col("_path"), depth["labels"] or 0, depth["parts"] or 0)).alias("_k")).select(
        "_row", "captured", "_k.kind", "_k.pattern", month(F.col("captured")).alias("_month")
    )
    active = keyed.join(spread, ["kind", "pattern", "_month"]).filter("captured >= since and (until is null or captured < until)")
    rank = F.struct(F.length("pattern").alias("n"), F.col("kind").alias("kind"), F.col("pattern").alias("pattern"))
    found = active.groupBy("_row").agg(F.count("*").alias("n_active"), F.max(rank).alias("_best"))
    return rows.join(found, "_row", "left").select(
        F.col("key").alias(key), "url", "host", "captured", F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"),
        F.col("n_active").isNotNull().alias("blocked"), F.concat_ws(":", "_best.kind", "_best.pattern").alias("entry"),
    )


# the given pages have no dates and no list: both follow from hashes of pages and hosts

FIRST_DAY = "2024-01-01"


def dated_captures(pages: DataFrame) -> DataFrame:
    """The pages, each with a day of 2024 that a hash of its id gives."""
    return pages.select("page_id", "url", F.date_add(F.lit(FIRST_DAY).cast("date"), (hash_long("captured", F.col("page_id")) % 365).cast("int")).alias("captured"))


def list_of_hosts(pages: DataFrame) -> DataFrame:
    """A list over the hosts of the pages. By a hash of the host: its host is listed for up
    to 60 days; the domain two labels up is listed for good; its prefix /en is listed,
    taken off and listed again; or nothing."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host <> ''").distinct()
    day = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))
    known = hosts.select("host", (hash_long("kind", F.col("host")) % 4).alias("k"), (hash_long("since", F.col("host")) % 300).alias("d"), (1 + hash_long("days", F.col("host")) % 60).alias("n"))
    entry = lambda kind, pattern, listed, at: F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(listed).alias("listed"), day(at).alias("at"))
    d, n, host = F.col("d"), F.col("n"), F.col("host")
    prefix, domain = F.concat(host, F.lit("/en")), F.regexp_replace(host, r"^(m|blog|www)\.", "")
    made = (
        F.when(F.col("k") == 0, F.array(entry("host", host, True, d), entry("host", host, False, d + n)))
        .when(F.col("k") == 1, F.array(entry("domain", domain, True, d)))
        .when(F.col("k") == 2, F.array(entry("prefix", prefix, True, d), entry("prefix", prefix, False, d + n), entry("prefix", prefix, True, d + 2 * n)))
    )
    return known.select(F.explode(made).alias("e")).select("e.*")


_H = "(('0x' || substr(md5(concat_ws('|', '{0}', {1}::VARCHAR)), 1, 13))::BIGINT)"
SQL = rf"""
WITH p AS (SELECT page_id, url, lower(regexp_extract(coalesce(url, ''), '{URL}', 1)) AS host, regexp_extract(coalesce(url, ''), '{URL}', 2) AS path,
                  DATE '{FIRST_DAY}' + ({_H.format('captured', 'page_id')} % 365)::INT AS captured FROM pages),
h AS (SELECT host, {_H.format('kind', 'host')} % 4 AS k, ({_H.format('since', 'host')} % 300)::INT AS d, (1 + {_H.format('days', 'host')} % 60)::INT AS n
      FROM (SELECT DISTINCT host FROM p WHERE host <> '')),
e AS (SELECT 'host' AS kind, host AS pattern, true AS listed, d AS day FROM h WHERE k = 0
      UNION SELECT 'host', host, false, d + n FROM h WHERE k = 0
      UNION SELECT 'domain', regexp_replace(host, '^(m|blog|www)\.', ''), true, d FROM h WHERE k = 1
      UNION SELECT 'prefix', host || '/en', true, d FROM h WHERE k = 2
      UNION SELECT 'prefix', host || '/en', false, d + n FROM h WHERE k = 2
      UNION SELECT 'prefix', host || '/en', true, d + 2 * n FROM h WHERE k = 2),
v AS (SELECT *, lead(day) OVER (PARTITION BY kind, pattern ORDER BY day, listed DESC) AS until FROM e),
i AS (SELECT kind, pattern, DATE '{FIRST_DAY}' + day AS since, DATE '{FIRST_DAY}' + until AS until FROM v WHERE listed AND (until IS NULL OR until > day)),
m AS (SELECT page_id, count(*) AS n_active, max({{'n': length(pattern), 'kind': kind, 'pattern': pattern}}) AS best
      FROM p JOIN i ON captured >= since AND (until IS NULL OR captured < until)
           AND CASE kind WHEN 'host' THEN host = pattern WHEN 'domain' THEN host = pattern OR ends_with(host, '.' || pattern)
                         ELSE starts_with(host || regexp_replace(path, '/+', '/', 'g') || '/', pattern || '/') END
      GROUP BY page_id)
SELECT p.page_id, url, host, captured, coalesce(n_active, 0) AS n_active, n_active IS NOT NULL AS blocked,
       coalesce(best.kind || ':' || best.pattern, '') AS entry
FROM p LEFT JOIN m ON p.page_id = m.page_id
"""
