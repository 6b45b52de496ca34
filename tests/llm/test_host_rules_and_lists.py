from datetime import date

import duckdb
import pandas as pd

from rankforge.llm import host_rules, url_lists

GOOD = " ".join(f"word{i}" for i in range(80))
NOISE = " ".join(f"w{i}***" for i in range(80))


def test_hosts_are_judged_by_shrunk_rates(spark):
    rows = [(f"good{h}", GOOD) for h in range(30) for _ in range(20)] + [("bad", NOISE)] * 60 + [("bad", GOOD)] * 4 + [("tiny", NOISE)] + [(None, GOOD)]
    docs = spark.createDataFrame([(i, h, t, True) for i, (h, t) in enumerate(rows)], "doc_id long, source string, text string, kept boolean")
    got = {r.doc_id: r for r in host_rules.judge_documents(docs).collect()}
    kept = {(h, t): got[i].kept for i, (h, t) in enumerate(rows)}
    assert not kept["bad", NOISE] and not kept["bad", GOOD]  # the host's verdict reaches all its documents
    assert kept["tiny", NOISE] and kept[None, GOOD] and all(kept[f"good{h}", GOOD] for h in range(30))
    assert not any(r.base_failed for r in got.values())
    rates = {r.host: r for r in host_rules.host_verdicts(docs.selectExpr("source AS host", "80L AS n_words", "0L AS n_repeat_words", "if(text like '%*%', 240L, 0L) AS n_symbols", "0L AS n_dup_lines", "1L AS n_lines", "400L AS word_chars")).collect()}
    assert rates["bad"].symbols_rate > 0.5 > rates["tiny"].symbols_rate > rates["good0"].symbols_rate


def test_prior_and_raw_rate_decide_differently_and_sql_agrees(spark):
    """A host of one bad document and one a little over the limit are kept by the shrunk rate and
    would go by the raw one; a large host over the limit goes either way."""
    rows = [(f"good{h}", GOOD) for h in range(40) for _ in range(10)] + [("bad", NOISE)] * 60 + [("bad", GOOD)] * 5
    rows += [("tiny", NOISE)] + [("edge", NOISE)] * 6 + [("edge", GOOD)] * 5 + [(None, GOOD), (None, None), ("good1", "few words")]
    docs = pd.DataFrame([(i, h, t) for i, (h, t) in enumerate(rows)], columns=["doc_id", "source", "text"])
    frame = spark.createDataFrame(list(docs.itertuples(index=False, name=None)), "doc_id long, source string, text string")
    strict = tuple(host_rules.Rule(r.name, r.failed, 0.05) for r in host_rules.RULES)
    dropped = {}
    for name, rules in (("usual", host_rules.RULES), ("strict", strict)):
        got = host_rules.judge_documents(frame, rules=rules)
        con = duckdb.connect()
        con.register("documents", docs)
        want = con.execute(host_rules.sql(rules)).fetchdf().sort_values("doc_id")
        have = got.select(*want.columns).toPandas().sort_values("doc_id")
        assert have.to_numpy().tolist() == want.to_numpy().tolist()
        own = have.set_index("doc_id")
        dropped[name] = {h for i, (h, t) in enumerate(rows) if not own.loc[i, "kept"] and not own.loc[i, "base_failed"]}
    raw = {h: sum(t == NOISE for g, t in rows if g == h) / sum(g == h for g, _ in rows) for h in ("bad", "tiny", "edge")}
    assert all(rate > 0.5 for rate in raw.values()) and dropped["usual"] == {"bad"}
    assert dropped["strict"] >= {"bad", "tiny", "edge"}


def test_entries_hold_from_day_to_day(spark):
    d = lambda n: date(2024, 1, n)
    entries = spark.createDataFrame([
        ("host", "a.com", True, d(5)), ("host", "a.com", False, d(10)), ("host", "a.com", True, d(20)), ("host", "a.com", True, d(20)), ("domain", "b.org", True, d(3)),
        ("prefix", "c.net/x/y", True, d(1)), ("host", "d.com", True, d(7)), ("host", "d.com", False, d(7)), ("other", "a.com", True, d(1)), ("host", None, True, d(1)),
    ], "kind string, pattern string, listed boolean, at date")
    urls = [("http://a.com/", d(4), 0), ("http://a.com/", d(5), 1), ("http://A.com", d(9), 1), ("http://a.com", d(10), 0), ("http://a.com", d(30), 1), ("http://s.b.org", d(3), 1),
            ("http://xb.org", d(9), 0), ("http://c.net/x/y/z?q", d(2), 1), ("http://c.net/x/yy", d(2), 0), ("http://d.com", d(7), 0), (None, d(7), 0), ("http://a.com", None, 0), ("http://a.com:8/", date(2031, 5, 5), 1)]
    pages = spark.createDataFrame([(i, u, t, 5, "k") for i, (u, t, _) in enumerate(urls)] + [(4, *urls[4][:2], 5, "k")], "page_id long, url string, captured date, n_active int, key string")
    rows = url_lists.judge_captures(pages, entries).collect()
    assert len(rows) == len(urls) + 1 and {r.page_id: r.n_active for r in rows} == {i: n for i, (*_, n) in enumerate(urls)}
    assert {r.entry for r in rows if r.page_id == 7} == {"prefix:c.net/x/y"} and all(r.blocked == (r.n_active > 0) for r in rows)
    none = url_lists.judge_captures(pages, entries.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.blocked for r in none)
