"""Summaries, exports, bootstrap and paired tests."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rankforge.operators import paired, sampling, summary
from rankforge.operators.ranking import TIE_DIGITS
from rankforge.workload import shapes as s
from rankforge.workload import views as v
from rankforge.workload.experiment_queries import SUMMARY_COLS, final_report, lambda_report, run_means
from rankforge.workload.registry import cte, query

cte(
    "paired_rows",
    "SELECT b.checkpoint, b.run, b.profile_idx, b.method AS baseline, a.f1 AS a, b.f1 AS b, a.f1 - b.f1 AS diff FROM report b JOIN report a ON a.method = 'hybrid' AND b.method <> 'hybrid' AND a.checkpoint = b.checkpoint AND a.run = b.run AND a.profile_idx = b.profile_idx",
    "report",
)
cte(
    "paired_runs",
    "SELECT b.run, b.method AS baseline, a.f1 AS a, b.f1 AS b, a.f1 - b.f1 AS diff FROM (SELECT run, method, avg(f1) AS f1 FROM final_report GROUP BY run, method) b JOIN (SELECT run, avg(f1) AS f1 FROM final_report WHERE method = 'hybrid' GROUP BY run) a USING (run) WHERE method <> 'hybrid'",
    "final_report",
)


def run_values(spark, sf):
    return final_report(spark, sf).groupBy("run", "method").agg(F.avg("f1").alias("f1"))


@query("paired_by_run", "J11", "SELECT run::BIGINT AS run, baseline, round(a, 6) AS a, round(b, 6) AS b, round(diff, 6) AS diff FROM paired_runs", "paired_runs")
def paired_by_run(spark, sf):
    return s.rounded(paired.pair_up(run_values(spark, sf), "hybrid", ["run"]))


T_SQL = """SELECT {keys}, round(mean_diff, 6) AS mean_diff, n, wins, ties, losses, round(CASE WHEN sd <= 1e-12 THEN 0 ELSE mean_diff / (sd / sqrt(n)) END, 5) AS t_stat,
  round(CASE WHEN sd <= 1e-12 THEN 0 ELSE mean_diff / sd END, 5) AS cohen_d FROM (
SELECT {keys}, avg(diff) AS mean_diff, stddev_samp(diff) AS sd, count(*) AS n, count(*) FILTER (diff > 0) AS wins, count(*) FILTER (diff = 0) AS ties, count(*) FILTER (diff < 0) AS losses FROM {source} GROUP BY {keys})"""
T_COLUMNS = ("mean_diff", "n", "wins", "ties", "losses", "t_stat", "cohen_d")


def t_rounded(df, *keys):
    return s.rounded(
        df.select(*keys, F.round("mean_diff", 6).alias("mean_diff"), "n", "wins", "ties", "losses",
                  F.round("t_stat", 5).alias("t_stat"), F.round("cohen_d", 5).alias("cohen_d"))
    )


@query(
    "paired_t", "H1 H2 A15",
    T_SQL.format(keys="baseline", source=f"(SELECT baseline, round(diff, {TIE_DIGITS}) + 0.0 AS diff FROM paired_runs)"), "paired_runs",
)
def paired_t(spark, sf):
    pairs = paired.pair_up(run_values(spark, sf), "hybrid", ["run"])
    return t_rounded(paired.paired_t(pairs, guard=True, p_values=False, round_digits=TIE_DIGITS), "baseline")


@query("paired_t_by_checkpoint", "H2 H4 A15", T_SQL.format(keys="checkpoint, baseline", source="paired_rows"), "paired_rows")
def paired_t_by_checkpoint(spark, sf):
    pairs = paired.pair_up(s.report(spark, sf), "hybrid", ["run", "profile_idx"], ["checkpoint"])
    return t_rounded(paired.paired_t(pairs, ["checkpoint", "baseline"], guard=True, p_values=False), "checkpoint", "baseline")


@query("paired_t_p_values", "H1 H4")
def paired_t_p_values(spark, sf):
    pairs = paired.pair_up(s.report(spark, sf), "hybrid", ["run", "profile_idx"], ["checkpoint"])
    return paired.paired_t(pairs, ["checkpoint", "baseline"])


cte(
    "signed_ranks",
    """SELECT checkpoint, baseline, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, count(*) AS n_nonzero FROM (
SELECT checkpoint, baseline, d, rank() OVER (PARTITION BY checkpoint, baseline ORDER BY abs(d)) + (count(*) OVER (PARTITION BY checkpoint, baseline, abs(d)) - 1) / 2 AS r
FROM (SELECT checkpoint, baseline, round(diff, 9) AS d FROM paired_rows) WHERE d <> 0) GROUP BY checkpoint, baseline""",
    "paired_rows",
)
cte(
    "tie_terms",
    "SELECT checkpoint, baseline, sum(t * t * t - t) AS tie_term FROM (SELECT checkpoint, baseline, count(*)::DOUBLE AS t FROM paired_rows WHERE round(diff, 9) <> 0 GROUP BY checkpoint, baseline, abs(round(diff, 9))) GROUP BY checkpoint, baseline",
    "paired_rows",
)


cte(
    "ild_pairs",
    "SELECT b.run, b.profile_idx, b.method AS baseline, round(a.ild - b.ild, 9) AS diff FROM ild_rows b JOIN ild_rows a ON a.method = 'hybrid' AND b.method <> 'hybrid' AND a.run = b.run AND a.profile_idx = b.profile_idx",
    "ild_rows",
)
cte(
    "rank_chances",
    """SELECT * FROM (WITH RECURSIVE c(n, p) AS (SELECT 0, [1.0::DOUBLE] UNION ALL SELECT n + 1, list_transform(range(1, len(p) + n + 2),
  lambda i: (CASE WHEN i <= len(p) THEN p[i] ELSE 0 END + CASE WHEN i > n + 1 THEN p[i - n - 1] ELSE 0 END) / 2.0::DOUBLE) FROM c WHERE n < 50) SELECT n, p FROM c)""",
)
cte(
    "ild_ranks",
    """SELECT baseline, sum(CASE WHEN diff > 0 THEN r ELSE 0 END)::DOUBLE AS w_plus, count(*) AS n_nonzero, max(peers) AS peers FROM (
SELECT baseline, diff, rank() OVER (PARTITION BY baseline ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY baseline, abs(diff)) - 1) / 2.0::DOUBLE AS r,
  count(*) OVER (PARTITION BY baseline, abs(diff)) AS peers FROM ild_pairs WHERE diff <> 0) GROUP BY baseline""",
    "ild_pairs",
)


@query(
    "wilcoxon_exact", "H3",
    """SELECT s.baseline, n_pairs, coalesce(n_nonzero, 0) AS n_nonzero, coalesce(w_plus, 0)::DOUBLE AS w_plus,
  round(CASE WHEN n_pairs = n_nonzero AND peers = 1 AND n_pairs <= 50 THEN list_sum(c.p[w_plus::BIGINT + 1:]) END, 9) AS p_exact
FROM (SELECT baseline, count(*) AS n_pairs FROM ild_pairs GROUP BY baseline) s LEFT JOIN ild_ranks USING (baseline) LEFT JOIN rank_chances c ON c.n = n_nonzero""",
    "ild_pairs ild_ranks rank_chances",
)
def wilcoxon_exact(spark, sf):
    """List diversity of the blend against every other method, by run and profile."""
    from rankforge.operators import metrics
    from rankforge.plans import experiment as ex

    ild = metrics.intra_list_distance(s.final_lists(spark, sf), s.samples(spark, sf), [*ex.GROUP, "method"], ["run"])
    pairs = paired.pair_up(ild, "hybrid", list(ex.GROUP), value="ild")
    tested = paired.wilcoxon_exact(pairs, ["baseline"], round_digits=9)
    return s.rounded(tested.select("baseline", "n_pairs", "n_nonzero", "w_plus", "p_exact"), 9)


@query(
    "wilcoxon", "H3 H4",
    "SELECT k.checkpoint, k.baseline, coalesce(w_plus, 0)::DOUBLE AS w_plus, coalesce(tie_term, 0)::DOUBLE AS tie_term, coalesce(n_nonzero, 0) AS n_nonzero FROM (SELECT DISTINCT checkpoint, baseline FROM paired_rows) k LEFT JOIN signed_ranks USING (checkpoint, baseline) LEFT JOIN tie_terms USING (checkpoint, baseline)",
    "paired_rows signed_ranks tie_terms",
)
def wilcoxon(spark, sf):
    pairs = paired.pair_up(s.report(spark, sf), "hybrid", ["run", "profile_idx"], ["checkpoint"])
    return s.rounded(paired.wilcoxon(pairs, ["checkpoint", "baseline"], round_digits=9, p_values=False))


@query(
    "win_tie_loss", "A15",
    "SELECT checkpoint, baseline, count(*) FILTER (diff > 0) AS wins, count(*) FILTER (diff = 0) AS ties, count(*) FILTER (diff < 0) AS losses FROM paired_rows GROUP BY checkpoint, baseline",
    "paired_rows",
)
def win_tie_loss(spark, sf):
    pairs = paired.pair_up(s.report(spark, sf), "hybrid", ["run", "profile_idx"], ["checkpoint"])
    return paired.paired_t(pairs, ["checkpoint", "baseline"], p_values=False).select("checkpoint", "baseline", "wins", "ties", "losses")


@query(
    "test_battery", "H4 H1 H3 A15",
    """SELECT checkpoint, baseline, round(avg(diff), 6) AS mean_diff, round(median(diff), 6) AS median_diff, count(*) AS n FROM paired_rows GROUP BY checkpoint, baseline""",
    "paired_rows",
)
def test_battery(spark, sf):
    full = paired.test_battery(s.report(spark, sf), "hybrid", ["run", "profile_idx"], ["checkpoint"])
    return s.rounded(full.select("checkpoint", "baseline", "mean_diff", "median_diff", "n"))


@query("test_battery_p_values", "H4 H1 H3")
def test_battery_p_values(spark, sf):
    return paired.test_battery(s.report(spark, sf), "hybrid", ["run", "profile_idx"], ["checkpoint"])


cte("user_metric", "SELECT user_id, split, avg(rating) AS value FROM selected_users GROUP BY user_id, split", "selected_users")
cte("user_numbers", "SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM user_metric)", "user_metric")
cte(
    "boot",
    """SELECT split, replicate, sum(value * times) / sum(times) AS value FROM user_metric JOIN (
SELECT replicate, u.user_id, count(*) AS times FROM (
SELECT replicate, ('0x' || substring(md5(concat_ws('|', 42, replicate, slot.idx)), 1, 13))::BIGINT % slot.n AS idx FROM user_numbers slot CROSS JOIN range(30) r(replicate)) d
JOIN user_numbers u ON u.idx = d.idx GROUP BY replicate, u.user_id) USING (user_id) GROUP BY split, replicate""",
    "user_metric", "user_numbers",
)


def user_metric(spark, sf):
    return v.selected(spark, sf).groupBy("user_id", "split").agg(F.avg("rating").alias("value"))


@query("user_bootstrap", "M5", "SELECT split, replicate::BIGINT AS replicate, round(value, 6) AS value FROM boot", "boot")
def user_bootstrap(spark, sf):
    return s.rounded(sampling.user_bootstrap(user_metric(spark, sf), "value", ["split"]))


@query(
    "bootstrap_summary", "M5 A5",
    "SELECT split, " + SUMMARY_COLS.replace("f1", "value") + " FROM boot GROUP BY split", "boot",
)
def bootstrap_summary(spark, sf):
    return s.rounded(summary.summarize(sampling.user_bootstrap(user_metric(spark, sf), "value", ["split"]), "value", ["split"]))


# Cumulative Poisson(1) probabilities of 0..9.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) for i in range(10)]


@query(
    "poisson_bootstrap", "M5",
    f"""SELECT split, replicate::BIGINT AS replicate, round(sum(value * times) / nullif(sum(times), 0), 6) AS value FROM (
SELECT split, value, replicate, {' + '.join(f'(u >= {p!r}::DOUBLE)::INTEGER' for p in POISSON)} AS times FROM (
SELECT *, ('0x' || substring(md5(concat_ws('|', 42, replicate, user_id)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
FROM user_metric CROSS JOIN range(30) r(replicate))) GROUP BY split, replicate""",
    "user_metric",
)
def poisson_bootstrap(spark, sf):
    return s.rounded(sampling.poisson_bootstrap(user_metric(spark, sf), "value", ["split"]))


@query(
    "summarize_users", "A5",
    "SELECT split, " + SUMMARY_COLS.replace("f1", "value") + " FROM user_metric GROUP BY split", "user_metric",
)
def summarize_users(spark, sf):
    return s.rounded(summary.summarize_large(user_metric(spark, sf), "value", ["split"]))


cte("lambda_runs", "SELECT run, 'lambda_' || lambda_q AS method, 10000::BIGINT AS checkpoint, avg(f1) AS f1 FROM lambda_report GROUP BY run, lambda_q", "lambda_report")


@query(
    "summary_export", "S12 S7",
    " UNION ALL ".join(
        f"SELECT '{e}' AS experiment, 'main_400' AS grp, method, checkpoint, round(avg(f1), 6) AS mean, round(stddev_pop(f1), 6) AS std, round(quantile_cont(f1, 0.025::DOUBLE), 6) AS ci_lo, round(quantile_cont(f1, 0.975::DOUBLE), 6) AS ci_hi FROM {t} GROUP BY method, checkpoint"
        for e, t in (("methods", "run_means"), ("blend", "lambda_runs"))
    ),
    "run_means lambda_runs",
)
def summary_export(spark, sf):
    methods = summary.summarize(run_means(spark, sf), "f1", ["method", "checkpoint"])
    runs = lambda_report(spark, sf).groupBy("run", "lambda_q").agg(F.avg("f1").alias("f1"))
    blend = summary.summarize(
        runs.select("run", F.concat(F.lit("lambda_"), F.col("lambda_q").cast("string")).alias("method"), F.lit(10000).cast("long").alias("checkpoint"), "f1"),
        "f1", ["method", "checkpoint"],
    )
    return s.rounded(summary.tagged_export({("methods", "main_400"): methods, ("blend", "main_400"): blend}))
