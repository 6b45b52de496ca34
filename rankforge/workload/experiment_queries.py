"""Experiment queries: blending, list metrics, sensitivity and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankforge.functions import profiles as pf
from rankforge.operators import blending, metrics, sampling, summary, utility
from rankforge.operators.ranking import top_k
from rankforge.plans import experiment as ex
from rankforge.session import materialize
from rankforge.workload import shapes as s
from rankforge.workload import views as v
from rankforge.workload.registry import cte, query, shared

G = "run::BIGINT AS run, profile_idx::BIGINT AS profile_idx"


@query("hybrid_scores", "D3", f"SELECT {G}, item_id, round(hybrid, 6) AS hybrid FROM learned", "learned")
def hybrid_scores(spark, sf):
    frame = s.scored(spark, sf).join(s.values(spark, sf).withColumnRenamed("state", "profile_idx"), ["profile_idx", "item_id"], "left")
    return s.rounded(blending.hybrid(frame, ex.GROUP).select(*ex.GROUP, "item_id", "hybrid"))


@query("gated_scores", "D4", f"SELECT {G}, item_id, round(gated, 6) AS gated, round(lambda_q, 6) AS lambda_q FROM learned", "learned")
def gated_scores(spark, sf):
    frame = s.scored(spark, sf).join(s.values(spark, sf).withColumnRenamed("state", "profile_idx"), ["profile_idx", "item_id"], "left")
    return s.rounded(blending.confidence_gated(frame, ex.GROUP).select(*ex.GROUP, "item_id", "gated", "lambda_q"))


cte("final_report", s.metrics_sql("final_lists", "truth", "run, profile_idx, method", "run, profile_idx"), "final_lists", "truth")
REPORT_COLS = "n_pred, n_truth, tp, round(f1, 6) AS f1, round(ndcg, 6) AS ndcg"


def final_report(spark, sf):
    return metrics.list_metrics(s.final_lists(spark, sf), s.truth(spark, sf), [*ex.GROUP, "method"], list(ex.GROUP))


@query("list_f1_ndcg", "E1 E2 U4", f"SELECT {G}, method, {REPORT_COLS} FROM final_report", "final_report")
def list_f1_ndcg(spark, sf):
    return s.rounded(final_report(spark, sf))


@query("method_checkpoint_report", "E7 L7 D3 D4", f"SELECT {G}, method, checkpoint, {REPORT_COLS} FROM report", "report")
def method_checkpoint_report(spark, sf):
    group = [*ex.GROUP, "checkpoint"]
    learned = ex.learned_scores(s.scored(spark, sf), s.snapshots(spark, sf), s.CHECKPOINTS)
    lists = ex.learned_lists(learned, group)
    return s.rounded(ex.checkpoint_report(s.fixed(spark, sf), lists, s.truth(spark, sf), s.CHECKPOINTS))


cte("run_means", "SELECT run, method, checkpoint, avg(f1) AS f1 FROM report GROUP BY run, method, checkpoint", "report")


def run_means(spark, sf):
    return s.report(spark, sf).groupBy("run", "method", "checkpoint").agg(F.avg("f1").alias("f1"))


SUMMARY_COLS = "round(avg(f1), 6) AS mean, round(stddev_pop(f1), 6) AS std, round(quantile_cont(f1, 0.025::DOUBLE), 6) AS ci_lo, round(quantile_cont(f1, 0.975::DOUBLE), 6) AS ci_hi, count(*) AS n"


@query(
    "checkpoint_summary", "A5 A6",
    f"SELECT method, checkpoint, {SUMMARY_COLS}, list(round(f1, 6) ORDER BY run) AS raw FROM run_means GROUP BY method, checkpoint", "run_means",
)
def checkpoint_summary(spark, sf):
    out = summary.summarize(run_means(spark, sf), "f1", ["method", "checkpoint"], raw=True, order="run")
    return s.rounded(out.withColumn("raw", F.transform("raw", lambda x: F.round(x, 6))))


@query("two_level_mean", "A6", "SELECT method, checkpoint, round(avg(f1), 6) AS f1 FROM run_means GROUP BY method, checkpoint", "run_means")
def two_level_mean(spark, sf):
    return s.rounded(summary.two_level_mean(s.report(spark, sf), "f1", ["run", "method", "checkpoint"], ["method", "checkpoint"]))


@query(
    "profile_gap", "A9",
    """SELECT profile_idx::BIGINT AS profile_idx, round(h, 6) AS hybrid, round(r, 6) AS rl_only, round(t, 6) AS topsis_only, round(h - r, 6) AS hybrid_minus_rl, round(h - t, 6) AS hybrid_minus_topsis FROM (
SELECT profile_idx, avg(f1) FILTER (method = 'hybrid') AS h, avg(f1) FILTER (method = 'rl_only') AS r, avg(f1) FILTER (method = 'topsis_only') AS t FROM final_report GROUP BY profile_idx)""",
    "final_report",
)
def profile_gap(spark, sf):
    return s.rounded(summary.profile_gap(final_report(spark, sf), by=["profile_idx"]))


LAMBDAS = "(SELECT unnest([" + ", ".join(f"{x}::DOUBLE" for x in pf.LAMBDA_GRID) + "]) AS lambda_q)"
cte(
    "lambda_lists",
    s.top_sql(f"(SELECT l.run, l.profile_idx, l.item_id, lambda_q, lambda_q * q_norm + (1 - lambda_q) * t_norm AS score FROM (SELECT * EXCLUDE (lambda_q) FROM learned) l CROSS JOIN {LAMBDAS})", "score", 7, "run, profile_idx, lambda_q", "run, profile_idx, lambda_q, rank, item_id"),
    "learned",
)
cte("lambda_report", s.metrics_sql("lambda_lists", "truth", "run, profile_idx, lambda_q", "run, profile_idx"), "lambda_lists", "truth")


@shared
def lambda_report(spark, sf):
    return ex.blend_sensitivity(s.learned(spark, sf), s.truth(spark, sf))


@query(
    "blend_sensitivity", "D5 A5 A6",
    f"SELECT lambda_q, {SUMMARY_COLS} FROM (SELECT run, lambda_q, avg(f1) AS f1 FROM lambda_report GROUP BY run, lambda_q) GROUP BY lambda_q", "lambda_report",
)
def blend_sensitivity(spark, sf):
    rows = ex.blend_sensitivity(s.learned(spark, sf), s.truth(spark, sf))
    runs = rows.groupBy("run", "lambda_q").agg(F.avg("f1").alias("f1"))
    return s.rounded(summary.summarize(runs, "f1", ["lambda_q"]))


ALPHAS = "(SELECT unnest([" + ", ".join(f"{x}::DOUBLE" for x in pf.ALPHA_GRID) + "]) AS alpha)"
cte(
    "alpha_truth",
    s.top_sql(f"(SELECT *, {s.mm('b', 'run, profile_idx, alpha')} AS t2 FROM (SELECT run, profile_idx, item_id, alpha, alpha * observable + (1 - alpha) * hidden AS b FROM scored CROSS JOIN {ALPHAS}))", "t2", 7, "run, profile_idx, alpha", "run, profile_idx, alpha, rank, item_id"),
    "scored",
)
cte("alpha_lists", f"SELECT run, profile_idx, method, rank, item_id, alpha FROM final_lists CROSS JOIN {ALPHAS} WHERE method IN ('topsis_only', 'rl_only', 'hybrid')", "final_lists")
cte("alpha_report", s.metrics_sql("alpha_lists", "alpha_truth", "run, profile_idx, alpha, method", "run, profile_idx, alpha"), "alpha_lists", "alpha_truth")


@query(
    "target_split_sensitivity", "D6 P16",
    f"SELECT alpha, method, {SUMMARY_COLS} FROM (SELECT run, alpha, method, avg(f1) AS f1 FROM alpha_report GROUP BY run, alpha, method) GROUP BY alpha, method", "alpha_report",
)
def target_split_sensitivity(spark, sf):
    lists = s.final_lists(spark, sf).filter(F.col("method").isin("topsis_only", "rl_only", "hybrid"))
    rows = ex.split_sensitivity(s.scored(spark, sf), lists)
    runs = rows.groupBy("run", "alpha", "method").agg(F.avg("f1").alias("f1"))
    return s.rounded(summary.summarize(runs, "f1", ["alpha", "method"]))


cte(
    "ild_rows",
    """SELECT run, profile_idx, method, coalesce(avg(d), 0) AS ild FROM (SELECT a.run, a.profile_idx, a.method, sqrt(pow(x.price_pct - y.price_pct, 2) + pow(x.quality_pct - y.quality_pct, 2)
  + pow(x.popularity_pct - y.popularity_pct, 2) + pow(x.rating_pct - y.rating_pct, 2) + pow(x.recency_pct - y.recency_pct, 2)) AS d
FROM final_lists a JOIN final_lists b ON a.run = b.run AND a.profile_idx = b.profile_idx AND a.method = b.method AND a.item_id < b.item_id
JOIN samples x ON x.run = a.run AND x.item_id = a.item_id JOIN samples y ON y.run = b.run AND y.item_id = b.item_id) GROUP BY run, profile_idx, method""",
    "final_lists", "samples",
)


@query("intra_list_distance", "E3", f"SELECT {G}, method, round(ild, 6) AS ild FROM ild_rows", "ild_rows")
def intra_list_distance(spark, sf):
    return s.rounded(metrics.intra_list_distance(s.final_lists(spark, sf), s.samples(spark, sf), [*ex.GROUP, "method"], ["run"]))


@query(
    "gated_vs_static", "D10",
    """SELECT r.run::BIGINT AS run, round(static, 6) AS static, round(gated, 6) AS gated, round(mean_lambda, 6) AS mean_lambda FROM
(SELECT run, avg(f1) FILTER (method = 'hybrid') AS static, avg(f1) FILTER (method = 'gated') AS gated FROM final_report GROUP BY run) r
JOIN (SELECT run, avg(lambda_q) AS mean_lambda FROM learned GROUP BY run) l ON l.run = r.run""",
    "final_report learned",
)
def gated_vs_static(spark, sf):
    f1 = final_report(spark, sf).groupBy("run").pivot("method", ["hybrid", "gated"]).agg(F.avg("f1"))
    lam = s.learned(spark, sf).groupBy("run").agg(F.avg("lambda_q").alias("mean_lambda"))
    return s.rounded(f1.join(lam, "run").select("run", F.col("hybrid").alias("static"), "gated", "mean_lambda"))


cte(
    "diag_lists",
    " UNION ALL ".join(s.top_sql("scored", m, 7, "run, profile_idx", f"run, profile_idx, '{m}' AS method, rank, item_id") for m in ("topsis", "hidden", "observable")),
    "scored",
)
cte("diag_report", s.metrics_sql("diag_lists", "truth", "run, profile_idx, method", "run, profile_idx"), "diag_lists", "truth")


@query(
    "diagnostics", "E8 A8",
    f"""SELECT r.run::BIGINT AS run, r.profile_idx::BIGINT AS profile_idx, round(f1_topsis, 6) AS f1_topsis, round(f1_hidden, 6) AS f1_hidden, round(f1_observable, 6) AS f1_observable, round(c, 6) AS corr_topsis_target FROM
(SELECT run, profile_idx, max(f1) FILTER (method = 'topsis') AS f1_topsis, max(f1) FILTER (method = 'hidden') AS f1_hidden, max(f1) FILTER (method = 'observable') AS f1_observable FROM diag_report GROUP BY run, profile_idx) r
JOIN (SELECT run, profile_idx, corr(topsis, target) AS c FROM scored GROUP BY run, profile_idx) k ON k.run = r.run AND k.profile_idx = r.profile_idx""",
    "diag_report scored",
)
def diagnostics(spark, sf):
    return s.rounded(ex.diagnostics(s.scored(spark, sf)))


@query(
    "catalog_correlation", "A8",
    "SELECT profile, round(corr(topsis, target), 6) AS corr FROM item_profiles GROUP BY profile", "item_profiles",
)
def catalog_correlation(spark, sf):
    return s.rounded(s.item_profiles(spark, sf).groupBy("profile").agg(F.corr("topsis", "target").alias("corr")))


@query(
    "list_coverage", "A10",
    "SELECT method, count(DISTINCT item_id) AS n_listed, round(count(DISTINCT item_id) / (SELECT count(*) FROM items), 6) AS coverage FROM final_lists GROUP BY method",
    "final_lists items",
)
def list_coverage(spark, sf):
    return s.rounded(metrics.coverage(s.final_lists(spark, sf), v.items(spark, sf), ["method"]))


@query(
    "best_blend", "A14",
    "SELECT lambda_q, f1 FROM (SELECT lambda_q, round(avg(f1), 9) AS f1 FROM lambda_report GROUP BY lambda_q) ORDER BY f1 DESC, lambda_q LIMIT 1", "lambda_report",
)
def best_blend(spark, sf):
    means = lambda_report(spark, sf).groupBy("lambda_q").agg(F.round(F.avg("f1"), 9).alias("f1"))
    return summary.best_by(means, "lambda_q", "f1")


@query(
    "final_summary", "A18",
    """SELECT round(rnd, 6) AS random, round(pop, 6) AS popularity, round(t, 6) AS topsis_only, round(r, 6) AS rl_only, round(h, 6) AS hybrid, round(h - t, 6) AS hybrid_minus_topsis, round(h - r, 6) AS hybrid_minus_rl,
  best_lambda_q, round(best_f1, 6) AS best_f1, round(dr, 6) AS drift_rl_only, round(dh, 6) AS drift_hybrid FROM
(SELECT avg(f1) FILTER (method = 'random') AS rnd, avg(f1) FILTER (method = 'popularity') AS pop, avg(f1) FILTER (method = 'topsis_only') AS t, avg(f1) FILTER (method = 'rl_only') AS r, avg(f1) FILTER (method = 'hybrid') AS h FROM report WHERE checkpoint = 10000),
(SELECT lambda_q AS best_lambda_q, f1 AS best_f1 FROM (SELECT lambda_q, round(avg(f1), 9) AS f1 FROM lambda_report GROUP BY lambda_q) ORDER BY f1 DESC, lambda_q LIMIT 1),
(SELECT avg(f1) FILTER (method = 'rl_only') AS dr, avg(f1) FILTER (method = 'hybrid') AS dh FROM drift_report WHERE checkpoint = 10000)""",
    "report lambda_report drift_report",
)
def final_summary(spark, sf):
    from rankforge.workload.feedback_queries import drift_report

    last = F.col("checkpoint") == s.CHECKPOINTS[-1]
    return s.rounded(
        summary.final_summary(s.report(spark, sf).filter(last), lambda_report(spark, sf), drift_report(spark, sf).filter(last))
    )


SIZES = (200, 400, 800)
for _n in SIZES:
    cte(f"samples_{_n}", s.sample_sql(_n, s.N_RUNS, 19 * _n), "octants")
    cte(f"totals_{_n}", s.totals_sql(f"samples_{_n}", "run"), f"samples_{_n}")
    cte(f"weights_{_n}", s.weights_sql(f"totals_{_n}"), f"totals_{_n}")
    cte(f"topsis_{_n}", s.topsis_sql(f"samples_{_n}", f"weights_{_n}", "run"), f"samples_{_n}", f"weights_{_n}")
    cte(f"scored_{_n}", s.profile_sql(f"topsis_{_n}", "run"), f"topsis_{_n}", *s.PROFILE_CTES)
    cte(f"truth_{_n}", s.top_sql(f"scored_{_n}", "target", 7, "run, profile_idx", "run, profile_idx, rank, item_id"), f"scored_{_n}")
    cte(
        f"learned_{_n}",
        f"""SELECT *, 0.5 * {s.mm('q', 'run, profile_idx')} + 0.5 * {s.mm('topsis', 'run, profile_idx')} AS hybrid FROM (
SELECT f.*, coalesce(q.q, 0) AS q FROM scored_{_n} f LEFT JOIN q_final q ON q.state = f.profile_idx AND q.item_id = f.item_id)""",
        f"scored_{_n}", "q_final",
    )
    cte(
        f"lists_{_n}",
        " UNION ALL ".join(
            s.top_sql(f"scored_{_n}", c, 7, "run, profile_idx", f"run, profile_idx, '{m}' AS method, rank, item_id")
            for m, c in (("popularity", "popularity_pct"), ("topsis_only", "topsis"))
        )
        + " UNION ALL " + s.top_sql(f"scored_{_n}", "", 7, "run, profile_idx", "run, profile_idx, 'random' AS method, rank, item_id", order="md5(concat_ws('|', 'random', run, profile_idx, item_id)), item_id")
        + " UNION ALL " + " UNION ALL ".join(
            s.top_sql(f"learned_{_n}", c, 7, "run, profile_idx", f"run, profile_idx, '{m}' AS method, rank, item_id") for m, c in (("rl_only", "q"), ("hybrid", "hybrid"))
        ),
        f"scored_{_n}", f"learned_{_n}",
    )
    cte(f"report_{_n}", s.metrics_sql(f"lists_{_n}", f"truth_{_n}", "run, profile_idx, method", "run, profile_idx"), f"lists_{_n}", f"truth_{_n}")


@query(
    "catalog_size_sensitivity", "E9 M1",
    " UNION ALL ".join(
        f"SELECT {n}::BIGINT AS n_items, method, {SUMMARY_COLS} FROM (SELECT run, method, avg(f1) AS f1 FROM report_{n} GROUP BY run, method) GROUP BY method" for n in SIZES
    ),
    " ".join(f"report_{n}" for n in SIZES),
)
def catalog_size_sensitivity(spark, sf):
    """Five methods on samples of three sizes, with the values of the whole log."""
    out = None
    octants = materialize(sampling.octants(v.items(spark, sf)))
    for n in SIZES:
        drawn = materialize(sampling.stratified_sample(v.items(spark, sf), octants, n, s.N_RUNS, seed_shift=19 * n))
        scored = materialize(ex.scored_frame(drawn, v.FIXTURE_PROFILES))
        truth = ex.truth_lists(scored)
        learned = materialize(ex.learned_scores(scored, s.values(spark, sf), None))
        lists = ex.fixed_lists(scored).unionByName(ex.learned_lists(learned, ex.GROUP).filter("method <> 'gated'"))
        f1 = metrics.list_metrics(lists, truth, [*ex.GROUP, "method"], list(ex.GROUP))
        runs = f1.groupBy("run", "method").agg(F.avg("f1").alias("f1"))
        part = summary.summarize(runs, "f1", ["method"]).withColumn("n_items", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return s.rounded(out)


@query(
    "subset_rows", "F5",
    f"SELECT {G}, method, item_id FROM final_lists WHERE run = 0 AND rank <= 7 AND method = 'hybrid'", "final_lists",
)
def subset_rows(spark, sf):
    return s.rounded(s.final_lists(spark, sf).filter("run = 0 AND rank <= 7 AND method = 'hybrid'").select(*ex.GROUP, "method", "item_id"))


@query(
    "policy_tables", "S13",
    f"SELECT {G}, method, rank, item_id FROM final_lists", "final_lists",
)
def policy_tables(spark, sf):
    """Written as run partitions and read back."""
    import uuid

    from rankforge.session import shared_dir
    from rankforge.sources.writers import policy_tables as write

    path = f"{shared_dir(spark).rstrip('/')}/policy-{uuid.uuid4().hex}"
    policy = s.learned(spark, sf).select(*ex.GROUP, "item_id", "q", "visits", F.col("hybrid").alias("score"))
    write(s.final_lists(spark, sf), policy, path)
    return s.rounded(spark.read.parquet(f"{path}/lists").select(*ex.GROUP, "method", "rank", "item_id"))


@query(
    "repeated_grid", "M8 U3",
    f"SELECT {G}, lambda_q, count(*) AS n FROM scored CROSS JOIN {LAMBDAS} GROUP BY run, profile_idx, lambda_q", "scored",
)
def repeated_grid(spark, sf):
    grid = utility.with_grid(s.scored(spark, sf), "lambda_q", pf.LAMBDA_GRID)
    return s.rounded(grid.groupBy(*ex.GROUP, "lambda_q").agg(F.count("*").alias("n")))


@query(
    "hybrid_lists", "D3 T1",
    f"SELECT {G}, rank, item_id FROM final_lists WHERE method = 'hybrid'", "final_lists",
)
def hybrid_lists(spark, sf):
    return s.rounded(top_k(s.learned(spark, sf), "hybrid", pf.TOP_K, ex.GROUP).select(*ex.GROUP, "rank", "item_id"))
