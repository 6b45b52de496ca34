"""Shared tables of the experiment and the SQL fragments that mirror them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.operators import feedback as fb
from rankforge.operators import mcdm, sampling, utility
from rankforge.operators.mcdm import CRITERIA
from rankforge.plans import experiment as ex
from rankforge.workload import views as v
from rankforge.workload.registry import cte, shared

N_RUNS = 5
SAMPLE = 400
CHECKPOINTS = (100, 300, 1000, 3000, 10000)


def r6(c: str | object, name: str | None = None):
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6).alias(name or c)


def long(c: str):
    return F.col(c).cast("long").alias(c)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double rounded and every int widened: the form in which results of two
    engines are compared."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            # Adding zero turns -0.0 into 0.0.
            c = F.round(c, digits) + F.lit(0.0)
        elif kind == "int":
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def half_up(c, digits: int = 6):
    """A double at ``digits`` decimals, halves away from zero. It is taken at 12 decimals
    first, so that the last bits of a half decide in no engine."""
    return F.round(c.cast("decimal(24,12)"), digits).cast("double")


def half_up_sql(c: str, digits: int = 6) -> str:
    return f"round(({c})::DECIMAL(24, 12), {digits})::DOUBLE"


@shared
def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_sample(v.items(spark, sf_dir), None, SAMPLE, N_RUNS)


@shared
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled items of every run next to every profile with all static scores."""
    return ex.scored_frame(samples(spark, sf_dir), v.FIXTURE_PROFILES)


@shared
def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.truth_lists(scored(spark, sf_dir))


@shared
def fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.fixed_lists(scored(spark, sf_dir))


@shared
def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fb.snapshots(fb.rewards(v.feedback(spark, sf_dir)), CHECKPOINTS)


@shared
def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fb.q_values(fb.rewards(v.feedback(spark, sf_dir)), order=["event_no"])


@shared
def learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with the final values."""
    return ex.learned_scores(scored(spark, sf_dir), values(spark, sf_dir), None)


@shared
def learned_by_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ex.learned_scores(scored(spark, sf_dir), snapshots(spark, sf_dir), CHECKPOINTS)


@shared
def final_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six methods' lists per (run, profile)."""
    return fixed(spark, sf_dir).unionByName(ex.learned_lists(learned(spark, sf_dir), ex.GROUP))


@shared
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 and NDCG per (run, profile, method, checkpoint)."""
    group = [*ex.GROUP, "checkpoint"]
    lists = ex.learned_lists(learned_by_checkpoint(spark, sf_dir), group)
    return ex.checkpoint_report(fixed(spark, sf_dir), lists, truth(spark, sf_dir), CHECKPOINTS)


@shared
def item_topsis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closeness over the whole catalog."""
    return mcdm.topsis(v.items(spark, sf_dir), keep_weights=True)


@shared
def item_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole catalog next to every profile with utilities and target."""
    frame = utility.with_profiles(utility.observable_utility(item_topsis(spark, sf_dir)), v.FIXTURE_PROFILES)
    return utility.blend_target(utility.hidden_utility(frame), noise_sd=0.0)


# SQL ---------------------------------------------------------------------------

def mm(e: str, part: str = "") -> str:
    p = f"PARTITION BY {part}" if part else ""
    lo, hi = f"min({e}) OVER ({p})", f"max({e}) OVER ({p})"
    return f"CASE WHEN {hi} <= {lo} THEN 0.5::DOUBLE ELSE (({e}) - {lo}) / ({hi} - {lo} + 1e-10) END"


def top_sql(source: str, score: str, k: int, by: str = "", cols: str = "*", rank: str = "rank", order: str | None = None) -> str:
    part = f"PARTITION BY {by} " if by else ""
    order = order or f"round({score}, 9) DESC, item_id"
    return f"SELECT {cols} FROM (SELECT *, row_number() OVER ({part}ORDER BY {order}) AS {rank} FROM {source}) WHERE {rank} <= {k}"


def totals_sql(source: str, by: str = "") -> str:
    """n, sums, squares, extremes and entropy sums of the clipped criteria."""
    group = f"GROUP BY {by}" if by else ""
    key = f"{by}, " if by else ""
    link = f"JOIN t1 USING ({by})" if by else "CROSS JOIN t1"
    first = ", ".join(
        f"sum(greatest({c}, 1e-10)) AS sum_{c}, sum(greatest({c}, 1e-10) * greatest({c}, 1e-10)) AS sq_{c}, "
        f"max(greatest({c}, 1e-10)) AS max_{c}, min(greatest({c}, 1e-10)) AS min_{c}" for c in CRITERIA
    )
    share = {c: f"least(greatest(greatest({c}, 1e-10) / sum_{c}, 1e-10), 1.0)" for c in CRITERIA}
    second = ", ".join(f"-sum({share[c]} * ln({share[c]})) AS ent_{c}" for c in CRITERIA)
    last = "t1 JOIN t2 USING (%s)" % by if by else "t1 CROSS JOIN t2"
    return (
        f"WITH t1 AS (SELECT {key}count(*) AS n, {first} FROM {source} {group}), "
        f"t2 AS (SELECT {key}{second} FROM {source} {link} {group}) SELECT * FROM {last}"
    )


def weights_sql(totals: str) -> str:
    d = {c: f"(1 - ent_{c} / ln(n))" for c in CRITERIA}
    dsum = " + ".join(d.values())
    raw = ", ".join(f"greatest(0.1 + {d[c]} / ({dsum}) * 0.6, 0.1) AS r_{c}" for c in CRITERIA)
    rsum = " + ".join(f"r_{c}" for c in CRITERIA)
    return f"SELECT *, " + ", ".join(f"r_{c} / ({rsum}) AS w_{c}" for c in CRITERIA) + f" FROM (SELECT *, {raw} FROM {totals})"


def topsis_sql(source: str, weights: str, by: str = "") -> str:
    link = f"JOIN {weights} USING ({by})" if by else f"CROSS JOIN {weights}"
    def dist(to: str) -> str:
        return "sqrt(" + " + ".join(
            f"pow((greatest({c}, 1e-10) - {to}_{c}) / sqrt(sq_{c}) * w_{c}, 2)" for c in CRITERIA
        ) + ")"
    ws = ", ".join(f"w_{c}" for c in CRITERIA)
    return (
        f"SELECT * EXCLUDE (dp, dm), dm / CASE WHEN dp + dm = 0 THEN 1e-10 ELSE dp + dm END AS topsis FROM "
        f"(SELECT s.*, {ws}, {dist('max')} AS dp, {dist('min')} AS dm FROM {source} s {link})"
    )


def profile_sql(source: str, by: str = "") -> str:
    """Components, hidden utility and noise-free target of source x profiles."""
    group = f"{by}, profile_idx" if by else "profile_idx"
    return f"""SELECT *, {mm('0.5 * observable + (1 - 0.5) * hidden', group)} AS target FROM (
SELECT *, {mm('0.45 * brand_score + 0.30 * price_fit + 0.15 * cat_score + 0.10 * recency_score', group)} AS hidden FROM (
SELECT *, cat / max(cat) OVER (PARTITION BY {group}) AS cat_score, {mm('(price_pct + quality_pct + popularity_pct + rating_pct) / 4', group)} AS observable FROM (
SELECT s.*, p.*,
  coalesce(pb.w, 0.1::DOUBLE) AS brand_score, coalesce(pc.w, 0.05::DOUBLE) AS cat,
  least(greatest(1 - abs(price - (price_lo + price_hi) / 2) / ((price_hi - price_lo) / 2 + 1), 0), 1) AS price_fit,
  recency_pct * recency_weight + (1 - recency_weight) * 0.5 AS recency_score
FROM {source} s CROSS JOIN profiles p
LEFT JOIN profile_brand pb ON pb.profile_idx = p.profile_idx AND pb.brand = s.brand
LEFT JOIN profile_cat pc ON pc.profile_idx = p.profile_idx AND pc.category = s.category)))"""


PROFILE_CTES = ("profiles", "profile_brand", "profile_cat")
cte("item_totals", totals_sql("items"), "items")
cte("item_weights", weights_sql("item_totals"), "item_totals")
cte("item_topsis", topsis_sql("items", "item_weights"), "items", "item_weights")
cte("item_profiles", profile_sql("item_topsis"), "item_topsis", *PROFILE_CTES)


def sample_sql(n: int, runs: int, shift: int = 0) -> str:
    pct = ", ".join(
        f"{v.pct_sql(c, 'run', c == 'price')} AS {c}_pct" for c in ("price", "quality", "popularity", "rating", "recency")
    )
    return f"""SELECT * REPLACE ({pct}) FROM (
SELECT * EXCLUDE (r, h, pick) FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY (r > {n // 8})::INTEGER, h, item_id) AS pick FROM (
SELECT *, row_number() OVER (PARTITION BY run, octant ORDER BY h, item_id) AS r FROM (
SELECT o.*, run, 17042 + 17 * run + {shift} AS seed, md5(concat_ws('|', 17042 + 17 * run + {shift}, item_id)) AS h
FROM octants o CROSS JOIN range({runs}) g(run)))) WHERE pick <= {n})"""


cte(
    "octants",
    """SELECT i.*, (price_pct >= mp)::INTEGER * 4 + (quality_pct >= mq)::INTEGER * 2 + (popularity_pct >= mo)::INTEGER AS octant
FROM items i CROSS JOIN (SELECT median(price_pct) AS mp, median(quality_pct) AS mq, median(popularity_pct) AS mo FROM items)""",
    "items",
)
cte("samples", sample_sql(SAMPLE, N_RUNS), "octants")
cte("run_totals", totals_sql("samples", "run"), "samples")
cte("run_weights", weights_sql("run_totals"), "run_totals")
cte("run_topsis", topsis_sql("samples", "run_weights", "run"), "samples", "run_weights")
cte("scored", profile_sql("run_topsis", "run"), "run_topsis", *PROFILE_CTES)
cte("truth", top_sql("scored", "target", 7, "run, profile_idx", "run, profile_idx, rank, item_id"), "scored")
cte(
    "fixed",
    " UNION ALL ".join(
        top_sql("scored", s, 7, "run, profile_idx", f"run, profile_idx, '{m}' AS method, rank, item_id", order=o)
        for m, s, o in (
            ("random", "", "md5(concat_ws('|', 'random', run, profile_idx, item_id)), item_id"),
            ("popularity", "popularity_pct", None),
            ("topsis_only", "topsis", None),
        )
    ),
    "scored",
)
REWARD = "(-0.02::DOUBLE + CASE WHEN engaged THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN engaged AND converted THEN 1.0::DOUBLE ELSE 0 END)"
cte("rewarded", f"SELECT *, {REWARD} AS reward FROM feedback", "feedback")
cte(
    "q_final",
    """SELECT state, item_id, sum(0.05::DOUBLE * pow(0.95::DOUBLE, age) * reward) AS q, count(*) AS visits FROM (
SELECT *, row_number() OVER (PARTITION BY state, item_id ORDER BY event_no DESC) - 1 AS age FROM rewarded) GROUP BY state, item_id""",
    "rewarded",
)
MARKS = ", ".join(f"({c})" for c in CHECKPOINTS)
cte("marks", f"SELECT checkpoint::BIGINT AS checkpoint FROM (VALUES {MARKS}) t(checkpoint)")
cte(
    "q_marks",
    """SELECT state, item_id, checkpoint, sum(0.05::DOUBLE * pow(0.95::DOUBLE, age) * reward) AS q, count(*) AS visits FROM (
SELECT r.*, checkpoint, row_number() OVER (PARTITION BY state, item_id, checkpoint ORDER BY event_no DESC) - 1 AS age
FROM rewarded r JOIN marks ON event_no <= checkpoint) GROUP BY state, item_id, checkpoint""",
    "rewarded", "marks",
)


def learned_sql(extra: str) -> str:
    """extra: '' or ', checkpoint'."""
    grid = " CROSS JOIN marks" if extra else ""
    source = "q_marks" if extra else "q_final"
    on = " AND q.checkpoint = f.checkpoint" if extra else ""
    g = f"run, profile_idx{extra}"
    return f"""SELECT *, 0.5 * q_norm + 0.5 * t_norm AS hybrid, lambda_q * q_norm + (1 - lambda_q) * t_norm AS gated FROM (
SELECT *, {mm('q', g)} AS q_norm, {mm('topsis', g)} AS t_norm, 0.5 * (1 - exp(-visits / 300.0::DOUBLE)) AS lambda_q FROM (
SELECT f.*, coalesce(q.q, 0) AS q, coalesce(q.visits, 0) AS visits FROM (SELECT * FROM scored{grid}) f
LEFT JOIN {source} q ON q.state = f.profile_idx AND q.item_id = f.item_id{on}))"""


cte("learned", learned_sql(""), "scored", "q_final")
cte("learned_marks", learned_sql(", checkpoint"), "scored", "q_marks", "marks")


def learned_lists_sql(source: str, extra: str) -> str:
    return " UNION ALL ".join(
        top_sql(source, s, 7, f"run, profile_idx{extra}", f"run, profile_idx{extra}, '{m}' AS method, rank, item_id")
        for m, s in (("rl_only", "q"), ("hybrid", "hybrid"), ("gated", "gated"))
    )


cte("final_lists", "SELECT * FROM fixed UNION ALL " + learned_lists_sql("learned", ""), "fixed", "learned")
cte("mark_lists", learned_lists_sql("learned_marks", ", checkpoint"), "learned_marks")


def metrics_sql(lists: str, truth_name: str, by: str, truth_by: str, k: int = 7) -> str:
    """n_pred, n_truth, tp, f1, ndcg per list."""
    link = " AND ".join(f"t.{c.strip()} = l.{c.strip()}" for c in truth_by.split(",")) if truth_by else "TRUE"
    sizes = f"SELECT {truth_by}, count(*) AS n_truth FROM {truth_name} GROUP BY {truth_by}" if truth_by else f"SELECT count(*) AS n_truth FROM {truth_name}"
    join = f"LEFT JOIN sz USING ({truth_by})" if truth_by else "CROSS JOIN sz"
    ideal = f"(SELECT sum(1 / log2(i + 1.0::DOUBLE)) FROM range(1, {k} + 1) r(i) WHERE i <= coalesce(n_truth, 0))"
    return f"""WITH sz AS ({sizes}), pl AS (SELECT {", ".join("l." + c.strip() for c in by.split(","))}, count(*) AS n_pred, count(t.item_id) AS tp,
  sum(CASE WHEN t.item_id IS NOT NULL THEN 1 / log2(l.rank + 1.0::DOUBLE) ELSE 0 END) AS dcg
FROM {lists} l LEFT JOIN {truth_name} t ON {link} AND t.item_id = l.item_id GROUP BY {", ".join("l." + c.strip() for c in by.split(","))})
SELECT {by}, n_pred, coalesce(n_truth, 0) AS n_truth, tp::BIGINT AS tp,
  CASE WHEN coalesce(n_truth, 0) = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (n_pred + n_truth) END AS f1,
  CASE WHEN coalesce(n_truth, 0) = 0 THEN 0 ELSE dcg / {ideal} END AS ndcg FROM pl {join}"""


cte(
    "all_mark_lists",
    "SELECT run, profile_idx, method, checkpoint, rank, item_id FROM mark_lists UNION ALL SELECT run, profile_idx, method, checkpoint, rank, item_id FROM fixed CROSS JOIN marks",
    "mark_lists", "fixed", "marks",
)
cte("report", metrics_sql("all_mark_lists", "truth", "run, profile_idx, method, checkpoint", "run, profile_idx"), "all_mark_lists", "truth")
