"""Queries over the feedback log: rewards, values, snapshots, drift."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from rankforge.functions import profiles as pf
from rankforge.functions.scalars import dot
from rankforge.operators import drift, explaining
from rankforge.operators import feedback as fb
from rankforge.operators import interactions as ix
from rankforge.operators import utility
from rankforge.operators.grid_targets import best_targets
from rankforge.operators.mcdm import CRITERIA
from rankforge.operators.ranking import from_cut, top_k, with_cuts
from rankforge.session import materialize, shared_dir
from rankforge.streaming.ordered import ordered_values, start
from rankforge.streaming.values import streaming_values
from rankforge.workload import shapes as s
from rankforge.workload import views as v
from rankforge.workload.catalog_queries import contexts
from rankforge.workload.registry import cte, query, shared

def nudged(df):
    """Folded values have few decimals and often end in a 5 where they are rounded;
    a shift far above float noise makes both engines round them alike."""
    return s.rounded(df.withColumn("q", F.col("q") + 1e-12), 9)


# Truth among items that ever got feedback, one list per state (= profile).
cte("visited_items", "SELECT DISTINCT item_id FROM feedback", "feedback")
cte(
    "state_truth",
    s.top_sql("(SELECT * FROM item_profiles WHERE item_id IN (SELECT item_id FROM visited_items))", "target", 7, "profile_idx", "profile_idx AS state, rank, item_id"),
    "item_profiles", "visited_items",
)


@shared
def state_truth(spark, sf):
    seen = v.feedback(spark, sf).select("item_id").distinct()
    inside = s.item_profiles(spark, sf).join(seen, "item_id", "left_semi")
    return top_k(inside, "target", pf.TOP_K, ["profile_idx"]).select(F.col("profile_idx").alias("state"), "rank", "item_id")


@query(
    "rewards", "L1",
    f"SELECT event_id, f.state::BIGINT AS state, f.item_id, round({s.REWARD} + CASE WHEN t.item_id IS NOT NULL THEN 0.2 ELSE 0 END, 6) AS reward FROM feedback f LEFT JOIN state_truth t ON t.state = f.state AND t.item_id = f.item_id",
    "feedback state_truth",
)
def rewards(spark, sf):
    out = fb.rewards(v.feedback(spark, sf), state_truth(spark, sf), 0.2)
    return s.rounded(out.select("event_id", "state", "item_id", "reward"))


@query("q_values", "L2 L3", "SELECT state::BIGINT AS state, item_id, round(q + 1e-12, 9) AS q, visits FROM q_final", "q_final")
def q_values(spark, sf):
    log = fb.rewards(v.feedback(spark, sf))
    return nudged(fb.q_values(log).select("state", "item_id", "q", "visits"))


@query("visits", "L3", "SELECT state::BIGINT AS state, item_id, count(*) AS visits FROM feedback GROUP BY state, item_id", "feedback")
def visits(spark, sf):
    return s.rounded(fb.visits(v.feedback(spark, sf)))


@query(
    "constant_reward_values", "L4",
    "SELECT q.state::BIGINT AS state, q.item_id, round(hidden * (1 - pow(0.95::DOUBLE, visits)), 6) AS q FROM q_final q JOIN item_profiles p ON p.profile_idx = q.state AND p.item_id = q.item_id",
    "q_final item_profiles",
)
def constant_reward_values(spark, sf):
    counts = fb.visits(v.feedback(spark, sf))
    utilities = s.item_profiles(spark, sf).select(F.col("profile_idx").alias("state"), "item_id", "hidden")
    joined = counts.join(utilities, ["state", "item_id"])
    return s.rounded(joined.select("state", "item_id", fb.constant_reward_value(F.col("hidden"), F.col("visits")).alias("q")))


@query(
    "exploration_schedule", "L5",
    "SELECT event_id, round(greatest(0.05, 0.3 * pow(0.9997::DOUBLE, event_no)), 6) AS eps, round(greatest(0.05, 0.3 * pow(0.998::DOUBLE, event_no)), 6) AS eps_external FROM feedback",
    "feedback",
)
def exploration_schedule(spark, sf):
    n = F.col("event_no")
    return s.rounded(
        v.feedback(spark, sf).select(
            "event_id", fb.exploration_rate(n).alias("eps"), fb.exploration_rate(n, decay=pf.EPS_DECAY_EXTERNAL).alias("eps_external")
        )
    )


@query(
    "greedy_actions", "L6",
    "SELECT state::BIGINT AS state, item_id, round(q, 6) AS q FROM (" + s.top_sql(
        "(SELECT s.state, i.item_id, coalesce(q.q, 0) AS q FROM items i CROSS JOIN (SELECT DISTINCT state FROM feedback) s LEFT JOIN q_final q ON q.state = s.state AND q.item_id = i.item_id)",
        "q", 1, "state",
    ) + ")",
    "items feedback q_final",
)
def greedy_actions(spark, sf):
    states = v.feedback(spark, sf).select("state").distinct()
    pool = utility.with_each(v.items(spark, sf).select("item_id"), states)
    return s.rounded(fb.greedy_action(pool, s.values(spark, sf)).select("state", "item_id", "q"))


@query(
    "value_snapshots", "L7 J9",
    "SELECT state::BIGINT AS state, item_id, checkpoint, round(q + 1e-12, 9) AS q, visits FROM q_marks", "q_marks",
)
def value_snapshots(spark, sf):
    return nudged(fb.snapshots(fb.rewards(v.feedback(spark, sf)), s.CHECKPOINTS).select("state", "item_id", "checkpoint", "q", "visits"))


@query(
    "value_snapshots_by_time", "L7",
    """SELECT state::BIGINT AS state, item_id, checkpoint, round(q + 1e-12, 9) AS q, visits FROM (
SELECT state, item_id, checkpoint, sum(0.05::DOUBLE * pow(0.95::DOUBLE, age) * reward) AS q, count(*) AS visits FROM (
SELECT r.*, checkpoint, row_number() OVER (PARTITION BY state, item_id, checkpoint ORDER BY ts DESC, event_id DESC) - 1 AS age
FROM rewarded r JOIN (SELECT unnest([1704412800, 1705276800, 1706745600])::BIGINT AS checkpoint) c ON epoch(ts) <= checkpoint) GROUP BY state, item_id, checkpoint)""",
    "rewarded",
)
def value_snapshots_by_time(spark, sf):
    log = fb.rewards(v.feedback(spark, sf))
    clock = log.withColumn("clock", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    out = fb.snapshots(clock, (1704412800, 1705276800, 1706745600), clock="clock", tie_break=["event_id"])
    return nudged(out.select("state", "item_id", "checkpoint", "q", "visits"))


cte(
    "bonus_values",
    """SELECT bonus, state, item_id, sum(0.05::DOUBLE * pow(0.95::DOUBLE, age) * (reward + CASE WHEN in_truth THEN bonus ELSE 0 END)) AS q FROM (
SELECT r.*, bonus, t.item_id IS NOT NULL AS in_truth, row_number() OVER (PARTITION BY bonus, r.state, r.item_id ORDER BY event_no DESC) - 1 AS age
FROM rewarded r CROSS JOIN (SELECT unnest([0.0::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE]) AS bonus) b LEFT JOIN state_truth t ON t.state = r.state AND t.item_id = r.item_id)
GROUP BY bonus, state, item_id""",
    "rewarded", "state_truth",
)
cte(
    "bonus_frame",
    f"""SELECT *, 0.5 * {s.mm('q', 'bonus, state')} + 0.5 * {s.mm('topsis', 'bonus, state')} AS hybrid FROM (
SELECT p.profile_idx AS state, p.item_id, p.topsis, b.bonus, coalesce(q.q, 0) AS q FROM item_profiles p CROSS JOIN (SELECT unnest([0.0::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE]) AS bonus) b
LEFT JOIN bonus_values q ON q.bonus = b.bonus AND q.state = p.profile_idx AND q.item_id = p.item_id)""",
    "item_profiles", "bonus_values",
)
cte(
    "bonus_lists",
    " UNION ALL ".join(
        s.top_sql("bonus_frame", c, 7, "bonus, state", f"bonus, state, '{m}' AS method, rank, item_id") for m, c in (("rl_only", "q"), ("hybrid", "hybrid"))
    ),
    "bonus_frame",
)
cte("bonus_report", s.metrics_sql("bonus_lists", "state_truth", "bonus, state, method", "state"), "bonus_lists", "state_truth")


@query(
    "bonus_sensitivity", "L8 L1 L2 D3 E1",
    """SELECT bonus, round(avg(f1) FILTER (method = 'hybrid'), 6) AS hybrid, round(avg(f1) FILTER (method = 'rl_only'), 6) AS rl_only,
  round(avg(f1) FILTER (method = 'hybrid') - avg(f1) FILTER (method = 'rl_only'), 6) AS delta FROM bonus_report GROUP BY bonus""",
    "bonus_report",
)
def bonus_sensitivity(spark, sf):
    from rankforge.operators import blending, metrics

    truth = state_truth(spark, sf)
    # Position and size of an event do not depend on the bonus: fold the two parts
    # of the reward once, then combine them per bonus.
    log = fb.rewards(v.feedback(spark, sf), truth, 1.0)
    base = fb.rewards(v.feedback(spark, sf))
    marked = log.join(base.select("event_id", F.col("reward").alias("plain")), "event_id")
    parts = fb.q_values(marked.withColumn("reward", F.col("plain")), order=["event_no"]).join(
        fb.q_values(marked.withColumn("reward", F.col("reward") - F.col("plain")), order=["event_no"]).select(
            "state", "item_id", F.col("q").alias("per_bonus")
        ),
        ["state", "item_id"],
    )
    values = utility.with_grid(materialize(parts), "bonus", pf.BONUS_GRID).select(
        "bonus", "state", "item_id", (F.col("q") + F.col("bonus") * F.col("per_bonus")).alias("q")
    )
    frame = utility.with_grid(
        s.item_profiles(spark, sf).select(F.col("profile_idx").alias("state"), "item_id", "topsis"), "bonus", pf.BONUS_GRID
    ).join(values, ["bonus", "state", "item_id"], "left")
    scored = blending.hybrid(frame, ["bonus", "state"])
    lists = None
    for name, score in (("rl_only", "q"), ("hybrid", "hybrid")):
        part = top_k(scored, score, pf.TOP_K, ["bonus", "state"]).select("bonus", "state", F.lit(name).alias("method"), "rank", "item_id")
        lists = part if lists is None else lists.unionByName(part)
    f1 = metrics.list_metrics(lists, truth, ["bonus", "state", "method"], ["state"])
    wide = f1.groupBy("bonus").pivot("method", ["hybrid", "rl_only"]).agg(F.avg("f1"))
    return s.rounded(wide.withColumn("delta", F.col("hybrid") - F.col("rl_only")))


@query("contextual_ridge", "L9 P17")
def contextual_ridge(spark, sf):
    """Scores and upper bounds of every item per state."""
    x, size = contexts(v.items(spark, sf))
    models = fb.contextual_ridge(fb.rewards(v.feedback(spark, sf)), x, size)
    return fb.contextual_scores(x, models, size)


@query(
    "contextual_ridge_equations", "L9",
    """SELECT state::BIGINT AS state, d AS place, round(sum(reward * x[d + 1]) + 1e-8, 5) AS moment
FROM (SELECT state, reward, x, unnest(range(len(x))) AS d FROM rewarded JOIN contexts USING (item_id)) GROUP BY state, d""",
    "rewarded contexts",
)
def contextual_ridge_equations(spark, sf):
    """theta + sum of x (x . theta) over all events, per state and place: what a solution of the
    ridge equations makes of the moments of the rewards, which the SQL sums. Moments that end in
    a 5 are shifted by far more than float noise, so both engines round them alike."""
    x, size = contexts(v.items(spark, sf))
    log = fb.rewards(v.feedback(spark, sf))
    models = materialize(fb.contextual_ridge(log, x, size)).select("state", "theta")
    visits = log.groupBy("state", "item_id").agg(F.count("*").alias("n"))
    # One row per state.
    told = visits.join(x, "item_id").join(models, "state").withColumn("told", F.col("n") * dot("x", "theta"))
    sums = told.select("state", "told", F.posexplode("x").alias("place", "v")).groupBy("state", "place").agg(F.sum(F.col("told") * F.col("v")).alias("a"))
    own = models.select("state", F.posexplode("theta").alias("place", "t"))
    return sums.join(own, ["state", "place"]).select(F.col("state").cast("long"), F.col("place").cast("long"), F.round(F.col("a") + F.col("t") + 1e-8, 5).alias("moment"))


cte(
    "flipped",
    """SELECT user_id, cat_leaf, CASE WHEN cat_leaf = lo_k THEN hi_w WHEN cat_leaf = hi_k THEN lo_w ELSE share END AS share FROM leaf_shares JOIN (
SELECT user_id, arg_min(cat_leaf, ROW(share, cat_leaf)) AS lo_k, min(share) AS lo_w, arg_max(cat_leaf, ROW(share, cat_leaf)) AS hi_k, max(share) AS hi_w
FROM leaf_shares GROUP BY user_id) USING (user_id)""",
    "leaf_shares",
)


def leaf_shares(spark, sf):
    return ix.category_shares(v.train_items(spark, sf), "cat_leaf")


@query("flip_preferences", "L10", "SELECT user_id, cat_leaf, round(share, 6) AS share FROM flipped", "flipped")
def flip_preferences(spark, sf):
    return s.rounded(drift.flip_extremes(leaf_shares(spark, sf), ["user_id"], "cat_leaf", "share").select("user_id", "cat_leaf", "share"))


@query(
    "shifted_taste", "L11 L10",
    """SELECT user_id, round(greatest(10, c2 - h), 6) AS price_lo, round(least(1000, c2 + h), 6) AS price_hi, round(least(greatest(1 - recency_pref, 0.1), 0.9), 6) AS recency_pref FROM (
SELECT user_id, recency_pref, (hi - lo) / 2 AS h, CASE WHEN (lo + hi) / 2 < 950 THEN (lo + hi) / 2 + 25 ELSE (lo + hi) / 2 - 25 END AS c2 FROM (
SELECT user_id, min(price) AS lo, max(price) AS hi, avg(recency_pct) AS recency_pref FROM train_items GROUP BY user_id))""",
    "train_items",
)
def shifted_taste(spark, sf):
    ranges = v.train_items(spark, sf).groupBy("user_id").agg(
        F.min("price").alias("lo"), F.max("price").alias("hi"), F.avg("recency_pct").alias("recency_pref")
    )
    lo, hi = drift.shifted_range(F.col("lo"), F.col("hi"), pivot=950.0, move=25.0)
    return s.rounded(ranges.select("user_id", lo.alias("price_lo"), hi.alias("price_hi"), drift.shifted_recency(F.col("recency_pref")).alias("recency_pref")))


@query(
    "interpolated_preferences", "L12",
    """SELECT user_id, cat_leaf, frac, round((1 - frac) * coalesce(a.share, 0) + frac * coalesce(b.share, 0), 6) AS share
FROM (SELECT * FROM leaf_shares WHERE share > 0.1) a FULL JOIN flipped b USING (user_id, cat_leaf) CROSS JOIN (SELECT unnest([0.0::DOUBLE, 0.3::DOUBLE, 1.0::DOUBLE]) AS frac) f""",
    "leaf_shares flipped",
)
def interpolated_preferences(spark, sf):
    pre = leaf_shares(spark, sf)
    post = drift.flip_extremes(pre, ["user_id"], "cat_leaf", "share")
    return s.rounded(drift.interpolate(pre.filter("share > 0.1"), post, ["user_id"], "cat_leaf", "share", [0.0, 0.3, 1.0]))


PHASE_SQL = """(CASE WHEN event_no <= 200 THEN 0 WHEN event_no >= 900 THEN 1 ELSE (event_no - 200) / 700.0::DOUBLE END)"""


@query(
    "drift_phases", "L13",
    f"SELECT event_id, round({PHASE_SQL}, 6) AS fraction, round_even({PHASE_SQL} * 40, 0)::BIGINT AS phase FROM feedback", "feedback",
)
def drift_phases(spark, sf):
    n = F.col("event_no")
    return s.rounded(
        v.feedback(spark, sf).select(
            "event_id", drift.drift_fraction(n, 200, 900).alias("fraction"), drift.drift_phase(n, 200, 900).alias("phase")
        )
    )


# Drift: from event 501 on, the truth of a state is the one of the next state.
cte(
    "truth_versions",
    "SELECT state, 0::BIGINT AS phase_start, item_id FROM state_truth UNION ALL SELECT (state + 4) % 5 AS state, 501::BIGINT AS phase_start, item_id FROM state_truth",
    "state_truth",
)
cte("state_marks", "SELECT DISTINCT state, checkpoint FROM feedback CROSS JOIN marks", "feedback", "marks")
cte(
    "active_truth",
    """SELECT m.state, m.checkpoint, t.item_id FROM (SELECT m.state, checkpoint, max(phase_start) AS phase_start FROM state_marks m JOIN truth_versions t ON t.state = m.state AND phase_start <= checkpoint GROUP BY m.state, checkpoint) m
JOIN truth_versions t ON t.state = m.state AND t.phase_start = m.phase_start""",
    "state_marks", "truth_versions",
)


def truth_versions(spark, sf):
    now = state_truth(spark, sf)
    first = now.select("state", F.lit(0).cast("long").alias("phase_start"), "item_id")
    later = now.select(((F.col("state") + 4) % 5).alias("state"), F.lit(501).cast("long").alias("phase_start"), "item_id")
    return first.unionByName(later)


def state_marks(spark, sf):
    return utility.with_grid(v.feedback(spark, sf).select("state").distinct(), "checkpoint", s.CHECKPOINTS).withColumn(
        "checkpoint", F.col("checkpoint").cast("long")
    )


@query("truth_at_checkpoint", "J10", "SELECT state::BIGINT AS state, checkpoint, item_id FROM active_truth", "active_truth")
def truth_at_checkpoint(spark, sf):
    return s.rounded(drift.truth_at(state_marks(spark, sf), truth_versions(spark, sf), ["state"]))


cte(
    "drift_frame",
    f"""SELECT *, 0.5 * {s.mm('q', 'checkpoint, state')} + 0.5 * {s.mm('topsis', 'checkpoint, state')} AS hybrid FROM (
SELECT p.profile_idx AS state, p.item_id, p.topsis, m.checkpoint, coalesce(q.q, 0) AS q FROM item_profiles p CROSS JOIN marks m
LEFT JOIN q_marks q ON q.checkpoint = m.checkpoint AND q.state = p.profile_idx AND q.item_id = p.item_id)""",
    "item_profiles", "marks", "q_marks",
)
cte(
    "drift_lists",
    " UNION ALL ".join(
        s.top_sql("drift_frame", c, 7, "state, checkpoint", f"state, checkpoint, '{m}' AS method, rank, item_id")
        for m, c in (("topsis_only", "topsis"), ("rl_only", "q"), ("hybrid", "hybrid"))
    ),
    "drift_frame",
)
cte("drift_report", s.metrics_sql("drift_lists", "active_truth", "state, checkpoint, method", "state, checkpoint"), "drift_lists", "active_truth")


@shared
def drift_report(spark, sf):
    from rankforge.operators import blending, metrics

    frame = utility.with_grid(
        s.item_profiles(spark, sf).select(F.col("profile_idx").alias("state"), "item_id", "topsis"), "checkpoint", s.CHECKPOINTS
    ).withColumn("checkpoint", F.col("checkpoint").cast("long"))
    joined = frame.join(s.snapshots(spark, sf), ["state", "item_id", "checkpoint"], "left")
    scored = materialize(blending.hybrid(joined, ["state", "checkpoint"]).select("state", "checkpoint", "item_id", "topsis", "q", "hybrid"))
    cut = with_cuts(scored, ("topsis", "q", "hybrid"), pf.TOP_K, ["state", "checkpoint"])
    lists = None
    for name, score in (("topsis_only", "topsis"), ("rl_only", "q"), ("hybrid", "hybrid")):
        part = top_k(from_cut(cut, score), score, pf.TOP_K, ["state", "checkpoint"]).select("state", "checkpoint", F.lit(name).alias("method"), "rank", "item_id")
        lists = part if lists is None else lists.unionByName(part)
    active = drift.truth_at(state_marks(spark, sf), truth_versions(spark, sf), ["state"])
    return metrics.list_metrics(lists, active, ["state", "checkpoint", "method"], ["state", "checkpoint"])


@query(
    "drift_curve", "L14 L7 J10 E1 A5",
    "SELECT method, checkpoint, round(avg(f1), 6) AS mean_f1, round(stddev_pop(f1), 6) AS std_f1 FROM drift_report GROUP BY method, checkpoint", "drift_report",
)
def drift_curve(spark, sf):
    out = drift_report(spark, sf).groupBy("method", "checkpoint").agg(F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("std_f1"))
    return s.rounded(out)


# Gradual drift: profiles move to their shifted form in 40 phases.
GRADUAL = (200, 900)
GRADUAL_MARKS = (100, 250, 400, 550, 700, 850, 1000)
SHIFT = {"pivot": 950.0, "move": 25.0}
_STARTS = drift.phase_starts(*GRADUAL)


def profile_table(spark):
    columns = [F.col("p")[f].alias(f) for f in utility.PROFILE_FIELDS]
    return spark.range(1).select(F.explode(pf.profile_array(v.FIXTURE_PROFILES)).alias("p")).select(*columns)


def _shifted_sql(source: str, key: str) -> str:
    return f"""SELECT profile_idx, {key}, CASE WHEN {key} = lo_k THEN hi_w WHEN {key} = hi_k THEN lo_w ELSE w END AS w FROM {source} JOIN (
SELECT profile_idx, arg_min({key}, ROW(w, {key})) AS lo_k, min(w) AS lo_w, arg_max({key}, ROW(w, {key})) AS hi_k, max(w) AS hi_w FROM {source} GROUP BY profile_idx) USING (profile_idx)"""


cte("shifted_brand", _shifted_sql("profile_brand", "brand"), "profile_brand")
cte("shifted_cat", _shifted_sql("profile_cat", "category"), "profile_cat")
cte(
    "shifted_profiles",
    """SELECT profile_idx, profile, greatest(10, c2 - h) AS price_lo, least(1000, c2 + h) AS price_hi, least(greatest(1 - recency_weight, 0.1), 0.9) AS recency_weight FROM (
SELECT *, (price_hi - price_lo) / 2 AS h, CASE WHEN (price_lo + price_hi) / 2 < 950 THEN (price_lo + price_hi) / 2 + 25 ELSE (price_lo + price_hi) / 2 - 25 END AS c2 FROM profiles)""",
    "profiles",
)


@query(
    "shifted_profile", "L11 L10",
    """SELECT profile_idx::BIGINT AS profile_idx, profile, kind, key, round(w, 6) AS weight, round(price_lo, 6) AS price_lo, round(price_hi, 6) AS price_hi, round(recency_weight, 6) AS recency_weight FROM shifted_profiles
JOIN (SELECT profile_idx, 'brand' AS kind, brand AS key, w FROM shifted_brand UNION ALL SELECT profile_idx, 'category', category, w FROM shifted_cat) USING (profile_idx)""",
    "shifted_profiles shifted_brand shifted_cat",
)
def shifted_profile(spark, sf):
    """All shifts of a profile in one table, a row per preference."""
    post = drift.shifted_profile(profile_table(spark), **SHIFT)
    rows = drift.preferences(post).join(post.select("profile_idx", "profile", "price_lo", "price_hi", "recency_weight"), "profile_idx")
    return s.rounded(rows)


cte("phases", f"SELECT range::INT AS phase, range / 40.0::DOUBLE AS frac, [{', '.join(map(str, _STARTS))}][range + 1]::BIGINT AS phase_start FROM range(41)")
cte(
    "phase_scored",
    f"""SELECT *, {s.mm('0.5 * observable + 0.5 * hidden', 'profile_idx, phase')} AS target FROM (
SELECT *, {s.mm('0.45 * brand_score + 0.30 * price_fit + 0.15 * cat_score + 0.10 * recency_score', 'profile_idx, phase')} AS hidden FROM (
SELECT *, cat / max(cat) OVER (PARTITION BY profile_idx, phase) AS cat_score FROM (
SELECT i.item_id, i.observable, p.profile_idx, f.phase, f.phase_start,
  coalesce((1 - frac) * b0.w + frac * b1.w, 0.1::DOUBLE) AS brand_score, coalesce((1 - frac) * c0.w + frac * c1.w, 0.05::DOUBLE) AS cat,
  least(greatest(1 - abs(price - (lo + hi) / 2) / ((hi - lo) / 2 + 1), 0), 1) AS price_fit, recency_pct * rw + (1 - rw) * 0.5 AS recency_score
FROM (SELECT *, {s.mm('(price_pct + quality_pct + popularity_pct + rating_pct) / 4')} AS observable FROM items) i CROSS JOIN phases f
CROSS JOIN (SELECT a.profile_idx, f.phase AS ph, (1 - frac) * a.price_lo + frac * z.price_lo AS lo, (1 - frac) * a.price_hi + frac * z.price_hi AS hi, (1 - frac) * a.recency_weight + frac * z.recency_weight AS rw
  FROM profiles a JOIN shifted_profiles z USING (profile_idx) CROSS JOIN phases f) p
LEFT JOIN profile_brand b0 ON b0.profile_idx = p.profile_idx AND b0.brand = i.brand LEFT JOIN shifted_brand b1 ON b1.profile_idx = p.profile_idx AND b1.brand = i.brand
LEFT JOIN profile_cat c0 ON c0.profile_idx = p.profile_idx AND c0.category = i.category LEFT JOIN shifted_cat c1 ON c1.profile_idx = p.profile_idx AND c1.category = i.category
WHERE p.ph = f.phase)))""",
    "items", "phases", "profiles", "shifted_profiles", "profile_brand", "shifted_brand", "profile_cat", "shifted_cat",
)
cte("phase_truth", s.top_sql("phase_scored", "target", 7, "profile_idx, phase", "profile_idx AS state, phase, phase_start, item_id"), "phase_scored")


@shared
def phase_truth(spark, sf):
    """The best seven items of every profile in every phase of the drift."""
    pre = profile_table(spark)
    phases = drift.profile_phases(pre, drift.shifted_profile(pre, **SHIFT))
    items = utility.observable_utility(v.items(spark, sf)).select("item_id", "brand", "category", "price", "recency_pct", "observable")
    best = best_targets(items, phases, ["profile_idx", "phase"], pf.TOP_K)  # five profiles in 41 phases
    start = F.element_at(F.array(*[F.lit(int(n)).cast("long") for n in _STARTS]), F.col("phase") + 1)
    return best.select(F.col("profile_idx").alias("state"), "phase", start.alias("phase_start"), "item_id")


@query("drifting_truth", "L12 L13 U1", "SELECT state::BIGINT AS state, phase::BIGINT AS phase, phase_start, item_id FROM phase_truth", "phase_truth")
def drifting_truth(spark, sf):
    return s.rounded(phase_truth(spark, sf))


_GRADUAL_MARKS = ", ".join(f"({n})" for n in GRADUAL_MARKS)
cte("gradual_marks", f"SELECT checkpoint::BIGINT AS checkpoint FROM (VALUES {_GRADUAL_MARKS}) t(checkpoint)")
cte(
    "q_gradual",
    """SELECT state, item_id, checkpoint, sum(0.05::DOUBLE * pow(0.95::DOUBLE, age) * reward) AS q FROM (
SELECT r.*, checkpoint, row_number() OVER (PARTITION BY state, item_id, checkpoint ORDER BY event_no DESC) - 1 AS age
FROM rewarded r JOIN gradual_marks ON event_no <= checkpoint) GROUP BY state, item_id, checkpoint""",
    "rewarded", "gradual_marks",
)
cte(
    "gradual_frame",
    f"""SELECT *, 0.5 * {s.mm('q', 'checkpoint, state')} + 0.5 * {s.mm('topsis', 'checkpoint, state')} AS hybrid FROM (
SELECT p.profile_idx AS state, p.item_id, p.topsis, m.checkpoint, coalesce(q.q, 0) AS q FROM item_profiles p CROSS JOIN gradual_marks m
LEFT JOIN q_gradual q ON q.checkpoint = m.checkpoint AND q.state = p.profile_idx AND q.item_id = p.item_id)""",
    "item_profiles", "gradual_marks", "q_gradual",
)
cte(
    "gradual_lists",
    " UNION ALL ".join(
        s.top_sql("gradual_frame", c, 7, "state, checkpoint", f"state, checkpoint, '{m}' AS method, rank, item_id")
        for m, c in (("topsis_only", "topsis"), ("rl_only", "q"), ("hybrid", "hybrid"))
    ),
    "gradual_frame",
)
cte(
    "gradual_truth",
    """SELECT state, m.checkpoint, t.item_id FROM (SELECT state, checkpoint, max(phase_start) AS phase_start FROM (SELECT DISTINCT state, phase_start FROM phase_truth) JOIN gradual_marks ON phase_start <= checkpoint GROUP BY state, checkpoint) m
JOIN phase_truth t USING (state, phase_start)""",
    "phase_truth", "gradual_marks",
)
cte("gradual_report", s.metrics_sql("gradual_lists", "gradual_truth", "state, checkpoint, method", "state, checkpoint"), "gradual_lists", "gradual_truth")


@query(
    "drift_curve_gradual", "L14 L11 L12 L13 J10",
    "SELECT method, checkpoint, round(avg(f1), 6) AS mean_f1, round(stddev_pop(f1), 6) AS std_f1 FROM gradual_report GROUP BY method, checkpoint", "gradual_report",
)
def drift_curve_gradual(spark, sf):
    from rankforge.operators import blending, metrics

    marks = utility.with_grid(s.item_profiles(spark, sf).select(F.col("profile_idx").alias("state"), "item_id", "topsis"), "checkpoint", GRADUAL_MARKS)
    values = fb.snapshots(fb.rewards(v.feedback(spark, sf)), GRADUAL_MARKS)
    joined = marks.withColumn("checkpoint", F.col("checkpoint").cast("long")).join(values, ["state", "item_id", "checkpoint"], "left")
    scored = materialize(blending.hybrid(joined, ["state", "checkpoint"]).select("state", "checkpoint", "item_id", "topsis", "q", "hybrid"))
    cut = with_cuts(scored, ("topsis", "q", "hybrid"), pf.TOP_K, ["state", "checkpoint"])
    lists = None
    for name, score in (("topsis_only", "topsis"), ("rl_only", "q"), ("hybrid", "hybrid")):
        part = top_k(from_cut(cut, score), score, pf.TOP_K, ["state", "checkpoint"]).select("state", "checkpoint", F.lit(name).alias("method"), "rank", "item_id")
        lists = part if lists is None else lists.unionByName(part)
    active = drift.truth_at(scored.select("state", "checkpoint").distinct(), phase_truth(spark, sf).select("state", "phase_start", "item_id"), ["state"])
    report = metrics.list_metrics(lists, active, ["state", "checkpoint", "method"], ["state", "checkpoint"])
    return s.rounded(report.groupBy("method", "checkpoint").agg(F.avg("f1").alias("mean_f1"), F.stddev_pop("f1").alias("std_f1")))


@query(
    "streaming_values", "L15",
    "SELECT state::BIGINT AS state, item_id, round(q + 1e-12, 9) AS q, visits FROM q_final", "q_final",
)
def streaming_values_query(spark, sf):
    """The stream of the whole log, applied until it is used up; its last state
    equals the batch fold."""
    schema = v.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    log = events.filter(F.col("event_type").isin("view", "click", "purchase")).select(
        (F.col("user_id") % 5).cast("int").alias("state"),
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        "ts", "event_id",
        F.col("event_type").isin("click", "purchase").alias("engaged"),
        (F.col("event_type") == "purchase").alias("converted"),
    )
    folder = tempfile.mktemp(prefix="stream-", dir="").lstrip("/")
    out = f"{shared_dir(spark).rstrip('/')}/{folder}"

    def save(batch, batch_id):
        # Overwriting the folder of its batch makes a repeated batch harmless.
        batch.write.mode("overwrite").parquet(f"{out}/updates/batch={batch_id}")

    q = (
        streaming_values(fb.rewards(log)).writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    updates = spark.read.parquet(f"{out}/updates")
    last = updates.groupBy("state", "item_id").agg(F.max_by(F.struct("q", "visits"), "batch").alias("_l"))
    return nudged(last.select("state", "item_id", "_l.q", "_l.visits"))


#: Parts of the log in the ordered stream; one event in three comes a part late.
PARTS = 4


@query(
    "streaming_values_out_of_order", "L15",
    "SELECT state::BIGINT AS state, item_id, round(q + 1e-12, 9) AS q, visits FROM q_final", "q_final",
)
def streaming_values_out_of_order(spark, sf):
    """The whole log in parts of equal spans of time, a third of the events one part late. The
    stream is restarted from its checkpoint for every part; its last report is the batch fold."""
    log = v.feedback(spark, sf).select("state", "item_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "engaged", "converted")
    lo, hi = log.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    if lo is None:
        return nudged(fb.q_values(fb.rewards(log)))
    width = (hi - lo) // PARTS + 1
    late = (F.pmod(F.xxhash64("event_id"), F.lit(3)) == 0).cast("long")
    parts = materialize(fb.rewards(log).withColumn("part", F.floor((F.unix_micros("ts") - lo) / width) + late), ("part",))
    out = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def save(batch, batch_id):
        # Overwriting the folder of its batch makes a repeated batch harmless.
        batch.write.mode("overwrite").parquet(f"{out}/updates/batch={batch_id}")

    for part in range(PARTS + 1):
        parts.filter(F.col("part") == part).drop("part").write.mode("append").parquet(f"{out}/in")
        stream = spark.readStream.schema(parts.drop("part").schema).parquet(f"{out}/in")
        values = ordered_values(stream, f"{2 * width // 1000} milliseconds")
        start(spark, (
            values.writeStream.outputMode("update").foreachBatch(save)
            .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
        )).awaitTermination()
    last = spark.read.parquet(f"{out}/updates").groupBy("state", "item_id").agg(F.max_by(F.struct("q", "visits"), F.struct("batch", "visits")).alias("_l"))
    return nudged(last.select("state", "item_id", "_l.q", "_l.visits"))


_WEIGHED = "[" + ", ".join(f"{c} * w_{c}" for c in CRITERIA) + "]"
_NAMES = "[" + ", ".join(f"'{explaining.CRITERION_LABELS[c]}'" for c in CRITERIA) + "]"
_SHOWN = "[brand_score, price_fit, 1.0::DOUBLE, recency_score]"


@query(
    "signal_explanations", "D8 P21 P22",
    f"""SELECT run::BIGINT AS run, profile_idx::BIGINT AS profile_idx, rank, item_id, round(c_t, 3) AS c_t, round(c_q, 3) AS c_q, CASE WHEN by_criteria THEN 'Observable' ELSE 'Behavioral' END AS dominant_signal,
  CASE WHEN by_criteria THEN {_NAMES}[list_position({_WEIGHED}, list_max({_WEIGHED}))] ELSE [brand, 'PriceRange', category, 'Recency'][list_position({_SHOWN}, list_max({_SHOWN}))] END AS dominant_label, in_truth FROM (
SELECT *, 0.5 * t_norm AS c_t, 0.5 * q_norm AS c_q, round(0.5 * t_norm, 9) >= round(0.5 * q_norm, 9) AS by_criteria FROM (
SELECT l.*, t.item_id IS NOT NULL AS in_truth, row_number() OVER (PARTITION BY l.run, l.profile_idx ORDER BY round(l.hybrid, 9) DESC, l.item_id) AS rank
FROM learned l LEFT JOIN truth t ON t.run = l.run AND t.profile_idx = l.profile_idx AND t.item_id = l.item_id)) WHERE rank <= 7""",
    "learned truth",
)
def signal_explanations(spark, sf):
    """Every run's lists with contributions, stronger signal and its label."""
    frame = utility.hidden_components(s.learned(spark, sf), ["run", "profile_idx"])
    return s.rounded(explaining.signal_explanations(frame, s.truth(spark, sf), ["run", "profile_idx"]))
