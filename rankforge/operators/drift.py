"""Preference changes over time, on long preference tables (owner, key, weight)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.functions.scalars import clip
from rankforge.operators.ordering import running_totals
from rankforge.session import materialize

# Episodes of the gradual drift and the number of phases, the
# sudden drift, and the moves of a shifted profile.
DRIFT_START, DRIFT_END, PHASES = 10_000, 25_000, 40
SUDDEN_DRIFT = 15_000
CENTER_PIVOT, CENTER_MOVE, PRICE_FLOOR, PRICE_CEILING = 350.0, 250.0, 10.0, 1000.0
RECENCY_FLOOR, RECENCY_CEILING = 0.10, 0.90


def flip_extremes(prefs: DataFrame, owner: Sequence[str], key: str, weight: str) -> DataFrame:
    """Swap the weights of each owner's lowest and highest key (first key wins
    ties); other keys keep theirs."""
    w = F.col(weight)
    ends = prefs.groupBy(*owner).agg(
        F.min(F.struct(w, F.col(key))).alias("_lo"),
        F.max_by(F.struct(w, F.col(key)), F.struct(w, F.col(key))).alias("_hi"),
    )
    k = F.col(key)
    swapped = F.when(k == F.col(f"_lo.{key}"), F.col(f"_hi.{weight}")).when(
        k == F.col(f"_hi.{key}"), F.col(f"_lo.{weight}")
    ).otherwise(w)
    return prefs.join(ends, list(owner)).withColumn(weight, swapped).drop("_lo", "_hi")


def shifted_range(lo: Column, hi: Column, pivot: float = CENTER_PIVOT, move: float = CENTER_MOVE,
                  floor: float = PRICE_FLOOR, ceiling: float = PRICE_CEILING) -> tuple[Column, Column]:
    """The price range moved away from its side of the pivot, inside the limits."""
    center, half = (lo + hi) / 2.0, (hi - lo) / 2.0
    new = F.when(center < pivot, center + move).otherwise(center - move)
    return F.greatest(F.lit(floor), new - half), F.least(F.lit(ceiling), new + half)


def shifted_recency(weight: Column) -> Column:
    return clip(1.0 - weight, RECENCY_FLOOR, RECENCY_CEILING)


def interpolate(pre: DataFrame, post: DataFrame, owner: Sequence[str], key: str, weight: str,
                fractions: Sequence[float]) -> DataFrame:
    """Key-wise mix of two preference tables; a missing key weighs zero."""
    keys = [*owner, key]
    both = pre.select(*keys, F.col(weight).alias("_a")).join(
        post.select(*keys, F.col(weight).alias("_b")), keys, "full_outer"
    )
    frac = clip(F.col("frac"), 0.0, 1.0)
    mixed = both.withColumn("frac", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    return mixed.select(
        *keys, "frac",
        ((1.0 - frac) * F.coalesce("_a", F.lit(0.0)) + frac * F.coalesce("_b", F.lit(0.0))).alias(weight),
    )


def drift_fraction(clock: Column, start: int = DRIFT_START, end: int = DRIFT_END) -> Column:
    return F.when(clock <= start, 0.0).when(clock >= end, 1.0).otherwise((clock - start) / F.lit(float(end - start)))


def drift_phase(clock: Column, start: int = DRIFT_START, end: int = DRIFT_END, phases: int = PHASES) -> Column:
    """Phase number, halves rounded to even."""
    return F.bround(drift_fraction(clock, start, end) * phases, 0).cast("int")


def phase_starts(start: int = DRIFT_START, end: int = DRIFT_END, phases: int = PHASES) -> list[int]:
    """The first event of every phase 0 .. phases (phase 0: event 0)."""
    out = [0] * (phases + 1)
    for n in range(end, start, -1):
        out[round(phases * (n - start) / (end - start))] = n  # halves to even
    return [0, *out[1:]]


PREFERENCES = {"brand": "brand_pref", "category": "cat_affinity"}


def preferences(profiles: DataFrame) -> DataFrame:
    """(profile_idx, kind, key, weight) of profiles with preference maps."""
    out = None
    for kind, c in PREFERENCES.items():
        part = profiles.select("profile_idx", F.lit(kind).alias("kind"), F.explode(c).alias("key", "weight"))
        out = part if out is None else out.unionByName(part)
    return out


def with_preferences(ranges: DataFrame, prefs: DataFrame, by: Sequence[str] = ("profile_idx",)) -> DataFrame:
    """Price ranges and recency weights with the preference maps of ``prefs``."""
    maps = prefs.groupBy(*by).agg(*[
        F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "weight")))).alias(c) for kind, c in PREFERENCES.items()
    ])
    return ranges.join(maps, list(by))


def shifted_profile(profiles: DataFrame, pivot: float = CENTER_PIVOT, move: float = CENTER_MOVE,
                    floor: float = PRICE_FLOOR, ceiling: float = PRICE_CEILING) -> DataFrame:
    """The profiles after the drift: brand and category extremes swapped, the price range
    moved, the recency weight turned round."""
    lo, hi = shifted_range(F.col("price_lo"), F.col("price_hi"), pivot, move, floor, ceiling)
    ranges = profiles.select("profile_idx", "profile", lo.alias("price_lo"), hi.alias("price_hi"), shifted_recency(F.col("recency_weight")).alias("recency_weight"))
    flipped = flip_extremes(preferences(profiles), ["profile_idx", "kind"], "key", "weight")
    return with_preferences(ranges, flipped).select(*profiles.columns)


def profile_phases(pre: DataFrame, post: DataFrame, phases: int = PHASES) -> DataFrame:
    """The profiles of every ``phase``, mixed from before and after the drift key by key."""
    fractions = [p / phases for p in range(phases + 1)]
    prefs = interpolate(preferences(pre), preferences(post), ["profile_idx", "kind"], "key", "weight", fractions)
    phase = F.bround(F.col("frac") * phases, 0).cast("int").alias("phase")
    numbers = ("price_lo", "price_hi", "recency_weight")
    both = pre.select("profile_idx", "profile", *numbers).join(post.select("profile_idx", *[F.col(c).alias(f"_{c}") for c in numbers]), "profile_idx")
    frac = F.col("frac")
    ranges = both.withColumn("frac", F.explode(F.array(*[F.lit(f) for f in fractions]))).select(
        "profile_idx", "profile", phase, *[((1.0 - frac) * F.col(c) + frac * F.col(f"_{c}")).alias(c) for c in numbers]
    )
    return with_preferences(ranges, prefs.select("profile_idx", "kind", "key", "weight", phase), ["profile_idx", "phase"])


def truth_at(marks: DataFrame, versions: DataFrame, by: Sequence[str], clock: str = "checkpoint") -> DataFrame:
    """Truth rows valid at every checkpoint: the version of the latest phase that
    has started. ``versions`` carries by, phase_start and item_id.

    An as-of join as one sorted union: versions count one, marks nothing, and the running
    total at a mark is the number of the version that holds there, whichever slice of the
    order it began in. So the work is versions plus marks, not their product.
    """
    by = list(by)
    starts = versions.select(*by, F.col("phase_start").cast("long").alias("_t")).distinct()
    asked = marks.select(*by, F.col(clock).alias("_clock")).distinct()
    union = starts.select(*by, "_t", F.lit(0).alias("_kind"), F.lit(None).cast(asked.schema["_clock"].dataType).alias("_clock"), F.lit(1).cast("long").alias("_one")).unionByName(
        asked.select(*by, F.col("_clock").cast("long").alias("_t"), F.lit(1).alias("_kind"), "_clock", F.lit(0).cast("long").alias("_one"))
    )
    placed = materialize(running_totals(union, by, ["_t", "_kind"], "_one"))
    began = placed.filter("_kind = 0").select(*by, (F.col("before") + 1).alias("_nth"), F.col("_t").alias("phase_start"))
    active = placed.filter("_kind = 1 and before > 0").select(*by, F.col("before").alias("_nth"), F.col("_clock").alias(clock)).join(began, [*by, "_nth"])
    return active.join(versions, [*by, "phase_start"]).select(*by, clock, "item_id")
