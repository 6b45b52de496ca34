"""The five preference profiles and the experiment constants."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SEED_BASE = 17042
RUN_SEED_STEP = 17
PROFILE_SEED_FIRST = 101
PROFILE_SEED_STEP = 97
TOP_K = 7
LIST_K = 10
LEARNING_RATE = 0.05
EPS_INIT, EPS_DECAY, EPS_MIN = 0.30, 0.9997, 0.05
EPS_DECAY_EXTERNAL = 0.998
ALPHA = 0.50
LAMBDA_Q = 0.50
NOISE_SD = 0.015
LAMBDA_GRID = (0.10, 0.20, 0.30, 0.40, 0.45, 0.50, 0.60, 0.70, 0.80, 0.90)
ALPHA_GRID = (0.30, 0.40, 0.50, 0.60, 0.70, 0.80)
BONUS_GRID = (0.0, 0.10, 0.20)
CONFIDENCE_TAU, CONFIDENCE_TAU_EXTERNAL, CONFIDENCE_MAX = 300.0, 8.0, 0.50
REWARD_BASE, REWARD_ENGAGE, REWARD_CONVERT = -0.02, 0.30, 1.00
DEFAULT_BRAND, DEFAULT_CATEGORY = 0.10, 0.05
FEATURES = ("price_pct", "quality_pct", "popularity_pct", "rating_pct", "recency_pct")


@dataclass(frozen=True)
class Profile:
    name: str
    brand_pref: dict[str, float]
    price_range: tuple[float, float]
    cat_affinity: dict[str, float]
    recency_weight: float
    index: int = field(default=0)


def _profile(index, name, budget, mid, premium, price_range, electronics, computers, home, recency):
    return Profile(
        name,
        {"budget_brand": budget, "mid_brand": mid, "premium_brand": premium},
        price_range,
        {"Electronics": electronics, "Computers": computers, "HomeKitchen": home},
        recency,
        index,
    )


# Name, budget, mid, premium, price range, electronics, computers,
# home and kitchen, recency weight.
PROFILES = (
    _profile(0, "budget", 0.80, 0.15, 0.05, (10.0, 160.0), 0.20, 0.20, 0.60, 0.10),
    _profile(1, "quality_seeker", 0.05, 0.20, 0.75, (300.0, 1000.0), 0.55, 0.35, 0.10, 0.75),
    _profile(2, "explorer", 0.25, 0.50, 0.25, (50.0, 700.0), 0.35, 0.30, 0.35, 0.65),
    _profile(3, "loyal", 0.05, 0.30, 0.65, (100.0, 800.0), 0.70, 0.20, 0.10, 0.25),
    _profile(4, "balanced", 0.20, 0.50, 0.30, (80.0, 500.0), 0.35, 0.30, 0.35, 0.45),
)


def run_seed(run: Column | int) -> Column | int:
    return SEED_BASE + RUN_SEED_STEP * run


def profile_seed(seed: Column | int, index: Column | int) -> Column | int:
    return seed + PROFILE_SEED_FIRST + PROFILE_SEED_STEP * index


def rescale_prices(profiles, span_from, span_to):
    """The same profiles with price ranges mapped linearly to another span."""
    (a, b), (c, d) = span_from, span_to
    move = lambda x: c + (x - a) * (d - c) / (b - a)
    return tuple(
        Profile(p.name, p.brand_pref, (move(p.price_range[0]), move(p.price_range[1])),
                p.cat_affinity, p.recency_weight, p.index)
        for p in profiles
    )


def map_column(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def profile_array(profiles=PROFILES) -> Column:
    """The profiles as one array column, to be exploded next to every row."""
    return F.array(
        *[
            F.struct(
                F.lit(p.index).alias("profile_idx"),
                F.lit(p.name).alias("profile"),
                map_column(p.brand_pref).alias("brand_pref"),
                map_column(p.cat_affinity).alias("cat_affinity"),
                F.lit(float(p.price_range[0])).alias("price_lo"),
                F.lit(float(p.price_range[1])).alias("price_hi"),
                F.lit(float(p.recency_weight)).alias("recency_weight"),
            )
            for p in profiles
        ]
    )
