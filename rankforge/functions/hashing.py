"""Seeded pseudo-random columns that do not depend on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 13  # 52 bits, exact in a double


def hash_key(*parts: Column | str | int) -> Column:
    """md5 of the parts joined by '|': an order that any engine reproduces."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]).cast("binary"))


def hash_long(*parts: Column | str | int) -> Column:
    return F.conv(F.substring(hash_key(*parts), 1, HEX_DIGITS), 16, 10).cast("long")


def hash_uniform(*parts: Column | str | int) -> Column:
    """Uniform in [0, 1)."""
    return hash_long(*parts) / F.lit(float(16**HEX_DIGITS))


def hash_normal(*parts: Column | str | int) -> Column:
    """Standard normal from two uniforms."""
    u1 = F.greatest(hash_uniform(*parts, "a"), F.lit(2.0**-52))
    u2 = hash_uniform(*parts, "b")
    return F.sqrt(-2.0 * F.ln(u1)) * F.cos(2.0 * math.pi * u2)
