"""Column-level helpers shared by the feature builders."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, functions as F

from pitrank.contracts import SECTOR_COLUMNS, SECTOR_SUFFIX


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` with null for a zero or null denominator (ANSI safe)."""
    return num / F.when(den != 0, den)


def growth(now: Column, then: Column) -> Column:
    return ratio(now, then) - F.lit(1.0)


def bucketise(value: Column, edges: Sequence[float]) -> Column:
    """Left-closed bins over (-inf, edges..., inf): code = number of edges <= value."""
    out = F.when(value.isNull() | F.isnan(value), F.lit(None).cast("double"))
    for code, edge in enumerate(edges):
        out = out.when(value < F.lit(float(edge)), F.lit(float(code)))
    return out.otherwise(F.lit(float(len(edges))))


def sector_onehot(sector: Column, industry: Column) -> list[Column]:
    """Ten sector flags, ``sector_other`` and ``is_biotech`` as integers."""
    key = F.lower(F.trim(sector))
    members = {s: [k for k, v in SECTOR_SUFFIX.items() if v == s] for s in SECTOR_COLUMNS}
    flags = [
        F.coalesce(key.isin(names), F.lit(False)).cast("int").alias(f"sector_{suffix}")
        for suffix, names in members.items()
    ]
    known = F.coalesce(key.isin(list(SECTOR_SUFFIX)), F.lit(False))
    biotech = F.coalesce(F.contains(F.lower(F.trim(industry)), F.lit("biotech")), F.lit(False))
    return [*flags, (~known).cast("int").alias("sector_other"), biotech.cast("int").alias("is_biotech")]


def wilson_bounds(successes: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Wilson score interval clipped to [0, 1]; (0, 0) when ``n`` is zero."""
    z = NormalDist().inv_cdf(1 - (1 - confidence) / 2)
    share = ratio(successes.cast("double"), n.cast("double"))
    inv_n = ratio(F.lit(1.0), n.cast("double"))
    scale = F.lit(1.0) + F.lit(z * z) * inv_n
    centre = share + F.lit(z * z / 2) * inv_n
    margin = F.lit(z) * F.sqrt(share * (F.lit(1.0) - share) * inv_n + F.lit(z * z / 4) * inv_n * inv_n)
    low = F.greatest(F.lit(0.0), (centre - margin) / scale)
    high = F.least(F.lit(1.0), (centre + margin) / scale)
    return F.coalesce(low, F.lit(0.0)), F.coalesce(high, F.lit(0.0))


def random_guess_tolerance(
    expected: Column, observations: Column, multiplier: float = 3.0, z: float = 3.0
) -> Column:
    """Largest precision still explainable by chance: max(m*p, p + z*se), clipped to [p, 1]."""
    spread = F.sqrt(ratio(expected * (F.lit(1.0) - expected), observations.cast("double")))
    chance = expected + F.coalesce(F.lit(z) * spread, F.lit(0.0))
    bound = F.greatest(F.lit(multiplier) * expected, chance)
    clipped = F.least(F.lit(1.0), F.greatest(expected, bound))
    return F.when(expected.isNull() | (expected <= 0), expected).otherwise(clipped)


def student_t_two_sided(t: float, dof: int) -> float:
    """Two-sided p-value of Student's t, for the single result row of a test.

    Regularised incomplete beta by its continued fraction (modified Lentz).
    """
    if dof <= 0 or math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    x, a, b = dof / (dof + t * t), dof / 2.0, 0.5
    if x in (0.0, 1.0):
        return x
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for step in range(400):
        m = step // 2
        if step == 0:
            coef = 1.0
        elif step % 2 == 0:
            coef = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            coef = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + coef * d or tiny)
        c = 1.0 + coef / c or tiny
        f *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    value = front * (f - 1.0)
    return 1.0 - value if flip else value


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))
