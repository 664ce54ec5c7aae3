"""Column macros shared by the operators: guarded arithmetic, scaling, weighted scores, regimes."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """A double, or null where it is missing, not a number, or infinite."""
    d = x.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def rnd(x: Column | str, places: int) -> Column:
    """Rounded to some places, after a nudge of 1e-9 that keeps halves, which engines round apart, off the edge."""
    return F.round((F.col(x) if isinstance(x, str) else x) + F.lit(1e-9), places)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def pct_gap(value: Column, reference: Column) -> Column:
    """Percent by which a value exceeds a positive reference, else null."""
    return F.when(reference > 0, (value / reference - 1) * 100)


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """Null stays null (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def scaled(x: Column, low: float, high: float, inverse: bool = False) -> Column:
    """Linear scale of [low, high] to 0..100."""
    y = clamp((x - float(low)) / (float(high) - float(low)) * 100)
    return 100 - y if inverse else y


def weighted(parts: Mapping[str, Column], weights: Mapping[str, float]) -> tuple[Column, Column]:
    """(score, coverage): missing parts are dropped and the weights of the others renormalized."""
    add = lambda cols: reduce(lambda a, b: a + b, cols)
    top = add([F.when(parts[k].isNotNull(), parts[k] * w).otherwise(0.0) for k, w in weights.items()])
    base = add([F.when(parts[k].isNotNull(), F.lit(w)).otherwise(0.0) for k, w in weights.items()])
    return F.when(base > 0, rnd(top / base, 3)), rnd(base / F.lit(sum(weights.values())), 3)


def mean_of(parts: list[Column]) -> Column:
    """Mean of the columns that are not null."""
    add = lambda cols: reduce(lambda a, b: a + b, cols)
    n = add([F.when(p.isNotNull(), 1.0).otherwise(0.0) for p in parts])
    return F.try_divide(add([F.coalesce(p, F.lit(0.0)) for p in parts]), n)


def regime(score: Column) -> Column:
    return F.when(score.isNull(), "insufficient").when(score >= 65, "strong").when(score <= 35, "weak").otherwise("mixed")


def signed_regime(x: Column, threshold: float = 1.0) -> Column:
    return F.when(x.isNull(), "insufficient").when(x > threshold, "positive").when(x < -threshold, "negative").otherwise("mixed_or_flat")


def bucket(score: Column) -> Column:
    return F.when(score < 40, "<40").when(score < 50, "40-50").when(score < 60, "50-60").when(score < 70, "60-70").otherwise(">=70")


def rate(flag: Column) -> Column:
    """Share of true flags, four places."""
    return rnd(F.avg(flag.cast("double")), 4)


def correlation(x: Column, y: Column, least: int = 3) -> Column:
    """Pearson's r from moments; null under ``least`` pairs or where a side is constant."""
    num = F.covar_pop(x, y)
    den = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when((F.count(F.when(x.isNotNull() & y.isNotNull(), 1)) >= least) & (den > 1e-12), F.try_divide(num, den))
