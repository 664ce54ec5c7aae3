"""Factor scores of stocks and sectors, breadth, and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import mean_of, regime, rnd, scaled, weighted
from .timeseries import asof

# Factor weights and the ranges that scale to 0..100 (inverse: low is good).
STOCK_WEIGHTS = {
    "momentum_20d": 0.18, "momentum_60d": 0.12, "relative_20d": 0.18, "relative_60d": 0.12,
    "trend": 0.15, "volume_confirmation": 0.10, "volatility_quality": 0.08, "drawdown_quality": 0.07,
}
SHORT_WEIGHTS = {"momentum_5d": 0.25, "momentum_20d": 0.20, "relative_20d": 0.10, "trend": 0.20, "breadth_20d": 0.15, "volatility_quality": 0.10}
SWING_WEIGHTS = {"momentum_20d": 0.20, "momentum_60d": 0.20, "relative_60d": 0.10, "trend": 0.20, "breadth_20d": 0.10, "breadth_60d": 0.10, "volatility_quality": 0.10}
MOMENTUM = {"momentum_5d": ("return_5d_pct", -8, 8), "momentum_20d": ("return_20d_pct", -15, 15), "momentum_60d": ("return_60d_pct", -30, 30), "relative_20d": ("relative_20d_pct", -10, 10), "relative_60d": ("relative_60d_pct", -20, 20)}
STOCK_TREND = (("ma20_gap_pct", -10, 10), ("ma20_vs_ma60_pct", -8, 8), ("ma20_slope_10d_pct", -6, 6))
SECTOR_TREND = (("ma20_gap_pct", -8, 8), ("ma20_vs_ma60_pct", -8, 8), ("ma20_slope_10d_pct", -5, 5))
STOCK_OTHER = {"volume_confirmation": ("volume_20d_vs_60d", 0.6, 1.6, False), "volatility_quality": ("volatility_20d_annualized_pct", 15, 70, True), "drawdown_quality": ("max_drawdown_60d_pct", -40, 0, False)}
SECTOR_OTHER = {"breadth_20d": ("above_ma20_pct", 20, 80, False), "breadth_60d": ("above_ma60_pct", 20, 80, False), "volatility_quality": ("volatility_20d_annualized_pct", 12, 55, True)}
#: Least coverage of a score that counts.
LEAST_COVERAGE = 0.75


def _parts(trend: tuple, other: dict) -> dict[str, Column]:
    parts = {k: scaled(F.col(c), a, b) for k, (c, a, b) in MOMENTUM.items()}
    parts["trend"] = mean_of([scaled(F.col(c), a, b) for c, a, b in trend])
    return parts | {k: scaled(F.col(c), a, b, i) for k, (c, a, b, i) in other.items()}


def stock_scores(features: DataFrame) -> DataFrame:
    """Features of stocks with their eight components (three places), score and coverage."""
    parts = {k: v for k, v in _parts(STOCK_TREND, STOCK_OTHER).items() if k in STOCK_WEIGHTS}
    score, coverage = weighted(parts, STOCK_WEIGHTS)
    return features.where("role = 'stock'").withColumns({k: rnd(v, 3) for k, v in parts.items()} | {"score": score, "coverage": coverage})


def explanations(scored: DataFrame, limit: int = 3) -> DataFrame:
    """Names of the highest and lowest components of each row; ties by name."""
    items = F.filter(F.array(*[F.struct(F.col(k).alias("value"), F.lit(k).alias("name")) for k in STOCK_WEIGHTS]), lambda x: x["value"].isNotNull())
    low = F.array_sort(items)
    high = F.array_sort(F.transform(items, lambda x: F.struct((-x["value"]).alias("value"), x["name"].alias("name"))))
    names = lambda a: F.array_join(F.transform(F.slice(a, 1, limit), lambda x: x["name"]), ",")
    return scored.withColumns({"strengths": names(high), "risks": names(low)})


def breadth(features: DataFrame) -> DataFrame:
    """(sector, date, eligible_count, above_ma20_pct, above_ma60_pct, positive_20d_pct) at every day of the sector.

    Each stock of the sector counts with its last feature row at or before the day.
    """
    dates = features.where("role = 'sector'").select("sector", F.col("date").alias("as_of"))
    share = lambda flag: rnd(100.0 * F.count_if(flag) / F.count("*"), 3)
    return as_of_features(features, dates).groupBy("sector", F.col("as_of").alias("date")).agg(
        F.count("*").alias("eligible_count"), share(F.col("close") > F.col("raw_ma20")).alias("above_ma20_pct"),
        share(F.col("close") > F.col("raw_ma60")).alias("above_ma60_pct"), share(F.col("return_20d_pct") > 0).alias("positive_20d_pct"),
    )


def sector_scores(features: DataFrame) -> DataFrame:
    """Short and swing scores of each sector and day, with the breadth of its stocks."""
    f = features.where("role = 'sector'").join(breadth(features), ["sector", "date"], "left")
    parts = _parts(SECTOR_TREND, SECTOR_OTHER)
    s5, c5 = weighted(parts, SHORT_WEIGHTS)
    s20, c20 = weighted(parts, SWING_WEIGHTS)
    return f.withColumns({"score_5d": s5, "coverage_5d": c5, "score_20d": s20, "coverage_20d": c20}).withColumns({"regime_5d": regime(F.col("score_5d")), "regime_20d": regime(F.col("score_20d"))})


def as_of_features(features: DataFrame, dates: DataFrame) -> DataFrame:
    """For each (sector, as_of) of ``dates`` and each stock of the sector, its last feature row at or before the day."""
    stocks = features.where("role = 'stock'")
    members = stocks.select("sector", "code").distinct()
    asked = dates.join(members, "sector").select("code", "as_of", F.col("sector").alias("asked_sector"))
    found = asof(asked, stocks.drop("sector"), "code", "as_of", "date", prefix="")
    return found.where("date IS NOT NULL").withColumnRenamed("asked_sector", "sector")


def ranked(scored: DataFrame, by: list[str]) -> DataFrame:
    """Eligible rows (a score of enough coverage) ranked within ``by``, best score first, then the later code."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("code"))
    return scored.where(F.col("score").isNotNull() & (F.col("coverage") >= LEAST_COVERAGE)).withColumn("rank", F.row_number().over(w))
