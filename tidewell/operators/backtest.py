"""Walk-forward tests: of the stock selector and of the sector signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import bucket, correlation, rate, rnd
from .scoring import as_of_features, ranked, stock_scores
from .timeseries import FACTOR_HISTORY, by_date


def forward(bars: DataFrame, horizon: int) -> DataFrame:
    """(role, code, sector, date, rn, n, close, later, later_date): each bar with the one ``horizon`` bars on."""
    w = by_date()
    return bars.select(
        "role", "code", "sector", "date", "close", F.row_number().over(w).alias("rn"), F.count("*").over(Window.partitionBy("code")).alias("n"),
        F.lead("close", horizon).over(w).alias("later"), F.lead("date", horizon).over(w).alias("later_date"),
    )


def evaluation_dates(bars: DataFrame, horizon: int, step: int, start: str | None = None) -> DataFrame:
    """(sector, as_of, benchmark_return): every ``step``-th day of a sector from FACTOR_HISTORY bars on that has ``horizon`` bars after it.

    A start date is applied after the stepping.
    """
    f = forward(bars, horizon).where("role = 'sector'")
    out = f.where((F.col("rn") >= FACTOR_HISTORY) & (F.col("rn") <= F.col("n") - horizon) & ((F.col("rn") - FACTOR_HISTORY) % step == 0))
    out = out.select("sector", F.col("date").alias("as_of"), ((F.col("later") / F.col("close") - 1) * 100).alias("benchmark_return"))
    return out if start is None else out.where(F.col("as_of") >= F.lit(start).cast("date"))


def selector_observations(bars: DataFrame, features: DataFrame, horizon: int = 20, top_n: int = 3, step: int = 5, cost_bps: float = 20.0, start: str | None = None) -> DataFrame:
    """The ``top_n`` stocks of each sector at each evaluation date with what followed.

    Ranks are frozen before any later price is joined; a stock is held from its last bar at the
    date for ``horizon`` of its own bars.
    """
    dates = evaluation_dates(bars, horizon, step, start)
    known = as_of_features(features, dates.select("sector", "as_of"))
    chosen = ranked(stock_scores(known), ["sector", "as_of"]).where(F.col("rank") <= max(1, top_n)).select("sector", "as_of", "code", "date", "rank", "score")
    after = forward(bars, horizon).where("role = 'stock' AND later IS NOT NULL").select("code", "date", ((F.col("later") / F.col("close") - 1) * 100).alias("gross"))
    net = F.col("gross") - cost_bps / 100
    return (
        chosen.join(dates, ["sector", "as_of"]).join(after, ["code", "date"])
        .select("sector", "as_of", "code", "rank", "score", net.alias("raw_net"), F.col("benchmark_return").alias("raw_benchmark"),
                rnd("gross", 4).alias("future_gross_return_pct"), rnd(net, 4).alias("future_net_return_pct"),
                rnd("benchmark_return", 4).alias("benchmark_return_pct"), rnd(net - F.col("benchmark_return"), 4).alias("excess_return_pct"))
    )


def selector_periods(observations: DataFrame) -> DataFrame:
    """The equal-weight portfolio of each sector and date against the benchmark."""
    return observations.groupBy("sector", "as_of").agg(
        F.count("*").alias("holdings"), rnd(F.avg("raw_net"), 4).alias("portfolio_net_return_pct"), rnd(F.max("raw_benchmark"), 4).alias("benchmark_return_pct"),
        rnd(F.avg("raw_net") - F.max("raw_benchmark"), 4).alias("excess_return_pct"),
    )


def selector_metrics(observations: DataFrame) -> DataFrame:
    per_obs = observations.groupBy("sector").agg(
        F.count("*").alias("candidate_observations"), F.countDistinct("as_of").alias("evaluation_periods"), rate(F.col("future_net_return_pct") > 0).alias("hit_rate"),
        rate(F.col("excess_return_pct") > 0).alias("excess_hit_rate"), rnd(F.avg("future_net_return_pct"), 4).alias("mean_net_return_pct"),
        rnd(F.median("future_net_return_pct"), 4).alias("median_net_return_pct"), rnd(F.avg("excess_return_pct"), 4).alias("mean_excess_return_pct"),
    )
    periods = selector_periods(observations).groupBy("sector").agg(rnd(F.avg("portfolio_net_return_pct"), 4).alias("portfolio_period_mean_net_return_pct"))
    return per_obs.join(periods, "sector")


def score_buckets(observations: DataFrame, net: str, keys: list[str]) -> DataFrame:
    """Outcomes by score band; bands without observations are absent."""
    return observations.groupBy(*keys, bucket(F.col("score")).alias("bucket")).agg(
        F.count("*").alias("observations"), rate(F.col(net) > 0).alias("historical_up_rate"), rate(F.col("excess_return_pct") > 0).alias("historical_excess_hit_rate"),
        rnd(F.avg(net), 4).alias("mean_net_return_pct"), rnd(F.avg("excess_return_pct"), 4).alias("mean_excess_return_pct"),
        (F.count("*") >= 30).alias("probability_publishable"),
    )


def sector_observations(bars: DataFrame, scored: DataFrame, horizon: int = 20, step: int | None = None, cost_bps: float = 20.0) -> DataFrame:
    """Sector scores at stepped decision days with the following return, net and against the market on the same days."""
    step = horizon if step is None else max(1, step)
    f = forward(bars, horizon)
    market = bars.where("role = 'market'")
    now, later = market.select(F.col("date"), F.col("close").alias("m0")), market.select(F.col("date").alias("later_date"), F.col("close").alias("m1"))
    taken = f.where("role = 'sector'").where((F.col("rn") >= FACTOR_HISTORY) & (F.col("rn") <= F.col("n") - horizon) & ((F.col("rn") - FACTOR_HISTORY) % step == 0))
    net = (F.col("later") / F.col("close") - 1) * 100 - cost_bps / 100
    s = scored.select("sector", "date", F.col(f"score_{horizon}d").alias("score")).where("score IS NOT NULL")
    return (
        taken.join(now, "date").join(later, "later_date").join(s, ["sector", "date"])
        .select("sector", "date", "later_date", "score", rnd(net, 4).alias("net_return_pct"), rnd(net - (F.col("m1") / F.col("m0") - 1) * 100, 4).alias("excess_return_pct"))
    )


def sector_gate(observations: DataFrame, scored: DataFrame, horizon: int = 20) -> DataFrame:
    """usable or abstain for each sector: enough observations, a score that orders returns, and a band that earned its side."""
    now = scored.groupBy("sector").agg(F.max_by(f"score_{horizon}d", "date").alias("current_score"))
    whole = observations.groupBy("sector").agg(F.count("*").alias("total"), rnd(correlation(F.col("score"), F.col("excess_return_pct")), 4).alias("score_excess_correlation"))
    bands = score_buckets(observations, "net_return_pct", ["sector"]).select("sector", F.col("bucket").alias("current_bucket"), F.col("observations").alias("bucket_n"), F.col("mean_excess_return_pct").alias("m"), F.col("historical_excess_hit_rate").alias("h"))
    j = now.withColumn("current_bucket", bucket(F.col("current_score"))).join(whole, "sector", "left").join(bands, ["sector", "current_bucket"], "left")
    s = F.col("current_score")
    side = F.when((s > 35) & (s < 65), False).when(F.col("bucket_n").isNull() | (F.col("bucket_n") < 20), False).when(s >= 65, (F.col("m") > 0) & (F.col("h") >= 0.5)).otherwise((F.col("m") < 0) & (F.col("h") < 0.5))
    enough, ordered = F.coalesce(F.col("total") >= 30, F.lit(False)), F.coalesce(F.col("score_excess_correlation") >= 0.10, F.lit(False))
    return j.select(
        "sector", rnd(s, 3).alias("current_score"), "current_bucket", F.coalesce("total", F.lit(0)).alias("observations"), "score_excess_correlation", enough.alias("enough_total_observations"),
        ordered.alias("positive_score_monotonicity"), side.alias("current_bucket_usable"), F.when(enough & ordered & side, "usable").otherwise("abstain").alias("status"),
    )
