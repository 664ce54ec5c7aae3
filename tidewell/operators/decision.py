"""Recommendations, position sizes, the publication gate and outlook plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import clamp, rnd

# Position limits of the risk profiles, in percent.
PROFILES = {
    "conservative": {"single": 3.0, "theme": 10.0, "risk_cap": 10.0, "budget": 0.25},
    "balanced": {"single": 5.0, "theme": 20.0, "risk_cap": 12.0, "budget": 0.50},
    "aggressive": {"single": 8.0, "theme": 30.0, "risk_cap": 15.0, "budget": 0.75},
}
# Points of the verdicts.
POINTS = {
    "fundamental_verdict": {"pass": 85, "watch": 55, "fail": 10},
    "valuation_verdict": {"attractive": 85, "fair": 65, "expensive": 20, "not_meaningful": 55},
    "catalyst_status": {"confirmed": 85, "plausible": 65, "absent": 20},
    "risk_level": {"medium": 75, "high": 45, "very_high": 10},
}
CONVICTION = (("score", 0.45), ("sector_score", 0.20), ("fundamental_verdict", 0.15), ("catalyst_status", 0.10), ("valuation_verdict", 0.05), ("risk_level", 0.05))


def points(name: str) -> Column:
    table = F.create_map(*[F.lit(v) for k, p in POINTS[name].items() for v in (k, float(p))])
    return F.coalesce(table[F.col(name)], F.lit(0.0))


def review_date(as_of: Column, horizon: Column) -> Column:
    """Calendar day by which ``horizon`` sessions have passed."""
    return F.date_add(as_of, F.bround(1.45 * horizon).cast("int"))


#: The valuation framework under which a valuation that has no meaning does not stand against a buy.
PIPELINE_VALUATION = "pipeline_milestone_and_risk_adjusted_cashflow"


def gate_checks(profile: str = "balanced") -> dict[str, Column]:
    """The conditions of a buy by name, each true or false."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    pipeline = (F.col("valuation_framework") == PIPELINE_VALUATION) & (F.col("valuation_verdict") == "not_meaningful")
    checks = {
        "stock_score_at_least_65": F.col("score") >= 65, "sector_score_at_least_55": F.col("sector_score") >= 55, "backtest_positive_excess": F.col("mean_excess") > 0, "backtest_excess_hit_at_least_50pct": F.col("excess_hit") >= 0.5,
        "fundamental_pass": F.col("fundamental_verdict") == "pass", "catalyst_present": F.col("catalyst_status").isin("confirmed", "plausible"), "valuation_allowed": ok(F.col("valuation_verdict").isin("attractive", "fair")) | ok(pipeline),
        "risk_level_allowed": F.col("risk_level").isin("medium", "high"), "timing_state_triggered_or_retest": F.col("timing_state").isin("triggered", "retest"), "timing_backtest_usable": F.col("timing_gate") == "usable",
        "timing_risk_within_profile_cap": (F.col("risk_distance_pct") > 0) & (F.col("risk_distance_pct") <= PROFILES[profile]["risk_cap"]),
    }
    return {name: ok(c) for name, c in checks.items()}


def ready_only(candidates: DataFrame, gates: DataFrame, by: str = "document") -> DataFrame:
    """Candidates of briefs whose gate is ready; there is no recommendation on the others."""
    return candidates.join(gates.where("ready").select(by), by, "left_semi")


def recommend(candidates: DataFrame, profile: str = "balanced", by: str = "sector") -> DataFrame:
    """Actions and sizes of candidates (score, sector_score, verdicts, selector and timing results, risk distance).

    All conditions of ``gate_checks`` make a buy. A size is bounded by conviction, by the risk budget over the trade plan's
    ``technical_risk_pct`` (without such a column the timing state's distance, two digits), and by the profile's single cap; sizes of one theme are scaled
    to its cap. ``valuation_framework`` may be missing.
    """
    p = PROFILES[profile]
    ok = lambda c: F.coalesce(c, F.lit(False))
    if "valuation_framework" not in candidates.columns:
        candidates = candidates.withColumn("valuation_framework", F.lit(None).cast("string"))
    if "technical_risk_pct" not in candidates.columns:
        candidates = candidates.withColumn("technical_risk_pct", rnd("risk_distance_pct", 2))
    conviction = sum((w * (F.coalesce(F.col(c), F.lit(0.0)) if c in ("score", "sector_score") else points(c)) for c, w in CONVICTION), F.lit(0.0))
    avoid = ok(F.col("fundamental_verdict") == "fail") | ok(F.col("risk_level") == "very_high") | ok(F.col("score") < 45)
    checks = F.create_map(*[x for name, c in gate_checks(profile).items() for x in (F.lit(name), c)])
    c = candidates.withColumns({"conviction": rnd(conviction, 2), "gate_checks": checks}).withColumn("buy_gate", F.forall(F.map_values("gate_checks"), lambda x: x))
    c = c.withColumn("action", F.when(F.col("buy_gate"), "buy").when(avoid, "avoid").otherwise("wait"))
    strength = clamp((F.col("conviction") - 60) / 25, 0, 1)
    # a plan without a distance to its stop gets no position
    risk_cap = F.when(F.col("technical_risk_pct") > 0, p["budget"] / F.col("technical_risk_pct") * 100)
    size = F.when(risk_cap.isNotNull(), F.least(p["single"] * (0.5 + 0.5 * strength), risk_cap, F.lit(p["single"]))).otherwise(0.0)
    c = c.withColumn("raw", F.when(F.col("action") == "buy", rnd(size, 2)).otherwise(0.0))
    total = F.sum("raw").over(Window.partitionBy(by))
    scale = F.when(total > 0, F.least(F.lit(1.0), p["theme"] / total)).otherwise(1.0)
    return c.withColumn("position_pct", rnd(F.col("raw") * scale, 2)).withColumn("order", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.col("action") == "buy"), F.desc("conviction"), "code")))


def portfolio_controls(recommended: DataFrame, profile: str = "balanced", by: str = "sector") -> DataFrame:
    return recommended.groupBy(by).agg(
        F.count("*").alias("candidates"), F.count_if(F.col("action") == "buy").alias("buys"), F.count_if(F.col("action") == "avoid").alias("avoids"), rnd(F.sum("position_pct"), 2).alias("total_position_pct"),
        (F.sum("position_pct") <= PROFILES[profile]["theme"] + 0.01).alias("within_theme_cap"),
    )


CHECKS = ("facts_ok", "forecast_ok", "selection_ok", "periods_ok", "observations_ok", "costs_ok", "selector_ok", "news_ok", "signal_ok")


def publication_gate(inputs: DataFrame) -> DataFrame:
    """ready, and the checks that failed, of rows with what each check reads."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    checks = {
        "facts_ok": F.col("substantive_facts") >= 3, "forecast_ok": F.col("forecast_coverage") >= 0.75, "selection_ok": F.col("selection_coverage") >= 0.75, "periods_ok": F.col("evaluation_periods") >= 20,
        "observations_ok": F.col("candidate_observations") >= 30, "costs_ok": F.col("cost_bps") > 0, "selector_ok": (F.col("mean_excess_return_pct") > 0) & (F.col("excess_hit_rate") >= 0.5) & (F.col("median_net_return_pct") > 0),
        "news_ok": F.col("news_passed"), "signal_ok": F.col("signal_status") == "usable",
    }
    out = inputs.withColumns({k: ok(v) for k, v in checks.items()})
    failed = F.array_compact(F.array(*[F.when(~F.col(k), k) for k in CHECKS]))
    return out.withColumn("failed", F.array_join(failed, ",")).withColumn("ready", F.col("failed") == "")


# The order of the stages of an outlook, by branch.
ORDERS = {
    "structural": ["identity", "clock", "fundamentals", "news", "cross_market", "positioning", "local_state", "synthesis"],
    "confirmed": ["identity", "clock", "news", "local_state_before_event", "cross_market", "positioning", "synthesis"],
    "rumor": ["identity", "clock", "local_state", "news_verification", "positioning", "cross_market", "synthesis"],
    "premarket": ["identity", "clock", "news", "cross_market", "local_state", "positioning", "synthesis"],
    "default": ["identity", "clock", "local_state", "news", "cross_market", "positioning", "synthesis"],
}


def outlook_branch() -> Column:
    return F.when((F.col("session") == "structural") | F.col("horizon").isin("60d", "12m"), "structural").when(F.col("event_state") == "confirmed_material", "confirmed").when(F.col("event_state") == "rumor", "rumor").when(F.col("session") == "premarket", "premarket").otherwise("default")


def outlook_plan(asked: DataFrame) -> DataFrame:
    """The ordered stages for rows of (horizon, session, event_state)."""
    orders = F.create_map(*[x for k, v in ORDERS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    return asked.withColumn("branch", outlook_branch()).select(*asked.columns, "branch", F.posexplode(orders[F.col("branch")]).alias("position", "stage"))


def asked_outlooks(spark: SparkSession) -> DataFrame:
    one = lambda name, xs: spark.createDataFrame([(x,) for x in xs], f"{name} string")
    return one("horizon", ["1d", "5d", "20d", "60d", "12m"]).crossJoin(one("session", ["premarket", "intraday", "after_close", "structural"])).crossJoin(one("event_state", ["unknown", "rumor", "confirmed_material"]))
