"""Timing states over several time frames, and their walk-forward test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import pct_gap, rate, ratio, rnd
from .timeseries import TIMING_HISTORY, by_date, trend, weekly

ENTRY_STATES = ("triggered", "retest")


def value_or_close(name: str) -> Column:
    return F.when(F.col(name) > 0, F.col(name)).otherwise(F.col("close"))


def daily_measures(bars: DataFrame) -> DataFrame:
    """ATR, prior channels, volume ratio, on-balance direction and daily trend of every bar; prior windows end a bar before."""
    w = by_date()
    rows = lambda a, b: w.rowsBetween(a, b)
    b = bars.withColumns({"hi": value_or_close("high"), "lo": value_or_close("low")}).withColumns({"rn": F.row_number().over(w), "pc": F.lag("close").over(w)})
    tr = F.greatest(F.col("hi") - F.col("lo"), F.abs(F.col("hi") - F.col("pc")), F.abs(F.col("lo") - F.col("pc")))
    volume = F.coalesce(F.col("volume"), F.lit(0.0))
    delta = F.when(F.col("close") > F.col("pc"), volume).when(F.col("close") < F.col("pc"), -volume).otherwise(0.0)
    b = b.withColumns({"tr": tr, "delta": F.when(F.col("pc").isNotNull(), delta)})
    after = lambda n, x: F.when(F.col("rn") >= n, x)
    b = b.withColumns({
        "atr20": after(21, F.avg("tr").over(rows(-19, 0))), "high20": after(21, F.max("hi").over(rows(-20, -1))), "low20": after(21, F.min("lo").over(rows(-20, -1))),
        "high55": after(56, F.max("hi").over(rows(-55, -1))), "low55": after(56, F.min("lo").over(rows(-55, -1))), "low10": after(11, F.min("lo").over(rows(-10, -1))),
        "volume_ratio": ratio(F.col("volume"), F.avg("volume").over(rows(-20, -1))), "obv": after(11, ratio(F.sum("delta").over(rows(-9, 0)), F.sum(F.abs("delta")).over(rows(-9, 0)))),
        "ma20": F.avg("close").over(rows(-19, 0)), "ma60": F.avg("close").over(rows(-59, 0)), "ma20_5": F.avg("close").over(rows(-24, -5)),
    })
    obv = F.when(F.col("rn") < 11, "unknown").when(F.col("obv") > 0.15, "rising").when(F.col("obv") < -0.15, "falling").otherwise("flat")
    daily = trend(F.col("close"), F.col("ma20"), F.col("ma60"), pct_gap(F.col("ma20"), F.col("ma20_5")), F.col("rn") >= 65)
    broke = F.when(F.col("close") > F.col("high20"), F.struct(F.col("rn").alias("at"), F.col("high20").alias("level")))
    b = b.withColumns({"obv_direction": obv, "daily_state": daily, "broke": broke})
    return b.withColumn("recent", F.last("broke", ignorenulls=True).over(rows(-10, -1))).drop("tr", "delta", "broke", "pc")


def weekly_state(bars: DataFrame) -> DataFrame:
    """(code, date, weekly_state): the trend over completed weeks at every bar.

    From Friday on the week under way counts with the day's close; before, it does not. Means are added up from the
    newest week to the oldest, as equal means are told apart by the last bit.
    """
    newest = Window.partitionBy("code").orderBy(F.desc("date"))
    weeks = weekly(bars).select("code", "iso_year", "iso_week", F.collect_list(F.struct("close")).over(newest.rowsBetween(1, 23)).alias("earlier"))
    day = bars.select("code", "date", "close", F.extract(F.lit("YEAROFWEEK"), F.col("date")).cast("int").alias("iso_year"), F.weekofyear("date").alias("iso_week"))
    own = F.when(F.weekday("date") >= 4, F.array(F.struct("close"))).otherwise(F.array().cast("array<struct<close: double>>"))
    j = day.join(weeks, ["code", "iso_year", "iso_week"]).select("code", "date", F.transform(F.concat(own, "earlier"), lambda x: x["close"]).alias("closes"))

    def mean(first: int, count: int) -> Column:
        held = F.filter(F.slice("closes", first, count), lambda x: x.isNotNull())
        return F.try_divide(F.aggregate(held, F.lit(0.0), lambda t, x: t + x), F.size(held))

    j = j.withColumns({"fast": mean(1, 10), "slow": mean(1, 20), "past": mean(4, 10)})
    return j.select("code", "date", trend(F.get("closes", F.lit(0)), F.col("fast"), F.col("slow"), pct_gap(F.col("fast"), F.col("past")), F.size("closes") >= 23).alias("weekly_state"))


def states(bars: DataFrame) -> DataFrame:
    """The timing state and stop of every bar of TIMING_HISTORY or more."""
    d = daily_measures(bars).join(weekly_state(bars), ["code", "date"]).where(F.col("rn") >= TIMING_HISTORY)
    c, level = F.col("close"), F.col("recent.level")
    retest = F.coalesce((F.col("lo") <= level * 1.015) & (c >= level) & (F.col("ma20") <= c), F.lit(False))
    failed = F.coalesce(c < level * 0.98, F.lit(False))
    gap = rnd(pct_gap(c, F.col("ma20")), 6)
    stretch = F.when((F.col("atr20") > 0) & (c > F.col("high20")), (c - F.col("high20")) / F.col("atr20"))
    extended = F.coalesce(gap > 8, F.lit(False)) | F.coalesce(stretch > 2, F.lit(False))
    near = F.coalesce(pct_gap(c, F.col("high20")).between(-2.5, 0), F.lit(False))
    broke20, broke55 = F.coalesce(c > F.col("high20"), F.lit(False)), F.coalesce(c > F.col("high55"), F.lit(False))
    confirmed = F.coalesce((F.col("volume_ratio") >= 1.2) | ((F.col("volume_ratio") >= 1.0) & (F.col("obv_direction") == "rising")), F.lit(False))
    wk, dy = F.col("weekly_state"), F.col("daily_state")
    bull = wk == "bullish"
    state = (
        F.when(failed | (wk == "bearish") | ((dy == "bearish") & (c < F.col("ma60"))), "blocked").when(extended & bull, "extended").when(retest & bull & (dy != "bearish"), "retest")
        .when((broke20 | broke55) & bull & (dy == "bullish"), F.when(confirmed, "triggered").otherwise("triggered_unconfirmed")).when(bull & (dy != "bearish") & near, "watch")
        .when(bull & (dy == "bullish"), "trend_only").when((bull & (dy == "bearish")) | ((wk == "bearish") & (dy == "bullish")), "mixed").otherwise("no_setup")
    )
    valid = lambda x: F.when((x > 0) & (x < c), x)
    stop = F.greatest(valid(F.when(F.col("atr20") > 0, c - 2 * F.col("atr20"))), valid(F.col("low10")))
    return d.withColumns({"retest": retest, "failed_breakout": failed, "near_breakout": near, "volume_confirmed": confirmed, "state": state, "stop": stop}).withColumns({
        "risk_distance_pct": -pct_gap(c, F.col("stop")), "review_2r": c + 2 * (c - F.col("stop"))})


def candidates(bars: DataFrame, timed: DataFrame, horizon: int = 20, slippage_bps: float = 10.0, states_in: tuple[str, ...] = ENTRY_STATES, start: str | None = None) -> DataFrame:
    """Every bar whose state allows an entry at the next open, with its exit: the first stop within the horizon, else its last close.

    A bounded look-ahead window holds the horizon's bars; entries without a whole horizon, or whose stop is not below the open, are left out.
    """
    w = by_date().rowsBetween(1, horizon)
    ahead = bars.select("code", "date", F.collect_list(F.struct("date", "open", "low", "close")).over(w).alias("ahead"))
    slip = slippage_bps / 10000
    s = timed.where(F.col("state").isin(*states_in))
    if start is not None:
        s = s.where(F.col("date") >= F.lit(start).cast("date"))
    c = s.join(ahead, ["code", "date"]).where(F.size("ahead") == horizon).withColumn("entry_open", F.col("ahead")[0]["open"])
    stop = rnd("stop", 6)
    c = c.withColumn("stop", stop).where((F.col("stop") > 0) & (F.col("stop") < F.col("entry_open")))
    k = F.array_position(F.transform("ahead", lambda x: ((x["open"] <= F.col("stop")) | (x["low"] <= F.col("stop"))).cast("int")), 1).cast("int")
    c = c.withColumn("hit", k).withColumn("held", F.when(F.col("hit") > 0, F.col("hit")).otherwise(horizon)).withColumn("exit", F.element_at("ahead", F.col("held").cast("int")))
    gap = (F.col("hit") > 0) & (F.col("exit.open") <= F.col("stop"))
    price = F.when(gap, F.col("exit.open")).when(F.col("hit") > 0, F.col("stop")).otherwise(F.col("exit.close"))
    return c.select(
        "code", "sector", F.col("date").alias("signal_date"), "rn", "state", F.col("ahead")[0]["date"].alias("entry_date"), F.col("exit.date").alias("exit_date"), (F.col("rn") + F.col("held")).alias("exit_rn"),
        F.col("held").cast("long").alias("holding_sessions"), (F.col("entry_open") * (1 + slip)).alias("entry_price"), "stop", (price * (1 - slip)).alias("exit_price"),
        F.when(gap, "gap_through_stop").when(F.col("hit") > 0, "intraday_stop").otherwise("horizon_close").alias("exit_reason"),
    )


def non_overlapping(entries: DataFrame) -> DataFrame:
    """Of each code's entries in order, those that begin after the last one taken has ended: a fold over the code's sorted list."""
    listed = entries.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("rn", "exit_rn"))).alias("e"))
    start = F.struct(F.lit(0).cast("int").alias("free"), F.array().cast("array<int>").alias("taken"))
    step = lambda a, x: F.when(x["rn"] >= a["free"], F.struct((x["exit_rn"] + 1).cast("int").alias("free"), F.array_append(a["taken"], x["rn"].cast("int")).alias("taken"))).otherwise(a)
    taken = listed.select("code", F.explode(F.aggregate("e", start, step, lambda a: a["taken"])).alias("rn"))
    return entries.join(taken, ["code", "rn"], "left_semi")


def trades(bars: DataFrame, entries: DataFrame, cost_bps: float = 20.0) -> DataFrame:
    """Non-overlapping trades against their sector on the same days; those whose days the sector lacks are dropped after they took their place."""
    sector = bars.where("role = 'sector'")
    first = sector.select("sector", F.col("date").alias("entry_date"), F.coalesce(F.when(F.col("open") > 0, F.col("open")), F.col("close")).alias("b0"))
    last = sector.select("sector", F.col("date").alias("exit_date"), F.col("close").alias("b1"))
    t = non_overlapping(entries).join(first, ["sector", "entry_date"]).join(last, ["sector", "exit_date"])
    gross = (F.col("exit_price") / F.col("entry_price") - 1) * 100
    net, bench = gross - cost_bps / 100, (F.col("b1") / F.col("b0") - 1) * 100
    r = lambda c, n: rnd(c, n)
    return t.select(
        "code", "sector", "signal_date", "entry_date", "exit_date", "state", r(F.col("entry_price"), 6).alias("entry_price"), F.col("stop").alias("stop_reference"), r(F.col("exit_price"), 6).alias("exit_price"), "exit_reason",
        "holding_sessions", r(gross, 4).alias("gross_return_pct"), r(net, 4).alias("net_return_pct"), r(bench, 4).alias("benchmark_return_pct"), r(net - bench, 4).alias("excess_return_pct"),
    )


def trade_metrics(done: DataFrame, by: str = "code") -> DataFrame:
    net = F.col("net_return_pct")
    gains, losses = F.sum(F.when(net > 0, net).otherwise(0.0)), F.abs(F.sum(F.when(net < 0, net).otherwise(0.0)))
    factor = F.when(losses == 0, F.when(gains > 0, 999.0)).otherwise(rnd(F.try_divide(gains, losses), 4))
    run = F.array_sort(F.collect_list(F.struct("signal_date", "code", "net_return_pct")))
    start = F.struct(F.lit(1.0).alias("equity"), F.lit(1.0).alias("peak"), F.lit(0.0).alias("worst"))

    def step(a, x):
        e = a["equity"] * (1 + x["net_return_pct"] / 100)
        p = F.greatest(a["peak"], e)
        return F.struct(e.alias("equity"), p.alias("peak"), F.least(a["worst"], e / p - 1).alias("worst"))

    return done.groupBy(by).agg(
        F.count("*").alias("trades"), rate(net > 0).alias("hit_rate"), rate(F.col("excess_return_pct") > 0).alias("excess_hit_rate"), rnd(F.avg(net), 4).alias("mean_net_return_pct"),
        rnd(F.median(net), 4).alias("median_net_return_pct"), rnd(F.avg("excess_return_pct"), 4).alias("mean_excess_return_pct"), factor.alias("profit_factor"),
        rnd(F.aggregate(run, start, step, lambda a: a["worst"]) * 100, 4).alias("trade_sequence_max_drawdown_pct"), rate(F.col("exit_reason") != "horizon_close").alias("stop_exit_rate"),
    )


def timing_gate(metrics: DataFrame, start: str | None) -> DataFrame:
    ok = lambda c: F.coalesce(c, F.lit(False))
    checks = {
        "start_supplied": F.lit(bool(start)), "enough_trades": F.col("trades") >= 20, "positive_net": ok(F.col("mean_net_return_pct") > 0), "positive_excess": ok(F.col("mean_excess_return_pct") > 0),
        "hit_rate_ok": ok(F.col("hit_rate") >= 0.45), "profit_factor_ok": ok(F.col("profit_factor") > 1),
    }
    every = checks["start_supplied"]
    for c in list(checks.values())[1:]:
        every = every & c
    return metrics.withColumns(checks).withColumn("status", F.when(every, "usable").otherwise("abstain"))
