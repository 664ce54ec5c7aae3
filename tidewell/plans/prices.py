"""Queries over bars: cleaning, windows, factors, scores, walk-forward tests and timing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import rnd

from ..operators import backtest, scoring, timeseries, timing
from ..sources import panels
from . import sql
from .cuts import cut

START = "1999-01-01"

# --- Spark side ---


def _features(spark, d) -> DataFrame:
    return cut(timeseries.features(panels.bars(spark, d)))  # days times codes, read by several branches


def bars_unit_price(spark, d):
    """Open, high, low, close of unit prices straight from the lines; open and close by a total order of lines."""
    lines = panels.table(spark, d, "lineitem")
    parts = panels.table(spark, d, "part").select("p_partkey", "p_brand")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).groupBy(F.col("p_brand").alias("code"), F.to_date("l_shipdate").alias("date")).agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"), F.sum(F.col("l_quantity").cast("long")).alias("volume")
    )


def bars_daily(spark, d):
    return panels.bars(spark, d)


def bars_clean(spark, d):
    """Cleaning of a raw feed: several rows a day, some closes missing or negative, some volumes missing; the last ingested wins."""
    lines = panels.table(spark, d, "lineitem")
    parts = panels.table(spark, d, "part").select("p_partkey", "p_brand")
    n = F.col("l_linenumber")
    raw = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(
        F.col("p_brand").alias("code"), F.to_date("l_shipdate").cast("string").alias("date"), F.col("l_extendedprice").alias("open"),
        F.when(n == 7, -1.0).when(n == 6, F.lit(None)).when(n == 5, F.lit("nan").cast("double")).otherwise(F.col("l_extendedprice")).alias("close"),
        F.when(n != 4, F.col("l_quantity")).alias("volume"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("ingest_seq"),
    )
    return timeseries.clean_bars(raw, "2000-12-31").drop("ingest_seq")


def bars_weekly(spark, d):
    return timeseries.weekly(panels.bars(spark, d))


def weekly_completed_state(spark, d):
    return timing.weekly_state(panels.bars(spark, d).where("role = 'stock'"))


def _pick(*cols):
    def query(spark, d):
        return _features(spark, d).select("code", "date", *cols)

    return query


def feature_vector(spark, d):
    return _features(spark, d).drop("raw_ma20", "raw_ma60", "role")


def stock_score(spark, d):
    return scoring.stock_scores(_features(spark, d)).select("code", "date", *scoring.STOCK_WEIGHTS, "score", "coverage")


def score_explain(spark, d):
    s = scoring.explanations(scoring.stock_scores(_features(spark, d)))
    return s.groupBy("code").agg(*[F.max_by(c, "date").alias(c) for c in ("strengths", "risks", "score")], F.max("date").alias("date"))


def breadth_by_date(spark, d):
    return scoring.breadth(_features(spark, d))


def sector_score(spark, d):
    return scoring.sector_scores(_features(spark, d)).select("sector", "date", "score_5d", "coverage_5d", "regime_5d", "score_20d", "coverage_20d", "regime_20d")


def sector_regime(spark, d):
    return sector_score(spark, d).groupBy("sector", "regime_5d", "regime_20d").agg(F.count("*").alias("days"), F.count_if(F.col("regime_5d") != F.col("regime_20d")).alias("contradictions"))


def rank_top_n(spark, d, top_n: int = 3):
    """The flagship: the best stocks of each sector on its last day, by factor score against the sector."""
    f = _features(spark, d)
    last = f.where("role = 'sector'").groupBy("sector").agg(F.max("date").alias("as_of"))
    r = scoring.ranked(scoring.stock_scores(scoring.as_of_features(f, last)), ["sector", "as_of"])
    return r.where(F.col("rank") <= top_n).select("sector", "as_of", "code", "rank", "score", "coverage", F.col("date").alias("bar_date"), F.datediff("as_of", "date").alias("stale_days"))


def rank_exclusions(spark, d):
    """Why a series is not ranked: risk names, benchmarks, short history, low coverage."""
    parts = panels.table(spark, d, "part").groupBy(F.col("p_brand").alias("code")).agg(F.min("p_name").alias("name"))
    panel = panels.bars(spark, d)
    bars = panel.groupBy("role", "code").agg(F.count("*").alias("bars"))
    s = scoring.stock_scores(timeseries.features(panel)).groupBy("code").agg(F.max_by("coverage", "date").alias("coverage"))
    j = bars.join(parts, "code", "left").join(s, "code", "left")
    risky = F.coalesce(F.upper("name").contains("ST") | F.col("name").contains("退"), F.lit(False))
    reason = F.when(F.col("role") != "stock", "benchmark").when(risky, "risk name").when(F.col("bars") < timeseries.FACTOR_HISTORY, "insufficient history").when(F.coalesce("coverage", F.lit(0.0)) < scoring.LEAST_COVERAGE, "coverage")
    return j.withColumn("reason", reason).where("reason IS NOT NULL").select("code", "bars", "reason")


def _observations(spark, d):
    b = panels.bars(spark, d)
    return cut(backtest.selector_observations(b, cut(timeseries.features(b))))


def selector_observations(spark, d):
    return _observations(spark, d).drop("raw_net", "raw_benchmark")


def selector_periods(spark, d):
    return backtest.selector_periods(_observations(spark, d))


def selector_metrics(spark, d):
    return backtest.selector_metrics(_observations(spark, d))


def selector_buckets(spark, d):
    return backtest.score_buckets(_observations(spark, d), "future_net_return_pct", ["sector"])


def _sector(spark, d):
    b = panels.bars(spark, d)
    s = cut(scoring.sector_scores(cut(timeseries.features(b))))
    return cut(backtest.sector_observations(b, s)), s


def sector_signal_observations(spark, d):
    return _sector(spark, d)[0]


def sector_signal_buckets(spark, d):
    return backtest.score_buckets(_sector(spark, d)[0], "net_return_pct", ["sector"])


def sector_signal_gate(spark, d):
    return backtest.sector_gate(*_sector(spark, d))


def _measures(*cols):
    def query(spark, d):
        m = timing.daily_measures(panels.bars(spark, d)).where("role = 'stock'")
        return m.select("code", "date", *cols)

    return query


def atr20(spark, d):
    return _measures("atr20")(spark, d).withColumn("atr20", rnd("atr20", 6))


def recent_breakout(spark, d):
    m = timing.daily_measures(panels.bars(spark, d)).where("role = 'stock' AND recent IS NOT NULL")
    return m.select("code", "date", (F.col("rn") - F.col("recent.at")).cast("long").alias("sessions_ago"), rnd("recent.level", 6).alias("level"))


def _states(spark, d):
    return timing.states(panels.bars(spark, d).where("role = 'stock'"))


def timing_state(spark, d):
    return _states(spark, d).select("code", "date", "state", "daily_state", "weekly_state", "retest", "failed_breakout", "near_breakout", "volume_confirmed")


def timing_risk(spark, d):
    return _states(spark, d).select("code", "date", *[rnd(c, 6).alias(c) for c in ("atr20", "stop", "risk_distance_pct", "review_2r")])


def _entries(spark, d):
    b = panels.bars(spark, d)
    stocks = b.where("role = 'stock'")
    return b, timing.candidates(stocks, timing.states(stocks), start=START)


def timing_candidates(spark, d):
    c = _entries(spark, d)[1]
    return c.select("code", "signal_date", "state", "entry_date", "exit_date", "holding_sessions", rnd("entry_price", 6).alias("entry_price"), "stop", rnd("exit_price", 6).alias("exit_price"), "exit_reason")


def timing_trades(spark, d):
    return timing.trades(*_entries(spark, d))


def timing_metrics(spark, d):
    return timing.trade_metrics(timing_trades(spark, d))


def timing_gate(spark, d):
    return timing.timing_gate(timing_metrics(spark, d), START).select("code", "trades", "start_supplied", "enough_trades", "positive_net", "positive_excess", "hit_rate_ok", "profit_factor_ok", "status")


# --- SQL side ---

_W = sql.with_(sql.BARS)
_F = sql.with_(sql.BARS, sql.FEATURES)


def _sql_parts(trend, other) -> dict[str, str]:
    parts = {k: sql.scaled(c, a, b) for k, (c, a, b) in scoring.MOMENTUM.items()}
    parts["trend"] = sql.mean_of([sql.scaled(c, a, b) for c, a, b in trend])
    return parts | {k: sql.scaled(c, a, b, i) for k, (c, a, b, i) in other.items()}


_STOCK = _sql_parts(scoring.STOCK_TREND, scoring.STOCK_OTHER)
_SCORE, _COVER = sql.weighted({k: _STOCK[k] for k in scoring.STOCK_WEIGHTS}, scoring.STOCK_WEIGHTS)
_SCORED = f"""scored AS (SELECT *, {', '.join(f'round({_STOCK[k]}, 3) AS {k}' for k in scoring.STOCK_WEIGHTS)}, {_SCORE} AS score, {_COVER} AS coverage FROM features WHERE role = 'stock')"""
_BREADTH = """members AS (SELECT DISTINCT sector, code FROM features WHERE role = 'stock'),
breadth AS (
  SELECT sector, date, count(*) AS eligible_count, round(100.0::DOUBLE * count(*) FILTER (close > raw_ma20) / count(*), 3) AS above_ma20_pct,
         round(100.0::DOUBLE * count(*) FILTER (close > raw_ma60) / count(*), 3) AS above_ma60_pct, round(100.0::DOUBLE * count(*) FILTER (return_20d_pct > 0) / count(*), 3) AS positive_20d_pct
  FROM (SELECT q.sector, q.as_of AS date, f.close, f.raw_ma20, f.raw_ma60, f.return_20d_pct FROM (SELECT s.sector, s.date AS as_of, m.code FROM features s JOIN members m ON s.sector = m.sector WHERE s.role = 'sector') q
        ASOF JOIN (SELECT * FROM features WHERE role = 'stock') f ON q.code = f.code AND q.as_of >= f.date) GROUP BY 1, 2)"""
_SECT = _sql_parts(scoring.SECTOR_TREND, scoring.SECTOR_OTHER)
_S5, _C5 = sql.weighted(_SECT, scoring.SHORT_WEIGHTS)
_S20, _C20 = sql.weighted(_SECT, scoring.SWING_WEIGHTS)
_SECTOR = f"""sector_scored AS (
  SELECT f.sector, f.date, {_S5} AS score_5d, {_C5} AS coverage_5d, {_S20} AS score_20d, {_C20} AS coverage_20d
  FROM features f LEFT JOIN breadth b ON f.sector = b.sector AND f.date = b.date WHERE f.role = 'sector')"""
_SECTOR_ALL = sql.with_(sql.BARS, sql.FEATURES, _BREADTH, _SECTOR)
_FWD = "fwd AS (SELECT *, lead(close, 20) OVER w AS later, lead(date, 20) OVER w AS later_date, count(*) OVER (PARTITION BY code) AS n FROM base WINDOW w AS (PARTITION BY code ORDER BY date))"
_OBS = f"""{_FWD},
eval AS (SELECT sector, date AS as_of, (later / close - 1) * 100 AS bench FROM fwd WHERE role = 'sector' AND rn >= 80 AND rn <= n - 20 AND (rn - 80) % 5 = 0),
asked2 AS (SELECT e.sector, e.as_of, m.code FROM eval e JOIN (SELECT DISTINCT sector, code FROM features WHERE role = 'stock') m ON e.sector = m.sector),
known AS (SELECT a.sector, a.as_of, a.code, s.date, s.score, s.coverage FROM asked2 a ASOF JOIN scored s ON a.code = s.code AND a.as_of >= s.date),
ranked AS (SELECT *, row_number() OVER (PARTITION BY sector, as_of ORDER BY score DESC, code DESC) AS rank FROM known WHERE score IS NOT NULL AND coverage >= 0.75),
obs AS (
  SELECT r.sector, r.as_of, r.code, r.rank, r.score, (f.later / f.close - 1) * 100 - 0.2::DOUBLE AS raw_net, e.bench AS raw_benchmark, round((f.later / f.close - 1) * 100, 4) AS future_gross_return_pct,
         round((f.later / f.close - 1) * 100 - 0.2::DOUBLE, 4) AS future_net_return_pct, round(e.bench, 4) AS benchmark_return_pct, round((f.later / f.close - 1) * 100 - 0.2::DOUBLE - e.bench, 4) AS excess_return_pct
  FROM ranked r JOIN eval e ON r.sector = e.sector AND r.as_of = e.as_of JOIN fwd f ON r.code = f.code AND r.date = f.date WHERE r.rank <= 3 AND f.later IS NOT NULL)"""
_OBS_ALL = sql.with_(sql.BARS, sql.FEATURES, _SCORED, _OBS)
_PERIODS = """periods AS (SELECT sector, as_of, count(*) AS holdings, round(avg(raw_net), 4) AS portfolio_net_return_pct, round(max(raw_benchmark), 4) AS benchmark_return_pct, round(avg(raw_net) - max(raw_benchmark), 4) AS excess_return_pct FROM obs GROUP BY 1, 2)"""


def _bands(src: str, net: str) -> str:
    return f"""SELECT sector, {sql.bucket('score')} AS bucket, count(*) AS observations, round(avg(({net} > 0)::INT), 4) AS historical_up_rate, round(avg((excess_return_pct > 0)::INT), 4) AS historical_excess_hit_rate,
      round(avg({net}), 4) AS mean_net_return_pct, round(avg(excess_return_pct), 4) AS mean_excess_return_pct, count(*) >= 30 AS probability_publishable FROM {src} GROUP BY 1, 2"""


_SIG = f"""{_FWD},
sig AS (
  SELECT f.sector, f.date, f.later_date, s.score_20d AS score, round((f.later / f.close - 1) * 100 - 0.2::DOUBLE, 4) AS net_return_pct,
         round((f.later / f.close - 1) * 100 - 0.2::DOUBLE - (b.close / a.close - 1) * 100, 4) AS excess_return_pct
  FROM fwd f JOIN bars a ON a.role = 'market' AND a.date = f.date JOIN bars b ON b.role = 'market' AND b.date = f.later_date JOIN sector_scored s ON s.sector = f.sector AND s.date = f.date
  WHERE f.role = 'sector' AND f.rn >= 80 AND f.rn <= f.n - 20 AND (f.rn - 80) % 20 = 0 AND s.score_20d IS NOT NULL)"""
_SIG_ALL = sql.with_(sql.BARS, sql.FEATURES, _BREADTH, _SECTOR, _SIG)

_DAYS = """
day0 AS (SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS pc FROM bars WHERE role = 'stock' WINDOW w AS (PARTITION BY code ORDER BY date)),
day1 AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, CASE WHEN pc IS NULL THEN NULL WHEN close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END AS delta FROM day0),
day2 AS (
  SELECT *, CASE WHEN rn >= 21 THEN avg(tr) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS atr20,
    CASE WHEN rn >= 21 THEN max(high) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS high20, CASE WHEN rn >= 21 THEN min(low) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS low20,
    CASE WHEN rn >= 56 THEN max(high) OVER (w ROWS BETWEEN 55 PRECEDING AND 1 PRECEDING) END AS high55, CASE WHEN rn >= 56 THEN min(low) OVER (w ROWS BETWEEN 55 PRECEDING AND 1 PRECEDING) END AS low55,
    CASE WHEN rn >= 11 THEN min(low) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END AS low10, volume / nullif(avg(volume) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) AS volume_ratio,
    CASE WHEN rn >= 11 THEN sum(delta) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) / nullif(sum(abs(delta)) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 0) END AS obv,
    avg(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ma20, avg(close) OVER (w ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS ma60, avg(close) OVER (w ROWS BETWEEN 24 PRECEDING AND 5 PRECEDING) AS ma20_5
  FROM day1 WINDOW w AS (PARTITION BY code ORDER BY date)),
day3 AS (
  SELECT *, CASE WHEN rn < 11 THEN 'unknown' WHEN obv > 0.15 THEN 'rising' WHEN obv < -0.15 THEN 'falling' ELSE 'flat' END AS obv_direction,
    CASE WHEN rn < 65 THEN 'insufficient_data' WHEN close > ma20 AND ma20 > ma60 AND ma20 / ma20_5 > 1 THEN 'bullish' WHEN close < ma20 AND ma20 < ma60 AND ma20 / ma20_5 < 1 THEN 'bearish' ELSE 'mixed' END AS daily_state,
    CASE WHEN close > high20 THEN rn END AS brk FROM day2),
day4 AS (SELECT *, max(brk) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS recent_at FROM day3),
days AS (SELECT a.*, b.high20 AS level FROM day4 a LEFT JOIN day4 b ON a.code = b.code AND b.rn = a.recent_at)"""
_WEEKS = """
wk AS (SELECT code, isoyear(date) AS iso_year, week(date) AS iso_week, max(date) AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume, count(*) AS sessions FROM bars {where} GROUP BY 1, 2, 3)"""
_WSTATE = _WEEKS.format(where="WHERE role = 'stock'") + """,
series AS (
  SELECT b.code, b.date, w.date AS wdate, CASE WHEN w.iso_year = isoyear(b.date) AND w.iso_week = week(b.date) THEN b.close ELSE w.close END AS c,
         row_number() OVER (PARTITION BY b.code, b.date ORDER BY w.date DESC) AS back, count(*) OVER (PARTITION BY b.code, b.date) AS n
  FROM bars b JOIN wk w ON b.code = w.code AND (w.iso_year * 100 + w.iso_week < isoyear(b.date) * 100 + week(b.date) OR (isodow(b.date) >= 5 AND w.iso_year = isoyear(b.date) AND w.iso_week = week(b.date)))
  WHERE b.role = 'stock'),
wmeans AS (
  SELECT code, date, max(n) AS n, max(c) FILTER (back = 1) AS c, avg(c) FILTER (back <= 10) AS fast, avg(c) FILTER (back <= 20) AS slow, avg(c) FILTER (back BETWEEN 4 AND 13) AS past FROM series WHERE back <= 23 GROUP BY 1, 2),
wstate AS (
  SELECT b.code, b.date, CASE WHEN m.n IS NULL OR m.n < 23 THEN 'insufficient_data' WHEN m.c > m.fast AND m.fast > m.slow AND m.fast / m.past > 1 THEN 'bullish'
         WHEN m.c < m.fast AND m.fast < m.slow AND m.fast / m.past < 1 THEN 'bearish' ELSE 'mixed' END AS weekly_state
  FROM bars b LEFT JOIN wmeans m ON b.code = m.code AND b.date = m.date WHERE b.role = 'stock')"""
_STATES = """
st0 AS (
  SELECT d.*, w.weekly_state, coalesce(low <= level * 1.015::DOUBLE AND close >= level AND ma20 <= close, false) AS retest, coalesce(close < level * 0.98::DOUBLE, false) AS failed_breakout,
    coalesce((close / high20 - 1) * 100 BETWEEN -2.5 AND 0, false) AS near_breakout, coalesce(volume_ratio >= 1.2 OR (volume_ratio >= 1.0 AND obv_direction = 'rising'), false) AS volume_confirmed,
    coalesce(round((close / ma20 - 1) * 100, 6) > 8, false) OR coalesce(CASE WHEN atr20 > 0 AND close > high20 THEN (close - high20) / atr20 END > 2, false) AS extended,
    coalesce(close > high20, false) OR coalesce(close > high55, false) AS broke,
    greatest(CASE WHEN atr20 > 0 AND close - 2 * atr20 > 0 AND close - 2 * atr20 < close THEN close - 2 * atr20 END, CASE WHEN low10 > 0 AND low10 < close THEN low10 END) AS stop
  FROM days d JOIN wstate w ON d.code = w.code AND d.date = w.date WHERE d.rn >= 120),
states AS (
  SELECT *, CASE WHEN failed_breakout OR weekly_state = 'bearish' OR (daily_state = 'bearish' AND close < ma60) THEN 'blocked' WHEN weekly_state <> 'bullish' THEN 'no_setup'
    WHEN extended THEN 'extended' WHEN retest AND daily_state <> 'bearish' THEN 'retest' WHEN broke AND daily_state = 'bullish' THEN CASE WHEN volume_confirmed THEN 'triggered' ELSE 'triggered_unconfirmed' END
    WHEN daily_state <> 'bearish' AND near_breakout THEN 'watch' WHEN daily_state = 'bullish' THEN 'trend_only' WHEN daily_state = 'bearish' THEN 'mixed' ELSE 'no_setup' END AS state,
    (1 - close / stop) * 100 AS risk_raw FROM st0)"""
_STATES_ALL = sql.with_(sql.BARS, _DAYS, _WSTATE, _STATES)
_CAND = f"""
sig AS (SELECT s.code, s.sector, s.date, s.rn, s.state, round(s.stop, 6) AS stop FROM states s WHERE s.state IN ('triggered', 'retest') AND s.date >= DATE '{START}'),
look AS (
  SELECT s.*, b.rn AS brn, b.date AS bdate, b.open AS bopen, b.low AS blow, b.close AS bclose, b.open <= s.stop OR b.low <= s.stop AS hit FROM sig s JOIN days b ON s.code = b.code AND b.rn BETWEEN s.rn + 1 AND s.rn + 20),
pick AS (
  SELECT code, date, arg_min(bopen, brn) AS entry_open, arg_min(bdate, brn) AS entry_date, count(*) AS n, coalesce(min(brn) FILTER (hit), max(brn)) AS exit_rn, bool_or(hit) AS stopped FROM look GROUP BY 1, 2),
cand AS (
  SELECT s.code, s.sector, s.date AS signal_date, s.rn, s.state, p.entry_date, l.bdate AS exit_date, p.exit_rn, p.exit_rn - s.rn AS holding_sessions, p.entry_open * (1 + 0.001::DOUBLE) AS entry_price, s.stop,
    CASE WHEN p.stopped AND l.bopen <= s.stop THEN l.bopen WHEN p.stopped THEN s.stop ELSE l.bclose END * (1 - 0.001::DOUBLE) AS exit_price,
    CASE WHEN p.stopped AND l.bopen <= s.stop THEN 'gap_through_stop' WHEN p.stopped THEN 'intraday_stop' ELSE 'horizon_close' END AS exit_reason
  FROM sig s JOIN pick p ON s.code = p.code AND s.date = p.date JOIN look l ON l.code = s.code AND l.date = s.date AND l.brn = p.exit_rn WHERE p.n = 20 AND s.stop > 0 AND s.stop < p.entry_open)"""
_CAND_ALL = sql.with_(sql.BARS, _DAYS, _WSTATE, _STATES, _CAND)
_TRADES = """
nxt AS (SELECT c.code, c.rn, min(n.rn) AS next_rn FROM cand c LEFT JOIN cand n ON c.code = n.code AND c.exit_rn < n.rn GROUP BY 1, 2),
taken(code, rn) AS (SELECT code, min(rn) FROM cand GROUP BY code UNION ALL SELECT n.code, n.next_rn FROM taken t JOIN nxt n ON t.code = n.code AND t.rn = n.rn WHERE n.next_rn IS NOT NULL),
trades AS (
  SELECT c.code, c.sector, c.signal_date, c.entry_date, c.exit_date, c.state, round(c.entry_price, 6) AS entry_price, c.stop AS stop_reference, round(c.exit_price, 6) AS exit_price, c.exit_reason, c.holding_sessions,
    round((c.exit_price / c.entry_price - 1) * 100, 4) AS gross_return_pct, round((c.exit_price / c.entry_price - 1) * 100 - 0.2::DOUBLE, 4) AS net_return_pct, round((y.close / x.open - 1) * 100, 4) AS benchmark_return_pct,
    round((c.exit_price / c.entry_price - 1) * 100 - 0.2::DOUBLE - (y.close / x.open - 1) * 100, 4) AS excess_return_pct
  FROM cand c JOIN taken t ON c.code = t.code AND c.rn = t.rn JOIN bars x ON x.code = c.sector AND x.date = c.entry_date JOIN bars y ON y.code = c.sector AND y.date = c.exit_date)"""
_TRADES_ALL = "WITH RECURSIVE " + ",".join([sql.BARS, _DAYS, _WSTATE, _STATES, _CAND, _TRADES])
_EQUITY = """
eq AS (SELECT *, exp(sum(ln(1 + net_return_pct / 100)) OVER (PARTITION BY code ORDER BY signal_date)) AS equity FROM trades),
dd AS (SELECT code, equity / greatest(1, max(equity) OVER (PARTITION BY code ORDER BY signal_date)) - 1 AS d FROM eq),
worst AS (SELECT code, round(least(0, min(d)) * 100, 4) AS trade_sequence_max_drawdown_pct FROM dd GROUP BY code),
metrics AS (
  SELECT t.code, count(*) AS trades, round(avg((net_return_pct > 0)::INT), 4) AS hit_rate, round(avg((excess_return_pct > 0)::INT), 4) AS excess_hit_rate, round(avg(net_return_pct), 4) AS mean_net_return_pct,
    round(median(net_return_pct), 4) AS median_net_return_pct, round(avg(excess_return_pct), 4) AS mean_excess_return_pct,
    CASE WHEN count(*) FILTER (net_return_pct < 0) = 0 THEN CASE WHEN sum(greatest(net_return_pct, 0)) > 0 THEN 999.0 END ELSE round(sum(greatest(net_return_pct, 0)) / abs(sum(least(net_return_pct, 0))), 4) END AS profit_factor,
    max(w.trade_sequence_max_drawdown_pct) AS trade_sequence_max_drawdown_pct, round(avg((exit_reason <> 'horizon_close')::INT), 4) AS stop_exit_rate
  FROM trades t JOIN worst w ON t.code = w.code GROUP BY t.code)"""

QUERIES = {
    "rank_top_n": (rank_top_n, sql.with_(sql.BARS, sql.FEATURES, _SCORED) + """, last AS (SELECT sector, max(date) AS as_of FROM features WHERE role = 'sector' GROUP BY 1),
      asked2 AS (SELECT l.sector, l.as_of, m.code FROM last l JOIN (SELECT DISTINCT sector, code FROM features WHERE role = 'stock') m ON l.sector = m.sector),
      r AS (SELECT a.sector, a.as_of, a.code, s.score, s.coverage, s.date, row_number() OVER (PARTITION BY a.sector ORDER BY s.score DESC, a.code DESC) AS rank FROM asked2 a ASOF JOIN scored s ON a.code = s.code AND a.as_of >= s.date WHERE s.score IS NOT NULL AND s.coverage >= 0.75)
      SELECT sector, as_of, code, rank, score, coverage, date AS bar_date, as_of - date AS stale_days FROM r WHERE rank <= 3"""),
    "bars_unit_price": (bars_unit_price, """SELECT p_brand AS code, CAST(l_shipdate AS DATE) AS date, arg_min(l_extendedprice / l_quantity, k) AS open, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
      arg_max(l_extendedprice / l_quantity, k) AS close, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume FROM (SELECT *, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""),
    "bars_daily": (bars_daily, _W + " SELECT * FROM bars"),
    "bars_clean": (bars_clean, """SELECT code, date, r.o AS open, r.c AS close, r.v AS volume FROM (
      SELECT p_brand AS code, CAST(l_shipdate AS DATE) AS date, arg_max({'o': l_extendedprice, 'c': l_extendedprice, 'v': CASE WHEN l_linenumber <> 4 THEN l_quantity END}, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) AS r
      FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber < 5 AND l_extendedprice > 0 AND CAST(l_shipdate AS DATE) <= DATE '2000-12-31' GROUP BY 1, 2)"""),
    "bars_weekly": (bars_weekly, sql.with_(sql.BARS, _WEEKS.format(where="")) + " SELECT * FROM wk"),
    "weekly_completed_state": (weekly_completed_state, sql.with_(sql.BARS, _WSTATE) + " SELECT * FROM wstate"),
    "pct_change_5_20_60": (_pick("return_5d_pct", "return_20d_pct", "return_60d_pct"), _F + " SELECT code, date, return_5d_pct, return_20d_pct, return_60d_pct FROM features"),
    "sma_structure": (_pick("ma20_gap_pct", "ma20_vs_ma60_pct", "ma20_slope_10d_pct"), _F + " SELECT code, date, ma20_gap_pct, ma20_vs_ma60_pct, ma20_slope_10d_pct FROM features"),
    "volume_ratio": (_pick("volume_20d_vs_60d"), _F + " SELECT code, date, volume_20d_vs_60d FROM features"),
    "volatility_20d": (_pick("volatility_20d_annualized_pct"), _F + " SELECT code, date, volatility_20d_annualized_pct FROM features"),
    "max_drawdown_60d": (_pick("max_drawdown_60d_pct"), _F + " SELECT code, date, max_drawdown_60d_pct FROM features"),
    "relative_strength": (_pick("relative_20d_pct", "relative_60d_pct"), _F + " SELECT code, date, relative_20d_pct, relative_60d_pct FROM features"),
    "feature_vector": (feature_vector, _F + " SELECT * EXCLUDE (raw_ma20, raw_ma60, role) FROM features"),
    "stock_score": (stock_score, sql.with_(sql.BARS, sql.FEATURES, _SCORED) + f" SELECT code, date, {', '.join(scoring.STOCK_WEIGHTS)}, score, coverage FROM scored"),
    "score_explain": (score_explain, sql.with_(sql.BARS, sql.FEATURES, _SCORED) + f""", lastly AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1),
      long AS (SELECT code, date, score, name, value FROM lastly UNPIVOT (value FOR name IN ({', '.join(scoring.STOCK_WEIGHTS)}))),
      r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY value DESC, name) AS h, row_number() OVER (PARTITION BY code ORDER BY value, name) AS l FROM long)
      SELECT code, max(date) AS date, max(score) AS score, string_agg(name, ',' ORDER BY h) FILTER (h <= 3) AS strengths, string_agg(name, ',' ORDER BY l) FILTER (l <= 3) AS risks FROM r GROUP BY code"""),
    "breadth_by_date": (breadth_by_date, sql.with_(sql.BARS, sql.FEATURES, _BREADTH) + " SELECT * FROM breadth"),
    "sector_score": (sector_score, _SECTOR_ALL + f" SELECT *, {sql.regime('score_5d')} AS regime_5d, {sql.regime('score_20d')} AS regime_20d FROM sector_scored"),
    "sector_regime": (sector_regime, _SECTOR_ALL + f" SELECT sector, {sql.regime('score_5d')} AS regime_5d, {sql.regime('score_20d')} AS regime_20d, count(*) AS days, count(*) FILTER ({sql.regime('score_5d')} <> {sql.regime('score_20d')}) AS contradictions FROM sector_scored GROUP BY 1, 2, 3"),
    "rank_exclusions": (rank_exclusions, sql.with_(sql.BARS, sql.FEATURES, _SCORED) + """, nm AS (SELECT p_brand AS code, min(p_name) AS name FROM part GROUP BY 1), cv AS (SELECT code, arg_max(coverage, date) AS coverage FROM scored GROUP BY 1),
      ct AS (SELECT role, code, count(*) AS bars FROM bars GROUP BY 1, 2)
      SELECT * FROM (SELECT ct.code, bars, CASE WHEN role <> 'stock' THEN 'benchmark' WHEN upper(name) LIKE '%ST%' OR name LIKE '%退%' THEN 'risk name' WHEN bars < 80 THEN 'insufficient history' WHEN coalesce(coverage, 0) < 0.75 THEN 'coverage' END AS reason
      FROM ct LEFT JOIN nm ON ct.code = nm.code LEFT JOIN cv ON ct.code = cv.code) WHERE reason IS NOT NULL"""),
    "selector_observations": (selector_observations, _OBS_ALL + " SELECT * EXCLUDE (raw_net, raw_benchmark) FROM obs"),
    "selector_periods": (selector_periods, _OBS_ALL + "," + _PERIODS + " SELECT * FROM periods"),
    "selector_metrics": (selector_metrics, _OBS_ALL + "," + _PERIODS + """ SELECT o.*, p.portfolio_period_mean_net_return_pct FROM (
      SELECT sector, count(*) AS candidate_observations, count(DISTINCT as_of) AS evaluation_periods, round(avg((future_net_return_pct > 0)::INT), 4) AS hit_rate, round(avg((excess_return_pct > 0)::INT), 4) AS excess_hit_rate,
        round(avg(future_net_return_pct), 4) AS mean_net_return_pct, round(median(future_net_return_pct), 4) AS median_net_return_pct, round(avg(excess_return_pct), 4) AS mean_excess_return_pct FROM obs GROUP BY 1) o
      JOIN (SELECT sector, round(avg(portfolio_net_return_pct), 4) AS portfolio_period_mean_net_return_pct FROM periods GROUP BY 1) p ON o.sector = p.sector"""),
    "selector_buckets": (selector_buckets, _OBS_ALL + " " + _bands("obs", "future_net_return_pct")),
    "sector_signal_observations": (sector_signal_observations, _SIG_ALL + " SELECT * FROM sig"),
    "sector_signal_buckets": (sector_signal_buckets, _SIG_ALL + " " + _bands("sig", "net_return_pct")),
    "sector_signal_gate": (sector_signal_gate, _SIG_ALL + f""", bands AS ({_bands('sig', 'net_return_pct')}), cur AS (SELECT sector, arg_max(score_20d, date) AS s FROM sector_scored GROUP BY 1),
      tot AS (SELECT sector, count(*) AS n, round(CASE WHEN count(*) >= 3 AND stddev_pop(score) * stddev_pop(excess_return_pct) > 1e-12 THEN covar_pop(score, excess_return_pct) / (stddev_pop(score) * stddev_pop(excess_return_pct)) END, 4) AS r FROM sig GROUP BY 1),
      j AS (SELECT c.sector, s, {sql.bucket('s')} AS b, coalesce(n, 0) AS n, r FROM cur c LEFT JOIN tot ON c.sector = tot.sector),
      g AS (SELECT j.*, CASE WHEN s > 35 AND s < 65 THEN false WHEN k.observations IS NULL OR k.observations < 20 THEN false WHEN s >= 65 THEN k.mean_excess_return_pct > 0 AND k.historical_excess_hit_rate >= 0.5 ELSE k.mean_excess_return_pct < 0 AND k.historical_excess_hit_rate < 0.5 END AS side FROM j LEFT JOIN bands k ON j.sector = k.sector AND j.b = k.bucket)
      SELECT sector, round(s, 3) AS current_score, b AS current_bucket, n AS observations, r AS score_excess_correlation, n >= 30 AS enough_total_observations, coalesce(r >= 0.10, false) AS positive_score_monotonicity, side AS current_bucket_usable,
        CASE WHEN n >= 30 AND coalesce(r >= 0.10, false) AND side THEN 'usable' ELSE 'abstain' END AS status FROM g"""),
    "atr20": (atr20, sql.with_(sql.BARS, _DAYS) + " SELECT code, date, round(atr20, 6) AS atr20 FROM days"),
    "donchian_prior": (_measures("high20", "low20", "high55", "low55", "low10"), sql.with_(sql.BARS, _DAYS) + " SELECT code, date, high20, low20, high55, low55, low10 FROM days"),
    "obv_direction": (_measures("obv_direction"), sql.with_(sql.BARS, _DAYS) + " SELECT code, date, obv_direction FROM days"),
    "trend_state": (_measures("daily_state"), sql.with_(sql.BARS, _DAYS) + " SELECT code, date, daily_state FROM days"),
    "recent_breakout": (recent_breakout, sql.with_(sql.BARS, _DAYS) + " SELECT code, date, rn - recent_at AS sessions_ago, round(level, 6) AS level FROM days WHERE recent_at IS NOT NULL"),
    "timing_state": (timing_state, _STATES_ALL + " SELECT code, date, state, daily_state, weekly_state, retest, failed_breakout, near_breakout, volume_confirmed FROM states"),
    "timing_risk": (timing_risk, _STATES_ALL + " SELECT code, date, round(atr20, 6) AS atr20, round(stop, 6) AS stop, round(-(close / stop - 1) * 100, 6) AS risk_distance_pct, round(close + 2 * (close - stop), 6) AS review_2r FROM states"),
    "timing_candidates": (timing_candidates, _CAND_ALL + " SELECT code, signal_date, state, entry_date, exit_date, holding_sessions, round(entry_price, 6) AS entry_price, stop, round(exit_price, 6) AS exit_price, exit_reason FROM cand"),
    "timing_trades": (timing_trades, _TRADES_ALL + " SELECT * FROM trades"),
    "timing_metrics": (timing_metrics, _TRADES_ALL + "," + _EQUITY + " SELECT * FROM metrics"),
    "timing_gate": (timing_gate, _TRADES_ALL + "," + _EQUITY + """ SELECT *, CASE WHEN start_supplied AND enough_trades AND positive_net AND positive_excess AND hit_rate_ok AND profit_factor_ok THEN 'usable' ELSE 'abstain' END AS status FROM (
      SELECT code, trades, true AS start_supplied, trades >= 20 AS enough_trades, mean_net_return_pct > 0 AS positive_net, mean_excess_return_pct > 0 AS positive_excess, hit_rate >= 0.45 AS hit_rate_ok, coalesce(profit_factor > 1, false) AS profit_factor_ok FROM metrics)"""),
}
