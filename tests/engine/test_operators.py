"""Operators on small series with known answers, no look-ahead, and folds against plain loops."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import backtest, decision, evidence, journal, scoring, signals, timeseries, timing
from tidewell.plans import research
from tidewell.sources import panels

BARS = "role string, code string, sector string, date date, open double, high double, low double, close double, volume double"


def series(role, code, sector, n, r, v=0.0, start=dt.date(2025, 1, 1), weekdays=False):
    out, day, i = [], start, 0
    while i < n:
        if not weekdays or day.weekday() < 5:
            p = 100 * (1 + r) ** (i + 1)
            out.append((role, code, sector, day, p * 0.998, p * 1.004, p * 0.996, p, 1e6 * (1 + v * i)))
            i += 1
        day += dt.timedelta(days=1)
    return out


@pytest.fixture(scope="module")
def history(spark):
    rows = series("sector", "S0", "S0", 260, 0.001) + series("market", "MKT", None, 260, 0.0002) + series("stock", "A1", "S0", 260, 0.002, 0.002) + series("stock", "A2", "S0", 260, -0.0005)
    return spark.createDataFrame(rows, BARS)


def test_clean_bars(spark):
    raw = spark.createDataFrame(
        [("a", "2026-01-02", "1", 1), ("a", "2026-01-02", "2", 2), ("a", "2026-01-03", "nan", 1), ("a", "2026-01-04", "-1", 1), ("a", "2026-01-05", "inf", 1), ("a", "x", "5", 1), ("a", "2026-02-01", "3", 1), ("a", None, "4", 1)],
        "code string, date string, close string, ingest_seq long",
    )
    got = timeseries.clean_bars(raw, "2026-01-31").collect()
    assert [(str(r["date"]), r["close"]) for r in got] == [("2026-01-02", 2.0)]


def test_features_by_hand(history):
    f = {(r["code"], r["date"]): r for r in timeseries.features(history).collect()}
    last = dt.date(2025, 1, 1) + dt.timedelta(days=259)
    a = f["A1", last]
    assert a["history_count"] == 260
    assert a["return_20d_pct"] == pytest.approx((1.002**20 - 1) * 100, abs=1e-5)
    assert a["relative_20d_pct"] == pytest.approx((1.002**20 - 1.001**20) * 100, abs=1e-5)
    assert a["max_drawdown_60d_pct"] == 0 and f["A2", last]["max_drawdown_60d_pct"] == pytest.approx((0.9995**59 - 1) * 100, abs=1e-5)
    first = dt.date(2025, 1, 1) + dt.timedelta(days=79)
    assert min(d for c, d in f if c == "A1") == first  # the 80th bar is the first with factors


def test_missing_volumes_are_skipped(spark):
    rows = [(r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[7], None if k % 3 == 0 else float(k)) for k, r in enumerate(series("stock", "A1", "S0", 130, 0.001))]
    got = {r["date"]: r["volume_20d_vs_60d"] for r in timeseries.features(spark.createDataFrame(rows, BARS)).collect()}
    have = [(r[3], r[8]) for r in rows if r[8] is not None]
    for day, value in got.items():
        seen = [v for d, v in have if d <= day]
        want = (sum(seen[-20:]) / 20) / (sum(seen[-60:]) / 60) if len(seen) >= 60 else None
        assert value == (pytest.approx(want, abs=1e-6) if want is not None else None)


def test_strong_stock_ranks_first(history):
    f = timeseries.features(history)
    last = f.where("role = 'sector'").groupBy("sector").agg(F.max("date").alias("as_of"))
    r = scoring.ranked(scoring.stock_scores(scoring.as_of_features(f, last)), ["sector", "as_of"]).collect()
    assert [x["code"] for x in sorted(r, key=lambda x: x["rank"])] == ["A1", "A2"]
    s = scoring.sector_scores(f).orderBy(F.desc("date")).first()
    assert s["score_20d"] > 60


def test_selector_earns_on_the_strong_stock(history):
    obs = backtest.selector_observations(history, timeseries.features(history), horizon=5, top_n=1, step=10, cost_bps=10)
    m = backtest.selector_metrics(obs).first()
    assert m["evaluation_periods"] > 0 and m["mean_excess_return_pct"] > 0


def test_sector_gate_abstains_on_few_observations(history):
    s = scoring.sector_scores(timeseries.features(history))
    obs = backtest.sector_observations(history, s)
    assert obs.count() <= 9
    assert backtest.sector_gate(obs, s).first()["status"] == "abstain"


def test_nothing_looks_ahead(spark):
    b = panels.bars(spark, "/root/testdata/sf0.001")
    day = dt.date(1999, 6, 15)
    cut = b.where(F.col("date") <= F.lit(day))
    for op in (timeseries.features, timing.daily_measures, lambda x: scoring.sector_scores(timeseries.features(x)), lambda x: timing.weekly_state(x), lambda x: signals.mood(signals.snapshots(x))):
        whole = sorted(map(str, op(b).where(F.col("date") == F.lit(day)).collect()))
        part = sorted(map(str, op(cut).where(F.col("date") == F.lit(day)).collect()))
        assert whole == part


def test_weekly_rule_against_a_loop(spark):
    rng = random.Random(4)
    rows, day = [], dt.date(2024, 1, 1)
    for i in range(300):
        p = 100 + 10 * math.sin(i / 15) + rng.random()
        rows.append(("stock", "A1", "S0", day, p, p, p, p, 1.0))
        day += dt.timedelta(days=rng.choice([1, 1, 1, 2, 3]))
    got = {r["date"]: r["weekly_state"] for r in timing.weekly_state(spark.createDataFrame(rows, BARS)).collect()}
    for k, r in enumerate(rows):
        weeks = {}
        for x in rows[: k + 1]:
            weeks[x[3].isocalendar()[:2]] = x[7]
        closes = [weeks[w] for w in sorted(weeks)]
        if r[3].weekday() < 4:
            closes = closes[:-1]
        if len(closes) < 23:
            want = "insufficient_data"
        else:
            mean = lambda xs: sum(xs) / len(xs)
            fast, slow, past, c = mean(closes[-10:]), mean(closes[-20:]), mean(closes[-13:-3]), closes[-1]
            want = "bullish" if c > fast > slow and fast > past else "bearish" if c < fast < slow and fast < past else "mixed"
        assert got[r[3]] == want


def test_timing_backtest(spark):
    rows = series("sector", "S0", "S0", 360, 0.0005, 0.001, dt.date(2024, 1, 1), True) + series("stock", "A1", "S0", 360, 0.0025, 0.001, dt.date(2024, 1, 1), True)
    rows = [(*r[:4], r[4], r[7] * 1.0015, r[7] * 0.995, r[7], r[8]) for r in rows]
    b = spark.createDataFrame(rows, BARS)
    s = timing.states(b.where("role = 'stock'"))
    assert s.orderBy(F.desc("date")).first()["state"] == "retest"
    start = str(rows[360 + 120][3])
    t = timing.trades(b, timing.candidates(b.where("role = 'stock'"), s, horizon=5, start=start))
    got = t.collect()
    assert len(got) >= 20 and all(r["entry_date"] > r["signal_date"] and r["holding_sessions"] <= 5 for r in got)
    m = timing.trade_metrics(t)
    assert timing.timing_gate(m, start).first()["status"] == "usable" and timing.timing_gate(m, None).first()["status"] == "abstain"
    assert timing.candidates(b.where("role = 'stock'"), s, horizon=300).count() == 0


def test_greedy_fold_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(f"c{c}", rn, rn + rng.randint(1, 9)) for c in range(6) for rn in sorted(rng.sample(range(200), 60))]
    got = {(r["code"], r["rn"]) for r in timing.non_overlapping(spark.createDataFrame(rows, "code string, rn int, exit_rn int")).collect()}
    want, free = set(), {}
    for code, rn, end in sorted(rows):
        if rn >= free.get(code, 0):
            want.add((code, rn))
            free[code] = end + 1
    assert got == want


def test_strict_prior_pairs(spark):
    d = lambda n: dt.date(2026, 1, n)
    home = spark.createDataFrame([("S0", d(2), -1.0), ("S0", d(3), -2.0)], "sector string, date date, excess double")
    foreign = spark.createDataFrame([("us", "X", d(1), 1.0), ("us", "X", d(2), 99.0), ("us", "X", d(3), 99.0)], "market string, symbol string, date date, excess double")
    got = signals.lead_lag_pairs(home, foreign).orderBy("date").collect()
    assert [(r["home_excess"], r["foreign_excess"]) for r in got] == [(-1.0, 1.0), (-2.0, 99.0)]


def test_event_study(spark):
    days = [dt.date(2026, 7, 27) + dt.timedelta(days=i) for i in range(12)]
    bar = lambda role, code, m: [(role, code, None if role == "market" else "S0", d, c, c, c, c, 2e6 if i == 6 else 1e6) for i, d in enumerate(days) for c in [100.0 if i < 6 else 100 * m]]
    b = spark.createDataFrame(bar("stock", "A1", 0.98) + bar("sector", "S0", 1.0) + bar("market", "MKT", 1.0), BARS)
    e = spark.createDataFrame([(1, "A1", dt.date(2026, 8, 2), "positive", "announced")], "event_id long, code string, event_date date, direction string, stage string")
    r = signals.event_reactions(e, b).first()
    assert (r["regime"], r["relative_return_1d_pct"], r["event_volume_ratio_20d"], r["pre_5d_return_pct"], r["stage_maturity"]) == ("positive_rejected", -2.0, 2.0, 0.0, 0.55)
    assert "high_event_volume" in r["flags"]


def test_mood_weights_are_renormalized(spark):
    cols = "date string, advance_count long, decline_count long, limit_up_count long, limit_down_count long, break_rate_pct double, max_limit_height long, continuation_rate_pct double, index_return double"
    rows = [("full", 4000, 1000, 100, 5, 100 * 20 / 120, 5, 60.0, 1.5), ("part", 100, 100, None, None, None, None, None, None)]
    got = {r["date"]: r for r in signals.mood(spark.createDataFrame(rows, cols)).collect()}
    assert got["full"]["score"] == pytest.approx(79.028, abs=2e-3) and got["full"]["coverage"] == 1.0
    assert got["part"]["score"] == 50.0 and got["part"]["coverage"] == 0.35


def test_topic_heat(spark):
    now = dt.datetime(2026, 8, 8, 8)
    rows = [(1, "t", "Same title!", "A", now - dt.timedelta(minutes=20)), (2, "t", "same TITLE", "B", now - dt.timedelta(minutes=10)), (3, "t", "other", "B", now - dt.timedelta(hours=3)), (4, "t", "third", "C", now - dt.timedelta(days=3))]
    a = spark.createDataFrame(rows, "article_id long, topic string, title string, source string, published_at timestamp")
    r = signals.topic_heat(a, ["topic"], F.lit("2026-08-08 08:00:00").cast("timestamp")).first()
    assert (r["last_24h_count"], r["velocity_ratio"], r["attention_velocity_score"], r["source_diversity_score"], r["recency_score"], r["score"], r["duplicate_ratio"]) == (2, 2.571429, 77.251, 20.0, 50.0, 58.851, 0.25)


def test_coverage_gates(spark):
    plan = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "c")], "topic string, site_id string")
    tries = lambda *x: spark.createDataFrame([(s, i, o) for i, (s, o) in enumerate(x)], "site_id string, seq int, outcome string")
    none = spark.createDataFrame([], "site_id string, seq int, access_state string, capture_method string")
    page = spark.createDataFrame([("a", 1, "open", "visible_original_page")], none.schema)
    g = evidence.coverage_gate(plan, tries(("a", "failed"), ("b", "paywalled"), ("c", "no_relevant_result")), page, "topic").first()
    assert g["passed"] and g["opened_original_pages"] == 1 and g["status"] == "complete"
    g = evidence.coverage_gate(plan, tries(("b", "paywalled"), ("c", "no_relevant_result")), none, "topic").first()
    assert not g["passed"] and g["missing"] == 1
    g = evidence.coverage_gate(plan, tries(("a", "search_results_only"), ("b", "paywalled"), ("c", "no_relevant_result")), none, "topic").first()
    assert not g["passed"] and g["unresolved"] == 1


def test_fact_errors(spark):
    kind = "seq int, fact_id string, claim string, value double, unit string, period string, publisher string, source_url string, retrieved_at string, evidence_role string, observation_scope string"
    good = (1, "F1", "c", 1.0, "%", "2026", "p", "https://a.com/x", "2026-01-01T00:00:00Z", None, None)
    bad = (2, "F1", None, 1.0, None, "2026", "p", "ftp://a", "noon", "discovery_lead", None)
    v = {r["seq"]: r for r in evidence.validate_facts(spark.createDataFrame([good, bad], kind)).collect()}
    assert v[1]["errors"] == [] and set(v[2]["errors"]) == {"duplicate fact_id", "missing claim", "invalid source_url", "invalid retrieved_at", "missing unit"}


def test_recommendation_case(spark):
    row = dict(sector="S0", code="A1", score=80.0, sector_score=70.0, mean_excess=1.0, excess_hit=0.6, fundamental_verdict="pass", valuation_verdict="fair", catalyst_status="confirmed", risk_level="medium", timing_state="triggered", timing_gate="usable", risk_distance_pct=8.0)
    rows = [row, {**row, "code": "A2", "timing_gate": "abstain"}, {**row, "code": "A3", "risk_level": "very_high"}]
    r = {x["code"]: x for x in decision.recommend(spark.createDataFrame(rows)).collect()}
    assert r["A1"]["action"] == "buy" and 2.5 <= r["A1"]["position_pct"] <= 5
    assert (r["A2"]["action"], r["A3"]["action"]) == ("wait", "avoid") and r["A2"]["position_pct"] == 0
    assert spark.range(1).select(decision.review_date(F.lit("2026-01-01").cast("date"), F.lit(20)).alias("d")).first()["d"] == dt.date(2026, 1, 30)


def test_outlook_branches(spark):
    p = research.outlook_plan(spark, "")
    order = lambda h, s, e: [r["stage"] for r in p.where(f"horizon = '{h}' AND session = '{s}' AND event_state = '{e}'").orderBy("position").collect()]
    assert order("5d", "after_close", "unknown").index("local_state") < order("5d", "after_close", "unknown").index("news")
    assert order("5d", "after_close", "confirmed_material").index("news") < order("5d", "after_close", "confirmed_material").index("local_state_before_event")
    assert order("1d", "premarket", "unknown").index("cross_market") < order("1d", "premarket", "unknown").index("local_state")


def test_auto_review(spark):
    days = [dt.date(2026, 1, d) for d in (2, 3, 4, 5)]
    bar = lambda role, code, closes: [(role, code, "S0", d, c, c, c, c, 1.0) for d, c in zip(days, closes)]
    b = spark.createDataFrame(bar("stock", "A1", [100.0, 102.0, 104.0, 106.0]) + bar("sector", "S0", [100.0, 101.0, 101.0, 102.0]), BARS)
    runs = spark.createDataFrame([(1, "A1", dt.date(2026, 1, 1), 3, "bullish", False), (2, "A1", dt.date(2026, 1, 4), 3, "bullish", False)], "run_id long, code string, as_of date, days int, stance string, abstention_supported boolean")
    r = {x["run_id"]: x for x in journal.auto_review(runs, b, spark.createDataFrame([("A1", "S0")], "code string, bench string"), (3,)).collect()}
    assert (r[1]["realized_return_pct"], r[1]["benchmark_return_pct"], r[1]["excess_return_pct"], r[1]["thesis_status"], r[1]["decision_quality"]) == (6.0, 2.0, 4.0, "confirmed", "good")
    assert r[2]["thesis_status"] == "blocked" and r[2]["reason"].startswith("1/4")


def test_store_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "sha256 string, n int")
    path = str(tmp_path / "objects")
    assert journal.insert_absent(rows, path, "sha256") == 0
    assert journal.insert_absent(rows.union(spark.createDataFrame([("c", 3)], rows.schema)), path, "sha256") == 2
    assert sorted(r["sha256"] for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_positions_stream(spark, tmp_path):
    from tidewell.streaming import heat

    path = str(tmp_path / "signals")
    spark.createDataFrame([("a", 1), ("a", 3), ("a", 9), ("b", 2)], "code string, rn bigint").coalesce(1).write.parquet(path)
    s = heat.one_position(spark.readStream.schema("code string, rn bigint").parquet(path), 5)
    assert {(r["code"], r["rn"]) for r in heat.drain(s, "positions", "append").collect()} == {("a", 1), ("a", 9), ("b", 2)}
