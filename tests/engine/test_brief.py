import json

from pyspark.sql import functions as F

from tidewell.operators import brief


def test_scaffold_waits_for_research(spark):
    sectors = spark.createDataFrame([("S0", "strong", "weak"), ("S1", "mixed", "mixed")], "sector string, regime_5d string, regime_20d string")
    cands = spark.createDataFrame([("S0", "A", 1, 80.0), ("S0", "B", 2, 70.0)], "sector string, code string, rank int, score double")
    b = brief.brief(sectors, cands)
    got = {r["sector"]: r for r in b.withColumns({"todo": brief.has_todo(F.struct("causal", "candidate_theses")), "n": brief.todo_count(F.struct("causal", "candidate_theses"))}).collect()}
    assert got["S0"]["contradicts"] and not got["S1"]["contradicts"] and got["S0"]["todo"]
    assert got["S0"]["n"] == 8 + 5 + 2 * len(brief.THESIS_FIELDS) and got["S1"]["n"] == 13
    assert [t["code"] for t in got["S0"]["candidate_theses"]] == ["A", "B"]


def test_trade_plan(spark):
    kind = "code string, close double, ma20_gap_pct double, ma20_vs_ma60_pct double, volatility_20d_annualized_pct double, timing_stop double, timing_risk_pct double, timing_review double"
    rows = [("a", 100.0, 0.0, 0.0, 15.874507866387544, 95.0, 5.0, 110.0), ("b", 100.0, 9.0, 0.0, 63.49803146555018, None, None, None), ("c", 100.0, None, None, None, None, None, None)]
    r = {x["code"]: x for x in brief.trade_plan(spark.createDataFrame(rows, kind)).collect()}
    assert (r["a"]["technical_risk_pct"], r["a"]["technical_stop"], r["a"]["risk_method"]) == (5.0, 95.0, "atr_and_prior_channel")
    assert (r["b"]["technical_risk_pct"], r["b"]["entry"], r["b"]["technical_stop"]) == (10.0, "do_not_chase", 90.0)
    assert (r["c"]["technical_risk_pct"], r["c"]["entry"], r["c"]["review_level"]) == (6.0, "wait_for_data", 112.0)


def test_recommendation_errors(spark):
    kind = "sector string, code string, action string, position_pct double, buy_gate boolean, timing_state string, timing_gate string, technical_stop double, reported_total double"
    good = ("S0", "A", "buy", 4.0, True, "retest", "usable", 9.0, 4.0)
    bad = [("S1", "A", "buy", 9.0, False, "watch", None, None, 1.0), ("S1", "B", "wait", 1.0, None, None, None, None, 1.0), ("S1", "B", "sell", 0.0, None, None, None, None, 1.0)]
    e = {(r["sector"], r["code"], r["error"]) for r in brief.recommendation_errors(spark.createDataFrame([good, *bad], kind)).collect()}
    assert {x for x in e if x[0] == "S0"} == set()
    assert {x[2] for x in e if x[1] == "A"} == {"position exceeds single-name cap", "buy failed a gate", "buy lacks a stop", "buy lacks a timing state", "buy lacks a usable timing test"}
    assert {x[2] for x in e if x[1] == "B"} == {"other action has a position", "invalid action", "code repeats"}
    assert {x[2] for x in e if x[1] is None} == {"reported total differs"}


def test_registries_and_archive(spark, tmp_path):
    sites = spark.createDataFrame([("r", "Roundwire", ["RW"], "core", "intl", 5), ("b", "Blog", None, "secondary", "cn", 9), ("c", "Central", [], "core", "intl", 7)], "site_id string, publisher string, aliases array<string>, tier string, region string, corpus_files int")
    assert [r["site_id"] for r in brief.select_sites(sites).orderBy("place").collect()] == ["c", "r", "b"]
    assert [r["site_id"] for r in brief.select_sites(sites, publisher="rw").collect()] == ["r"]
    a = "market string, symbol string, strength double, ordinal int"
    got = brief.planned_assets(spark.createDataFrame([("us", "SPY", 1.0, 0), ("kr", "KS", 1.0, 0)], a), spark.createDataFrame([("us", "SOXX", 0.8, 0), ("kr", "SPY", 0.5, 0), ("jp", "X", 1.0, 0)], a), ["us", "kr"]).collect()
    assert {(r["symbol"], r["role"]) for r in got} == {("SPY", "market_benchmark"), ("KS", "market_benchmark"), ("SOXX", "peer")}
    for name, last, n in (("a", "2026-01-03", 2), ("b/c", "2026-01-04", 1), ("d", "2026-01-04", 2)):
        p = tmp_path / f"{name}.json"
        p.parent.mkdir(exist_ok=True)
        p.write_text(json.dumps({"schema": "market.history/1", "series": [{"code": "sh600000", "bars": [{"date": last, "close": 1.0}] * n}]}))
    (tmp_path / "other.json").write_text(json.dumps({"schema": "x/1"}))
    best = brief.best_history(brief.read_histories(spark, str(tmp_path))).collect()
    assert [(r["code"], len(r["bars"]), r["path"][-6:]) for r in best] == [("600000", 2, "d.json")]
    doc = json.dumps({"schema": "s/1", "gate": {"status": "abstain"}, "metrics": {"hit_rate": 0.5}, "recommendations": [{"action": "wait"}, {"action": "wait"}, {}]})
    s = brief.snapshots(spark.createDataFrame([(doc,)], "body string"))
    r = s.select("*", brief.supports_abstention(F.col("gate"), F.col("doc_status")).alias("abstain")).first()
    assert r["abstain"] and r["metrics"]["hit_rate"] == 0.5 and r["action_counts"] == {"unknown": 1, "wait": 2}
    (tmp_path / "a.jsonl").write_text('{"title": "t", "source": "s"}\n')
    assert brief.read_articles(spark, str(tmp_path / "a.jsonl")).count() == 1
