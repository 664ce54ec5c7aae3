"""Every publication rule, each broken alone and then together, and the gate of finished briefs."""

import copy
import json

import pytest

from tidewell.operators import publication as pub
from tidewell.plans import publications

NAMES = ("forecast", "selection", "backtest", "brief", "recommendation")
REC = {
    "code": "600001", "action": "buy", "model_position_pct": 3.0, "gate_checks": {"a": True}, "trade_plan": {"entry_condition": "e", "technical_stop_reference": 9.5, "execution_clock": pub.NEXT_SESSION},
    "timing_evidence": {"state": "retest", "timing_backtest_gate": "usable"},
}
THESIS = {"code": "600001", "supporting_fact_ids": ["F1"], "fundamental_verdict": "pass", "valuation_verdict": "fair", "catalyst_status": "confirmed", "risk_level": "high"}
GOOD = {
    "forecast": {"schema": pub.SIGNAL, "signal_type": "sector_trend_forecast", "coverage": 0.9, "values": {"forecasts": {h: {"score": 55.5, "probability_status": pub.UNCALIBRATED, "coverage": 0.8} for h in ("5d", "20d")}}},
    "selection": {"schema": pub.SIGNAL, "signal_type": "stock_selection", "coverage": 0.9, "values": {"candidates": [{"code": "600001", "score": 70}, {"code": "600002", "score": 0}]}},
    "backtest": {
        "schema": pub.BACKTEST, "period": {"candidate_observations": 30, "evaluation_periods": 20}, "settings": {"round_trip_cost_bps": 20}, "metrics": {"mean_excess_return_pct": 0.1, "excess_hit_rate": 0.5, "median_net_return_pct": 0.1},
        "score_buckets": [{"bucket": "<40", "probability_publishable": False, "observations": 3}],
    },
    "brief": {
        "schema": pub.BRIEF, "blogger_logic": {"contradiction": "c"}, "candidate_theses": [THESIS, {**THESIS, "code": "600002"}],
        "publication_gate": {"ready": True, "verified_fact_count": 3, "news_coverage_complete": True, "sector_signal_usable": True, "selector_backtest_usable": True},
    },
    "recommendation": {
        "schema": pub.RECOMMENDATION, "suitability": {"risk_profile": "balanced", "status": "user_supplied", "single_cap_pct": 5, "theme_cap_pct": 20, "risk_budget_pct": 0.5},
        "recommendations": [REC, {"code": "600002", "action": "wait", "model_position_pct": 0}], "portfolio_controls": {"recommended_theme_position_pct": 3.01},
    },
}

#: (path to change, value, rules that it breaks when published)
BROKEN = [
    ("forecast.schema", "x", {"not a sector trend forecast"}), ("forecast.signal_type", None, {"not a sector trend forecast"}), ("forecast.values.forecasts.5d.score", 100.5, {"score out of range"}), ("forecast.values.forecasts.20d.score", None, {"score out of range"}),
    ("forecast.values.forecasts.5d.probability_status", "calibrated", {"probability not declared uncalibrated"}), ("forecast.values.forecasts.5d.coverage", 1.2, {"coverage out of range"}),
    ("forecast.values.forecasts", None, {"score out of range", "probability not declared uncalibrated", "coverage out of range"}), ("selection.schema", "x", {"not a stock selection"}),
    ("selection.values.candidates", [], {"no candidates", "codes outside the selection"}), ("selection.values.candidates.1.code", "600001", {"codes repeat", "codes outside the selection"}), ("selection.values.candidates.1.score", -1, {"invalid code or score"}),
    ("selection.values.candidates.1.code", "6", {"invalid code or score", "codes outside the selection"}), ("backtest.schema", "x", {"not a selector test"}), ("backtest.period.candidate_observations", 29, {"fewer than 30 observations", "publication needs 30 observations"}),
    ("backtest.period.evaluation_periods", 19, {"fewer than 20 periods", "publication needs 20 periods"}), ("backtest.settings", None, {"no costs deducted", "publication needs costs"}), ("backtest.score_buckets.0.probability_publishable", True, {"publishable on fewer than 30 observations"}),
    ("backtest", None, {"publication needs a selector test"}), ("backtest", {}, {"publication needs a selector test"}), ("brief.schema", "x", {"not a brief"}), ("brief.blogger_logic.contradiction", "", {"no opening contradiction"}), ("brief.publication_gate.ready", False, {"gate not ready"}),
    ("brief.publication_gate.verified_fact_count", 2, {"fewer than three verified facts"}), ("brief.publication_gate.news_coverage_complete", None, {"news coverage incomplete"}), ("brief.publication_gate.sector_signal_usable", False, {"sector signal not usable"}),
    ("brief.publication_gate.selector_backtest_usable", False, {"selector test not usable"}), ("brief.candidate_theses.0.anything", "research_required", {"research still open"}), ("brief", None, {"publication needs a brief"}),
    ("recommendation.schema", "x", {"not a recommendation"}), ("recommendation.suitability.risk_profile", "x", {"invalid risk profile"}), ("recommendation.suitability.status", None, {"personalization not declared"}), ("recommendation.suitability.risk_budget_pct", 0, {"no positive risk budget"}),
    ("recommendation.recommendations", [], {"empty or codes repeat", "reported total differs"}), ("recommendation.recommendations.1.code", "600001", {"empty or codes repeat"}), ("recommendation.recommendations.1.code", "999999", {"codes outside the selection"}),
    ("recommendation.recommendations.1.action", "hold", {"invalid action"}), ("recommendation.recommendations.0.model_position_pct", 5.1, {"position outside the single cap", "reported total differs"}),
    ("recommendation.recommendations.0.model_position_pct", 0, {"buy without a position", "reported total differs"}), ("recommendation.recommendations.0.gate_checks.b", False, {"buy failed a gate"}), ("recommendation.recommendations.0.trade_plan.technical_stop_reference", None, {"buy without entry or stop"}),
    ("recommendation.recommendations.0.timing_evidence.state", "watch", {"buy without a timing state"}), ("recommendation.recommendations.0.timing_evidence.timing_backtest_gate", None, {"buy without a usable timing test"}),
    ("recommendation.recommendations.0.trade_plan.execution_clock", "now", {"buy without a next-session clock"}), ("recommendation.recommendations.1.model_position_pct", 1, {"position without a buy", "reported total differs"}),
    ("recommendation.suitability.theme_cap_pct", 2, {"theme cap exceeded"}), ("recommendation.portfolio_controls", None, {"reported total differs"}), ("recommendation", None, {"publication needs a recommendation"}),
]


def changed(path, value, good=GOOD):
    doc = copy.deepcopy(good)
    *way, last = [int(p) if p.isdigit() else p for p in path.split(".")]
    at = doc
    for step in way:
        at = at[step]
    at[last] = value
    return doc


def frame(spark, docs, publication=True, names=NAMES):
    rows = [(i, publication, *[None if d.get(n) is None else json.dumps(d[n]) for n in names]) for i, d in enumerate(docs)]
    return spark.createDataFrame(rows, "document int, publication boolean, " + ", ".join(f"{n} string" for n in names))


def test_each_rule_alone(spark):
    docs = frame(spark, [GOOD, *[changed(p, v) for p, v, _ in BROKEN]])
    found = pub.validate_publications(docs)
    broken = {}
    for r in found.collect():
        broken.setdefault(r["document"], set()).add(r["rule"])
    for i, (path, value, rules) in enumerate(BROKEN, 1):
        assert broken.get(i, set()) == rules, (path, value)
    assert 0 not in broken
    named = {rule for group in pub.PUBLICATION for _, rule, _ in group.checks}
    assert set().union(*(r for _, _, r in BROKEN)) == named
    verdicts = {r["document"]: r for r in pub.verdict_of(docs, found).collect()}
    assert verdicts[0]["valid"] and not verdicts[1]["valid"] and len(verdicts) == len(BROKEN) + 1


def test_drafts_are_held_to_less(spark):
    """A draft needs no test, brief or recommendation; what it has is still checked, and shortfalls only warn."""
    draft = {n: GOOD[n] for n in ("forecast", "selection")}
    short = changed("backtest.period.evaluation_periods", 1)
    rows = pub.validate_publications(frame(spark, [draft, short, changed("brief.publication_gate.ready", False)], publication=False)).collect()
    assert [(r["document"], r["level"], r["rule"]) for r in rows] == [(1, "warning", "fewer than 20 periods")]


def test_order_and_paths(spark):
    """Breaches keep the order of the table, and for lists that of the elements; nothing there is no crash."""
    doc = changed("selection.values.candidates", [{"code": "6", "score": 1}, {"code": "600001", "score": 101}, {}])
    rows = pub.validate_publications(frame(spark, [doc])).orderBy("seq").collect()
    assert [r["path"] for r in rows if r["rule"] == "invalid code or score"] == [f"selection.values.candidates[{i}]" for i in range(3)]
    odd = spark.createDataFrame([(1, True, "no json", "[]", None, "null", "3")], "document int, publication boolean, forecast string, selection string, backtest string, brief string, recommendation string")
    got = {r["rule"] for r in pub.validate_publications(odd).collect()}
    assert {"not a sector trend forecast", "no candidates", "publication needs a brief", "publication needs a recommendation"} <= got
    empty = spark.createDataFrame([], odd.schema)
    assert pub.validate_publications(empty).count() == 0


def facts(*changes):
    base = {"claim": "c", "publisher": "p", "source_url": "https://a.org/x", "retrieved_at": "2026-01-01T00:00:00", "period": "2026"}
    return [{"fact_id": f"F{i}", **base, **change} for i, change in enumerate(changes, 1)]


FINAL = {
    **{n: GOOD[n] for n in ("brief", "forecast", "selection", "backtest")}, "evidence_pack": {"schema": "evidence.pack/1", "topic": "t", "facts": facts({}, {}, {}, {"evidence_role": "discovery_lead"})},
    "news_coverage": {"schema": "news.collection.coverage/2", "status": "complete", "gate": {"passed": True}}, "signal_backtest": {"schema": pub.SIGNAL_BACKTEST, "gate": {"status": "usable"}},
}
UNFINISHED = [
    ("brief.schema", "x", {"not a brief"}), ("brief.candidate_theses.0.catalyst", "research_required", {"research still open"}), ("brief.candidate_theses.1.code", "600003", {"theses do not match the selection"}), ("brief.candidate_theses.0.supporting_fact_ids", [], {"no supporting facts"}),
    ("brief.candidate_theses.0.supporting_fact_ids", ["F4"], {"supported by leads or metadata only"}), ("brief.candidate_theses.0.supporting_fact_ids", ["F1", "F9", "F9"], {"unknown fact"}), ("brief.candidate_theses.0.supporting_fact_ids", ["F8"], {"unknown fact", "supported by leads or metadata only"}),
    *[(f"brief.candidate_theses.0.{v}", "x", {f"invalid {v}"}) for v in pub.VERDICTS], ("forecast.coverage", 0.74, {"forecast coverage below 75 %"}), ("selection.coverage", None, {"selection coverage below 75 %"}), ("backtest.period.evaluation_periods", 19, {"fewer than 20 periods"}),
    ("backtest.period.candidate_observations", 29, {"fewer than 30 observations"}), ("backtest.settings.round_trip_cost_bps", 0, {"no costs deducted"}), ("backtest.metrics.excess_hit_rate", 0.49, {"selector test failed"}), ("news_coverage.gate.passed", False, {"news coverage missing or incomplete"}),
    ("news_coverage", None, {"news coverage missing or incomplete"}), ("signal_backtest.gate.status", "abstain", {"sector signal missing or abstains"}), ("evidence_pack.facts", facts({}, {}), {"fewer than three substantive facts"}), ("evidence_pack.topic", " ", {"pack without a topic"}),
    ("evidence_pack.schema", "x", {"unsupported schema"}), ("evidence_pack.facts", 5, {"facts are no list", "fewer than three substantive facts", "unknown fact", "supported by leads or metadata only"}),
    ("evidence_pack.facts.0.claim", None, {"missing claim"}), ("evidence_pack.facts.1.fact_id", "F1", {"duplicate fact_id"}), ("evidence_pack.facts.3", "text", {"fact is no object"}),
]


def test_finalize(spark):
    docs = frame(spark, [FINAL, *[changed(p, v, FINAL) for p, v, _ in UNFINISHED]], names=tuple(FINAL)).cache()
    gates, found = pub.finalize(docs)
    broken = {}
    for r in found.collect():
        if r["level"] == "error":
            broken.setdefault(r["document"], set()).add(r["rule"])
    for i, (path, value, rules) in enumerate(UNFINISHED, 1):
        assert broken.get(i, set()) == rules, (path, value)
    got = {r["document"]: r for r in gates.collect()}
    assert got[0]["ready"] and got[0]["verified_fact_count"] == 3 and got[0]["total_fact_count"] == 4 and 0 not in broken
    assert not any(got[i]["ready"] for i in range(1, len(UNFINISHED) + 1))
    assert not got[2]["candidate_verdicts_resolved"] and got[2]["all_causal_fields_resolved"]
    missing = [i for i, (p, v, _) in enumerate(UNFINISHED, 1) if p == "news_coverage"]
    assert got[missing[0]]["news_coverage_status"] == "missing"
    warned = {r["rule"] for r in found.collect() if r["document"] == 0}
    assert warned == {"leads or metadata only among the facts"}


@pytest.mark.parametrize("value", [None, "", "{}", "  {} ", "[1]", "nope"])
def test_documents_that_are_none(spark, value):
    df = spark.createDataFrame([(1, value)], "document int, brief string")
    assert pub.typed(df, ("brief",)).where("brief IS NULL").count() == 1


def test_verdicts_where_the_row_stands(spark):
    docs = frame(spark, [GOOD, *[changed(p, v) for p, v, _ in BROKEN]])
    assert sorted(pub.publication_verdicts(docs).collect()) == sorted(pub.verdict_of(docs, pub.validate_publications(docs)).collect())
    assert {tuple(r)[1:] for r in pub.publication_verdicts(docs.withColumn("document", docs["document"] - docs["document"] * None)).collect()} == {(True, 0, 0)}


def test_publications_are_made_once_and_by_many_tasks(spark, sf_dir):
    """Lines are read once, and the texts are dealt to as many tasks as the session sets, however small the table is."""
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert publications.documents(spark, sf_dir).rdd.getNumPartitions() == wide
    plan = publications.publication_valid(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_partkey") > 0 and plan.count("Relation [l_orderkey") == 1 and plan.count("Join") == 1
