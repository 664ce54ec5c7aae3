"""Queries over publications: every order is one, its lines are the candidates, with faults planted by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import publication as pub
from ..sources import panels

_K, _P = "o_orderkey", "x.p"


def documents(spark, d):
    """(document, publication, the JSON texts): orders with their lines in one list, written as landed documents are."""
    line = panels.table(spark, d, "lineitem").select("l_orderkey", F.col("l_orderkey").cast("long").alias("k"), F.col("l_linenumber").cast("int").alias("ln"), F.col("l_partkey").cast("long").alias("p"), F.col("l_quantity").cast("int").alias("q"), F.col("l_returnflag").alias("rf"))
    # what several texts hold is made once a line, before lines meet
    line = line.withColumn("code", F.expr("CASE WHEN p % 37 = 0 THEN '12' WHEN k % 29 = 0 THEN lpad(CAST(p % 3 AS STRING), 6, '0') ELSE lpad(CAST(p AS STRING), 6, '0') END"))
    line = line.withColumn("action", F.expr("CASE WHEN k % 97 = 1 AND ln = 1 THEN 'hold' WHEN rf = 'A' THEN 'buy' WHEN rf = 'R' THEN 'avoid' ELSE 'wait' END"))
    line = line.withColumn("position", F.expr("CAST(CASE WHEN action = 'buy' THEN CASE WHEN p % 41 = 0 THEN 0 ELSE q / 8 END WHEN action = 'hold' THEN 0 WHEN p % 43 = 0 THEN 1 WHEN p % 47 = 0 THEN -1 ELSE 0 END AS DOUBLE)"))
    # texts cost far more than the bytes that are shuffled, so the number of tasks is set and not left to sizes
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = line.repartition(wide, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("ln", "p", "q", "rf", "code", "action", "position"))).alias("lines"))
    orders = panels.table(spark, d, "orders").select(F.col(_K).alias("o"), F.col(_K).cast("long").alias("k")).repartition(wide, "o")
    o = orders.join(lines, orders["o"] == lines["l_orderkey"], "left").withColumn("lines", F.coalesce("lines", F.expr("array()")))
    code, action, position = "x.code", "x.action", "x.position"
    horizon = lambda score, status, cover: f"named_struct('score', {score}, 'probability_status', {status}, 'coverage', {cover})"
    five = horizon("CAST(CASE WHEN k % 7 = 3 THEN 120 ELSE k % 101 END AS DOUBLE)", f"if(k % 43 = 0, 'calibrated', '{pub.UNCALIBRATED}')", "if(k % 47 = 0, CAST(NULL AS DOUBLE), 0.9D)")
    twenty = horizon("if(k % 53 = 0, CAST(NULL AS DOUBLE), 50D)", f"'{pub.UNCALIBRATED}'", "if(k % 59 = 0, 1.5D, 0.9D)")
    fact = """named_struct('fact_id', if(x.p % 31 = 0, NULL, concat('F', if(k % 35 = 0, x.p % 2, x.p))), 'claim', if(x.p % 23 = 0, NULL, 'c'), 'publisher', 'p', 'source_url', concat(if(x.p % 29 = 0, 'ftp', 'https'), '://h.org/', x.p),
      'retrieved_at', if(x.p % 19 = 0, 'yesterday', '2024-01-31T08:00:00'), 'period', '2024-01', 'value', x.q, 'unit', if(x.p % 21 = 0, NULL, 'pct'), 'evidence_role', if(x.p % 4 = 0, 'discovery_lead', NULL), 'observation_scope', if(x.p % 6 = 0, 'metadata_only', NULL))"""
    thesis = f"""named_struct('code', if(x.ln = 5 AND k % 26 = 0, '888888', {code}), 'supporting_fact_ids', if(x.p % 18 = 0, array(), array_compact(array(concat('F', x.p), if(x.p % 8 = 0, 'F999999999', NULL)))),
      'fundamental_verdict', if(x.p % 45 = 0, 'research_required', 'pass'), 'valuation_verdict', if(x.p % 9 = 0, 'x', 'fair'), 'catalyst_status', if(x.p % 10 = 0, NULL, 'absent'), 'risk_level', if(x.p % 27 = 0, 'low', 'high'))"""
    rec = f"""named_struct('code', if(x.ln = 4 AND k % 9 = 0, '999999', {code}), 'action', {action}, 'model_position_pct', {position}, 'gate_checks', map('score', true, 'timing', x.p % 3 <> 0),
      'trade_plan', named_struct('entry_condition', if(x.p % 7 = 0, NULL, 'e'), 'technical_stop_reference', if(x.p % 11 = 0, NULL, 10D), 'execution_clock', if(x.p % 13 = 0, 'now', '{pub.NEXT_SESSION}')),
      'timing_evidence', named_struct('state', CASE WHEN x.p % 5 < 2 THEN 'triggered' WHEN x.p % 5 < 4 THEN 'retest' ELSE 'watch' END, 'timing_backtest_gate', if(x.p % 17 = 0, NULL, 'usable')))"""
    total = f"aggregate(lines, 0D, (t, x) -> t + {position})"
    texts = {
        "forecast": f"named_struct('schema', if(k % 41 = 0, 'evidence.signal/0', '{pub.SIGNAL}'), 'signal_type', 'sector_trend_forecast', 'coverage', k % 20 / 20D, 'values', named_struct('forecasts', map('5d', {five}, '20d', {twenty})))",
        "selection": f"named_struct('schema', if(k % 61 = 0, NULL, '{pub.SIGNAL}'), 'signal_type', 'stock_selection', 'coverage', k % 25 / 25D, 'values', named_struct('candidates', if(k % 67 = 0, array(), transform(lines, x -> named_struct('code', {code}, 'score', CAST(if(x.p % 97 = 0, 101, 2 * x.q) AS DOUBLE))))))",
        "backtest": f"""if(k % 11 = 0, NULL, named_struct('schema', if(k % 13 = 0, 'model.backtest/2', '{pub.BACKTEST}'), 'period', named_struct('candidate_observations', k % 5 * 12, 'evaluation_periods', k % 7 * 6), 'settings', named_struct('round_trip_cost_bps', if(k % 17 = 0, 0D, 20D)),
          'metrics', named_struct('mean_excess_return_pct', CAST(k % 5 - 1 AS DOUBLE), 'excess_hit_rate', k % 10 / 10D, 'median_net_return_pct', CAST(k % 4 - 1 AS DOUBLE)), 'score_buckets', transform(lines, x -> named_struct('bucket', x.rf, 'probability_publishable', x.ln % 2 = 0, 'observations', x.q))))""",
        "brief": f"""if(k % 19 = 0, NULL, named_struct('schema', if(k % 23 = 0, 'x', '{pub.BRIEF}'), 'blogger_logic', named_struct('contradiction', if(k % 31 = 0, NULL, 'why')), 'publication_gate', named_struct('ready', k % 2 = 0, 'verified_fact_count', k % 6, 'news_coverage_complete', k % 3 <> 0,
          'sector_signal_usable', k % 37 <> 0, 'selector_backtest_usable', k % 29 <> 1), 'candidate_theses', transform(lines, x -> {thesis})))""",
        "recommendation": f"""if(k % 10 = 0, NULL, named_struct('schema', if(k % 71 = 0, 'x', '{pub.RECOMMENDATION}'), 'suitability', named_struct('risk_profile', if(k % 73 = 0, 'reckless', 'balanced'), 'status', if(k % 79 = 0, NULL, 'user_supplied'), 'single_cap_pct', 5D, 'theme_cap_pct', 10D, 'risk_budget_pct', if(k % 83 = 0, 0D, 0.5D)),
          'recommendations', if(k % 89 = 0, array(), transform(lines, x -> {rec})), 'portfolio_controls', named_struct('recommended_theme_position_pct', {total} + if(k % 12 = 0, 1, 0))))""",
        "evidence_pack": f"named_struct('schema', if(k % 33 = 0, 'x', 'evidence.pack/1'), 'topic', if(k % 34 = 0, '', 't'), 'facts', if(k % 36 = 0, NULL, transform(lines, x -> {fact})))",
        "news_coverage": "if(k % 14 = 0, NULL, named_struct('schema', if(k % 15 = 0, 'x', 'browser.news.coverage/1'), 'status', 'complete', 'gate', named_struct('passed', k % 4 <> 1)))",
        "signal_backtest": f"if(k % 16 = 0, NULL, named_struct('schema', '{pub.SIGNAL_BACKTEST}', 'gate', named_struct('status', if(k % 3 = 0, 'abstain', 'usable'))))",
    }
    return o.select(F.col("k").alias("document"), F.expr("k % 4 <> 0").alias("publication"), *[F.to_json(F.expr(x)).alias(n) for n, x in texts.items()])


def publication_errors(spark, d):
    return pub.validate_publications(documents(spark, d)).select("document", "level", "path", "rule")


def publication_valid(spark, d):
    return pub.publication_verdicts(documents(spark, d))


def finalized_briefs(spark, d):
    return pub.finalize(documents(spark, d))[0]


def finalization_errors(spark, d):
    return pub.finalize(documents(spark, d))[1].select("document", "level", "path", "rule")


_LINES = """
WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS k, o_orderkey % 4 <> 0 AS publication FROM orders),
l0 AS (SELECT CAST(l_orderkey AS BIGINT) AS k, CAST(l_linenumber AS INT) AS ln, CAST(l_partkey AS BIGINT) AS p, CAST(l_quantity AS INT) AS q, l_returnflag AS rf FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
l1 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ln, p, q, rf) - 1 AS i, CASE WHEN p % 37 = 0 THEN '12' WHEN k % 29 = 0 THEN lpad(CAST(p % 3 AS VARCHAR), 6, '0') ELSE lpad(CAST(p AS VARCHAR), 6, '0') END AS code,
  CASE WHEN k % 97 = 1 AND ln = 1 THEN 'hold' WHEN rf = 'A' THEN 'buy' WHEN rf = 'R' THEN 'avoid' ELSE 'wait' END AS action FROM l0),
l AS (SELECT *, '[' || i || ']' AS ix, CASE WHEN ln = 4 AND k % 9 = 0 THEN '999999' ELSE code END AS rcode, CASE WHEN ln = 5 AND k % 26 = 0 THEN '888888' ELSE code END AS tcode,
  CASE WHEN action = 'buy' THEN CASE WHEN p % 41 = 0 THEN 0 ELSE q / 8.0::DOUBLE END WHEN action = 'hold' THEN 0 WHEN p % 43 = 0 THEN 1 WHEN p % 47 = 0 THEN -1 ELSE 0 END AS pos FROM l1),
s AS (SELECT o.k, o.publication, count(l.k) AS n, count(DISTINCT l.code) AS codes, count(DISTINCT l.rcode) AS rcodes, coalesce(sum(l.pos), 0) AS total, count(*) FILTER (WHERE l.rcode <> l.code) AS moved, coalesce(bool_or(p % 45 = 0), false) AS todo,
  coalesce(list(DISTINCT l.code) FILTER (WHERE l.k IS NOT NULL), []) AS cs, coalesce(list(DISTINCT l.rcode) FILTER (WHERE l.k IS NOT NULL), []) AS rs, coalesce(list(DISTINCT l.tcode) FILTER (WHERE l.k IS NOT NULL), []) AS ts FROM o LEFT JOIN l ON l.k = o.k GROUP BY 1, 2)"""


def _rows(source: str, rules: list[tuple[str, str, str]], level: str = "error") -> str:
    return "\nUNION ALL ".join(f"SELECT k AS document, '{level}' AS level, {path} AS path, '{rule}' AS rule FROM {source} WHERE {when}" for path, rule, when in rules)


_RECS = "(SELECT * FROM l WHERE k % 10 <> 0 AND k % 89 <> 0)"
_TOTAL = "(CASE WHEN k % 89 = 0 THEN 0 ELSE total END)"
ERRORS_SQL = _LINES + ", e AS (" + "\nUNION ALL ".join([
    _rows("s", [
        ("'forecast.schema'", "not a sector trend forecast", "k % 41 = 0"), ("'forecast.values.forecasts.score[5d]'", "score out of range", "k % 7 = 3 OR k % 101 > 100"), ("'forecast.values.forecasts.score[20d]'", "score out of range", "k % 53 = 0"),
        ("'forecast.values.forecasts.probability_status[5d]'", "probability not declared uncalibrated", "k % 43 = 0"), ("'forecast.values.forecasts.coverage[5d]'", "coverage out of range", "k % 47 = 0"), ("'forecast.values.forecasts.coverage[20d]'", "coverage out of range", "k % 59 = 0"),
        ("'selection.schema'", "not a stock selection", "k % 61 = 0"), ("'selection.values.candidates'", "no candidates", "k % 67 = 0 OR n = 0"), ("'selection.values.candidates'", "codes repeat", "k % 67 <> 0 AND n > codes"),
        ("'backtest.schema'", "not a selector test", "k % 11 <> 0 AND k % 13 = 0"), ("'backtest.period.evaluation_periods'", "publication needs 20 periods", "publication AND k % 11 <> 0 AND k % 7 * 6 < 20"), ("'backtest.period.candidate_observations'", "publication needs 30 observations", "publication AND k % 11 <> 0 AND k % 5 * 12 < 30"),
        ("'backtest.settings.round_trip_cost_bps'", "publication needs costs", "publication AND k % 11 <> 0 AND k % 17 = 0"), ("'backtest'", "publication needs a selector test", "publication AND k % 11 = 0"),
        ("'brief.schema'", "not a brief", "k % 19 <> 0 AND k % 23 = 0"), ("'brief.blogger_logic.contradiction'", "no opening contradiction", "k % 19 <> 0 AND k % 31 = 0"), ("'brief.publication_gate.ready'", "gate not ready", "publication AND k % 19 <> 0 AND k % 2 = 1"),
        ("'brief.publication_gate.verified_fact_count'", "fewer than three verified facts", "publication AND k % 19 <> 0 AND k % 6 < 3"), ("'brief.publication_gate.news_coverage_complete'", "news coverage incomplete", "publication AND k % 19 <> 0 AND k % 3 = 0"),
        ("'brief.publication_gate.sector_signal_usable'", "sector signal not usable", "publication AND k % 19 <> 0 AND k % 37 = 0"), ("'brief.publication_gate.selector_backtest_usable'", "selector test not usable", "publication AND k % 19 <> 0 AND k % 29 = 1"),
        ("'brief'", "research still open", "publication AND k % 19 <> 0 AND todo"), ("'brief'", "publication needs a brief", "publication AND k % 19 = 0"), ("'recommendation.schema'", "not a recommendation", "k % 10 <> 0 AND k % 71 = 0"),
        ("'recommendation.suitability.risk_profile'", "invalid risk profile", "k % 10 <> 0 AND k % 73 = 0"), ("'recommendation.suitability.status'", "personalization not declared", "k % 10 <> 0 AND k % 79 = 0"), ("'recommendation.suitability.risk_budget_pct'", "no positive risk budget", "k % 10 <> 0 AND k % 83 = 0"),
        ("'recommendation.recommendations'", "empty or codes repeat", "k % 10 <> 0 AND (k % 89 = 0 OR n = 0 OR rcodes < n)"),
        ("'recommendation.recommendations'", "codes outside the selection", "k % 10 <> 0 AND k % 89 <> 0 AND len(list_filter(rs, lambda c: k % 67 = 0 OR NOT list_contains(cs, c))) > 0"), ("'recommendation.recommendations'", "theme cap exceeded", f"k % 10 <> 0 AND {_TOTAL} > 10 + 1e-6"),
        ("'recommendation.portfolio_controls'", "reported total differs", f"k % 10 <> 0 AND abs({_TOTAL} - total - CASE WHEN k % 12 = 0 THEN 1 ELSE 0 END) > 0.02"), ("'recommendation'", "publication needs a recommendation", "publication AND k % 10 = 0"),
    ]),
    _rows("s", [("'backtest.period.candidate_observations'", "fewer than 30 observations", "k % 11 <> 0 AND k % 5 * 12 < 30"), ("'backtest.period.evaluation_periods'", "fewer than 20 periods", "k % 11 <> 0 AND k % 7 * 6 < 20"), ("'backtest.settings.round_trip_cost_bps'", "no costs deducted", "k % 11 <> 0 AND k % 17 = 0")], "warning"),
    _rows("l", [
        ("'selection.values.candidates' || ix", "invalid code or score", "k % 67 <> 0 AND (length(code) <> 6 OR p % 97 = 0 OR 2 * q > 100 OR q < 0)"), ("'backtest.score_buckets' || ix", "publishable on fewer than 30 observations", "k % 11 <> 0 AND ln % 2 = 0 AND q < 30"),
    ]),
    _rows(_RECS, [
        ("'recommendation.recommendations' || ix", "invalid action", "action = 'hold'"), ("'recommendation.recommendations' || ix", "position outside the single cap", "pos < 0 OR pos > 5 + 1e-9"), ("'recommendation.recommendations' || ix", "buy without a position", "action = 'buy' AND pos <= 0"),
        ("'recommendation.recommendations' || ix", "buy failed a gate", "action = 'buy' AND p % 3 = 0"), ("'recommendation.recommendations' || ix", "buy without entry or stop", "action = 'buy' AND (p % 7 = 0 OR p % 11 = 0)"), ("'recommendation.recommendations' || ix", "buy without a timing state", "action = 'buy' AND p % 5 = 4"),
        ("'recommendation.recommendations' || ix", "buy without a usable timing test", "action = 'buy' AND p % 17 = 0"), ("'recommendation.recommendations' || ix", "buy without a next-session clock", "action = 'buy' AND p % 13 = 0"), ("'recommendation.recommendations' || ix", "position without a buy", "action <> 'buy' AND pos <> 0"),
    ]),
]) + ")\n"

_FACTS = """, f0 AS (SELECT k, i, ix, p, q, CASE WHEN p % 31 <> 0 THEN 'F' || CASE WHEN k % 35 = 0 THEN p % 2 ELSE p END END AS id, p % 4 <> 0 AND p % 6 <> 0 AS solid FROM l WHERE k % 36 <> 0),
f AS (SELECT *, CASE WHEN id IS NOT NULL THEN row_number() OVER (PARTITION BY k, id ORDER BY i) ELSE 1 END AS copy FROM f0),
w AS (SELECT s.*, (SELECT count(*) FROM f WHERE f.k = s.k) AS held, (SELECT count(*) FROM f WHERE f.k = s.k AND solid) AS substantive FROM s),
t0 AS (SELECT l.k, l.ix, l.p, unnest(CASE WHEN p % 18 = 0 THEN [] WHEN p % 8 = 0 THEN ['F' || p, 'F999999999'] ELSE ['F' || p] END) AS id FROM l WHERE k % 19 <> 0),
t AS (SELECT t0.*, g.solid, g.id IS NOT NULL AS known FROM t0 LEFT JOIN (SELECT k, id, bool_or(solid) AS solid FROM f WHERE id IS NOT NULL GROUP BY 1, 2) g ON g.k = t0.k AND g.id = t0.id),
u AS (SELECT k, ix, coalesce(bool_or(solid), false) AS supported FROM t GROUP BY 1, 2)"""
_SELECTOR = "(k % 11 <> 0 AND k % 5 > 1 AND k % 10 >= 5 AND k % 4 > 1)"
_NEWS = "(k % 14 <> 0 AND k % 15 <> 0 AND k % 4 <> 1)"
_USABLE = "(k % 16 <> 0 AND k % 3 <> 0)"
_SELECTED = "(CASE WHEN k % 67 = 0 THEN [] ELSE cs END)"
_THESES = "(CASE WHEN k % 19 = 0 THEN [] ELSE ts END)"
FINAL_SQL = _LINES + _FACTS + ", e AS (" + "\nUNION ALL ".join([
    _rows("w", [
        ("'brief.schema'", "not a brief", "k % 19 = 0 OR k % 23 = 0"), ("'evidence_pack.facts'", "fewer than three substantive facts", "substantive < 3"), ("'brief'", "research still open", "k % 19 <> 0 AND todo"),
        ("'brief.candidate_theses'", "theses do not match the selection", f"len(list_filter({_THESES}, lambda c: NOT list_contains({_SELECTED}, c))) + len(list_filter({_SELECTED}, lambda c: NOT list_contains({_THESES}, c))) > 0"),
        ("'forecast.coverage'", "forecast coverage below 75 %", "k % 20 < 15"), ("'selection.coverage'", "selection coverage below 75 %", "k % 25 / 25.0::DOUBLE < 0.75"), ("'backtest.period.evaluation_periods'", "fewer than 20 periods", "k % 11 = 0 OR k % 7 * 6 < 20"),
        ("'backtest.period.candidate_observations'", "fewer than 30 observations", "k % 11 = 0 OR k % 5 * 12 < 30"), ("'backtest.settings.round_trip_cost_bps'", "no costs deducted", "k % 11 = 0 OR k % 17 = 0"), ("'backtest.metrics'", "selector test failed", f"NOT {_SELECTOR}"),
        ("'news_coverage'", "news coverage missing or incomplete", f"NOT {_NEWS}"), ("'signal_backtest'", "sector signal missing or abstains", f"NOT {_USABLE}"), ("'evidence_pack.schema'", "unsupported schema", "k % 33 = 0"), ("'evidence_pack.facts'", "facts are no list", "k % 36 = 0"),
        ("'evidence_pack.topic'", "pack without a topic", "k % 33 <> 0 AND k % 34 = 0"),
    ]),
    _rows("w", [("'evidence_pack.facts'", "no facts", "held < 1"), ("'evidence_pack.facts'", "leads or metadata only among the facts", "held > substantive")], "warning"),
    _rows("(SELECT *, 'evidence_pack.facts' || ix AS path FROM f)", [
        ("path", "missing fact_id", "id IS NULL"), ("path", "duplicate fact_id", "copy > 1"), ("path", "missing claim", "p % 23 = 0"), ("path", "invalid source_url", "p % 29 = 0"), ("path", "invalid retrieved_at", "p % 19 = 0"), ("path", "missing unit", "p % 21 = 0"),
    ]),
    _rows("(SELECT *, 'brief.candidate_theses' || ix AS path FROM l WHERE k % 19 <> 0)", [
        ("path", "no supporting facts", "p % 18 = 0"), ("path", "invalid fundamental_verdict", "p % 45 = 0"), ("path", "invalid valuation_verdict", "p % 9 = 0"), ("path", "invalid catalyst_status", "p % 10 = 0"), ("path", "invalid risk_level", "p % 27 = 0"),
    ]),
    _rows("u", [("'brief.candidate_theses' || ix", "supported by leads or metadata only", "NOT supported")]),
    _rows("t", [("'brief.candidate_theses' || ix || '.' || id", "unknown fact", "NOT known")]),
]) + ")\n"

QUERIES = {
    "publication_errors": (publication_errors, ERRORS_SQL + "SELECT document, level, path, rule FROM e"),
    "publication_valid": (publication_valid, ERRORS_SQL + """, c AS (SELECT document, count(*) FILTER (WHERE level = 'error') AS errors, count(*) FILTER (WHERE level = 'warning') AS warnings FROM e GROUP BY 1)
SELECT o.k AS document, coalesce(errors, 0) = 0 AS valid, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings FROM o LEFT JOIN c ON c.document = o.k"""),
    "finalization_errors": (finalization_errors, FINAL_SQL + "SELECT document, level, path, rule FROM e"),
    "finalized_briefs": (finalized_briefs, FINAL_SQL + f""", c AS (SELECT document, count(*) FILTER (WHERE level = 'error') AS errors FROM e GROUP BY 1)
SELECT k AS document, coalesce(errors, 0) = 0 AS ready, coalesce(errors, 0) AS errors, substantive AS verified_fact_count, held AS total_fact_count, {_NEWS} AS news_coverage_complete, CASE WHEN k % 14 = 0 THEN 'missing' ELSE 'complete' END AS news_coverage_status,
  {_USABLE} AS sector_signal_usable, CASE WHEN k % 16 = 0 THEN 'missing' WHEN k % 3 = 0 THEN 'abstain' ELSE 'usable' END AS sector_signal_status, {_SELECTOR} AS selector_backtest_usable, CAST(CASE WHEN k % 11 = 0 THEN 0 ELSE k % 7 * 6 END AS INT) AS walk_forward_periods,
  CAST(CASE WHEN k % 11 = 0 THEN 0 ELSE k % 5 * 12 END AS INT) AS candidate_observations, k % 20 / 20.0::DOUBLE AS forecast_coverage, k % 25 / 25.0::DOUBLE AS selection_coverage, true AS all_causal_fields_resolved, k % 19 = 0 OR NOT todo AS candidate_verdicts_resolved,
  CASE WHEN coalesce(errors, 0) = 0 THEN 'publication_ready_for_conditional_recommendation' ELSE 'research_incomplete' END AS status FROM w LEFT JOIN c ON c.document = w.k"""),
}
