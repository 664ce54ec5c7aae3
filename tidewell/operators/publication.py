"""Publication rules over landed documents: what a forecast, its selection, tests, brief and recommendation break.

A publication is one row of JSON texts. They are read with fixed types, and the rules are a table of
conditions over the nested columns; conditions on lists are tested element by element where the list
stands. Facts can be many, so they are rows: a thesis meets them by equality of (document, fact id),
and what it names in vain is an anti-join.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.cuts import settle
from . import evidence
from .brief import TODO

# Names of schemas and the words that documents use.
SIGNAL, BACKTEST, SIGNAL_BACKTEST, BRIEF, RECOMMENDATION = "evidence.signal/1", "model.backtest/1", "model.signal-backtest/1", "prediction.brief/1", "stock.recommendation/1"
COVERAGE_SCHEMAS = ("news.collection.coverage/2", "browser.news.coverage/1")
EVIDENCE_SCHEMAS = ("evidence.source/1", "evidence.pack/1")
VERDICTS = {
    "fundamental_verdict": ("pass", "watch", "fail"),
    "valuation_verdict": ("attractive", "fair", "expensive", "not_meaningful"),
    "catalyst_status": ("confirmed", "plausible", "absent"),
    "risk_level": ("medium", "high", "very_high"),
}
UNCALIBRATED = "uncalibrated_direction_score"
NEXT_SESSION = "signal_at_close_earliest_execution_next_session"
#: Actions of a recommendation: to buy under conditions, to wait, to stay away.
ACTIONS = ("buy", "wait", "avoid")

#: Types of the documents; fields that are not named are not read.
TYPES = {
    "forecast": "schema string, signal_type string, as_of string, coverage double, values struct<forecasts: map<string, struct<score: double, probability_status: string, coverage: double>>>",
    "selection": "schema string, signal_type string, as_of string, coverage double, values struct<candidates: array<struct<code: string, name: string, score: double>>>",
    "backtest": "schema string, period struct<candidate_observations: int, evaluation_periods: int>, settings struct<round_trip_cost_bps: double>,"
    " metrics struct<mean_excess_return_pct: double, excess_hit_rate: double, median_net_return_pct: double>, score_buckets array<struct<bucket: string, probability_publishable: boolean, observations: int>>",
    "brief": "schema string, blogger_logic struct<contradiction: string>, publication_gate struct<ready: boolean, verified_fact_count: int, news_coverage_complete: boolean, sector_signal_usable: boolean, selector_backtest_usable: boolean>,"
    f" candidate_theses array<struct<code: string, supporting_fact_ids: array<string>, {', '.join(f'{v}: string' for v in VERDICTS)}>>",
    "recommendation": "schema string, suitability struct<risk_profile: string, status: string, single_cap_pct: double, theme_cap_pct: double, risk_budget_pct: double>,"
    " recommendations array<struct<code: string, action: string, model_position_pct: double, gate_checks: map<string, boolean>, trade_plan: struct<entry_condition: string, technical_stop_reference: double, execution_clock: string>,"
    " timing_evidence: struct<state: string, timing_backtest_gate: string>>>, portfolio_controls struct<recommended_theme_position_pct: double>",
    "news_coverage": "schema string, status string, gate struct<passed: boolean>",
    "signal_backtest": "schema string, gate struct<status: string>",
}
FACT = "fact_id string, claim string, publisher string, source_url string, retrieved_at string, period string, value string, unit string, evidence_role string, observation_scope string"


@dataclass(frozen=True)
class Rules:
    """Rules on one part of a publication: (path, what is wrong, the condition, in SQL over the typed columns).

    ``given`` says when they apply at all. With ``each`` they are tested for every element ``x`` of a list, and the path gets its index, or what ``label`` says.
    """

    checks: tuple[tuple[str, str, str], ...]
    given: str = "true"
    each: str | None = None
    level: str = "error"
    label: str = "i"

    def sql(self) -> str:
        at = f"concat({{p}}, '[', {self.label}, ']')" if self.each else "{p}"
        found = ", ".join(
            f"CASE WHEN ({self.given}) AND coalesce({broken}, false) THEN named_struct('level', '{self.level}', 'path', {at.format(p=repr(path))}, 'rule', '{rule}') END" for path, rule, broken in self.checks
        )
        return f"flatten(transform(coalesce({self.each}, array()), (x, i) -> array({found})))" if self.each else f"array({found})"


def _found(rules: Iterable[Rules]) -> Column:
    """The list of (level, path, rule) of the conditions that hold."""
    return F.expr(f"filter(concat({', '.join(r.sql() for r in rules)}), e -> e IS NOT NULL)")


def breaches(documents: DataFrame, rules: Iterable[Rules], key: str = "document") -> DataFrame:
    """(key, seq, level, path, rule): a row for each condition that holds, in the order of the table of rules."""
    return documents.select(F.col(key), F.posexplode(_found(rules)).alias("seq", "e")).select(key, "seq", "e.level", "e.path", "e.rule")


def typed(documents: DataFrame, names: Iterable[str]) -> DataFrame:
    """JSON texts read with their types; a text that is no object, or has no field at all, counts as missing. ``<name>_todo`` says whether research is still open in it."""
    out = documents
    for name in names:
        text = F.col(name)
        read = F.when(~F.coalesce(F.regexp_like(text, F.lit(r"^\s*\{\s*\}\s*$")), F.lit(True)) & F.startswith(F.ltrim(text), F.lit("{")), F.from_json(text, TYPES[name]))
        out = out.withColumns({f"{name}_todo": F.coalesce(F.contains(text, F.lit(f'"{TODO}"')), F.lit(False)), name: read})
    return out


_FORECAST = "forecast.values.forecasts[x]"
_CODES = "transform(selection.values.candidates, c -> coalesce(c.code, ''))"
_REC_CODES = "transform(recommendation.recommendations, r -> coalesce(r.code, ''))"
_TOTAL = "aggregate(coalesce(recommendation.recommendations, array()), CAST(0 AS DOUBLE), (t, r) -> t + coalesce(r.model_position_pct, 0))"
_ZERO = lambda path: f"coalesce({path}, 0)"


def _in(path: str, words: Iterable[str]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"coalesce({path} IN ({listed}), false)"


def _share(path: str, top: int) -> str:
    """Whether a number lies in 0 to ``top``; null and NaN do not."""
    return f"coalesce({path} >= 0 AND {path} <= {top} AND NOT isnan({path}), false)"


#: Everything a publication is held to, in order. ``publication`` rules apply to what is to be published, not to drafts.
PUBLICATION = (
    Rules((("forecast.schema", "not a sector trend forecast", f"forecast.schema IS DISTINCT FROM '{SIGNAL}' OR forecast.signal_type IS DISTINCT FROM 'sector_trend_forecast'"),)),
    Rules((
        ("forecast.values.forecasts.score", "score out of range", f"NOT {_share(f'{_FORECAST}.score', 100)}"),
        ("forecast.values.forecasts.probability_status", "probability not declared uncalibrated", f"{_FORECAST}.probability_status IS DISTINCT FROM '{UNCALIBRATED}'"),
        ("forecast.values.forecasts.coverage", "coverage out of range", f"NOT {_share(f'{_FORECAST}.coverage', 1)}"),
    ), each="array('5d', '20d')", label="x"),
    Rules((
        ("selection.schema", "not a stock selection", f"selection.schema IS DISTINCT FROM '{SIGNAL}' OR selection.signal_type IS DISTINCT FROM 'stock_selection'"),
        ("selection.values.candidates", "no candidates", "coalesce(size(selection.values.candidates), 0) < 1"),
        ("selection.values.candidates", "codes repeat", f"size({_CODES}) <> size(array_distinct({_CODES}))"),
    )),
    Rules((("selection.values.candidates", "invalid code or score", f"length(coalesce(x.code, '')) <> 6 OR NOT {_share('x.score', 100)}"),), each="selection.values.candidates"),
    Rules((("backtest.schema", "not a selector test", f"backtest.schema IS DISTINCT FROM '{BACKTEST}'"),), given="backtest IS NOT NULL"),
    Rules((
        ("backtest.period.candidate_observations", "fewer than 30 observations", f"{_ZERO('backtest.period.candidate_observations')} < 30"),
        ("backtest.period.evaluation_periods", "fewer than 20 periods", f"{_ZERO('backtest.period.evaluation_periods')} < 20"),
        ("backtest.settings.round_trip_cost_bps", "no costs deducted", f"{_ZERO('backtest.settings.round_trip_cost_bps')} <= 0"),
    ), given="backtest IS NOT NULL", level="warning"),
    Rules((
        ("backtest.period.evaluation_periods", "publication needs 20 periods", f"{_ZERO('backtest.period.evaluation_periods')} < 20"),
        ("backtest.period.candidate_observations", "publication needs 30 observations", f"{_ZERO('backtest.period.candidate_observations')} < 30"),
        ("backtest.settings.round_trip_cost_bps", "publication needs costs", f"{_ZERO('backtest.settings.round_trip_cost_bps')} <= 0"),
    ), given="publication AND backtest IS NOT NULL"),
    Rules((("backtest.score_buckets", "publishable on fewer than 30 observations", "x.probability_publishable AND coalesce(x.observations, 0) < 30"),), given="backtest IS NOT NULL", each="backtest.score_buckets"),
    Rules((("backtest", "publication needs a selector test", "true"),), given="publication AND backtest IS NULL"),
    Rules((
        ("brief.schema", "not a brief", f"brief.schema IS DISTINCT FROM '{BRIEF}'"),
        ("brief.blogger_logic.contradiction", "no opening contradiction", "coalesce(brief.blogger_logic.contradiction, '') = ''"),
    ), given="brief IS NOT NULL"),
    Rules((
        ("brief.publication_gate.ready", "gate not ready", "NOT coalesce(brief.publication_gate.ready, false)"),
        ("brief.publication_gate.verified_fact_count", "fewer than three verified facts", f"{_ZERO('brief.publication_gate.verified_fact_count')} < 3"),
        ("brief.publication_gate.news_coverage_complete", "news coverage incomplete", "NOT coalesce(brief.publication_gate.news_coverage_complete, false)"),
        ("brief.publication_gate.sector_signal_usable", "sector signal not usable", "NOT coalesce(brief.publication_gate.sector_signal_usable, false)"),
        ("brief.publication_gate.selector_backtest_usable", "selector test not usable", "NOT coalesce(brief.publication_gate.selector_backtest_usable, false)"),
        ("brief", "research still open", "brief_todo"),
    ), given="publication AND brief IS NOT NULL"),
    Rules((("brief", "publication needs a brief", "true"),), given="publication AND brief IS NULL"),
    Rules((
        ("recommendation.schema", "not a recommendation", f"recommendation.schema IS DISTINCT FROM '{RECOMMENDATION}'"),
        ("recommendation.suitability.risk_profile", "invalid risk profile", f"NOT {_in('recommendation.suitability.risk_profile', ('conservative', 'balanced', 'aggressive'))}"),
        ("recommendation.suitability.status", "personalization not declared", f"NOT {_in('recommendation.suitability.status', ('user_supplied', 'non_personalized_default'))}"),
        ("recommendation.suitability.risk_budget_pct", "no positive risk budget", f"{_ZERO('recommendation.suitability.risk_budget_pct')} <= 0"),
        ("recommendation.recommendations", "empty or codes repeat", f"coalesce(size({_REC_CODES}), 0) < 1 OR size({_REC_CODES}) <> size(array_distinct({_REC_CODES}))"),
        ("recommendation.recommendations", "codes outside the selection", f"size(array_except({_REC_CODES}, coalesce({_CODES}, array()))) > 0"),
    ), given="recommendation IS NOT NULL"),
    Rules((
        ("recommendation.recommendations", "invalid action", f"NOT {_in('x.action', ACTIONS)}"),
        ("recommendation.recommendations", "position outside the single cap", f"{_ZERO('x.model_position_pct')} < 0 OR {_ZERO('x.model_position_pct')} > {_ZERO('recommendation.suitability.single_cap_pct')} + 1e-9"),
        ("recommendation.recommendations", "buy without a position", f"x.action = 'buy' AND {_ZERO('x.model_position_pct')} <= 0"),
        ("recommendation.recommendations", "buy failed a gate", "x.action = 'buy' AND exists(map_values(coalesce(x.gate_checks, map())), g -> NOT coalesce(g, false))"),
        ("recommendation.recommendations", "buy without entry or stop", "x.action = 'buy' AND (coalesce(x.trade_plan.entry_condition, '') = '' OR coalesce(x.trade_plan.technical_stop_reference, 0) = 0)"),
        ("recommendation.recommendations", "buy without a timing state", f"x.action = 'buy' AND NOT {_in('x.timing_evidence.state', ('triggered', 'retest'))}"),
        ("recommendation.recommendations", "buy without a usable timing test", "x.action = 'buy' AND x.timing_evidence.timing_backtest_gate IS DISTINCT FROM 'usable'"),
        ("recommendation.recommendations", "buy without a next-session clock", f"x.action = 'buy' AND x.trade_plan.execution_clock IS DISTINCT FROM '{NEXT_SESSION}'"),
        ("recommendation.recommendations", "position without a buy", f"x.action IS DISTINCT FROM 'buy' AND {_ZERO('x.model_position_pct')} <> 0"),
    ), given="recommendation IS NOT NULL", each="recommendation.recommendations"),
    Rules((
        ("recommendation.recommendations", "theme cap exceeded", f"{_TOTAL} > {_ZERO('recommendation.suitability.theme_cap_pct')} + 1e-6"),
        ("recommendation.portfolio_controls", "reported total differs", f"abs({_TOTAL} - {_ZERO('recommendation.portfolio_controls.recommended_theme_position_pct')}) > 0.02"),
    ), given="recommendation IS NOT NULL"),
    Rules((("recommendation", "publication needs a recommendation", "true"),), given="publication AND recommendation IS NULL"),
)


def validate_publications(documents: DataFrame, key: str = "document") -> DataFrame:
    """(key, seq, level, path, rule): what each publication breaks, in order; one that breaks nothing has no row.

    ``documents`` has the key, JSON texts ``forecast``, ``selection``, ``backtest``, ``brief`` and ``recommendation`` (null or empty:
    missing), and ``publication``, whether it is to be published. No shuffle: every rule is tested where the row stands.
    """
    return breaches(typed(documents, ("forecast", "selection", "backtest", "brief", "recommendation")), PUBLICATION, key)


def publication_verdicts(documents: DataFrame, key: str = "document") -> DataFrame:
    """``verdict_of`` for documents of ``validate_publications`` with a row a key: breaches are counted where the row stands, without a shuffle. A null key has none, as in the join."""
    levels = typed(documents, ("forecast", "selection", "backtest", "brief", "recommendation")).select(key, F.transform(_found(PUBLICATION), lambda e: e["level"]).alias("levels"))
    count = lambda level: F.when(F.col(key).isNull(), 0).otherwise(F.size(F.filter("levels", lambda x: x == level))).cast("long")
    return levels.select(key, (count("error") == 0).alias("valid"), count("error").alias("errors"), count("warning").alias("warnings"))


def verdict_of(documents: DataFrame, found: DataFrame, key: str = "document") -> DataFrame:
    """(key, valid, errors, warnings) for every document, those without a breach included."""
    counts = found.groupBy(key).agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return documents.select(key).join(counts, key, "left").select(key, (F.coalesce("errors", F.lit(0)) == 0).alias("valid"), zero("errors"), zero("warnings"))


def _entries(pack: str) -> Column:
    """The list of a pack's facts, each as (is_object, f); null where there is no list."""
    listed = F.get_json_object(pack, "$.facts")
    entry = lambda e: F.struct(F.coalesce(F.startswith(e, F.lit("{")), F.lit(False)).alias("is_object"), F.from_json(e, FACT).alias("f"))
    return F.when(_is_list(listed), F.transform(F.from_json(listed, "array<string>"), entry))


def _fact_rows(packs: DataFrame, key: str, entries: str) -> DataFrame:
    return packs.select(key, F.posexplode(entries).alias("seq", "e")).select(key, "seq", "e.is_object", "e.f.*")


def pack_facts(packs: DataFrame, key: str = "document", pack: str = "evidence_pack") -> DataFrame:
    """(key, seq, is_object, the fields of a fact): the entries of each pack's list of facts."""
    return _fact_rows(packs.select(key, _entries(pack).alias("entries")), key, "entries")


def _pack_head(pack: str) -> dict[str, Column]:
    field = lambda name: F.get_json_object(pack, f"$.{name}")
    return {"schema": field("schema"), "topic": field("topic"), "listed": _is_list(field("facts"))}


def _is_list(text: Column) -> Column:
    return F.coalesce(F.startswith(F.ltrim(text), F.lit("[")), F.lit(False))


def validate_packs(packs: DataFrame, key: str = "document", pack: str = "evidence_pack") -> DataFrame:
    """(key, seq, level, path, rule): what the evidence packs and their facts break.

    A fact id may stand once in a pack. A pack that is missing has no schema and no list.
    """
    return _broken_packs(packs.select(key, *[c.alias(n) for n, c in _pack_head(pack).items()]), pack_facts(packs, key, pack), key)


def _broken_packs(head: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``validate_packs`` of what is read already: (key, schema, topic, listed) and the rows of facts."""
    checked = evidence.validate_facts(facts.where("is_object"), [key])
    weak = checked.where(~evidence.substantive()).groupBy(key).agg(F.count("*").alias("weak"))
    some = facts.groupBy(key).agg(F.count("*").alias("held"))
    wide = head.join(some, key, "left").join(weak, key, "left")
    listed = ", ".join(f"'{s}'" for s in EVIDENCE_SCHEMAS)
    whole = breaches(wide, (
        Rules((("schema", "unsupported schema", f"NOT coalesce(schema IN ({listed}), false)"), ("facts", "facts are no list", "NOT listed"),
               ("topic", "pack without a topic", "schema = 'evidence.pack/1' AND trim(coalesce(topic, '')) = ''"))),
        Rules((("facts", "no facts", "coalesce(held, 0) < 1"), ("facts", "leads or metadata only among the facts", "weak > 0")), level="warning"),
    ), key)
    at = F.concat(F.lit("facts["), F.col("seq"), F.lit("]"))
    one = lambda level, kind: checked.select(key, "seq", F.lit(level).alias("level"), at.alias("path"), F.explode(kind).alias("rule"))
    odd = facts.where("NOT is_object").select(key, "seq", F.lit("error").alias("level"), at.alias("path"), F.lit("fact is no object").alias("rule"))
    return whole.unionByName(one("error", "errors")).unionByName(one("warning", "warnings")).unionByName(odd)


_METRIC = lambda name: f"coalesce(backtest.metrics.{name}, 0)"
_SELECTOR = f"({_METRIC('mean_excess_return_pct')} > 0 AND {_METRIC('excess_hit_rate')} >= 0.5 AND {_METRIC('median_net_return_pct')} > 0)"
_NEWS = f"({_in('news_coverage.schema', COVERAGE_SCHEMAS)} AND coalesce(news_coverage.gate.passed, false))"
_SIGNAL_USABLE = f"(coalesce(signal_backtest.schema = '{SIGNAL_BACKTEST}', false) AND coalesce(signal_backtest.gate.status = 'usable', false))"
_THESES = "transform(coalesce(brief.candidate_theses, array()), t -> coalesce(t.code, 'None'))"
_SELECTED = "transform(coalesce(selection.values.candidates, array()), c -> coalesce(c.code, 'None'))"

#: What a finished brief is held to, beside its theses and facts.
FINAL = (
    Rules((
        ("brief.schema", "not a brief", f"brief.schema IS DISTINCT FROM '{BRIEF}'"),
        ("evidence_pack.facts", "fewer than three substantive facts", "substantive < 3"),
        ("brief", "research still open", "brief_todo"),
        ("brief.candidate_theses", "theses do not match the selection", f"size(array_except({_THESES}, {_SELECTED})) + size(array_except({_SELECTED}, {_THESES})) > 0"),
        ("forecast.coverage", "forecast coverage below 75 %", f"{_ZERO('forecast.coverage')} < 0.75"),
        ("selection.coverage", "selection coverage below 75 %", f"{_ZERO('selection.coverage')} < 0.75"),
        ("backtest.period.evaluation_periods", "fewer than 20 periods", f"{_ZERO('backtest.period.evaluation_periods')} < 20"),
        ("backtest.period.candidate_observations", "fewer than 30 observations", f"{_ZERO('backtest.period.candidate_observations')} < 30"),
        ("backtest.settings.round_trip_cost_bps", "no costs deducted", f"{_ZERO('backtest.settings.round_trip_cost_bps')} <= 0"),
        ("backtest.metrics", "selector test failed", f"NOT {_SELECTOR}"),
        ("news_coverage", "news coverage missing or incomplete", f"NOT {_NEWS}"),
        ("signal_backtest", "sector signal missing or abstains", f"NOT {_SIGNAL_USABLE}"),
    )),
)


def _theses(documents: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """(key, seq, level, path, rule) of theses: their verdicts where they stand, their facts by joins on (document, fact id)."""
    rows = documents.select(key, F.posexplode("brief.candidate_theses").alias("seq", "t")).select(key, "seq", "t.*")
    named = rows.select(key, "seq", F.explode(F.array_distinct("supporting_fact_ids")).alias("fact_id"))
    known = facts.where("coalesce(fact_id, '') <> ''").groupBy(key, "fact_id").agg(F.max(evidence.substantive()).alias("solid"))
    solid = named.join(known.where("solid"), [key, "fact_id"], "left_semi").select(key, "seq").distinct()
    lost = named.join(known, [key, "fact_id"], "left_anti")
    at = F.concat(F.lit("brief.candidate_theses["), F.col("seq"), F.lit("]"))

    def row(df: DataFrame, rule: Column, path: Column = at) -> DataFrame:
        return df.select(key, "seq", F.lit("error").alias("level"), path.alias("path"), rule.alias("rule"))

    bare = rows.where("coalesce(size(supporting_fact_ids), 0) < 1")
    weak = rows.where("size(supporting_fact_ids) > 0").join(solid, [key, "seq"], "left_anti")
    wrong = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(v).isin(*words), F.lit(False)), F.lit(f"invalid {v}")) for v, words in VERDICTS.items()]))
    return (
        row(bare, F.lit("no supporting facts")).unionByName(row(weak, F.lit("supported by leads or metadata only")))
        .unionByName(row(lost, F.lit("unknown fact"), F.concat(at, F.lit("."), F.col("fact_id")))).unionByName(row(rows, F.explode(wrong)))
    )


def finalize(documents: DataFrame, key: str = "document") -> tuple[DataFrame, DataFrame]:
    """The publication gate of briefs: (gates, a row a document; breaches as (key, seq, level, path, rule)).

    ``documents`` has one row a key, with JSON texts ``brief``, ``forecast``, ``selection``, ``backtest``, ``evidence_pack``, ``news_coverage`` and
    ``signal_backtest``; null means missing. A brief is ready if nothing is broken, its pack's own errors included; a pack's warnings are handed on.
    """
    read = typed(documents.withColumn("__brief", F.col("brief")), ("brief", "forecast", "selection", "backtest", "news_coverage", "signal_backtest"))
    open_in = lambda part: F.coalesce(F.contains(F.get_json_object("__brief", f"$.{part}"), F.lit(f'"{TODO}"')), F.lit(False))
    # every text is read once; the branches below take what they need of it
    read = settle(read.select(
        key, "brief", "brief_todo", "forecast", "selection", "backtest", "news_coverage", "signal_backtest", (~open_in("blogger_logic")).alias("all_causal_fields_resolved"), (~open_in("candidate_theses")).alias("candidate_verdicts_resolved"),
        F.struct(*[c.alias(n) for n, c in _pack_head("evidence_pack").items()]).alias("pack"), _entries("evidence_pack").alias("entries"),
    ))
    facts = _fact_rows(read, key, "entries")
    counts = facts.where("is_object").groupBy(key).agg(F.count("*").alias("total"), F.count_if(evidence.substantive()).alias("substantive"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    wide = read.drop("pack", "entries").join(counts, key, "left").withColumns({"total": zero("total"), "substantive": zero("substantive")})
    pack = _broken_packs(read.select(key, "pack.*"), facts, key).withColumn("path", F.concat(F.lit("evidence_pack."), "path"))
    found = breaches(wide, FINAL, key).unionByName(_theses(wide, facts, key)).unionByName(pack)
    broken = found.where("level = 'error'").groupBy(key).agg(F.count("*").alias("errors"))
    n = lambda path: F.coalesce(F.expr(path), F.lit(0))
    gates = wide.join(broken, key, "left").select(
        key, (F.coalesce("errors", F.lit(0)) == 0).alias("ready"), zero("errors"), F.col("substantive").alias("verified_fact_count"), F.col("total").alias("total_fact_count"),
        F.expr(_NEWS).alias("news_coverage_complete"), F.coalesce("news_coverage.status", F.lit("missing")).alias("news_coverage_status"), F.expr(_SIGNAL_USABLE).alias("sector_signal_usable"),
        F.coalesce("signal_backtest.gate.status", F.lit("missing")).alias("sector_signal_status"), F.expr(_SELECTOR).alias("selector_backtest_usable"), n("backtest.period.evaluation_periods").alias("walk_forward_periods"),
        n("backtest.period.candidate_observations").alias("candidate_observations"), n("forecast.coverage").alias("forecast_coverage"), n("selection.coverage").alias("selection_coverage"), "all_causal_fields_resolved", "candidate_verdicts_resolved",
        F.when(F.coalesce("errors", F.lit(0)) == 0, "publication_ready_for_conditional_recommendation").otherwise("research_incomplete").alias("status"),
    )
    return gates, found
