"""Queries over facts, coverage, recommendations, outlooks and the journal."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import backtest, brief, coverage, decision, evidence, journal, scoring, timeseries, timing
from ..sources import panels
from . import prices, sql
from .cuts import cut

REFERENCE_DAY = "2024-07-01"
RUN_FIELDS = ("run_id", "topic", "stance", "decision")


def facts(spark, d):
    """Pages as cited facts, with the faults that a validator must find planted by page number."""
    p = panels.table(spark, d, "pages")
    k = F.col("page_id")
    fault = lambda n, good, bad=None: F.when(k % n == 0, F.lit(bad)).otherwise(good)
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1))
    return p.select(
        k.alias("seq"), fault(23, F.concat(F.lit("PG-"), F.substring(F.sha2(F.concat(host, (k % 40).cast("string")), 256), 1, 12)), "").alias("fact_id"), host.alias("document"), fault(11, F.concat(F.lit("claim "), k.cast("string"))).alias("claim"),
        (k * 1.5).alias("value"), fault(7, F.lit("pct")).alias("unit"), F.lit("2024-01").alias("period"), fault(19, host).alias("publisher"), F.when(k % 17 == 0, F.concat(F.lit("ftp://"), host)).when(k % 29 == 0, F.concat("url", F.lit("?key=REDACTED"))).otherwise(F.col("url")).alias("source_url"),
        fault(13, F.lit("2024-01-31T08:00:00"), "yesterday").alias("retrieved_at"), F.when(k % 3 == 0, "discovery_lead").when(k % 4 == 0, "official").alias("evidence_role"), F.when(k % 5 == 0, "metadata_only").alias("observation_scope"),
    )


def fact_validation(spark, d):
    v = evidence.validate_facts(facts(spark, d))
    return v.select("seq", F.array_join(F.array_sort("errors"), ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"))


def doc_validation(spark, d):
    v = evidence.validate_facts(facts(spark, d), ["document"])
    return evidence.validate_documents(v, "document")


def evidence_pack(spark, d):
    f = facts(spark, d).select("fact_id", "claim", "publisher", "evidence_role", "observation_scope")
    n = panels.news_events(spark, d).select(F.concat(F.lit("EV-"), F.col("event_id").cast("string")).alias("fact_id"), F.col("direction").alias("claim"), F.lit("event").alias("evidence_role"))
    return evidence.evidence_pack(f, n).groupBy("evidence_role").agg(F.count("*").alias("facts"), F.countDistinct("fact_id").alias("fact_ids"), F.count_if(evidence.substantive()).alias("substantive"))


def _attempts(spark, d):
    docs = panels.table(spark, d, "documents")
    k = F.min("doc_id")
    return docs.groupBy(F.col("lang").alias("topic"), "source").agg(
        F.when(k % 5 == 0, "failed").when(k % 31 != 0, "success").alias("outcome"), F.when(k % 3 == 0, "cached").when(k % 7 == 0, "stale").otherwise("fresh").alias("retrieval"), F.count_if(F.contains("text", F.lit("tion"))).alias("matched"),
    )


def source_outcomes_gate(spark, d):
    return evidence.source_gate(_attempts(spark, d), "topic")


def _browser(spark, d):
    n = panels.table(spark, d, "nation")
    plan = n.join(panels.table(spark, d, "region"), n["n_regionkey"] == F.col("r_regionkey")).select(F.col("r_name").alias("topic"), F.col("n_nationkey").alias("site_id"))
    outcomes = F.array(*[F.lit(x) for x in ("no_relevant_result", "paywalled", "failed", "search_results_only", "login_required", "opened_original")])
    attempts = panels.table(spark, d, "supplier").select(F.col("s_nationkey").alias("site_id"), F.col("s_suppkey").alias("seq"), F.get(outcomes, (F.col("s_suppkey") % 6).cast("int")).alias("outcome"))
    access = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "open").when(F.col("c_mktsegment") == "BUILDING", "paywalled").when(F.col("c_mktsegment") == "MACHINERY", "login_required").otherwise("unknown")
    pages = panels.table(spark, d, "customer").select(F.col("c_nationkey").alias("site_id"), F.col("c_custkey").alias("seq"), access.alias("access_state"), F.when(F.col("c_custkey") % 2 == 0, "visible_original_page").otherwise("search_result").alias("capture_method"))
    return plan, attempts, pages


def coverage_gate(spark, d):
    return evidence.coverage_gate(*_browser(spark, d), "topic")


def collection_gate(spark, d):
    """Primary sources by language against the browser fallback of a region."""
    primary = source_outcomes_gate(spark, d).withColumn("topic", F.when(F.col("topic") == "en", "AMERICA").when(F.col("topic") == "de", "EUROPE").when(F.col("topic") == "es", "AFRICA").otherwise("NOWHERE"))
    return evidence.collection_gate(primary, coverage_gate(spark, d), "topic")


def site_match(spark, d):
    p = panels.table(spark, d, "pages")
    plan = p.select(F.regexp_extract(F.lower(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("domain")).where("domain <> ''").distinct()
    return evidence.match_sites(p, plan).groupBy("domain").agg(F.count("*").alias("pages"))


def _candidates(spark, d):
    """The top stocks of each sector with everything a recommendation reads; verdicts follow from the brand's number."""
    b = panels.bars(spark, d)
    f = cut(timeseries.features(b))
    last = f.where("role = 'sector'").groupBy("sector").agg(F.max("date").alias("as_of"))
    top = scoring.ranked(scoring.stock_scores(scoring.as_of_features(f, last)), ["sector", "as_of"]).where("rank <= 3").select("sector", "code", "score", "coverage")
    s = scoring.sector_scores(f).groupBy("sector").agg(F.max_by("score_20d", "date").alias("sector_score"), F.max_by("coverage_20d", "date").alias("sector_coverage"))
    m = backtest.selector_metrics(backtest.selector_observations(b, f))
    states = timing.states(b.where("role = 'stock'"))
    now = states.groupBy("code").agg(F.max_by("state", "date").alias("timing_state"), F.max_by("risk_distance_pct", "date").alias("risk_distance_pct"))
    gates = timing.timing_gate(timing.trade_metrics(timing.trades(b, timing.candidates(b.where("role = 'stock'"), states, start=prices.START))), prices.START).select("code", F.col("status").alias("timing_gate"))
    n = F.regexp_extract("code", r"(\d+)", 1).cast("int")
    pick = lambda xs, k: F.get(F.array(*[F.lit(x) for x in xs]), k)
    return top.join(s, "sector").join(m, "sector").join(now, "code", "left").join(gates, "code", "left").withColumns({
        "mean_excess": F.col("mean_excess_return_pct"), "excess_hit": F.col("excess_hit_rate"), "fundamental_verdict": pick(("pass", "watch", "fail"), n % 3), "valuation_verdict": pick(("fair", "attractive", "expensive", "not_meaningful"), n % 4),
        "catalyst_status": pick(("confirmed", "plausible", "absent"), (n + 1) % 3), "risk_level": pick(("medium", "high", "medium", "very_high"), (n + 2) % 4),
    })


def recommendation(spark, d):
    r = decision.recommend(_candidates(spark, d))
    return r.select("sector", "code", "action", "buy_gate", "conviction", "position_pct", F.col("order").cast("long").alias("place"), "timing_state", F.coalesce("timing_gate", F.lit("missing")).alias("timing_gate"))


def portfolio_controls(spark, d):
    return decision.portfolio_controls(decision.recommend(_candidates(spark, d)))


def sizing(spark, d):
    """Sizes where the gates are forced open, so that the caps and the theme's scale bind; half by a valuation without meaning, as a pipeline's is."""
    c = _candidates(spark, d)
    n = F.regexp_extract("code", r"(\d+)", 1).cast("int")
    opened = c.withColumns({"score": F.greatest(F.col("score"), F.lit(65.0)) + F.regexp_extract("code", r"(\d+)", 1).cast("double"), "sector_score": F.lit(70.0), "mean_excess": F.lit(1.0), "excess_hit": F.lit(0.6), "fundamental_verdict": F.lit("pass"), "valuation_verdict": F.when(n % 2 == 0, "not_meaningful").otherwise("fair"), "valuation_framework": F.when(n % 4 == 0, decision.PIPELINE_VALUATION), "technical_risk_pct": 5.0 + n / 4,
                            "catalyst_status": F.lit("confirmed"), "risk_level": F.lit("medium"), "timing_state": F.lit("triggered"), "timing_gate": F.lit("usable"), "risk_distance_pct": 6.0 + F.regexp_extract("code", r"(\d+)", 1).cast("double") / 5})
    r = decision.recommend(opened, "conservative")
    return r.select("sector", "code", "action", "conviction", "position_pct")


def publication_gate(spark, d):
    b = panels.bars(spark, d)
    f = cut(timeseries.features(b))
    scored = scoring.sector_scores(f)
    s = scored.groupBy("sector").agg(F.max_by("coverage_20d", "date").alias("forecast_coverage"))
    m = backtest.selector_metrics(backtest.selector_observations(b, f))
    g = backtest.sector_gate(backtest.sector_observations(b, scored), scored).select("sector", F.col("status").alias("signal_status"))
    # one pack and one coverage result for all sectors: rows of one value each
    n = F.broadcast(facts(spark, d).agg(F.count_if(evidence.substantive()).alias("substantive_facts")))
    news = F.broadcast(coverage_gate(spark, d).agg(F.bool_and("passed").alias("news_passed")))
    inputs = s.join(m, "sector").join(g, "sector").crossJoin(n).crossJoin(news).withColumns({"selection_coverage": F.lit(1.0), "cost_bps": F.lit(20.0)})
    return decision.publication_gate(inputs).select("sector", *decision.CHECKS, "failed", "ready")


def _last_features(bars):
    f = cut(timeseries.features(bars))
    return f.where("role = 'stock'").groupBy("code").agg(F.max_by(F.struct(*[c for c in f.columns if c not in ("code", "role")]), "date").alias("f")).select("code", "f.*")


def _features(spark, d):
    return cut(timeseries.features(panels.bars(spark, d)))


def trade_plan(spark, d):
    """Entry, risk and stop of every stock on its last day; every third by its timing state, the others by the fallback."""
    b = panels.bars(spark, d)
    t = timing.states(b.where("role = 'stock'")).groupBy("code").agg(*[F.max_by(c, "date").alias(n) for c, n in (("stop", "timing_stop"), ("risk_distance_pct", "timing_risk_pct"), ("review_2r", "timing_review"))])
    third = F.regexp_extract("code", r"(\d+)", 1).try_cast("int") % 3 == 0
    t = t.where(third)
    p = brief.trade_plan(_last_features(b).join(t, "code", "left"))
    return p.select("code", "ma20_reference", "ma60_reference", "entry", "technical_risk_pct", "technical_stop", "review_level", "risk_method")


def prediction_brief(spark, d):
    """Scaffolds of the sectors on their last day: whether the terms contradict, and what is left to research."""
    f = _features(spark, d)
    s = scoring.sector_scores(f).groupBy("sector").agg(F.max_by("regime_5d", "date").alias("regime_5d"), F.max_by("regime_20d", "date").alias("regime_20d"))
    last = f.where("role = 'sector'").groupBy("sector").agg(F.max("date").alias("as_of"))
    c = scoring.ranked(scoring.stock_scores(scoring.as_of_features(f, last)), ["sector", "as_of"]).where("rank <= 3").select("sector", "code", "rank", "score")
    b = brief.brief(s, c)
    doc = F.struct("causal", "candidate_theses")
    return b.select("sector", "contradicts", F.col("causal.contradiction").alias("contradiction"), F.size("candidate_theses").cast("long").alias("theses"), brief.has_todo(doc).alias("unfinished"), brief.todo_count(doc).alias("open_fields"), "status")


def prediction_validation(spark, d):
    """The forced sizes of ``sizing`` with faults planted by the brand's number, and what the validator finds."""
    r = sizing(spark, d)
    n = F.regexp_extract("code", r"(\d+)", 1).try_cast("int")
    total = r.groupBy("sector").agg(F.sum("position_pct").alias("reported_total"))
    x = r.join(total, "sector").withColumns({
        "position_pct": F.when(n % 7 == 0, F.col("position_pct") + 10).otherwise(F.col("position_pct")), "action": F.when(n % 5 == 0, "sell").otherwise(F.col("action")), "buy_gate": n % 4 != 0, "timing_state": F.when(n % 3 == 0, "watch").otherwise("retest"),
        "timing_gate": F.when(n % 2 == 0, "usable"), "technical_stop": F.when(n % 11 != 0, 1.0),
    })
    return brief.recommendation_errors(x, "conservative")


def outlook_plan(spark, d):
    return decision.outlook_plan(decision.asked_outlooks(spark))


def runs(spark, d):
    x = panels.table(spark, d, "documents")
    k = F.col("doc_id")
    pick = lambda xs, i: F.get(F.array(*[F.lit(v) for v in xs]), i.cast("int"))
    h = F.when(k % 2 == 0, 5).otherwise(20)
    r = x.select(
        k.alias("run_id"), F.concat_ws(" ", "source", "lang").alias("topic"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")).alias("as_of"), F.concat(h.cast("string"), F.lit("d")).alias("horizon"), h.alias("days"),
        F.array(F.concat(F.lit("Brand#"), (k % 25 + 1).cast("string"))).alias("instruments"), F.when(k % 9 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", "source")).alias("tags"), pick(("bullish", "bearish", "neutral", "mixed", "abstain", "not_applicable"), k % 6).alias("stance"),
        pick(("hold", "buy", "avoid"), k % 3).alias("decision"), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t-\r]+", " ")).alias("thesis"),
    )
    r = r.withColumn("review_date", F.when(F.col("run_id") % 11 != 0, decision.review_date(F.col("as_of"), F.col("days"))))
    honest = journal.fingerprint(*RUN_FIELDS)
    return r.withColumn("fingerprint", F.when(F.col("run_id") % 97 == 0, F.lit("tampered")).otherwise(honest))


def reviews(spark, d):
    x = panels.table(spark, d, "labels")
    k = F.col("doc_id")
    realized = ((k * 37) % 2001 - 1000) / 100.0
    return x.select(
        (k * 10).alias("review_id"), F.when(k % 83 == 0, -k).otherwise(k).alias("run_id"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 300 + k % 40).cast("int")).alias("observed_at"), F.when(F.col("toxic") == 1, "refuted").otherwise("confirmed").alias("thesis_status"),
        realized.alias("realized"), F.when(k % 4 != 0, 1.0).alias("benchmark"), F.when(k % 4 != 0, realized - 1.0).alias("excess"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("decision_quality"),
    )


def journal_search(spark, d):
    found = journal.search(runs(spark, d), query="ti", tag="EN", decision="BU", date_from="2024-02-01")
    return journal.newest(found, 50).select("run_id", "as_of", "stance", "decision")


def review_queue(spark, d):
    return journal.review_queue(runs(spark, d), reviews(spark, d), REFERENCE_DAY, 30, include_unscheduled=True)


def _stats(by):
    def query(spark, d):
        return journal.stats(runs(spark, d), reviews(spark, d), by)

    return query


def journal_statistics(spark, d):
    s = journal.statistics(runs(spark, d), reviews(spark, d))
    shown = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(c)
    return s.withColumns({c: shown(c) for c in ("thesis_status_counts", "decision_quality_counts")})


def _planned(spark, d):
    """A plan of sites for each region: its nations; suppliers are attempts, customers are pages, some of them of the next nation's domain or with another's name."""
    n = panels.table(spark, d, "nation").join(panels.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("int").alias("n"), F.col("n_name").alias("publisher"), F.col("r_name").alias("topic"))
    domain = lambda c: F.concat(F.lower(F.regexp_replace(c, " ", "-")), F.lit(".example.com"))
    plan = n.select("topic", F.col("n").alias("ordinal"), F.concat(F.lit("site-"), "n").alias("site_id"), "publisher", domain(F.col("publisher")).alias("domain"), (F.col("n") % 7 != 6).alias("must_attempt"))
    words = F.array(*[F.lit(x) for x in ("no_relevant_result", "paywalled", "failed", "search_results_only", "login_required", "opened_original", "guessed")])
    s = panels.table(spark, d, "supplier").select(F.col("s_nationkey").cast("int").alias("n"), F.col("s_suppkey").alias("seq")).join(n, "n")
    attempts = s.select("topic", F.when(F.col("seq") % 10 == 0, "nowhere").otherwise(F.concat(F.lit("site-"), "n")).alias("site_id"), "seq", F.get(words, (F.col("seq") % 7).cast("int")).alias("outcome"))
    following = n.select(((F.col("n") + 24) % 25).alias("n"), F.col("publisher").alias("next"))
    c = panels.table(spark, d, "customer").select(F.col("c_nationkey").cast("int").alias("n"), F.col("c_custkey").alias("page_id"), "c_mktsegment").join(n, "n").join(following, "n")
    k = F.col("page_id")
    host = F.concat(F.lit("https://www."), F.when(k % 5 == 0, domain(F.col("next"))).otherwise(domain(F.col("publisher"))), F.lit(":443/x?q=1"))
    access = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "open").when(F.col("c_mktsegment") == "BUILDING", "paywalled").when(F.col("c_mktsegment") == "MACHINERY", "login_required")
    pages = c.select("topic", "page_id", F.when(k % 3 == 0, F.concat(F.lit("  "), F.lower("publisher"))).otherwise("Other").alias("publisher"), F.when(k % 4 == 0, "https://nowhere.org/").otherwise(host).alias("url"), access.alias("access_state"), F.when(k % 11 == 0, "visible_original_page").alias("capture_method"))
    return plan, attempts, pages


def page_sites(spark, d):
    plan, _, pages = _planned(spark, d)
    return coverage.match_pages(pages, plan, "topic")


def site_coverage(spark, d):
    g = coverage.gate(*_planned(spark, d), "topic", "site-7")
    return g.withColumns({c: F.array_join(c, ";") for c in ("missing_publishers", "failed_publishers", "unresolved_publishers", "warnings")})


def journal_verify(spark, d):
    return journal.verify(runs(spark, d), reviews(spark, d), RUN_FIELDS)


def run_comparison(spark, d):
    return journal.compare(runs(spark, d), reviews(spark, d), [1, 2, 3, 5, 8, 13, 21])


def auto_review(spark, d):
    b = panels.bars(spark, d)
    asked = runs(spark, d).select("run_id", F.col("instruments")[0].alias("code"), F.date_add(F.lit("1998-01-01").cast("date"), (F.col("run_id") * 3 % 1450).cast("int")).alias("as_of"), "days", "stance", (F.col("run_id") % 2 == 0).alias("abstention_supported"))
    return journal.auto_review(asked, b.where("role <> 'market'"), b.where("role = 'stock'").select("code", F.col("sector").alias("bench")).distinct())


# --- SQL ---

_FACT = """WITH f AS (SELECT page_id AS seq, CASE WHEN page_id % 23 = 0 THEN '' ELSE 'PG-' || substr(sha256(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) || CAST(page_id % 40 AS VARCHAR)), 1, 12) END AS fact_id,
  lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS document, CASE WHEN page_id % 11 <> 0 THEN 'claim ' || page_id END AS claim, page_id % 7 = 0 AS no_unit, CASE WHEN page_id % 19 <> 0 THEN lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) END AS publisher,
  page_id % 17 = 0 AS bad_url, page_id % 17 <> 0 AND page_id % 29 = 0 AS redacted, page_id % 13 = 0 AS bad_time, CASE WHEN page_id % 3 = 0 THEN 'discovery_lead' WHEN page_id % 4 = 0 THEN 'official' END AS evidence_role, page_id % 3 <> 0 AND page_id % 5 <> 0 AS sub FROM pages)"""


_SITES = """WITH plan AS (SELECT n_nationkey AS n, r_name AS topic, lower(n_name) AS key, lower(replace(n_name, ' ', '-')) || '.example.com' AS domain, n_nationkey % 7 <> 6 AS must FROM nation JOIN region ON n_regionkey = r_regionkey),
att AS (SELECT s_nationkey AS n, p.topic, s_suppkey AS seq, s_suppkey % 10 = 0 AS lost, ['no_relevant_result', 'paywalled', 'failed', 'search_results_only', 'login_required', 'opened_original', 'guessed'][s_suppkey % 7 + 1] AS o FROM supplier JOIN plan p ON p.n = s_nationkey),
pg AS (SELECT c_custkey AS page_id, p.topic, CASE WHEN c_custkey % 3 = 0 THEN p.key ELSE 'other' END AS pub, CASE WHEN c_custkey % 4 = 0 THEN 'nowhere.org' ELSE 'www.' || CASE WHEN c_custkey % 5 = 0 THEN q.domain ELSE p.domain END END AS host,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'paywalled' WHEN c_mktsegment = 'MACHINERY' THEN 'login_required' WHEN c_mktsegment = 'AUTOMOBILE' AND c_custkey % 11 = 0 THEN 'opened_original' ELSE 'search_results_only' END AS o FROM customer JOIN plan p ON p.n = c_nationkey JOIN plan q ON q.n = (c_nationkey + 1) % 25),
met AS (SELECT pg.topic, pg.page_id, 'site-' || min(p.n) AS site_id FROM pg JOIN plan p ON p.topic = pg.topic AND (pg.pub = p.key OR pg.host = p.domain OR ends_with(pg.host, '.' || p.domain)) GROUP BY 1, 2)"""


def _errors(by: str) -> str:
    return f"""list_filter([CASE WHEN fact_id = '' THEN 'missing fact_id' WHEN row_number() OVER (PARTITION BY {by}fact_id ORDER BY seq) > 1 THEN 'duplicate fact_id' END, CASE WHEN claim IS NULL THEN 'missing claim' END, CASE WHEN coalesce(publisher, '') = '' THEN 'missing publisher' END,
      CASE WHEN bad_url THEN 'invalid source_url' END, CASE WHEN bad_time THEN 'invalid retrieved_at' END, CASE WHEN no_unit THEN 'missing unit' END], lambda x: x IS NOT NULL)"""


_ATT = "WITH a AS (SELECT lang AS topic, source, CASE WHEN min(doc_id) % 5 = 0 THEN 'failed' WHEN min(doc_id) % 31 <> 0 THEN 'success' END AS outcome, CASE WHEN min(doc_id) % 3 = 0 THEN 'cached' WHEN min(doc_id) % 7 = 0 THEN 'stale' ELSE 'fresh' END AS retrieval, count(*) FILTER (contains(text, 'tion')) AS matched FROM documents GROUP BY 1, 2)"
_SG = """g AS (SELECT topic, count(*) AS selected, count(*) FILTER (outcome = 'success') AS successes, count(*) FILTER (outcome = 'failed') AS failures, count(*) FILTER (outcome = 'success' AND retrieval = 'stale') AS stale, count(*) FILTER (outcome = 'success' AND retrieval = 'cached') AS cached,
  CAST(coalesce(sum(matched) FILTER (outcome = 'success'), 0) AS BIGINT) AS facts, count(*) FILTER (outcome IS NULL) AS silent FROM a GROUP BY 1),
sg AS (SELECT topic, selected, successes, failures, facts, silent = 0 AS all_source_outcomes_explicit, successes >= least(3, selected) AND facts >= 3 AS primary_sufficient,
  CASE WHEN successes = 0 THEN 'failed' WHEN failures > 0 OR stale > 0 THEN 'degraded' WHEN cached = successes THEN 'cached' ELSE 'fresh' END AS status,
  concat_ws(',', CASE WHEN successes < least(3, selected) THEN 'too few sources' END, CASE WHEN facts < 3 THEN 'too few items' END) AS reasons FROM g)"""
_CG = """plan AS (SELECT r_name AS topic, n_nationkey AS site_id FROM nation JOIN region ON n_regionkey = r_regionkey),
tried AS (SELECT s_nationkey AS site_id, arg_max(['no_relevant_result', 'paywalled', 'failed', 'search_results_only', 'login_required', 'opened_original'][s_suppkey % 6 + 1], s_suppkey) AS tried FROM supplier GROUP BY 1),
pg AS (SELECT c_nationkey AS site_id, c_custkey AS seq, CASE WHEN c_mktsegment = 'BUILDING' THEN 'paywalled' WHEN c_mktsegment = 'MACHINERY' THEN 'login_required' WHEN c_mktsegment = 'AUTOMOBILE' AND c_custkey % 2 = 0 THEN 'opened_original' ELSE 'search_results_only' END AS o FROM customer),
pgs AS (SELECT site_id, count(*) FILTER (o = 'opened_original') AS originals, arg_max(o, seq) AS last_page FROM pg GROUP BY 1),
oc AS (SELECT topic, originals, CASE WHEN originals > 0 OR tried = 'opened_original' THEN 'opened_original' ELSE coalesce(last_page, tried) END AS outcome FROM plan LEFT JOIN tried ON plan.site_id = tried.site_id LEFT JOIN pgs ON plan.site_id = pgs.site_id),
cg0 AS (SELECT topic, count(*) AS required_publishers, count(*) FILTER (outcome IN ('opened_original', 'no_relevant_result', 'paywalled', 'login_required', 'search_results_only')) AS accounted, count(*) FILTER (outcome IN ('opened_original', 'no_relevant_result', 'paywalled', 'login_required')) AS completed,
  count(*) FILTER (outcome IS NULL) AS missing, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'search_results_only') AS unresolved, CAST(coalesce(sum(originals), 0) AS BIGINT) AS opened_original_pages FROM oc GROUP BY 1),
cg AS (SELECT *, completed = required_publishers AS passed, CASE WHEN completed = required_publishers AND opened_original_pages > 0 THEN 'complete' WHEN completed = required_publishers THEN 'degraded' ELSE 'incomplete' END AS status FROM cg0)"""

_METRICS_BY = """sel AS (SELECT sector, count(*) AS candidate_observations, count(DISTINCT as_of) AS evaluation_periods, round(avg((excess_return_pct > 0)::INT), 4) AS excess_hit_rate, round(median(future_net_return_pct), 4) AS median_net, round(avg(excess_return_pct), 4) AS mean_excess FROM obs GROUP BY 1)"""
_CAND = f"""{_METRICS_BY},
lasts AS (SELECT sector, max(date) AS as_of FROM features WHERE role = 'sector' GROUP BY 1),
topq AS (SELECT l.sector, l.as_of, m.code FROM lasts l JOIN (SELECT DISTINCT sector, code FROM features WHERE role = 'stock') m ON l.sector = m.sector),
top3 AS (SELECT * FROM (SELECT q.sector, q.code, s.score, row_number() OVER (PARTITION BY q.sector ORDER BY s.score DESC, q.code DESC) AS rank FROM topq q ASOF JOIN scored s ON q.code = s.code AND q.as_of >= s.date WHERE s.score IS NOT NULL AND s.coverage >= 0.75) WHERE rank <= 3),
ss AS (SELECT sector, arg_max(score_20d, date) AS sector_score FROM sector_scored GROUP BY 1),
stnow AS (SELECT code, arg_max(state, date) AS timing_state, arg_max(risk_raw, date) AS risk_distance_pct FROM states GROUP BY 1),
gate AS (SELECT code, CASE WHEN trades >= 20 AND mean_net_return_pct > 0 AND mean_excess_return_pct > 0 AND hit_rate >= 0.45 AND coalesce(profit_factor > 1, false) THEN 'usable' ELSE 'abstain' END AS timing_gate FROM metrics),
cd AS (SELECT t.sector, t.code, t.score, ss.sector_score, sel.mean_excess, sel.excess_hit_rate AS excess_hit, n.timing_state, n.risk_distance_pct, g.timing_gate, CAST(regexp_extract(t.code, '(\\d+)', 1) AS INT) AS n
  FROM top3 t JOIN ss ON t.sector = ss.sector JOIN sel ON t.sector = sel.sector LEFT JOIN stnow n ON t.code = n.code LEFT JOIN gate g ON t.code = g.code),
"""
_VERDICT = """cv AS (SELECT *, ['pass', 'watch', 'fail'][n % 3 + 1] AS fv, ['fair', 'attractive', 'expensive', 'not_meaningful'][n % 4 + 1] AS vv, ['confirmed', 'plausible', 'absent'][(n + 1) % 3 + 1] AS cs, ['medium', 'high', 'medium', 'very_high'][(n + 2) % 4 + 1] AS rl, false AS pipeline, round(risk_distance_pct, 2) AS plan_risk FROM cd)"""
_FORCED = """cv AS (SELECT sector, code, greatest(score, 65.0) + n AS score, 70.0::DOUBLE AS sector_score, 1.0 AS mean_excess, 0.6 AS excess_hit, 'triggered' AS timing_state, 6.0::DOUBLE + n / 5::DOUBLE AS risk_distance_pct, 'usable' AS timing_gate, 'pass' AS fv, CASE WHEN n % 2 = 0 THEN 'not_meaningful' ELSE 'fair' END AS vv, 'confirmed' AS cs, 'medium' AS rl, n % 4 = 0 AS pipeline, 5.0::DOUBLE + n / 4::DOUBLE AS plan_risk FROM cd)"""


def _recommended(profile: str) -> str:
    p = decision.PROFILES[profile]
    pts = lambda col, name: "CASE " + " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in decision.POINTS[name].items()) + " ELSE 0 END"
    return f"""rc0 AS (SELECT *, round(0.45::DOUBLE * score + 0.20::DOUBLE * coalesce(sector_score, 0) + 0.15::DOUBLE * ({pts('fv', 'fundamental_verdict')}) + 0.10::DOUBLE * ({pts('cs', 'catalyst_status')}) + 0.05::DOUBLE * ({pts('vv', 'valuation_verdict')}) + 0.05::DOUBLE * ({pts('rl', 'risk_level')}), 2) AS conviction,
      coalesce(score >= 65 AND sector_score >= 55 AND mean_excess > 0 AND excess_hit >= 0.5 AND fv = 'pass' AND cs IN ('confirmed', 'plausible') AND (vv IN ('attractive', 'fair') OR pipeline AND vv = 'not_meaningful') AND rl IN ('medium', 'high') AND timing_state IN ('triggered', 'retest') AND timing_gate = 'usable' AND risk_distance_pct > 0 AND risk_distance_pct <= {p['risk_cap']}, false) AS buy_gate FROM cv),
    rc1 AS (SELECT *, CASE WHEN buy_gate THEN 'buy' WHEN fv = 'fail' OR rl = 'very_high' OR score < 45 THEN 'avoid' ELSE 'wait' END AS action FROM rc0),
    rc2 AS (SELECT *, CASE WHEN buy_gate THEN round(least({p['single']}::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * greatest(0, least(1, (conviction - 60) / 25))), {p['budget']}::DOUBLE / plan_risk * 100, {p['single']}::DOUBLE), 2) ELSE 0 END AS raw FROM rc1),
    rec AS (SELECT *, round(raw * CASE WHEN sum(raw) OVER (PARTITION BY sector) > 0 THEN least(1.0::DOUBLE, {p['theme']}::DOUBLE / sum(raw) OVER (PARTITION BY sector)) ELSE 1 END, 2) AS position_pct, row_number() OVER (PARTITION BY sector ORDER BY (action = 'buy')::INT DESC, conviction DESC, code) AS place FROM rc2)"""


_ALL = "WITH RECURSIVE " + ",".join([sql.BARS, sql.FEATURES, prices._SCORED, prices._OBS, prices._BREADTH, prices._SECTOR, prices._DAYS, prices._WSTATE, prices._STATES, prices._CAND, prices._TRADES, prices._EQUITY]) + "," + _CAND
_JRUN = """WITH r0 AS (SELECT doc_id AS run_id, concat_ws(' ', source, lang) AS topic, DATE '2024-01-01' + CAST(doc_id % 300 AS INT) AS as_of, CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 20 END AS days, 'Brand#' || CAST(doc_id % 25 + 1 AS VARCHAR) AS code,
  CASE WHEN doc_id % 9 = 0 THEN [] ELSE [lang, source] END AS tags, ['bullish', 'bearish', 'neutral', 'mixed', 'abstain', 'not_applicable'][doc_id % 6 + 1] AS stance, ['hold', 'buy', 'avoid'][doc_id % 3 + 1] AS decision, trim(regexp_replace(coalesce(text, ''), '[ \\t-\\r]+', ' ', 'g')) AS thesis FROM documents),
runs AS (SELECT *, CASE WHEN run_id % 11 <> 0 THEN as_of + CAST(CASE WHEN days = 5 THEN 7 ELSE 29 END AS INT) END AS review_date FROM r0),
reviews AS (SELECT doc_id * 10 AS review_id, CASE WHEN doc_id % 83 = 0 THEN -doc_id ELSE doc_id END AS run_id, DATE '2024-01-01' + CAST(doc_id % 300 + doc_id % 40 AS INT) AS observed_at, CASE WHEN toxic = 1 THEN 'refuted' ELSE 'confirmed' END AS thesis_status,
  ((doc_id * 37) % 2001 - 1000) / 100.0::DOUBLE AS realized, CASE WHEN doc_id % 4 <> 0 THEN 1.0::DOUBLE END AS benchmark, CASE WHEN doc_id % 4 <> 0 THEN ((doc_id * 37) % 2001 - 1000) / 100.0::DOUBLE - 1 END AS excess, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS decision_quality FROM labels),
latest AS (SELECT *, count(*) OVER (PARTITION BY run_id) AS review_count, max(observed_at) OVER (PARTITION BY run_id) AS reviewed_through FROM reviews QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY observed_at DESC, review_id DESC) = 1)"""
_STAT = "count(*) AS runs, count(l.run_id) AS reviewed_runs, round(count(l.run_id) / count(*), 4) AS review_coverage, count(*) FILTER (thesis_status = 'confirmed') AS confirmed, count(*) FILTER (decision_quality = 'good') AS good, round(avg(realized), 6) AS mean_realized_return_pct, round(avg(excess), 6) AS mean_excess_return_pct"
_REVIEW = _JRUN + "," + sql.BARS + """,
px AS (SELECT code, date, close, row_number() OVER (PARTITION BY code ORDER BY date) AS rn FROM bars WHERE role = 'stock'),
ask AS (SELECT run_id, code, DATE '1998-01-01' + CAST(run_id * 3 % 1450 AS INT) AS as_of, days, stance, run_id % 2 = 0 AS sup FROM runs),
en AS (SELECT a.*, e.date AS entry_date, e.close AS c0, e.rn FROM ask a ASOF LEFT JOIN px e ON a.code = e.code AND a.as_of < e.date),
pth AS (SELECT en.run_id, p.rn, p.date, p.close, p.close / max(p.close) OVER (PARTITION BY en.run_id ORDER BY p.rn) - 1 AS dd, en.rn AS r0, en.days FROM en JOIN px p ON en.code = p.code AND p.rn BETWEEN en.rn AND en.rn + en.days),
agg AS (SELECT run_id, count(*) AS n, max(days) AS days, arg_max(date, rn) AS x, arg_max(close, rn) AS c1, least(0, min(dd)) * 100 AS mdd FROM pth GROUP BY 1),
o AS (SELECT en.*, coalesce(agg.n, 0) AS n, CASE WHEN agg.n = en.days + 1 THEN x END AS exit_date, CASE WHEN agg.n = en.days + 1 THEN (c1 / c0 - 1) * 100 END AS realized, CASE WHEN agg.n = en.days + 1 THEN mdd END AS mdd FROM en LEFT JOIN agg ON en.run_id = agg.run_id),
ob AS (SELECT o.*, (b1.close / b0.close - 1) * 100 AS bench FROM o LEFT JOIN bars b0 ON b0.code = 'S' || CAST(CAST(regexp_extract(o.code, '(\\d+)', 1) AS INT) % 5 AS VARCHAR) AND b0.date = o.entry_date LEFT JOIN bars b1 ON b1.code = 'S' || CAST(CAST(regexp_extract(o.code, '(\\d+)', 1) AS INT) % 5 AS VARCHAR) AND b1.date = o.exit_date),
oc AS (SELECT *, realized - bench AS ex, CASE WHEN realized IS NULL THEN 'blocked' WHEN stance IN ('abstain', 'mixed', 'not_applicable') THEN 'unresolved'
  WHEN stance = 'bullish' THEN CASE WHEN realized >= 1 AND coalesce(realized - bench >= 0, true) THEN 'confirmed' WHEN realized > 0 OR coalesce(realized - bench > 0, false) THEN 'partially_confirmed' ELSE 'refuted' END
  WHEN stance = 'bearish' THEN CASE WHEN realized <= -1 AND coalesce(realized - bench <= 0, true) THEN 'confirmed' WHEN realized < 0 OR coalesce(realized - bench < 0, false) THEN 'partially_confirmed' ELSE 'refuted' END
  ELSE CASE WHEN abs(realized) <= 3 THEN 'confirmed' WHEN abs(realized) <= 6 THEN 'partially_confirmed' ELSE 'refuted' END END AS st FROM ob)"""
_ORD = " ".join(f"WHEN '{k}' THEN {v}" for k, v in decision.ORDERS.items())

QUERIES = {
    "fact_validation": (fact_validation, _FACT + f" SELECT seq, array_to_string(list_sort({_errors('')}), ';') AS errors, CASE WHEN redacted THEN 'redacted credentials' ELSE '' END AS warnings FROM f"),
    "doc_validation": (doc_validation, _FACT + f", e AS (SELECT *, len({_errors('document, ')}) AS n FROM f) SELECT document, count(*) AS facts, CAST(sum(n) AS BIGINT) AS error_count, sum(n) = 0 AS valid, count(*) FILTER (NOT sub) AS metadata_only, count(*) FILTER (sub) AS substantive FROM e GROUP BY 1"),
    "evidence_pack": (evidence_pack, _FACT + ", u AS (SELECT fact_id, evidence_role, sub FROM f UNION ALL SELECT 'EV-' || CAST(o_orderkey AS VARCHAR), 'event', true FROM orders) SELECT evidence_role, count(*) AS facts, count(DISTINCT fact_id) AS fact_ids, count(*) FILTER (sub) AS substantive FROM u GROUP BY 1"),
    "source_outcomes_gate": (source_outcomes_gate, _ATT + "," + _SG + " SELECT * FROM sg"),
    "coverage_gate": (coverage_gate, "WITH " + _CG + " SELECT * FROM cg"),
    "collection_gate": (collection_gate, _ATT + "," + _SG + "," + _CG + """, p AS (SELECT *, CASE topic WHEN 'en' THEN 'AMERICA' WHEN 'de' THEN 'EUROPE' WHEN 'es' THEN 'AFRICA' ELSE 'NOWHERE' END AS t FROM sg),
      j AS (SELECT p.t AS topic, primary_sufficient, NOT primary_sufficient OR NOT all_source_outcomes_explicit AS req, cg.passed IS NOT NULL AS prov, coalesce(cg.passed, false) AS fp, all_source_outcomes_explicit AS ex FROM p LEFT JOIN cg ON p.t = cg.topic)
      SELECT topic, primary_sufficient, req AS fallback_required, prov AS fallback_provided, fp AS fallback_passed, ex AND CASE WHEN req THEN fp ELSE primary_sufficient END AS passed, CASE WHEN req AND fp THEN 'degraded' WHEN ex AND CASE WHEN req THEN fp ELSE primary_sufficient END THEN 'complete' ELSE 'incomplete' END AS status FROM j"""),
    "site_match": (site_match, """WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) AS host FROM pages), plan AS (SELECT DISTINCT regexp_extract(host, '([^.]+\\.[^.]+\\.[^.]+)$', 1) AS domain FROM h),
      m AS (SELECT h.page_id, p.domain FROM h JOIN plan p ON p.domain <> '' AND (h.host = p.domain OR h.host LIKE '%.' || p.domain) QUALIFY row_number() OVER (PARTITION BY h.page_id ORDER BY length(p.domain) DESC) = 1) SELECT domain, count(*) AS pages FROM m GROUP BY 1"""),
    "recommendation": (recommendation, _ALL + _VERDICT + "," + _recommended("balanced") + " SELECT sector, code, action, buy_gate, conviction, position_pct, place, timing_state, coalesce(timing_gate, 'missing') AS timing_gate FROM rec"),
    "portfolio_controls": (portfolio_controls, _ALL + _VERDICT + "," + _recommended("balanced") + " SELECT sector, count(*) AS candidates, count(*) FILTER (action = 'buy') AS buys, count(*) FILTER (action = 'avoid') AS avoids, round(sum(position_pct), 2) AS total_position_pct, sum(position_pct) <= 20.01 AS within_theme_cap FROM rec GROUP BY 1"),
    "sizing": (sizing, _ALL + _FORCED + "," + _recommended("conservative") + " SELECT sector, code, action, conviction, position_pct FROM rec"),
    "publication_gate": (publication_gate, sql.with_(sql.BARS, sql.FEATURES, prices._SCORED, prices._OBS, prices._BREADTH, prices._SECTOR, prices._SIG.replace(prices._FWD + ",", ""), _METRICS_BY, _CG) + f""",
      bands AS ({prices._bands('sig', 'net_return_pct')}), cur AS (SELECT sector, arg_max(score_20d, date) AS s, arg_max(coverage_20d, date) AS cov FROM sector_scored GROUP BY 1),
      tot AS (SELECT sector, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(score) * stddev_pop(excess_return_pct) > 1e-12 THEN covar_pop(score, excess_return_pct) / (stddev_pop(score) * stddev_pop(excess_return_pct)) END AS r FROM sig GROUP BY 1),
      g AS (SELECT c.sector, c.cov, coalesce(n, 0) >= 30 AND coalesce(round(r, 4) >= 0.10, false) AND CASE WHEN s > 35 AND s < 65 THEN false WHEN k.observations IS NULL OR k.observations < 20 THEN false WHEN s >= 65 THEN k.mean_excess_return_pct > 0 AND k.historical_excess_hit_rate >= 0.5 ELSE k.mean_excess_return_pct < 0 AND k.historical_excess_hit_rate < 0.5 END AS u FROM cur c LEFT JOIN tot ON c.sector = tot.sector LEFT JOIN bands k ON c.sector = k.sector AND k.bucket = {sql.bucket('s')}),
      fc AS (SELECT count(*) FILTER (page_id % 3 <> 0 AND page_id % 5 <> 0) AS nf FROM pages), nw AS (SELECT bool_and(passed) AS np FROM cg),
      k AS (SELECT g.sector, nf >= 3 AS facts_ok, coalesce(cov >= 0.75, false) AS forecast_ok, true AS selection_ok, evaluation_periods >= 20 AS periods_ok, candidate_observations >= 30 AS observations_ok, true AS costs_ok, mean_excess > 0 AND excess_hit_rate >= 0.5 AND median_net > 0 AS selector_ok, coalesce(np, false) AS news_ok, u AS signal_ok FROM g JOIN sel ON g.sector = sel.sector CROSS JOIN fc CROSS JOIN nw)
      SELECT *, failed = '' AS ready FROM (SELECT *, concat_ws(',', {', '.join(f"CASE WHEN NOT {c} THEN '{c}' END" for c in decision.CHECKS)}) AS failed FROM k)"""),
    "trade_plan": (trade_plan, sql.with_(sql.BARS, sql.FEATURES, prices._DAYS, prices._WSTATE, prices._STATES) + """,
      lf AS (SELECT * FROM features WHERE role = 'stock' QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1), ls AS (SELECT code, stop, risk_raw, close + 2 * (close - stop) AS rv FROM states WHERE CAST(regexp_extract(code, '(\\d+)', 1) AS INT) % 3 = 0 QUALIFY row_number() OVER (PARTITION BY code ORDER BY date DESC) = 1),
      q AS (SELECT lf.*, ls.stop AS ts, ls.risk_raw AS tr, ls.rv, CASE WHEN 1 + ma20_gap_pct / 100 > 0 THEN close / (1 + ma20_gap_pct / 100) END AS m20, greatest(6.0::DOUBLE, least(12.0::DOUBLE, 2.5::DOUBLE * coalesce(volatility_20d_annualized_pct / sqrt(252), 6.0::DOUBLE / 2.5::DOUBLE))) AS risk FROM lf LEFT JOIN ls ON lf.code = ls.code),
      q2 AS (SELECT *, CASE WHEN 1 + ma20_vs_ma60_pct / 100 > 0 THEN m20 / (1 + ma20_vs_ma60_pct / 100) END AS m60, coalesce(tr > 0 AND ts IS NOT NULL, false) AS timed FROM q)
      SELECT code, round(m20, 4) AS ma20_reference, round(m60, 4) AS ma60_reference, CASE WHEN ma20_gap_pct IS NULL THEN 'wait_for_data' WHEN ma20_gap_pct > 8 THEN 'do_not_chase' WHEN ma20_gap_pct >= -3 THEN 'staged' ELSE 'wait_for_recovery' END AS entry, round(CASE WHEN timed THEN tr ELSE risk END, 2) AS technical_risk_pct,
        round(CASE WHEN timed THEN ts ELSE greatest(close * (1 - risk / 100), CASE WHEN m60 * 0.98::DOUBLE < close THEN m60 * 0.98::DOUBLE END) END, 4) AS technical_stop, round(CASE WHEN timed THEN rv ELSE close * (1 + 2 * risk / 100) END, 4) AS review_level, CASE WHEN timed THEN 'atr_and_prior_channel' ELSE 'volatility_and_ma60' END AS risk_method FROM q2"""),
    "prediction_brief": (prediction_brief, sql.with_(sql.BARS, sql.FEATURES, prices._SCORED, prices._BREADTH, prices._SECTOR) + f""",
      cur AS (SELECT sector, {sql.regime('arg_max(score_5d, date)')} AS r5, {sql.regime('arg_max(score_20d, date)')} AS r20, max(date) AS as_of FROM sector_scored GROUP BY 1),
      tq AS (SELECT c.sector, c.as_of, m.code FROM cur c JOIN members m ON c.sector = m.sector), tn AS (SELECT q.sector, least(3, count(*)) AS n FROM tq q ASOF JOIN scored s ON q.code = s.code AND q.as_of >= s.date WHERE s.score IS NOT NULL AND s.coverage >= 0.75 GROUP BY 1)
      SELECT cur.sector, r5 <> r20 AS contradicts, CASE WHEN r5 <> r20 THEN 'short term ' || r5 || ', medium term ' || r20 || ': why do they part?' ELSE 'both terms ' || r5 || ': is it borne out by fundamentals?' END AS contradiction, coalesce(n, 0) AS theses, true AS unfinished,
        {2 * len(brief.ACTORS) + len(brief.CAUSAL_FIELDS)} + {len(brief.THESIS_FIELDS)} * coalesce(n, 0) AS open_fields, 'research_scaffold_not_publication_ready' AS status FROM cur LEFT JOIN tn ON cur.sector = tn.sector"""),
    "prediction_validation": (prediction_validation, _ALL + _FORCED + "," + _recommended("conservative") + """,
      x AS (SELECT sector, code, CAST(regexp_extract(code, '(\\d+)', 1) AS INT) AS n, action AS a0, position_pct AS p0, sum(position_pct) OVER (PARTITION BY sector) AS rep FROM rec),
      y AS (SELECT *, CASE WHEN n % 5 = 0 THEN 'sell' ELSE a0 END AS act, CASE WHEN n % 7 = 0 THEN p0 + 10 ELSE p0 END AS pos FROM x),
      z AS (SELECT sector, code, unnest(list_filter([CASE WHEN act = 'sell' THEN 'invalid action' END, CASE WHEN pos < 0 OR pos > 3 + 1e-9 THEN 'position exceeds single-name cap' END, CASE WHEN act = 'buy' AND pos <= 0 THEN 'buy has no position' END, CASE WHEN act = 'buy' AND n % 4 = 0 THEN 'buy failed a gate' END,
        CASE WHEN act = 'buy' AND n % 11 = 0 THEN 'buy lacks a stop' END, CASE WHEN act = 'buy' AND n % 3 = 0 THEN 'buy lacks a timing state' END, CASE WHEN act = 'buy' AND n % 2 <> 0 THEN 'buy lacks a usable timing test' END, CASE WHEN act <> 'buy' AND pos <> 0 THEN 'other action has a position' END], lambda e: e IS NOT NULL)) AS error FROM y),
      t AS (SELECT sector, sum(pos) AS t, max(rep) AS r FROM y GROUP BY 1)
      SELECT sector, code, error FROM z UNION ALL SELECT sector, NULL, 'theme cap exceeded' FROM t WHERE t > 10 + 1e-6 UNION ALL SELECT sector, NULL, 'reported total differs' FROM t WHERE abs(t - r) > 0.02"""),
    "outlook_plan": (outlook_plan, f"""WITH a AS (SELECT * FROM (VALUES ('1d'), ('5d'), ('20d'), ('60d'), ('12m')) h(horizon) CROSS JOIN (VALUES ('premarket'), ('intraday'), ('after_close'), ('structural')) s(session) CROSS JOIN (VALUES ('unknown'), ('rumor'), ('confirmed_material')) e(event_state)),
      b AS (SELECT *, CASE WHEN session = 'structural' OR horizon IN ('60d', '12m') THEN 'structural' WHEN event_state = 'confirmed_material' THEN 'confirmed' WHEN event_state = 'rumor' THEN 'rumor' WHEN session = 'premarket' THEN 'premarket' ELSE 'default' END AS branch FROM a),
      c AS (SELECT *, CASE branch {_ORD} END AS st FROM b) SELECT horizon, session, event_state, branch, CAST(unnest(range(len(st))) AS INT) AS position, unnest(st) AS stage FROM c"""),
    "journal_search": (journal_search, _JRUN + " SELECT run_id, as_of, stance, decision FROM runs WHERE as_of >= DATE '2024-02-01' AND list_contains(tags, 'en') AND contains(decision, 'bu') AND contains(lower(concat_ws(' ', topic, code, array_to_string(tags, ' '), thesis)), 'ti') ORDER BY as_of DESC, run_id DESC LIMIT 50"),
    "review_queue": (review_queue, _JRUN + f""", q AS (SELECT r.run_id, as_of, review_date, CAST(review_date - DATE '{REFERENCE_DAY}' AS DOUBLE) AS days_until_review, CASE WHEN review_date IS NULL THEN 'unscheduled' WHEN reviewed_through >= review_date THEN 'reviewed' WHEN review_date < DATE '{REFERENCE_DAY}' THEN 'overdue' WHEN review_date = DATE '{REFERENCE_DAY}' THEN 'due'
      WHEN review_date <= DATE '{REFERENCE_DAY}' + 30 THEN 'upcoming' END AS review_status, coalesce(review_count, 0) AS review_count FROM runs r LEFT JOIN latest l ON r.run_id = l.run_id)
      SELECT *, CASE review_status WHEN 'overdue' THEN 0 WHEN 'due' THEN 1 WHEN 'upcoming' THEN 2 ELSE 3 END AS priority FROM q WHERE review_status IS NOT NULL AND review_status <> 'reviewed'"""),
    "journal_stats": (_stats("none"), _JRUN + f" SELECT 'all' AS key, {_STAT} FROM runs r LEFT JOIN latest l ON r.run_id = l.run_id GROUP BY 1"),
    "journal_stats_stance": (_stats("stance"), _JRUN + f" SELECT stance AS key, {_STAT} FROM runs r LEFT JOIN latest l ON r.run_id = l.run_id GROUP BY 1"),
    "journal_stats_tag": (_stats("tag"), _JRUN + f", x AS (SELECT *, unnest(CASE WHEN len(tags) > 0 THEN tags ELSE ['untagged'] END) AS key FROM runs) SELECT key, {_STAT} FROM x r LEFT JOIN latest l ON r.run_id = l.run_id GROUP BY 1"),
    "journal_stats_horizon": (_stats("horizon"), _JRUN + f" SELECT CAST(days AS VARCHAR) || 'd' AS key, {_STAT} FROM runs r LEFT JOIN latest l ON r.run_id = l.run_id GROUP BY 1"),
    "journal_stats_decision": (_stats("decision"), _JRUN + f" SELECT decision AS key, {_STAT} FROM runs r LEFT JOIN latest l ON r.run_id = l.run_id GROUP BY 1"),
    "journal_stats_instrument": (_stats("instrument"), _JRUN + f" SELECT code AS key, {_STAT} FROM runs r LEFT JOIN latest l ON r.run_id = l.run_id GROUP BY 1"),
    "journal_statistics": (journal_statistics, _JRUN + """, x AS (SELECT 'none' AS dimension, 'all' AS key, run_id FROM runs UNION ALL SELECT 'horizon', CAST(days AS VARCHAR) || 'd', run_id FROM runs UNION ALL SELECT 'stance', coalesce(stance, 'unknown'), run_id FROM runs UNION ALL SELECT 'decision', coalesce(decision, 'unknown'), run_id FROM runs
      UNION ALL SELECT 'instrument', code, run_id FROM runs UNION ALL SELECT 'tag', unnest(CASE WHEN len(tags) > 0 THEN list_distinct(tags) ELSE ['untagged'] END), run_id FROM runs)
      SELECT dimension, key, count(*) AS runs, count(l.run_id) AS reviewed_runs, round(count(l.run_id) / count(*)::DOUBLE, 4) AS review_coverage,
        concat_ws(',', CASE WHEN count(*) FILTER (thesis_status = 'confirmed') > 0 THEN 'confirmed=' || count(*) FILTER (thesis_status = 'confirmed') END, CASE WHEN count(*) FILTER (thesis_status = 'refuted') > 0 THEN 'refuted=' || count(*) FILTER (thesis_status = 'refuted') END) AS thesis_status_counts,
        concat_ws(',', CASE WHEN count(*) FILTER (decision_quality = 'good') > 0 THEN 'good=' || count(*) FILTER (decision_quality = 'good') END, CASE WHEN count(*) FILTER (decision_quality = 'poor') > 0 THEN 'poor=' || count(*) FILTER (decision_quality = 'poor') END) AS decision_quality_counts,
        round(avg(realized), 6) AS mean_realized_return_pct, round(avg(excess), 6) AS mean_excess_return_pct FROM x LEFT JOIN latest l ON l.run_id = x.run_id GROUP BY 1, 2"""),
    "page_sites": (page_sites, _SITES + " SELECT topic, page_id, site_id FROM met"),
    "site_coverage": (site_coverage, _SITES + """, req AS (SELECT * FROM plan WHERE must), tried AS (SELECT n, arg_max(o, seq) AS tried FROM att WHERE NOT lost AND o <> 'guessed' GROUP BY 1),
      got AS (SELECT m.n, count(*) FILTER (o = 'opened_original') AS originals, arg_max(o, page_id) AS last FROM (SELECT pg.page_id, pg.o, arg_min(r.n, r.n) AS n FROM pg JOIN req r ON r.topic = pg.topic AND (pg.pub = r.key OR pg.host = r.domain OR ends_with(pg.host, '.' || r.domain)) GROUP BY 1, 2) m GROUP BY 1),
      oc AS (SELECT r.topic, r.n, 'site-' || r.n AS site, coalesce(originals, 0) AS originals, CASE WHEN originals > 0 OR tried = 'opened_original' THEN 'opened_original' ELSE coalesce(last, tried) END AS o FROM req r LEFT JOIN tried ON tried.n = r.n LEFT JOIN got ON got.n = r.n),
      g AS (SELECT topic, count(*) AS req, count(*) FILTER (o <> 'failed') AS acc, count(*) FILTER (o NOT IN ('failed', 'search_results_only')) AS comp, CAST(sum(originals) AS BIGINT) AS orig, coalesce(string_agg(site, ';' ORDER BY n) FILTER (o IS NULL), '') AS mi, coalesce(string_agg(site, ';' ORDER BY n) FILTER (o = 'failed'), '') AS fa,
        coalesce(string_agg(site, ';' ORDER BY n) FILTER (o = 'search_results_only'), '') AS un, coalesce(bool_or(site = 'site-7' AND o <> 'failed'), false) AS key7 FROM oc GROUP BY 1),
      odd AS (SELECT topic, string_agg(w, ';' ORDER BY s, w) AS odd FROM (SELECT topic, w, min(seq) AS s FROM (SELECT topic, seq, CASE WHEN lost THEN 'attempt outside the required plan: nowhere' WHEN NOT must THEN 'attempt outside the required plan: site-' || n WHEN o = 'guessed' THEN 'invalid outcome for site-' || n || ': guessed' END AS w FROM att JOIN plan USING (topic, n)) WHERE w IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
      SELECT g.topic, req AS required_publishers, acc AS accounted_publishers, comp AS completed_publishers, acc = req AS all_accounted_for, comp = req AS passed, CASE WHEN comp = req AND orig > 0 THEN 'complete' WHEN comp = req THEN 'degraded' ELSE 'incomplete' END AS status, key7 AS key_site_attempted, orig AS opened_original_pages,
        mi AS missing_publishers, fa AS failed_publishers, un AS unresolved_publishers, concat_ws(';', odd, CASE WHEN orig = 0 THEN 'no original page was opened' END, CASE WHEN mi <> '' THEN 'silently skipped: ' || replace(mi, ';', ', ') END, CASE WHEN fa <> '' THEN 'failed: ' || replace(fa, ';', ', ') END,
        CASE WHEN un <> '' THEN 'not resolved beyond search results: ' || replace(un, ';', ', ') END) AS warnings FROM g LEFT JOIN odd ON odd.topic = g.topic"""),
    "journal_verify": (journal_verify, _JRUN + " SELECT 'run fingerprint mismatch' AS problem, run_id AS id FROM runs WHERE run_id % 97 = 0 UNION ALL SELECT 'review without run', review_id FROM reviews WHERE run_id NOT IN (SELECT run_id FROM runs)"),
    "run_comparison": (run_comparison, _JRUN + " SELECT r.run_id, r.as_of, CAST(r.days AS VARCHAR) || 'd' AS horizon, r.stance, r.decision, observed_at, thesis_status, realized, benchmark, excess, decision_quality FROM runs r LEFT JOIN latest l ON r.run_id = l.run_id WHERE r.run_id IN (1, 2, 3, 5, 8, 13, 21)"),
    "auto_review": (auto_review, _REVIEW + """ SELECT run_id, code, entry_date, exit_date, round(realized, 4) AS realized_return_pct, round(bench, 4) AS benchmark_return_pct, round(ex, 4) AS excess_return_pct, round(mdd, 4) AS max_drawdown_pct, st AS thesis_status,
      CASE st WHEN 'blocked' THEN 'blocked' WHEN 'confirmed' THEN 'good' WHEN 'partially_confirmed' THEN 'mixed' WHEN 'refuted' THEN 'poor' ELSE CASE WHEN stance = 'abstain' AND sup THEN 'good' ELSE 'unrated' END END AS decision_quality,
      CASE WHEN realized IS NULL THEN CAST(n AS VARCHAR) || '/' || CAST(days + 1 AS VARCHAR) || ' bars' END AS reason FROM oc"""),
}
