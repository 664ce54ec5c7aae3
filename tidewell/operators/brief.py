"""Research scaffolds, trade plans, document checks and registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import clamp, rnd
from .decision import PROFILES

#: Stands where research has yet to fill a field.
TODO = "research_required"
# Fields of a thesis and of the causal part that research fills.
THESIS_FIELDS = ("role_in_industry_chain", "expectation_gap", "catalyst", "who_benefits_and_why", "fundamental_confirmation", "fundamental_verdict", "valuation_verdict", "catalyst_status", "risk_level", "competing_explanation", "second_order_effect", "invalidation_signal")
CAUSAL_FIELDS = ("surface_explanation", "structural_cause", "competing_explanation", "second_order_effect", "conditional_conclusion")
ACTORS = ("policy makers", "companies of the chain", "customers", "capital providers")
FLOORS = {"conservative": 5.0, "balanced": 6.0, "aggressive": 8.0}
#: Fields of archived documents that a snapshot keeps.
GATE_FIELDS = ("ready", "passed", "status", "sector_signal_usable", "selector_backtest_usable", "news_coverage_complete")
METRIC_FIELDS = ("hit_rate", "excess_hit_rate", "mean_net_return_pct", "median_net_return_pct", "mean_excess_return_pct")


def has_todo(document: Column) -> Column:
    """Whether any value anywhere in a nested column still waits for research; keys never hold the mark."""
    return F.contains(F.to_json(document), F.lit(f'"{TODO}"'))


def todo_count(document: Column) -> Column:
    return F.regexp_count(F.to_json(document), F.lit(f'"{TODO}"')).cast("long")


def brief(sectors: DataFrame, candidates: DataFrame, by: str = "sector") -> DataFrame:
    """A scaffold for each sector (regime_5d, regime_20d): the opening contradiction, actors, theses of its candidates (code, rank, score)."""
    thesis = F.struct("rank", "code", "score", *[F.lit(TODO).alias(f) for f in THESIS_FIELDS], F.array().cast("array<string>").alias("supporting_fact_ids"))
    listed = candidates.groupBy(by).agg(F.array_sort(F.collect_list(thesis)).alias("candidate_theses"))
    actors = F.array(*[F.struct(F.lit(a).alias("actor"), F.lit(TODO).alias("goal"), F.lit(TODO).alias("constraint")) for a in ACTORS])
    differ = F.col("regime_5d") != F.col("regime_20d")
    opening = F.when(differ, F.format_string("short term %s, medium term %s: why do they part?", "regime_5d", "regime_20d")).otherwise(F.format_string("both terms %s: is it borne out by fundamentals?", "regime_5d"))
    causal = F.struct(opening.alias("contradiction"), actors.alias("actor_matrix"), *[F.lit(TODO).alias(f) for f in CAUSAL_FIELDS])
    return sectors.join(listed, by, "left").select(by, differ.alias("contradicts"), causal.alias("causal"), F.coalesce("candidate_theses", F.array().cast(listed.schema["candidate_theses"].dataType)).alias("candidate_theses"), F.lit("research_scaffold_not_publication_ready").alias("status"))


def trade_plan(candidates: DataFrame, profile: str = "balanced") -> DataFrame:
    """Risk distance, stop and review level: from the timing state where it has one, else from volatility and the 60-bar mean.

    Reads close, ma20_gap_pct, ma20_vs_ma60_pct, volatility_20d_annualized_pct, timing_stop, timing_risk_pct, timing_review.
    """
    c, gap, over = F.col("close"), 1 + F.col("ma20_gap_pct") / 100, 1 + F.col("ma20_vs_ma60_pct") / 100
    ma20 = F.when(gap > 0, c / gap)
    ma60 = F.when(over > 0, ma20 / over)
    floor, cap = FLOORS[profile], PROFILES[profile]["risk_cap"]
    timed = F.coalesce((F.col("timing_risk_pct") > 0) & F.col("timing_stop").isNotNull(), F.lit(False))
    risk = clamp(2.5 * F.coalesce(F.col("volatility_20d_annualized_pct") / F.sqrt(F.lit(252.0)), F.lit(floor / 2.5)), floor, cap)
    stop = F.greatest(c * (1 - risk / 100), F.when(ma60 * 0.98 < c, ma60 * 0.98))
    entry = F.when(F.col("ma20_gap_pct").isNull(), "wait_for_data").when(F.col("ma20_gap_pct") > 8, "do_not_chase").when(F.col("ma20_gap_pct") >= -3, "staged").otherwise("wait_for_recovery")
    return candidates.withColumns({
        "ma20_reference": rnd(ma20, 4), "ma60_reference": rnd(ma60, 4), "entry": entry, "technical_risk_pct": rnd(F.when(timed, F.col("timing_risk_pct")).otherwise(risk), 2), "technical_stop": rnd(F.when(timed, F.col("timing_stop")).otherwise(stop), 4),
        "review_level": rnd(F.when(timed, F.col("timing_review")).otherwise(c * (1 + 2 * risk / 100)), 4), "risk_method": F.when(timed, "atr_and_prior_channel").otherwise("volatility_and_ma60"),
    })


def recommendation_errors(recommended: DataFrame, profile: str = "balanced", by: str = "sector") -> DataFrame:
    """(by, code, error): what a set of recommendations breaks, row by row and as a whole (code null).

    Reads code, action, position_pct, buy_gate, timing_state, timing_gate, technical_stop and reported_total.
    """
    p = PROFILES[profile]
    recommended = recommended.withColumn("copies", F.count("*").over(Window.partitionBy(by, "code")))
    buy, pos = F.col("action") == "buy", F.coalesce("position_pct", F.lit(0.0))
    rules = [
        (~F.coalesce(F.col("action").isin("buy", "wait", "avoid"), F.lit(False)), "invalid action"), ((pos < 0) | (pos > p["single"] + 1e-9), "position exceeds single-name cap"), (buy & (pos <= 0), "buy has no position"), (buy & ~F.coalesce("buy_gate", F.lit(False)), "buy failed a gate"),
        (buy & F.col("technical_stop").isNull(), "buy lacks a stop"), (buy & ~F.coalesce(F.col("timing_state").isin("triggered", "retest"), F.lit(False)), "buy lacks a timing state"), (buy & (F.coalesce("timing_gate", F.lit("")) != "usable"), "buy lacks a usable timing test"),
        (~buy & (pos != 0), "other action has a position"), (F.col("copies") > 1, "code repeats"),
    ]
    rows = recommended.select(by, "code", F.explode(F.array_compact(F.array(*[F.when(c, e) for c, e in rules]))).alias("error"))
    total = F.sum(pos)
    whole = recommended.groupBy(by).agg(total.alias("t"), F.max("reported_total").alias("r"))
    sums = F.array_compact(F.array(F.when(F.col("t") > p["theme"] + 1e-6, "theme cap exceeded"), F.when(F.abs(F.col("t") - F.coalesce("r", F.lit(0.0))) > 0.02, "reported total differs")))
    return rows.unionByName(whole.select(by, F.lit(None).cast("string").alias("code"), F.explode(sums).alias("error")))


def select_sites(sites: DataFrame, tiers: tuple[str, ...] = (), region: str | None = None, publisher: str = "", tier_order: tuple[str, ...] = ("core", "secondary", "reference")) -> DataFrame:
    """Sites by tier, region and a part of any of their names, in order of tier, corpus size and id."""
    s = sites
    if tiers:
        s = s.where(F.col("tier").isin(*tiers))
    if region:
        s = s.where(F.col("region") == region)
    if publisher.strip():
        names = F.concat(F.array("site_id", "publisher"), F.coalesce("aliases", F.array().cast("array<string>")))
        s = s.where(F.exists(names, lambda n: F.contains(F.lower(n), F.lit(publisher.strip().lower()))))
    place = F.coalesce(F.create_map(*[F.lit(x) for i, t in enumerate(tier_order) for x in (t, i)])[F.col("tier")], F.lit(99))
    return s.withColumn("place", F.row_number().over(Window.orderBy(place, F.desc("corpus_files"), "site_id")))  # a registry: tens of rows


def planned_assets(benchmarks: DataFrame, peers: DataFrame, markets: list[str]) -> DataFrame:
    """Benchmarks and peers of the markets in order, a symbol once, the first wins. Both have market, symbol, strength, ordinal."""
    order = F.array_position(F.array(*[F.lit(m) for m in markets]), F.col("market"))
    both = benchmarks.withColumns({"role": F.lit("market_benchmark"), "strength": F.lit(1.0), "kind": F.lit(0)}).unionByName(peers.withColumns({"role": F.lit("peer"), "kind": F.lit(1)}))
    kept = both.where(F.col("market").isin(markets)).withColumn("at", F.struct(order.alias("m"), "kind", "ordinal"))
    return kept.groupBy("symbol").agg(F.min_by(F.struct("market", "role", "strength"), "at").alias("a")).select("symbol", "a.*")


def best_history(files: DataFrame) -> DataFrame:
    """Of the landed histories (path, code, bars: date and close) of each code, the one that ends last, then the longest, then the first path."""
    bars = F.filter("bars", lambda b: b["date"].isNotNull())
    f = files.withColumns({"bars": bars, "code": F.right(F.regexp_replace("code", "[^0-9]", ""), F.lit(6))}).where((F.size("bars") > 0) & (F.length("code") == 6))
    w = Window.partitionBy("code").orderBy(F.desc(F.array_max(F.transform("bars", lambda b: b["date"]))), F.desc(F.size("bars")), "path")
    return f.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def read_histories(spark: SparkSession, folder: str) -> DataFrame:
    """Landed history documents under a folder, at any depth: (path, code, bars); other documents are passed over."""
    kind = "schema string, series array<struct<code:string,bars:array<struct<date:string,close:double>>>>"
    raw = spark.read.schema(kind).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    return raw.where("schema = 'market.history/1'").select(F.input_file_name().alias("path"), F.explode("series").alias("s")).select("path", "s.code", "s.bars")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles, a JSON object a line; a line that is none ends the read."""
    return spark.read.schema("title string, content string, source string, published_at string").option("mode", "FAILFAST").json(path)


def snapshots(documents: DataFrame, body: str = "body") -> DataFrame:
    """What an archive keeps of a document (JSON text): header, gate and metric fields, and counts of actions."""
    at = lambda path: F.get_json_object(body, path)
    either = lambda f: F.coalesce(at(f"$.publication_gate.{f}"), at(f"$.gate.{f}"))
    actions = F.from_json(at("$.recommendations"), "array<struct<action:string,code:string>>")
    one = lambda name: F.size(F.filter(actions, lambda x: F.coalesce(x["action"], F.lit("unknown")) == name))
    names = F.array_sort(F.array_distinct(F.transform(actions, lambda x: F.coalesce(x["action"], F.lit("unknown")))))
    counts = F.map_from_arrays(names, F.transform(names, one))
    return documents.select(
        "*", *[at(f"$.{f}").alias(f"doc_{f}") for f in ("schema", "as_of", "status")], F.struct(*[either(f).alias(f) for f in GATE_FIELDS]).alias("gate"), F.struct(*[at(f"$.metrics.{f}").try_cast("double").alias(f) for f in METRIC_FIELDS]).alias("metrics"), counts.alias("action_counts"),
    )


def supports_abstention(gate: Column, status: Column) -> Column:
    """Whether an archived snapshot says that nothing should have been done."""
    no = lambda f: F.coalesce(gate[f] == "false", F.lit(False))
    return F.coalesce(gate["status"] == "abstain", F.lit(False)) | no("ready") | no("passed") | F.coalesce(status == "research_scaffold_not_publication_ready", F.lit(False))
