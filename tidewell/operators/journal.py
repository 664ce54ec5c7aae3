"""The research journal: search, review queue, statistics, verification, sinks and automatic reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import rnd
from .timeseries import by_date, drawdown


def fingerprint(*cols: str) -> Column:
    """Digest of a row's content, fields in alphabetical order with their names; null is told from empty."""
    return F.sha2(F.concat_ws("|", *[F.concat(F.lit(c + "="), F.coalesce(F.col(c).cast("string"), F.lit("\\N"))) for c in sorted(cols)]), 256)


def search(runs: DataFrame, query: str = "", instrument: str = "", tag: str = "", stance: str = "", decision: str = "", date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    hay = low(F.concat_ws(" ", "topic", F.array_join("instruments", " "), F.array_join("tags", " "), "thesis"))
    out = runs
    if date_from:
        out = out.where(F.col("as_of") >= F.lit(date_from).cast("date"))
    if date_to:
        out = out.where(F.col("as_of") <= F.lit(date_to).cast("date"))
    if instrument:
        out = out.where(F.contains(low(F.array_join("instruments", " ")), F.lit(instrument.lower())))
    if tag:
        out = out.where(F.array_contains(F.transform("tags", F.lower), tag.lower()))
    if stance:
        out = out.where(F.col("stance") == stance)
    if decision:
        out = out.where(F.contains(low(F.col("decision")), F.lit(decision.lower())))
    return out.where(F.contains(hay, F.lit(query.lower()))) if query else out


def newest(runs: DataFrame, limit: int) -> DataFrame:
    return runs.orderBy(F.desc("as_of"), F.desc("run_id")).limit(max(1, limit))


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """The last review of each run by (observed_at, review_id), and how many there are."""
    return reviews.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in reviews.columns if c != "run_id"]), F.struct("observed_at", "review_id")).alias("latest"), F.count("*").alias("review_count"), F.max("observed_at").alias("reviewed_through"))


def review_queue(runs: DataFrame, reviews: DataFrame, as_of: str, days_ahead: int = 0, include_reviewed: bool = False, include_unscheduled: bool = False) -> DataFrame:
    """Runs that want a review: overdue, due, or upcoming within ``days_ahead``; in that order, then by date and id."""
    today = F.lit(as_of).cast("date")
    j = runs.join(latest_reviews(reviews).drop("latest"), "run_id", "left")
    d = F.col("review_date")
    status = (
        F.when(d.isNull(), "unscheduled").when(F.col("reviewed_through") >= d, "reviewed").when(d < today, "overdue").when(d == today, "due").when(d <= F.date_add(today, max(0, days_ahead)), "upcoming")
    )
    out = j.withColumn("review_status", status).where("review_status IS NOT NULL")
    if not include_reviewed:
        out = out.where("review_status <> 'reviewed'")
    if not include_unscheduled:
        out = out.where("review_status <> 'unscheduled'")
    order = F.create_map(*[F.lit(x) for k, v in {"overdue": 0, "due": 1, "upcoming": 2, "unscheduled": 3, "reviewed": 4}.items() for x in (k, v)])
    return out.select("run_id", "as_of", "review_date", F.datediff("review_date", today).cast("double").alias("days_until_review"), "review_status", F.coalesce("review_count", F.lit(0)).alias("review_count"), order[F.col("review_status")].alias("priority"))


def stats(runs: DataFrame, reviews: DataFrame, group_by: str = "none") -> DataFrame:
    """Review coverage and outcomes by all, horizon, stance, decision, instrument or tag; a run counts under each of its tags or instruments."""
    j = runs.join(latest_reviews(reviews), "run_id", "left")
    many = {"instrument": ("instruments", "unknown"), "tag": ("tags", "untagged")}
    if group_by in many:
        c, none = many[group_by]
        j = j.withColumn("key", F.explode(F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit(none)))))
    else:
        j = j.withColumn("key", F.lit("all") if group_by == "none" else F.coalesce(group_by, F.lit("unknown")))
    return j.groupBy("key").agg(
        F.count("*").alias("runs"), F.count("latest").alias("reviewed_runs"), rnd(F.count("latest") / F.count("*"), 4).alias("review_coverage"), F.count_if(F.col("latest.thesis_status") == "confirmed").alias("confirmed"),
        F.count_if(F.col("latest.decision_quality") == "good").alias("good"), rnd(F.avg("latest.realized"), 6).alias("mean_realized_return_pct"), rnd(F.avg("latest.excess"), 6).alias("mean_excess_return_pct"),
    )


#: What runs are counted by; instruments and tags count a run under each of them.
DIMENSIONS = ("none", "horizon", "stance", "decision", "instrument", "tag")


def statistics(runs: DataFrame, reviews: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, statuses: tuple[str, ...] = ("confirmed", "partially_confirmed", "refuted", "unresolved"), qualities: tuple[str, ...] = ("good", "mixed", "poor", "unrated")) -> DataFrame:
    """(dimension, key) with runs, reviews, counts by status and quality, and mean returns: all groupings from one reading and one join.

    Each run gives one slim row a key, so one aggregation, partial before its shuffle, does them all; ``none`` and other keys that hold many runs are
    one row a task by then. Words outside ``statuses`` and ``qualities`` count as ``other``; words that do not occur are left out of the maps.
    """
    one = lambda name, key: F.array(F.struct(F.lit(name).alias("dimension"), key.alias("key")))
    many = lambda name, c, none: F.transform(F.when(F.size(c) > 0, F.array_distinct(c)).otherwise(F.array(F.lit(none))), lambda x: F.struct(F.lit(name).alias("dimension"), x.alias("key")))
    plain = lambda name: one(name, F.coalesce(F.col(name).cast("string"), F.lit("unknown")))
    keys = {"none": one("none", F.lit("all")), "horizon": plain("horizon"), "stance": plain("stance"), "decision": plain("decision"), "instrument": many("instrument", "instruments", "unknown"), "tag": many("tag", "tags", "untagged")}
    slim = runs.select("run_id", F.concat(*[keys[d] for d in dimensions]).alias("keys"))
    latest = latest_reviews(reviews).select("run_id", F.struct("latest.thesis_status", "latest.decision_quality", "latest.realized", "latest.excess").alias("r"))
    j = slim.join(latest, "run_id", "left").select(F.explode("keys").alias("k"), "r").select("k.dimension", "k.key", "r")

    def counted(field: str, words: tuple[str, ...]) -> Column:
        word = F.col(f"r.{field}")
        known = [x for w in words for x in (F.lit(w), F.count_if(word == w))]
        return F.map_filter(F.create_map(*known, F.lit("other"), F.count_if(F.col("r").isNotNull() & ~F.coalesce(word.isin(*words), F.lit(False)))), lambda _, n: n > 0)

    return j.groupBy("dimension", "key").agg(
        F.count("*").alias("runs"), F.count("r").alias("reviewed_runs"), rnd(F.count("r") / F.count("*"), 4).alias("review_coverage"), counted("thesis_status", statuses).alias("thesis_status_counts"), counted("decision_quality", qualities).alias("decision_quality_counts"),
        rnd(F.avg("r.realized"), 6).alias("mean_realized_return_pct"), rnd(F.avg("r.excess"), 6).alias("mean_excess_return_pct"),
    )


def verify(runs: DataFrame, reviews: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(problem, id): runs whose content does not give their fingerprint, and reviews of runs that are not there."""
    changed = runs.where(F.col("fingerprint") != fingerprint(*fields)).select(F.lit("run fingerprint mismatch").alias("problem"), F.col("run_id").alias("id"))
    lost = reviews.join(runs.select("run_id"), "run_id", "left_anti").select(F.lit("review without run").alias("problem"), F.col("review_id").alias("id"))
    return changed.unionByName(lost)


def compare(runs: DataFrame, reviews: DataFrame, run_ids: list[int]) -> DataFrame:
    j = runs.where(F.col("run_id").isin(run_ids)).join(latest_reviews(reviews), "run_id", "left")
    return j.select("run_id", "as_of", "horizon", "stance", "decision", *[F.col(f"latest.{c}").alias(c) for c in ("observed_at", "thesis_status", "realized", "benchmark", "excess", "decision_quality")])


def insert_absent(new: DataFrame, path: str, key: str) -> int:
    """Appends the rows of ``new`` whose key the store at ``path`` lacks, one a key; returns how many were there already.

    Saving the same rows again adds nothing. ``key`` is a digest of the content, so equal keys are equal rows.
    """
    spark = new.sparkSession
    new = new.dropDuplicates([key])
    try:
        held = spark.read.schema(new.schema).parquet(path)
    except Exception as error:  # no store yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        new.write.parquet(path)
        return 0
    fresh = new.join(held.select(key), key, "left_anti")
    there = new.count() - fresh.count()
    fresh.write.mode("append").parquet(path)
    return there


def horizon_days(text: Column) -> Column:
    n = F.regexp_extract(text, r"^(\d+)d$", 1).try_cast("int")
    return F.when(n >= 1, n)


def outcome_windows(bars: DataFrame, periods: int) -> DataFrame:
    """Each bar as an entry: the close ``periods`` bars on, the return and the worst fall between."""
    w = by_date()
    ahead = bars.select("code", F.col("date").alias("entry_date"), F.col("close").alias("entry_close"), F.collect_list(F.struct("date", "close")).over(w.rowsBetween(0, periods)).alias("a"))
    last = F.element_at("a", -1)
    return ahead.select(
        "code", "entry_date", "entry_close", F.size("a").alias("bars"), F.when(F.size("a") == periods + 1, last["date"]).alias("exit_date"), F.when(F.size("a") == periods + 1, (last["close"] / F.col("entry_close") - 1) * 100).alias("realized"),
        F.when(F.size("a") == periods + 1, drawdown(F.transform("a", lambda x: x["close"]))).alias("max_drawdown"),
    )


def verdict(stance: Column, realized: Column, excess: Column, abstention_supported: Column, threshold: float = 1.0, band: float = 3.0) -> Column:
    """(thesis_status, decision_quality) of a stance by what followed."""
    pair = lambda s, q: F.struct(F.lit(s).alias("thesis_status"), F.lit(q).alias("decision_quality"))
    confirmed, partly, refuted = pair("confirmed", "good"), pair("partially_confirmed", "mixed"), pair("refuted", "poor")
    better, worse = F.coalesce(excess > 0, F.lit(False)), F.coalesce(excess < 0, F.lit(False))
    return (
        F.when((stance == "abstain") & abstention_supported, pair("unresolved", "good")).when(stance.isin("abstain", "mixed", "not_applicable"), pair("unresolved", "unrated"))
        .when(stance == "bullish", F.when((realized >= threshold) & ~worse, confirmed).when((realized > 0) | better, partly).otherwise(refuted))
        .when(stance == "bearish", F.when((realized <= -threshold) & ~better, confirmed).when((realized < 0) | worse, partly).otherwise(refuted))
        .when(stance == "neutral", F.when(F.abs(realized) <= band, confirmed).when(F.abs(realized) <= 2 * band, partly).otherwise(refuted)).otherwise(pair("unresolved", "unrated"))
    )


def auto_review(runs: DataFrame, bars: DataFrame, benchmark_of: DataFrame, horizons: tuple[int, ...] = (5, 20)) -> DataFrame:
    """Outcomes of runs (run_id, code, as_of, days, stance, abstention_supported): entry at the first close after the day, exit ``days`` bars on.

    The benchmark counts on the same two days only. Runs without enough bars stay, blocked, with the reason.
    """
    from .signals import forward_asof

    windows = None
    for h in horizons:
        x = outcome_windows(bars, h).withColumn("days", F.lit(h))
        windows = x if windows is None else windows.unionByName(x)
    windows = windows.withColumn("key", F.concat_ws("|", "code", "days")).drop("code", "days")
    # a run's entry depends on its code, span and day alone, so the days are looked up, not the runs
    asked = runs.select("code", "days", "as_of").distinct().withColumn("key", F.concat_ws("|", "code", "days")).withColumn("after", F.date_add("as_of", 1))
    j = runs.join(forward_asof(asked, windows, "key", "after", "entry_date").drop("key", "after"), ["code", "days", "as_of"])
    b = bars.select(F.col("code").alias("bench"), F.col("date"), F.col("close"))
    one, two = b.select("bench", F.col("date").alias("entry_date"), F.col("close").alias("b0")), b.select("bench", F.col("date").alias("exit_date"), F.col("close").alias("b1"))
    j = j.join(benchmark_of, "code", "left").join(one, ["bench", "entry_date"], "left").join(two, ["bench", "exit_date"], "left")
    bench = (F.col("b1") / F.col("b0") - 1) * 100
    v = verdict(F.col("stance"), F.col("realized"), F.col("realized") - bench, F.col("abstention_supported"))
    done = F.col("realized").isNotNull()
    blocked = F.concat(F.coalesce("bars", F.lit(0)).cast("string"), F.lit("/"), (F.col("days") + 1).cast("string"), F.lit(" bars"))
    return j.select(
        "run_id", "code", "entry_date", "exit_date", rnd("realized", 4).alias("realized_return_pct"), rnd(bench, 4).alias("benchmark_return_pct"), rnd(F.col("realized") - bench, 4).alias("excess_return_pct"), rnd("max_drawdown", 4).alias("max_drawdown_pct"),
        F.when(done, v["thesis_status"]).otherwise("blocked").alias("thesis_status"), F.when(done, v["decision_quality"]).otherwise("blocked").alias("decision_quality"), F.when(~done, blocked).alias("reason"),
    )
