"""Cross-market lead and lag, event studies, market mood, topic heat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clamp, correlation, ratio, rnd, signed_regime
from .timeseries import asof, by_date

MARKETS = ("us", "kr")
# How far a news stage has come, 0 to 1.
MATURITY = {"rumor": 0.15, "proposal": 0.30, "draft": 0.35, "announced": 0.55, "approved": 0.75, "effective": 0.90, "enforced": 1.00, "result": 1.00, "unknown": 0.25}
# Weights of the mood's components.
MOOD_WEIGHTS = {"breadth": 0.35, "limit_ecology": 0.35, "momentum": 0.20, "continuation": 0.10}
THRESHOLD = 0.75


def daily_returns(bars: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("date")
    return bars.select("*", ((F.col("close") / F.lag("close").over(w) - 1) * 100).alias("ret")).where("ret IS NOT NULL")


def excess(own: DataFrame, broad: DataFrame, on: list[str]) -> DataFrame:
    """own's daily return less broad's, on the days both have."""
    return own.join(broad.select(*on, F.col("ret").alias("broad_ret")), on).withColumn("excess", F.col("ret") - F.col("broad_ret"))


def foreign_excess(bars: DataFrame) -> DataFrame:
    """(market, symbol, date, excess): peers against the index of their market."""
    r = daily_returns(bars, "symbol")
    index = F.col("symbol").startswith("IDX_")
    return excess(r.where(~index), r.where(index), ["market", "date"]).select("market", "symbol", "date", "excess")


def sector_excess(bars: DataFrame) -> DataFrame:
    r = daily_returns(bars.where("role <> 'stock'"), "code")
    return excess(r.where("role = 'sector'"), r.where("role = 'market'"), ["date"]).select(F.col("code").alias("sector"), "date", "excess")


def lead_lag_pairs(home: DataFrame, foreign: DataFrame) -> DataFrame:
    """Each home day with the last foreign day strictly before it; a foreign day serves its first home day only."""
    symbols, sectors = foreign.select("market", "symbol").distinct(), home.select("sector").distinct()
    both = sectors.crossJoin(F.broadcast(symbols))  # sectors times symbols: a few dozen names, whatever the rows
    key = F.concat_ws("|", "sector", "symbol").alias("pair")
    left = home.join(F.broadcast(both), "sector").select(key, "sector", "market", "symbol", "date", F.col("excess").alias("home_excess"))
    right = foreign.join(F.broadcast(both), ["market", "symbol"]).select(key, F.col("date").alias("foreign_date"), F.col("excess").alias("foreign_excess"))
    j = asof(left, right, "pair", "date", "foreign_date", strict=True, prefix="").where("foreign_date IS NOT NULL")
    w = Window.partitionBy("pair", "foreign_date").orderBy("date")
    return j.withColumn("k", F.row_number().over(w)).where("k = 1").select("sector", "market", "symbol", "date", "foreign_date", "home_excess", "foreign_excess")


def lead_lag_stats(pairs: DataFrame) -> DataFrame:
    a, f = F.col("home_excess"), F.col("foreign_excess")
    moved = (a != 0) & (f != 0)
    return pairs.groupBy("sector", "market", "symbol").agg(
        F.count("*").alias("samples"), rnd(correlation(a, f), 4).alias("lead_correlation"), rnd(100.0 * ratio(F.count_if(moved & ((a > 0) == (f > 0))), F.count_if(moved)), 2).alias("direction_agreement_pct")
    )


def last_returns(bars: DataFrame, key: list[str], periods: tuple[int, ...]) -> DataFrame:
    """The last bar of each series with its returns over some numbers of bars."""
    w = Window.partitionBy(*key).orderBy("date")
    cols = {f"r{n}": (F.col("close") / F.lag("close", n).over(w) - 1) * 100 for n in periods}
    return bars.withColumns(cols).groupBy(*key).agg(F.max("date").alias("as_of"), *[F.max_by(c, "date").alias(c) for c in cols])


def market_impulse(bars: DataFrame, strength: DataFrame) -> DataFrame:
    """Strength-weighted excess of each market's peers; markets without peers appear, with none."""
    last = last_returns(bars, ["market", "symbol"], (5, 20))
    index = F.col("symbol").startswith("IDX_")
    own = last.where(~index).join(last.where(index).select("market", F.col("r5").alias("b5"), F.col("r20").alias("b20")), "market").join(strength, "symbol")
    x5, x20, m = F.col("r5") - F.col("b5"), F.col("r20") - F.col("b20"), F.col("strength")
    mean = lambda x: ratio(F.sum(F.when(x.isNotNull() & (m > 0), x * m)), F.sum(F.when(x.isNotNull() & (m > 0), m)))
    found = own.groupBy("market").agg(F.count("*").alias("peer_count"), rnd(mean(x5), 4).alias("weighted_excess_5d_pct"), rnd(mean(x20), 4).alias("weighted_excess_20d_pct"))
    every = bars.sparkSession.createDataFrame([(m,) for m in MARKETS], "market string")
    j = every.join(found, "market", "left")
    return j.select("market", F.coalesce("peer_count", F.lit(0)).alias("peer_count"), "weighted_excess_5d_pct", "weighted_excess_20d_pct", signed_regime(F.col("weighted_excess_5d_pct")).alias("regime_5d"))


def acceptance(home: Column, foreign: Column) -> Column:
    h, f = signed_regime(home), signed_regime(foreign)
    return (
        F.when((f == "positive") & (h == "negative"), "foreign_positive_a_rejected").when((f == "negative") & (h == "positive"), "foreign_negative_a_resilient")
        .when((f == "positive") & (h == "positive"), "positive_confirmed").when((f == "negative") & (h == "negative"), "negative_confirmed").otherwise("mixed_or_insufficient")
    )


def event_windows(bars: DataFrame, key: str = "code") -> DataFrame:
    """Each bar as the anchor of an event: returns against the close before it, and volume against the 20 bars before.

    ``prev_date`` is the day of the bar before; an event of a day in (prev_date, date] anchors here.
    """
    w = by_date(code=key)
    prev = F.lag("close").over(w)
    after = lambda n: (F.lead("close", n - 1).over(w) / prev - 1) * 100
    before = F.avg(F.when(F.col("volume") > 0, F.col("volume"))).over(w.rowsBetween(-20, -1))
    return bars.select(
        key, F.col("date").alias("anchor"), F.lag("date").over(w).alias("prev_date"), prev.alias("prev_close"), ((prev / F.lag("close", 6).over(w) - 1) * 100).alias("pre_5d"),
        after(1).alias("r1"), after(3).alias("r3"), after(5).alias("r5"), F.when(F.col("volume") > 0, ratio(F.col("volume"), before)).alias("volume_ratio"),
    ).where("prev_close IS NOT NULL")


def forward_asof(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str) -> DataFrame:
    """Each left row with the first right row at or after it: the as-of join on reversed time."""
    flip = lambda c: F.datediff(F.lit("1900-01-01").cast("date"), F.col(c))
    j = asof(left.withColumn("__lt", flip(left_time)), right.withColumn("__rt", flip(right_time)), key, "__lt", "__rt", prefix="")
    return j.drop("__lt", "__rt")


def event_reactions(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Each event with the reaction of its stock against its sector, as labels and flags.

    Events whose stock, sector or market has no bar at or after the day, or none before that bar, are left out.
    """
    windows = event_windows(bars)
    sector = bars.where("role = 'stock'").select("code", "sector").distinct()
    # what an event meets depends on its code and day alone: days times codes, however many events there are
    days = events.select("code", "event_date").distinct().join(F.broadcast(sector), "code")
    e = forward_asof(days, windows, "code", "event_date", "anchor").where("anchor IS NOT NULL")
    e = e.select("code", "sector", "event_date", "anchor", "pre_5d", F.col("r1").alias("a1"), F.col("r3").alias("a3"), F.col("r5").alias("a5"), "volume_ratio")
    s = windows.where(F.col("code").startswith("S")).select(F.col("code").alias("sector"), F.col("anchor").alias("sector_anchor"), F.col("r1").alias("s1"), F.col("r5").alias("s5"))
    # sectors and the market are looked up by day, whatever the number of stocks
    near = forward_asof(e.select("sector", "event_date").distinct(), s, "sector", "event_date", "sector_anchor").where("sector_anchor IS NOT NULL")
    m = windows.where("code = 'MKT'").select(F.lit("MKT").alias("mkt"), F.col("anchor").alias("market_anchor"))
    wide = forward_asof(near.select("event_date").distinct().withColumn("mkt", F.lit("MKT")), m, "mkt", "event_date", "market_anchor").where("market_anchor IS NOT NULL").drop("mkt")
    e = e.join(near.join(wide, "event_date"), ["sector", "event_date"])
    e = events.join(e, ["code", "event_date"])
    d, x1, x5 = F.col("direction"), F.col("a1") - F.col("s1"), F.col("a5") - F.col("s5")
    regime = (
        F.when((d == "positive") & (x1 <= -THRESHOLD), "positive_rejected").when((d == "negative") & (x1 >= THRESHOLD), "negative_absorbed")
        .when((d == "positive") & (x1 >= THRESHOLD), "positive_confirmed").when((d == "negative") & (x1 <= -THRESHOLD), "negative_confirmed").otherwise("ambiguous")
    )
    flags = F.array_compact(F.array(
        F.when((d == "positive") & (F.col("pre_5d") >= 2), "possible_positive_priced_in"), F.when((d == "negative") & (F.col("pre_5d") <= -2), "possible_negative_priced_in"),
        F.when((x1 * x5 < 0) & (F.abs(x5) >= THRESHOLD), "reaction_reversed_by_5d"), F.when(F.col("volume_ratio") >= 1.8, "high_event_volume"),
    ))
    maturity = F.coalesce(F.create_map(*[F.lit(v) for kv in MATURITY.items() for v in kv])[F.col("stage")], F.lit(MATURITY["unknown"]))
    return e.select(
        "event_id", "code", "event_date", F.col("anchor").alias("event_trading_date"), "direction", "stage", maturity.alias("stage_maturity"), regime.alias("regime"),
        rnd(x1, 4).alias("relative_return_1d_pct"), rnd(x5, 4).alias("relative_return_5d_pct"), rnd("pre_5d", 4).alias("pre_5d_return_pct"), rnd("a3", 4).alias("return_3d_pct"),
        rnd("volume_ratio", 4).alias("event_volume_ratio_20d"), F.array_join(flags, ",").alias("flags"),
    )


def snapshots(bars: DataFrame, limit: float = 2.0) -> DataFrame:
    """A market snapshot of each day from the stocks' bars: breadth, stocks that reached ``limit`` percent, and what became of them."""
    w = by_date()
    s = bars.where("role = 'stock'").withColumn("prev", F.lag("close").over(w)).where("prev IS NOT NULL")
    s = s.withColumns({"ret": (F.col("close") / F.col("prev") - 1) * 100, "top": (F.col("high") / F.col("prev") - 1) * 100})
    s = s.withColumns({"up": (F.col("ret") >= limit).cast("int"), "down": (F.col("ret") <= -limit).cast("int"), "broken": ((F.col("top") >= limit) & (F.col("ret") < limit)).cast("int")})
    # days in a row at the limit: bars since the last one below it
    s = s.withColumn("k", F.row_number().over(w)).withColumn("miss", F.max(F.when(F.col("up") == 0, F.col("k")).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumns({"height": F.col("k") - F.col("miss"), "was_up": F.lag("up").over(w), "rose": (F.col("ret") > 0).cast("int")})
    m = daily_returns(bars.where("role = 'sector'"), "code").groupBy("date").agg(F.avg("ret").alias("index_return"))
    day = s.groupBy("date").agg(
        F.sum("rose").alias("advance_count"), F.count_if(F.col("ret") < 0).alias("decline_count"), F.sum("up").alias("limit_up_count"), F.sum("down").alias("limit_down_count"),
        F.sum("broken").alias("broken_limit_count"), F.max("height").cast("long").alias("max_limit_height"), (100.0 * ratio(F.sum(F.when(F.col("was_up") == 1, F.col("rose"))), F.sum("was_up"))).alias("continuation_rate_pct"),
    )
    broke = 100.0 * ratio(F.col("broken_limit_count"), F.col("broken_limit_count") + F.col("limit_up_count"))
    return day.withColumn("break_rate_pct", broke).join(m, "date", "left")


def mood(day: DataFrame) -> DataFrame:
    """Mood score, coverage and regime of snapshots; parts that a snapshot lacks are left out and the weights renormalized."""
    up, down = F.col("limit_up_count"), F.col("limit_down_count")
    parts = [(clamp(50 + 50 * (up - down) / (up + down + 20)), 0.40), (clamp(100 - F.col("break_rate_pct")), 0.35), (clamp(20.0 * F.col("max_limit_height")), 0.25)]
    total = sum((F.when(x.isNotNull(), F.lit(w)).otherwise(0.0) for x, w in parts), F.lit(0.0))
    ecology = F.try_divide(sum((F.coalesce(x * w, F.lit(0.0)) for x, w in parts), F.lit(0.0)), total)
    c = {
        "breadth": rnd(100.0 * ratio(F.col("advance_count"), F.col("advance_count") + F.col("decline_count")), 3), "limit_ecology": rnd(ecology, 3),
        "momentum": rnd(clamp(50 + 12.5 * F.col("index_return")), 3), "continuation": rnd(clamp(F.col("continuation_rate_pct")), 3),
    }
    base = sum((F.when(c[k].isNotNull(), F.lit(w)).otherwise(0.0) for k, w in MOOD_WEIGHTS.items()), F.lit(0.0))
    score = F.try_divide(sum((F.coalesce(c[k] * w, F.lit(0.0)) for k, w in MOOD_WEIGHTS.items()), F.lit(0.0)), base)
    label = F.when(score < 25, "very_cold").when(score < 42, "cold").when(score < 58, "neutral").when(score < 75, "hot").otherwise("very_hot")
    return day.select("date", *[v.alias(k) for k, v in c.items()], rnd(score, 3).alias("score"), rnd(base, 3).alias("coverage"), F.when(score.isNotNull(), label).alias("regime"))


def title_key(title: Column) -> Column:
    """Digest of a title without signs and blanks, lower-cased; letters of any script stay."""
    return F.sha2(F.lower(F.regexp_replace(title, r"(?U)[^\w㐀-鿿]+", "")), 256)


def in_week(published: str, now: Column) -> Column:
    return (F.col(published) <= now + F.expr("INTERVAL 5 MINUTES")) & (F.col(published) >= now - F.expr("INTERVAL 7 DAYS"))


def dedupe_titles(articles: DataFrame, keys: list[str]) -> DataFrame:
    """The newest of the articles with one title key, within ``keys``; ties to the greatest id."""
    return articles.withColumn("title_key", title_key(F.col("title"))).groupBy(*keys, "title_key").agg(F.max_by(F.struct("article_id", "source", "published_at"), F.struct("published_at", "article_id")).alias("a")).select(*keys, "title_key", "a.*")


def topic_heat(matched: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Attention of each topic (``keys``) over its matched articles of the last week.

    Articles are deduplicated by title first, and the ratio of copies is kept.
    """
    recent = matched.where(in_week("published_at", now))
    all_n = recent.groupBy(*keys).agg(F.count("*").alias("matched_articles"))
    d = dedupe_titles(recent, keys)
    t = F.col("published_at")
    day, hour = now - F.expr("INTERVAL 24 HOURS"), now - F.expr("INTERVAL 1 HOUR")
    g = d.groupBy(*keys).agg(
        F.count("*").alias("unique_articles"), F.count_if(t >= hour).alias("last_hour_count"), F.count_if(t >= day).alias("last_24h_count"), F.count_if(t < day).alias("prior_six_day_count"),
        F.countDistinct(F.when(t >= day, F.coalesce("source", F.lit("unknown")))).alias("sources"),
    )
    velocity = (F.col("last_24h_count") + 1) / (F.col("prior_six_day_count") / 6 + 1)
    attention, diversity = clamp(50 + 20 * F.log2(velocity)), clamp(20.0 * F.col("sources"))
    recency = clamp(100.0 * F.col("last_hour_count") / F.greatest(F.lit(1), F.col("last_24h_count")))
    return g.join(all_n, keys).select(
        *keys, rnd(0.60 * attention + 0.25 * diversity + 0.15 * recency, 3).alias("score"), rnd(attention, 3).alias("attention_velocity_score"), rnd(diversity, 3).alias("source_diversity_score"),
        rnd(recency, 3).alias("recency_score"), "last_hour_count", "last_24h_count", "prior_six_day_count", rnd(velocity, 6).alias("velocity_ratio"),
        rnd(1 - F.col("unique_articles") / F.col("matched_articles"), 6).alias("duplicate_ratio"), "matched_articles",
    )
