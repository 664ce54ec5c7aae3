"""Landed payloads turned into rows: price feeds, news feeds, filings, statistics, trials.

Fetching stays outside the engine: bodies are landed in a table of (body, ...) by whatever may
reach the network, and each parser is a DataFrame expression over that table. A body that does
not parse gives no rows; ``outcomes`` makes that a failed outcome of its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.expr import finite

#: Index codes that trade in the first market although they look like the second's.
SH_INDEX = ("000016", "000300", "000688", "000852", "000905")


def body_text(body: Column, charset: str = "UTF-8") -> Column:
    """Text of landed bytes, without a byte-order mark."""
    return F.regexp_replace(F.decode(body, charset), "^﻿", "")


def normalize_code(code: Column) -> Column:
    """The last six digits of a code, null under six."""
    d = F.regexp_replace(code.cast("string"), "[^0-9]", "")
    return F.when(F.length(d) >= 6, F.right(d, F.lit(6)))


def market_prefix(code: Column) -> Column:
    """sh, sz or bj by an explicit prefix, the index list, or the leading digit."""
    given = F.lower(F.regexp_extract(code, r"(?i)^(sh|sz|bj)", 1))
    six = normalize_code(code)
    by_digit = F.when(six.isin(*SH_INDEX) | F.left(six, F.lit(1)).isin("5", "6", "9"), "sh").when(F.left(six, F.lit(1)).isin("4", "8"), "bj").otherwise("sz")
    return F.when(given != "", given).otherwise(by_digit)


def kline(landed: DataFrame, code: str, adjustment: str = "qfqday") -> DataFrame:
    """Daily bars of a positional feed: each item is date, open, close, high, low, volume; malformed items are dropped."""
    rows = F.from_json(F.get_json_object("body", f"$.data.{code}.{adjustment}"), "array<array<string>>")
    x = landed.select(F.lit(code).alias("code"), F.posexplode(rows).alias("ingest_seq", "r")).where(F.size("r") >= 6)
    at = lambda i: finite(F.col("r")[i])
    out = x.select("code", F.try_to_date(F.col("r")[0]).alias("date"), at(1).alias("open"), at(3).alias("high"), at(4).alias("low"), at(2).alias("close"), at(5).alias("volume"), F.col("ingest_seq").cast("long").alias("ingest_seq"))
    return out.where("date IS NOT NULL AND close IS NOT NULL")


def chart(landed: DataFrame, symbol: str) -> DataFrame:
    """Daily bars of a columnar chart: adjusted close where there is one, the exchange's own date, last row of a date wins."""
    kind = "struct<chart:struct<result:array<struct<meta:struct<exchangeTimezoneName:string>,timestamp:array<bigint>,indicators:struct<quote:array<struct<open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>>>,adjclose:array<struct<adjclose:array<double>>>>>>>>"
    r = landed.select(F.explode(F.from_json("body", kind)["chart"]["result"]).alias("x"))
    q, adj = F.col("x.indicators.quote")[0], F.get(F.col("x.indicators.adjclose"), F.lit(0))["adjclose"]
    z = r.select(F.coalesce("x.meta.exchangeTimezoneName", F.lit("UTC")).alias("tz"), F.posexplode("x.timestamp").alias("i", "ts"), q.alias("q"), adj.alias("adj"))
    at = lambda c: F.get(F.col(f"q.{c}"), F.col("i"))
    close = F.coalesce(F.when(F.get("adj", "i") > 0, F.get("adj", "i")), at("close"))
    rows = z.select(F.lit(symbol).alias("symbol"), F.to_date(F.from_utc_timestamp(F.timestamp_seconds("ts"), F.col("tz"))).alias("date"), at("open").alias("open"), at("high").alias("high"), at("low").alias("low"), close.alias("close"), at("close").alias("raw_close"), at("volume").alias("volume"), "i")
    last = F.max_by(F.struct("open", "high", "low", "close", "raw_close", "volume"), "i")
    return rows.where("close > 0").groupBy("symbol", "date").agg(last.alias("b")).select("symbol", "date", "b.*")


def range_for_days(days: Column) -> Column:
    """The span that a chart is asked for."""
    return F.when(days <= 120, "6mo").when(days <= 260, "1y").when(days <= 520, "2y").otherwise("5y")


def _items(x: DataFrame, source: str) -> DataFrame:
    """News items in one form: source, title, url, published_at, summary; those without title or address go."""
    return x.select(F.lit(source).alias("source"), text.html_text(F.col("title"), 500).alias("title"), text.canonical_url(F.col("url")).alias("url"), text.timestamp(F.col("published").cast("string")).alias("published_at"), text.html_text(F.coalesce("summary", F.lit("")), 1000).alias("summary")).where("title <> '' AND url IS NOT NULL")


def feed(landed: DataFrame, source: str) -> DataFrame:
    """Items of RSS, Atom or JSON feeds."""
    rss = "struct<channel:struct<item:array<struct<title:string,link:string,pubDate:string,description:string>>>>"
    atom = "struct<entry:array<struct<title:string,link:struct<_href:string>,updated:string,published:string,summary:string>>>"
    js = "struct<items:array<struct<title:string,url:string,date_published:string,summary:string,content_text:string>>>"
    kind = F.when(F.regexp_like("body", F.lit(r"^\s*\{")), "json").when(F.contains("body", F.lit("<rss")), "rss").when(F.contains("body", F.lit("<feed")), "atom").otherwise("none")
    x = landed.select("body", kind.alias("kind"))
    a = x.where("kind = 'rss'").select(F.explode(F.from_xml("body", rss)["channel"]["item"]).alias("i")).select("i.title", F.col("i.link").alias("url"), F.col("i.pubDate").alias("published"), F.col("i.description").alias("summary"))
    b = x.where("kind = 'atom'").select(F.explode(F.from_xml("body", atom)["entry"]).alias("i")).select("i.title", F.col("i.link._href").alias("url"), F.coalesce("i.published", "i.updated").alias("published"), "i.summary")
    c = x.where("kind = 'json'").select(F.explode(F.from_json("body", js)["items"]).alias("i")).select("i.title", "i.url", F.col("i.date_published").alias("published"), F.coalesce("i.summary", "i.content_text").alias("summary"))
    return _items(a.unionByName(b).unionByName(c), source)


def _object(body: str) -> Column:
    """The JSON object inside a script assignment or callback."""
    return F.regexp_extract(body, r"(?s)(\{.*\})", 1)


def flash(landed: DataFrame, source: str) -> DataFrame:
    """Flash news in a script: LivesList of title, url, time, digest."""
    x = landed.select(F.explode(F.from_json(_object("body"), "struct<LivesList:array<struct<title:string,url_w:string,url:string,showtime:string,digest:string>>>")["LivesList"]).alias("i"))
    return _items(x.select("i.title", F.regexp_replace(F.coalesce("i.url_w", "i.url"), "^http://", "https://").alias("url"), F.col("i.showtime").alias("published"), F.col("i.digest").alias("summary")), source)


def news_list(landed: DataFrame, source: str) -> DataFrame:
    """A list of articles, only where its code says that it worked."""
    x = landed.where(F.get_json_object("body", "$.code").cast("string") == "1").select(F.explode(F.from_json(F.get_json_object("body", "$.data.list"), "array<struct<title:string,url:string,showTime:string,summary:string>>")).alias("i"))
    return _items(x.select("i.title", "i.url", F.col("i.showTime").alias("published"), "i.summary"), source)


def live(landed: DataFrame, source: str) -> DataFrame:
    """Live items; the title is the part in 【】 or the first 120 characters."""
    x = landed.select(F.explode(F.from_json(F.get_json_object("body", "$.data.items"), "array<struct<title:string,content_text:string,uri:string,display_time:string>>")).alias("i"))
    bracket = F.regexp_extract("i.content_text", "【([^】]+)】", 1)
    title = F.coalesce(F.nullif(F.col("i.title"), F.lit("")), F.nullif(bracket, F.lit("")), F.left(F.col("i.content_text"), F.lit(120)))
    return _items(x.select(title.alias("title"), F.col("i.uri").alias("url"), F.col("i.display_time").alias("published"), F.col("i.content_text").alias("summary")), source)


def telegraph(landed: DataFrame, source: str) -> DataFrame:
    x = landed.select(F.explode(F.from_json(F.get_json_object("body", "$.data.roll_data"), "array<struct<title:string,brief:string,shareurl:string,ctime:string>>")).alias("i"))
    return _items(x.select(F.coalesce(F.nullif(F.col("i.title"), F.lit("")), F.left(F.col("i.brief"), F.lit(120))).alias("title"), F.col("i.shareurl").alias("url"), F.col("i.ctime").alias("published"), F.col("i.brief").alias("summary")), source)


def first_list(landed: DataFrame, source: str) -> DataFrame:
    """Items under ``list`` or, without one, under the first key that holds a list."""
    m = F.from_json(_object("body"), "map<string,string>")
    value = F.coalesce(m["list"], F.get(F.filter(F.map_values(m), lambda v: F.regexp_like(v, F.lit(r"^\s*\["))), F.lit(0)))
    x = landed.select(F.explode(F.from_json(value, "array<struct<title:string,url:string,ptime:string,digest:string>>")).alias("i"))
    return _items(x.select("i.title", "i.url", F.col("i.ptime").alias("published"), F.col("i.digest").alias("summary")), source)


PARSERS = {"feed": feed, "flash": flash, "news_list": news_list, "live": live, "telegraph": telegraph, "first_list": first_list}


def parse(landed: DataFrame, most: int = 50) -> DataFrame:
    """Items of a landed table (source, parser, body): each source's newest ``most``, which is the feed's own limit."""
    from pyspark.sql import Window

    out = None
    for row in landed.select("source", "parser").distinct().collect():  # a registry of sources: tens of names
        if row["parser"] in PARSERS:
            x = PARSERS[row["parser"]](landed.where((F.col("source") == row["source"]) & (F.col("parser") == row["parser"])), row["source"])
            out = x if out is None else out.unionByName(x)
    if out is None:
        raise ValueError("no source has a known parser")
    w = Window.partitionBy("source").orderBy(F.desc_nulls_last("published_at"), "url")
    return out.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")


def outcomes(landed: DataFrame, items: DataFrame) -> DataFrame:
    """(source, outcome, item_count): a source without items has failed."""
    n = items.groupBy("source").agg(F.count("*").alias("item_count"))
    return landed.select("source").distinct().join(n, "source", "left").select("source", F.when(F.col("item_count") > 0, "success").otherwise("failed").alias("outcome"), F.coalesce("item_count", F.lit(0)).alias("item_count"))


def news_facts(items: DataFrame, prefix: str = "NEWS", role: str = "discovery_lead") -> DataFrame:
    """Items as facts, one an address, the newest; the id holds the day, the publisher and a digest of the address."""
    one = items.groupBy("url").agg(F.max_by(F.struct("source", "title", "published_at", "summary"), F.struct("published_at", "title")).alias("i")).select("url", "i.*")
    day = F.date_format("published_at", "yyyyMMdd")
    fact_id = F.concat_ws("-", F.lit(prefix), F.coalesce(day, F.lit("undated")), text.slug(F.col("source")), F.substring(F.sha2("url", 256), 1, 12))
    return one.select(fact_id.alias("fact_id"), F.concat(F.lit("Reported: "), "title").alias("claim"), F.date_format("published_at", "yyyy-MM-dd").alias("period"), F.col("source").alias("publisher"), F.col("url").alias("source_url"), F.lit(role).alias("evidence_role"))


def article_list(landed: DataFrame) -> DataFrame:
    """Found articles of a news search: address, title, day seen, domain; first of an address wins."""
    x = landed.select(F.posexplode(F.from_json(F.get_json_object("body", "$.articles"), "array<struct<url:string,title:string,seendate:string,domain:string>>")).alias("n", "i")).where("i.url IS NOT NULL AND i.title IS NOT NULL")
    one = x.groupBy(text.canonical_url(F.col("i.url")).alias("url")).agg(F.min_by("i", "n").alias("i"))
    return one.where("url IS NOT NULL").select("url", F.col("i.title").alias("title"), F.col("i.domain").alias("publisher"), F.try_to_date(F.left(F.col("i.seendate"), F.lit(8)), "yyyyMMdd").alias("period"), F.lit("discovery_lead").alias("evidence_role"))


def ticker_map(landed: DataFrame) -> DataFrame:
    """(ticker, cik) of either payload: rows under fields and data, or objects by number; ciks have ten digits."""
    table = landed.select(F.explode(F.from_json(F.get_json_object("body", "$.data"), "array<array<string>>")).alias("r"), F.from_json(F.get_json_object("body", "$.fields"), "array<string>").alias("f"))
    at = lambda name: F.get(F.col("r"), (F.array_position("f", name) - 1).cast("int"))
    a = table.select(at("ticker").alias("ticker"), at("cik").alias("cik"))
    b = landed.where(F.get_json_object("body", "$.data").isNull()).select(F.explode(F.map_values(F.from_json("body", "map<string,struct<cik_str:string,ticker:string>>"))).alias("o")).select("o.ticker", F.col("o.cik_str").alias("cik"))
    return a.unionByName(b).where("ticker IS NOT NULL").select(F.upper("ticker").alias("ticker"), F.lpad(F.regexp_replace("cik", "[^0-9]", ""), 10, "0").alias("cik"))


def filings(landed: DataFrame, cik: str, forms: tuple[str, ...], limit: int = 20) -> DataFrame:
    """Recent filings, columns made rows: those of some forms with all they need, the newest ``limit``."""
    names = ("accessionNumber", "filingDate", "form", "primaryDocument")
    cols = [F.from_json(F.get_json_object("body", f"$.filings.recent.{n}"), "array<string>") for n in names]
    x = landed.select(F.inline(F.arrays_zip(*cols))).toDF(*names)
    ok = x.where(F.col("form").isin(*forms) & (F.coalesce("accessionNumber", F.lit("")) != "") & (F.coalesce("primaryDocument", F.lit("")) != "") & F.try_to_date("filingDate").isNotNull())
    url = F.concat(F.lit(f"https://www.sec.gov/Archives/edgar/data/{int(cik)}/"), F.regexp_replace("accessionNumber", "-", ""), F.lit("/"), F.col("primaryDocument"))
    return ok.select("form", F.to_date("filingDate").alias("period"), "accessionNumber", url.alias("source_url")).orderBy(F.desc("period"), "accessionNumber").limit(limit)


def trials(landed: DataFrame) -> DataFrame:
    """Clinical studies, their modules flattened."""
    kind = "array<struct<protocolSection:struct<identificationModule:struct<nctId:string,briefTitle:string>,statusModule:struct<overallStatus:string,lastUpdatePostDateStruct:struct<date:string>>,designModule:struct<phases:array<string>,enrollmentInfo:struct<count:bigint>>,conditionsModule:struct<conditions:array<string>>,sponsorCollaboratorsModule:struct<leadSponsor:struct<name:string>>,armsInterventionsModule:struct<interventions:array<struct<name:string>>>>>>"
    p = landed.select(F.explode(F.from_json(F.get_json_object("body", "$.studies"), kind)).alias("s")).select("s.protocolSection.*").where("identificationModule.nctId IS NOT NULL")
    return p.select(
        F.col("identificationModule.nctId").alias("nct_id"), F.col("identificationModule.briefTitle").alias("title"), F.col("statusModule.overallStatus").alias("status"), F.col("designModule.phases").alias("phases"), F.col("designModule.enrollmentInfo.count").alias("enrollment"),
        F.col("conditionsModule.conditions").alias("conditions"), F.col("sponsorCollaboratorsModule.leadSponsor.name").alias("sponsor"), F.transform("armsInterventionsModule.interventions", lambda i: i["name"]).alias("interventions"), F.col("statusModule.lastUpdatePostDateStruct.date").alias("period"),
    )


def observations(landed: DataFrame, series: str) -> DataFrame:
    """A statistic's values by date; missing marks are dropped, numbers are numbers, other values stay text."""
    x = landed.select(F.explode(F.from_json(F.get_json_object("body", "$.observations"), "array<struct<date:string,value:string,realtime_start:string>>")).alias("o")).where("o.value IS NOT NULL AND trim(o.value) NOT IN ('', '.')")
    return x.select(F.lit(series).alias("series"), F.try_to_date("o.date").alias("date"), finite(F.col("o.value")).alias("value"), F.col("o.value").alias("raw"), F.col("o.realtime_start").alias("vintage"))


def indicator(landed: DataFrame, unit: str | None = None) -> DataFrame:
    """An indicator's values by country and year; the unit is given, else the name's last parenthesis, else %."""
    x = landed.select(F.explode(F.from_json(F.get_json_object("body", "$[1]"), "array<struct<indicator:struct<id:string,value:string>,country:struct<value:string>,date:string,value:double,unit:string>>")).alias("o")).where("o.value IS NOT NULL")
    found = F.regexp_extract("o.indicator.value", r"\(([^()]*)\)\s*$", 1)
    u = F.coalesce(F.lit(unit), F.nullif(F.col("o.unit"), F.lit("")), F.nullif(found, F.lit("")), F.when(F.contains("o.indicator.value", F.lit("%")), "%"))
    return x.select(F.col("o.indicator.id").alias("indicator"), F.col("o.country.value").alias("country"), F.col("o.date").alias("period"), F.col("o.value").alias("value"), u.alias("unit"))


def universe(boards: DataFrame, keywords: list[str], seeds: DataFrame, cap: int = 80) -> DataFrame:
    """Members of the boards that a keyword names, one row a code with its boards; without any, the dated seeds. Largest first, ``cap`` at most.

    ``boards``: board, kind, code, name, market_cap; names at risk of delisting and odd codes are left out.
    """
    named = F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(F.lower("board"), k)) if keywords else F.lit(False)
    risky = F.contains(F.upper("name"), F.lit("ST")) | F.contains("name", F.lit("退"))
    m = boards.where(named & ~risky & F.regexp_like("code", F.lit(r"^\d{6}$"))).groupBy("code").agg(F.min("name").alias("name"), F.max("market_cap").alias("market_cap"), F.array_sort(F.collect_set("board")).alias("boards"))
    if m.isEmpty():
        m = seeds.select("code", "name", F.lit(None).cast("double").alias("market_cap"), F.array().cast("array<string>").alias("boards"))
    return m.orderBy(F.desc_nulls_last("market_cap"), F.desc("code")).limit(cap)


def history_coverage(asked: DataFrame, bars: DataFrame, least: int = 20) -> DataFrame:
    """(code, bars, last_date, warning) of every code asked for; a series under ``least`` bars counts as missing."""
    n = bars.groupBy("code").agg(F.count("*").alias("bars"), F.max("date").alias("last_date"))
    j = asked.select("code").distinct().join(n, "code", "left")
    return j.select("code", F.coalesce("bars", F.lit(0)).alias("bars"), "last_date", F.when(F.coalesce("bars", F.lit(0)) < least, F.concat(F.lit("only "), F.coalesce("bars", F.lit(0)).cast("string"), F.lit(" bars"))).alias("warning"))


def latest_fetch(fetches: DataFrame, now: str, ttl_seconds: int) -> DataFrame:
    """The body to use of each address (url, body, status, retrieved_at): cached within its time, stale beyond it, with the digest and secrets blanked."""
    good = fetches.where("status = 200").groupBy("url").agg(F.max_by(F.struct("body", "retrieved_at"), "retrieved_at").alias("f")).select("url", "f.*")
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("retrieved_at")
    return good.select(text.redact(F.col("url")).alias("url"), F.sha2("body", 256).alias("sha256"), "retrieved_at", F.when(age <= ttl_seconds, "cached").otherwise("stale").alias("status"), "body")


def health(probes: DataFrame) -> DataFrame:
    """Healthy, failed and skipped probes of each source, and the median latency of the healthy."""
    return probes.groupBy("source").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("healthy", "failed", "skipped")], F.median(F.when(F.col("status") == "healthy", F.col("latency_ms"))).alias("median_latency_ms"))
