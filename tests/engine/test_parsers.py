import json

from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.sources import parsers as P


def land(spark, *bodies):
    return spark.createDataFrame([(b if isinstance(b, str) else json.dumps(b, ensure_ascii=False),) for b in bodies], "body string")


def test_kline_order_and_prefix(spark):
    body = {"data": {"sh600000": {"qfqday": [["2026-01-02", "1.0", "1.1", "1.2", "0.9", "1000"], ["bad"], ["2026-01-05", "x", "nan", "1", "1", "1"]]}}}
    rows = P.kline(land(spark, body, "<html>"), "sh600000").collect()
    assert [(str(r["date"]), r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in rows] == [("2026-01-02", 1.0, 1.2, 0.9, 1.1, 1000.0)]
    got = spark.createDataFrame([("000300",), ("SZ000001",), ("600519",), ("830001",), ("000001x",)], "c string").select(P.market_prefix(F.col("c")).alias("m")).collect()
    assert [r["m"] for r in got] == ["sh", "sz", "sh", "bj", "sz"]


def test_chart_prefers_adjusted_close(spark):
    body = {"chart": {"result": [{"meta": {"exchangeTimezoneName": "America/New_York"}, "timestamp": [1767364200, 1767364260], "indicators": {"quote": [{"open": [100, 1], "high": [103, 2], "low": [99, 1], "close": [102.0, -1], "volume": [10, 1]}], "adjclose": [{"adjclose": [101.5, None]}]}}]}}
    r = P.chart(land(spark, body), "X").collect()
    assert len(r) == 1 and r[0]["close"] == 101.5 and r[0]["raw_close"] == 102.0 and str(r[0]["date"]) == "2026-01-02"


def test_feeds(spark):
    rss = "<rss><channel><item><title>A &amp; B</title><link>http://x.com/a?utm_source=q&amp;id=1#f</link><pubDate>Sat, 08 Aug 2026 01:02:03 GMT</pubDate><description>&lt;p&gt;hi&lt;/p&gt;</description></item></channel></rss>"
    atom = '<feed><entry><title>T</title><link href="https://y.com/b"/><updated>2026-08-08T00:00:00Z</updated><summary>s</summary></entry></feed>'
    js = {"items": [{"title": "J", "url": "https://z.com/c", "date_published": "2026-08-08T00:00:00Z", "content_text": "c"}]}
    got = {r["title"]: r for r in P.feed(land(spark, rss, atom, js, "nothing"), "s").collect()}
    assert set(got) == {"A & B", "T", "J"}
    assert got["A & B"]["url"] == "http://x.com/a?id=1" and str(got["A & B"]["published_at"]) == "2026-08-08 01:02:03"


def test_news_parsers_and_outcomes(spark):
    landed = spark.createDataFrame(
        [
            ("a", "flash", 'var ajaxResult={"LivesList":[{"title":"t","url_w":"http://f.com/1","showtime":"2026-08-08 10:00:00","digest":"up 4.15%"}]}'),
            ("b", "news_list", json.dumps({"code": "1", "data": {"list": [{"title": "n", "url": "https://l.com/1", "showTime": "2026-08-08 10:00:00"}]}})),
            ("c", "news_list", json.dumps({"code": "0", "data": {"list": []}})),
            ("d", "live", json.dumps({"data": {"items": [{"content_text": "【Head】body", "uri": "https://w.com/1", "display_time": 1786180000}]}}, ensure_ascii=False)),
            ("e", "telegraph", json.dumps({"data": {"roll_data": [{"brief": "short", "shareurl": "https://c.com/1", "ctime": 1786180000}]}})),
            ("f", "first_list", "cb(" + json.dumps({"x": 1, "T1": [{"title": "q", "url": "https://n.com/1", "ptime": "2026-08-08 10:00:00"}]}) + ")"),
            ("g", "flash", "<html>"),
        ],
        "source string, parser string, body string",
    )
    items = P.parse(landed)
    got = {r["source"]: r for r in items.collect()}
    assert set(got) == {"a", "b", "d", "e", "f"}
    assert got["a"]["url"].startswith("https://") and "4.15%" in got["a"]["summary"]
    assert got["d"]["title"] == "Head" and got["d"]["published_at"] is not None
    assert {r["source"]: r["outcome"] for r in P.outcomes(landed, items).collect()} == {"a": "success", "b": "success", "c": "failed", "d": "success", "e": "success", "f": "success", "g": "failed"}
    assert all(r["fact_id"].startswith("NEWS-2026") for r in P.news_facts(items).collect())


def test_articles_filings_trials_statistics(spark):
    a = P.article_list(land(spark, {"articles": [{"url": "https://a.com/x?utm_medium=1", "title": "one", "seendate": "20260808T010000Z", "domain": "a.com"}, {"url": "https://a.com/x", "title": "two", "seendate": "20260809T000000Z", "domain": "a.com"}]})).collect()
    assert [(r["title"], str(r["period"]), r["evidence_role"]) for r in a] == [("one", "2026-08-08", "discovery_lead")]
    t = P.ticker_map(land(spark, {"0": {"cik_str": 320193, "ticker": "aapl"}}, {"fields": ["cik", "name", "ticker"], "data": [[789019, "M", "MSFT"]]}))
    assert {(r["ticker"], r["cik"]) for r in t.collect()} == {("AAPL", "0000320193"), ("MSFT", "0000789019")}
    f = P.filings(land(spark, {"filings": {"recent": {"accessionNumber": ["1-2", "3-4", ""], "filingDate": ["2026-01-02", "2026-01-03", "2026-01-04"], "form": ["8-K", "4", "8-K"], "primaryDocument": ["a.htm", "b.htm", "c.htm"]}}}), "0000320193", ("8-K",)).collect()
    assert [(r["form"], r["source_url"][-15:]) for r in f] == [("8-K", "320193/12/a.htm")]
    s = P.trials(land(spark, {"studies": [{"protocolSection": {"identificationModule": {"nctId": "N1", "briefTitle": "b"}, "statusModule": {"overallStatus": "RECRUITING"}, "designModule": {"phases": ["PHASE2"]}}}]})).collect()
    assert s[0]["status"] == "RECRUITING" and s[0]["phases"] == ["PHASE2"]
    o = P.observations(land(spark, {"observations": [{"date": "2026-01-01", "value": "1.5"}, {"date": "2026-01-02", "value": "."}, {"date": "2026-01-03", "value": "n/a"}]}), "G").collect()
    assert [(r["value"], r["raw"]) for r in o] == [(1.5, "1.5"), (None, "n/a")]
    w = P.indicator(land(spark, [{}, [{"indicator": {"id": "G", "value": "GDP (current US$)"}, "country": {"value": "C"}, "date": "2024", "value": 1.0}]])).collect()
    assert w[0]["unit"] == "current US$"


def test_universe_falls_back_to_seeds(spark):
    boards = spark.createDataFrame([("AI chips", "concept", "688001", "A", 5.0), ("Chip gear", "industry", "688001", "A", 6.0), ("AI chips", "concept", "688002", "*ST B", 9.0), ("Banks", "industry", "600000", "C", 9.0), ("AI chips", "concept", "68", "D", 1.0)], "board string, kind string, code string, name string, market_cap double")
    seeds = spark.createDataFrame([("000001", "S")], "code string, name string")
    got = P.universe(boards, ["CHIP"], seeds).collect()
    assert [(r["code"], r["market_cap"], r["boards"]) for r in got] == [("688001", 6.0, ["AI chips", "Chip gear"])]
    assert [r["code"] for r in P.universe(boards, ["none"], seeds).collect()] == ["000001"]


def test_cache_coverage_health(spark):
    f = spark.createDataFrame([("https://u:p@x.com/a?token=abc&b=1", "old", 200, "2026-01-01 00:00:00"), ("https://u:p@x.com/a?token=abc&b=1", "new", 200, "2026-01-01 00:10:00"), ("https://u:p@x.com/a?token=abc&b=1", "bad", 500, "2026-01-01 00:20:00")], "url string, body string, status int, retrieved_at string").withColumn("retrieved_at", F.col("retrieved_at").cast("timestamp"))
    r = P.latest_fetch(f, "2026-01-01 00:15:00", 600).first()
    assert (r["status"], r["body"], r["url"]) == ("cached", "new", "https://***@x.com/a?token=REDACTED&b=1")
    assert P.latest_fetch(f, "2026-01-01 02:00:00", 600).first()["status"] == "stale"
    bars = spark.createDataFrame([("a", f"2026-01-{i:02d}") for i in range(1, 26)], "code string, date string")
    c = {r["code"]: r["warning"] for r in P.history_coverage(spark.createDataFrame([("a",), ("b",)], "code string"), bars).collect()}
    assert c == {"a": None, "b": "only 0 bars"}
    h = P.health(spark.createDataFrame([("s", "healthy", 10.0), ("s", "failed", None), ("s", "healthy", 30.0)], "source string, status string, latency_ms double")).first()
    assert (h["healthy"], h["failed"], h["skipped"], h["median_latency_ms"]) == (2, 1, 0, 20.0)


def test_timestamps_and_slugs(spark):
    forms = ["1786180000", "1786180000000", "Sat, 08 Aug 2026 01:02:03 +0800", "2026-08-08T01:02:03Z", "2026-08-08 01:02", "20260808T010203Z", "2026-08-08", "yesterday"]
    got = [r["t"] for r in spark.createDataFrame([(f,) for f in forms], "s string").select(text.timestamp(F.col("s")).cast("string").alias("t")).collect()]
    assert got[0] == got[1] and got[2].startswith("2026-08-07 17:02") and got[3] == "2026-08-08 01:02:03" and got[5] == "2026-08-08 01:02:03" and got[7] is None and None not in got[:7]
    r = spark.range(1).select(text.slug(F.lit("Hello, World!")).alias("a"), text.slug(F.lit("")).alias("b"), text.iso_date(F.lit("on 2026-03-04 it")).cast("string").alias("c")).first()
    assert tuple(r) == ("hello-world", "item", "2026-03-04")


def test_phrases_count_without_overlap(spark):
    t = "公司盈利增长20%，但风险与下调可能仍存。数据显示2026-08-08"
    row = spark.createDataFrame([(t,)], "t string").select(*[text.phrase_count(text.squeeze(F.col("t")), v).alias(k) for k, v in text.LEXICONS.items()], F.regexp_count("t", F.lit(text.NUMBER)).alias("n")).first()
    assert row["positive"] == 2 and row["negative"] == 2 and row["uncertainty"] == 1 and row["source_language"] == 1 and row["n"] > 0


def test_addresses_and_markup(spark):
    """Tracking parameters, references, users and hosts, as the feeds have them."""
    cases = {
        "http://Example.com//a//b?utm_source=x&id=7#top": "http://example.com/a/b?id=7", "https://a.com/?from=a&ref=9&source=z": "https://a.com/?from=a&ref=9&source=z",
        "https://a.com?REF_SRC=t&at_medium=m&at_campaign=c&q=1&amp;r=2": "https://a.com/?q=1&r=2", "http://finance.eastmoney.com/x": "https://finance.eastmoney.com/x", "https://u:p@a.com/": None,
        "ftp://a.com/": None, "https://a.com:8443/x?k": "https://a.com:8443/x?k=", "https://a.com:99999/": None, " https://a.com/?q=a+b%2Fc ": "https://a.com/?q=a+b%2Fc", "": None,
    }
    got = spark.createDataFrame([(k,) for k in cases], "u string").select("u", text.canonical_url(F.col("u")).alias("c")).collect()
    assert {r["u"]: r["c"] for r in got} == cases
    pages = {"<script>x</style>secret</script>a&#8212;b &eacute;&nbsp;<b>c</b>": "a—b é c", "&lt;p&gt;in&lt;/p&gt; <style>s</style>out": "in out", "a &am b": "a &am b"}
    got = spark.createDataFrame([(k,) for k in pages], "h string").select("h", text.html_text(F.col("h")).alias("t")).collect()
    assert {r["h"]: r["t"] for r in got} == pages


def test_words_ranges_markets_and_times(spark):
    one = spark.range(1)
    assert one.select(text.query_words(F.lit(" AI，芯片;Gold|oil/AI ；x "))).first()[0] == ["ai", "芯片", "gold", "oil", "x"]
    assert [one.select(P.range_for_days(F.lit(n))).first()[0] for n in (1, 120, 121, 260, 261, 520, 521)] == ["6mo", "6mo", "1y", "1y", "2y", "2y", "5y"]
    assert [one.select(P.market_prefix(F.lit(c))).first()[0] for c in ("000001", "000300", "SZ000001", "600000", "830799", "BJ1")] == ["sz", "sh", "sz", "sh", "bj", "bj"]
    assert one.select(text.timestamp(F.lit("20240131"), zone="Asia/Shanghai").cast("string")).first()[0] == "2024-01-30 16:00:00"
    assert one.select(text.timestamp(F.lit("2024-01-31T08:00:00Z"), zone="Asia/Shanghai").cast("string")).first()[0] == "2024-01-31 08:00:00"
