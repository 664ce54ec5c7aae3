"""News collection: every parser, outcomes, first-wins addresses, claims and the gate."""

import datetime as dt
import json

import pytest

from tidewell.sources import collection as C

WHEN = dt.datetime(2026, 8, 20, 12, tzinfo=dt.timezone.utc)
RSS = """<rss version="2.0"><channel><title>x</title><item><title>A &amp;amp; B &lt;b&gt;up&lt;/b&gt;</title><link>http://x.com//a?utm_source=q&amp;id=1#f</link><pubDate>Thu, 20 Aug 2026 01:02:03 GMT</pubDate><description>&lt;p&gt;hi&lt;/p&gt;</description><source url="u">Other</source></item>
<item><title>no link</title></item><item><title>G</title><guid>https://x.com/g</guid></item></channel></rss>"""
ATOM = '<feed><entry><title>T</title><link rel="self" href="https://y.com/self"/><link href="https://y.com/b"/><updated>2026-08-19T00:00:00Z</updated><summary>s</summary></entry></feed>'


def j(x):
    return json.dumps(x, ensure_ascii=False)


BODIES = [
    ("rss", "feed", RSS), ("atom", "feed", ATOM), ("jsonfeed", "feed", j({"items": [{"title": "J", "id": "https://z.com/c", "date_modified": "2026-08-18T00:00:00Z"}, 3, {"title": "x"}]})),
    ("flash", "flash", 'var ajaxResult={"rc":1,"LivesList":[{"newsid":"20260820","title":"基金上涨","digest":"上涨4.15%。","showtime":"2026-08-20 13:38:24","url_w":"http://finance.eastmoney.com/a/1.html"},{"newsid":"77","title":"only id"}]};'),
    ("list", "news_list", j({"code": 1, "data": {"list": [{"title": "n", "articleUrl": "https://l.com/1", "showTime": "2026-08-20 10:00:00"}]}})), ("bad", "news_list", j({"code": "0", "data": {"list": [{"title": "n", "url": "https://l.com/1"}]}})),
    ("live", "live", j({"data": {"items": [{"id": 9, "content_text": "【Head】body", "display_time": 1786180000}, {"content_text": "no id"}]}})), ("cls", "telegraph", j({"data": {"roll_data": [{"id": 5, "brief": "", "content": "【标题】内容", "ctime": "1786180000"}, {"brief": "no id"}]}})),
    ("netease", "first_list", "cb(" + j({"x": 1, "T1": [{"title": "q", "docid": "D1", "ptime": "2026-08-20 10:00:00"}], "A0": [{"title": "later", "docid": "D2"}]}) + ")"), ("index", "index_feed", j({"items": [{"title": "K", "url": "https://k.com/1", "content_text": "t"}]})),
    ("twice", "feed", j({"items": [{"title": "J again", "url": "https://z.com/c?utm_medium=x", "content_text": "later source"}, {"title": "new", "url": "https://z.com/d"}]})), ("html", "flash", "<html>"), ("odd", "carrier-pigeon", "{}"), ("none", "feed", None), ("empty", "feed", j({"items": []})),
]


@pytest.fixture(scope="module")
def landed(spark):
    rows = [(s, n, s.upper(), p, "Asia/Shanghai" if p == "flash" else "UTC", None if b is None else bytearray(("﻿" + b).encode()), WHEN, "stale" if s == "rss" else "cached") for n, (s, p, b) in enumerate(BODIES)]
    return spark.createDataFrame(rows, "source string, ordinal int, publisher string, parser string, timezone string, body binary, retrieved_at timestamp, retrieval string").cache()


def test_parsers(landed):
    got = {}
    for r in C.articles(landed).collect():
        got.setdefault(r["source"], []).append(r)
    assert set(got) == {"rss", "atom", "jsonfeed", "flash", "list", "live", "cls", "netease", "index", "twice"}
    rss = sorted(got["rss"], key=lambda r: r["place"])
    assert [(r["title"], r["url"], r["publisher"], r["summary"]) for r in rss] == [("A & B up", "http://x.com/a?id=1", "Other", "hi"), ("G", "https://x.com/g", "RSS", "")]
    assert str(rss[0]["published_at"]) == "2026-08-20 01:02:03" and rss[1]["published_at"] == rss[1]["retrieved_at"]
    assert (got["atom"][0]["url"], str(got["atom"][0]["published_at"])) == ("https://y.com/b", "2026-08-19 00:00:00")
    assert [r["url"] for r in got["jsonfeed"]] == ["https://z.com/c"]
    flash = sorted(got["flash"], key=lambda r: r["place"])
    assert [(r["url"], r["summary"]) for r in flash] == [("https://finance.eastmoney.com/a/1.html", "上涨4.15%。"), ("https://finance.eastmoney.com/a/77.html", "only id")] and str(flash[0]["published_at"]) == "2026-08-20 05:38:24"
    assert got["list"][0]["url"] == "https://l.com/1"
    assert [(r["title"], r["url"]) for r in got["live"]] == [("Head", "https://wallstreetcn.com/livenews/9")] and got["live"][0]["published_at"].year == 2026
    assert [(r["title"], r["url"]) for r in got["cls"]] == [("标题", "https://www.cls.cn/telegraph/5")]
    assert [(r["title"], r["url"]) for r in got["netease"]] == [("q", "https://www.163.com/dy/article/D1.html")]
    assert C.articles(landed, 1).count() == len(got)


def test_one_scan_whatever_the_parsers(landed):
    plan = C.articles(landed)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 1 and "Union" not in plan


def test_collection(landed):
    kept, tried = C.collect(landed, max_facts=None)
    outcome = {r["source"]: (r["outcome"], r["error"]) for r in tried.collect()}
    assert {s: e for s, (o, e) in outcome.items() if o == "failed"} == {"bad": "no usable items", "html": "no usable items", "odd": "unknown parser carrier-pigeon", "none": "not fetched", "empty": "no usable items"}
    by_url = {r["source_url"]: r for r in kept.collect()}
    assert by_url["https://z.com/c"]["source"] == "jsonfeed" and by_url["https://z.com/d"]["source"] == "twice"
    roles = {u: (r["evidence_role"], r["observation_scope"], r["content_observed"]) for u, r in by_url.items()}
    assert roles["https://k.com/1"] == ("discovery_lead", "metadata_only", False) and roles["https://z.com/c"] == ("publisher_index", "metadata_only", False) and roles["https://y.com/b"] == ("api_observed_news_item", "content_and_metadata", True)
    assert by_url["http://x.com/a?id=1"]["claim"] == "A news service returned an item of Other: A & B up" and by_url["https://l.com/1"]["fact_id"].startswith("NEWS-2026-08-20-list-")
    g = C.gate(kept, tried).first()
    assert (g["requested_sources"], g["successful_sources"], g["stale_sources"], g["status"], g["primary_sufficient"], g["reasons"]) == (15, 10, 1, "degraded", True, [])


def test_query_and_newest(landed):
    kept, tried = C.collect(landed, "基金, 上涨")
    assert [r["source"] for r in kept.collect()] == ["flash"] and sum(r["matched"] for r in tried.collect()) == 1
    assert not C.gate(kept, tried).first()["primary_sufficient"]
    both, _ = C.collect(landed, "基金 NEW", every=False, max_facts=None)
    assert {r["source"] for r in both.collect()} == {"flash", "twice"}
    top, _ = C.collect(landed, max_facts=3)
    every, _ = C.collect(landed, max_facts=None)
    order = sorted(((r["published_at"], r["fact_id"]) for r in every.collect()), reverse=True)
    assert sorted(((r["published_at"], r["fact_id"]) for r in top.collect()), reverse=True) == order[:3]
