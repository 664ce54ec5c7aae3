"""Queries over landed payloads: bodies are written from the tables as their publishers would, landed as bytes, and read back."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import collection, landing, panels, snapshots
from .cuts import shared_dir

RETRIEVED = "2024-03-01 00:00:00"


def news(spark, d):
    """A source for each page, of eight kinds of payload in turn, with a shared item, one without a title and one of its own; some land nothing, nothing known or nothing to read."""
    k = "page_id"
    title, when = f"concat('Item <b>', {k}, '</b> &amp; co')", f"concat('2024-01-', lpad({k} % 28 + 1, 2, '0'))"
    shared, own = f"concat('http://x.org//p', {k} % 100, '?utm_source=a&id=1#f')", f"concat('https://y.org/q', {k})"

    def items(name_title, name_url, name_summary, name_time, form, ident=None):
        one = f"'{name_title}', {title}, '{name_url}', {shared}, '{name_summary}', concat('sum ', {k}), '{name_time}', {form}"
        other = f"'{name_title}', concat('Other ', {k}), '{name_url}', {own}, '{name_summary}', CAST(NULL AS STRING), '{name_time}', CAST(NULL AS STRING)"
        empty = f"'{name_title}', ' ', '{name_url}', 'https://z.org/', '{name_summary}', CAST(NULL AS STRING), '{name_time}', CAST(NULL AS STRING)"
        if ident:
            one, other, empty = one + f", 'id', CAST({k} % 100 AS STRING)", other + f", 'id', concat('q', {k})", empty + ", 'id', CAST(NULL AS STRING)"
        return f"array(named_struct({one}), named_struct({empty}), named_struct({other}))"

    plain, iso = f"concat({when}, ' 10:00:00')", f"concat({when}, 'T10:00:00Z')"
    xml = lambda tag, link, extra: f"concat('<{tag}><title>', {{t}}, '</title>', {link}, {extra}, '</{tag}>')"
    rss_link, rss_more = "'<link>', replace({u}, '&', '&amp;'), '</link>'", f"'<description>', {{s}}, '</description><pubDate>', {k} % 28 + 1, ' Jan 2024 10:00:00 GMT</pubDate>'"
    atom_link, atom_more = "'<link href=\"', replace({u}, '&', '&amp;'), '\"/>'", f"'<summary>', {{s}}, '</summary><updated>', {iso}, '</updated>'"
    coded = f"concat('Item &lt;b&gt;', {k}, '&lt;/b&gt; &amp;amp; co')"
    entry = lambda tag, link, more: xml(tag, link, more).format(t=coded, u=shared, s=f"concat('sum ', {k})")
    bare = lambda tag, link: xml(tag, link, "''").format(t=f"concat('Other ', {k})", u=own)
    texts = [
        f"to_json(named_struct('items', {items('title', 'url', 'content_text', 'date_published', iso)}))",
        f"concat('<rss><channel>', {entry('item', rss_link, rss_more)}, '<item><title> </title></item>', {bare('item', rss_link)}, '</channel></rss>')",
        f"concat('<feed>', {entry('entry', atom_link, atom_more)}, '<entry><title> </title></entry>', {bare('entry', atom_link)}, '</feed>')",
        f"concat('var ajaxResult=', to_json(named_struct('LivesList', {items('title', 'url_w', 'digest', 'showtime', plain)})), ';')",
        f"to_json(named_struct('code', if({k} % 3 = 0, '0', '1'), 'data', named_struct('list', {items('title', 'url', 'summary', 'showTime', plain)})))",
        f"to_json(named_struct('data', named_struct('items', {items('title', 'uri', 'content_text', 'display_time', plain)})))",
        f"to_json(named_struct('data', named_struct('roll_data', {items('brief', 'shareurl', 'content', 'ctime', plain, 'id')})))",
        f"concat('cb(', to_json(named_struct('x', 1, 'T1', {items('title', 'url', 'digest', 'ptime', plain)})), ')')",
    ]
    names = ("feed", "feed", "feed", "flash", "news_list", "live", "telegraph", "first_list")
    body = f"CASE WHEN {k} % 19 = 0 THEN NULL WHEN {k} % 29 = 0 THEN '<html>' ELSE CASE {k} % 8 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts)) + " END END"
    parser = f"CASE WHEN {k} % 23 = 0 THEN 'unheard' WHEN {k} % 40 = 0 THEN 'index_feed' ELSE CASE {k} % 8 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END END"
    p = panels.table(spark, d, "pages").select(k)
    return p.select(
        F.concat(F.lit("src"), k).alias("source"), F.col(k).alias("ordinal"), F.concat(F.lit("Pub "), (F.col(k) % 7).cast("string")).alias("publisher"), F.expr(parser).alias("parser"), F.lit("UTC").alias("timezone"), F.encode(F.expr(body), "UTF-8").alias("body"),
        F.lit(RETRIEVED).cast("timestamp").alias("retrieved_at"), F.when(F.col(k) % 3 == 0, "stale").when(F.col(k) % 3 == 1, "cached").otherwise("fresh").alias("retrieval"),
    )


def _shown(kept):
    return kept.select("fact_id", "claim", "period", "publisher", "source_url", "title", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"), "excerpt", "evidence_role", "observation_scope", "content_observed", "source")


def news_collection(spark, d):
    return _shown(collection.collect(news(spark, d), max_facts=None)[0])


def news_newest(spark, d):
    """The newest 200 facts of items that hold both words of a query."""
    return _shown(collection.collect(news(spark, d), "ITEM, 1")[0])


def news_attempts(spark, d):
    return collection.collect(news(spark, d), "ITEM, 1")[1]


@F.pandas_udf(T.BinaryType())
def _gbk(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t.encode("gbk")).astype(object)


def market(spark, d):
    """(market, endpoint, body): the orders of a customer are a market's pools."""
    o = panels.table(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("st"))
    listed = lambda keep, item: F.to_json(F.struct(F.struct(F.array_sort(F.collect_list(F.when(keep, item))).alias("pool")).alias("data")))
    one = lambda name, value: F.struct(value.alias(name))
    height, change = F.when(F.col("k") % 7 == 0, "-").otherwise((F.col("k") % 6).cast("string")), F.when(F.col("k") % 11 == 0, "-").otherwise((F.col("k") % 25 - 5).cast("string"))
    side = F.struct(F.count_if(F.col("k") % 2 == 0).alias("f104"), F.count_if(F.col("k") % 2 == 1).alias("f105"), F.lit("").alias("f106"))
    other = F.struct(F.count_if(F.col("k") % 3 == 0).alias("f104"), F.count_if(F.col("k") % 3 == 1).alias("f105"), F.count_if(F.col("k") % 10 == 0).cast("string").alias("f106"))
    quote = lambda name, code, text: F.concat(F.lit(f'v_{code}="1~{name}~{code}~' + "0~" * 29), text, F.lit('~0";'))
    index = F.concat(quote("上证指数", "000001", ((F.sum("k") % 9 - 4) / 2).cast("string")), quote("深证成指", "399001", F.when(F.sum("k") % 5 == 0, "n/a").otherwise(((F.sum("k") % 7 - 3) / 2).cast("string"))))
    g = o.groupBy("c").agg(
        F.to_json(F.struct(F.struct(F.array(side, other).alias("diff")).alias("data"))).alias("breadth"), listed(F.col("st") == "F", one("lbc", height)).alias("limit_up"), listed(F.col("st") == "P", one("lbc", height)).alias("broken_limit"),
        listed((F.col("st") == "O") & (F.col("k") % 5 == 0), one("lbc", height)).alias("limit_down"), listed(F.lit(True), one("zdp", change)).alias("yesterday_limit"), index.alias("index"),
    )
    fault = {"breadth": F.when(F.col("c") % 13 != 0, F.col("breadth")), "limit_up": F.when(F.col("c") % 17 == 0, "oops").otherwise(F.col("limit_up")), "index": F.when(F.col("c") % 19 != 0, F.col("index"))}
    bodies = F.array(*[F.struct(F.lit(e).alias("endpoint"), fault.get(e, F.col(e)).alias("text")) for e in snapshots.ENDPOINTS])
    rows = g.select(F.col("c").alias("market"), F.explode(bodies).alias("b")).select("market", "b.*")
    return rows.select("market", "endpoint", F.when(F.col("endpoint") == "index", _gbk("text")).otherwise(F.encode("text", "UTF-8")).alias("body"))


def landed_market_snapshot(spark, d):
    s = snapshots.market_snapshots(market(spark, d), "market")
    ladder = F.array_join(F.transform(F.map_entries("ladder"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",")
    return s.withColumns({"ladder": ladder, "indices": F.array_join(F.transform("indices", lambda i: F.concat(i["name"], F.lit("="), i["code"])), ","), "warnings": F.array_join("warnings", ";")})


def _fetches(spark, d):
    """Every page is fetched up to four times and landed as lines, some of them broken; the folder is read back as a data source."""
    p = panels.table(spark, d, "pages").select(F.col("page_id").alias("k"), F.concat(F.lit("site"), (F.col("page_id") % 20).cast("string")).alias("source"), F.concat(F.lit("https://h.org/"), F.col("page_id")).alias("url"))
    x = p.withColumn("attempt", F.explode(F.expr("sequence(1, 1 + k % 4)"))).withColumn("r", (F.col("k") + F.col("attempt")) % 5)
    status = F.when(F.col("r").isin(0, 4), 200).when(F.col("r") == 1, 503).when(F.col("r") == 2, 404).when(F.col("r") == 3, 429)
    path = f"{shared_dir(spark)}/fetches-{uuid.uuid4().hex}"
    landing.land(x.select("source", "url", "attempt", status.alias("http_status"), F.when(F.col("r") == 4, "").otherwise("body").alias("body"), F.concat(F.lit("2024-01-0"), F.col("attempt"), F.lit("T00:00:00Z")).alias("retrieved_at")), path)
    p.where("k % 37 = 0").select("source", F.concat(F.lit("{broken "), "k").alias("value")).write.mode("append").partitionBy("source").text(path)
    return p, landing.read(spark, path)


def fetch_histories(spark, d):
    return landing.histories(_fetches(spark, d)[1])


def fetch_coverage(spark, d):
    p, landed = _fetches(spark, d)
    asked = p.select("source", "url").unionByName(p.where("k % 10 = 0").select("source", F.concat("url", F.lit("/never")).alias("url")))
    return landing.coverage(landed, asked).withColumn("as_of", F.date_format("as_of", "yyyy-MM-dd"))


_NEWS = """WITH p AS (SELECT page_id AS k, page_id % 8 AS kind, page_id % 40 = 0 AND page_id % 23 <> 0 AS lead, page_id % 19 = 0 AS none, page_id % 23 = 0 AS unheard,
  page_id % 29 = 0 OR (page_id % 8 = 4 AND page_id % 3 = 0) AS dry FROM pages),
i0 AS (SELECT *, 0 AS place, 'Item ' || k || ' & co' AS title, CASE WHEN kind = 6 THEN 'https://www.cls.cn/telegraph/' || (k % 100) ELSE 'http://x.org/p' || (k % 100) || '?id=1' END AS url, 'sum ' || k AS excerpt, '2024-01-' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0') AS period, '10:00:00' AS t FROM p
  UNION ALL SELECT *, 2, 'Other ' || k, CASE WHEN kind = 6 THEN 'https://www.cls.cn/telegraph/q' || k ELSE 'https://y.org/q' || k END, CASE WHEN kind IN (3, 6, 7) THEN 'Other ' || k ELSE '' END, '2024-03-01', '00:00:00' FROM p),
i AS (SELECT *, 'Pub ' || (k % 7) AS publisher, 'src' || k AS source FROM i0 WHERE NOT none AND NOT unheard AND NOT dry)"""
_FACTS = """, m AS (SELECT * FROM i WHERE {match}),
f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY url ORDER BY k, place) = 1),
x AS (SELECT 'NEWS-' || period || '-' || source || '-' || substr(sha256(url), 1, 12) AS fact_id, CASE WHEN lead THEN 'A news index lists an item of ' WHEN excerpt <> '' THEN 'A news service returned an item of ' ELSE 'A news service listed an item of ' END || publisher || ': ' || title AS claim, period, publisher,
  url AS source_url, title, period || ' ' || t AS published_at, excerpt, CASE WHEN lead THEN 'discovery_lead' WHEN excerpt <> '' THEN 'api_observed_news_item' ELSE 'publisher_index' END AS evidence_role, CASE WHEN lead OR excerpt = '' THEN 'metadata_only' ELSE 'content_and_metadata' END AS observation_scope,
  NOT lead AND excerpt <> '' AS content_observed, source FROM f) SELECT * FROM x"""
_WORDS = "contains(lower(title || ' ' || excerpt || ' ' || publisher), 'item') AND contains(title || ' ' || excerpt || ' ' || publisher, '1')"
_MARKET = """WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus AS st, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 6 END AS h, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 25 - 5)::DOUBLE END AS z FROM orders),
l AS (SELECT c, string_agg(h || ':' || n, ',' ORDER BY h) AS ladder FROM (SELECT c, h, count(*) AS n FROM o WHERE st = 'F' AND h > 0 GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT c, c % 13 <> 0 AS b, c % 17 <> 0 AS u, c % 19 <> 0 AS q, count(*) FILTER (k % 2 = 0) + count(*) FILTER (k % 3 = 0) AS a, count(*) FILTER (k % 2 = 1) + count(*) FILTER (k % 3 = 1) AS d, count(*) FILTER (k % 10 = 0) AS f,
  count(*) FILTER (st = 'F') AS up, count(*) FILTER (st = 'P') AS br, count(*) FILTER (st = 'O' AND k % 5 = 0) AS dn, max(h) FILTER (st = 'F') AS mh, count(z) AS n, count(*) FILTER (z >= 9.8) AS g, sum(z) AS s, CAST(sum(k) AS BIGINT) AS k FROM o GROUP BY 1)
SELECT g.c AS market, CASE WHEN b THEN a END AS advance_count, CASE WHEN b THEN d END AS decline_count, CASE WHEN b THEN f END AS flat_count, CASE WHEN u THEN up END AS limit_up_count, br AS broken_limit_count, dn AS limit_down_count,
  CASE WHEN br + CASE WHEN u THEN up ELSE 0 END > 0 THEN round(100.0::DOUBLE * br / (br + CASE WHEN u THEN up ELSE 0 END), 3) END AS break_rate_pct, CASE WHEN u THEN CAST(mh AS BIGINT) END AS max_limit_height, CASE WHEN u THEN coalesce(ladder, '') ELSE '' END AS ladder,
  CASE WHEN n > 0 THEN n END AS yesterday_limit_count, CASE WHEN n > 0 THEN g END AS continuation_count, CASE WHEN n > 0 THEN round(100.0::DOUBLE * g / n, 3) END AS continuation_rate_pct, CASE WHEN n > 0 THEN round(s / n, 3) END AS yesterday_pool_mean_return_pct,
  CASE WHEN q THEN '上证指数=000001' || CASE WHEN k % 5 = 0 THEN '' ELSE ',深证成指=399001' END ELSE '' END AS indices, CASE WHEN q THEN CASE WHEN k % 5 = 0 THEN (k % 9 - 4) / 2.0::DOUBLE ELSE ((k % 9 - 4) / 2.0::DOUBLE + (k % 7 - 3) / 2.0::DOUBLE) / 2 END END AS index_return,
  concat_ws(';', CASE WHEN NOT b THEN 'breadth unavailable' END, CASE WHEN NOT u THEN 'limit_up pool unavailable' END, CASE WHEN NOT q THEN 'index momentum unavailable' END) AS warnings FROM g LEFT JOIN l ON l.c = g.c"""

_FETCH = """WITH p AS (SELECT page_id AS k, 'site' || (page_id % 20) AS source, 'https://h.org/' || page_id AS url FROM pages),
x AS (SELECT *, (k + attempt) % 5 AS r FROM (SELECT *, unnest(range(1, 2 + k % 4)) AS attempt FROM p)),
h AS (SELECT source, url, count(*) AS attempts, count(*) FILTER (r <> 0 AND r <> 2) AS transient, round(coalesce(sum(0.6::DOUBLE * pow(2, attempt - 1)) FILTER (r <> 0 AND r <> 2 AND attempt < 3), 0), 3) AS waited_seconds, CAST(arg_max(CASE WHEN r IN (0, 4) THEN 200 WHEN r = 1 THEN 503 WHEN r = 2 THEN 404 ELSE 429 END, attempt) AS INT) AS http_status,
  CASE WHEN arg_max(r, attempt) = 0 THEN 'success' WHEN arg_max(r, attempt) <> 2 AND max(attempt) < 3 THEN 'pending' ELSE 'failed' END AS outcome FROM x GROUP BY 1, 2)"""

QUERIES = {
    "news_collection": (news_collection, _NEWS + _FACTS.format(match="true")),
    "news_newest": (news_newest, _NEWS + _FACTS.format(match=_WORDS) + " ORDER BY published_at DESC, fact_id DESC LIMIT 200"),
    "news_attempts": (news_attempts, _NEWS + f""", n AS (SELECT k, count(*) AS items, count(*) FILTER ({_WORDS}) AS matched FROM i GROUP BY 1)
SELECT 'src' || p.k AS source, p.k AS ordinal, CASE WHEN items > 0 THEN 'success' ELSE 'failed' END AS outcome, CASE WHEN p.k % 3 = 0 THEN 'stale' WHEN p.k % 3 = 1 THEN 'cached' ELSE 'fresh' END AS retrieval, coalesce(items, 0) AS item_count, coalesce(matched, 0) AS matched,
  CASE WHEN p.none THEN 'not fetched' WHEN unheard THEN 'unknown parser unheard' WHEN items IS NULL THEN 'no usable items' END AS error FROM p LEFT JOIN n ON n.k = p.k"""),
    "fetch_histories": (fetch_histories, _FETCH + " SELECT source, url, attempts, transient, waited_seconds, http_status, outcome FROM h"),
    "fetch_coverage": (fetch_coverage, _FETCH + """, a AS (SELECT source, count(*) AS asked, count(outcome) AS landed, count(*) FILTER (outcome = 'success') AS succeeded, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'pending') AS pending
  FROM (SELECT source, outcome FROM h UNION ALL SELECT source, NULL FROM p WHERE k % 10 = 0) GROUP BY 1), m AS (SELECT source, count(*) FILTER (k % 37 = 0) AS malformed FROM p GROUP BY 1), t AS (SELECT source, max(attempt) FILTER (r IN (0, 4)) AS last FROM x GROUP BY 1)
SELECT a.source, asked, landed, succeeded, failed, pending, malformed, round(succeeded / asked::DOUBLE, 4) AS coverage, '2024-01-0' || last AS as_of FROM a JOIN m ON m.source = a.source JOIN t ON t.source = a.source"""),
    "landed_market_snapshot": (landed_market_snapshot, _MARKET),
}
