"""News collection: landed payloads of many sources read in one scan, matched, deduplicated and gated.

What a parser reads is a table of paths. A payload is parsed once, JSON as VARIANT and feeds as XML, and
one expression gives its items as an array whatever its parser, so there is no branch and no scan a source.
An unknown parser, a body that is none, and a payload without usable items are failed outcomes with a reason.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .parsers import body_text

ITEM = "struct<title:string,url:string,summary:string,published:string,publisher:string>"


@dataclass(frozen=True)
class Paths:
    """Where a JSON payload holds its items and their fields; of several fields the first that is not empty counts.

    ``page`` makes an address of an item's id where it has none. Without a title the part in brackets at the head of the summary is
    the title, else its first 120 characters, where ``headless`` is set.
    """

    items: str
    title: tuple[str, ...]
    url: tuple[str, ...] = ()
    summary: tuple[str, ...] = ()
    published: tuple[str, ...] = ()
    ident: tuple[str, ...] = ()
    page: str | None = None
    headless: bool = False
    summary_is_title: bool = False


# The fields of the public payloads.
JSON_FEED = Paths("$.items", ("title",), ("url", "external_url", "id"), ("content_text", "summary", "content_html"), ("date_published", "date_modified"))
PARSERS = {
    "flash": Paths("$.LivesList", ("title",), ("url_unique", "url_w", "url_m"), ("digest", "simdigest"), ("showtime", "ordertime"), ("newsid", "id"), "https://finance.eastmoney.com/a/{}.html", summary_is_title=True),
    "news_list": Paths("$.data.list", ("title",), ("url", "articleUrl", "code_url"), ("summary", "digest"), ("showTime", "publishTime", "showtime")),
    "live": Paths("$.data.items", ("title",), ("uri",), ("content_text", "content"), ("display_time", "created_at"), ("id",), "https://wallstreetcn.com/livenews/{}", headless=True),
    "telegraph": Paths("$.data.roll_data", ("brief",), (), ("content", "brief"), ("ctime",), ("id",), "https://www.cls.cn/telegraph/{}", headless=True),
    "first_list": Paths("$.list", ("title",), ("url_3w", "url", "docurl"), ("digest", "description"), ("ptime",), ("docid", "postid"), "https://www.163.com/dy/article/{}.html", summary_is_title=True),
}
#: Parsers of feeds in XML or JSON; items of an index of other publishers are leads, whatever they hold.
FEEDS = ("feed", "index_feed")

_RSS = "struct<channel:struct<item:array<struct<title:string,link:string,guid:string,pubDate:string,description:string,source:struct<_VALUE:string,_url:string>>>>>"
_ATOM = "struct<entry:array<struct<title:string,link:array<struct<_href:string,_rel:string>>,published:string,updated:string,summary:string,content:string>>>"


def _field(item: Column, names: tuple[str, ...]) -> Column:
    """The first of the fields that is neither missing nor empty nor zero, as text."""
    found = [F.try_variant_get(item, f"$.{n}", "string") for n in names]
    return F.coalesce(*[F.when(~f.isin("", "0", "false"), f) for f in found], F.lit(None).cast("string")) if found else F.lit(None).cast("string")


def _items(listed: Column, p: Paths) -> Column:
    """Items of a list of variants; elements that are no objects have no fields and go later for want of a title."""

    def one(x: Column) -> Column:
        summary = _field(x, p.summary)
        title = _field(x, p.title)
        if p.headless:
            bracket = F.nullif(F.regexp_extract(F.ltrim(summary), "^【([^】]+)】", 1), F.lit(""))
            title = F.coalesce(F.nullif(F.trim(title), F.lit("")), bracket, F.left(summary, F.lit(120)))
        ident = F.nullif(F.trim(_field(x, p.ident)), F.lit(""))
        page = F.replace(F.lit(p.page), F.lit("{}"), ident) if p.page else F.lit(None).cast("string")
        return F.struct(
            title.alias("title"), F.coalesce(_field(x, p.url), page).alias("url"), (F.coalesce(summary, title) if p.summary_is_title else summary).alias("summary"), _field(x, p.published).alias("published"), F.lit(None).cast("string").alias("publisher")
        )

    return F.transform(listed, one).cast(f"array<{ITEM}>")


def _list(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def items_of(parser: Column, body: Column) -> Column:
    """The items of a payload by its parser, null where there is no such parser or the payload is not what it reads."""
    # the object inside a script assignment or callback, or the whole text
    inner = F.when(parser.isin("flash", "first_list"), F.regexp_extract(body, r"(?s)(\{.*\})", 1)).otherwise(body)
    v = F.try_parse_json(inner)
    result = None
    for name, p in PARSERS.items():
        listed = _list(v, p.items)
        if name == "first_list":
            # without ``list`` the first key, in the order of the text, that holds a list
            keys = F.from_json(inner, "map<string,string>")
            first = F.get(F.filter(F.map_values(keys), lambda x: F.regexp_like(x, F.lit(r"^\s*\["))), F.lit(0))
            listed = F.coalesce(listed, _list(F.try_parse_json(first), "$"))
        if name == "news_list":
            listed = F.when(F.try_variant_get(v, "$.code", "string") == "1", listed)
        result = F.when(parser == name, _items(listed, p)) if result is None else result.when(parser == name, _items(listed, p))
    plain = lambda c: F.nullif(F.trim(c), F.lit(""))
    # text of another kind is put away first, as the XML reader refuses it
    rss = F.from_xml(F.when(F.contains(body, F.lit("<rss")), body), _RSS)["channel"]["item"]
    atom = F.from_xml(F.when(~F.contains(body, F.lit("<rss")) & F.contains(body, F.lit("<feed")), body), _ATOM)["entry"]
    links = lambda i: F.filter(i["link"], lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate")  # noqa: E731, E741
    of_rss = F.transform(rss, lambda i: F.struct(i["title"], F.coalesce(plain(i["link"]), plain(i["guid"])), i["description"], i["pubDate"], i["source"]["_VALUE"]))
    of_atom = F.transform(atom, lambda i: F.struct(i["title"], F.coalesce(F.get(links(i), F.lit(0))["_href"], F.get(i["link"], F.lit(0))["_href"]), F.coalesce(i["summary"], i["content"]), F.coalesce(i["published"], i["updated"]), F.lit(None).cast("string")))
    kind = f"array<{ITEM}>"
    feed = F.when(F.regexp_like(body, F.lit(r"^\s*\{")), _items(_list(v, JSON_FEED.items), JSON_FEED)).otherwise(F.coalesce(of_rss.cast(kind), of_atom.cast(kind)))
    return result.when(parser.isin(*FEEDS), feed)


def articles(landed: DataFrame, limit: int = 50) -> DataFrame:
    """(source, ordinal, parser, publisher, place, title, url, summary, published_at, retrieved_at): the usable items of each source's payload, the first ``limit``.

    ``landed`` has one payload a source: source, ordinal (its place in the plan), publisher, parser, timezone, body (binary), retrieved_at and retrieval (fresh, cached, stale). Items
    without a title or an address of http(s) are not usable. Times that cannot be read are the payload's own.
    """
    x = landed.select("source", "ordinal", "publisher", "parser", "timezone", "retrieved_at", F.posexplode(items_of(F.col("parser"), body_text(F.col("body")))).alias("place", "i"))
    own = F.nullif(text.html_text(F.col("i.publisher"), 200), F.lit(""))
    x = x.select(
        "source", "ordinal", "parser", F.coalesce(own, "publisher").alias("publisher"), "place", text.html_text(F.col("i.title"), 500).alias("title"), text.canonical_url(F.col("i.url")).alias("url"), F.coalesce(text.html_text(F.col("i.summary"), 4000), F.lit("")).alias("summary"),
        text.timestamp(F.col("i.published"), F.col("retrieved_at"), F.coalesce("timezone", F.lit("UTC"))).alias("published_at"), "retrieved_at",
    ).where("coalesce(title, '') <> '' AND coalesce(url, '') <> ''")
    near = Window.partitionBy("source").orderBy("place")
    return x.withColumn("k", F.row_number().over(near)).where(F.col("k") <= limit).drop("k")


def attempts(landed: DataFrame, found: DataFrame, matched: DataFrame) -> DataFrame:
    """(source, ordinal, outcome, retrieval, item_count, matched, error) of every source in the plan."""
    count = lambda df, name: df.groupBy("source").agg(F.count("*").alias(name))
    j = landed.select("source", "ordinal", "parser", "retrieval", F.col("body").isNotNull().alias("landed")).join(count(found, "item_count"), "source", "left").join(count(matched, "matched"), "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    known = F.coalesce(F.col("parser").isin(*PARSERS, *FEEDS), F.lit(False))
    error = F.when(~F.col("landed"), "not fetched").when(~known, F.concat(F.lit("unknown parser "), F.coalesce("parser", F.lit("(none)")))).when(F.coalesce("item_count", F.lit(0)) < 1, "no usable items")
    return j.select("source", "ordinal", F.when(error.isNull(), "success").otherwise("failed").alias("outcome"), "retrieval", zero("item_count"), zero("matched"), error.alias("error"))


def facts(found: DataFrame, prefix: str = "NEWS") -> DataFrame:
    """Items as facts with the claim that their observation allows: an index leads, a listed title points, an item with text was observed."""
    lead, observed = F.col("parser") == "index_feed", F.col("summary") != ""
    verb = F.when(lead, "A news index lists an item of ").when(observed, "A news service returned an item of ").otherwise("A news service listed an item of ")
    period = F.date_format("published_at", "yyyy-MM-dd")
    return found.select(
        F.concat_ws("-", F.lit(prefix), period, text.identifier(F.col("source")), F.left(F.sha2("url", 256), F.lit(12))).alias("fact_id"), F.concat(verb, "publisher", F.lit(": "), "title").alias("claim"), period.alias("period"), "publisher", F.col("url").alias("source_url"),
        "title", "published_at", "retrieved_at", F.col("summary").alias("excerpt"), F.when(lead, "discovery_lead").when(observed, "api_observed_news_item").otherwise("publisher_index").alias("evidence_role"),
        F.when(lead | ~observed, "metadata_only").otherwise("content_and_metadata").alias("observation_scope"), (~lead & observed).alias("content_observed"), "source", "ordinal", "place",
    )


def collect(landed: DataFrame, query: str = "", every: bool = True, limit: int = 50, max_facts: int | None = 200) -> tuple[DataFrame, DataFrame]:
    """(facts, attempts) of a collection.

    Items that match the query's words (all of them, or any) in title, summary and publisher become facts; of an address
    the first one counts, by the source's place in the plan, then by its own order. The newest ``max_facts`` are kept (None: all), ties by id.
    """
    found = articles(landed, limit)
    hay = F.concat_ws(" ", "title", "summary", "publisher")
    matched = found.where(text.matches_words(hay, text.query_words(F.lit(query)), every))
    every_fact = facts(matched)
    first = every_fact.groupBy("source_url").agg(F.min_by(F.struct(*[c for c in every_fact.columns if c != "source_url"]), F.struct("ordinal", "source", "place")).alias("f")).select("source_url", "f.*")
    kept = first if max_facts is None else first.orderBy(F.desc("published_at"), F.desc("fact_id")).limit(max_facts)
    return kept, attempts(landed, found, matched)


def gate(kept: DataFrame, tried: DataFrame, min_sources: int = 3, min_facts: int = 3) -> DataFrame:
    """One row: whether the sources suffice, with status and reasons. Counts only; both sides are summed before they meet."""
    ok = F.col("outcome") == "success"
    n = kept.agg(F.count("*").alias("relevant_fact_count"))
    g = tried.agg(
        F.count("*").alias("requested_sources"), F.count_if(ok).alias("successful_sources"), F.count_if(~ok).alias("failed_sources"), F.count_if(ok & (F.col("retrieval") == "stale")).alias("stale_sources"), F.count_if(ok & (F.col("retrieval") == "cached")).alias("cached_sources"),
        F.coalesce(F.sum("item_count"), F.lit(0)).alias("raw_item_count"),
    ).crossJoin(F.broadcast(n))
    few = F.col("successful_sources") < F.least(F.lit(max(1, min_sources)), F.col("requested_sources"))
    bare = F.col("relevant_fact_count") < max(1, min_facts)
    good = F.col("successful_sources")
    status = F.when(good == 0, "failed").when((F.col("failed_sources") > 0) | (F.col("stale_sources") > 0), "degraded").when(F.col("cached_sources") == good, "cached").otherwise("fresh")
    reasons = F.array_compact(F.array(F.when(few, "too few sources succeeded"), F.when(bare, "too few relevant items")))
    return g.withColumns({"primary_sufficient": ~few & ~bare, "status": status, "reasons": reasons})
