"""Text, URL and markup functions."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The phrases that each category counts.
LEXICONS = {
    "positive": ["增长", "改善", "突破", "上调", "回升", "盈利", "增持", "超预期", "创新高", "利好", "领先", "扩张"],
    "negative": ["下降", "恶化", "下调", "亏损", "减持", "违约", "风险", "暴跌", "低于预期", "收缩", "处罚", "危机"],
    "uncertainty": ["可能", "或许", "预计", "尚未", "不确定", "有待", "传闻", "据称", "无法确认", "存在变数", "取决于"],
    "urgency": ["突发", "紧急", "立即", "警告", "最后期限", "迫在眉睫", "史上首次", "创纪录"],
    "causal": ["因为", "所以", "导致", "意味着", "原因是", "本质上", "反过来", "从而", "取决于", "结果是"],
    "source_language": ["数据显示", "根据", "公告", "报告", "统计", "原文", "官方", "同比", "环比"],
}
# Query parameters that only track (beside those that begin with utm_), and hosts that are read over https.
TRACKING = ("at_campaign", "at_medium", "fbclid", "gclid", "mc_cid", "mc_eid", "ref_src", "spm")
SECURE = ("eastmoney.com", "wallstreetcn.com", "163.com", "netease.com")
NUMBER = r"(?<![A-Za-z0-9_])\d+(?:\.\d+)?%?"
DATE = r"(?:20\d{2}[-年/.])?\d{1,2}[-月/.]\d{1,2}日?"


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def has_han(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"\p{IsHan}"))


def phrase_count(text: Column, phrases: list[str], han: Column | None = None) -> Column:
    """Non-overlapping occurrences of all phrases together. With ``han`` (whether the text has a Han letter) phrases of Han letters are looked for in such texts only."""
    one = lambda p: (F.length(text) - F.length(F.replace(text, F.lit(p), F.lit("")))) / len(p)
    whole = lambda ps: reduce(lambda a, b: a + b, [one(p) for p in ps])
    if han is None:
        return whole(phrases).cast("long")
    far = [p for p in phrases if any("\u3400" <= c <= "\u9fff" for c in p)]
    near = [p for p in phrases if p not in far]
    parts = ([whole(near)] if near else []) + ([F.when(han, whole(far)).otherwise(0.0)] if far else [])
    return reduce(lambda a, b: a + b, parts).cast("long")


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Character references read by the standard's table of over 2,000 names, which Spark has no function for."""
    return text.map(lambda t: html.unescape(t) if "&" in t else t, na_action="ignore")


def html_text(markup: Column, cap: int | None = None) -> Column:
    """Markup's words: character references read, then scripts, styles and tags dropped, blanks collapsed."""
    t = F.regexp_replace(unescape(markup), r"(?is)<script\b[^>]*>.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style\b[^>]*>.*?</style>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = F.trim(F.regexp_replace(t, r"(?U)[\s\x1c-\x1f]+", " "))
    return t if cap is None else F.left(t, F.lit(cap))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, doubled slashes, tracking parameters and fragment dropped, what is left of the query
    written in one way (name=value, form-encoded); null unless http(s) with a host and no user."""
    u = F.regexp_replace(F.regexp_replace(unescape(url), r"(?U)^[\s\x00-\x20]+|\s+$", ""), r"[\t\r\n]", "")
    head = r"(?i)^(https?)://([^/?#]*)"
    scheme, net = F.lower(F.regexp_extract(u, head, 1)), F.lower(F.regexp_extract(u, head, 2))
    host, port = F.regexp_extract(net, r"^(\[[^\]]*\]|[^:]*)", 1), F.regexp_extract(net, r":(\d*)$", 1).try_cast("int")
    secure = reduce(lambda a, b: a | b, [F.endswith(host, F.lit(h)) for h in SECURE])
    rest = F.regexp_replace(F.regexp_replace(u, head, ""), r"(?s)#.*$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), "/{2,}", "/")
    pairs = F.filter(F.split(F.regexp_extract(rest, r"(?s)\?(.*)$", 1), "&"), lambda x: F.length(x) > 0)
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)
    coded = lambda x: F.replace(F.replace(F.url_encode(plain(x)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    name = lambda x: F.lower(plain(F.substring_index(x, "=", 1)))
    kept = F.filter(pairs, lambda x: ~F.startswith(name(x), F.lit("utm_")) & ~name(x).isin(*TRACKING))
    kept = F.transform(kept, lambda x: F.concat(coded(F.substring_index(x, "=", 1)), F.lit("="), coded(F.regexp_extract(x, r"(?s)^[^=]*=(.*)$", 1))))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    good = (host != "") & ~F.contains(net, F.lit("@")) & (F.coalesce(port, F.lit(0)) <= 65535) & F.regexp_like(net, F.lit(r"^(\[[^\]]*\]|[^:]*)(:\d*)?$"))
    where = F.concat(F.when(secure, "https").otherwise(scheme), F.lit("://"), host, F.when(F.coalesce(port, F.lit(0)) > 0, F.concat(F.lit(":"), port.cast("string"))).otherwise(""))
    return F.when(good, F.concat(where, F.when(path == "", "/").otherwise(path), tail))


def slug(text: Column, default: str = "item") -> Column:
    s = F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(default)).otherwise(s)


def identifier(text: Column, default: str = "item") -> Column:
    """A name that is safe in paths: other signs than letters, digits, point, underline and dash become one dash."""
    s = F.trim(F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._-]+", "-"), F.lit("-"))
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(default)).otherwise(s)


def redact(url: Column) -> Column:
    """The address with the values of secret parameters and the user blanked."""
    u = F.regexp_replace(url, r"(?i)([?&](?:api_?key|token|secret|password|access_token|key|signature|sig)=)[^&#]*", "$1REDACTED")
    return F.regexp_replace(u, r"(?i)^([a-z][a-z0-9+.-]*://)[^/@\s]+@", "$1***@")


def timestamp(text: Column, fallback: Column | None = None, zone: str | Column = "UTC") -> Column:
    """Seconds or milliseconds since 1970, RFC 2822, or ISO forms; times without a zone are of ``zone``. Null, or ``fallback``, where none fits."""
    t = F.trim(text)
    digits = F.regexp_like(t, F.lit(r"^\d{10,13}$"))
    epoch = F.when(F.length(t) >= 13, t.try_cast("double") / 1000).otherwise(t.try_cast("double"))
    plain = F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3},\s*", ""), r"\s(GMT|UTC|Z)$", " +0000")
    zoned = [("d MMM yyyy HH:mm:ss Z", plain), ("yyyy-MM-dd'T'HH:mm:ssXXX", t), ("yyyyMMdd'T'HHmmss'Z'", t)]
    local = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyyMMdd", "yyyy-MM-dd"]
    there = lambda x: x if isinstance(zone, str) and zone.upper() == "UTC" else F.to_utc_timestamp(x, zone)
    got = [F.when(digits, F.timestamp_seconds(epoch))] + [F.when(~digits, F.try_to_timestamp(x, F.lit(f))) for f, x in zoned] + [F.when(~digits, there(F.try_to_timestamp(t, F.lit(f)))) for f in local] + [F.when(~digits, F.try_to_timestamp(t))]
    return F.coalesce(*got, *([fallback] if fallback is not None else []))


def iso_date(text: Column) -> Column:
    """The date a text is, or the first yyyy-mm-dd in it."""
    return F.coalesce(F.try_to_date(F.trim(text)), F.try_to_date(F.nullif(F.regexp_extract(text, r"\d{4}-\d{2}-\d{2}", 0), F.lit(""))))


def query_words(query: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(query)), r"(?U)[\s,，;；|/]+"), lambda x: F.length(x) > 0))


def matches_words(haystack: Column, words: Column, every: bool = False) -> Column:
    """ANY (or ALL) of the words stand in the text; no words match everything."""
    test = F.forall if every else F.exists
    return (F.size(words) == 0) | test(words, lambda w: F.contains(F.lower(haystack), w))
