"""Market snapshots from landed payloads: breadth, limit pools and index quotes of a day in one row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import rnd
from .parsers import body_text

#: Endpoints of a day: breadth by exchange, four pools, index quotes (positional, in GBK).
POOLS = ("limit_up", "broken_limit", "limit_down", "yesterday_limit")
ENDPOINTS = ("breadth", *POOLS, "index")
#: From this return on, in percent, a stock of yesterday's pool counts as going on.
CONTINUES = 9.8
_INDEX = "array<struct<name:string,code:string,change_pct:double>>"


@F.pandas_udf(T.StringType())
def gbk_text(body: pd.Series) -> pd.Series:
    """Landed bytes in GBK as text, odd bytes replaced; the engine's own decoder knows no such charset."""
    return body.map(lambda b: None if b is None else bytes(b).decode("gbk", errors="replace")).astype(object)


def _objects(text: Column) -> Column:
    """The objects under a key, whether they stand in a list or under keys of their own, as JSON texts."""
    listed = F.when(F.startswith(text, F.lit("[")), F.from_json(text, "array<string>")).when(F.startswith(text, F.lit("{")), F.map_values(F.from_json(text, "map<string,string>")))
    return F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.coalesce(F.startswith(x, F.lit("{")), F.lit(False)))


def _whole(item: Column, name: str) -> Column:
    """A whole number under a key, 0 where it is missing or empty, null where it is none."""
    text = F.coalesce(F.nullif(F.get_json_object(item, f"$.{name}"), F.lit("")), F.lit("0"))
    return F.coalesce(text.try_cast("bigint"), F.when(F.regexp_like(text, F.lit(r"^-?\d+\.\d*$")), text.try_cast("double").cast("bigint")))


def _quotes(text: Column) -> Column:
    """(name, code, change_pct) of quotes that stand as ``v="..~..";``, the change at place 32."""
    fields = F.transform(F.filter(F.split(text, ";"), lambda line: F.contains(line, F.lit('="'))), lambda line: F.split(F.get(F.split(line, '"'), F.lit(1)), "~"))
    known = F.filter(fields, lambda v: (F.size(v) > 32) & F.get(v, F.lit(32)).try_cast("double").isNotNull())
    return F.transform(known, lambda v: F.struct(F.get(v, F.lit(1)).alias("name"), F.get(v, F.lit(2)).alias("code"), F.get(v, F.lit(32)).try_cast("double").alias("change_pct"))).cast(_INDEX)


def market_snapshots(landed: DataFrame, by: str = "date") -> DataFrame:
    """A snapshot of each day from (date, endpoint, body): one scan, every body parsed where it stands, one row a day after one shuffle.

    Counts of a pool whose body is missing or no JSON object are null and named in ``warnings``; an empty pool counts 0. Of several bodies of a day
    and endpoint the greatest by its text is taken. Other endpoints are passed over; a day without any of these has no row.
    """
    known = landed.where(F.col("endpoint").isin(*ENDPOINTS)).select(by, "endpoint", "body")
    text = F.when(F.col("endpoint") == "index", gbk_text("body")).otherwise(body_text(F.col("body")))
    rows = known.withColumn("text", text)
    is_object = F.coalesce(F.regexp_like("text", F.lit(r"^\s*\{")), F.lit(False)) & F.get_json_object("text", "$").isNotNull()
    pool = _objects(F.get_json_object("text", "$.data.pool"))
    sides = F.transform(_objects(F.get_json_object("text", "$.data.diff")), lambda r: F.struct(*[_whole(r, f).alias(n) for f, n in (("f104", "up"), ("f105", "down"), ("f106", "flat"))]))
    sides = F.filter(sides, lambda s: s["up"].isNotNull() & s["down"].isNotNull() & s["flat"].isNotNull())
    heights = F.transform(pool, lambda r: F.coalesce(_whole(r, "lbc"), F.lit(0)).cast("int"))
    returns = F.filter(F.transform(pool, lambda r: F.get_json_object(r, "$.zdp").try_cast("double")), lambda x: x.isNotNull())
    at = lambda name: F.col("endpoint") == name
    parsed = rows.select(
        by, "endpoint", "text", F.when(at("index"), F.col("text").isNotNull()).otherwise(is_object).alias("read"), F.size(pool).cast("bigint").alias("size"), F.when(at("breadth"), sides).alias("sides"), F.when(at("limit_up"), heights).alias("heights"),
        F.when(at("yesterday_limit"), returns).alias("returns"), F.when(at("index"), _quotes(F.col("text"))).alias("quotes"),
    )
    part = F.struct("read", "size", "sides", "heights", "returns", "quotes")
    day = parsed.groupBy(by).agg(*[F.max_by(F.when(at(e), part), F.when(at(e), F.coalesce("text", F.lit("")))).alias(e) for e in ENDPOINTS])
    read = {e: F.coalesce(F.col(f"{e}.read"), F.lit(False)) for e in ENDPOINTS}
    n = {p: F.when(read[p], F.col(f"{p}.size")) for p in POOLS}
    summed = lambda name: F.when(F.size("breadth.sides") > 0, F.aggregate(F.transform("breadth.sides", lambda s: s[name]), F.lit(0).cast("bigint"), lambda a, x: a + x))
    hit, broken = F.coalesce(n["limit_up"], F.lit(0)), F.coalesce(n["broken_limit"], F.lit(0))
    h, r, q = F.col("limit_up.heights"), F.col("yesterday_limit.returns"), F.coalesce("index.quotes", F.array().cast(_INDEX))
    some = F.size(r) > 0
    going = F.size(F.filter(r, lambda x: x >= CONTINUES)).cast("bigint")
    mean = lambda xs: F.try_divide(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), F.size(xs))
    steps = F.array_sort(F.array_distinct(F.filter(h, lambda x: x > 0)))
    ladder = F.map_from_entries(F.transform(steps, lambda s: F.struct(s, F.size(F.filter(h, lambda x: x == s)).cast("bigint"))))
    warnings = [F.when(~read["breadth"], "breadth unavailable"), F.when((F.size("breadth.sides") > 0) & (F.size("breadth.sides") != 2), F.concat(F.lit("expected 2 breadth components, got "), F.size("breadth.sides")))]
    warnings += [F.when(~read[p], f"{p} pool unavailable") for p in POOLS] + [F.when(~read["index"], "index momentum unavailable").when(F.size(q) < 1, "no index could be read")]
    return day.select(
        by, summed("up").alias("advance_count"), summed("down").alias("decline_count"), summed("flat").alias("flat_count"), n["limit_up"].alias("limit_up_count"), n["broken_limit"].alias("broken_limit_count"), n["limit_down"].alias("limit_down_count"),
        rnd(100.0 * F.try_divide(broken, hit + broken), 3).alias("break_rate_pct"), F.array_max(h).cast("bigint").alias("max_limit_height"), F.coalesce(ladder, F.create_map().cast("map<int,bigint>")).alias("ladder"), F.when(some, F.size(r).cast("bigint")).alias("yesterday_limit_count"),
        F.when(some, going).alias("continuation_count"), F.when(some, rnd(100.0 * going / F.size(r), 3)).alias("continuation_rate_pct"), F.when(some, rnd(mean(r), 3)).alias("yesterday_pool_mean_return_pct"), q.alias("indices"),
        mean(F.transform(q, lambda x: x["change_pct"])).alias("index_return"), F.array_compact(F.array(*warnings)).alias("warnings"),
    )
