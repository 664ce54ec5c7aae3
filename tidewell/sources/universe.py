"""Sector universes: boards found by terms, their members, a dated seed where nothing is found, and the codes a universe asks for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import finite
from ..functions.groups import ordered_distinct
from ..operators.topics import keyword_matches
from .parsers import body_text, normalize_code

#: Places of a positional quote.
QUOTE = {"price": 3, "change_pct": 32, "turnover_pct": 38, "pe_ttm": 39, "market_cap_yi": 44, "pb": 46}
#: Lists of a universe document that hold codes, and its objects that do, in this order.
MEMBER_KEYS, BENCHMARK_KEYS = ("members", "stocks", "candidates", "securities"), ("benchmark", "market_benchmark")
#: The market's benchmark where a preset names none.
MARKET_BENCHMARK = ("000300", "沪深300")


def quotes(landed: DataFrame) -> DataFrame:
    """(code, market_id, name, the fields of QUOTE): the quote that comes with daily bars; zeros and what is no number are null.

    ``landed``: market_id (prefix and code) and body. A body without a quote gives an empty name.
    """
    node = F.from_json(F.get_json_object(body_text(F.col("body")), "$.data"), "map<string,string>")[F.col("market_id")]
    values = F.from_json(F.from_json(F.get_json_object(node, "$.qt"), "map<string,string>")[F.col("market_id")], "array<string>")
    q = landed.select("market_id", values.alias("v"))
    at = lambda i: F.nullif(finite(F.get("v", F.lit(i))), F.lit(0.0))
    return q.select(normalize_code(F.col("market_id")).alias("code"), "market_id", F.coalesce(F.get("v", F.lit(1)), F.lit("")).alias("name"), *[at(i).alias(n) for n, i in QUOTE.items()])


def codes_of(documents: DataFrame, key: str = "document", body: str = "body") -> DataFrame:
    """(key, ordinal, code): the codes that universe documents (JSON text) name, each once, in the order of the text's lists, then its benchmarks.

    Entries are objects with a code, or codes; what is no code of six digits is left out.
    """
    entries = [F.coalesce(F.from_json(F.get_json_object(body, f"$.{k}"), "array<string>"), F.array().cast("array<string>")) for k in MEMBER_KEYS]
    entries += [F.array(F.get_json_object(body, f"$.{k}")) for k in BENCHMARK_KEYS]
    code = lambda x: normalize_code(F.when(F.startswith(x, F.lit("{")), F.get_json_object(x, "$.code")).otherwise(x))
    listed = F.array_distinct(F.filter(F.transform(F.concat(*entries), code), lambda c: c.isNotNull()))
    return documents.select(key, F.posexplode(listed).alias("ordinal", "code"))


def matched_boards(boards: DataFrame, presets: DataFrame, most: int = 30) -> DataFrame:
    """(sector, place, board, name): the boards whose name holds one of a sector's terms, whatever the case; the first ``most`` of each sector.

    ``boards``: board, name, ordinal (concepts before industries, pages in order); of a board that is listed twice the last name counts, at its first place.
    ``presets``: sector, terms. All terms are looked for in one reading of the boards.
    """
    each = presets.select("sector", F.explode(F.array_distinct("terms")).alias("term")).select(F.col("sector").alias("topic"), F.array("term").alias("keywords"))
    named = boards.where("coalesce(board, '') <> '' AND coalesce(name, '') <> ''")
    hit = keyword_matches(named.select("board", "name", "ordinal"), each, ("name",)).select(F.col("topic").alias("sector"), "board", "name", "ordinal").distinct()
    one = hit.groupBy("sector", "board").agg(F.min("ordinal").alias("first"), F.max_by("name", "ordinal").alias("name"))
    w = Window.partitionBy("sector").orderBy("first", "board")
    return one.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("sector", "place", "board", "name")


def members(found: DataFrame, listed: DataFrame, identity: Sequence[str] = ("code",)) -> DataFrame:
    """(sector, the identity, code, name, market_cap, boards): the members of a sector's boards, a row a code, its boards in their order; name and size are those of the first board.

    ``listed``: board, code, name, market_cap. Names at risk of delisting and codes of other than six signs are left out.
    ``identity``: columns of ``listed`` that tell members apart, where a code alone does not.
    """
    risky = F.contains(F.upper("name"), F.lit("ST")) | F.contains("name", F.lit("退"))
    ok = listed.where((F.length("code") == 6) & ~F.coalesce(risky, F.lit(False)))
    j = found.select("sector", "place", "board", F.col("name").alias("board_name")).join(ok, "board")
    key = ["sector", *identity]
    held = [c for c in ("code", "name", "market_cap") if c not in key]
    first = j.groupBy(*key).agg(F.min_by(F.struct(*held), F.struct("place", *held)).alias("m")).select(*key, "m.*")
    return first.join(ordered_distinct(j, key, "board_name", "place", "boards"), key, "left")


def universes(presets: DataFrame, boards: DataFrame, listed: DataFrame, seeds: DataFrame, most_boards: int = 30, most_members: int = 80, identity: Sequence[str] = ("code",)) -> tuple[DataFrame, DataFrame]:
    """(sectors, members): a row a sector with its benchmarks, status and warnings, and its largest members in order.

    ``presets``: sector, terms, benchmark, market_benchmark, seed_as_of; ``seeds``: sector, code, name, market_cap. A sector without a dynamic member takes its
    seeds (``seed_fallback``). Members stand by size, then code, both falling; a missing size counts as 0. ``identity`` is that of ``members``.
    """
    found = matched_boards(boards, presets, most_boards)
    dynamic = members(found, listed, identity).select("sector", "code", "name", "market_cap", "boards", F.lit("dynamic").alias("kind"))
    has = dynamic.groupBy("sector").agg(F.count("*").alias("dynamic_member_count"))
    planted = seeds.join(has, "sector", "left_anti").select("sector", "code", "name", "market_cap", F.array("sector").alias("boards"), F.lit("seed_fallback").alias("kind"))
    order = Window.partitionBy("sector").orderBy(F.desc(F.coalesce("market_cap", F.lit(0.0))), F.desc("code"))
    every = dynamic.unionByName(planted).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most_members)
    n = every.groupBy("sector").agg(F.count("*").alias("member_count"), F.max("kind").alias("kind"))
    b = found.groupBy("sector").agg(F.count("*").alias("board_count"))
    j = presets.join(n, "sector", "left").join(b, "sector", "left").join(has, "sector", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    seeded = F.coalesce(F.col("kind") == "seed_fallback", F.lit(False))
    warnings = F.array_compact(F.array(
        F.when(F.col("board_count").isNull(), "no board name matched"), F.when(seeded, F.concat(F.lit("dated seed universe as of "), F.coalesce("seed_as_of", F.lit("an unknown day")))),
        F.when(F.col("member_count").isNull(), "no members and no seed universe"), F.when(F.coalesce("benchmark", F.lit("")) == "", "no tradable benchmark configured"),
    ))
    sectors = j.select(
        "sector", F.when(seeded, "seed_fallback").otherwise("dynamic").alias("discovery_status"), F.when(seeded, F.col("seed_as_of")).alias("seed_as_of"), F.nullif("benchmark", F.lit("")).alias("benchmark"), F.coalesce(F.nullif("market_benchmark", F.lit("")), F.lit(MARKET_BENCHMARK[0])).alias("market_benchmark"),
        zero("board_count"), zero("dynamic_member_count"), zero("member_count"), F.round(F.coalesce("member_count", F.lit(0)) / max(1, most_members), 3).alias("coverage"), warnings.alias("warnings"),
    )
    return sectors, every.select("sector", "place", "code", "name", "market_cap", "boards")
