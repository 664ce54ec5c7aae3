"""Universes, the codes they ask for, and quotes."""

import json

import duckdb

from tidewell.plans import catalog
from tidewell.sources import universe

PRESETS = "sector string, terms array<string>, benchmark string, market_benchmark string, seed_as_of string"
BOARDS = "board string, name string, ordinal int"
LISTED = "board string, code string, name string, market_cap double"
SEEDS = "sector string, code string, name string, market_cap double"


def test_discovery_seeds_and_benchmarks(spark):
    presets = spark.createDataFrame([("chips", ["Chip", "半导体"], "512480", None, "2026-01-01"), ("drugs", ["drug"], "", "000905", "2025-05-05"), ("none", ["zzz"], None, None, None)], PRESETS)
    boards = spark.createDataFrame([("B1", "Microchips", 1), ("B2", "半导体设备", 2), ("B1", "Micro CHIPS", 5), ("B3", "Banks", 3), ("B4", "chip paper", 4), (None, "chip", 6)], BOARDS)
    listed = spark.createDataFrame([("B1", "600001", "a", 5.0), ("B2", "600001", "a2", 9.0), ("B2", "600002", "b", None), ("B1", "600003", "*ST c", 7.0), ("B1", "60", "d", 1.0), ("B4", "600004", "e", 5.0), ("B3", "600009", "f", 1.0), ("B2", "600005", "退市g", 1.0)], LISTED)
    seeds = spark.createDataFrame([("drugs", "600100", "s", 3.0), ("drugs", "600101", "t", 3.0), ("chips", "600900", "u", 9.0)], SEEDS)
    sectors, members = universe.universes(presets, boards, listed, seeds)
    s = {r["sector"]: r for r in sectors.collect()}
    assert (s["chips"]["discovery_status"], s["chips"]["board_count"], s["chips"]["member_count"], s["chips"]["market_benchmark"], s["chips"]["warnings"]) == ("dynamic", 3, 3, "000300", [])
    assert s["drugs"]["warnings"] == ["no board name matched", "dated seed universe as of 2025-05-05", "no tradable benchmark configured"] and s["drugs"]["market_benchmark"] == "000905"
    assert s["none"]["warnings"] == ["no board name matched", "no members and no seed universe", "no tradable benchmark configured"] and s["none"]["coverage"] == 0.0
    m = [(r["sector"], r["place"], r["code"], r["boards"]) for r in members.orderBy("sector", "place").collect()]
    assert m == [("chips", 1, "600004", ["chip paper"]), ("chips", 2, "600001", ["Micro CHIPS", "半导体设备"]), ("chips", 3, "600002", ["半导体设备"]), ("drugs", 1, "600101", ["drugs"]), ("drugs", 2, "600100", ["drugs"])]
    capped, few = universe.universes(presets, boards, listed, seeds, most_boards=1, most_members=1)
    assert few.where("sector = 'chips'").first()["code"] == "600001" and capped.where("sector = 'chips'").first()["board_count"] == 1


def test_parts_that_share_a_code_stay_apart(spark, sf_dir, tmp_path):
    """Keys of seven digits give codes that others have: each part is a member of its own, as in the SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE part AS SELECT p_partkey + i * 999900 AS p_partkey, p_name, p_brand, p_type, p_size, p_retailprice + i AS p_retailprice FROM '{sf_dir}/part.parquet', range(2) r(i)")
    con.execute(f"CREATE TABLE region AS SELECT * FROM '{sf_dir}/region.parquet'")
    for name in ("part", "region"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    for name in ("sector_universe", "universe_members"):
        got, found = catalog.queries()[name](spark, str(tmp_path)), con.execute(catalog.oracle_sql()[name])
        names = [c[0] for c in found.description]
        assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, found.fetchall()))


def test_codes_of_documents(spark):
    doc = {"benchmark": {"code": "sh512480"}, "market_benchmark": "x", "stocks": ["600002", "12", None, {"code": "SZ000001"}], "members": [{"code": "600001"}, {"code": 600002}, {"name": "none"}]}
    rows = universe.codes_of(spark.createDataFrame([("d", json.dumps(doc)), ("e", "{}"), ("f", None)], "document string, body string")).orderBy("ordinal").collect()
    assert [(r["document"], r["code"]) for r in rows] == [("d", c) for c in ("600001", "600002", "000001", "512480")]


def test_quotes(spark):
    values = ["1", "浦发银行", "600000", "10.5"] + ["0"] * 28 + ["-1.25"] + ["0"] * 5 + ["0.3", "nan"] + ["0"] * 4 + ["3000"] + ["0", "x"]
    good = json.dumps({"data": {"sh600000": {"qt": {"sh600000": values}}}}, ensure_ascii=False)
    rows = {r["code"]: r for r in universe.quotes(spark.createDataFrame([("sh600000", bytearray(good.encode())), ("sz000001", bytearray(b"{}")), ("bj830001", None)], "market_id string, body binary")).collect()}
    r = rows["600000"]
    assert (r["name"], r["price"], r["change_pct"], r["turnover_pct"], r["pe_ttm"], r["market_cap_yi"], r["pb"]) == ("浦发银行", 10.5, -1.25, 0.3, None, 3000.0, None)
    assert rows["000001"]["name"] == "" and rows["830001"]["price"] is None
