"""Market snapshots from landed bytes."""

import json

import pytest

from tidewell.operators import signals
from tidewell.sources import snapshots


def pool(*items):
    return json.dumps({"data": {"pool": list(items)}}).encode()


def quote(name, code, change):
    return f'v_{code}="' + "~".join(["1", name, code] + ["0"] * 29 + [change, "x"]) + '"'


DAY = {
    "breadth": b"\xef\xbb\xbf" + json.dumps({"data": {"diff": [{"f12": "a", "f104": 2500, "f105": "700", "f106": None}, {"f12": "b", "f104": 1500, "f105": 300, "f106": 7}, {"f104": "-"}, 3]}}).encode(),
    "limit_up": pool({"lbc": 1}, {"lbc": "5"}, {"lbc": 1}, {"lbc": "x"}, {}, "odd"), "broken_limit": pool({}), "limit_down": pool(), "yesterday_limit": pool({"zdp": 9.8}, {"zdp": "10.1"}, {"zdp": "-"}, {"zdp": -3}, {"zdp": 1.1}),
    "index": (quote("上证指数", "000001", "2.0") + ";\n" + quote("深证成指", "399001", "1.0") + ";" + quote("x", "y", "n/a") + ';v_s="1~2";none;').encode("gbk"),
}


@pytest.fixture(scope="module")
def rows(spark):
    odd = {**DAY, "breadth": json.dumps({"data": {"diff": {"0": {"f104": 1, "f105": 1, "f106": 1}}}}).encode(), "limit_up": b"<html>", "broken_limit": None, "index": b"\xff\xff;", "news": b"{}"}
    landed = [("d1", k, v) for k, v in DAY.items()] + [("d1", "limit_down", pool())] + [("d2", k, v) for k, v in odd.items() if k != "yesterday_limit"] + [("d3", "news", b"{}")]
    found = snapshots.market_snapshots(spark.createDataFrame([(d, e, None if b is None else bytearray(b)) for d, e, b in landed], "date string, endpoint string, body binary"))
    return {r["date"]: r for r in found.collect()}


def test_a_whole_day(rows):
    r = rows["d1"]
    assert (r["advance_count"], r["decline_count"], r["flat_count"]) == (4000, 1000, 7)
    assert (r["limit_up_count"], r["broken_limit_count"], r["limit_down_count"], r["break_rate_pct"]) == (5, 1, 0, 16.667)
    assert r["max_limit_height"] == 5 and r["ladder"] == {1: 2, 5: 1}
    assert (r["yesterday_limit_count"], r["continuation_count"], r["continuation_rate_pct"], r["yesterday_pool_mean_return_pct"]) == (4, 2, 50.0, 4.5)
    assert [(i["name"], i["code"], i["change_pct"]) for i in r["indices"]] == [("上证指数", "000001", 2.0), ("深证成指", "399001", 1.0)] and r["index_return"] == 1.5 and r["warnings"] == []


def test_what_is_missing_is_null_and_named(rows):
    r = rows["d2"]
    assert (r["limit_up_count"], r["broken_limit_count"], r["limit_down_count"], r["break_rate_pct"], r["continuation_count"], r["index_return"], r["max_limit_height"]) == (None, None, 0, None, None, None, None)
    assert r["ladder"] == {} and r["advance_count"] == 1
    assert r["warnings"] == ["expected 2 breadth components, got 1", "limit_up pool unavailable", "broken_limit pool unavailable", "yesterday_limit pool unavailable", "no index could be read"] and "d3" not in rows


def test_mood_of_snapshots(spark):
    """A hot day with all parts, and a day of which only breadth is known."""
    up = lambda n: pool(*[{"lbc": 5 if i == 0 else 1} for i in range(n)])
    went = pool(*[{"zdp": 10 if i < 6 else 0} for i in range(10)])
    landed = [("hot", "breadth", DAY["breadth"]), ("hot", "limit_up", up(100)), ("hot", "broken_limit", up(20)), ("hot", "limit_down", up(5)), ("hot", "yesterday_limit", went), ("hot", "index", DAY["index"])]
    landed += [("part", "breadth", json.dumps({"data": {"diff": [{"f104": 50, "f105": 50}, {"f104": 50, "f105": 50}]}}).encode())]
    day = snapshots.market_snapshots(spark.createDataFrame([(d, e, bytearray(b)) for d, e, b in landed], "date string, endpoint string, body binary"))
    m = {r["date"]: r for r in signals.mood(day).collect()}
    assert m["hot"]["score"] > 60 and m["hot"]["coverage"] == 1.0
    assert m["part"]["score"] == 50.0 and m["part"]["coverage"] < 0.75
