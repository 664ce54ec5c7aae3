"""Landed fetches as a data source: folders, odd lines, pushed filters, histories and coverage."""

import base64
import json

import pytest
from tidewell.sources import landing


@pytest.fixture
def folder(tmp_path):
    def put(source, name, *lines):
        (tmp_path / f"source={source}").mkdir(exist_ok=True)
        (tmp_path / f"source={source}" / name).write_bytes(b"\n".join(x if isinstance(x, bytes) else json.dumps(x).encode() for x in lines))

    fetch = lambda url, attempt, status, body="x", day=1: {"url": url, "attempt": attempt, "http_status": status, "body": body, "retrieved_at": f"2026-01-0{day}T00:00:00Z"}
    put("a", "one.json", fetch("u1", 1, 503), fetch("u1", 2, 429), fetch("u1", 3, 200, day=3), fetch("u2", 1, 404), b"{broken", b"", b"[1]", {"url": "u5", "attempt": "x"})
    put("a", "two.json", fetch("u3", 1, 500), {"url": "u4", "attempt": 3}, fetch("u4", 2, 502), fetch("u4", 1, 502), fetch("u6", 1, 200, ""))
    put("b%2Fc", "one.json", {"url": "v1", "attempt": 1, "http_status": 200, "body_base64": base64.b64encode(b"\x00\xff").decode(), "more": 1}, b"\xef\xbb\xbf" + json.dumps(fetch("v2", 1, 200)).encode())
    put("b%2Fc", "_hidden", b"nothing")
    (tmp_path / "stray.json").write_text("{}")
    return str(tmp_path)


def test_lines_become_rows(spark, folder):
    rows = landing.read(spark, folder).collect()
    assert len(rows) == 14 and {r["source"] for r in rows} == {"a", "b/c"}
    assert bytes(next(r["body"] for r in rows if r["url"] == "v1")) == b"\x00\xff"
    bad = [(bytes(r["body"]), r["error"].split(":")[0]) for r in rows if r["error"]]
    assert sorted(bad) == [(b"[1]", "ValueError"), (b'{"url": "u5", "attempt": "x"}', "ValueError"), (b"{broken", "JSONDecodeError")]
    assert all(r["url"] is None for r in rows if r["error"])


def test_sources_choose_folders(spark, folder):
    whole = landing.read(spark, folder)
    assert whole.where("source = 'b/c' AND attempt = 1").count() == 2 and whole.count() == 14
    assert landing.read(spark, folder, ["a", "z"]).rdd.getNumPartitions() == 2 and whole.rdd.getNumPartitions() == 3
    assert landing.read(spark, folder, ["b/c"]).count() == 2 and landing.read(spark, folder, ["nowhere"]).count() == 0


def test_histories_and_coverage(spark, folder):
    df = landing.read(spark, folder)
    h = {r["url"]: (r["attempts"], r["transient"], r["waited_seconds"], r["http_status"], r["outcome"]) for r in landing.histories(df).collect()}
    assert h["u1"] == (3, 2, 1.8, 200, "success") and h["u2"] == (1, 0, 0.0, 404, "failed") and h["u3"] == (1, 1, 0.6, 500, "pending")
    assert h["u4"] == (3, 3, 1.8, None, "failed") and h["u6"] == (1, 1, 0.6, 200, "pending") and h["v1"][4] == "success"
    asked = spark.createDataFrame([("a", "u1"), ("a", "u2"), ("a", "u3"), ("a", "u4"), ("a", "never"), ("a", "never"), ("d", "x")], "source string, url string")
    c = {r["source"]: r for r in landing.coverage(df, asked).collect()}
    assert (c["a"]["asked"], c["a"]["landed"], c["a"]["succeeded"], c["a"]["failed"], c["a"]["pending"], c["a"]["malformed"], c["a"]["coverage"], str(c["a"]["as_of"])) == (5, 4, 1, 2, 1, 3, 0.2, "2026-01-03 00:00:00")
    assert (c["d"]["asked"], c["d"]["landed"], c["d"]["coverage"], c["d"]["as_of"]) == (1, 0, 0.0, None) and set(c) == {"a", "d"}


def test_landed_and_read_back(spark, tmp_path):
    path = str(tmp_path / "out")
    landing.land(spark.createDataFrame([("s 1/x", "u", 1, 200, "b")], "source string, url string, attempt int, http_status int, body string"), path)
    assert [(r["source"], r["url"], bytes(r["body"])) for r in landing.read(spark, path).collect()] == [("s 1/x", "u", b"b")]
    with pytest.raises(Exception, match="no folder"):
        landing.read(spark, path + "-none").count()
