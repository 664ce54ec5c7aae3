"""Weekly states against their SQL where means of weeks are equal but for the last bit."""

import datetime as dt
import random

import duckdb

from tidewell.operators import timing
from tidewell.plans import prices


def test_equal_means_are_told_apart_as_in_the_sql(spark):
    rng = random.Random(7)
    rows = [(f"c{c}", dt.date(2020, 1, 1) + dt.timedelta(days=d), 100 + rng.randint(-1, 1) / 10) for c in range(6) for d in range(700) if rng.random() < 0.6]
    con = duckdb.connect()
    con.execute("CREATE TABLE raw (code VARCHAR, date DATE, close DOUBLE)")
    con.executemany("INSERT INTO raw VALUES (?, ?, ?)", rows)
    con.execute("CREATE TABLE bars AS SELECT 'stock' AS role, *, close AS open, close AS high, close AS low, 1.0::DOUBLE AS volume FROM raw")
    want = con.execute("WITH " + prices._WSTATE + " SELECT code, date, weekly_state FROM wstate").fetchall()
    bars = spark.createDataFrame(rows, "code string, date date, close double").selectExpr("*", "close AS open", "close AS high", "close AS low", "1D AS volume")
    got = [tuple(r) for r in timing.weekly_state(bars).select("code", "date", "weekly_state").collect()]
    assert sorted(got) == sorted(want) and len({r[2] for r in got}) == 4
