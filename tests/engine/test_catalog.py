"""Queries against their SQL on the smallest tables, and the contract of the entry point."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__
from tidewell.plans import catalog, sql

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels".split()
NAMES = (
    "bars_daily", "bars_clean", "bars_weekly", "weekly_completed_state", "feature_vector", "stock_score", "score_explain", "breadth_by_date", "timing_state", "timing_trades", "lead_lag_pairs", "event_reaction",
    "market_mood_daily", "text_signals", "topic_heat", "url_canonical", "html_text", "fact_validation", "collection_gate", "site_match", "outlook_plan", "review_queue", "journal_stats_tag", "journal_verify",
    "publication_errors", "publication_valid", "finalization_errors", "finalized_briefs", "fetch_cache_stream", "sizing", "archive_saves", "archive_verification",
    "news_collection", "news_newest", "news_attempts", "landed_market_snapshot", "fetch_histories", "fetch_coverage",
    "topic_articles", "topic_keyword_heat", "page_sites", "site_coverage", "journal_statistics",
    "sector_universe", "universe_members", "universe_codes",
)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (dt.date, dt.datetime)):
        return str(x)[:10]
    return x


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, sf_dir, con, name):
    got = catalog.queries()[name](spark, sf_dir)
    found = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(names)
    rows = lambda data, cols: sorted((tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in data), key=str)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(found.fetchall(), names)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_steady_rounding_reaches_nested_calls():
    assert sql.steady("round(a, 2)") == "round((a) + 1e-9::DOUBLE, 2)"
    assert sql.steady("x + round(b * 100) + round(f(c, 1), 3)") == "x + round(b * 100) + round((f(c, 1)) + 1e-9::DOUBLE, 3)"
