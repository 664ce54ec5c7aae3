"""Keyword sets against articles, held against testing every pair."""

import datetime as dt
import random

import duckdb
from pyspark.sql import functions as F

from tidewell.functions import text
from tidewell.operators import signals, topics
from tidewell.plans import catalog

ARTICLE = "article_id int, title string, content string, source string, published_at timestamp, topic string"


def test_against_every_pair(spark):
    rng = random.Random(3)
    letters = ["a", "b", "Ab", "ба", "新能源", "出口", " ", "\n", "x"]
    made = lambda n: "".join(rng.choices(letters, k=n))
    rows = [(i, made(3) if i % 7 else None, made(rng.randint(0, 30)) if i % 5 else None, "s", None, "clash") for i in range(200)]
    sets = [(f"t{i}", [made(rng.randint(1, 3)) for _ in range(rng.randint(1, 4))]) for i in range(60)] + [("none", []), ("blank", ["", " "]), ("null", None), ("t1", ["a"])]
    want = sorted(
        (r[0], name) for r in rows for name, words in sets for ws in [[w.lower() for w in words or [] if w.strip()]] if ws and all(w in f"{r[1] or ''}\n{r[2] or ''}".lower() for w in ws)
    )
    articles, table = spark.createDataFrame(rows, ARTICLE), spark.createDataFrame(sets, "topic string, keywords array<string>")
    for block in (5, 1000):
        got = topics.keyword_matches(articles, table, block=block)
        assert sorted((r["article_id"], r["topic"]) for r in got.collect()) == want and set(got.columns) == set(articles.columns)
    assert topics.keyword_matches(articles, table.where("topic = 'none'")).count() == 0
    assert topics.keyword_matches(articles.where("false"), table).count() == 0


def test_heat_of_matched_articles(spark):
    now = dt.datetime(2026, 8, 8, 8, tzinfo=dt.timezone.utc)
    ago = lambda **k: now - dt.timedelta(**k)
    rows = [(1, "新能源出口增长", "", "A", ago(minutes=20), None), (2, "新能源出口增长", "转载", "B", ago(minutes=10), None), (3, "新能源出口新数据", "", "B", ago(hours=3), None), (4, "新能源出口历史", "", "C", ago(days=3), None), (5, "新能源", "进口", "D", ago(hours=1), None)]
    table = spark.createDataFrame([("exports", ["新能源", "出口"])], "topic string, keywords array<string>")
    matched = topics.keyword_matches(spark.createDataFrame(rows, ARTICLE), table)
    r = signals.topic_heat(matched, ["topic"], F.lit(now)).first()
    assert r["last_24h_count"] == 2 and r["duplicate_ratio"] > 0 and r["score"] > 50 and r["matched_articles"] == 4


def test_words_that_upper_case_changes_are_found(spark, tmp_path):
    """``ß`` has no upper case of one letter; topics with it match as in the SQL."""
    con = duckdb.connect()
    con.execute("CREATE TABLE benchmark AS SELECT * FROM (VALUES (0, 'Erßie entech x'), (1, 'Enlich SCHSS. x')) t(item_id, text)")
    con.execute("CREATE TABLE documents AS SELECT doc_id, 'Line\n' || text AS text, 's' AS source FROM (VALUES (1::BIGINT, 'erßie ENTECH'), (2, 'ERSSIE entech'), (3, 'enlich schss.'), (4, 'enlich schß.')) t(doc_id, text)")
    for name in ("benchmark", "documents"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    for name in ("topic_articles", "topic_keyword_heat"):
        got, found = catalog.queries()[name](spark, str(tmp_path)), con.execute(catalog.oracle_sql()[name])
        want = {r[0]: dict(zip([c[0] for c in found.description], r)) for r in found.fetchall()}
        assert {r["topic"]: r.asDict() for r in got.collect()} == want and set(want) == {"item 0", "item 1"}


def test_phrases_of_one_script_are_not_looked_for_in_another(spark):
    df = spark.createDataFrame([("growth and growth 增长",), ("growth",), ("增长增长",), ("",)], "t string")
    words = ["growth", "增长"]
    a = [r[0] for r in df.select(text.phrase_count(F.col("t"), words)).collect()]
    assert a == [r[0] for r in df.select(text.phrase_count(F.col("t"), words, text.has_han(F.col("t")))).collect()] == [3, 1, 2, 0]
