"""Streaming forms: topic heat over sliding windows, and one open position a code."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.signals import title_key
from ..plans.cuts import shared_dir

ARTICLES = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def article_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream of articles. Its clock has no zone, so it is cast before a watermark."""
    e = spark.readStream.schema(ARTICLES).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parque*")
    title = F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k"))
    return e.select(F.col("event_id").alias("article_id"), F.col("event_type").alias("topic"), title.alias("title"), F.col("user_id").cast("string").alias("source"), F.col("ts").cast("timestamp").alias("published_at"))


def heat(articles: DataFrame, width: str = "24 hours", slide: str = "12 hours", late: str = "7 days") -> DataFrame:
    """Articles, titles and sources of each topic in sliding windows; copies of a title count once in a window.

    Counts are exact and the same in whatever order articles come: a window's state holds its titles and sources.
    """
    seen = articles.withColumn("title_key", title_key(F.col("title"))).withWatermark("published_at", late)
    many = lambda c: F.size(F.collect_set(c)).cast("long")
    return seen.groupBy(F.window("published_at", width, slide).alias("w"), "topic").agg(F.count("*").alias("articles"), many("title_key").alias("titles"), many("source").alias("sources")).select("topic", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "articles", "titles", "sources")


def first_titles(articles: DataFrame, late: str = "7 days") -> DataFrame:
    """The first article of each topic and title to come within ``late``; the state of a title goes when the watermark has passed it."""
    return articles.withColumn("title_key", title_key(F.col("title"))).withWatermark("published_at", late).dropDuplicatesWithinWatermark(["topic", "title_key"])


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there; its result is a table in the shared folder, by name.

    What a batch appends goes to a folder of the batch's number, so a batch that is run again replaces itself.
    """
    path = f"{shared_dir(stream.sparkSession)}/{name}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(path)


def one_position(signals: DataFrame, horizon: int) -> DataFrame:
    """Of each code's entry signals (code, rn) as they come, those that begin after the last taken one has run ``horizon`` bars.

    The state of a code is the first free bar; signals of a batch are taken in order of their bar.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        free = state.get[0] if state.exists else 0
        taken = []
        for rn in sorted(x for b in batches for x in b["rn"].tolist()):
            if rn >= free:
                taken.append(rn)
                free = rn + horizon + 1
        state.update((free,))
        yield pd.DataFrame({"code": [key[0]] * len(taken), "rn": pd.Series(taken, dtype="int64")})

    return signals.groupBy("code").applyInPandasWithState(step, "code string, rn bigint", "free bigint", "append", "NoTimeout")


def heat_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    found = drain(heat(article_stream(spark, sf_dir)), f"heat-{uuid.uuid4().hex}")
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return found.select("topic", day("start"), day("end"), "articles", "titles", "sources")


SQL = """WITH a AS (SELECT event_type AS topic, CAST(user_id AS VARCHAR) AS source, ts, sha256(lower(regexp_replace(event_type || ' ' || (props->>'$.k'), '[^\\w]+', '', 'g'))) AS title_key FROM events WHERE ts IS NOT NULL),
w AS (SELECT *, unnest([time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '1970-01-01') - INTERVAL 12 HOURS]) AS s FROM a)
SELECT topic, strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(s + INTERVAL 24 HOURS, '%Y-%m-%d %H:%M:%S') AS end, count(*) AS articles, count(DISTINCT title_key) AS titles, count(DISTINCT source) AS sources FROM w GROUP BY topic, s"""
