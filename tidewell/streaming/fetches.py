"""A fetch cache as a stream: each request is answered fresh, cached or stale from the state of its address."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .heat import ARTICLES, drain

#: Landed answers that are worth another try; others are final.
TRANSIENT = (408, 429, 500, 502, 503, 504)
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = T.StructType([T.StructField("fetched", T.LongType()), T.StructField("sha256", T.StringType())])
_OUT = "url string, request_id bigint, status string, age_ms bigint, sha256 string"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["url", "request_id", "status", "age_ms", "sha256"], dtype=object)


class FetchCache(StatefulProcessor):
    """State of an address: when its body was fetched last, and the body's digest.

    A request within ``ttl`` of that is answered from the state and fetches nothing. Otherwise its outcome counts: a success
    is fresh and replaces the state, a failure is answered with what there is up to ``keep`` later (stale), else it failed. Nothing is kept longer than
    ``keep``: a timer of event time clears the state, so it holds only addresses that were fetched lately.
    """

    def __init__(self, ttl_ms: int, keep_ms: int):
        self.ttl, self.keep = ttl_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fetched, digest = self.held.get() if self.held.exists() else (None, None)
        before, out = fetched, []
        batch = pd.concat(list(rows)).sort_values(["at_ms", "request_id"])
        for at, request, ok, sha in zip(batch["at_ms"].tolist(), batch["request_id"].tolist(), batch["ok"].tolist(), batch["sha256"].tolist()):
            age = None if fetched is None else at - fetched
            if age is not None and self.ttl > 0 and age <= self.ttl:
                out.append((key[0], request, "cached", max(0, age), digest))
            elif ok:
                fetched, digest = at, sha
                out.append((key[0], request, "fresh", 0, sha))
            elif age is not None and age <= self.keep:
                out.append((key[0], request, "stale", age, digest))
            else:
                out.append((key[0], request, "failed", None, None))
        if fetched != before:
            self.held.update((int(fetched), digest))
            if before is not None:
                self.handle.deleteTimer(before + self.keep)
            self.handle.registerTimer(int(fetched) + self.keep)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield _frame([])

    def close(self) -> None:
        pass


def cached_fetches(requests: DataFrame, ttl_seconds: int, keep_seconds: int, late: str = "1 hour") -> DataFrame:
    """(url, request_id, status, age_ms, sha256) for a stream of requests (url, request_id, at: timestamp, ok, sha256), in the order they come.

    ``ok`` and ``sha256`` are the outcome that a fetch has, or would have. Within a batch requests are answered by time, then id; one that comes late is
    answered by the state as it is then. The session needs a state store with timers while the stream starts, see ``run``.
    """
    slim = requests.select("url", "request_id", "at", F.unix_millis("at").alias("at_ms"), "ok", "sha256").withWatermark("at", late)
    return slim.groupBy("url").transformWithStateInPandas(FetchCache(1000 * ttl_seconds, 1000 * keep_seconds), _OUT, "Append", "EventTime")


def run(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream with timers over what is there. Such state lives in the embedded store; the session's own choice is put back after."""
    conf = stream.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKS)
    try:
        return drain(stream, name, "append")
    finally:
        conf.unset(_PROVIDER) if before is None else conf.set(_PROVIDER, before)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: a user is an address, a purchase or error a fetch that fails."""
    e = spark.readStream.schema(ARTICLES).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parque*").where("ts IS NOT NULL")
    return e.select(
        F.concat(F.lit("https://h.org/"), F.col("user_id")).alias("url"), F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("at"), (~F.col("event_type").isin("error", "purchase")).alias("ok"), F.sha2(F.col("props"), 256).alias("sha256"),
    )


def fetch_cache_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(cached_fetches(requests(spark, sf_dir), 6 * 3600, 48 * 3600), f"fetches-{uuid.uuid4().hex}")


SQL = """WITH RECURSIVE r AS (SELECT 'https://h.org/' || user_id AS url, event_id AS request_id, epoch_us(ts) // 1000 AS t, event_type NOT IN ('error', 'purchase') AS ok, sha256(props) AS sha, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM events WHERE ts IS NOT NULL),
f AS (SELECT url, 0::BIGINT AS rn, NULL::BIGINT AS fetched, NULL::VARCHAR AS sha, NULL::BIGINT AS request_id, NULL::VARCHAR AS status, NULL::BIGINT AS age_ms, NULL::VARCHAR AS given FROM (SELECT DISTINCT url FROM r)
  UNION ALL SELECT url, rn, CASE WHEN status = 'fresh' THEN t ELSE fetched END, CASE WHEN status = 'fresh' THEN new_sha ELSE sha END, request_id, status, CASE status WHEN 'fresh' THEN 0 WHEN 'failed' THEN NULL ELSE t - fetched END, CASE status WHEN 'fresh' THEN new_sha WHEN 'failed' THEN NULL ELSE sha END
  FROM (SELECT f.url, r.rn, f.fetched, f.sha, r.t, r.sha AS new_sha, r.request_id,
    CASE WHEN r.t - f.fetched <= 21600000 THEN 'cached' WHEN r.ok THEN 'fresh' WHEN r.t - f.fetched <= 172800000 THEN 'stale' ELSE 'failed' END AS status FROM f JOIN r ON r.url = f.url AND r.rn = f.rn + 1))
SELECT url, request_id, status, age_ms, given AS sha256 FROM f WHERE rn > 0"""
