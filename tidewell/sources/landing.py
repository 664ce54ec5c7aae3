"""Landed fetches as a data source: ``spark.read.format("landed_fetches")`` over a folder of JSON lines, and what their history says.

A folder holds one subfolder a source (``source=<name>``) with files of a fetch a line. Each file is read in its own task, in
Arrow batches, and folders can be chosen by source. A line that is no fetch is a row with an error, so nothing
that was landed gets lost.
"""

from __future__ import annotations

import base64
import datetime as dt
import io
import json
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Answers that are worth another try.
TRANSIENT = (408, 429, 500, 502, 503, 504)
#: Tries of an address before it is given up.
RETRIES = 3
SCHEMA = "source string, url string, attempt int, retrieved_at timestamp, http_status int, body binary, error string"
_ARROW = pa.schema([
    ("source", pa.string()), ("url", pa.string()), ("attempt", pa.int32()), ("retrieved_at", pa.timestamp("us", tz="UTC")), ("http_status", pa.int32()), ("body", pa.binary()), ("error", pa.string()),
])
_ROWS, _BYTES = 2000, 1 << 24


@dataclass
class LandedFile(InputPartition):
    path: str
    source: str


def parse_line(source: str, line: bytes) -> tuple:
    """A row of a landed line. What is missing is null; a line that is no JSON object, or whose fields have other types, keeps its bytes as the body."""
    try:
        d = json.loads(line.decode("utf-8-sig"))
        if not isinstance(d, dict):
            raise ValueError("no object")
        if "body_base64" in d:
            body = base64.b64decode(d["body_base64"], validate=True)
        else:
            body = None if d.get("body") is None else str(d["body"]).encode()
        at = None if d.get("retrieved_at") is None else dt.datetime.fromisoformat(d["retrieved_at"].replace("Z", "+00:00"))
        at = at if at is None or at.tzinfo else at.replace(tzinfo=dt.timezone.utc)
        whole = lambda name: None if d.get(name) is None else int(d[name])
        return source, None if d.get("url") is None else str(d["url"]), whole("attempt"), at, whole("http_status"), body, None
    except (ValueError, TypeError, AttributeError) as error:  # the row says what was wrong
        return source, None, None, None, None, line, f"{type(error).__name__}: {error}"[:200]


class LandedReader(DataSourceReader):
    def __init__(self, path: str, sources: set[str] | None):
        self.path, self.sources = path, sources

    def partitions(self) -> list[LandedFile]:
        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        if store.get_file_info(root).type == fs.FileType.NotFound:
            raise ValueError(f"no folder {self.path}")
        found = []
        for folder in store.get_file_info(fs.FileSelector(root)):
            name = folder.base_name
            source = urllib.parse.unquote(name.removeprefix("source="))
            if folder.type != fs.FileType.Directory or not name.startswith("source=") or (self.sources is not None and source not in self.sources):
                continue
            files = [f for f in store.get_file_info(fs.FileSelector(folder.path, recursive=True)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
            found += [LandedFile(f.path, source) for f in sorted(files, key=lambda f: f.path)]
        return found

    def read(self, partition: LandedFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no folder at all
            return
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        rows, size = [], 0
        with store.open_input_stream(partition.path) as stream:
            for line in io.BufferedReader(stream, 1 << 20):
                if line.strip():
                    rows.append(parse_line(partition.source, line.rstrip(b"\r\n")))
                    size += len(line)
                if len(rows) >= _ROWS or size >= _BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class LandedFetches(DataSource):
    """``load(folder)`` or the option ``path``; the option ``sources`` (JSON list of names) chooses folders.

    The choice is an option, not a pushed filter: the engine keeps a reader with the filters of its first scan, and
    later scans of the same frame would miss rows.
    """

    @classmethod
    def name(cls) -> str:
        return "landed_fetches"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandedReader:
        if not self.options.get("path"):
            raise ValueError("landed_fetches needs a folder")
        chosen = self.options.get("sources")
        return LandedReader(self.options["path"], None if chosen is None else set(json.loads(chosen)))


def read(spark: SparkSession, path: str, sources: list[str] | None = None) -> DataFrame:
    """The fetches under a folder, of all sources or some; folders of others are not listed."""
    spark.dataSource.register(LandedFetches)
    reader = spark.read.format("landed_fetches")
    return (reader if sources is None else reader.option("sources", json.dumps(sources))).load(path)


def land(fetches: DataFrame, path: str) -> None:
    """Lands fetches (source and the fields of a line) as JSON lines under ``path``."""
    fields = [c for c in fetches.columns if c != "source"]
    fetches.select("source", F.to_json(F.struct(*fields)).alias("value")).write.mode("append").partitionBy("source").text(path)


def backoff(attempt: Column) -> Column:
    """Seconds to wait before the next try, without the random part."""
    return F.least(F.lit(8.0), 0.6 * F.pow(F.lit(2.0), attempt - 1))


def histories(landed: DataFrame, retries: int = RETRIES) -> DataFrame:
    """(source, url, attempts, transient, waited_seconds, http_status, outcome) of each address, by its last try.

    A try with status 200 and a body succeeds; one without an answer or with a transient status is tried again until ``retries`` are used up; other answers
    are final. Lines that are no fetch have no address and are left out here; ``coverage`` counts them.
    """
    good = (F.col("http_status") == 200) & (F.length("body") > 0)
    again = F.col("http_status").isNull() | F.col("http_status").isin(*TRANSIENT) | (F.col("http_status") == 200)
    x = landed.where("url IS NOT NULL").select("source", "url", "attempt", "http_status", F.coalesce(good, F.lit(False)).alias("good"), (again & ~F.coalesce(good, F.lit(False))).alias("again"))
    h = x.groupBy("source", "url").agg(F.count("*").alias("attempts"), F.count_if("again").alias("transient"), F.sum(F.when(F.col("again") & (F.col("attempt") < retries), backoff(F.col("attempt"))).otherwise(0.0)).alias("waited_seconds"), F.max_by(F.struct("http_status", "good", "again"), "attempt").alias("last"), F.max("attempt").alias("n"))
    outcome = F.when(F.col("last.good"), "success").when(F.col("last.again") & (F.col("n") < retries), "pending").otherwise("failed")
    return h.select("source", "url", "attempts", "transient", F.round("waited_seconds", 3).alias("waited_seconds"), F.col("last.http_status").alias("http_status"), outcome.alias("outcome"))


def coverage(landed: DataFrame, asked: DataFrame, retries: int = RETRIES) -> DataFrame:
    """(source, asked, landed, succeeded, failed, pending, malformed, coverage, as_of): what came of the addresses asked for (source, url).

    Addresses that nothing was landed of count as asked only, and those that nobody asked for count nowhere.
    """
    h = histories(landed, retries).select("source", "url", "outcome")
    j = asked.select("source", "url").distinct().join(h, ["source", "url"], "left")
    one = lambda name: F.count_if(F.col("outcome") == name)
    g = j.groupBy("source").agg(F.count("*").alias("asked"), F.count("outcome").alias("landed"), one("success").alias("succeeded"), one("failed").alias("failed"), one("pending").alias("pending"))
    rest = landed.groupBy("source").agg(F.count("error").alias("malformed"), F.max(F.when(F.col("http_status") == 200, F.col("retrieved_at"))).alias("as_of"))
    return g.join(rest, "source", "left").select("source", "asked", "landed", "succeeded", "failed", "pending", F.coalesce("malformed", F.lit(0)).alias("malformed"), F.round(F.col("succeeded") / F.col("asked"), 4).alias("coverage"), "as_of")
