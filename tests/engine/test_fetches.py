"""The fetch cache over several batches, its timers, and batches that run again."""

import datetime as dt
import os
import uuid

from pyspark.sql import functions as F

from tidewell.plans.cuts import shared_dir
from tidewell.streaming import fetches, heat

KIND = "url string, request_id bigint, at timestamp, ok boolean, sha256 string"
START = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


def landed(spark, folder, batches):
    """Each batch is a file; a trigger reads one, oldest first."""
    for n, rows in enumerate(batches):
        made = [(u, i, START + dt.timedelta(minutes=m), ok, f"d{i}") for u, i, m, ok in rows]
        spark.createDataFrame(made, KIND).coalesce(1).write.mode("append").parquet(str(folder))
        for f in folder.glob("*.parquet"):
            if not (folder / f"{f.name}.seen").exists():
                os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))
                (folder / f"{f.name}.seen").write_text("")
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(folder))


def test_fresh_cached_stale_failed(spark, tmp_path):
    batches = [
        [("a", 1, 0, True), ("a", 3, 30, False), ("a", 2, 10, True), ("b", 4, 0, False)],
        [("a", 5, 60, False), ("a", 6, 61, False), ("b", 7, 61, True), ("a", 8, 62, True)],
        [("a", 9, 122, True), ("a", 10, 122, False), ("a", 11, 123, False), ("b", 12, 5000, False)],
        [("a", 13, 10000, False)],
    ]
    name = f"test-{uuid.uuid4().hex}"
    stream = fetches.cached_fetches(landed(spark, tmp_path / "in", batches), 3600, 7200, "1 minute")
    got = {r["request_id"]: (r["status"], r["age_ms"], r["sha256"]) for r in fetches.run(stream, name).collect()}
    minute = 60_000
    assert got == {
        1: ("fresh", 0, "d1"), 2: ("cached", 10 * minute, "d1"), 3: ("cached", 30 * minute, "d1"), 4: ("failed", None, None), 5: ("cached", 60 * minute, "d1"), 6: ("stale", 61 * minute, "d1"), 7: ("fresh", 0, "d7"), 8: ("fresh", 0, "d8"),
        9: ("cached", 60 * minute, "d8"), 10: ("cached", 60 * minute, "d8"), 11: ("stale", 61 * minute, "d8"), 12: ("failed", None, None), 13: ("failed", None, None),
    }
    held = spark.read.format("statestore").option("stateVarName", "held").load(f"{shared_dir(spark)}/{name}-progress")
    assert held.count() == 0  # the timers have cleared what nothing can use any more
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != fetches._ROCKS


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    rows = [("a", i, i, True) for i in range(4)]
    stream = landed(spark, tmp_path / "in", [rows[:2], rows[2:]]).withColumn("n", F.lit(1))
    name = f"test-{uuid.uuid4().hex}"
    assert heat.drain(stream, name, "append").count() == 4
    progress = f"{shared_dir(spark)}/{name}-progress"
    commits = sorted(f for f in os.listdir(f"{progress}/commits") if f.isdigit())
    for f in (commits[-1], f".{commits[-1]}.crc"):  # as if the last batch had been written but not committed
        if os.path.exists(f"{progress}/commits/{f}"):
            os.remove(f"{progress}/commits/{f}")
    assert heat.drain(stream, name, "append").count() == 4
