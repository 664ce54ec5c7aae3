"""The journal's store: saved, saved again, saved otherwise, replayed, reviewed and verified."""

import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from tidewell.operators import archive
from tidewell.plans.cuts import shared_dir

RUN = "run_id string, topic string, as_of string, horizon string, instruments array<string>, tags array<string>, stance string, decision string, confidence string, thesis string, review_date string, artifacts array<%s>, extra string" % archive.ARTIFACT
REVIEW = "run_id string, observed_at string, thesis_status string, realized_return_pct double, benchmark_return_pct double, decision_quality string, note string, tags array<string>, artifacts array<%s>" % archive.ARTIFACT


@pytest.fixture
def root(spark):
    return f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"


def artifacts(spark, folder, files):
    for name, content in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(folder))
    return archive.as_artifacts(found.select("path", "content"))


def refs(rows, *roles):
    return [{**{c: r[c] for c in ("source_name", "object_path", "sha256", "size_bytes", "media_type")}, "role": role} for r, role in zip(rows, roles)]


def run(arts, **changes):
    base = dict(run_id=None, topic=" Chips   next 20d ", as_of="2026-08-10", horizon="20d", instruments=["688001", " 688001", "", "688002"], tags=["semi", "after-close"], stance="neutral", decision="wait", confidence="medium", thesis="not\nyet  confirmed", review_date="2026-09-07", artifacts=arts, extra="ignored")
    return {**base, **changes}


def review(run_id, **changes):
    base = dict(run_id=run_id, observed_at="2026-09-07", thesis_status="partially_confirmed", realized_return_pct=3.5, benchmark_return_pct=1.0, decision_quality="good", note="late", tags=[], artifacts=None)
    return {**base, **changes}


def rows(spark, data, kind):
    schema = spark.createDataFrame([], kind).schema
    return spark.createDataFrame([tuple(d[n] for n in schema.names) for d in data], schema)


def statuses(df):
    return sorted((r["status"], r["rows"]) for r in df.collect())


def saved(spark, root, tmp_path, **changes):
    a = artifacts(spark, tmp_path / "in", {"conclusion.json": b'{"schema": "x/1"}', "notes/evidence.md": b"# e"})
    archive.save_objects(a, root, "first")
    found = sorted(a.collect(), key=lambda r: r["source_name"])
    arts = refs(found, "conclusion", "evidence-pack")
    return arts, archive.save_runs(rows(spark, [run(arts, **changes)], RUN), root, "first")


def test_objects_are_stored_once_and_secrets_not(spark, root, tmp_path):
    a = artifacts(spark, tmp_path, {"a.json": b"{}", "b.JSON": b"{}", "k.secret": b"s", "n.csv": b"1,2", "raw": b"\x00\xff"})
    hidden = spark.createDataFrame([("/x/.env", bytearray(b"KEY=1")), (".env", bytearray(b"{}"))], "path string, content binary")  # Spark's reader passes over such files by itself
    a = a.unionByName(archive.as_artifacts(hidden)).cache()
    got = {(r["sha256"], r["status"]) for r in archive.save_objects(a, root, "one").collect()}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {(digest(b"{}"), "saved"), (digest(b"KEY=1"), "refused"), (digest(b"s"), "refused"), (digest(b"1,2"), "saved"), (digest(b"\x00\xff"), "saved")}
    stored = {r["sha256"]: r for r in archive.read(spark, root, "objects").collect()}
    assert set(stored) == {digest(b"{}"), digest(b"1,2"), digest(b"\x00\xff")} and bytes(stored[digest(b"\x00\xff")]["content"]) == b"\x00\xff"
    kinds = {r["source_name"]: r["media_type"] for r in a.collect()}
    assert (kinds["b.JSON"], kinds["n.csv"], kinds["raw"]) == ("application/json", "text/csv", "application/octet-stream")
    assert {r["status"] for r in archive.save_objects(a.where("NOT refused"), root, "two").collect()} == {"repeated"}
    assert {r["status"] for r in archive.save_objects(a.where("NOT refused"), root, "one").collect()} == {"saved"}  # replayed
    assert archive.read(spark, root, "objects").count() == 3


def test_save_again_and_otherwise(spark, root, tmp_path):
    arts, outcome = saved(spark, root, tmp_path)
    assert statuses(outcome) == [("saved", 1)]
    held = archive.read(spark, root, "runs").first()
    identity = {"topic": "Chips next 20d", "as_of": "2026-08-10", "horizon": "20d", "instruments": ["688001", "688002"], "tags": ["semi", "after-close"], "artifacts": [{"role": a["role"], "sha256": a["sha256"]} for a in arts],
                "summary": {"stance": "neutral", "decision": "wait", "confidence": "medium", "thesis": "not yet confirmed", "review_date": "2026-09-07"}}
    digest = hashlib.sha256(json.dumps(identity, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert held["content_fingerprint"] == digest and held["run_id"] == f"20260810-Chips-next-20d-{digest[:10]}" and (held["year"], held["month"]) == (2026, 8)
    again = [run(arts), run(arts), run(arts, run_id=held["run_id"], thesis="rewritten"), run(arts, run_id="own id", stance="bullish"), run(arts, run_id="own id", stance="bearish"), run(arts, stance="sideways"), run(arts, as_of="soon"), run([], topic="t")]
    outcome = archive.save_runs(rows(spark, again, RUN), root, "second")
    assert statuses(outcome) == [("conflict", 1), ("conflict", 1), ("invalid", 1), ("invalid", 1), ("invalid", 1), ("repeated", 2), ("saved", 1)]
    assert {r["reason"] for r in outcome.where("status = 'invalid'").collect()} == {"invalid stance", "as_of is no date", "no conclusion"}
    assert archive.read(spark, root, "runs").count() == 2
    assert archive.read(spark, root, "runs").where(F.col("run_id") == held["run_id"]).first()["thesis"] == "not yet confirmed"


def test_a_replayed_batch_replaces_itself(spark, root, tmp_path):
    arts, _ = saved(spark, root, tmp_path)
    batch = rows(spark, [run(arts, topic=t) for t in ("a", "b", "c")], RUN)
    assert statuses(archive.save_runs(batch, root, "q-7")) == [("saved", 1)] * 3
    assert statuses(archive.save_runs(batch, root, "q-7")) == [("saved", 1)] * 3
    assert statuses(archive.save_runs(batch, root, "q-8")) == [("repeated", 1)] * 3
    assert archive.read(spark, root, "runs").count() == 4


def test_a_stream_saves_its_batches(spark, root, tmp_path):
    arts, _ = saved(spark, root, tmp_path)
    folder = str(tmp_path / "landed")
    for topic in ("a", "b"):
        rows(spark, [run(arts, topic=topic)], RUN).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(spark.createDataFrame([], RUN).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = stream.writeStream.foreachBatch(lambda df, n: archive.save_runs(df, root, f"stream-{n}")).option("checkpointLocation", f"{root}-progress").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["batch"] for r in archive.read(spark, root, "runs").collect()) == ["first", "stream-0", "stream-1"]


def test_reviews_and_verification(spark, root, tmp_path):
    arts, _ = saved(spark, root, tmp_path)
    run_id = archive.read(spark, root, "runs").first()["run_id"]
    given = [review(run_id), review(run_id), review("nobody"), review(run_id, thesis_status="sure"), review(run_id, realized_return_pct=float("inf")), review(run_id, observed_at="2026-10-01", artifacts=arts[:1])]
    outcome = archive.add_reviews(rows(spark, given, REVIEW), root, "r1")
    assert statuses(outcome) == [("invalid", 1), ("invalid", 1), ("invalid", 1), ("saved", 1), ("saved", 2)]
    assert statuses(archive.add_reviews(rows(spark, given[:1], REVIEW), root, "r2")) == [("repeated", 1)]
    assert {r["excess_return_pct"] for r in archive.read(spark, root, "reviews").collect()} == {2.5}
    assert archive.verify_store(spark, root).count() == 0
    runs, reviews, objects = (archive.read(spark, root, p).cache() for p in ("runs", "reviews", "objects"))
    problems = lambda *parts: sorted((r["kind"], r["problem"]) for r in archive.verify(*parts).collect())
    assert problems(runs.withColumn("thesis", F.lit("after the event")), reviews, objects) == [("run", "run content fingerprint mismatch")]
    assert problems(runs.union(runs), reviews, objects) == [("run", "duplicate run id")]
    assert problems(runs, reviews.withColumn("note", F.lit("x")), objects) == [("review", "review content fingerprint mismatch")] * 2
    assert problems(runs.where("false"), reviews, objects) == [("review", "invalid review link")] * 2
    assert problems(runs, reviews.withColumn("run_content_fingerprint", F.lit("x")), objects) == [("review", "run fingerprint mismatch")] * 2
    assert problems(runs, reviews, objects.where(F.col("sha256") != arts[0]["sha256"])) == [("review", "missing object"), ("run", "missing object")]
    assert problems(runs, reviews, objects.withColumn("content", F.lit(b"x"))) == [("object", "checksum mismatch")] * 2
    moved = runs.withColumn("artifacts", F.expr("transform(artifacts, a -> named_struct('role', a.role, 'source_name', a.source_name, 'object_path', '../x', 'sha256', a.sha256, 'size_bytes', a.size_bytes, 'media_type', a.media_type))"))
    assert problems(moved, reviews, objects) == [("run", "invalid object path")] * 2


def test_an_empty_store(spark, root):
    assert archive.verify_store(spark, root).count() == 0
    assert archive.save_runs(spark.createDataFrame([], RUN), root, "none").count() == 0 and archive.read(spark, root, "runs").count() == 0
