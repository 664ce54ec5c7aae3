"""Queries over the journal's store: the documents are saved as runs, the labels as their reviews, with repeats, conflicts and faults planted by key."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import archive
from ..sources import panels
from .cuts import cut, shared_dir


def _artifacts(spark, d):
    x = panels.table(spark, d, "documents").select(F.col("doc_id").alias("k"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    name = F.expr("CASE WHEN k % 53 = 0 THEN '.env' ELSE concat('doc-', k, if(k % 2 = 0, '.txt', '.json')) END")
    return archive.as_artifacts(x.withColumn("path", F.concat(F.lit("/landed/"), name)))


def _runs(artifacts):
    fields = F.struct(F.lit("conclusion").alias("role"), "source_name", "object_path", "sha256", "size_bytes", "media_type")
    none = F.expr(f"CAST(array() AS array<{archive.ARTIFACT}>)")
    return artifacts.select(
        "k", F.concat(F.lit("run-"), F.col("k")).alias("run_id"), F.lit("topic").alias("topic"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("k") % 300).cast("int")).cast("string").alias("as_of"), F.lit("20d").alias("horizon"), F.array(F.lit("600001")).alias("instruments"),
        F.array().cast("array<string>").alias("tags"), F.expr("if(k % 7 = 0, 'sideways', 'neutral')").alias("stance"), F.lit("wait").alias("decision"), F.lit("low").alias("confidence"), F.concat(F.lit("thesis "), F.col("k")).alias("thesis"), F.lit(None).cast("string").alias("review_date"),
        F.when(F.col("refused"), none).otherwise(F.array(fields)).alias("artifacts"),
    )


def _saved(spark, d):
    """A new store, and what came of saving everything, and of saving every fifth run again, half of these with another thesis."""
    root = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    artifacts = _artifacts(spark, d)
    objects = archive.save_objects(artifacts, root, "first")
    runs = cut(_runs(artifacts.drop("content")))
    first = archive.save_runs(runs, root, "first")
    again = runs.where("k % 5 = 0").withColumn("thesis", F.expr("if(k % 10 = 0, 'another', thesis)"))
    second = archive.save_runs(again, root, "second")
    named = lambda df, batch: df.select(F.lit(batch).alias("batch"), F.lit("run").alias("kind"), "status", "reason", "rows")
    objects = objects.select(F.lit("first").alias("batch"), F.lit("object").alias("kind"), "status", F.lit("").alias("reason"), F.lit(1).cast("bigint").alias("rows"))
    return root, objects.unionByName(named(first, "first")).unionByName(named(second, "second"))


def archive_saves(spark, d):
    return _saved(spark, d)[1].groupBy("batch", "kind", "status", "reason").agg(F.sum("rows").alias("n"))


def _reviews(spark, d):
    k = F.col("doc_id")
    note = F.when(k % 4 == 0, "late").otherwise("in time")
    none = F.expr(f"CAST(NULL AS array<{archive.ARTIFACT}>)").alias("artifacts")
    return panels.table(spark, d, "labels").select(
        F.concat(F.lit("run-"), k).alias("run_id"), F.lit("2025-01-01").alias("observed_at"), F.when(F.col("toxic") == 1, "refuted").when(F.col("quality") == 1, "confirmed").otherwise("unsure").alias("thesis_status"), (k % 100 / 10).alias("realized_return_pct"), F.lit(1.0).alias("benchmark_return_pct"),
        F.lit("good").alias("decision_quality"), note.alias("note"), F.array().cast("array<string>").alias("tags"), none,
    )


def archive_verification(spark, d):
    """A store that is read back with theses and notes rewritten, objects lost and others changed. A review is named by its run."""
    root, _ = _saved(spark, d)
    archive.add_reviews(_reviews(spark, d), root, "reviews")
    runs, reviews, objects = (archive.read(spark, root, p) for p in ("runs", "reviews", "objects"))
    k = F.substring("run_id", 5, 20).cast("bigint")
    names = reviews.select("review_id", "run_id")
    runs = runs.withColumn("thesis", F.when(k % 97 == 1, "rewritten").otherwise(F.col("thesis")))
    reviews = reviews.where(k % 89 != 3).withColumn("note", F.when(k % 83 == 2, "rewritten").otherwise(F.col("note"))).unionByName(reviews.where(k % 89 == 3).withColumn("run_id", F.lit("run-none")))
    objects = objects.where("prefix NOT LIKE '7%'").withColumn("content", F.when(F.startswith("prefix", F.lit("a")), F.encode(F.lit("changed"), "UTF-8")).otherwise(F.col("content")))
    found = archive.verify(runs, reviews, objects).join(names, F.col("id") == F.col("review_id"), "left")
    return found.select("kind", F.coalesce("run_id", "id").alias("id"), "problem")


_DOCS = "WITH d AS (SELECT doc_id AS k, coalesce(text, '') AS t, doc_id % 53 = 0 AS secret, doc_id % 7 = 0 AS odd, sha256(coalesce(text, '')) AS sha FROM documents)"
SAVES_SQL = _DOCS + """,
o AS (SELECT t, bool_or(NOT secret) AS kept FROM d GROUP BY 1),
r AS (SELECT 'first' AS batch, 'run' AS kind, CASE WHEN secret OR odd THEN 'invalid' ELSE 'saved' END AS status, concat_ws('; ', CASE WHEN odd THEN 'invalid stance' END, CASE WHEN secret THEN 'no conclusion' END) AS reason FROM d
  UNION ALL SELECT 'second', 'run', CASE WHEN secret OR odd THEN 'invalid' WHEN k % 10 = 0 THEN 'conflict' ELSE 'repeated' END, concat_ws('; ', CASE WHEN odd THEN 'invalid stance' END, CASE WHEN secret THEN 'no conclusion' END) FROM d WHERE k % 5 = 0
  UNION ALL SELECT 'first', 'object', CASE WHEN kept THEN 'saved' ELSE 'refused' END, '' FROM o)
SELECT batch, kind, status, reason, count(*) AS n FROM r GROUP BY ALL"""
VERIFY_SQL = _DOCS + """,
ok AS (SELECT * FROM d WHERE NOT secret AND NOT odd),
v AS (SELECT doc_id AS k FROM labels WHERE doc_id IN (SELECT k FROM ok) AND (toxic = 1 OR quality = 1)),
o AS (SELECT DISTINCT sha FROM d WHERE NOT secret)
SELECT 'run' AS kind, 'run-' || k AS id, 'run content fingerprint mismatch' AS problem FROM ok WHERE k % 97 = 1
UNION ALL SELECT 'run', 'run-' || k, 'missing object' FROM ok WHERE sha LIKE '7%'
UNION ALL SELECT 'object', sha, 'checksum mismatch' FROM o WHERE sha LIKE 'a%'
UNION ALL SELECT 'review', 'run-' || k, 'invalid review link' FROM v WHERE k % 89 = 3
UNION ALL SELECT 'review', 'run-' || k, 'review content fingerprint mismatch' FROM v WHERE k % 89 = 3 OR k % 83 = 2"""

QUERIES = {"archive_saves": (archive_saves, SAVES_SQL), "archive_verification": (archive_verification, VERIFY_SQL)}
