"""The journal's store: objects by digest, immutable runs and append-only reviews, by year and month, and its verification.

Every save carries the name of its batch, and what it adds goes to partitions of that batch. A batch that
is run again sees the store without itself and replaces its own partitions, so a stream's micro-batch can
be repeated. An id that is saved again with the same content is ``repeated``, with other content a
``conflict``: a row in the result, never a change of the store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import identifier
from ..plans.cuts import cut

# Words of runs and reviews.
STANCES = ("bullish", "bearish", "neutral", "mixed", "abstain", "not_applicable")
CONFIDENCES = ("low", "medium", "high", "unrated")
THESIS_STATES = ("confirmed", "partially_confirmed", "refuted", "unresolved")
QUALITIES = ("good", "mixed", "poor", "unrated")
# Media types by the file's suffix; any other is a plain sequence of bytes.
MEDIA = {
    ".json": "application/json", ".jsonl": "application/x-ndjson", ".md": "text/markdown", ".txt": "text/plain", ".pdf": "application/pdf", ".csv": "text/csv", ".tsv": "text/tab-separated-values",
}
BYTES = "application/octet-stream"

ARTIFACT = "struct<role:string,source_name:string,object_path:string,sha256:string,size_bytes:bigint,media_type:string>"
OBJECTS = "sha256 string, size_bytes bigint, media_type string, content binary, prefix string, batch string"
RUNS = (
    f"run_id string, content_fingerprint string, topic string, as_of string, horizon string, instruments array<string>, tags array<string>, stance string, decision string, confidence string, thesis string,"
    f" review_date string, artifacts array<{ARTIFACT}>, year int, month int, batch string"
)
REVIEWS = (
    f"review_id string, content_fingerprint string, run_id string, run_content_fingerprint string, observed_at string, thesis_status string, realized_return_pct double, benchmark_return_pct double,"
    f" excess_return_pct double, decision_quality string, note string, tags array<string>, artifacts array<{ARTIFACT}>, year int, month int, batch string"
)


def read(spark: SparkSession, root: str, part: str) -> DataFrame:
    """The store's ``objects``, ``runs`` or ``reviews``; one that holds nothing yet is empty."""
    schema = {"objects": OBJECTS, "runs": RUNS, "reviews": REVIEWS}[part]
    try:
        return spark.read.schema(schema).parquet(f"{root}/{part}")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def _suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))


def is_secret(name: Column) -> Column:
    """Names of files that likely hold secrets; they are not archived."""
    return (name == ".env") | _suffix(name).isin(".secret", ".secrets")


def as_artifacts(files: DataFrame, name: str = "path") -> DataFrame:
    """Landed files (``name``, content) with digest, place, size and media type, and whether they are refused as likely secrets."""
    own = F.regexp_extract(name, r"([^/\\]*)$", 1)
    kinds = F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair])
    out = files.withColumns({"source_name": own, "sha256": F.sha2("content", 256), "size_bytes": F.length("content").cast("bigint")})
    return out.withColumns({
        "media_type": F.coalesce(kinds[_suffix(F.col("source_name"))], F.lit(BYTES)), "object_path": F.concat(F.lit("objects/"), F.left("sha256", F.lit(2)), F.lit("/"), F.col("sha256")), "refused": is_secret(F.col("source_name")),
    })


def save_objects(artifacts: DataFrame, root: str, batch: str) -> DataFrame:
    """Stores each content once, however often and under whatever names it comes. Returns (sha256, status): saved, repeated or refused.

    Refused files are not read into the store; a digest that comes both refused and not is stored. Only contents that the store lacks are shuffled.
    """
    spark = artifacts.sparkSession
    held = read(spark, root, "objects").where(F.col("batch") != batch).select("sha256")
    kept = artifacts.where("NOT refused").select("sha256", "size_bytes", "media_type", "content")
    fresh = kept.join(held, "sha256", "left_anti").dropDuplicates(["sha256"])
    _replace(fresh.withColumns({"prefix": F.left("sha256", F.lit(2)), "batch": F.lit(batch)}), f"{root}/objects", "prefix", "batch")
    known = held.withColumn("held", F.lit(True))
    status = F.when(~F.col("kept"), "refused").when(F.col("held"), "repeated").otherwise("saved")
    return artifacts.groupBy("sha256").agg(F.bool_or(~F.col("refused")).alias("kept")).join(known, "sha256", "left").select("sha256", status.alias("status"))


def _replace(rows: DataFrame, path: str, *parts: str) -> None:
    """Writes partitions, replacing those that the rows fall into."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def _words(c: Column) -> Column:
    """Trimmed, with single blanks; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def _list(c: Column) -> Column:
    """The items of a list that are not blank, in order, each once."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), _words), lambda x: x != ""))


def _once(artifacts: str) -> Column:
    """Artifacts by (role, digest), the first one of each."""
    return F.expr(f"filter({artifacts}, (a, i) -> NOT exists(slice({artifacts}, 1, i), b -> b.role <=> a.role AND b.sha256 <=> a.sha256))")


def _digest(fields: dict[str, Column]) -> Column:
    """Digest of the content as canonical JSON: keys in order, no blanks, nulls written."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


_refs = lambda: F.transform("artifacts", lambda a: F.struct(a["role"].alias("role"), a["sha256"].alias("sha256")))


def run_fingerprint() -> Column:
    summary = F.struct(*[F.col(c) for c in ("confidence", "decision", "review_date", "stance", "thesis")])
    return _digest({"topic": F.col("topic"), "as_of": F.col("as_of"), "horizon": F.col("horizon"), "instruments": F.col("instruments"), "tags": F.col("tags"), "summary": summary, "artifacts": _refs()})


def review_fingerprint() -> Column:
    plain = ("run_id", "observed_at", "thesis_status", "realized_return_pct", "benchmark_return_pct", "excess_return_pct", "decision_quality", "note", "tags")
    return _digest({**{c: F.col(c) for c in plain}, "artifacts": _refs()})


def _starts_with_date(c: Column) -> Column:
    return F.coalesce(F.regexp_like(c, F.lit(r"^\d{4}-\d{2}-\d{2}")) & F.left(c, F.lit(10)).try_cast("date").isNotNull(), F.lit(False))


def _invalid(c: str, words: tuple[str, ...]) -> tuple[Column, str]:
    return ~F.coalesce(F.col(c).isin(*words), F.lit(False)), f"invalid {c}"


def _reason(faults: list[tuple[Column, str]]) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(broken, F.lit(text)) for broken, text in faults])), "; ")


def _dated(c: str) -> dict[str, Column]:
    return {"year": F.substring(c, 1, 4).try_cast("int"), "month": F.substring(c, 6, 2).try_cast("int")}


def prepare_runs(runs: DataFrame) -> DataFrame:
    """Runs as they are stored, and ``reason``, empty where nothing stands against storing them.

    Reads topic, as_of, horizon, instruments, tags, stance, decision, confidence, thesis, review_date, artifacts (the conclusion first) and run_id; a run without an
    id gets one from its day, topic and content. Other columns are left out.
    """
    default = lambda c, word: F.coalesce(F.col(c), F.lit(word)).alias(c)
    r = runs.select(
        F.col("run_id").alias("asked"), _words(F.col("topic")).alias("topic"), F.trim(F.coalesce("as_of", F.lit(""))).alias("as_of"), F.trim(F.coalesce("horizon", F.lit(""))).alias("horizon"), _list(F.col("instruments")).alias("instruments"), _list(F.col("tags")).alias("tags"),
        default("stance", "not_applicable"), _words(F.col("decision")).alias("decision"), default("confidence", "unrated"), _words(F.col("thesis")).alias("thesis"), F.nullif(F.trim("review_date"), F.lit("")).alias("review_date"), _once("artifacts").alias("artifacts"),
    )
    r = r.withColumn("content_fingerprint", run_fingerprint())
    made = F.concat_ws("-", F.regexp_replace(F.left("as_of", F.lit(10)), "[^0-9]", ""), F.left(identifier(F.col("topic")), F.lit(40)), F.left("content_fingerprint", F.lit(10)))
    faults = [
        _invalid("stance", STANCES), _invalid("confidence", CONFIDENCES), ((F.col("topic") == "") | (F.col("as_of") == "") | (F.col("horizon") == ""), "topic, as_of and horizon are required"), (~_starts_with_date(F.col("as_of")), "as_of is no date"),
        (F.col("review_date").isNotNull() & ~_starts_with_date(F.col("review_date")), "review_date is no date"), (F.coalesce(F.size("artifacts"), F.lit(0)) < 1, "no conclusion"),
    ]
    return r.withColumn("run_id", F.when(F.coalesce(F.trim("asked"), F.lit("")) == "", made).otherwise(identifier(F.col("asked")))).withColumn("reason", _reason(faults)).drop("asked")


def prepare_reviews(reviews: DataFrame, runs: DataFrame) -> DataFrame:
    """Reviews as they are stored, with the reason that stands against it; ``runs`` are those that the store has."""
    known = runs.select("run_id", F.col("content_fingerprint").alias("run_content_fingerprint")).dropDuplicates(["run_id"])
    finite = lambda c: F.col(c).isNull() | (~F.isnan(c) & (F.abs(c) < float("inf")))
    r = reviews.select(
        "run_id", F.trim(F.coalesce("observed_at", F.lit(""))).alias("observed_at"), "thesis_status", F.col("realized_return_pct").cast("double").alias("realized_return_pct"), F.col("benchmark_return_pct").cast("double").alias("benchmark_return_pct"),
        F.coalesce("decision_quality", F.lit("unrated")).alias("decision_quality"), _words(F.col("note")).alias("note"), _list(F.col("tags")).alias("tags"), F.coalesce("artifacts", F.expr(f"CAST(array() AS array<{ARTIFACT}>)")).alias("artifacts"),
    )
    r = r.withColumn("excess_return_pct", F.round(F.col("realized_return_pct") - F.col("benchmark_return_pct"), 6)).withColumn("content_fingerprint", review_fingerprint())
    r = r.withColumn("review_id", F.concat_ws("-", F.regexp_replace(F.left("observed_at", F.lit(10)), "[^0-9]", ""), F.left("content_fingerprint", F.lit(10)))).join(known, "run_id", "left")
    faults = [
        _invalid("thesis_status", THESIS_STATES), _invalid("decision_quality", QUALITIES), (~_starts_with_date(F.col("observed_at")), "observed_at is no date"), (F.col("run_content_fingerprint").isNull(), "unknown run"),
        (~(finite("realized_return_pct") & finite("benchmark_return_pct")), "returns are not finite"),
    ]
    return r.withColumn("reason", _reason(faults))


def append(prepared: DataFrame, root: str, part: str, key: list[str], day: str, batch: str) -> DataFrame:
    """Adds what the store lacks to the partitions of (year, month, batch); (key, content_fingerprint, status, reason, rows) for each distinct content.

    Of several contents under one id in a batch the one of the least fingerprint is stored, the others are conflicts. Rows that repeat are counted before they meet.
    """
    spark = prepared.sparkSession
    schema = spark.createDataFrame([], {"runs": RUNS, "reviews": REVIEWS}[part]).schema
    held = read(spark, root, part).where(F.col("batch") != batch).groupBy(*key).agg(F.min("content_fingerprint").alias("held"))
    body = [f.name for f in schema if f.name not in (*key, "content_fingerprint", "year", "month", "batch")]
    each = prepared.groupBy(*key, "content_fingerprint", "reason").agg(F.any_value(F.struct(*body)).alias("body"), F.count("*").alias("rows"))
    each = cut(each.join(held, key, "left"))
    valid = F.col("reason") == ""
    first = F.row_number().over(Window.partitionBy(*key, valid).orderBy("content_fingerprint"))
    status = (
        F.when(~valid, "invalid").when(F.col("held") == F.col("content_fingerprint"), "repeated").when(F.col("held").isNotNull() | (F.col("first") > 1), "conflict").otherwise("saved")
    )
    each = each.withColumn("first", first).withColumn("status", status)
    fresh = each.where("status = 'saved'").select(*key, "content_fingerprint", "body.*").withColumns({**_dated(day), "batch": F.lit(batch)})
    _replace(fresh.select(*schema.names), f"{root}/{part}", "year", "month", "batch")
    return each.select(*key, "content_fingerprint", "status", "reason", "rows")


def save_runs(runs: DataFrame, root: str, batch: str) -> DataFrame:
    """Stores runs; see ``append`` for the result. A stream saves its batches under its own name and their numbers."""
    return append(prepare_runs(runs), root, "runs", ["run_id"], "as_of", batch)


def add_reviews(reviews: DataFrame, root: str, batch: str) -> DataFrame:
    """Stores reviews of runs that the store has; the same content again is ``repeated``."""
    known = read(reviews.sparkSession, root, "runs")
    return append(prepare_reviews(reviews, known), root, "reviews", ["run_id", "review_id"], "observed_at", batch)


def verify(runs: DataFrame, reviews: DataFrame, objects: DataFrame) -> DataFrame:
    """(kind, id, problem): everything that does not fit in a store.

    Digests are worked out again where the rows stand; links between runs, reviews and objects are anti-joins on ids and digests, so no content moves.
    """
    row = lambda df, kind, name, problem: df.select(F.lit(kind).alias("kind"), F.col(name).alias("id"), F.lit(problem).alias("problem"))
    twice = runs.groupBy("run_id").agg(F.count("*").alias("n")).where("n > 1")
    fingerprints = runs.groupBy("run_id").agg(F.min("content_fingerprint").alias("is"))
    linked = reviews.join(fingerprints, "run_id", "left")
    found = [
        row(runs.where(run_fingerprint() != F.col("content_fingerprint")), "run", "run_id", "run content fingerprint mismatch"), row(twice, "run", "run_id", "duplicate run id"),
        row(linked.where("is IS NULL"), "review", "review_id", "invalid review link"), row(linked.where(F.col("is") != F.col("run_content_fingerprint")), "review", "review_id", "run fingerprint mismatch"),
        row(reviews.where(review_fingerprint() != F.col("content_fingerprint")), "review", "review_id", "review content fingerprint mismatch"),
        row(objects.where(F.sha2("content", 256) != F.col("sha256")), "object", "sha256", "checksum mismatch"),
    ]
    there = objects.select("sha256").distinct()
    for kind, rows, name in (("run", runs, "run_id"), ("review", reviews, "review_id")):
        a = rows.select(F.col(name).alias("id"), F.explode("artifacts").alias("a")).select("id", "a.sha256", "a.object_path")
        blank = (F.coalesce("sha256", F.lit("")) == "") | (F.coalesce("object_path", F.lit("")) == "")
        inside = F.regexp_like("object_path", F.lit(r"^objects/(?!(.*/)?\.\.(/|$))"))
        found += [row(a.where(blank), kind, "id", "incomplete artifact record"), row(a.where(~blank & ~inside), kind, "id", "invalid object path"), row(a.where(~blank & inside).join(there, "sha256", "left_anti"), kind, "id", "missing object")]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def verify_store(spark: SparkSession, root: str) -> DataFrame:
    return verify(read(spark, root, "runs"), read(spark, root, "reviews"), read(spark, root, "objects"))
