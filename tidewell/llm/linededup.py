"""Line deduplication with content-defined chunks, in DataFrame operations alone.

A text's lines are hashed; a rolling hash over the last WINDOW line hashes ends a chunk where it
is less than at both neighbours, so the same lines give the same chunks wherever they are moved to.
A chunk of several lines that stands earlier in the corpus already, byte for byte, is removed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_classes

#: Lines in the rolling hash, and the lines after which a chunk is cut.
WINDOW, LONGEST = 2, 16
PRIME, MODULUS = 1_000_003, 2**31 - 1
#: Bytes of the places of shared chunks up to which they are sent to every task (64 a row and 64 a place, all
#: of fixed width); beyond, texts and places are shuffled by row.
MOST_SENT = 32 << 20
#: A chunk without a letter or digit is never removed.
SOLID = r"[\p{L}\p{N}]"


def line_hash(line: Column) -> Column:
    """A whole number below 2**28 from the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def rolled(hashes: str) -> Column:
    """The rolling hash at each line."""

    def one(i: Column) -> Column:
        terms = [F.coalesce(F.get(F.col(hashes), i - age), F.lit(0)) * F.lit(PRIME**age) for age in range(WINDOW)]
        return reduce(lambda a, b: a + b, terms) % MODULUS

    return F.transform(hashes, lambda h, i: one(i))


def chunk_spans(lines: Column, rolls: str) -> Column:
    """Array of (s, n), the first line (from 0) and the number of lines of each chunk.

    A line ends a chunk where the rolling hash there, the sum of hash * PRIME**age over the line
    and the WINDOW - 1 before it modulo MODULUS, is less than at the line before and not more than at the line after; so ends
    are two lines apart or more, three on average. The first line and the last but one end none and the last one does, so only a text of one line is a chunk of one.
    What is longer than LONGEST + 1 lines is cut every LONGEST lines from its start, a rest of one line left on.
    """
    last = F.size(lines) - 1

    least = lambda i: (F.get(rolls, i) < F.get(rolls, i - 1)) & (F.get(rolls, i) <= F.get(rolls, i + 1))
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | ((i > 0) & (i < last - 1) & least(i)))
    starts = F.slice(F.concat(F.array(F.lit(0)), F.transform(ends, lambda e: e + 1)), F.lit(1), F.size(ends))
    pieces = F.zip_with(ends, starts, lambda e, s: F.transform(F.sequence(s, F.greatest(s, e - 1), F.lit(LONGEST)), lambda p: F.struct(p.alias("s"), F.when(p + LONGEST < e, LONGEST).otherwise(e - p + 1).alias("n"))))
    return F.flatten(pieces)


def joined(lines: Column, span: Column) -> Column:
    return F.array_join(F.slice(lines, span["s"] + 1, span["n"]), "\n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None, most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, text, n_lines, removed_lines, removed_chunks) for every row; text is what stays.

    Of equal chunks of two lines or more the one with the least (doc_id, place) stays, a null id
    first. Chunks are found equal by digest and length, which alone are shuffled; then the texts of those that
    share them are grouped by their bytes, and where one digest has several texts, each text counts on its own. Lines end at \\n. Null texts stay null with 0
    lines; rows that repeat whole (id and text) have one fate, that of one row; an empty table
    gives no rows. ``digest`` replaces the digest of a chunk (column ``chunk``), for tests.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    lines = F.split("text", "\n", -1)
    spans = (
        base.where("text IS NOT NULL").select("doc_id", "row", lines.alias("lines")).withColumn("h", F.transform("lines", line_hash))
        .withColumn("rolls", rolled("h"))  # a column of its own: worked out once a text, not once a line
        .select("doc_id", "row", "lines", F.explode(chunk_spans(F.col("lines"), "rolls")).alias("span")).where("span.n > 1")
        .select("doc_id", "row", "span", joined(F.col("lines"), F.col("span")).alias("chunk")).where(F.regexp_like("chunk", F.lit(SOLID)))
    )
    key = F.xxhash64("chunk") if digest is None else digest
    found = cut(spans.select("doc_id", "row", "span", key.alias("h"), F.octet_length("chunk").alias("size")))
    place = F.struct("doc_id", "row", F.col("span.s").alias("s"))
    shared = cut(found.groupBy("h", "size").agg(F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1"))
    marks = cut(
        join_classes(found, shared, ["h", "size"]).groupBy("doc_id", "row")
        .agg(F.collect_set(F.struct("span.s", "span.n", "h", "size", F.coalesce((F.col("first.row") != F.col("row")) | (F.col("first.s") != F.col("span.s")), F.lit(True)).alias("later"))).alias("marks"))
    )
    rows, places = marks.agg(F.count("*"), F.coalesce(F.sum(F.size("marks")), F.lit(0))).first()
    few = 64 * (rows + places) <= most_sent
    slim = marks.select(F.col("row").alias("__row"), F.col("doc_id").alias("__doc"), "marks")

    def attach(how: str) -> DataFrame:
        same = (F.col("row") == F.col("__row")) & F.col("doc_id").eqNullSafe(F.col("__doc"))
        return base.join(F.broadcast(slim) if few else slim, same, how).drop("__row", "__doc")

    # the bytes: chunks that share a digest are grouped by their texts
    texts = attach("inner").select("doc_id", "row", lines.alias("lines"), F.explode("marks").alias("m"))
    texts = texts.select("doc_id", "row", F.col("m.s").alias("s"), F.col("m.h").alias("h"), F.col("m.size").alias("size"), joined(F.col("lines"), F.col("m")).alias("chunk"))
    groups = texts.groupBy("h", "size", "chunk").agg(F.min(F.struct("doc_id", "row", "s")).alias("first"))
    mixed = groups.groupBy("h", "size").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    out = attach("left")
    if not mixed.isEmpty():  # digests that collide: each text has a first of its own
        own = texts.join(mixed, ["h", "size"]).join(groups, ["h", "size", "chunk"])
        own = own.where((F.col("first.row") == F.col("row")) & (F.col("first.s") == F.col("s"))).groupBy("row").agg(F.collect_set("s").alias("firsts"))
        clash = texts.join(mixed, ["h", "size"]).groupBy("row").agg(F.collect_set("s").alias("clashes"))
        out = out.join(own, "row", "left").join(clash, "row", "left").withColumn(
            "marks",
            F.transform("marks", lambda m: m.withField("later", F.when(F.coalesce(F.array_contains("clashes", m["s"]), F.lit(False)), ~F.coalesce(F.array_contains("firsts", m["s"]), F.lit(False))).otherwise(m["later"]))),
        )
    gone = F.filter("marks", lambda m: m["later"])
    out = out.withColumn("gone", F.coalesce(gone, F.array().cast(out.schema["marks"].dataType)))
    kept = F.filter(lines, lambda x, i: ~F.exists("gone", lambda m: (m["s"] <= i) & (i < m["s"] + m["n"])))
    return out.select(
        "doc_id", F.when(F.size("gone") > 0, F.array_join(kept, "\n")).otherwise(F.col("text")).alias("text"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.aggregate("gone", F.lit(0), lambda a, m: a + m["n"]).cast("long").alias("removed_lines"), F.size("gone").cast("long").alias("removed_chunks"),
    )


SQL = f"""
WITH base AS (SELECT doc_id, text FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM base WHERE text IS NOT NULL),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM lines),
rolled AS (
  SELECT *, (h + COALESCE(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) * {PRIME}) % {MODULUS} AS roll, max(i) OVER (PARTITION BY doc_id) AS last FROM hashed),
ended AS (SELECT *, i = last OR (i > 0 AND i < last - 1 AND roll < lag(roll) OVER (PARTITION BY doc_id ORDER BY i) AND roll <= lead(roll) OVER (PARTITION BY doc_id ORDER BY i)) AS ends FROM rolled),
segments AS (
  SELECT *, COALESCE(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM ended),
placed AS (SELECT *, least((i - min(i) OVER (PARTITION BY doc_id, seg)) // {LONGEST}, greatest(0, max(i) OVER (PARTITION BY doc_id, seg) - min(i) OVER (PARTITION BY doc_id, seg) - 1) // {LONGEST}) AS piece FROM segments),
chunks AS (
  SELECT doc_id, min(i) AS s, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM placed GROUP BY doc_id, seg, piece),
ranked AS (
  SELECT *, n > 1 AND regexp_matches(chunk, '{SOLID}') AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, s) > 1 AS gone FROM chunks),
out AS (
  SELECT doc_id, string_agg(chunk, chr(10) ORDER BY s) FILTER (NOT gone) AS text, sum(n) AS n_lines,
         COALESCE(sum(n) FILTER (gone), 0) AS removed_lines, count(*) FILTER (gone) AS removed_chunks
  FROM ranked GROUP BY doc_id)
SELECT b.doc_id, CASE WHEN b.text IS NULL THEN NULL ELSE COALESCE(o.text, '') END AS text, CAST(COALESCE(o.n_lines, 0) AS BIGINT) AS n_lines,
       CAST(COALESCE(o.removed_lines, 0) AS BIGINT) AS removed_lines, CAST(COALESCE(o.removed_chunks, 0) AS BIGINT) AS removed_chunks
FROM base b LEFT JOIN out o ON b.doc_id = o.doc_id
"""
