"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Built from DataFrame operations alone. No window runs over a whole source: word counts are
summed by (source, band of the sampling key), bands are prefix-summed, and only the band in
which a source's budget runs out is ranked row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, free, repeated, row_digest

#: Rows that a band of the sampling key holds on average, so that the ranked band does not grow with the corpus.
BAND_ROWS = 1 << 15


def quality_weight(text: Column) -> Column:
    """A document's sampling weight, 0.25 to 1: the share of letters, digits and blanks in its text."""
    body = F.coalesce(text, F.lit(""))
    odd = F.length(F.regexp_replace(body, r"[\p{L}\p{Nd}\x20\x09-\x0D]+", ""))
    return F.when(F.length(body) == 0, F.lit(0.25)).otherwise(1 - F.lit(0.75) * odd / F.length(body))


def _sampled(docs: DataFrame, id_col: str, text_col: str, source_col: str, whole: bool) -> Column:
    """What sampling needs of a row, as a struct: a function of the row alone, so every pass over the table agrees.

    Where ``whole`` is set it holds the digest of all columns too.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(body)))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 1) / F.lit(2.0**48 + 1)
    return F.struct(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"),
        (-F.log(u) / quality_weight(F.col(text_col))).alias("key"), digest.alias("digest"), *([row_digest(docs).alias("row")] if whole else []),
    )


def _plan(slim: DataFrame, cap: float, most_sources: int) -> tuple[DataFrame, int]:
    """One row a source (__name, source_size, target, epochs, budget, edge, before), and the number of bands.

    Bands under ``edge`` are taken whole, those above not at all; ``before`` is what the former hold.
    """
    bands = max(4096, slim.count() // BAND_ROWS)
    words = slim.groupBy("source", _band(F.col("key"), bands).alias("band")).agg(F.sum("size").alias("words"))
    words = cut(words)
    sources = words.groupBy("source").agg(F.sum("words").alias("source_size"))
    if (count := sources.count()) > most_sources:
        raise ValueError(f"{count} sources, more than {most_sources}")
    targets = (
        source_targets(sources, cap)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("long"))
        .withColumn("budget", F.round(F.col("target"), 0).cast("long") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "__name")
    )
    fill = Window.partitionBy("source").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    filled = words.withColumn("before", F.coalesce(F.sum("words").over(fill), F.lit(0)))
    met = filled.join(F.broadcast(targets), F.col("source").eqNullSafe(F.col("__name"))).where(F.col("before") + F.col("words") > F.col("budget"))
    first = met.groupBy("__name").agg(F.min(F.struct("band", "before")).alias("first")).withColumnRenamed("__name", "__edge")
    plan = targets.join(first, F.col("__name").eqNullSafe(F.col("__edge")), "left").select(
        "__name", "source_size", "target", "epochs", "budget", F.coalesce("first.band", F.lit(bands + 1)).alias("edge"), F.coalesce("first.before", F.lit(0)).alias("before")
    )
    return cut(plan), bands


def _band(key: Column, bands: int) -> Column:
    """exp(-key) lies in (0, 1) and falls as the key rises, so bands of it are bands of the key."""
    return (F.lit(bands) * (1 - F.exp(-key))).cast("int")


def _edge(slim: DataFrame, plan: DataFrame, bands: int, by: tuple[str, ...]) -> DataFrame:
    """Of each source's edge band the distinct rows (``by``) with ``copies``, and of these ``full`` that are taken whole and ``rest``, the words of the next one.

    Rows that repeat are counted first, so that no window holds them one by one.
    """
    same = F.col("source").eqNullSafe(F.col("__name")) & (_band(F.col("key"), bands) == F.col("edge"))
    groups = slim.join(F.broadcast(plan), same).groupBy("source", "key", "digest", "size", "source_size", "target", "epochs", "budget", "before", *by).agg(F.count("*").alias("copies"))
    rank = Window.partitionBy("source").orderBy("key", "digest", *by).rowsBetween(Window.unboundedPreceding, -1)
    room = F.greatest(F.lit(0), F.col("budget") - F.col("before") - F.coalesce(F.sum(F.col("size") * F.col("copies")).over(rank), F.lit(0)))
    full = F.when(F.col("size") > 0, F.least(F.col("copies"), F.expr("room div size"))).otherwise(F.col("copies"))
    return groups.withColumn("room", room).withColumn("full", full).withColumn("rest", F.least(F.col("size"), F.col("room") - F.col("full") * F.col("size")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = 3.0, most_sources: int = 1_000_000) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, digest) for every row; digest is that of id and text.

    size is the number of words. Sources in order of code points, null last, weigh 1, 2, 3 in
    turn and share the sum of all sizes; a target stops at ``cap`` times its source's size and
    the excess goes to the others by weight. A source first gives whole epochs; the rest is
    selected in the order of keys -ln(u) / weight (u from a digest of id and text, weight from
    ``quality_weight``), documents being taken until the budget is met. The document in which it
    is met gives only the words that are left, so the source's sum is its target to the word.
    Null text has size 0 and takes 0. Keys that tie are ordered by the digest; rows that repeat are ordered among themselves by nothing but
    their place, which changes no multiset of results. Other columns are ignored, whatever their
    names. An empty table gives no rows. The plan holds one row a source and is sent to the tasks;
    more than ``most_sources`` sources are refused.
    """
    slim = cut(docs.select(_sampled(docs, id_col, text_col, source_col, False).alias("s")).select("s.*"))
    plan, bands = _plan(slim, cap, most_sources)
    band = _band(F.col("key"), bands)
    whole = slim.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("__name"))).where(band != F.col("edge")).withColumn("more", F.when(band < F.col("edge"), F.col("size")).otherwise(0))
    edge = _edge(slim, plan, bands, ("doc_id",))
    part = lambda n, more: F.struct(n.cast("long").alias("n"), more.cast("long").alias("more"))
    # of the copies of a row the first ones are taken whole, the next for the rest, the others not at all
    parts = F.array(part(F.col("full"), F.col("size")), part(F.least(F.lit(1), F.col("copies") - F.col("full")), F.col("rest")), part(F.col("copies") - F.col("full") - 1, F.lit(0)))
    edge = repeated(edge.withColumn("part", F.explode(parts)).withColumn("more", F.col("part.more")), F.col("part.n"))
    out = ["doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("more")).cast("long").alias("taken"), "source", "digest"]
    return whole.select(*out).unionByName(edge.select(*out))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = 3.0, most_sources: int = 1_000_000, most_sent: int = 200_000) -> DataFrame:
    """The rows of the mix, all columns: each row of ``docs`` as often as it is taken, the one at the cut if half of it is.

    Every row keeps its own columns. Rows of which all of the source or nothing is taken are decided where they stand,
    by a plan of one row a source; rows of the edge bands by their digests, which are sent to them up to ``most_sent`` (24 bytes each)
    and joined beyond, or where such rows repeat. Rows equal in every column
    are told apart by nothing, so the times they are taken are added up. Rows without words are taken no times.
    """
    s = free(docs, "__s")
    rows = docs.withColumn(s, _sampled(docs, id_col, text_col, source_col, True))
    slim = cut(rows.select(f"{s}.*"))
    plan, bands = _plan(slim, cap, most_sources)
    p, times = free(docs, "__plan"), free(docs, "__times")
    sent = F.broadcast(plan.select(F.struct("*").alias(p)))
    placed = rows.join(sent, F.col(f"{s}.source").eqNullSafe(F.col(f"{p}.__name")))
    band, size = _band(F.col(f"{s}.key"), bands), F.col(f"{s}.size")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    edge = band == F.col(f"{p}.edge")
    takes = F.when(size > 0, F.col(f"{p}.epochs") + (band < F.col(f"{p}.edge")).cast("long")).otherwise(0)
    half = ((F.col("full") < F.col("copies")) & (2 * F.col("rest") >= F.col("size"))).cast("long")
    groups = cut(_edge(slim, plan, bands, ("row",)).where("size > 0").select(F.unhex("row").alias(s), "copies", (F.col("copies") * F.col("epochs") + F.col("full") + half).alias(times)))
    mark = F.unhex(F.col(f"{s}.row"))
    if groups.count() <= most_sent and groups.where("copies > 1").isEmpty():
        sent = F.broadcast(groups.select(F.struct(s, times).alias(times)))
        taken = placed.join(sent, edge & (mark == F.col(f"{times}.{s}")), "left").select(*columns, F.when(edge, F.coalesce(F.col(f"{times}.{times}"), F.lit(0))).otherwise(takes).alias(times))
    else:
        cuts = placed.where(edge).select(*columns, mark.alias(s)).dropDuplicates([s]).join(groups.select(s, times), s).select(*columns, times)
        taken = placed.where(~edge).select(*columns, takes.alias(times)).unionByName(cuts)
    return repeated(taken, F.col(times)).select(*columns)


def source_targets(sources: DataFrame, cap: float) -> DataFrame:
    """(source, source_size, target): water-filling by one pass over sources sorted by cap / weight.

    With sources in ascending order of cap * size / weight, the first ones reach their cap; the
    level of the others is (total - caps before) / weights from here. ``sources`` has one row a source.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    w = sources.withColumn("weight", (1 + (F.row_number().over(named) - 1) % 3).cast("double")).withColumn("most", F.lit(cap) * F.col("source_size"))
    w = w.withColumn("reach", F.col("most") / F.col("weight"))
    order = Window.orderBy("reach", F.col("source").asc_nulls_last())
    before, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(ahead)
    w = w.withColumn("level", level).withColumn("open", F.col("reach") > F.col("level"))
    # the level that holds is the one of the first source that stays below its cap
    w = w.withColumn("held", F.min(F.when(F.col("open"), F.struct("reach", F.coalesce("source", F.lit("")), "level"))).over(everything))
    target = F.least(F.col("most"), F.coalesce(F.col("weight") * F.col("held.level"), F.col("most")))
    return w.select("source", "source_size", target.alias("target"))


SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS b, md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|', md5(coalesce(text, '')))) AS dg FROM documents),
e AS (SELECT doc_id, source, dg, len(regexp_extract_all(b, '{WORD}')) AS size, -ln((('0x' || substr(dg, 1, 12))::BIGINT + 1) / CAST({2**48 + 1} AS DOUBLE)) /
  (CASE WHEN length(b) = 0 THEN 0.25::DOUBLE ELSE 1 - 0.75::DOUBLE * length(regexp_replace(b, '[\p{{L}}\p{{Nd}}\x20\x09-\x0D]+', '', 'g')) / length(b) END) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM e GROUP BY 1),
r AS (SELECT *, 3.0::DOUBLE * source_size AS most, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS w FROM s),
l AS (SELECT *, most / w AS reach, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
  sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(most, coalesce(w * (SELECT arg_min(level, reach) FROM l WHERE reach > level), most)) AS target FROM l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-9) AS BIGINT) ELSE 0 END AS epochs FROM t),
p AS (SELECT e.doc_id, e.size, g.*, coalesce(sum(e.size) OVER (PARTITION BY e.source ORDER BY e.key, e.dg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e JOIN g ON e.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken FROM p
"""
