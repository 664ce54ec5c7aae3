"""Phrase collocation mining by PCY and DHP hashing, level by level.

Pass k reads the texts, counts phrases of k words exactly and, while it is there, counts phrases of
k + 1 words by hash bucket. A phrase of k words is counted only if its bucket reached the support in
the pass before (PCY) and both of its parts of k - 1 words are frequent (Apriori); a phrase of k + 1
words enters a bucket only if its parts of k words may be counted (DHP). Both tests go to the tasks
as bitmaps whose size is fixed by ``BUCKETS``: a frequent phrase of k - 1 words is one bit too, so
that what is sent never grows with the vocabulary. A bit that two phrases share costs work only, as
the counts that decide are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import settle, small_batches

#: Bits of a bitmap. More keep their power over larger corpora; results do not depend on it.
BUCKETS = 1 << 24
#: Buckets travel in blocks of this many.
BLOCK = 1 << 16
#: Texts are counted in chunks of about this many bytes.
CHUNK = 1 << 23
#: A-Z to a-z, ends of pieces to line feeds, tabs to blanks.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?" or 10 <= c <= 13 else 32 if c == 9 else c for c in range(256))
#: Odd multipliers that set the words of a phrase apart by their place.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)

_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("count", pa.int64())])
_BLOCKS = pa.schema([("block", pa.int32()), ("counts", pa.binary())])
_PASS = pa.schema([*_COUNTS, *_BLOCKS])


class _Chunk:
    """The words of some texts of one language: their numbers in the chunk's vocabulary, and where pieces end."""

    def __init__(self, lang: str, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts).translate(_BYTES), np.uint8)
        gap = (raw == 32) | (raw == 10)
        begins = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        ends = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]])) + 1
        offsets = np.zeros(len(begins) + 1, np.int64)
        np.cumsum(ends - begins, out=offsets[1:])
        words = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[~gap].tobytes())]).dictionary_encode()
        self.lang = lang
        self.ids = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = words.dictionary.to_pylist()
        #: the number of words of the piece from here on, at most 5
        piece = np.searchsorted(np.flatnonzero(raw == 10), begins)
        self.left = np.ones(len(begins), np.int64)
        for k in range(1, 5):
            self.left[:-k] += (piece[k:] == piece[:-k]) if len(piece) > k else 0
        seed = xxhash.xxh64_intdigest(lang.encode())
        self.hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.words], np.uint64)

    def starts(self, k: int) -> np.ndarray:
        """Where phrases of ``k`` words begin."""
        return np.flatnonzero(self.left >= k)

    def buckets(self, at: np.ndarray, k: int, buckets: int) -> np.ndarray:
        return _bucket(self.hashes[self.ids[at[:, None] + np.arange(k)]], buckets) if len(at) else np.zeros(0, np.int64)

    def counted(self, at: np.ndarray, k: int) -> tuple[list[bytes], np.ndarray]:
        """The distinct phrases of ``k`` words that begin at ``at``, and how often each does."""
        number = self.ids[at]
        for place in range(1, k):
            number = pd.factorize(number * len(self.words) + self.ids[at + place])[0]
        _, first, counts = np.unique(number, return_index=True, return_counts=True)
        words = self.words
        return [b" ".join([words[i] for i in row]) for row in self.ids[at[first][:, None] + np.arange(k)].tolist()], counts


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each row of word hashes."""
    with np.errstate(over="ignore"):
        mixed = (hashes * _PLACES[: hashes.shape[1]]).sum(axis=1, dtype=np.uint64)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    return (mixed % np.uint64(buckets)).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
    """Texts by language, some ``CHUNK`` bytes at a time; a text is never divided."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist()):
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size > CHUNK:
                yield from (_Chunk(*entry) for entry in held.items())
                held, size = {}, 0
    yield from (_Chunk(*entry) for entry in held.items())


def _admitted(chunk: _Chunk, k: int, buckets: int, busy: np.ndarray | None, parts: np.ndarray | None) -> np.ndarray:
    """Whether a phrase of ``k`` words that may be frequent begins at each word: by its bucket and by its parts."""
    found = np.zeros(len(chunk.ids) + 1, bool)
    at = chunk.starts(k)
    if k > 1:
        part = np.zeros(len(chunk.ids) + 1, bool)
        shorter = chunk.starts(k - 1)
        part[shorter] = _set(parts, chunk.buckets(shorter, k - 1, buckets))
        at = at[part[at] & part[at + 1]]
        at = at[_set(busy, chunk.buckets(at, k, buckets))]
    found[at] = True
    return found


def _set(bitmap: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (bitmap[buckets >> 3] >> (7 - (buckets & 7)).astype(np.uint8)) & 1 == 1


def _packed(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Blocks with counts, as (place, count) pairs where few are, else one byte a bucket."""
    for block in range(0, len(counts), BLOCK):
        some = counts[block : block + BLOCK]
        at = np.flatnonzero(some)
        if len(at):
            yield block // BLOCK, some.tobytes() if 3 * len(at) >= len(some) else at.astype(np.uint16).tobytes() + some[at].tobytes() + b"\x00"


def _unpack_into(total: np.ndarray, counts: bytes, most: int) -> None:
    """Adds the counts of a packed block; they stop at ``most``, beyond which nothing is asked."""
    if len(counts) == len(total):
        more = np.frombuffer(counts, np.uint8)
        np.minimum(total + more.astype(np.uint16), most, out=total, casting="unsafe")
    else:
        n = len(counts) // 3
        at = np.frombuffer(counts, np.uint16, n)
        total[at] = np.minimum(total[at].astype(np.uint16) + np.frombuffer(counts, np.uint8, n, 2 * n), most)


def _pass(texts: DataFrame, k: int, support: int, last: bool, buckets: int, busy: np.ndarray | None, parts: np.ndarray | None) -> DataFrame:
    """One reading of the texts: exact counts of admitted phrases of ``k`` words, a row a phrase and chunk, and bucket counts of the next length."""
    sent = texts.sparkSession.sparkContext.broadcast((busy, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        busy, parts = sent.value
        counts = None if last else np.zeros(buckets, np.uint8)
        for chunk in _chunks(batches):
            admitted = _admitted(chunk, k, buckets, busy, parts)
            phrases, times = chunk.counted(np.flatnonzero(admitted[:-1]), k)
            if phrases:
                n = len(phrases)
                yield pa.RecordBatch.from_arrays([pa.array([chunk.lang] * n, pa.string()), pa.array(phrases, pa.binary()), pa.array(times, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=_PASS)
            if not last:
                longer = chunk.starts(k + 1)
                bucket, times = np.unique(chunk.buckets(longer[admitted[longer] & admitted[longer + 1]], k + 1, buckets), return_counts=True)
                counts[bucket] = np.minimum(counts[bucket] + times, support)
        if not last:
            for block, packed in _packed(counts):
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([block], pa.int32()), pa.array([packed], pa.binary())], schema=_PASS)

    small_batches(texts.sparkSession)
    return texts.mapInArrow(run, from_arrow_schema(_PASS))


def _busy(passed: DataFrame, support: int, buckets: int) -> np.ndarray:
    """The bitmap of buckets that reach the support. Blocks are added up in the tasks; one bit a bucket comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total = held.setdefault(block, np.zeros(min(BLOCK, buckets - block * BLOCK), np.uint8))
                _unpack_into(total, counts, support)
        if held:
            yield pa.RecordBatch.from_pydict({"block": list(held), "counts": [np.packbits(v >= support).tobytes() for v in held.values()]}, schema=_BLOCKS)

    blocks = passed.where("block IS NOT NULL").select("block", "counts").repartition("block")
    return _bitmap(blocks.mapInArrow(run, from_arrow_schema(_BLOCKS)), buckets)


def _frequent_bits(frequent: DataFrame, k: int, buckets: int) -> np.ndarray:
    """The bitmap of the buckets of frequent phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(buckets, bool)
        for batch in batches:
            hashes = np.array(
                [[xxhash.xxh64_intdigest(w, xxhash.xxh64_intdigest(lang.encode())) for w in phrase.split(b" ")] for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())],
                np.uint64,
            )
            if len(hashes):
                bits[_bucket(hashes.reshape(-1, k), buckets)] = True
        for block in range(0, buckets, BLOCK):
            some = bits[block : block + BLOCK]
            if some.any():
                yield pa.RecordBatch.from_pydict({"block": [block // BLOCK], "counts": [np.packbits(some).tobytes()]}, schema=_BLOCKS)

    small_batches(frequent.sparkSession, 10000)
    rows = frequent.select("lang", "phrase").mapInArrow(run, from_arrow_schema(_BLOCKS))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                more = np.frombuffer(packed, np.uint8)
                held[block] = held[block] | more if block in held else more
        if held:
            yield pa.RecordBatch.from_pydict({"block": list(held), "counts": [v.tobytes() for v in held.values()]}, schema=_BLOCKS)

    return _bitmap(rows.repartition("block").mapInArrow(joined, from_arrow_schema(_BLOCKS)), buckets)


def _bitmap(blocks: DataFrame, buckets: int) -> np.ndarray:
    bits = np.zeros((buckets + 7) // 8, np.uint8)
    for block, packed in blocks.collect():
        at = block * (BLOCK // 8)
        bits[at : at + len(packed)] = np.frombuffer(packed, np.uint8)
    return bits


def frequent_phrases(docs: DataFrame, longest: int = 4, support: int = 30, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS) -> tuple[list[DataFrame], DataFrame]:
    """Tables (lang, phrase, count) of the phrases of 1, 2, ... ``longest`` words that stand ``support`` times or more, and (lang, n) of all words.

    ``phrase`` is binary, words joined by blanks; counts stop at no bound. ``support`` is at most 255.
    """
    if not 1 <= support <= 255:
        raise ValueError("support is 1 to 255")
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text")).where("length(text) > 0")
    tables, words, busy, parts = [], None, None, None
    for k in range(1, longest + 1):
        last = k == longest
        passed = settle(_pass(texts, k, support, last, buckets, busy, parts))
        counts = passed.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("count").alias("count"))
        if k == 1:
            words = settle(passed.where("phrase IS NOT NULL").groupBy("lang").agg(F.sum("count").alias("n")))
        tables.append(settle(counts.where(F.col("count") >= support)))
        if not last:
            busy, parts = _busy(passed, support, buckets), _frequent_bits(tables[-1], k, buckets)
    return tables, words


def collocations(docs: DataFrame, top: int = 2000, longest: int = 4, support: int = 30, drop: int = 80, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to ``longest`` words.

    A-Z are lower-cased; texts are divided at ``.,;:!?`` and line ends into pieces, these at blanks and tabs into words.
    a is how often the phrase stands within pieces, overlaps included, l and r how often the two parts of its weakest cut do,
    n the language's words; score is floor(2,000,000 a / (l + r)), in decimals of 38 digits. Of cuts that tie the
    one after fewer words counts. A phrase goes where a longer frequent one that holds it has ``drop`` percent or more of its
    count. Order: score and a falling, then the phrase's bytes. Null and empty texts have no words; a null language is ``und``;
    rows that repeat count as often as they stand. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    return ranked(*frequent_phrases(docs, longest, support, text_col, lang_col, buckets), top, drop)


def ranked(tables: list[DataFrame], words: DataFrame, top: int = 2000, drop: int = 80) -> DataFrame:
    """The first phrases of each language from the tables of ``frequent_phrases``, see ``collocations``."""
    every = [t.select("lang", F.col("phrase").cast("string").alias("phrase"), "count") for t in tables]
    known = every[0]
    for t in every[1:]:
        known = known.unionByName(t)
    found = every[1]
    for t in every[2:]:
        found = found.unionByName(t)
    found = found.withColumnRenamed("count", "a").withColumn("words", F.split("phrase", " "))

    cuts = F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice("words", F.lit(1), k), " ").alias("left"), F.array_join(F.slice("words", k + 1, F.size("words") - k), " ").alias("right"))))
    cut = found.select("lang", "phrase", "a", cuts.alias("c")).select("lang", "phrase", "a", "c.*")
    side = lambda name, out: known.select("lang", F.col("phrase").alias(name), F.col("count").alias(out))
    cut = cut.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    cut = cut.withColumn("score", F.expr("CAST((2000000BD * CAST(a AS decimal(20,0))) div (CAST(l AS decimal(20,0)) + CAST(r AS decimal(20,0))) AS long)"))
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.score", "m.l", "m.r")

    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.size("words") - size + 1), lambda at: F.array_join(F.slice("words", at, size), " ")))))
    held = found.where(F.size("words") > 2).select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    scored = scored.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * wide("longer") < drop * wide("a"))).drop("longer")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language may hold most phrases: the first of each of 64 shares, then the first of these
    shared = scored.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    near = shared.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    first = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return first.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')), '[^\x20\x09]+') AS w FROM d),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k, CAST(count(*) AS BIGINT) AS a FROM s, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY 1),
c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w FROM g WHERE k > 1),
u AS (SELECT *, unnest(range(1, k)) AS j FROM c),
q AS (SELECT u.lang, u.phrase, u.k, u.a, u.j, l.a AS l, r.a AS r, CAST((2000000::HUGEINT * u.a) // (l.a::HUGEINT + r.a) AS BIGINT) AS score FROM u
  JOIN g l ON l.lang = u.lang AND l.phrase = array_to_string(w[1 : j], ' ') AND l.k = j JOIN g r ON r.lang = u.lang AND r.phrase = array_to_string(w[j + 1 : u.k], ' ') AND r.k = u.k - j),
b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
h AS (SELECT c.lang, array_to_string(c.w[i : i + z - 1], ' ') AS phrase, max(c.a) AS longer FROM c, (SELECT unnest([2, 3]) AS z), (SELECT unnest([1, 2, 3]) AS i) WHERE z < c.k AND i + z - 1 <= c.k GROUP BY 1, 2),
f AS (SELECT b.* FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM f QUALIFY rank <= 2000)
SELECT o.lang, o.rank, o.phrase, o.a, o.l, o.r, n.n, o.score FROM o JOIN n ON n.lang = o.lang
"""
