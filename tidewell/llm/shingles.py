"""Near copies by word shingles: every pair of sets with Jaccard similarity of at least a bound, found exactly.

A set's distinct shingles are put in one order for all sets, common ones last: by the counts of a fixed number of buckets
over all texts, then by digest. Two sets of n and
m shingles that are alike at t share one of the first n - ceil(t n) + 1 of the one and of the first
m - ceil(t m) + 1 of the other, whatever the order is, so sets that meet nowhere in these prefixes are
no pair. Pairs that meet are held against their lengths and places, then against tables of distances to reference
sets (a set's shingles with a given last byte), whose differences bound the distance of two sets from below, and what
is left is counted shingle by shingle.

``one_of_each`` first takes the links of the texts' SimHash fingerprints (``simhash``: pivot tables) and counts those pairs exactly. A group of near copies has as many pairs as its square, so
in the same pass sets are linked with a few neighbours in each run of equal shingles. What is linked is one component, and pairs within a component are not made any more; then the
pairs are found that are alike though nothing of this tells.

Long runs are known by their real lengths: the shingles of all prefixes are counted, by digest alone. Every long run
is dealt over tiles, and its sets bring their counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import HOT_SHARE, LOWER, arrow_map, cut_narrow, free, join_classes, row_digest, settle, small_batches
from .components import components

#: Buckets of shingles that are counted (4 bytes each are sent to the tasks), and of those the buckets that travel together.
#: The order decides how many pairs meet, never which pairs are found.
BUCKETS, SEGMENT = 1 << 20, 1 << 12
#: Sets of a shingle from which on its run is a long one.
LONG = 64
#: Words whose digests a worker remembers.
WORDS = 1 << 16
#: Pairs of a tile that are compared at once.
TILE = 1 << 20
#: The first look: shingles from the start and from the end of each prefix (large groups meet in their common ones), and neighbours in each run.
HEAD, TAIL, NEAR = 8, 8, 2
#: Counts by the last byte that travel with the sets of a long run, so that its pairs are ruled out where they meet.
COUNTS = 256
#: Sketches of a block, and names of sets up to which they are sent to every task.
SKETCHES, MOST_SENT = 1 << 15, 200_000
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shingles(text: str | None, width: int, words_known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit digests of the text's word shingles; a shorter text is one shingle, no words give none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words_known) > WORDS:
        words_known.clear()
    for w in set(words).difference(words_known):
        words_known[w] = xxhash.xxh64_intdigest(w, 42)
    h = np.fromiter(map(words_known.__getitem__, words), np.uint64, len(words))
    k = min(width, len(words))
    n = len(words) - k + 1
    x = np.full(n, k, np.uint64)
    for i in range(k):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        x = (x ^ (x >> np.uint64(29))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return np.unique(x ^ (x >> np.uint64(31)))


def least_overlap(n, m, similarity: float):
    """The fewest shared shingles of sets of n and m that are alike at ``similarity``."""
    return np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)


def bucket(found: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each shingle, by its high bits."""
    return (found >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)


def prefix(found: np.ndarray, similarity: float, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of all sets: by the count of their bucket, then by digest."""
    if not len(found):
        return found
    keep = len(found) - math.ceil(similarity * len(found) - 1e-9) + 1
    return found[np.lexsort((found, counts[bucket(found, len(counts))]))[:keep]]


def _segments(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(segment, counts): the segments that are not all zero, eight bytes a bucket."""
    size = min(SEGMENT, len(counts))
    parts = counts.reshape(-1, size)
    at = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([parts[k].tobytes() for k in at], pa.binary())], names=["segment", "counts"])


def _counted(parts: DataFrame, buckets: int) -> np.ndarray:
    """The sums of all rows (segment, counts): added up segment by segment in the tasks; one array of ``buckets`` comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["segment", "counts"])

    out = np.zeros(buckets, np.int64)
    found = parts.repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "segment").mapInArrow(run, "segment int, counts binary").toArrow()
    for k, x in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
        out[k * len(x) // 8 : (k + 1) * len(x) // 8] = np.frombuffer(x, np.int64)
    return out


def _names(keyed: DataFrame, width: int, buckets: int) -> tuple[DataFrame, np.ndarray]:
    """(row, set, n, fp), the digest of each row's set, its size and the text's SimHash fingerprint, and the counts of all texts' shingles by bucket, in one reading."""
    small_batches(keyed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        counts = np.zeros(buckets, np.int64)
        none = lambda n, kind: pa.nulls(n, kind)
        fields = ["row", "set", "n", "fp", "segment", "counts"]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [shingles(t, width, known) for t in texts]
            marks = np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64)
            for x in found:
                np.add.at(counts, bucket(x, buckets), 1)
            named = [batch.column(0), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in found], pa.binary()), pa.array(list(map(len, found)), pa.int32()), pa.array(marks)]
            yield pa.RecordBatch.from_arrays([*named, none(len(found), pa.int32()), none(len(found), pa.binary())], names=fields)
        for part in _segments(counts):
            n = part.num_rows
            yield pa.RecordBatch.from_arrays([none(n, pa.string()), none(n, pa.binary()), none(n, pa.int32()), none(n, pa.int64()), *part.columns], names=fields)

    found = settle(keyed.mapInArrow(run, "row string, set binary, n int, fp long, segment int, counts binary"))
    return found.where("row IS NOT NULL").select("row", "set", "n", "fp"), _counted(found.where("row IS NULL").select("segment", "counts"), buckets)


def _sets(keyed: DataFrame, width: int, similarity: float, counts: np.ndarray) -> DataFrame:
    """(row, n, prefix, sketch): the set's size, its prefix, and counts by the last byte, with the size."""
    counts = np.minimum(counts, 2**32 - 1).astype(np.uint32)
    schema = pa.schema([("row", pa.string()), ("n", pa.int32()), ("prefix", pa.list_(pa.int64())), ("sketch", pa.binary())])
    known: dict[bytes, int] = {}

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {"row": batch.column(0), "n": [], "prefix": [], "sketch": []}
        for text in batch.column(1).to_pylist():
            found = shingles(text, width, known)
            out["n"].append(len(found))
            out["prefix"].append(prefix(found, similarity, counts).view(np.int64))
            out["sketch"].append(np.minimum(np.bincount((found & np.uint64(255)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes() + np.int32(len(found)).tobytes())
        return out

    return arrow_map(keyed, run, schema)


def _long_runs(firsts: DataFrame, long: int) -> DataFrame:
    """(shingle, times) of the shingles that ``long`` prefixes or more hold, counted one by one."""
    return cut_narrow(firsts.select(F.explode("prefix").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("times")).where(F.col("times") >= long))


def meetings(key: np.ndarray, sets: np.ndarray, n: np.ndarray, place: np.ndarray, label: np.ndarray, similarity: float, most: int | None = None, fold: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets of different ``label`` in each run of equal ``key`` that can be alike as far as lengths and places tell; ``most``: of neighbours up to so many places apart.

    Where the shared shingle is the first one shared, no more can be shared than what follows it in either set.
    Rows of ``fold`` are counts of each set's shingles, whose differences bound the distance from below; all are zero where they are not known.
    """
    edge = np.flatnonzero(np.append(key[1:] != key[:-1], True)) + 1
    end = np.repeat(edge, np.diff(edge, prepend=0))
    left = n - place if most is None else n  # among a few shingles the first shared one may be missing
    i, step = np.arange(len(key)), 1
    while len(i := i[i + step < end[i]]) and (most is None or step <= most):
        j = i + step
        near = label[i] != label[j]
        one, two = i[near], j[near]
        need = least_overlap(n[one], n[two], similarity)
        near = np.minimum(left[one], left[two]) >= need
        one, two = one[near], two[near]
        if fold is not None:
            near = np.abs(fold[one] - fold[two]).sum(axis=1) <= n[one] + n[two] - 2 * need[near]
            one, two = one[near], two[near]
        a, b = sets[one], sets[two]
        if len(a):
            yield np.minimum(a, b), np.maximum(a, b)
        step += 1


def _candidates(firsts: DataFrame, similarity: float, few: bool, runs: DataFrame, most: int, most_sent: int) -> DataFrame:
    """(a, b): distinct pairs of sets (set, n, prefix, label, sketch) of different labels that meet in a prefix.

    A long run (``runs``: shingle, times) is dealt over tiles so that none has more than some two times ``most`` of its sets, as in ``simhash.links``. ``few``: only neighbours in the runs of a few shingles of each set.
    """
    spark = firsts.sparkSession
    counts = F.substring("sketch", 1, COUNTS)
    held = firsts.select("set", "n", "label", counts.alias("fold"), F.size("prefix").alias("size"), F.posexplode("prefix").alias("place", "shingle"))
    if few:
        held = held.where((F.col("place") < HEAD) | (F.col("place") >= F.col("size") - TAIL))
    sent = _sent(runs, most_sent)
    if sent is not runs:
        held = held.join(sent, "shingle", "left").withColumn("fold", F.when(F.col("times").isNotNull(), F.col("fold")))
    else:  # counts go to the sets of long runs alone
        held = held.drop("fold").join(runs, "shingle", "left")
        longer = held.where("times IS NOT NULL").join(firsts.select("set", counts.alias("fold")), "set")
        held = longer.unionByName(held.where("times IS NULL").withColumn("fold", F.lit(None).cast("binary")))
    held = held.withColumn("t", F.coalesce(F.ceil(F.col("times") / most), F.lit(1))).withColumn("p", F.pmod("set", F.col("t")))
    if few:
        tile = F.col("p")
    else:  # once for each part that its own part meets
        held = held.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t") - 1)))
        tile = F.least("p", "q") * F.col("t") + F.greatest("p", "q")
    dealt = held.select("shingle", tile.alias("tile"), "set", "n", "place", "label", "fold")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        none = bytes(COUNTS)

        def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            key = np.cumsum(np.append(True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]))) if rows.shape[1] else rows[0]
            a, b, size = [], [], 0
            for x, y in meetings(key, *rows[2:6], similarity, NEAR if few else None, rows[6:].T.copy().view(np.uint8).astype(np.int16)):
                a.append(x)
                b.append(y)
                size += len(x)
                if size > TILE:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b)], schema=schema)
                    a, b, size = [], [], 0
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            fold = np.frombuffer(b"".join(x or none for x in batch.column(6).to_pylist()), np.int64).reshape(-1, COUNTS // 8)
            rows = np.vstack([*(batch.column(c).to_numpy().astype(np.int64) for c in range(6)), fold.T])
            held.append(rows)
            if held[0][0, 0] == rows[0, -1] and held[0][1, 0] == rows[1, -1]:
                continue  # one run so far
            rows = np.concatenate(held, axis=1)
            last = int(np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))[-1]) + 1  # the last run may go on
            held = [rows[:, last:]]
            yield from pairs(rows[:, :last])
        if held:
            yield from pairs(np.concatenate(held, axis=1))

    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(wide, "shingle", "tile").sortWithinPartitions("shingle", "tile", F.xxhash64("shingle", "set")).mapInArrow(run, "a long, b long").distinct()


def _tiled(pairs: DataFrame, data: DataFrame, blocks: int, together: DataFrame | None = None) -> DataFrame:
    """Rows (tile, kind, a, b, data): in each tile first the sets (kind 0, named a) that have pairs there, then the pairs (kind 1).

    Sets are dealt to blocks and a tile is two blocks, so a set in many pairs travels at most once a block.
    Sets that ``together`` (set, root) names are in the tile of their root, with all their pairs, and travel once.
    """
    side = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    tile = F.least(side("a"), side("b")) * blocks + F.greatest(side("a"), side("b"))
    if together is not None:
        pairs = pairs.join(together.withColumnRenamed("set", "a"), "a", "left")
        tile = F.coalesce(-1 - F.col("root"), tile)
    pairs = pairs.select("a", "b", tile.alias("tile"))
    members = pairs.select("tile", F.explode(F.array("a", "b")).alias("set")).distinct()
    rows = members.join(data, "set").select("tile", F.lit(0).alias("kind"), F.col("set").alias("a"), F.lit(0).cast("long").alias("b"), "data")
    rows = rows.unionByName(pairs.select("tile", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("data")))
    small_batches(pairs.sparkSession)
    wide = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(wide, "tile").sortWithinPartitions("tile", "kind")


def _close(pairs: DataFrame, sketches: DataFrame, similarity: float, blocks: int) -> DataFrame:
    """The pairs whose sketches do not rule them out: the sets differ in at least as many shingles as the counts do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, sets = None, {}
        for batch in batches:
            out = []
            for at, kind, a, b, data in zip(*(c.to_pylist() for c in batch.columns)):
                if at != tile:
                    tile, sets = at, {}
                if kind == 0:
                    sets[a] = data
                else:
                    out.append((a, b, sets[a], sets[b]))
            if out:
                x, y = (np.frombuffer(b"".join(p[k] for p in out), np.uint8).reshape(len(out), -1).astype(np.int64) for k in (2, 3))
                n, m = x[:, 256:] @ (1 << np.arange(0, 32, 8)), y[:, 256:] @ (1 << np.arange(0, 32, 8))
                near = np.abs(x[:, :256] - y[:, :256]).sum(axis=1) <= n + m - 2 * least_overlap(n, m, similarity)
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()).filter(pa.array(near)) for k in (0, 1)], names=["a", "b"])

    return _tiled(pairs, sketches, blocks).mapInArrow(run, "a long, b long")


def _alike(pairs: DataFrame, sizes: DataFrame, texts: DataFrame, width: int, similarity: float, block: int, blocks: int) -> DataFrame:
    """(a, b) of the pairs whose sets are alike, or enough of them to give the components.

    Sets that pairs connect are compared in one task where they have at most ``block`` shingles together (``sizes``: set, n).
    """
    linked = components(pairs).withColumnRenamed("node", "set")
    small = linked.join(sizes, "set").groupBy("root").agg(F.sum("n").alias("n")).where(F.col("n") <= block).select("root")
    together = cut_narrow(linked.join(small, "root").select("set", "root"))
    schema = pa.schema([("set", pa.int64()), ("data", pa.binary())])
    known: dict[bytes, int] = {}

    def of(batch: pa.RecordBatch) -> dict:
        return {"set": batch.column(0), "data": [shingles(t, width, known).tobytes() for t in batch.column(1).to_pylist()]}

    held = arrow_map(texts.select("set", "text"), of, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, sets, root = None, {}, {}

        def find(x):
            while (up := root.get(x, x)) != x:
                root[x] = root.get(up, up)
                x = up
            return x

        for batch in batches:
            out = []
            for at, kind, a, b, data in zip(*(c.to_pylist() for c in batch.columns)):
                if at != tile:
                    tile, sets, root = at, {}, {}
                if kind == 0:
                    sets[a] = np.frombuffer(data, np.uint64)
                elif (u := find(a)) != (v := find(b)):
                    x, y = sets[a], sets[b]
                    both = np.concatenate((x, y))
                    both.sort(kind="stable")
                    shared = int(np.count_nonzero(both[1:] == both[:-1]))
                    if shared >= least_overlap(len(x), len(y), similarity):
                        root[max(u, v)] = min(u, v)
                        out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return _tiled(pairs, held, blocks, together).mapInArrow(run, "a long, b long")


def _fingerprint_links(names: DataFrame, classes: DataFrame, radius: int) -> DataFrame:
    """(a, b): links between sets (``classes``: long, set) that have rows of one SimHash fingerprint, or of fingerprints within ``radius`` bits; enough to give the components."""
    held = cut_narrow(names.select(F.col("set").alias("long"), "fp").distinct().join(classes.select("long", "set"), "long").select("fp", "set"))
    heads = cut_narrow(held.groupBy("fp").agg(F.min("set").alias("head"), F.count("*").alias("times")))
    equal = join_classes(held, heads, ["fp"]).where("set <> head").select(F.col("head").alias("a"), F.col("set").alias("b"))
    end = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_set"))
    near = simhash.links(heads.select("fp"), radius).join(end("a"), "a").join(end("b"), "b").select(F.col("a_set").alias("a"), F.col("b_set").alias("b"))
    return equal.unionByName(near).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, most: int = 4096, block: int = 1 << 22, most_sent: int = MOST_SENT, buckets: int = BUCKETS, long: int = LONG, radius: int = 4) -> DataFrame:
    """The rows of ``docs``, all columns, one of each component of texts whose sets of word shingles have a Jaccard
    similarity of ``similarity`` or more: the one with the least id (null last), then the least digest.

    Pairs come from SimHash fingerprints that differ in at most ``radius`` bits, and, where these do not tell, from shared shingles; all are counted exactly.

    Null and wordless texts have the empty set, alike to itself. Rows are told apart by 128 bits over all columns, so each
    keeps its own; of rows equal in every column one is kept. Columns may have any names. An empty table gives no rows.
    Sets of a shingle that more than ``most`` hold are dealt over tiles; ``block`` is the number
    of shingles of a block, ``buckets`` (a power of two) of counted ones, ``long`` of sets of a long run.
    """
    row = row_digest(docs)
    ids = cut_narrow(docs.select(row.alias("row"), F.col(id_col).cast("long").alias("id")).groupBy("row", "id").agg(F.count("*").alias("times")))
    docs = _often_once(docs, row, ids)
    plain = docs.select(row.alias("row"), F.col(text_col).alias("text"))
    names, counts = _names(plain, width, buckets)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    # a set's short name is a number of its own, so that no two sets share it
    classes = cut_narrow(
        names.select("row", F.col("set").alias("long"), "n").distinct().join(ids, "row").groupBy("long").agg(F.min(order).alias("first"), F.first("n").alias("n"))
        .select(F.monotonically_increasing_id().alias("set"), "long", "first", "n")
    )
    count, total = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    stands = classes.select(F.col("first.row").alias("row"), "set")
    firsts = settle(_sets(plain, width, similarity, counts).join(stands, "row").dropDuplicates(["row"]))
    runs = _long_runs(firsts, long)
    sketches = firsts.select("set", F.col("sketch").alias("data"))
    blocks = -(-count // SKETCHES) or 1
    links = None
    for few in (True, False):
        label = F.col("set") if links is None else F.coalesce("root", "set")
        named = firsts if links is None else firsts.join(_sent(components(links).withColumnRenamed("node", "set"), most_sent), "set", "left")
        pairs = _close(_candidates(named.withColumn("label", label), similarity, few, runs, most, most_sent), sketches, similarity, blocks)
        if few:
            pairs = pairs.unionByName(_fingerprint_links(names, classes, radius)).distinct()
        pairs = cut_narrow(pairs)
        asked = cut_narrow(stands.join(pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct(), "set", "left_semi"))
        texts = plain.join(_sent(asked, most_sent), "row").dropDuplicates(["row"])
        found = cut_narrow(_alike(pairs, classes.select("set", "n"), texts, width, similarity, block, -(-total // block) or 1))
        links = found if links is None else links.unionByName(found)
    named = components(links).withColumnRenamed("node", "set")
    kept = classes.join(named, "set", "left").groupBy(F.coalesce("root", "set").alias("root")).agg(F.min("first").alias("first"))
    return _kept_rows(docs, row, ids, kept.select("first.row"), most_sent)


def _sent(few: DataFrame, most: int) -> DataFrame:
    """``few`` marked to be sent to every task if it has at most ``most`` rows, else as it is."""
    return F.broadcast(few) if few.count() <= most else few


def _kept_rows(docs: DataFrame, row: Column, ids: DataFrame, keep: DataFrame, most_sent: int) -> DataFrame:
    """The rows of ``docs`` whose digest is in ``keep``, each once.

    Up to ``most_sent`` digests of rows that go or repeat are sent to the rows, which are then decided where they stand; beyond, rows are joined.
    """
    name, again = free(docs, "__row"), free(docs, "__again")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marks = ids.join(keep.withColumn("kept", F.lit(True)), "row", "left").where("kept IS NULL OR times > 1")
    marks = cut_narrow(marks.select(F.unhex("row").alias(name), F.coalesce("kept", F.lit(False)).alias(again)))
    if marks.count() > most_sent:
        return docs.withColumn(name, row).join(keep.withColumnRenamed("row", name), name, "left_semi").dropDuplicates([name]).select(*columns)
    marked = docs.withColumn(name, F.unhex(row)).join(F.broadcast(marks), name, "left")
    out = marked.where(F.col(again).isNull()).select(*columns)
    if marks.where(F.col(again)).isEmpty():
        return out
    return out.unionByName(marked.where(F.col(again)).dropDuplicates([name]).select(*columns))


def _often_once(docs: DataFrame, row: Column, ids: DataFrame) -> DataFrame:
    """``docs`` with those rows once that repeat very often (at most 1 / HOT_SHARE of them): they are put together where they stand, so that no task gathers their copies."""
    total = ids.agg(F.sum("times")).first()[0] or 0
    often = ids.where(F.col("times") > max(1.0, total * HOT_SHARE)).select("row")
    if often.isEmpty():
        return docs
    name, hot = free(docs, "__row"), free(docs, "__hot")
    marked = docs.withColumn(name, row).join(F.broadcast(often.select(F.col("row").alias(name), F.lit(True).alias(hot))), name, "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return marked.where(F.col(hot).isNull()).select(*columns).unionByName(marked.where(hot).dropDuplicates([name]).select(*columns))
