"""SimHash near-duplicates, found with tables of distances to reference fingerprints.

Documents with the same fingerprint are one class. Classes that may be close are brought
together by keys over parts of the fingerprint (a pair that differs in r bits agrees in all
but r of the parts), and within a bucket the pivot table does the work: the Hamming distance
to each reference fingerprint is known for every member, a pair whose distances to any
reference differ by more than r cannot be within r (triangle inequality), and the few pairs
that survive all references are verified by counting differing bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, arrow_map, cut, join_classes
from .components import components

#: Pairs of a tile that are compared at once.
TILE = 1 << 20


def reference_fingerprints(count: int) -> np.ndarray:
    """Fixed pseudo-random 64-bit words (the splitmix64 sequence)."""
    x = (np.arange(1, count + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash over word shingles; no words give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return digest(line, seed)  # one shingle: its own bits
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    h = np.fromiter([digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist())], np.uint64, n)
    total = np.zeros(64, np.int64)
    for at in range(0, n, 8192):  # bounded memory for very long texts
        part = h[at : at + 8192]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit number."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batch: pa.RecordBatch) -> dict:
        got = np.array([fingerprint(t, width, seed) for t in batch.column(1).to_pylist()], np.uint64)
        return {"doc_id": batch.column(0), "fp": got.view(np.int64)}

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, schema)


def key_plan(count: int, radius: int) -> list[list[tuple[int, int]]]:
    """Which parts of the fingerprint make a key, each a list of (shift, bits).

    With p parts, a pair within the radius agrees in some p - radius of them, so every choice of
    p - radius parts is a key. More parts give longer keys and more of them; p is chosen by the
    number of classes so that copies made plus pairs compared stay least. No choice loses a pair.
    """

    def cost(p: int) -> float:
        bits = 64 * (p - radius) / p
        return len(list(combinations(range(p), radius))) * (100 + count / 2**bits)

    parts = min(range(radius + 1, radius + 5), key=cost)
    edges = [round(i * 64 / parts) for i in range(parts + 1)]
    spans = [(a, b - a) for a, b in zip(edges, edges[1:])]
    return [list(c) for c in combinations(spans, parts - radius)]


def link_bucket(fps: np.ndarray, table: np.ndarray, radius: int, other: slice | None = None) -> np.ndarray:
    """For each member of a bucket the least index it is linked to, directly or through others.

    ``table`` holds the distances to the references (one row each). Rows are sorted by the first
    distance, so only a window is compared, and each further reference discards pairs of it.
    """
    n = len(fps)
    label = np.arange(n)
    order = np.argsort(table[0], kind="stable")
    fps, table = fps[order], table[:, order].astype(np.int16)
    stop = np.searchsorted(table[0], table[0] + radius, side="right")
    step = max(1, TILE // n)
    for at in range(0, n, step):
        rows = slice(at, min(n, at + step))
        cols = slice(at, int(stop[rows].max()))
        ok = np.abs(table[1][rows, None] - table[1][None, cols]) <= radius
        for d in table[2:6]:
            ok &= np.abs(d[rows, None] - d[None, cols]) <= radius
        i, j = np.nonzero(ok)
        i, j = i + at, j + at
        near = j > i
        i, j = i[near], j[near]
        for d in (table[0], *table[6:]):
            near = np.abs(d[i] - d[j]) <= radius
            i, j = i[near], j[near]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= radius  # verification
        i, j = i[near], j[near]
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := label[label], label):
                label = up
    out = np.empty(n, np.int64)
    out[order] = order[label]
    return out


def links(classes: DataFrame, radius: int = 4, references: int = 16, most: int = 16384) -> DataFrame:
    """(a, b): links between distinct fingerprints within ``radius`` bits; enough to give the components.

    A bucket of more than ``most`` classes is dealt over tiles: its members are split into t parts
    and every pair of parts meets in a task of its own, so no task holds more than two parts.
    """
    spark = classes.sparkSession
    count = classes.count()
    plan = key_plan(count, radius)
    keys = []
    for k, spans in enumerate(plan):
        key = F.lit(0).cast("long")
        for shift, bits in spans:
            key = F.shiftleft(key, bits).bitwiseOR(F.shiftrightunsigned("fp", shift).bitwiseAND((1 << bits) - 1))
        keys.append(F.struct(F.lit(k).cast("int").alias("k"), key.alias("key")))
    keyed = classes.select("fp", F.explode(F.array(*keys)).alias("x")).select("fp", "x.k", "x.key")
    sizes = keyed.groupBy("k", "key").count().where(F.col("count") > 1)
    parts = F.ceil(F.col("count") / most).cast("int")
    member = keyed.join(sizes, ["k", "key"]).select("fp", "k", "key", parts.alias("t"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("p"))
    tiles = F.when(F.col("t") == 1, F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("t") - 1), lambda q: F.least(q, F.col("p")) * F.col("t") + F.greatest(q, F.col("p")))
    )
    dealt = member.select("fp", "k", "key", F.explode(tiles).alias("tile"))
    refs = reference_fingerprints(references)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        held: list[np.ndarray] = []
        last = None

        def flush():
            fps = np.unique(np.concatenate(held)).view(np.uint64)
            held.clear()
            if len(fps) < 2:
                return None
            at = link_bucket(fps, np.bitwise_count(fps[None, :] ^ refs[:, None]), radius)
            moved = np.nonzero(at != np.arange(len(fps)))[0]
            return (fps[moved].view(np.int64), fps[at[moved]].view(np.int64)) if len(moved) else None

        found_a, found_b, size = [], [], 0
        for batch in batches:
            fp = batch.column(0).to_numpy()
            ids = [batch.column(c).to_numpy() for c in (1, 2, 3)]
            if not len(fp):
                continue
            change = np.nonzero((ids[0][1:] != ids[0][:-1]) | (ids[1][1:] != ids[1][:-1]) | (ids[2][1:] != ids[2][:-1]))[0] + 1
            for part, start in zip(np.split(fp, change), [0, *change.tolist()]):
                name = tuple(int(c[start]) for c in ids)
                if last is not None and name != last and (got := flush()):
                    found_a.append(got[0])
                    found_b.append(got[1])
                    size += len(got[0])
                last = name
                held.append(part)
            if size > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (found_a, found_b)], schema=schema)
                found_a, found_b, size = [], [], 0
        if held and (got := flush()):
            found_a.append(got[0])
            found_b.append(got[1])
        if found_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (found_a, found_b)], schema=schema)

    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(wide, "k", "key", "tile").sortWithinPartitions("k", "key", "tile").mapInArrow(run, "a long, b long")


def _roots(classes: DataFrame, radius: int, references: int) -> DataFrame:
    """(fp, root) of the classes that are linked: root is the least fingerprint of the component."""
    return components(links(classes.select("fp"), radius, references)).withColumnRenamed("node", "fp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, references: int = 16) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    component_id is the least doc_id reachable over links of at most ``radius`` differing bits.
    Null or wordless texts have fingerprint 0, linked like any other. Repeated rows share a class.
    A null doc_id stays and never names a component unless its component has no other. An empty
    table gives no rows; other columns of ``docs`` are ignored.
    """
    marked = cut(fingerprints(docs, id_col, text_col, width))
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("times")))
    named = _roots(classes, radius, references).join(classes, "fp")
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    whole = named.join(least, "root").select("fp", "component_id")
    per_class = cut(classes.join(whole, "fp", "left").select("fp", "times", F.coalesce("component_id", "least_id").alias("component_id")))
    return join_classes(marked, per_class, ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
