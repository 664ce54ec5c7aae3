"""Language-model scores by context-tree weighting over bytes.

Every byte is eight binary decisions. For each bit, a tree of contexts (the preceding bytes,
most recent first, down to DEPTH) holds counts; a node's Krichevsky-Trofimov estimate and the
product of its children are mixed half and half at every depth, which weighs all prunings of
the tree at once. Counts decide the weights, so the trees are learned in any order, in parallel.

A text is coded as its lower-cased words, each followed by a blank, then an end. The first three
bytes of a word have the blank and up to three bytes of the word before as their context, later
ones the word so far and its blank. So code lengths belong to units that repeat: a junction
(end of a word, start of the next) covers three bytes and a word the bytes after its third.
Contexts are gathered from distinct units weighted by their counts, and a text is scored by
adding up its units.

Keys of contexts are packed as [c1 c2 ... y]: c1 the byte just before y, and so on back.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, arrow_map, settle, small_batches

DEPTH = 6
#: Depth of the subtrees that are learned in parallel; the nodes above are few (at most 256 ** 2 * 255).
SPLIT = 3
BLANK, END = 0x20, 0x0A
#: Bytes of the word before, and of the word, in a junction.
TAIL, LEAD = 3, 3
#: Stand in for the word of a junction, for the junction of a word, and for the word of a row's own sums; no text has these bytes.
NO_WORD, NO_JUNCTION, OWN = b"\xfe", -1, b"\xff"
HALF = math.log(0.5)
#: Words and junctions held in every task with their scores: the commonest ones, bounded tables.
HEAD_WORDS, HEAD_JUNCTIONS = 1 << 18, 1 << 20
#: Contexts up to which their code lengths are sent to every task; beyond, words are joined with them.
MOST_SENT = 1 << 23
#: Words counted in a task before they are passed on.
FLUSH = 200_000


def split(texts: list[str | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """The words of each text, the empty one at its end, and the junctions of all with the text each belongs to.

    A junction is packed as [t3 t2 t1 h0 h1 h2]: the last bytes of the word before and the first
    of the coded word, zeros where there are none (h1 is the blank after a word of one byte).
    """
    words, lines = [], []
    for text in texts:
        found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
        lines.append(b"\0\0\0 " + b" ".join(found) + (b" \n\0\0" if found else b"\n\0\0"))
        found.append(b"")
        words.append(found)
    line = np.frombuffer(b"".join(lines), np.uint8)
    at = np.flatnonzero(line == BLANK) + 1
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    t1, t2, t3 = (line[at - k].astype(np.int64) for k in (2, 3, 4))
    short = t2 == BLANK
    t2[short] = 0
    t3[short | (t3 == BLANK)] = 0
    h0, h1, h2 = (line[at + k].astype(np.int64) for k in range(3))
    h2[h1 == BLANK] = 0
    return words, t3 << 40 | t2 << 32 | t1 << 24 | h0 << 16 | h1 << 8 | h2, owner


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 0.5: Stirling's series after a shift by 8."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    small = x < 1e6
    if small.any():
        xs = x[small]
        s = np.ones_like(xs)
        for i in range(8):
            s *= xs + i
        shift[small] = np.log(s)
        x = x.copy()
        x[small] = xs + 8
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - shift


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


def mixed(n0: np.ndarray, n1: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A node's weighted probability (ln) and the share of its own estimate in it."""
    own = HALF + kt(n0, n1)
    both = np.logaddexp(own, HALF + children)
    return both, np.exp(own - both)


def contexts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bytes of words that no junction covers, and the word each belongs to."""
    lead = b"\0" * (DEPTH - 1) + b" "
    line = np.frombuffer(b"".join([lead + w + b" " for w in words]), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(size + DEPTH + 1) - size - 1
    count = np.maximum(0, size + 1 - LEAD)
    owner = np.repeat(np.arange(len(words)), count)
    place = np.arange(len(owner)) + np.repeat(first + LEAD - (np.cumsum(count) - count), count)
    key = np.zeros(len(place), np.int64)
    for back in range(1, DEPTH + 1):
        key = (key << 8) | line[place - back]
    return (key << 8) | line[place], owner


def junction_contexts(junctions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bytes that junctions cover, and the junction each belongs to."""
    t3, t2, t1, h0, h1, h2 = ((junctions >> k) & 0xFF for k in range(40, -1, -8))
    two = h0 != END
    three = two & (h1 != BLANK)
    one = BLANK << 48 | t1 << 40 | t2 << 32 | t3 << 24 | h0
    second = (h0 << 48 | BLANK << 40 | t1 << 32 | t2 << 24 | t3 << 16 | h1)[two]
    third = (h1 << 48 | h0 << 40 | BLANK << 32 | t1 << 24 | t2 << 16 | t3 << 8 | h2)[three]
    return np.concatenate([one, second, third]), np.concatenate([np.arange(len(one)), np.flatnonzero(two), np.flatnonzero(three)])


def subtrees(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """For sorted distinct keys with counts, whole subtrees of depth SPLIT and below.

    Gives for each key and bit the probability of a one by the subtree alone, and for each bit
    the subtrees' sums by node of depth SPLIT - 1: (node, n0, n1, ln weighted probability).
    A node is its context and the bits before, (context << 8) | 1 bits.
    """
    ones = np.empty((len(keys), 8))
    tops = []
    for b in range(8):
        bit = (keys >> (7 - b)) & 1
        node = keys >> (8 - b)  # context of DEPTH and b bits, in order
        new = np.concatenate(([True], node[1:] != node[:-1]))
        start = np.flatnonzero(new)
        n1 = np.add.reduceat(counts * bit, start).astype(np.float64)
        n0 = np.add.reduceat(counts, start).astype(np.float64) - n1
        weighted = kt(n0, n1)
        row = np.cumsum(new) - 1
        levels = [(row, n0, n1, np.ones(len(n0)))]
        node = node[start]
        for depth in range(DEPTH - 1, SPLIT - 1, -1):
            # drop the oldest byte of the context, keep the bits
            up = ((node >> (8 + b)) << b) | (node & ((1 << b) - 1))
            names, to = np.unique(up, return_inverse=True)
            n0, n1 = np.bincount(to, n0, len(names)), np.bincount(to, n1, len(names))
            weighted, share = mixed(n0, n1, np.bincount(to, weighted, len(names)))
            levels.append((to, n0, n1, share))
            node = names
        top = ((node >> (8 + b)) << 8) | (1 << b) | (node & ((1 << b) - 1))
        names, to = np.unique(top, return_inverse=True)
        tops.append((names, np.bincount(to, n0), np.bincount(to, n1), np.bincount(to, weighted)))
        ones[:, b] = _downwards(levels)
    return ones, tops


def _downwards(levels: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """The mixed estimate of a one for every row, from the top of the subtree to its deepest context."""
    at = levels[0][0]
    path = [at]
    for to, *_ in levels[1:]:
        at = to[at]
        path.append(at)
    rest, total = 1.0, 0.0
    for at, (_, n0, n1, share) in zip(reversed(path), reversed(levels)):
        total = total + rest * (share * (n1 + 0.5) / (n0 + n1 + 1.0))[at]
        rest = rest * (1 - share)[at]
    return total


class Top:
    """The nodes above the subtrees: for each node of depth SPLIT - 1 the estimate down to it, and the weight left for its subtrees."""

    def __init__(self, node: np.ndarray, n0: np.ndarray, n1: np.ndarray, weighted: np.ndarray):
        order = np.argsort(node)
        self.node = node[order]
        n0, n1, weighted = n0[order], n1[order], weighted[order]
        names, levels, to = self.node, [], np.arange(len(node))
        for depth in range(SPLIT - 1, -1, -1):
            weighted, share = mixed(n0, n1, weighted)
            levels.append((to, n0, n1, share))
            if depth:
                up = ((names >> 16) << 8) | (names & 0xFF)
                names, to = np.unique(up, return_inverse=True)
                n0, n1, weighted = np.bincount(to, n0), np.bincount(to, n1), np.bincount(to, weighted)
        at, path = np.arange(len(node)), []
        for to, *_ in levels:
            at = to[at]
            path.append(at)
        self.one, self.rest = np.zeros(len(node)), np.ones(len(node))
        for at, (_, n0, n1, share) in zip(reversed(path), reversed(levels)):
            self.one += self.rest * (share * (n1 + 0.5) / (n0 + n1 + 1.0))[at]
            self.rest *= (1 - share)[at]

    def log10(self, keys: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """log10 of each key's probability; ones: its subtree's estimates."""
        total = np.zeros(len(keys))
        context = keys >> (8 * (DEPTH - SPLIT + 2))
        for b in range(8):
            at = np.searchsorted(self.node, (context << 8) | (1 << b) | ((keys & 0xFF) >> (8 - b)))
            p = self.one[at] + self.rest[at] * ones[:, b]
            total += np.log10(np.where((keys >> (7 - b)) & 1, p, 1 - p))
        return total


def count_words(docs: DataFrame) -> DataFrame:
    """(word, junction, n): training counts of all words and junctions of (held_out, text); the empty word is the texts' end."""

    def run(batches):
        counts: Counter = Counter()
        other: set = set()
        joints: list[np.ndarray] = []

        def out():
            names = list(counts) + [w for w in other if w not in counts]
            numbers = np.zeros(len(names), np.int64)
            numbers[: len(counts)] = np.fromiter(counts.values(), np.int64, len(counts))
            learnt, n = np.unique(np.concatenate([j for h, j in joints if not h] or [np.empty(0, np.int64)]), return_counts=True)
            more = np.setdiff1d(np.concatenate([j for h, j in joints if h] or [np.empty(0, np.int64)]), learnt)
            k = len(learnt) + len(more)
            batch = pa.RecordBatch.from_arrays([
                pa.array(names + [NO_WORD] * k, pa.binary()), pa.array(np.concatenate([np.full(len(names), NO_JUNCTION), learnt, more])),
                pa.array(np.concatenate([numbers, n, np.zeros(len(more), np.int64)])),
            ], names=["word", "junction", "n"])
            counts.clear()
            other.clear()
            joints.clear()
            return batch

        size = 0
        for batch in batches:
            held = np.array(batch.column(0).to_pylist(), bool)
            words, joint, owner = split(batch.column(1).to_pylist())
            for h, w in zip(held, words):
                (other if h else counts).update(w)
            joints += [(True, joint[held[owner]]), (False, joint[~held[owner]])]
            size += len(joint)
            if len(counts) + len(other) > FLUSH or size > 20 * FLUSH:
                yield out()
                size = 0
        if joints:
            yield out()

    return docs.select("held_out", "text").mapInArrow(run, "word binary, junction long, n long").groupBy("word", "junction").agg(F.sum("n").alias("n"))


def _units(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Words, junctions, and the rows of a batch (word, junction, ...) that each stands in."""
    names, joint = batch.column(0).to_pylist(), batch.column(1).to_numpy()
    is_word = joint == NO_JUNCTION
    at = np.flatnonzero(is_word)
    return [names[i] for i in at], joint[~is_word], at, np.flatnonzero(~is_word)


def _spread(batch: pa.RecordBatch):
    """Keys of all contexts of a batch, in bounded pieces, with the row each belongs to."""
    words, joint, word_rows, joint_rows = _units(batch)
    for part in _slices(words):
        keys, owner = contexts(words[part])
        yield keys, word_rows[part][owner]
    if len(joint):
        keys, owner = junction_contexts(joint)
        yield keys, joint_rows[owner]


def _gather(words: DataFrame) -> DataFrame:
    """(key, n) of every context of the words and junctions, with their training counts."""
    def out(parts):
        keys, n = (np.concatenate([p[i] for p in parts]) for i in range(2))
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return pa.RecordBatch.from_arrays([pa.array(keys[start]), pa.array(np.add.reduceat(n, start))], names=["key", "n"])

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            n = batch.column(2).to_numpy()
            for keys, rows in _spread(batch):
                if len(keys):
                    parts.append((keys, n[rows]))
                    size += len(keys)
            if size > 1 << 20:
                yield out(parts)
                parts, size = [], 0
        if parts:
            yield out(parts)

    return words.select("word", "junction", "n").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _slices(names: list[bytes], most: int = 1 << 20) -> list[slice]:
    """Runs of words whose bytes together stay near ``most``."""
    out, start, size = [], 0, 0
    for i, w in enumerate(names):
        size += len(w) + DEPTH + 1
        if size > most:
            out.append(slice(start, i + 1))
            start, size = i + 1, 0
    if start < len(names):
        out.append(slice(start, len(names)))
    return out


def learn(words: DataFrame, chunk: int = 1 << 16) -> tuple[DataFrame, Top | None]:
    """(key, one): the subtrees' estimates (eight doubles) for every context of ``words``, and the nodes above.

    Contexts are dealt by their last SPLIT bytes, sorted, and learned in chunks of whole
    subtrees. Each task also sums its subtrees by the node above; those sums (at most
    256 ** (SPLIT - 1) * 255 rows, whatever the corpus) go to the driver.
    """
    spark = words.sparkSession
    schema = pa.schema([("key", pa.int64()), ("one", pa.binary()), ("n0", pa.float64()), ("n1", pa.float64()), ("weighted", pa.float64()), ("top", pa.bool_())])
    shift = 8 * (DEPTH - SPLIT + 1)

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(keys, counts):
            ones, tops = subtrees(keys, counts)
            nodes, n0, n1, weighted = (np.concatenate([t[i] for t in tops]) for i in range(4))
            none = pa.nulls(len(keys), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.Array.from_buffers(pa.binary(64), len(keys), [None, pa.py_buffer(ones.tobytes())]).cast(pa.binary()), none, none, none, pa.array(np.zeros(len(keys), bool))], schema=schema)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.nulls(len(nodes), pa.binary()), pa.array(n0), pa.array(n1), pa.array(weighted), pa.array(np.ones(len(nodes), bool))], schema=schema)

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= chunk:
                keys, counts = (np.concatenate([h[i] for h in held]) for i in range(2))
                last = np.searchsorted(keys, (keys[-1] >> shift) << shift)  # the last subtree may go on
                if last:
                    yield from out(keys[:last], counts[:last])
                held, size = [(keys[last:], counts[last:])], len(keys) - last
        if held:
            keys, counts = (np.concatenate([h[i] for h in held]) for i in range(2))
            yield from out(keys, counts)

    grams = _gather(words)
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = grams.withColumn("tree", F.shiftright("key", shift)).repartition(wide, "tree").sortWithinPartitions("key").select("key", "n")
    found = settle(dealt.mapInArrow(run, "key long, one binary, n0 double, n1 double, weighted double, top boolean"))
    sums = found.where("top").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "weighted")])
    got = sums.toArrow()
    top = Top(*[got.column(c).to_numpy() for c in ("key", "n0", "n1", "weighted")]) if got.num_rows else None
    return found.where("NOT top").select("key", "one"), top


def word_scores(words: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """(word, junction, n, score): log10 probability of what every word and junction covers.

    Where the contexts are at most ``most_sent`` their code lengths are sent to the tasks (16 bytes
    each); beyond that, every byte of every distinct word is joined with its context.
    """
    spark = words.sparkSession
    words = words.select("word", "junction", "n")
    nodes, top = learn(words)
    schema = pa.schema([("key", pa.int64()), ("cost", pa.float64())])

    def price(batch: pa.RecordBatch) -> dict:
        keys = batch.column(0).to_numpy()
        return {"key": keys, "cost": top.log10(keys, np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(-1, 8))}

    costs = arrow_map(nodes, price, schema)
    if nodes.count() <= most_sent:
        table = costs.toArrow()
        keys, cost = table.column("key").to_numpy(), table.column("cost").to_numpy()
        order = np.argsort(keys)
        sent = spark.sparkContext.broadcast((keys[order], cost[order]))
        out = pa.schema([("word", pa.binary()), ("junction", pa.int64()), ("n", pa.int64()), ("score", pa.float64())])

        def add(batch: pa.RecordBatch) -> dict:
            known, cost = sent.value
            score = np.zeros(batch.num_rows)
            for keys, rows in _spread(batch):
                score += np.bincount(rows, cost[np.searchsorted(known, keys)], batch.num_rows)
            return {"word": batch.column(0), "junction": batch.column(1), "n": batch.column(2), "score": score}

        return arrow_map(words, add, out)
    pairs = pa.schema([("word", pa.binary()), ("junction", pa.int64()), ("n", pa.int64()), ("key", pa.int64())])

    def spread(batches):
        for batch in batches:
            seen = np.zeros(batch.num_rows, bool)
            for keys, rows in _spread(batch):
                seen[rows] = True
                yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(rows)) for i in range(3)] + [pa.array(keys)], schema=pairs)
            bare = np.flatnonzero(~seen)  # the few words that junctions cover whole
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(bare)) for i in range(3)] + [pa.array(np.full(len(bare), -1))], schema=pairs)

    rows = words.mapInArrow(spread, "word binary, junction long, n long, key long")
    return rows.join(costs, "key", "left").groupBy("word", "junction", "n").agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("score"))


def _commonest(units: DataFrame, most: int) -> DataFrame:
    """The units whose counts lie in the highest classes that together hold at most ``most``: a filter by a histogram of some hundred classes, nothing is sorted."""
    kind = F.floor(16 * F.log2(F.col("n") + 1))
    found = sorted(((r["kind"], r["count"]) for r in units.groupBy(kind.alias("kind")).count().collect()), reverse=True)
    total, least = 0, None
    for k, count in found:
        total += count
        if total > most:
            break
        least = k
    return units.where(kind >= least) if least is not None else units.limit(0)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: tuple[int, int] = (HEAD_WORDS, HEAD_JUNCTIONS), most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) for every row.

    n_bytes are the bytes coded (each word and its blank, and the end), bits_per_byte the mixture's code length for one.

    Rows with crc32(id) mod 10 = 0 are held out of the learning (a null id counts as the empty
    string). base_score is the unigram score with add-0.1 smoothing, score the mixture's. Null and
    empty texts are their end alone. Without training rows every count is 0 and every bit costs one bit.
    The commonest words and junctions (``head``) are scored inside the scan; the others meet their scores in a
    join, which so holds no hot key. Repeated rows are scored alike; an empty table gives no rows.
    """
    small_batches(docs.sparkSession, 500)  # the words of a batch are objects, some twenty times the text
    held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    words = settle(count_words(slim))
    is_word = F.col("junction") == NO_JUNCTION
    total, distinct = words.where(is_word).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.count_if(F.col("n") > 0), F.lit(0))).first()
    mass = total + 0.1 * (distinct + 1)
    scored = settle(word_scores(words, most_sent))
    common = _commonest(scored.where(is_word), head[0]).select("word", "n", "score").toArrow()
    joints = _commonest(scored.where(~is_word), head[1]).select("junction", "score").toArrow()
    n, joint = common.column("n").to_numpy(), joints.column("junction").to_numpy()
    order = np.argsort(joint)
    sent = docs.sparkSession.sparkContext.broadcast((
        {w: i for i, w in enumerate(common.column("word").to_pylist())}, np.log10((n + 0.1) / mass), common.column("score").to_numpy(), n > 0,
        joint[order], joints.column("score").to_numpy()[order],
    ))
    schema = pa.schema([
        ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("word", pa.binary()), ("junction", pa.int64()), ("times", pa.int64()),
        ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()),
    ])

    def run(batches):
        from pyspark import TaskContext

        place, bases, scores, knowns, known_joints, joint_scores = sent.value
        start = TaskContext.get().partitionId() << 40
        for batch in batches:
            m = batch.num_rows
            words, joint, owner = split(batch.column(2).to_pylist())
            sums, known = np.zeros((m, 2)), np.zeros(m, np.int64)
            names, times, rows = [], [], np.zeros(m, np.int64)
            for r, found in enumerate(words):
                counts = Counter(found)
                at = np.fromiter(map(place.get, counts, repeat(-1)), np.int64, len(counts))
                c = np.fromiter(counts.values(), np.int64, len(counts))
                here = at >= 0
                if not here.all():
                    names += compress(counts, (~here).tolist())
                    times.append(c[~here])
                    rows[r] = len(times[-1])
                    at, c = at[here], c[here]
                sums[r] = c @ bases[at], c @ scores[at]
                known[r] = c @ knowns[at]
            tail = [(np.repeat(np.arange(m), rows), names, np.full(len(names), NO_JUNCTION), np.concatenate(times) if times else np.empty(0, np.int64))]
            order = np.argsort(joint)  # sorted lookups walk the table once
            joint, owner = joint[order], owner[order]
            at = np.minimum(np.searchsorted(known_joints, joint), max(0, len(known_joints) - 1))
            here = known_joints[at] == joint if len(known_joints) else np.zeros(len(joint), bool)
            if len(known_joints):
                sums[:, 1] += np.bincount(owner[here], joint_scores[at[here]], m)
            lone = int((~here).sum())
            tail.append((owner[~here], [NO_WORD] * lone, joint[~here], np.ones(lone, np.int64)))
            # the rows' own sums; OWN with the row's number meets nothing
            tail.append((np.arange(m), [OWN] * m, start + np.arange(m), np.zeros(m, np.int64)))
            of = np.concatenate([t[0] for t in tail])
            k = len(of) - m
            own = lambda x: np.concatenate([np.zeros(k, x.dtype), x])  # noqa: B023, E731
            n = np.fromiter(map(len, words), np.int64, m)
            size = n + np.fromiter((sum(map(len, w)) for w in words), np.int64, m)
            yield pa.RecordBatch.from_arrays([
                pa.array(start + of), batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array([w for t in tail for w in t[1]], pa.binary()),
                pa.array(np.concatenate([t[2] for t in tail])), pa.array(np.concatenate([t[3] for t in tail])), pa.array(own(n)), pa.array(own(size)), pa.array(own(known)), pa.array(own(sums[:, 0])), pa.array(own(sums[:, 1])),
            ], schema=schema)
            start += m

    parts = slim.mapInArrow(run, "row long, doc_id long, held_out boolean, word binary, junction long, times long, n_tokens long, n_bytes long, n_known long, base double, score double")
    tail = scored.select("word", "junction", F.col("n").alias("c"), F.col("score").alias("own"))
    c = F.coalesce("c", F.lit(0))
    unigram = F.when(is_word, F.log10((c + F.lit(0.1)) / F.lit(mass))).otherwise(0.0)
    met = parts.join(tail, ["word", "junction"], "left").select(
        "row", "doc_id", "held_out", "n_tokens", "n_bytes", (F.col("n_known") + F.when(is_word & (c > 0), F.col("times")).otherwise(0)).alias("n_known"),
        (F.col("base") + F.col("times") * unigram).alias("base"), (F.col("score") + F.col("times") * F.coalesce("own", F.lit(0.0))).alias("score"),
    )
    return met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), F.sum("base").alias("base_score"), F.sum("score").alias("score"),
        F.sum("n_bytes").alias("n_bytes"), (-F.sum("score") / math.log10(2) / F.sum("n_bytes")).alias("bits_per_byte"),
    ).drop("row")
