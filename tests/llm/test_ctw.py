import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewell.llm import ctw

from .fixtures import frame


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def steps(text):
    """(context, most recent byte first; byte) of every byte of the coded text."""
    before = b""
    for w in tokens(text):
        line = b"\n" if w is None else w.encode() + b" "
        for k in range(len(line)):
            past = (before[-ctw.TAIL :] if k < ctw.LEAD else b"") + b" " + line[:k]
            yield (b"\0" * ctw.DEPTH + past)[-ctw.DEPTH :][::-1], line[k]
        before = line[:-1]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


class Slow:
    """The tree as defined, node by node."""

    def __init__(self, rows):
        self.n = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        self.memo = {}
        for i, t in rows:
            if not held(i):
                self.visit(t, self.learn)

    def visit(self, text, do):
        return sum(do(context, (1 << b) | (y >> (8 - b)), y >> (7 - b) & 1) or 0 for context, y in steps(text) for b in range(8))

    def learn(self, context, bits, bit):
        for d in range(ctw.DEPTH + 1):
            self.n[context[:d], bits][bit] += 1
            if d:
                self.children[context[: d - 1], bits].add((context[:d], bits))

    def kt(self, node):
        a, b = self.n[node] if node in self.n else (0, 0)
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, node):
        if node not in self.memo:
            own = self.kt(node)
            if len(node[0]) < ctw.DEPTH:
                below = sum(self.weighted(c) for c in self.children.get(node, ()))
                own = np.logaddexp(own, below) + math.log(0.5)
            self.memo[node] = float(own)
        return self.memo[node]

    def one(self, context, bits, d=0):
        """Probability of a one: the next symbol's by the weights so far."""
        node = (context[:d], bits)
        a, b = self.n[node] if node in self.n else (0, 0)
        own = (b + 0.5) / (a + b + 1)
        if d == ctw.DEPTH:
            return own
        share = math.exp(math.log(0.5) + self.kt(node) - self.weighted(node))
        return share * own + (1 - share) * self.one(context, bits, d + 1)

    def cost(self, context, bits, bit):
        p = self.one(context, bits)
        return math.log10(p if bit else 1 - p)


def check(rows, got):
    slow = Slow(rows)
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        words = tokens(t)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        want.append((i, held(i), len(words), sum(counts[w] > 0 for w in words), total, base, slow.visit(t, slow.cost)))
    key = lambda r: (str(r[0]), r[2], r[5])
    for r in got:
        assert r["bits_per_byte"] == pytest.approx(-r["score"] / math.log10(2) / r["n_bytes"])
    size = lambda t: sum(len(w) + 1 for w in (t or "").encode().split()) + 1
    assert sorted(r["n_bytes"] for r in got) == sorted(size(t) for _, t in rows)
    got, want = sorted((tuple(r)[:7] for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.array([r[5:] for r in got]) == pytest.approx(np.array([r[5:] for r in want]), rel=1e-9)


@pytest.mark.parametrize("head, most_sent", [((1 << 18, 1 << 20), 1 << 23), ((3, 2), 1 << 23), ((0, 0), 0)])
def test_against_brute_force(spark, head, most_sent):
    rows = [(i, t) for i, t in enumerate(["the cat sat on the mat", "The dog\tsat", None, "", "é ü éa", "a" * 40, "the the cat", "on a mat", "dog cat", "zzz qqq", "cat", "new words here", "\x00\x01"])]
    df = frame(spark, [(i, t, "en", "s", 0, 0, None, None, 0) for i, t in rows])
    check(rows, ctw.score_texts(df, head=head, most_sent=most_sent).collect())


def test_edge_rows(spark):
    df = frame(spark).where("length(text) < 10000 or text is null")
    check([(r["doc_id"], r["text"]) for r in df.collect()], ctw.score_texts(df).collect())
    assert ctw.score_texts(frame(spark)).count() == frame(spark).count()
    assert ctw.score_texts(frame(spark, [])).count() == 0
    lone = ctw.score_texts(frame(spark, [(i, "a", None, None, 1, 0, None, None, 0) for i in range(40) if held(i)])).collect()
    assert lone and all(r["train_tokens"] == 0 and r["score"] == pytest.approx(-24 * math.log10(2)) for r in lone)


def test_chunks_make_no_difference(spark, sf_dir):
    words = ctw.count_words(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id % 2 = 0 AS held_out", "text"))
    whole, top = ctw.learn(words)
    parts, top2 = ctw.learn(words, chunk=100)
    one, two = ({r["key"]: np.frombuffer(r["one"]) for r in x.collect()} for x in (whole, parts))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)
    assert top.one == pytest.approx(top2.one) and top.rest == pytest.approx(top2.rest)


def test_held_out_texts_cost_less_than_by_words(spark):
    got = [r for r in ctw.score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
