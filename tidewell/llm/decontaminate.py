"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may be changed in k of them. Cut into k + 1 pieces, one piece must
then stand in the text untouched, so an automaton over all pieces finds every place worth
looking at, and the item is verified around each hit with Myers's bit-parallel edit distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, settle


def normal(text: str) -> str:
    """Lower case, blanks collapsed. Offsets of results are in this form."""
    return " ".join(text.lower().split())


class Myers:
    """Semi-global edit distance of one pattern, all columns of the matrix held as bits of a number."""

    def __init__(self, pattern: str):
        self.size = len(pattern)
        self.full = (1 << self.size) - 1
        self.top = 1 << (self.size - 1)
        self.at: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.at[c] = self.at.get(c, 0) | (1 << i)

    def best(self, text: str) -> tuple[int, int]:
        """(least distance of the pattern to a substring, where the first such substring ends)."""
        plus, minus, score = self.full, 0, self.size
        best, end = score, 0
        at, full, top = self.at, self.full, self.top
        for i, c in enumerate(text, 1):
            eq = at.get(c, 0)
            x = eq | minus
            d = ((((x & plus) + plus) & full) ^ plus) | x
            up = minus | (full & ~(d | plus))
            down = plus & d
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up = (up << 1) & full
            down = (down << 1) & full
            plus = down | (full & ~(d | up))
            minus = up & d
            if score < best:
                best, end = score, i
        return best, end


class Item:
    """A test item in normal form, with its error budget and pieces."""

    def __init__(self, item_id: int, text: str, rate: float):
        self.item_id, self.text = item_id, normal(text)
        n = len(self.text)
        self.budget = int(n * rate)
        k = self.budget + 1
        self.pieces = [(n * i // k, self.text[n * i // k : n * (i + 1) // k]) for i in range(k)] if n else []
        self.myers = Myers(self.text) if n else None


class Matcher:
    """All items of a block."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [i for i in (Item(n, t, rate) for n, t in items) if i.pieces]
        uses: dict[str, list[tuple[int, int]]] = {}
        for i, item in enumerate(self.items):
            for offset, piece in item.pieces:
                uses.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in uses.items():
            self.automaton.add_word(piece, (len(piece), where))
        if uses:
            self.automaton.make_automaton()
        self.seen: dict[tuple[int, str], tuple[int, int]] = {}

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(index of item, end in the normal text, distance) of the best match of each item within budget."""
        if not self.items or not text:
            return []
        windows: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for i, offset in where:
                item = self.items[i]
                a = max(0, end + 1 - size - offset - item.budget)
                b = min(len(text), end + 1 - size - offset + len(item.text) + item.budget)
                got = windows.setdefault(i, [])
                if got and a <= got[-1][1]:  # hits come in order of their ends: overlapping windows are joined
                    got[-1][0], got[-1][1] = min(got[-1][0], a), max(got[-1][1], b)
                else:
                    got.append([a, b])
        out = []
        for i, spans in windows.items():
            item, best = self.items[i], None
            for a, b in spans:
                d, end = self.distance(i, text[a:b])
                if d <= item.budget and (best is None or d < best[0]):
                    best = (d, a + end)
            if best:
                out.append((i, best[1], best[0]))
        return out

    def distance(self, i: int, window: str) -> tuple[int, int]:
        """Verified distance; passages that many documents share are verified once a task."""
        item = self.items[i]
        exact = window.find(item.text)
        if exact >= 0:
            return 0, exact + len(item.text)
        key = (i, window)
        got = self.seen.get(key)
        if got is None:
            if len(self.seen) > 2_000:
                self.seen.clear()
            got = self.seen[key] = item.myers.best(window)
        return got


#: Blocks of items that one pass over the documents serves.
BLOCKS = 4
#: The matchers a worker process holds, by the digest of their items: those of one pass, kept over tasks.
_held: dict[str, Matcher] = {}


def _name(block: list[tuple[int, str]], rate: float) -> str:
    return hashlib.md5(repr((block, rate)).encode("utf-8", "surrogatepass")).hexdigest()


def _matcher(name: str, block: list[tuple[int, str]], rate: float) -> Matcher:
    if name not in _held:
        while len(_held) >= BLOCKS:
            _held.pop(next(iter(_held)))
        _held[name] = Matcher(block, rate)
    return _held[name]


def _passes(found: Iterable[list[tuple[int, str]]]) -> Iterator[list[list[tuple[int, str]]]]:
    """The blocks in groups that one pass serves."""
    rest = iter(found)
    while group := list(islice(rest, BLOCKS)):
        yield group


def leaks(docs: DataFrame, items: DataFrame, rate: float = 0.06, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, end, distance, budget): every item that a document holds within its budget.

    The budget is ``rate`` of the item's characters, rounded down; ``end`` is where the item's
    first best match ends in the text in normal form (lower case, blanks collapsed). Items are
    read to the driver in blocks of about ``block_bytes`` characters, and one pass over the documents serves BLOCKS of them, so
    the automata a task holds are bounded; items beyond that take another pass. Null and empty texts and items match nothing; items that
    repeat are all reported; a repeated document is reported as often as it stands; texts are
    matched whole; an empty table on either side gives no rows.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("end", pa.int64()), ("distance", pa.int64()), ("budget", pa.int64())])

    def over(group: list[list[tuple[int, str]]]) -> DataFrame:
        named = [(_name(block, rate), block) for block in group]

        def run(batch: pa.RecordBatch) -> dict:
            matchers = [_matcher(name, block, rate) for name, block in named]
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = normal(text or "")
                for matcher in matchers:
                    for i, end, d in matcher.find(text):
                        item = matcher.items[i]
                        for name, x in zip(out, (doc, item.item_id, end, d, item.budget)):
                            out[name].append(x)
            return out

        return arrow_map(slim, run, schema)

    found = [over(group) for group in _passes(blocks(items, item_col, item_text_col, block_bytes))] or [over([])]
    return reduce(DataFrame.unionByName, found)


def blocks(items: DataFrame, item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 4_000_000):
    """The items that have a text, in lists of about ``block_bytes`` characters."""
    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text IS NOT NULL")
    block, size = [], 0
    for r in rows.toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
        if size > block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def clean(docs: DataFrame, items: DataFrame, rate: float = 0.06, text_col: str = "text", block_bytes: int = 4_000_000) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns, whatever their names; a filter, nothing is shuffled.

    Null and empty texts hold nothing and stay; rows that repeat have one fate; without items every row stays. What is left
    after a pass (BLOCKS blocks of items) is written down before the next.
    """
    for i, group in enumerate(_passes(blocks(items, block_bytes=block_bytes))):
        docs = (settle(docs) if i else docs).where(~_holds(group, rate)(F.col(text_col)))
    return docs


def _holds(group: list[list[tuple[int, str]]], rate: float):
    named = [(_name(block, rate), block) for block in group]

    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        matchers = [_matcher(name, block, rate) for name, block in named]
        plain = [normal(t or "") for t in texts]
        return pd.Series([any(m.find(t) for m in matchers) for t in plain], dtype=bool)

    return holds
