"""Secret scan: fixed patterns, and a token-efficiency test that finds random strings.

A byte-pair vocabulary spends few tokens on words and identifiers and many on random
characters, so a long run with few characters a token is a likely secret. Runs that are known
digests or identifiers (hash digests, UUIDs, dates, numbers) are left out. Words joined by signs (paths, dotted or dashed
names) are told from keys in groups by the vocabulary too, over their letters.
"""

from __future__ import annotations

import base64
import functools
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's training split text: runs of letters, of digits, of other signs, of blanks.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KINDS = ("assign", "access", "hex", "entropy")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough
RUN = re.compile(r"[A-Za-z0-9+/_=.-]+")
#: Bytes of the digests that are written with their name.
DIGESTS = {"md5": 16, "sha1": 20, "sha224": 28, "sha256": 32, "sha384": 48, "sha512": 64}
#: Digests and identifiers that are no secrets. What follows a digest's name has to have its length, in hex or in base64 (without padding and a sign at the end, which are cut off before).
KNOWN = re.compile(
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})"
    r"|(?:[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128})"
    r"|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    + "".join(rf"|{name}[-:=](?:[0-9a-fA-F]{{{2 * n}}}|[A-Za-z0-9+/_-]{{{-(-4 * n // 3) - 1},{-(-4 * n // 3)}}})" for name, n in DIGESTS.items())
    + r"|[0-9+/_=.-]*|\d{4}-?\d\d-?\d\dT[0-9.Z+-]*"  # numbers, dates, rules
)
#: Letters of one case and short numbers, alone or joined by signs.
WORDS = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|\d{1,4})(?:[+/_=.-]+(?:[A-Z]?[a-z]+|[A-Z]+|\d{1,4}))*")
LETTERS = re.compile(r"[A-Za-z]{3,}")


class TokenEfficiency:
    """Decides whether a run of characters is random, by characters a token.

    Letters of one case alone merge a little better than mixed ones, words far better: random ones
    stay under ``letters_ratio``, words of the documents' languages above 2.1.
    """

    def __init__(self, ranks: bytes, least: int = 20, most_ratio: float = 1.9, letters_ratio: float = 2.05):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("secrets", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})
        self.least, self.most_ratio, self.letters_ratio = least, most_ratio, letters_ratio

    def random(self, run: str) -> bool:
        core = run.strip("=.-_/+")
        if len(core) < self.least or KNOWN.fullmatch(core) or len({ord(b) - ord(a) for a, b in zip(core, core[1:])}) == 1:
            return False  # the last: one character over and over, or the alphabet
        if not WORDS.fullmatch(core):
            return self.ratio([core]) < self.most_ratio
        parts = LETTERS.findall(core)
        return sum(map(len, parts)) >= 0.75 * self.least and self.ratio(parts) < self.letters_ratio

    def ratio(self, parts: list[str]) -> float:
        """Characters a token."""
        tokens = sum(len(self.encoding.encode_ordinary(p[at : at + 4096])) for p in parts for at in range(0, len(p), 4096))
        return sum(map(len, parts)) / max(1, tokens)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in order of start, then kind."""
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out


def long_words(text: str, least: int) -> list[tuple[int, str]]:
    """(start, word) of blank-separated words of ``least`` characters or more."""
    out, at = [], 0
    for w in text.split():
        if len(w) >= least:
            at = text.index(w, at)
            out.append((at, w))
            at += len(w)
    return out


def scan(text: str, test: TokenEfficiency) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Spans of the fixed patterns; the same with those the token-efficiency test adds outside them."""
    base = base_spans(text)
    words = long_words(text, min(20, test.least))
    for at, w in words:
        base += [(at + m.start(), at + m.end(), "hex") for m in HEX.finditer(w)]
    place = lambda s: (s[0], KINDS.index(s[2]))
    base.sort(key=place)
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))
    added = []
    for at, w in words:
        for m in RUN.finditer(w):
            if m.end() - m.start() < test.least:
                continue
            a, b = at + m.start(), at + m.end()
            before = bisect_left(starts, b)  # base spans that begin before the run ends
            if (not before or reach[before - 1] <= a) and test.random(m.group()):
                added.append((a, b, "entropy"))
    return base, sorted(base + added, key=place)


@functools.lru_cache(maxsize=1)
def _test(ranks: bytes, least: int, most_ratio: float) -> TokenEfficiency:
    """The process's own, kept over tasks."""
    return TokenEfficiency(ranks, least, most_ratio)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, least: int = 20, most_ratio: float = 1.9) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, end, kind) in code points, for every row.

    base holds the fixed patterns' spans, spans these and the added ones.

    Null and empty texts have no spans; whole texts are scanned, however long; repeated rows
    are scanned alike; other columns are ignored; an empty table gives no rows. The vocabulary
    (under 1 MB) is read on the driver and sent with the task.
    """
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    schema = pa.schema([("doc_id", pa.int64()), ("base", span), ("spans", span)])

    def run(batch: pa.RecordBatch) -> dict:
        test = _test(ranks, least, most_ratio)
        found = [scan(t or "", test) for t in batch.column(1).to_pylist()]
        rows = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]
        return {"doc_id": batch.column(0), "base": [rows(b) for b, _ in found], "spans": [rows(a) for _, a in found]}

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, schema)


def joined(spans: str) -> F.Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
