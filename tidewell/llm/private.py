"""Personal data: fixed patterns, and a skip-chain conditional random field.

Tokens that look like contact data but match no pattern (a number without its +, an address
without its last part) are labelled together with the matched ones. Adjacent candidates share
chain potentials; candidates whose digits or letters repeat or nearly repeat, however far apart,
share skip potentials; loopy sum-product message passing makes labels agree over the document.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive: a shorter run of digits never helps, so the matches are those of the plain pattern
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What may be personal data without matching: numbers of 7 digits and more, quads, words with an @.
NUMBER = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+")
SPLIT_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+(?:\x20?[\[(](?:at|AT)[\])]\x20?|@)[A-Za-z0-9-]+(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]+)*")
NOT_DIGIT = re.compile(r"[^0-9]+")
NOT_ALNUM = re.compile(r"[^A-Za-z0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outward, so long runs of letters cost nothing."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = last = m.end()
        at = text.find("@", end)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by kind, then start."""
    out = [(a, b, "email") for a, b in emails(text)]
    if not any(d in text for d in "0123456789"):
        return out
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m.group().split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Spans that may be personal data and overlap no matched span."""
    found = [m.span() for m in NUMBER.finditer(text)] if any(d in text for d in "0123456789") else []
    if "@" in text or "[at]" in text or "(at)" in text or "[AT]" in text or "(AT)" in text:
        found += split_addresses(text)
    out, taken, i = [], sorted((a, b) for a, b, _ in base), 0
    for a, b in sorted(found):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if (i == len(taken) or taken[i][0] >= b) and (not out or out[-1][1] <= a):
            out.append((a, b))
    return out


def split_addresses(text: str) -> list[tuple[int, int]]:
    out = []
    for m in re.finditer(r"@|[\[(](?:at|AT)[\])]", text):
        lo = m.start() - (text[m.start() - 1 : m.start()] == " " and m.group() != "@")
        start = lo
        while start > 0 and text[start - 1] in LOCAL:
            start -= 1
        if start < lo and (found := SPLIT_ADDRESS.match(text, start)):
            out.append(found.span())
    return out


FEATURES = 14


def features(text: str, a: int, b: int) -> list[float]:
    """What a candidate looks like; nothing here tests a fixed pattern."""
    s = text[a:b]
    digits = sum(c in "0123456789" for c in s)
    letters = sum(c.isalpha() for c in s)
    return [
        1.0, float("@" in s or "at" in s.lower() and letters > 0), float(s.startswith("+")), float(s.count(".") == 3 and not letters), float("(" in s), float(" " in s), float("-" in s),
        float(digits <= 7), float(8 <= digits <= 12), float(13 <= digits <= 15), float(16 <= digits <= 19), float(digits > 19), float(letters > 0), digits / max(1, len(s)),
    ]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: Iterable[str], rounds: int = 200, rate: float = 0.5) -> dict:
    """Unary weights by softmax regression, chain and skip weights by agreement counts.

    The labels are those of the fixed patterns; candidates without a match are labelled none.
    """
    x, y, chain, agree, pairs = [], [], np.ones((5, 5)), 1.0, 2.0
    for text in texts:
        base = base_spans(text)
        nodes = sorted([(a, b, LABELS.index(k)) for a, b, k in base] + [(a, b, 0) for a, b in candidates(text, base)])
        x += [features(text, a, b) for a, b, _ in nodes]
        y += [k for _, _, k in nodes]
        for (_, _, p), (_, _, q) in zip(nodes, nodes[1:]):
            chain[p, q] += 1
        named = [(key_of(text[a:b]), k) for a, b, k in nodes if k]
        for (s, p), (t, q) in zip(sorted(named), sorted(named)[1:]):
            if s == t:
                agree, pairs = agree + (p == q), pairs + 1
    weights = np.zeros((FEATURES, 5))
    if x:
        xs, onehot = np.array(x), np.eye(5)[y]
        for _ in range(rounds):
            weights -= rate * (xs.T @ (softmax(xs @ weights) - onehot) / len(xs) + 1e-3 * weights)
    # chain: how much more often labels are neighbours than their shares would have it, held small
    share = chain / chain.sum()
    lift = np.log(share / (share.sum(1, keepdims=True) * share.sum(0, keepdims=True)))
    skip = min(6.0, max(4.0, float(np.log(agree / max(0.5, pairs - agree) * 4))))
    return {"unary": weights, "chain": np.clip(lift, -0.5, 0.5), "skip": skip}


def key_of(s: str) -> str:
    """What repeats: the letters and digits of an address, the digits of a number."""
    return NOT_ALNUM.sub("", s.lower().replace("[at]", "").replace("(at)", "").replace("[dot]", "").replace("(dot)", "")) if any(c.isalpha() for c in s) else NOT_DIGIT.sub("", s)


def skip_edges(keys: list[str]) -> list[tuple[int, int]]:
    """Pairs of nodes with equal or similar keys: each is tied to the next in groups that share
    the whole key, its last 8 digits, or its first 10 letters, so edges stay linear in the nodes."""
    out = set()
    groups: dict[tuple[str, str], int] = {}
    for i, k in enumerate(keys):
        marks = [("=", k)]
        if k.isdigit():
            marks += [("<", k[-8:])] if len(k) >= 8 else []
        else:
            marks += [(">", k[:10])] if len(k) >= 10 else []
        for m in marks:
            if m in groups:
                out.add((groups[m], i))
            groups[m] = i
    return sorted(out)


def label(unary: np.ndarray, edges: list[tuple[int, int, np.ndarray]], rounds: int = 12, damping: float = 0.3) -> np.ndarray:
    """Posterior of each node's label by loopy sum-product message passing (log domain)."""
    n = len(unary)
    if not edges:
        return softmax(unary)
    src = np.array([e[0] for e in edges] + [e[1] for e in edges])
    dst = np.array([e[1] for e in edges] + [e[0] for e in edges])
    pot = np.array([e[2] for e in edges] + [e[2].T for e in edges])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    msg = np.zeros((len(src), unary.shape[1]))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        out = (belief[src] - msg[back])[:, :, None] + pot
        top = out.max(axis=1, keepdims=True)
        new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
        new -= new.max(axis=1, keepdims=True)
        msg = damping * msg + (1 - damping) * new
    belief = unary.copy()
    np.add.at(belief, dst, msg)
    return softmax(belief)


def added_spans(text: str, base: list[tuple[int, int, str]], model: dict, least: float) -> list[tuple[int, int, str]]:
    more = candidates(text, base)
    if not more:
        return []
    nodes = sorted([(a, b, LABELS.index(k)) for a, b, k in base] + [(a, b, -1) for a, b in more])
    unary = np.array([features(text, a, b) for a, b, _ in nodes]) @ model["unary"]
    for i, (_, _, k) in enumerate(nodes):
        if k >= 0:  # observed
            unary[i] = -30.0
            unary[i, k] = 0.0
    skip = np.eye(5) * model["skip"]
    edges = [(i, i + 1, model["chain"]) for i in range(len(nodes) - 1)]
    edges += [(i, j, skip) for i, j in skip_edges([key_of(text[a:b]) for a, b, _ in nodes])]
    post = label(unary, edges)
    return [(a, b, LABELS[int(p.argmax())]) for (a, b, k), p in zip(nodes, post) if k < 0 and p.argmax() and p.max() >= least]


def scan_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 2000, least: float = 0.9) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, end, kind) in code points, for every row.

    base holds the fixed patterns' spans, spans these and the added ones, each by kind, then start.

    The field's weights are fitted on ``sample`` documents (those first by a digest of their id)
    whose labels are the fixed patterns'; everything else covers all rows and whole texts. Null and empty texts have
    no spans; repeated rows are scanned alike; other columns are ignored; an empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = F.xxhash64("doc_id")
    first = slim.select("doc_id").orderBy(order, "doc_id").limit(sample)
    edge = first.agg(F.max(order)).first()[0]
    texts = () if edge is None else (r["text"] or "" for r in slim.where(order <= edge).orderBy(order, "doc_id").limit(sample).select("text").toLocalIterator())
    model = train(texts)  # whole texts, read one after the other
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    schema = pa.schema([("doc_id", pa.int64()), ("base", span), ("spans", span)])

    def run(batch: pa.RecordBatch) -> dict:
        base, spans = [], []
        place = lambda s: (KINDS.index(s[2]), s[0])
        rows = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]
        for text in batch.column(1).to_pylist():
            found = base_spans(text or "")
            base.append(rows(found))
            spans.append(rows(sorted(found + added_spans(text or "", found, model, least), key=place)))
        return {"doc_id": batch.column(0), "base": base, "spans": spans}

    return arrow_map(slim, run, schema)
