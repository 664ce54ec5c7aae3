import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tidewell.llm import phrases

from .fixtures import SCHEMA, frame


def brute(rows, support, top, longest=4, drop=80):
    """Counts every phrase in dictionaries, then ranks."""
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, found in counts.items():
        often = {p: a for p, a in found.items() if a >= support and len(p) > 1}
        kept = []
        for p, a in often.items():
            if any(100 * b >= drop * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in often.items() if len(q) > len(p)):
                continue
            score, _, left, right = min((2_000_000 * a // (found[p[:k]] + found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(count=400):
    rng = random.Random(4)
    vocabulary = ["New", "york", "times", "straße", "the", "of", "a", "ünï", "x", "\U0001f600", "zzz", "\xa0nb"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    ends = [" "] * 12 + ["\t", ". ", ", ", "\n", "!?", "\r\n", "  "]
    made = []
    for i in range(count):
        words = rng.choices(vocabulary, weights, k=rng.randint(0, 40)) + (["big", "red", "Fox", "jumps"] if i % 3 == 0 else [])
        made.append(("".join(w + rng.choice(ends) for w in words), rng.choice(["en", "en", "en", "de", None])))
    return made


def table(spark, pairs):
    return frame(spark, [(i, t, g, "s", 1, 1, "fp", "key", 1) for i, (t, g) in enumerate(pairs)]).repartition(5)


@pytest.mark.parametrize("buckets", [64, 1 << 10, 1 << 18])
def test_against_counting_everything(spark, buckets):
    """With few buckets most bits are shared: more is counted, the result is the same."""
    pairs = corpus()
    assert rows_of(phrases.collocations(table(spark, pairs), top=40, support=12, buckets=buckets)) == brute(pairs, 12, 40)


def test_awkward_rows(spark):
    """Null and empty texts have no words, a null language is ``und``, rows that repeat count twice, other columns are ignored."""
    got = rows_of(phrases.collocations(frame(spark), support=3, buckets=1 << 12))
    from .fixtures import rows

    assert got == brute([(r[1], r[2]) for r in rows()], 3, 2000) and got


def test_empty_table(spark):
    found = phrases.collocations(spark.createDataFrame([], SCHEMA), buckets=1 << 10)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and found.count() == 0


def test_chunks_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 50)
    pairs = corpus(60) + [("one two three " * 3000, "en")]
    assert rows_of(phrases.collocations(table(spark, pairs), support=10, buckets=1 << 12)) == brute(pairs, 10, 2000)


def test_numbers_beyond_64_bits_and_ties(spark):
    """Counts whose products pass 64 bits; of cuts that tie the first counts; ties of score go by count, then bytes."""
    big = 7 * 10**17
    one = spark.createDataFrame([("en", bytearray(w.encode()), c) for w, c in [("a", big), ("b", big + 3), ("c", big), ("Z", 60), ("é", 60), ("y", 60)]], "lang string, phrase binary, count long")
    two = spark.createDataFrame([("en", bytearray(w.encode()), c) for w, c in [("a b", big - 5), ("b c", big - 5), ("Z y", 40), ("é y", 40)]], "lang string, phrase binary, count long")
    three = spark.createDataFrame([("en", bytearray(b"a b c"), big // 2)], "lang string, phrase binary, count long")
    words = spark.createDataFrame([("en", 4 * big)], "lang string, n long")
    got = rows_of(phrases.ranked([one, two, three], words))
    score = lambda a, l, r: 2_000_000 * a // (l + r)
    assert got == [
        ("en", 1, "a b", big - 5, big, big + 3, 4 * big, score(big - 5, big, big + 3)), ("en", 2, "b c", big - 5, big + 3, big, 4 * big, score(big - 5, big + 3, big)),
        ("en", 3, "Z y", 40, 60, 60, 4 * big, 666_666), ("en", 4, "é y", 40, 60, 60, 4 * big, 666_666), ("en", 5, "a b c", big // 2, big, big - 5, 4 * big, score(big // 2, big, big - 5)),
    ]


def test_sql_agrees(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert rows_of(phrases.collocations(docs, buckets=1 << 16)) == sorted(db.execute(phrases.SQL).fetchall())
