"""Topics found in articles by their keywords: many sets of words against whole texts in one reading."""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keywords of all topics that one reading looks for; more take further readings.
BLOCK = 200_000
_READY: dict[int, tuple] = {}


def haystack(*columns: str) -> Column:
    """What keywords are looked for in: the columns in lower case, a line each; null is empty."""
    return F.lower(F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))


def _matcher(sets: list[tuple[str, list[str]]]):
    """A column function: the topics of which every keyword stands somewhere in the text, in order.

    One automaton holds all keywords, so a text is read once whatever their number; a topic is met through its rarest place in the
    index: its keywords count down, and at none left it matches. Workers keep the automaton over batches.
    """
    key = hash(tuple((t, tuple(w)) for t, w in sets))

    def ready() -> tuple:
        if key not in _READY:
            number: dict[str, int] = {}
            of: list[list[int]] = []
            for at, (_, words) in enumerate(sets):
                for w in words:
                    if w not in number:
                        number[w] = len(of)
                        of.append([])
                    of[number[w]].append(at)
            automaton = ahocorasick.Automaton()
            for w, n in number.items():
                automaton.add_word(w, n)
            automaton.make_automaton()
            _READY.clear()
            _READY[key] = (automaton, of, [len(words) for _, words in sets])
        return _READY[key]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def topics(text: pd.Series) -> pd.Series:
        automaton, of, need = ready()

        def one(t: str) -> list[str]:
            left: dict[int, int] = {}
            for n in {n for _, n in automaton.iter(t)}:
                for at in of[n]:
                    left[at] = left.get(at, need[at]) - 1
            return [sets[at][0] for at in sorted(left) if left[at] == 0]

        return text.map(one)

    return topics


def keyword_matches(articles: DataFrame, topics: DataFrame, columns: tuple[str, ...] = ("title", "content"), topic: str = "topic", keywords: str = "keywords", block: int = BLOCK) -> DataFrame:
    """A row for each article and topic of which all keywords stand in the article, the article's columns and the topic's name.

    Case does not count, and a keyword may stand within a word. ``topics`` is a registry: a row a topic, (name, list of keywords); its keywords are sent to the tasks
    in blocks of ``block``, a reading of the articles each, so nothing is shuffled and no pair is made that does not match. Blank keywords are no keywords;
    topics without any match nothing. Rows of one name are topics of their own, and repeat the article.
    """
    listed = F.array_distinct(F.filter(F.transform(keywords, lambda k: F.lower(k)), lambda k: F.coalesce(F.regexp_like(k, F.lit(r"\S")), F.lit(False))))
    sets: list[list[tuple[str, list[str]]]] = [[]]
    held = 0
    for row in topics.select(F.col(topic).alias("t"), listed.alias("k")).where("size(k) > 0").orderBy("t", "k").toLocalIterator():
        if held and held + len(row["k"]) > block:
            sets.append([])
            held = 0
        sets[-1].append((row["t"], row["k"]))
        held += len(row["k"])
    hay = haystack(*columns)
    rest = [c for c in articles.columns if c != topic]
    found = None
    for part in sets:
        if not part:
            return articles.select(*rest).withColumn(topic, F.lit(None).cast("string")).where("false")
        one = articles.select(*rest, F.explode(_matcher(part)(hay)).alias(topic))
        found = one if found is None else found.unionByName(one)
    return found
