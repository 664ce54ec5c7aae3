"""A small documents table with the awkward cases, and helpers."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("size", T.LongType()),
    T.StructField("fp", T.StringType()), T.StructField("key", T.StringType()), T.StructField("shard", T.LongType()),
])


def rows():
    words = "the quick brown fox jumps over a lazy dog while seven wizards brew potions near old mills".split()
    base = " ".join(words * 6)
    texts = [
        base, base, base + " today", None, "", "   \n\t", "one", "one two", "Ünïcödé straße " * 5, base.upper(), "x" * 5000,
        "long " * 30000, "café\nline two\nline three\n" * 4, "  ", "a b c d", "a b c d", None, "123 456",
    ]
    sources = ["a", "b", None, "a", "c", "￮", "\U0001f600", "a", "a", "a", "b", "b", "a", "a", "c", "c", "a", "a"]
    langs = ["en", None, "en", "de", "en", "en", "fr", "en", "de", "en", "en", "en", "fr", "en", "en", "en", None, "es"]
    out = [(i, t, g, s, len(t or ""), 7, "clash", "clash", 1) for i, (t, s, g) in enumerate(zip(texts, sources, langs))]
    out.append(out[1])  # a repeated row
    out.append((None, "no id here", "en", "a", 10, 0, None, None, None))
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
