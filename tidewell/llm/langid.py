"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs. A trigram's vector binds its letters' vectors, each
permuted by its place; a text's vector bundles (sums) its trigrams' vectors; a language's
prototype bundles those of its training texts. A text takes the language whose prototype has
the largest cosine with it. Signs are kept as bits, so binding is exclusive or.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, free

#: Signs of a vector; a multiple of 64.
DIMENSIONS = 1024
#: Code points whose vectors are held ready.
READY = 2048
#: Trigrams bundled at once.
BLOCK = 2048


def _words(codes: np.ndarray) -> np.ndarray:
    """Random bits of code points: splitmix64 of (code, word)."""
    n = DIMENSIONS // 64
    x = (codes.astype(np.uint64)[:, None] * np.uint64(n) + np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _permute(v: np.ndarray) -> np.ndarray:
    """A fixed permutation of places: words move on by one, bits of each turn by one."""
    v = np.roll(v, 1, axis=-1)
    return (v << np.uint64(1)) | (v >> np.uint64(63))


class Space:
    """Letters, trigrams and bundles."""

    def __init__(self):
        self.plain = _words(np.arange(READY))
        self.once = _permute(self.plain)
        self.twice = _permute(self.once)
        self.letter = np.zeros(0x110000, bool)
        self.letter[[c for c in range(0x110000) if chr(c).isalpha()]] = True

    def trigrams(self, text: str) -> np.ndarray:
        """Keys (three code points of 21 bits) of the lower-cased text's trigrams; other characters are blanks, runs of them one."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        codes = np.where(self.letter[codes], codes, 0)
        if not codes.any():
            return np.empty(0, np.int64)
        codes = np.concatenate(([0], codes, [0]))
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        codes = codes[keep]
        return (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]

    def _vectors(self, keys: np.ndarray) -> np.ndarray:
        a, b, c = keys >> 42, (keys >> 21) & 0x1FFFFF, keys & 0x1FFFFF
        if max(a.max(), b.max(), c.max()) < READY:
            return self.twice[a] ^ self.once[b] ^ self.plain[c]
        return _permute(_permute(_words(a))) ^ _permute(_words(b)) ^ _words(c)

    def bundle(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the trigrams' sign vectors, each as often as it counts."""
        total = np.zeros(DIMENSIONS)
        for at in range(0, len(keys), BLOCK):
            n = counts[at : at + BLOCK].astype(np.float32)
            bits = np.unpackbits(self._vectors(keys[at : at + BLOCK]).view(np.uint8), axis=1)
            total += n.sum(dtype=np.float64) - 2.0 * (n @ bits.astype(np.float32))
        return total


@functools.cache
def the_space() -> Space:
    """The process's own, kept over tasks."""
    return Space()


def prototypes(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most_languages: int = 10_000) -> dict[str, np.ndarray]:
    """Unit prototypes of the languages of ``docs``, of all its texts.

    Each task bundles what it reads and sends one vector a language, summed by place in Spark,
    so the driver gets languages x DIMENSIONS numbers. A table of more than ``most_languages`` is refused.
    """
    schema = pa.schema([("lang", pa.string()), ("place", pa.int32()), ("x", pa.float64())])

    def run(batches):
        space, sums = the_space(), {}
        for batch in batches:
            held: dict[str, list] = {}
            sizes: dict[str, int] = {}

            def bundle(lang: str) -> None:
                keys, counts = np.unique(np.concatenate(held.pop(lang)), return_counts=True)  # noqa: B023
                sizes.pop(lang)  # noqa: B023
                if len(keys):
                    sums[lang] = sums.get(lang, 0) + space.bundle(keys, counts)

            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = space.trigrams(text)
                held.setdefault(lang, []).append(keys)
                sizes[lang] = sizes.get(lang, 0) + len(keys)
                if sizes[lang] > 1_000_000:
                    bundle(lang)
            for lang in list(held):
                bundle(lang)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS, pa.string()), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(total)], schema=schema)

    slim = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    # sums of whole numbers: exact in any order
    parts = slim.mapInArrow(run, "lang string, place int, x double").groupBy("lang", "place").agg(F.sum("x").alias("x"))
    rows = parts.groupBy("lang").agg(F.collect_list(F.struct("place", "x")).alias("v")).limit(most_languages + 1).collect()
    if len(rows) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    out = {}
    for r in rows:
        v = np.zeros(DIMENSIONS)
        for place, x in r["v"]:
            v[place] = x
        if (norm := np.linalg.norm(v)) > 0:
            out[r["lang"]] = v / norm
    return dict(sorted(out.items()))


def predict(docs: DataFrame, known: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang_pred, score) and the columns in ``keep``, for every row.

    score is the cosine, 0 where it is negative. Texts that are null or without letters, and all
    texts where no language is known, are ``und`` with score 0. Ties go to the first name.
    Repeated rows are predicted alike; an empty table gives no rows.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keep)
    kept = [pa.field(f.name, t) for f, t in zip(slim.schema.fields[2:], _arrow_types(slim, keep))]
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), *kept])
    tag = judge(known)

    def run(batch: pa.RecordBatch) -> dict:
        found = [tag(text) for text in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]} | {f.name: batch.column(2 + i) for i, f in enumerate(kept)}

    return arrow_map(slim, run, schema)


def judge(known: dict[str, np.ndarray]):
    """A function from a text to (language, cosine, number of trigrams)."""
    names, matrix = list(known), np.array(list(known.values()))

    def tag(text: str | None) -> tuple[str, float, int]:
        space = the_space()
        keys, counts = np.unique(space.trigrams(text or ""), return_counts=True)
        if not len(keys) or not names:
            return "und", 0.0, 0
        v = space.bundle(keys, counts)
        cos = matrix @ v / max(np.linalg.norm(v), 1e-12)
        best = int(cos.argmax())
        return names[best], float(min(1.0, max(0.0, cos[best]))), int(counts.sum())

    return tag


def tagger(known: dict[str, np.ndarray]):
    """A column function: text to (lang, score, trigrams)."""
    tag = judge(known)

    @F.pandas_udf("lang string, score double, trigrams long")
    def column(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tag(t) for t in texts], columns=["lang", "score", "trigrams"])

    return column


def _arrow_types(df: DataFrame, keep: tuple[str, ...]) -> list:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(df.schema[c].dataType) for c in keep]


def is_held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.35, long: int = 200) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is told.

    Texts that are ``und`` go, and so do those of ``long`` trigrams or more that resemble no language
    (cosine below ``least``): lists of symbols, one word over and over. Short texts stay, as little can be told from them.
    Null and letterless texts are ``und``, so they go; rows that repeat have one fate; every row that stays keeps its own
    columns, whatever their names; an empty table gives no rows.
    """
    known = prototypes(docs.where(~is_held_out(id_col)), lang_col, text_col)
    tag = free(docs, "__tag")
    tagged = docs.withColumn(tag, tagger(known)(F.col(text_col)))
    return tagged.where((F.col(f"{tag}.lang") != "und") & ((F.col(f"{tag}.score") >= least) | (F.col(f"{tag}.trigrams") < long))).drop(tag)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): rows with crc32(id) mod 3 = 1 are held out of the learning.

    A null id counts as the empty string. Other columns are never read by a prediction.
    """
    held_out = is_held_out(id_col)
    known = prototypes(docs.where(~held_out), lang_col, text_col)
    found = predict(docs, known, id_col, text_col, keep)
    return found.select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score", *keep)
