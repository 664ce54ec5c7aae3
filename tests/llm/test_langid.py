import zlib

import numpy as np
import pytest

from tidewell.llm import langid

from .fixtures import frame


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in df.collect()}
    got = langid.identify(df).collect()
    assert len(got) == len(truth)
    right = total = 0
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
        lang, text = truth[r["doc_id"]]
        if r["held_out"] and any(c.isalpha() for c in text or ""):
            right, total = right + (r["lang_pred"] == lang), total + 1
    assert right / total >= 0.97, (right, total)


def slow_vector(text, space):
    letters = [c if c.isalpha() else " " for c in text.lower()]
    line = "".join(letters)
    while "  " in line:
        line = line.replace("  ", " ")
    line = " " + line.strip() + " "
    total = np.zeros(langid.DIMENSIONS)
    sign = lambda v: 1 - 2.0 * np.unpackbits(v.view(np.uint8))
    code = lambda c: np.array([0 if c == " " else ord(c)])
    for a, b, c in zip(line, line[1:], line[2:]):
        one = langid._permute(langid._permute(langid._words(code(a))))
        two, three = langid._permute(langid._words(code(b))), langid._words(code(c))
        total += sign(one[0]) * sign(two[0]) * sign(three[0])
    return total


def test_bundles_against_brute_force():
    space = langid.Space()
    for text in ("Hello, wörld!", "漢字 and more", "a", "  x-y  "):
        keys, counts = np.unique(space.trigrams(text), return_counts=True)
        assert space.bundle(keys, counts) == pytest.approx(slow_vector(text, space))


def test_edge_rows(spark):
    df = frame(spark)
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(df, keep=("source",)).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (17, "und")} <= got
    assert langid.identify(df).count() == df.count()
    assert langid.identify(frame(spark, [])).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df.limit(4).withColumn("lang", df["lang"].substr(9, 1)).where("false").unionByName(frame(spark, [(4, "abc", None, None, 3, 0, None, None, 0)]))).collect()} == {"und"}
