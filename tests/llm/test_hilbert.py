import itertools
import zlib

import numpy as np

from tidewell.llm import hilbert

from .fixtures import frame


def test_curve_is_a_walk_of_unit_steps():
    for dims, bits in ((2, 4), (3, 3)):
        points = np.array(list(itertools.product(range(2**bits), repeat=dims)))
        index = hilbert.hilbert_index(points, bits)
        assert sorted(index) == list(range(2 ** (bits * dims)))
        walk = points[np.argsort(index)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def check(rows, got, shards):
    assert len(got) == len(rows)
    body = lambda t: (t or "").encode()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(((i, len(body(t)) + 8, zlib.crc32(body(t))) for i, t in rows), key=str)
    counts = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(shards)]
    assert all(c == list(range(len(c))) for c in counts)
    assert max(map(len, counts)) - min(map(len, counts)) <= 1
    last = -1
    for r in sorted(got, key=lambda r: (r["shard"], r["slot"])):
        assert r["hilbert"] >= last
        last = r["hilbert"]


def test_edge_rows(spark):
    df = frame(spark)
    check([(r["doc_id"], r["text"]) for r in df.collect()], hilbert.hilbert_shards(df, 5).collect(), 5)


def test_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = hilbert.hilbert_shards(df, 24).collect()
    check([(r["doc_id"], r["text"]) for r in df.collect()], got, 24)
    place = {r["doc_id"]: r["hilbert"] for r in got}
    text = {}
    for r in df.collect():
        text.setdefault(r["text"], set()).add(place[r["doc_id"]])
    assert all(len(v) == 1 for v in text.values())  # copies lie together


def test_empty(spark):
    assert hilbert.hilbert_shards(frame(spark, [])).count() == 0
