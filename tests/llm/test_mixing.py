import re
from collections import defaultdict

import pytest

from tidewell.llm import mixing

from .fixtures import frame


def slow_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / free for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def check(rows, got):
    sizes = defaultdict(int)
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for i, t, s in rows:
        sizes[s] += n(t)
    want = slow_targets(sizes)
    assert sorted(((r["doc_id"], r["size"], r["source_size"]) for r in got), key=str) == sorted(((i, n(t), sizes[s]) for i, t, s in rows), key=str)
    took = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        took[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(took[s] - want[s]) <= 1


def test_edge_rows(spark):
    df = frame(spark)
    check([(r["doc_id"], r["text"], r["source"]) for r in df.collect()], mixing.mix(df).collect())


def test_documents_and_reruns(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = mixing.mix(df).collect()
    check([(r["doc_id"], r["text"], r["source"]) for r in df.collect()], got)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_whole_epochs_come_first(spark, sf_dir):
    for r in mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect():
        epochs = int(r["target"] / r["source_size"] + 1e-9)
        assert epochs * r["size"] <= r["taken"] <= (epochs + 1) * r["size"]


def test_native(spark, sf_dir):
    plan = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty(spark):
    assert mixing.mix(frame(spark, [])).count() == 0


def test_wordless(spark):
    got = mixing.mix(frame(spark, [(1, None, "en", "a", 0, 0, None, None, 0), (2, " ", "en", "b", 0, 0, None, None, 0)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2
