import random
from collections import Counter
from itertools import combinations

import corpus_pipeline
from tidewell.llm import shingles

from .fixtures import frame


def slow_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: 32 for c in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def slow_components(rows):
    """The rows (id, text, ...) of each component over all pairs with Jaccard similarity 0.8 or more."""
    sets = [slow_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or both * 10 >= 8 * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(find(k), []).append(r)
    return list(groups.values())


def slow_kept(rows):
    """The least id of each component."""
    least = [min((r[0] is None, r[0] or 0) for r in g) for g in slow_components(rows)]
    return sorted((None if none else i for none, i in least), key=str)


def test_stage_against_all_pairs(spark, sf_dir):
    """Documents of sf0.001 with near copies planted about the bound: the stage keeps one of each component of all pairs."""
    rng = random.Random(5)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    long = [r for r in rows if 60 < len((r[1] or "").split()) < 400][:25]
    for k, r in enumerate(long):
        words = r[1].split(" ")
        for at in rng.sample(range(len(words)), max(1, round(len(words) * (0.012, 0.02, 0.024, 0.028, 0.05)[k % 5]))):
            words[at] = f"changed{at}"
        rows.append((100_000 + k, " ".join(words), *r[2:]))
    got = sorted((r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, docs.schema), sf_dir).collect()), key=str)
    want = slow_kept([r[:2] for r in rows])
    assert got == want
    assert 1 not in got or 177 not in got  # alike at 0.83, 12 bits of SimHash apart


def test_awkward_rows_tiles_and_blocks(spark):
    df = frame(spark)
    data = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = slow_kept(data)
    base = [f"w{i}" for i in range(60)]
    many = [(i, " ".join(base[:-1] + [f"end{i}"]), None, None, 0, 0, None, None, 0) for i in range(40)]
    for most, block, sent, long in ((4096, 1 << 20, 200_000, 64), (4, 50, 200_000, 2), (4, 50, 0, 2)):
        asked = {"most": most, "block": block, "most_sent": sent, "long": long, "buckets": 64}
        assert sorted((r["doc_id"] for r in shingles.one_of_each(df, **asked).collect()), key=str) == want
        assert [r["doc_id"] for r in shingles.one_of_each(frame(spark, many), **asked).collect()] == [0]
    assert shingles.one_of_each(frame(spark, [])).count() == 0


def test_long_runs_are_counted(spark):
    """Exactly the shingles that many prefixes hold are long runs, with their counts."""
    rng = random.Random(2)
    rows = [(k, rng.sample(range(300), 8) + [(1 << 62) + 7] * (k % 3 > 0)) for k in range(120)]
    firsts = spark.createDataFrame(rows, "set long, prefix array<long>")
    times = Counter(x for _, p in rows for x in p)
    got = dict(map(tuple, shingles._long_runs(firsts, 6).collect()))
    assert got == {x: n for x, n in times.items() if n >= 6} and got[(1 << 62) + 7] == 80


def test_pairs_grow_with_the_documents(spark):
    """Random documents that share passages at random have few candidates, and few more for each document as there are more."""
    rng = random.Random(4)
    shared = [" ".join(f"s{k}w{i}" for i in range(5)) for k in range(50)]
    text = lambda: " ".join(" ".join([rng.choice(shared), *(str(rng.random()) for _ in range(5))]) for _ in range(6))
    found = []
    for count in (400, 1600):
        rows = [(i, text(), None, None, 0, 0, None, None, 0) for i in range(count)]
        made = []
        close = shingles._close
        shingles._close = lambda pairs, *rest: close(made.append(pairs) or pairs, *rest)
        try:
            assert shingles.one_of_each(frame(spark, rows)).count() == count
        finally:
            shingles._close = close
        found.append(sum(p.count() for p in made))
    assert found[1] <= 8 * max(found[0], count // 16)


def test_small_tables_take_few_tasks(spark, narrow):
    """However many shuffle partitions the session sets: each task leaves files, and the disk they take is no share of the input."""
    df = frame(spark)
    want = slow_kept([(r["doc_id"], r["text"]) for r in df.collect()])
    kept, tasks = narrow(lambda: sorted((r["doc_id"] for r in shingles.one_of_each(df).collect()), key=str))
    assert kept == want
    assert tasks < 80 * 60
