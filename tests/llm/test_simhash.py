import numpy as np
import xxhash

from tidewell.llm import simhash

from .fixtures import frame


def slow_fingerprint(text):
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in (text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def slow_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fs = sorted(root)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    return {f: find(f) for f in fs}


def expected(rows):
    fp = [slow_fingerprint(t) for _, t in rows]
    comp = slow_components(fp)
    least = {}
    for (i, _), f in zip(rows, fp):
        if i is not None:
            least[comp[f]] = min(least.get(comp[f], i), i)
    return sorted(((i, f"{f:016x}", least.get(comp[f])) for (i, _), f in zip(rows, fp)), key=str)


def test_against_brute_force(spark):
    df = frame(spark)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert sorted(map(tuple, simhash.simhash_components(df).collect()), key=str) == expected(rows)


def test_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert sorted(map(tuple, simhash.simhash_components(df).collect()), key=str) == expected([tuple(r) for r in df.collect()])


def test_empty(spark):
    assert simhash.simhash_components(frame(spark, [])).count() == 0


def test_dense_buckets_and_tiles(spark):
    rng = np.random.default_rng(1)
    center = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, int(k), replace=False)) for c in center for k in rng.integers(0, 6, 150)}
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    want = slow_components(fps)
    for most in (16384, 40):  # the second deals every bucket over tiles
        pairs = simhash.links(spark.createDataFrame(signed, "fp long"), most=most)
        from tidewell.llm.components import components

        got = {r["node"] % 2**64: r["root"] % 2**64 for r in components(pairs).collect()}
        groups = {}
        for f in fps:
            groups.setdefault(got.get(f, f), set()).add(f)
        slow = {}
        for f in fps:
            slow.setdefault(want[f], set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, slow.values()))


def test_key_plan_loses_no_pair():
    for count in (10, 10**6, 10**8, 10**10):
        plan = simhash.key_plan(count, 4)
        rng = np.random.default_rng(2)
        for _ in range(50):
            bad = {int(b) for b in rng.choice(64, 4, replace=False)}
            assert any(all(not (s <= b < s + n) for s, n in key for b in bad) for key in plan)
