import random

from tidewell.llm import decontaminate as dc

from .fixtures import frame


def slow_distance(pattern, text):
    """Least edit distance of the pattern to any substring."""
    row = list(range(len(pattern) + 1))
    best, end = row[-1], 0
    for i, c in enumerate(text, 1):
        new = [0]
        for j, p in enumerate(pattern, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
        if row[-1] < best:
            best, end = row[-1], i
    return best, end


def edited(text, k, rng):
    s = list(text)
    for _ in range(k):
        at = rng.randrange(len(s))
        kind = rng.randrange(3)
        s[at : at + 1] = {0: [], 1: ["ü"], 2: [s[at], "x"]}[kind]
    return "".join(s)


def test_myers_against_the_matrix():
    rng = random.Random(1)
    for _ in range(60):
        p = "".join(rng.choice("abcé") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abcé") for _ in range(rng.randint(0, 60))) + edited(p, rng.randint(0, 6), rng) + "ab"
        assert dc.Myers(p).best(t) == slow_distance(p, t)


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    items = [(i, line(rng.randint(8, 30))) for i in range(12)] + [(90, None), (91, ""), (92, line(3)), (3, line(12))]
    docs = []
    for i in range(150):
        text = line(60)
        if i % 3:
            t = items[i % 12][1]
            text += " " + edited(t, rng.randrange(int(len(t) * 0.06) + 1), rng).upper() + "\n\n " + line(20)
        docs.append((i, text, "en", "s", 0, 0, None, None, 0))
    docs += [(200, None) + docs[0][2:], (201, "") + docs[0][2:], docs[1], (None, items[0][1]) + docs[0][2:]]
    df = frame(spark, docs)
    want = []
    for d in docs:
        for i, t in items:
            p = dc.normal(t or "")
            if p:
                best, end = slow_distance(p, dc.normal(d[1] or ""))
                if best <= int(len(p) * 0.06):
                    want.append((d[0], i, best))
    table = spark.createDataFrame(items, "item_id long, text string")
    for size in (4_000_000, 300):  # one block and several
        got = [(r["doc_id"], r["item_id"], r["distance"]) for r in dc.leaks(df, table, block_bytes=size).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    bad = {(d[0], d[1]) for d in docs if any(w[0] == d[0] for w in want)}
    for size in (4_000_000, 900, 300):  # one block, several in one pass, several passes
        kept = [(r["doc_id"], r["text"]) for r in dc.clean(df, table, block_bytes=size).collect()]
        assert sorted(kept, key=str) == sorted(((d[0], d[1]) for d in docs if (d[0], d[1]) not in bad), key=str)


def test_edge_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "quick brown fox jumps over a lazy dog while seven wizards brew")], "item_id long, text string")
    assert dc.leaks(frame(spark), none).count() == 0
    assert dc.leaks(frame(spark, []), some).count() == 0
    assert {r["doc_id"] for r in dc.leaks(frame(spark), some).collect()} == {0, 1, 2, 9}
    assert dc.clean(frame(spark), some).columns == frame(spark).columns


def test_planted_passages(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = {r["doc_id"]: dc.normal(r["text"] or "") for r in docs.collect()}
    found = {(r["doc_id"], r["item_id"]) for r in dc.leaks(docs, items).collect()}
    whole = {(d, r["item_id"]) for r in items.collect() for d, t in texts.items() if dc.normal(r["text"]) in t}
    assert whole <= found
