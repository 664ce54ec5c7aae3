import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from tidewell.llm import linededup as ld

from .fixtures import frame


def slow(rows):
    """The definition, row by row."""
    seen, places, out = {}, [], []
    for k, (i, t) in enumerate(rows):
        if t is None:
            continue
        lines = t.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        roll = [(h[j] + (h[j - 1] * ld.PRIME if j else 0)) % ld.MODULUS for j in range(len(lines))]
        last, start = len(lines) - 1, 0
        for j in range(len(lines)):
            if j == last or (0 < j < last - 1 and roll[j - 1] > roll[j] <= roll[j + 1]):
                while start <= j:
                    end = j + 1 if j - start <= ld.LONGEST else start + ld.LONGEST
                    if end > start + 1 and re.search(r"[^\W_]", c := "\n".join(lines[start:end])):
                        places.append((i if i is not None else -1, k, start, end, c))
                    start = end
    gone = {}
    for i, k, a, b, c in sorted(places, key=lambda p: (p[0], p[2])):
        if c in seen:
            gone.setdefault(k, []).append((a, b))
        seen[c] = 1
    for k, (i, t) in enumerate(rows):
        if t is None:
            out.append((i, None, 0, 0, 0))
            continue
        lines = t.split("\n")
        bad = {x for a, b in gone.get(k, []) for x in range(a, b)}
        out.append((i, "\n".join(x for j, x in enumerate(lines) if j not in bad), len(lines), len(bad), len(gone.get(k, []))))
    return sorted(out, key=str)


def made(n=120):
    rng = random.Random(3)
    line = lambda: "".join(rng.choice("abc ") for _ in range(rng.randint(0, 9)))
    block = [[line() + str(b) for _ in range(rng.randint(2, 40))] for b in range(6)]
    rows = []
    for i in range(n):
        lines = [line() + f"#{i}" for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(lines))
            lines[at:at] = rng.choice(block)
        rows.append((i, "\n".join(lines)))
    return rows + [(500, None), (501, ""), (502, "\n" * 30), (503, "\n" * 30), (None, "\n".join(block[0] * 2))]


def as_frame(spark, rows):
    return frame(spark, [(i, t, None, None, 0, 0, None, None, 0) for i, t in rows])


def test_against_brute_force(spark):
    rows = made()
    for most_sent in (0, ld.MOST_SENT):
        got = sorted(map(tuple, ld.dedup_lines(as_frame(spark, rows), most_sent=most_sent).collect()), key=str)
        assert got == slow(rows)
    assert sum(r[3] for r in got) > 100


def test_colliding_digests(spark):
    rows = made()
    for digest in (F.xxhash64("chunk") % 7, F.lit(1).cast("long")):
        assert sorted(map(tuple, ld.dedup_lines(as_frame(spark, rows), digest=digest).collect()), key=str) == slow(rows)


def test_repeated_rows_share_a_fate(spark):
    rows = [(1, "alpha one\nbeta two\ngamma three\ndelta four")] * 2 + [(2, "alpha one\nbeta two\ngamma three\ndelta four")]
    got = sorted(map(tuple, ld.dedup_lines(as_frame(spark, rows)).collect()), key=str)
    assert got[0] == got[1] and got[0][1] == rows[0][1]


def test_planted_passages(spark):
    """Copies of whole texts go entirely; of passages of 6 to 14 lines between other lines, what lies in whole chunks (0.46 of the lines here)."""
    rng = random.Random(9)
    line = lambda: " ".join(str(rng.random())[2:8] for _ in range(6))
    whole = [(i, "\n".join(line() for _ in range(2 + i % 30))) for i in range(60)]
    got = {r["doc_id"]: r for r in ld.dedup_lines(as_frame(spark, whole + [(100 + i, t) for i, t in whole])).collect()}
    assert all(got[100 + i]["removed_lines"] == got[i]["n_lines"] and got[i]["removed_lines"] == 0 for i, _ in whole)
    passage = [[line() for _ in range(n)] for n in (6, 8, 10, 14) for _ in range(10)]
    rows = [(2 * k + j, "\n".join([line() for _ in range(rng.randint(1, 6))] + p + [line() for _ in range(rng.randint(1, 6))])) for k, p in enumerate(passage) for j in (0, 1)]
    removed = sum(r["removed_lines"] for r in ld.dedup_lines(as_frame(spark, rows)).collect())
    assert 0.4 * sum(map(len, passage)) <= removed <= sum(map(len, passage))


def test_edge_rows(spark):
    df = frame(spark)
    assert ld.dedup_lines(df).count() == df.count()
    assert ld.dedup_lines(frame(spark, [])).count() == 0


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.execute(ld.SQL).fetchall(), key=str)
    got = sorted(map(tuple, ld.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()), key=str)
    assert got == want


def test_native(spark, sf_dir):
    plan = ld.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
