from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import decontaminate, hilbert, langid, mixing, shingles, simhash

from .fixtures import frame
from .test_mixing import slow_targets
from .test_shingles import slow_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    """What goes into each stage and what comes out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(150)
    docs = docs.unionByName(docs.limit(2)).unionByName(docs.limit(1).selectExpr("-1L AS doc_id", "NULL AS text", "lang", "source", "0L AS n_chars"))
    out = []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        before = [tuple(r) for r in docs.select(COLUMNS).collect()]
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((before, docs.collect(), docs.columns))
    return out


def test_columns(steps):
    assert all(c == COLUMNS for _, _, c in steps[:-1])
    assert steps[-1][2] == [*COLUMNS, "shard", "slot"]


def test_language(spark, steps):
    before, after, _ = steps[0]
    import zlib

    df = spark.createDataFrame([r for r in before if zlib.crc32(str(r[0]).encode()) % 3 != 1], "doc_id long, text string, lang string, source string, n_chars long")
    tag = langid.judge(langid.prototypes(df))
    want = [r for r in before if (g := tag(r[1]))[0] != "und" and (g[1] >= 0.35 or g[2] < 200)]
    assert Counter(map(tuple, after)) == Counter(want)
    assert len(after) >= 0.95 * len(before)


def test_near_duplicates(steps):
    before, after, _ = steps[1]
    assert sorted(map(tuple, after)) == sorted(min(group, key=lambda r: r[0]) for group in slow_components(before))


def test_decontamination(spark, sf_dir, steps):
    before, after, _ = steps[2]
    items = [decontaminate.Item(r["item_id"], r["text"], 0.06) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = [r for r in before if not any(i.myers.best(decontaminate.normal(r[1]))[0] <= i.budget for i in items)]
    assert sorted(map(tuple, after)) == sorted(want)


def test_mixture(steps):
    before, after, _ = steps[3]
    n = lambda t: len((t or "").split())
    sizes, took = defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r[3]] += n(r[1])
    for r in after:
        took[r["source"]] += n(r["text"])
    target = slow_targets(sizes)
    longest = max(n(r[1]) for r in before)
    assert all(abs(took[s] - target[s]) <= longest / 2 + 1 for s in sizes)
    assert {tuple(r) for r in after} <= set(before)
    assert max(Counter(map(tuple, after)).values()) <= 3


def test_sharding(steps):
    before, after, _ = steps[4]
    assert Counter(tuple(r)[:5] for r in after) == Counter(before)
    counts = [sorted(r["slot"] for r in after if r["shard"] == s) for s in range(24)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1


def test_edge_rows_through_every_stage(spark, sf_dir, tmp_path):
    """Awkward rows, an empty table, and columns named like the stages' own."""
    extra = {"__row": "x", "__s": "y", "__plan": "z", "__tag": "t", "__digest": "d", "__times": "e", "__at": "a", "__point": "p", "slot": "s"}
    for k, data in enumerate((None, [])):
        docs = frame(spark, data)
        for name, value in extra.items():
            docs = docs.withColumn(name, F.lit(value))
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf_dir).write.parquet(str(tmp_path / f"{k}{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}{name}"))
            assert docs.columns[: len(columns)] == ([f"{c}_in" if c in ("shard", "slot") else c for c in columns] if name == "hilbert_sharding" else columns)
        assert docs.columns[len(columns) :] == ["shard", "slot"]
        assert docs.count() >= (5 if data is None else 0)
        assert all(r["__row"] == "x" and r["slot_in"] == "s" for r in docs.collect())


TWINS = [
    (1, None, "en", "a", 1), (1, "", "de", "b", 2), (2, "one two three", "en", "a", 3), (2, "one two three", "de", "b", 4), (2, "one two three", "de", "b", 4),
    (2, "one two three", "de", None, 4), (2, "one two three", "de", "", 4), (None, "one two three", "de", "", 4), (3, "four five", None, "a", None), (3, "four five", "", "a", 0),
]


def test_rows_alike_in_id_and_text_keep_their_own_columns(spark, sf_dir):
    """Same id and text with another source, null against empty text, repeated rows."""
    docs = spark.createDataFrame(TWINS, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)
    out = stage["hilbert_sharding"](spark, docs, sf_dir).collect()
    assert Counter(tuple(r)[:5] for r in out) == Counter(TWINS)
    for most_sent in (0, 100):
        assert Counter(tuple(r)[:5] for r in hilbert.sharded_rows(docs, 3, most_sent=most_sent).collect()) == Counter(TWINS)
    for repeat in (1, 40):
        many = spark.createDataFrame(TWINS * repeat, docs.schema)
        got = Counter(map(tuple, stage["source_mixing"](spark, many, sf_dir).collect()))
        assert got == Counter(map(tuple, mixing.mixed_rows(many, most_sent=0).collect()))
        took = Counter()
        for r in mixing.mix(spark.createDataFrame(TWINS * repeat, docs.schema)).collect():
            took[r["source"]] += r["taken"]
        words = Counter()
        for r, n in got.items():
            words[r[3]] += n * len((r[1] or "").split())
        assert set(got) <= set(TWINS) and all(abs(words[s] - took[s]) <= 1.5 for s in took)
    kept = stage["simhash_near_dedup"](spark, docs, sf_dir).collect()
    assert {tuple(r) for r in kept} <= set(TWINS)
    assert sorted((r["doc_id"] for r in kept), key=str) == [1, 2, 3]


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == [*COLUMNS, "shard", "slot"]


def test_near_duplicates_take_the_links_of_simhash(spark, sf_dir, monkeypatch):
    """Without pairs by shared shingles, texts within 4 bits still go together, once their shingles are counted."""
    rows = []
    for i in range(8):
        words = [f"v{i}x{k}" for k in range(600)]
        rows += [(10 * i, " ".join(words), "en", "a", i), (10 * i + 1, " ".join([*words[:-1], "last"]), "en", "a", i)]
    common = "terms of use apply to all pages of this " * 40
    rows += [(100 + i, common + " ".join(f"w{i}x{k}" for k in range(6)), "en", "a", i) for i in range(3)]  # within 4 bits, not alike
    marks = {r[0]: simhash.fingerprint(r[1]) for r in rows}
    near = lambda a, b: (marks[a] ^ marks[b]).bit_count() <= 4
    linked = [10 * i for i in range(8) if near(10 * i, 10 * i + 1)]
    assert len(linked) >= 4 and near(100, 101) and near(100, 102)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = lambda: sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect())
    assert kept() == sorted(min(r[0] for r in group) for group in slow_components(rows)) == [*range(0, 80, 10), 100, 101, 102]
    monkeypatch.setattr(shingles, "_candidates", lambda firsts, *_: firsts.sparkSession.createDataFrame([], "a long, b long"))
    assert kept() == sorted({r[0] for r in rows} - {i + 1 for i in linked})
