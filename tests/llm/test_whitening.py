import math

import numpy as np
import pytest
from pyspark.sql import types as T

from tidewell.llm import whitening

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("component", T.StringType()), T.StructField("n", T.StringType()),
])


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(3)


def brute(vectors, k):
    """Exact integers, then a dense eigensolver."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    c = ((n * x - s) / n).astype(float)
    values, q = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:k]
    return n, ((n * x - s) ** 2).sum(axis=1), c, values[order], q[:, order], values.sum()


def check(found, kept, k):
    n, deviation, c, values, q, trace = brute([v for _, v in kept], k)
    place = {i: a for a, (i, _) in enumerate(kept)}
    white = np.zeros((n, k))
    for r in found:
        a = place[r["vec_id"]]
        assert r["n"] == n and r["deviation"] == deviation[a]
        assert abs(r["explained"] / (values[r["component"] - 1] / trace) - 1) < 1e-9
        assert r["identity_error"] < 1e-9
        white[a, r["component"] - 1] = r["whitened"]
    assert len(found) == n * k
    want = c @ q / np.sqrt(values)
    signs = np.sign((white * want).sum(axis=0))
    assert np.abs(white * signs - want).max() < 1e-6


def test_against_a_dense_solver_with_rows_that_go(spark):
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=24).tolist()) for i in range(150)] + [(900 + i, [0.25] * 24) for i in range(60)]
    bad = [(500, None), (501, [None] + [0.1] * 23), (502, [float("nan")] * 24), (503, [float("inf")] + [0.0] * 23), (504, []), (505, [1.0] * 7), (506, [3e38] + [0.0] * 23)]
    found = whitening.components(spark, table(spark, good + bad), k=10).collect()
    check(found, good, 10)


def test_all_dimensions(spark):
    rng = np.random.default_rng(2)
    good = [(i, (rng.normal(size=64) * np.linspace(1, 3, 64)).tolist()) for i in range(400)]
    found = whitening.components(spark, table(spark, good)).collect()
    check(found, good, 32)


def test_wide_vectors_take_several_steps():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(600, 300)) * np.linspace(1, 2, 300)
    v = a.T @ a / 600
    values, vectors, residual, steps = whitening.lobpcg(lambda block: v @ block, 300, 8)
    want, q = np.linalg.eigh(v)
    assert steps > 3 and residual < 2e-13
    assert np.abs(values / want[::-1][:8] - 1).max() < 1e-12
    assert np.abs(np.abs((vectors * q[:, ::-1][:, :8]).sum(axis=0)) - 1).max() < 1e-10


def test_steps_that_do_not_suffice_are_an_error():
    v = np.diag(np.linspace(1, 1.001, 200))
    with pytest.raises(RuntimeError, match="residual"):
        whitening.lobpcg(lambda block: v @ block, 200, 2, steps=3)


def test_few_directions_repeats_and_null_ids(spark):
    """Vectors that span two dimensions have two components; rows that repeat count twice; a null id stays."""
    rows = [(1, [1.0, 0.0, 5.0]), (1, [1.0, 0.0, 5.0]), (2, [0.0, 2.0, 5.0]), (None, [3.0, 3.0, 5.0])]
    found = whitening.components(spark, table(spark, rows)).collect()
    assert len(found) == 8 and {r["component"] for r in found} == {1, 2} and {r["n"] for r in found} == {4}
    assert sum(r["vec_id"] is None for r in found) == 2 and sum(r["vec_id"] == 1 for r in found) == 4
    assert abs(sum(r["explained"] for r in found) / 4 - 1) < 1e-12


@pytest.mark.parametrize("rows", [[], [(1, None), (2, [])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])], [(1, [7.0])]])
def test_nothing_to_whiten(spark, rows):
    found = whitening.components(spark, table(spark, rows) if rows else spark.createDataFrame([], SCHEMA))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and found.count() == 0


def test_deviation_is_exact_beyond_products_of_64_bits():
    x = np.array([[1_000_005, 999_990], [1_000_000, 1_000_004]])
    for n in (7, 10**8, 10**12):
        sums = np.array([n * 1_000_001 + 3, n * 999_999 + 5])
        want = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
        assert whitening._deviation(x, n, sums) == [w if w < 2**63 else None for w in want]
