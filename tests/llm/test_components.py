import random

import pytest

from tidewell.llm.components import components


def reached(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def got(spark, edges, parts, **how):
    frame = spark.createDataFrame(edges, "a long, b long").repartition(parts)
    rows = components(frame, **how).collect()
    assert len(rows) == len({r["node"] for r in rows})
    return {r["node"]: r["root"] for r in rows}


@pytest.mark.parametrize("held", [1 << 18, 2])
def test_roots_of_random_edges_paths_and_hubs(spark, held):
    rng = random.Random(3)
    path = [(k + 1, k) if k % 3 else (k, k + 1) for k in range(-30, 40)]
    hub = [(500 + k, 500) for k in range(1, 200)]
    some = [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(150)]
    some = [e for e in some if e[0] != e[1]]
    edges = path + hub + some + some[:20]  # repeated edges too
    rng.shuffle(edges)
    assert got(spark, edges, 7, held=held) == reached(edges)


def test_no_edges_and_edges_to_oneself(spark):
    assert got(spark, [], 3) == {}
    assert got(spark, [(5, 5), (7, 6), (6, 7)], 3) == {7: 6, 6: 6}


def test_rounds_in_few_and_in_many_tasks(spark, narrow):
    """A round's tasks follow the edges, not the session's shuffle partitions; roots are the same for any number of them."""
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(300)] + [(1000 + k, 1000) for k in range(1, 200)]
    rng.shuffle(edges)
    few = narrow(lambda: got(spark, edges, 12, held=2))
    many = narrow(lambda: got(spark, edges, 12, held=2, share=4))
    assert few[0] == many[0] == reached(edges)
    assert few[1] < many[1] and few[1] < 90 * 60
