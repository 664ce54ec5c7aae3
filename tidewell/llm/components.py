"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHARE, cut, parts_of

#: Nodes that a task holds at once while it draws its own edges together.
HELD = 1 << 18


def _forest(edges: DataFrame, held: int) -> DataFrame:
    """(u, v): each task's edges (a, b) drawn together to stars, u to the least node v that its edges reach.

    Nothing is shuffled. Past ``held`` nodes the stars are given out and new ones begun, so memory is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        def stars() -> pa.RecordBatch:
            u = [x for x in up if up[x] != x]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (u, [find(x) for x in u])], names=["u", "v"])

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = find(a), find(b)
                up[max(a, b)] = min(a, b)
            if len(up) > held:
                yield stars()
                up.clear()
        yield stars()

    return edges.select("a", "b").mapInArrow(run, "u long, v long")


def _settled(edges: DataFrame, tasks: int | None) -> tuple[bool, int]:
    """Whether the edges (u, v) are stars already: each u has one v, and no v is a u; and how many edges there are."""
    ends = edges.select(F.col("u").alias("node"), "v").unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("v")))
    seen = ends.groupBy("node").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max(F.col("v").isNull()).alias("center"), F.count("v").alias("edges"))
    seen = seen if tasks is None else seen.coalesce(tasks)
    open_, count = seen.agg(F.count_if(F.col("low").isNotNull() & (F.col("center") | (F.col("low") != F.col("high")))), F.coalesce(F.sum("edges"), F.lit(0))).first()
    return open_ == 0, count


def _least(edges: DataFrame) -> DataFrame:
    """For each node the least of itself and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        both.join(_least(both), "u").where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).coalesce(tasks).distinct().coalesce(tasks)
    )


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u")
    return (
        moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        .where(F.col("u") != F.col("v")).coalesce(tasks).distinct().coalesce(tasks)
    )


def components(edges: DataFrame, most_rounds: int = 60, held: int = HELD, share: int = SHARE) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b; long) that differs from its neighbour: root is the least node that can be reached.

    Each task first draws its own edges together, so no more than a forest is shuffled. Each round is
    two aggregations with partial sums and two equi-joins on the node, so a
    node with very many neighbours is split by AQE rather than gathered. Rounds grow with the
    logarithm of the longest path and end when only stars are left. Each is cut by a checkpoint. Only
    two counts a round reach the driver. A round's steps run in a task for every ``share`` edges, and a few, however many
    shuffle partitions the session sets, as each task leaves files of its own. No edges give no rows.
    """
    now, tasks = cut(_forest(edges, held).distinct()), None
    for _ in range(most_rounds):
        ended, count = _settled(now, tasks)
        tasks = parts_of(count, share)
        now = now.coalesce(tasks)
        if ended:
            break
        now = cut(_small_star(_large_star(now, tasks), tasks))
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
