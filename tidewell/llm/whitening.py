"""Whitening of vectors by LOBPCG: the covariance is met only as products with blocks of directions.

Rows stay where they are. A step sends a block (dimension x three widths) to the tasks, each task
gives its part of the product over its centred rows, and the parts are added up block column by
block column. Rayleigh-Ritz on iterate, residual and previous directions runs on the driver, whose
matrices have the vectors' dimension and the block's width, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .common import small_batches

#: Entries are counted in 64ths, moved by OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Vectors with an entry beyond this are left out: their integers would not be exact.
LARGEST = 2.0**40
#: A direction counts as found when its residual is below this share of the largest eigenvalue.
CERTIFIED = 2e-14


@dataclass(frozen=True)
class Fit:
    """What the fit list gives: its size, exact sums by dimension, eigenpairs (vectors as columns) and the trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    steps: int


def _integers(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows that stay and their matrix of integers, by length of the vector, of one Arrow list column."""
    lists = column.cast(pa.large_list(pa.float64()))
    starts = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(np.asarray(lists.value_lengths().fill_null(0), np.int64), out=starts[1:])
    values = lists.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False)
    held = np.abs(values) < LARGEST
    whole = np.floor(SCALE * np.where(held, values, 0.0)).astype(np.int64) + OFFSET
    bad = np.concatenate([[0], np.cumsum(~held)])
    rows = np.flatnonzero(np.asarray(lists.is_valid()) & (bad[starts[1:]] == bad[starts[:-1]]))
    lengths = np.diff(starts)[rows]
    by_length = {int(length): rows[lengths == length] for length in np.unique(lengths)}
    return {length: (chosen, whole[starts[chosen][:, None] + np.arange(length)]) for length, chosen in by_length.items()}


def _batch(batch: pa.RecordBatch, column: str, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix) of the vectors of ``length`` in a batch."""
    return _integers(batch.column(column)).get(length, (np.zeros(0, np.int64), np.zeros((0, length), np.int64)))


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, from exact integers where they fit: no digits are lost to the offset."""
    whole, part = sums // n, sums % n
    return (x - whole) - part / n


def _map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: pa.Schema) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(run, from_arrow_schema(schema))


_SUMS = pa.schema([("length", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
_PART = pa.schema([("column", pa.int32()), ("part", pa.binary())])


def _count(vectors: DataFrame, column: str) -> tuple[int, int, tuple[int, ...]]:
    """(length, n, sums) of the most frequent length, the longer one of those that tie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for batch in batches:
            for length, (rows, x) in _integers(batch.column(0)).items():
                entry = seen.setdefault(length, [0, np.zeros(length, np.int64)])
                entry[0] += len(rows)
                entry[1] += x.sum(axis=0)
        if seen:
            yield pa.RecordBatch.from_pydict({"length": list(seen), "n": [v[0] for v in seen.values()], "sums": [v[1].tolist() for v in seen.values()]}, schema=_SUMS)

    parts = _map(vectors.select(F.col(f"`{column}`").alias("v")), run, _SUMS)
    sizes = parts.groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("length")).limit(1)
    top = sizes.first()
    if top is None or top["length"] == 0:
        return 0, 0, ()
    at = parts.where(F.col("length") == top["length"]).select(F.posexplode("sums").alias("at", "s"))
    sums = at.groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return top["length"], top["n"], tuple(int(r["s"]) for r in sorted(sums, key=lambda r: r["at"]))


def _added(parts: DataFrame, wide: int) -> np.ndarray:
    """Adds parts up, one task for many columns, batch by batch: no column's parts are ever held together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for column, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row = np.frombuffer(part)
                held[column] = held[column] + row if column in held else row
        if held:
            yield pa.RecordBatch.from_pydict({"column": list(held), "part": [v.tobytes() for v in held.values()]}, schema=_PART)

    rows = _map(parts.repartition("column"), run, _PART).collect()
    found = dict(map(tuple, rows))
    return np.array([np.frombuffer(found[i]) for i in range(wide)])


def _gathered(vectors: DataFrame, column: str, n: int, sums: tuple[int, ...], part: Callable[[np.ndarray], np.ndarray], wide: int) -> np.ndarray:
    """The sum of ``part`` (``wide`` rows of one length) over the centred rows of the fit list."""
    centre = np.array(sums, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(part(_centred(_batch(batch, "v", len(centre))[1], n, centre)) for batch in batches)
        if not isinstance(total, int):
            yield pa.RecordBatch.from_pydict({"column": list(range(wide)), "part": [row.tobytes() for row in np.ascontiguousarray(total)]}, schema=_PART)

    return _added(_map(vectors.select(F.col(f"`{column}`").alias("v")), run, _PART), wide)


def _product(vectors: DataFrame, column: str, n: int, sums: tuple[int, ...], block: np.ndarray) -> tuple[np.ndarray, float]:
    """Covariance times ``block``: the sum over rows of c (c . block) / n, c being the centred row. And the covariance's trace."""

    def part(c: np.ndarray) -> np.ndarray:
        return np.vstack([(c.T @ (c @ block)).T, (c * c).sum(axis=0)])

    total = _gathered(vectors, column, n, sums, part, block.shape[1] + 1)
    return total[:-1].T / n, float(total[-1].sum() / n)


def _orthonormal(parts: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of the blocks' span, later blocks made orthogonal to earlier ones; dependent directions go."""
    basis = np.zeros((parts[0].shape[0], 0))
    for part in parts:
        norms = np.linalg.norm(part, axis=0)
        part = part[:, norms > 0] / norms[norms > 0]
        for _ in range(2):
            part = part - basis @ (basis.T @ part)
            if part.shape[1]:
                u, s, _ = np.linalg.svd(part, full_matrices=False)
                part = u[:, s > 1e-10]
        basis = np.hstack([basis, part])
    return basis


def lobpcg(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, guard: int = 4, steps: int = 500, certified: float = CERTIFIED) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The ``k`` largest eigenpairs of a symmetric matrix that is known by its products alone: (values, vectors, residual, steps).

    A step multiplies one orthonormal basis of iterate, residual and previous directions, so products and residuals
    are those of the matrix itself and carry no drift. ``guard`` more directions than asked for keep the last ones apart
    from what follows. Ends when every residual is at most ``certified`` times the largest eigenvalue; where it
    has stopped falling within ten times that, rounding is reached. Not reaching it in ``steps`` raises.
    """
    m = min(d, k + guard)
    x = _orthonormal([np.random.default_rng(20240701).standard_normal((d, m))])
    directions = [x]
    best = np.inf
    for step in range(1, steps + 1):
        basis = _orthonormal(directions)
        image = product(basis)
        small = basis.T @ image
        values, c = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values, kind="stable")[:m]
        values, c = values[order], c[:, order]
        new, moved = basis @ c, image @ c
        residuals = moved - new * values
        size = np.linalg.norm(residuals[:, :k], axis=0).max()
        scale = max(abs(values[0]), np.finfo(float).tiny)
        if size <= certified * scale or (size <= 10 * certified * scale and size >= best / 2):
            return values[:k], new[:, :k], size / scale, step
        best = min(best, size)
        width = directions[0].shape[1]
        directions = [new, residuals, new - basis[:, :width] @ c[:width]]
    raise RuntimeError(f"residual {best / scale:.1e} of the largest eigenvalue after {steps} steps")


def fit(vectors: DataFrame, column: str = "embedding", k: int = 32, guard: int = 4, steps: int = 500) -> Fit | None:
    """Fits the whitening to all vectors of the table; None where there are none or none varies.

    Directions whose eigenvalue is below 1e-12 of the trace do not vary and are left out.
    """
    length, n, sums = _count(vectors, column)
    if not n:
        return None
    traces = []

    def multiply(block: np.ndarray) -> np.ndarray:
        image, trace = _product(vectors, column, n, sums, block)
        traces.append(trace)
        return image

    values, found, residual, used = lobpcg(multiply, length, min(k, length), guard, steps)
    keep = values > 1e-12 * traces[-1]
    return Fit(n, sums, values[keep], found[:, keep], traces[-1], residual, used) if keep.any() else None


def identity_error(vectors: DataFrame, fitted: Fit, column: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over all rows."""
    turn = fitted.vectors / np.sqrt(fitted.values)
    k = turn.shape[1]

    def part(c: np.ndarray) -> np.ndarray:
        w = c @ turn
        return np.vstack([w.T @ w, w.sum(axis=0)])

    total = _gathered(vectors, column, fitted.n, fitted.sums, part, k + 1)
    mean = total[-1] / fitted.n
    return float(np.abs(total[:-1] / fitted.n - np.outer(mean, mean) - np.eye(k)).max())


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, exact; None where it passes 64 bits."""
    most = max(n * int(np.abs(x).max(initial=0)), int(np.abs(sums).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 2**63:
        return ((n * x - sums) ** 2).sum(axis=1).tolist()
    whole = sums // n
    near, rest = x - whole, sums - n * whole  # n * x - S = n * near - rest, far smaller
    most = n * (int(np.abs(near).max(initial=0)) + 1)
    if most * most * max(1, x.shape[1]) < 2**63:
        return ((n * near - rest) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, rest)) for row in near]
    return [v if v < 2**63 else None for v in exact]


_WHITE = pa.schema([("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])


def whiten(vectors: DataFrame, fitted: Fit, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, deviation, whitened): the whitened coordinates of every row that stays, one row each."""
    centre, turn = np.array(fitted.sums, np.int64), fitted.vectors / np.sqrt(fitted.values)
    chosen = vectors.select(F.col(f"`{column}`").alias("v"), F.col(f"`{id_col}`").alias("id"))
    ids = pa.field("id", pa.int64())
    schema = pa.schema([ids, *_WHITE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _batch(batch, "v", len(centre))
            if len(rows):
                w = _centred(x, fitted.n, centre) @ turn
                lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), w.ravel())
                yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()).take(pa.array(rows)), pa.array(_deviation(x, fitted.n, centre), pa.int64()), lists], schema=schema)

    return _map(chosen, run, schema)


def components(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", k: int = 32) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for every row that stays and component.

    Vectors that are null, hold null or non-finite entries or entries beyond ``LARGEST``, or have another length than
    the most frequent one (the longer of two) are left out of fit and result. An entry c counts as the integer
    floor(64 c) + 1,000,000. Rows that repeat, and vectors that do, count as often as they stand; a null id stays null.
    Components are the eigenvectors of the ``k`` largest eigenvalues of the covariance (divisor n), numbered from 1;
    eigenvalues that tie are in no fixed order. Where the vectors span fewer dimensions there are fewer components, and
    no rows where no vector stays, none varies or the table is empty. ``deviation`` is null where it passes 64 bits.
    Other columns are ignored, whatever their names.
    """
    fitted = fit(vectors, column, k)
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fitted is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    explained = F.element_at(F.array(*[F.lit(float(v / fitted.trace)) for v in fitted.values]), F.col("component"))
    error = identity_error(vectors, fitted, column)
    rows = whiten(vectors, fitted, id_col, column).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    return rows.select(
        F.col("id").alias(id_col), "component", F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"),
    )
