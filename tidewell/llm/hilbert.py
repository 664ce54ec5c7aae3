"""Sharding along a Hilbert curve over several metadata dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free, join_classes, row_digest, settle

#: Bits to which each dimension is quantised.
BITS = 6
#: Texts (32 bytes each) up to which the curve indexes of copies that would lie apart are sent to every task.
MOST_SENT = 200_000


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of points (rows of ``axes``, one column a dimension, each below 2**bits).

    The published transpose method: undo excess work from the top bit down, Gray-encode, then
    interleave the bits of the dimensions.
    """
    x = axes.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve(*dims: Column) -> Column:
    """Hilbert index of quantised dimensions (integers from 0 to 2**BITS - 1)."""

    @F.pandas_udf("long")
    def index(*cols: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.column_stack([c.to_numpy(np.int64) for c in cols]), BITS))

    return index(*dims)


def category(name: str) -> Column:
    """A category's cell: values that are equal share it, null is the first."""
    return F.when(F.col(name).isNull(), 0).otherwise(1 + F.pmod(F.crc32(F.col(name).cast("binary")), F.lit(2**BITS - 1)))


def magnitude(size: Column) -> Column:
    """A size's cell, on a scale of logarithms to base 1.3."""
    return F.least(F.floor(F.log(size.cast("double") + 1) / np.log(1.3)), F.lit(2**BITS - 1))


def _ordered(docs: DataFrame, columns: list[str], id_col: str, text_col: str, categories: tuple[str, ...], most_sent: int) -> tuple[DataFrame, str]:
    """``columns`` of every row and a struct (doc_id, size, text_crc32, hilbert, at), written down in the order of the curve; the struct's name.

    ``at`` holds the partition in its upper bits and the row's place in it below.
    """
    spark = docs.sparkSession
    p, h, m = free(docs, "__point"), free(docs, "__hilbert"), free(docs, "__body")
    body = F.coalesce(F.col(text_col), F.lit(""))
    size = (F.octet_length(body) + 8).cast("long")
    point = F.struct(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), *([row_digest(docs).alias("row")] if columns else []))
    index = curve(*[category(c) for c in categories], magnitude(size))
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], point.alias(p), F.unhex(F.md5(body)).alias(m), index.alias(h))
    first = F.min(F.struct(F.col(f"{p}.doc_id"), F.col(h))).alias("first")
    texts = cut(rows.groupBy(m).agg(first, F.count("*").alias("times"), (F.min(h) != F.max(h)).alias("apart")).select(m, F.col(f"first.{h}").alias("__first"), "times", "apart"))
    apart = texts.where("apart").select(m, "__first")
    if apart.count() <= most_sent:
        rows = rows.join(F.broadcast(apart), m, "left").withColumn(h, F.coalesce("__first", h)).drop("__first")
    else:
        rows = settle(join_classes(rows, texts.select(m, F.col("__first").alias("__other"), F.col("times").alias("__times")), [m], "__times").withColumn(h, F.col("__other")).drop("__other"))
    seq = free(docs, "__seq")
    by = [F.col(h), F.col(f"{p}.size"), F.col(m), F.col(f"{p}.doc_id"), *([F.col(f"{p}.row")] if columns else []), F.col(seq)]
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn(seq, F.monotonically_increasing_id()).repartitionByRange(wide, *by).sortWithinPartitions(*by)
    kept = F.struct(f"{p}.doc_id", f"{p}.size", f"{p}.text_crc32", F.col(h).alias("hilbert"), F.monotonically_increasing_id().alias("at"))
    return settle(dealt.select(*[F.col(f"`{c}`") for c in columns], kept.alias(p))), p


def _numbered(ordered: DataFrame, p: str, shards: int) -> tuple[DataFrame, Column, Column]:
    """The rows with the number of rows before their partition, and columns for shard and slot."""
    spark = ordered.sparkSession
    task, place = F.shiftright(f"{p}.at", 33).cast("int"), F.col(f"{p}.at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["task"], r["count"]) for r in ordered.groupBy(task.alias("task")).count().collect())  # a row for each partition
    total = sum(n for _, n in counts)
    before, offsets = 0, []
    for t, n in counts:
        offsets.append((t, before))
        before += n
    n, t, r = free(ordered, "__before"), free(ordered, "__task"), free(ordered, "__rank")
    starts = F.broadcast(spark.createDataFrame(offsets, f"{t} int, {n} long"))  # as many rows as partitions
    rows = ordered.join(starts, task == F.col(t)).withColumn(r, F.col(n) + place)
    shard = F.expr(f"cast({r} * {shards} div {max(1, total)} as int)")
    first = F.expr(f"({r} * {shards} div {max(1, total)} * {max(1, total)} + {shards - 1}) div {shards}")
    return rows, shard, (F.col(r) - first).cast("long")


def hilbert_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("lang", "source"), most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, size, text_crc32, hilbert, shard, slot) for every row.

    Dimensions are the categories and the size of the text (UTF-8 bytes plus 8). Rows are sorted
    by curve index and the sorted run is cut into ``shards`` runs whose counts are at most one
    apart; slot counts from 0 in each. Equal texts take the index of their least
    (doc_id, index), so they lie side by side on the curve whatever source names them, and a
    group is divided only where a cut falls into it. The sort is a range partitioning whose last key is a
    row's number, so no task holds a whole group of copies. Indexes of copies that would lie apart are sent to
    the rows up to ``most_sent`` texts and joined beyond. Null texts count as empty; a null category is a cell of
    its own; ties are ordered by size, text digest and doc_id, and by nothing among equal rows; other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    rows, shard, slot = _numbered(*_ordered(docs, [], id_col, text_col, categories, most_sent), shards)
    p = rows.columns[0]
    return rows.select(f"{p}.doc_id", f"{p}.size", f"{p}.text_crc32", f"{p}.hilbert", shard.alias("shard"), slot.alias("slot"))


def sharded_rows(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("lang", "source"), most_sent: int = MOST_SENT) -> DataFrame:
    """The rows of ``docs``, all columns, with their shard and slot as in ``hilbert_shards``.

    Whole rows are sorted, so each keeps its own columns (repeated rows take neighbouring slots) and the files written
    from the result hold runs of the curve, whose statistics prune them. A column of ``docs`` that is named shard or slot
    is kept as shard_in or slot_in.
    """
    ordered, p = _ordered(docs, docs.columns, id_col, text_col, categories, most_sent)
    rows, shard, slot = _numbered(ordered, p, shards)
    own = [F.col(f"`{c}`").alias(free(docs, f"{c}_in") if c.lower() in ("shard", "slot") else c) for c in docs.columns]
    return rows.select(*own, shard.alias("shard"), slot.alias("slot"))
