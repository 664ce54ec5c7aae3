"""Shared helpers: table reading, lineage cuts and Arrow batch mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

#: Regular expression class of the separators that the contracts name.
WORD = r"[^\x20\x09-\x0D]+"
#: Lower-cases A-Z and nothing else, on bytes.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset on one machine
    (tests) a temporary folder takes its place. A cluster without one is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewell-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a narrow frame: computed once, read again after a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Partitions that a frame of few narrow rows keeps at least, and rows of each beyond.
PARTS, SHARE = 8, 1 << 14


def parts_of(rows: int, share: int = SHARE) -> int:
    """Partitions enough for ``rows`` narrow rows."""
    return PARTS + rows // share


def cut_narrow(df: DataFrame) -> DataFrame:
    """``cut`` of a frame of narrow rows that is read several times: in no more partitions than its rows need,
    however many shuffle partitions the session sets, as each task that reads it leaves files of its own."""
    held = cut(df)
    return held.coalesce(parts_of(held.count()))


def settle(df: DataFrame) -> DataFrame:
    """A wide frame written as Parquet to the shared folder (compressed, unlike a checkpoint) and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have: ``name``, with as many more underscores as it takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_digest(df: DataFrame) -> Column:
    """128 bits (hex) over all columns of a row; null is told from empty. Rows share it only if they are equal."""

    def one(field: T.StructField) -> Column:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.md5(column.cast("binary")), F.lit("-"))
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.md5(F.to_json(F.struct(column.alias("x")), {"ignoreNullFields": "false"})), F.lit("-"))
        return F.coalesce(column.cast("string"), F.lit("-"))

    return F.md5(F.concat_ws("|", *[one(f) for f in df.schema.fields]))


def repeated(df: DataFrame, times: Column, block: int = 1 << 16) -> DataFrame:
    """Each row as often as ``times`` says (0: not at all), made in blocks so that no array grows with the count."""
    at = free(df, "__at")
    blocks = df.withColumn(at, F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("long"), times.cast("long") - 1, F.lit(block).cast("long")))))
    return blocks.withColumn(at, F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(block).cast("long"), times.cast("long") - F.col(at))))).select(*[f"`{c}`" for c in df.columns])


#: A key that holds more than this share of all rows is hot, so there are at most 1 / HOT_SHARE such keys.
HOT_SHARE = 1e-3


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], times: str = "times") -> DataFrame:
    """Inner join of ``rows`` with one row a key of ``classes``, whose ``times`` says how many rows the key has.

    Hot keys are few by their share (at most 1000), so they are sent to the rows where these are;
    only rows of other keys are shuffled, and no task gathers a hot key. Both sides are read twice: cut them before.
    """
    total = classes.agg(F.sum(times)).first()[0] or 0
    hot = F.col(times) > max(1.0, total * HOT_SHARE)
    marked = rows.join(F.broadcast(classes.where(hot).withColumn("__hot", F.lit(True))), keys, "left")
    here = marked.where("__hot").drop("__hot")
    rest = marked.where("__hot IS NULL").select(*rows.columns).join(classes.where(~hot), keys)
    return here.unionByName(rest).drop(times)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Keeps Arrow batches of long texts small, unless the session asks for less."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: pa.Schema) -> DataFrame:
    """Applies ``fn`` (batch to a dict of columns) to Arrow batches; rows may change in number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, from_arrow_schema(schema))
