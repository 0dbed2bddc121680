"""Helpers shared by the operators: table access, reliable checkpoints and bounded Arrow slices."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import clear, new_folder, shared_checkpoints

__all__ = ["clear", "new_folder"]

#: Text bytes that one numpy step works on; a longer text is a step of its own.
SLICE_BYTES = 4 << 20
#: A table up to this size is broadcast.
BROADCAST_BYTES = 24 << 20
#: A key is hot if more than one row in so many has it.
HOT_SHARE = 10_000
#: Equal rows that a task writes at once.
COPIES = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share; see ``checkpoints``."""
    shared_checkpoints(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


@contextmanager
def _freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files once it has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def reliable(df: DataFrame) -> DataFrame:
    """Cuts lineage through a checkpoint in the shared folder, which survives lost executors."""
    shared_folder(df.sparkSession)
    with _freeing_shuffles(df.sparkSession):
        return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Like ``reliable``, as a Parquet table: for many rows whose columns compress well."""
    path = new_folder(df.sparkSession, "parquet")
    with _freeing_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def selected(df: DataFrame, condition: Column) -> DataFrame:
    """Filters after df's columns are there.  A plain filter would be pushed below them, with the expressions that make
    the columns in it, which are then evaluated twice or, inside lambdas, for every element."""
    return df.withColumn("_at", F.monotonically_increasing_id()).filter(condition & (F.col("_at") >= 0)).drop("_at")


def octets(df: DataFrame) -> int:
    """What a checkpointed table's values take: 64 octets a row, and its strings, arrays and structs."""
    size: Column = F.lit(64).cast("long")
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            size += F.coalesce(F.octet_length(f"`{field.name}`"), F.lit(0))
        elif kind in ("array", "map", "struct"):
            size += F.octet_length(F.to_json(F.struct(f"`{field.name}`")))
    return df.agg(F.sum(size).alias("n")).first().n or 0


def modest(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A checkpointed table, marked for broadcast if it is measured to take at most ``limit`` octets, and left to be
    joined by a shuffle otherwise."""
    return F.broadcast(df) if octets(df) <= limit else df


def looked_up(big: DataFrame, small: DataFrame, key: str, times: str) -> DataFrame:
    """big, left-joined with the checkpointed table small on a key that is unique there; ``times`` says how many rows of
    big have it, about, and is left out.  A small table is broadcast.  Of a larger one only the keys are that more than
    one row in ``HOT_SHARE`` has, which are at most ``HOT_SHARE``; the others shuffle, and no hot key does."""
    names = [c for c in small.columns if c != times]
    if octets(small) <= BROADCAST_BYTES:
        return big.join(F.broadcast(small.select(*names)), key, "left")
    limit = (small.agg(F.sum(times).alias("n")).first().n or 0) / HOT_SHARE
    hot = small.filter(F.col(times) > limit).select(*names)
    by_hot = big.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), key, "left")
    columns = [*big.columns, *[c for c in names if c != key]]
    warm = by_hot.filter("__hot").select(*columns)
    cold = by_hot.filter("__hot is null").select(*big.columns).join(small.filter(F.col(times) <= limit).select(*names), key, "left")
    return warm.unionByName(cold.select(*columns))


def repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row of a table as often as its column ``times`` says, without that column; many equal rows are written by many
    tasks."""
    most = df.agg(F.max(times).alias("n")).first().n or 0
    rows = df
    if most > COPIES:
        parts = df.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / COPIES))))
        dealt = parts.repartition("__part", *[c for c in df.columns if c != times])
        rows = dealt.withColumn(times, F.least(F.lit(COPIES), F.col(times) - COPIES * F.col("__part"))).drop("__part")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).drop("__copy", times)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with at most ``limit`` bytes in ``column`` (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for row, length in enumerate(lengths):
        if row > start and size + length > limit:
            yield batch.slice(start, row - start)
            start, size = row, 0
        size += length
    if start < batch.num_rows:
        yield batch.slice(start)
