"""Places of rows in an order, values carried along it, and bounded samples.  A key's rows are dealt out to tasks by ranges, so that a key
with most of all rows takes no longer than others."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .checkpoints import shared_checkpoints

#: A table measured to take at most so many octets is broadcast.
BROADCAST_OCTETS = 16 << 20
#: Rows that a task gets on average where ``dealt`` deals them out.
TASK_ROWS = 1 << 18


def _measured(small: DataFrame) -> DataFrame:
    """A checkpointed table, for broadcast if its values are measured to be few enough."""
    size = small.agg(F.sum(64 + F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(small) if size <= BROADCAST_OCTETS else small


def _matched(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """left with the columns of right, which has one row at most for all values in ``on`` that left has; nulls match nulls."""
    named = right.withColumnsRenamed({c: f"_r{i}" for i, c in enumerate(on)})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r{i}")) for i, c in enumerate(on)])
    return left.join(named, same, how).drop(*[f"_r{i}" for i in range(len(on))])


def numbered(rows: DataFrame, order: Sequence[str | Column], *key: str, name: str = "_n") -> DataFrame:
    """rows with their place, from 0 on, among those of their key in the order; equal ones in the order they are read.

    Rows are sorted by ranges of key and order and counted by key and range; what is before a range is added to the place
    in it.  A key has as many counts as ranges."""
    shared_checkpoints(rows.sparkSession)
    by = [*key, *order, "_read"]
    ranged = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_read")
    # the id's upper bits are the range's number; a checkpoint, as the same rows have to be counted and numbered
    placed = ranged.withColumn("_place", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_place", 33)).checkpoint()
    counts = placed.groupBy(*key, "_range").agg(F.min("_place").alias("_least"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*key, "_range", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_least")).alias("_shift")).checkpoint()
    return _matched(placed, _measured(shift), [*key, "_range"]).withColumn(name, F.col("_place") + F.col("_shift")).drop("_place", "_range", "_shift")


def dealt(rows: DataFrame, total: int, *by: str) -> DataFrame:
    """rows dealt out by columns to as many tasks as ``total`` rows need at ``TASK_ROWS`` each, whatever number of partitions is set."""
    return rows.repartition(max(1, -(-total // TASK_ROWS)), *by)


def carried(rows: DataFrame, value: str, order: str, *key: str, width: int) -> DataFrame:
    """rows in which a null value is that of the last row before it in its key that has one.

    order is a number that is unique in a key.  The last values of blocks of ``width`` numbers are carried from block to block, a row a
    block, and then inside the blocks."""
    return counted_carried(rows, value, order, *key, width=width)[0]


def counted_carried(rows: DataFrame, value: str, order: str, *key: str, width: int) -> tuple[DataFrame, int]:
    """(``carried`` rows, how many there are)."""
    shared_checkpoints(rows.sparkSession)
    blocked = rows.withColumn("_block", F.floor(F.col(order) / width))
    # numbers are added up by hash, a row a block in each task; texts would be sorted, with all rows of a task
    small = isinstance(rows.schema[value].dataType, NumericType)
    at = F.when(F.col(value).isNotNull(), F.col(order))
    last = blocked.groupBy(*key, "_block").agg((F.max_by(value, at) if small else F.max(at)).alias("_last"), F.count("*").alias("_rows")).checkpoint()
    total = last.agg(F.sum("_rows")).first()[0] or 0
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    handed = last.select(*key, "_block", F.last("_last", ignorenulls=True).over(before).alias("_before"))
    if not small:  # so far the places of the values
        places = _measured(handed.filter(F.col("_before").isNotNull()).select(*key, F.col("_before").alias(order)).distinct().checkpoint())
        valued = rows.select(*key, order, F.col(value).alias("_value"))
        found = _matched(valued, places, [*key, order]).withColumnRenamed(order, "_before")
        # one value a place, where rows are given again
        one = Window.partitionBy(*key, "_before").orderBy(F.desc_nulls_last("_value"))
        found = found.withColumn("_nth", F.row_number().over(one)).filter("_nth = 1").drop("_nth")
        handed = _matched(handed, found, [*key, "_before"], "left").drop("_before").withColumnRenamed("_value", "_before")
    inside = Window.partitionBy(*key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = dealt(blocked, total, *key, "_block").withColumn(value, F.last(value, ignorenulls=True).over(inside))
    joined = _matched(filled, _measured(handed.checkpoint()), [*key, "_block"])
    return joined.withColumn(value, F.coalesce(value, "_before")).drop("_block", "_before"), total


def bounded_sample(rows: DataFrame, n: int, *order: str | Column, where: Column | None = None) -> tuple[DataFrame, int]:
    """(at most n rows, how many there are).  A share of about twice as many is drawn first, so that tasks hand on few; of those
    that fit ``where``, the first n in the order are taken."""
    total = rows.count()
    drawn = rows if total <= 2 * n else rows.sample(fraction=2.0 * n / total, seed=0)
    return (drawn if where is None else drawn.filter(where)).orderBy(*order).limit(n), total
