"""Single-column index advice from forecasts, or from what has been seen so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.generate import column_weight
from ..functions.numeric import share_of
from ..functions.text import index_name, index_statement
from .series import asof

# Least queries of a template, its weight without and with an index, and weights by minutes ahead.
LEAST_QUERIES = 100
NEW_WEIGHT, INDEXED_WEIGHT = 10_000, 1
AHEAD_WEIGHTS = ((60, 100), (1440, 10), (10_080, 1))
HISTORY_DAYS = 14


def _weighted(access: DataFrame, indexes: DataFrame) -> DataFrame:
    """access with the weight of each template: low if one of its columns has an index already."""
    flagged = access.join(indexes.select("table", "column").distinct().withColumn("_i", F.lit(1)), ["table", "column"], "left")
    some = F.max("_i").over(Window.partitionBy("template"))
    return flagged.withColumn("weight", F.when(some == 1, INDEXED_WEIGHT).otherwise(NEW_WEIGHT)).drop("_i")


def _ranked(benefit: DataFrame, schema: DataFrame) -> DataFrame:
    """Every column of the schema with its benefit, 0 for those that nothing asks for."""
    return schema.select("table", "column", "ordinal").join(benefit, ["table", "column"], "left").select("table", "column", "ordinal", F.coalesce("benefit", F.lit(0.0)).alias("benefit"))


def recent_totals(counts: DataFrame, start, days: int = HISTORY_DAYS) -> DataFrame:
    """(template, total) over the last days up to a date."""
    span = (F.col("ts") > F.lit(start) - F.expr(f"INTERVAL {days} DAY")) & (F.col("ts") <= F.lit(start))
    return counts.filter(span).groupBy("template").agg(F.sum("cnt").alias("total"))


def predicted_benefit(totals: DataFrame, members: DataFrame, forecasts: DataFrame, access: DataFrame, schema: DataFrame, indexes: DataFrame, start, duration: int, step: int) -> DataFrame:
    """(table, column, ordinal, benefit): each template's part of its cluster's forecast at the steps from start on, by how
    far ahead they are, by type and by template weight.

    totals(template, total); members(template, cluster): of the largest clusters; forecasts(cluster, ts, predicted, ahead):
    ``ahead`` names the upper bound of AHEAD_WEIGHTS that a forecast is for."""
    load = totals.join(members, "template")
    cluster = load.groupBy("cluster").agg(F.sum("total").alias("cluster_total"))
    steps = [(j, bound, w) for low, (bound, w) in zip((0, 60, 1440), AHEAD_WEIGHTS, strict=True) for j in range(low, bound, step) if j < duration]
    spark = totals.sparkSession
    ahead = spark.createDataFrame(steps or [(0, 0, 0)], "minutes int, ahead int, step_weight int")
    grid = cluster.join(F.broadcast(ahead)).withColumn("ts", F.timestamp_add("MINUTE", F.col("minutes"), F.lit(start).cast("timestamp_ntz")))
    rates = asof(grid, forecasts.select("cluster", "ahead", "ts", "predicted"), ["cluster", "ahead"], "predicted").filter("step_weight > 0")
    rates = rates.groupBy("cluster").agg(F.sum(F.col("predicted") * F.col("step_weight")).alias("rate"))
    busy = load.filter(F.col("total") >= LEAST_QUERIES).join(cluster, "cluster").join(rates, "cluster")
    part = share_of(F.col("rate"), F.col("total"), F.col("cluster_total"))
    return _scored(busy.select("template", part.alias("part")), access, schema, indexes)


def seen_benefit(totals: DataFrame, access: DataFrame, schema: DataFrame, indexes: DataFrame) -> DataFrame:
    """The same from all queries seen so far instead of a forecast."""
    busy = totals.filter(F.col("total") >= LEAST_QUERIES)
    return _scored(busy.select("template", F.col("total").cast("double").alias("part")), access, schema, indexes)


def _scored(parts: DataFrame, access: DataFrame, schema: DataFrame, indexes: DataFrame) -> DataFrame:
    weights = schema.select("table", "column", column_weight(F.col("data_type")).alias("card"))
    joined = parts.join(_weighted(access, indexes), "template").join(weights, ["table", "column"])
    benefit = joined.groupBy("table", "column").agg(F.sum(F.col("part") * F.col("card") * F.col("weight")).cast("double").alias("benefit"))
    return _ranked(benefit, schema)


def not_indexed(candidates: DataFrame, indexes: DataFrame) -> DataFrame:
    """Candidates (table, column, ...) without an index of their column."""
    return candidates.join(indexes.select("table", "column"), ["table", "column"], "left_anti")


def advice(benefit: DataFrame, indexes: DataFrame, n: int = 1, least: float = 0.0) -> DataFrame:
    """The n best columns without an index, with the statements that make them; none at a benefit of ``least`` or below."""
    free = not_indexed(benefit, indexes).filter(F.col("benefit") > least)
    best = free.orderBy(F.desc("benefit"), "table", "ordinal").limit(n)
    return best.select("table", "column", "benefit", index_name(F.col("table"), F.col("column")).alias("index_name"), index_statement(F.col("table"), F.col("column")).alias("statement"))


def droppable(indexes: DataFrame, name: str = "index_name") -> DataFrame:
    """Indexes that are neither primary nor for a foreign key."""
    c = F.col(name)
    return indexes.filter(~(c.contains("PRIMARY") | c.contains("fk_") | c.contains("pkey")))
