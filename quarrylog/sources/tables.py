"""The library's own tables, and exports of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import finite_or_zero, not_negative
from ..functions.text import drop_dollars

SCHEMAS = {
    "template_counts": "template string, ts timestamp_ntz, cnt long",
    "assignments": "as_of timestamp_ntz, template string, cluster int",
    "top_clusters": "as_of timestamp_ntz, cluster int, total long, rank int",
    "cluster_series": "cluster int, ts timestamp_ntz, cnt long",
    "forecasts": "model string, horizon int, cluster int, ts timestamp_ntz, actual double, predicted double",
    "trace": "ts timestamp_ntz, conn string, query string",
    "cluster_totals": "as_of timestamp_ntz, cluster int, total long",
    "coverage": "k int, mean_share double",
    "replay": "ts timestamp_ntz, throughput double, p99 double, index string",
    "models": "model string, horizon int, as_of timestamp_ntz, shift double, mean double, deviation double, clusters array<int>, weights array<array<double>>",
}
#: Columns that tables are laid out by, so that filters on them read those folders only.
PARTITIONS = {"assignments": ("as_of",), "cluster_series": ("cluster",), "forecasts": ("model", "horizon"), "models": ("as_of",)}


def write_table(df: DataFrame, name: str, folder: str) -> None:
    df.write.mode("overwrite").partitionBy(*PARTITIONS.get(name, ())).parquet(f"{folder}/{name}")


def append_table(df: DataFrame, name: str, folder: str) -> None:
    """Adds rows to a table laid out by some columns.  What it has for the values that these columns have in df is replaced, and
    nothing else, so that writing a day again leaves the table as it was."""
    if not PARTITIONS.get(name):
        raise ValueError(f"{name} is not laid out by any column")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS[name]).parquet(f"{folder}/{name}")


def read_table(spark: SparkSession, name: str, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")


def read_template_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of templates without dollar signs; those that become equal are added up."""
    return read_table(spark, "template_counts", folder).groupBy(drop_dollars(F.col("template")).alias("template"), "ts").agg(F.sum("cnt").alias("cnt"))


def read_series_csv(spark: SparkSession, path: str) -> DataFrame:
    """(file, ts, cnt) of ``ts, count`` files in a folder and those below it."""
    options = {"recursiveFileLookup": True, "pathGlobFilter": "*.csv", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}
    return spark.read.schema("ts timestamp_ntz, cnt long").options(**options).csv(path).select(F.col("_metadata.file_path").alias("file"), "ts", "cnt")


def cleaned_predictions(forecasts: DataFrame, mode: str = "raw") -> DataFrame:
    """Predictions for combining (``clamped`` at 0), for errors (``raw``) or for sensitivity (``finite``)."""
    change = {"raw": lambda c: c, "clamped": not_negative, "finite": finite_or_zero}[mode]
    return forecasts.withColumn("predicted", change(F.col("predicted")))


def write_quoted_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("quoteAll", True).option("escape", '"').csv(path)


def write_templates(counts: DataFrame, path: str) -> None:
    """The distinct templates, sorted, one a line."""
    counts.select("template").distinct().orderBy("template").write.mode("overwrite").text(path)


def write_trace(trace: DataFrame, path: str) -> None:
    """``ts,conn,query`` lines."""
    trace.select(F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "conn", "query")).write.mode("overwrite").text(path)


def pivoted(df: DataFrame, label: str, column: str, value: str, columns: list) -> DataFrame:
    """A row per label with a column per given value of ``column``."""
    return df.groupBy(label).pivot(column, columns).agg(F.first(value))
