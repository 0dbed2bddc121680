"""Counts per template and minute from a stream of log rows, and totals that follow it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import new_folder
from ..functions import text


def stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def minute_counts(log: DataFrame, template: str, lateness: str = "10 minutes", minutes: int = 1) -> DataFrame:
    """(template, ts, cnt) per bucket; rows more than ``lateness`` behind are dropped, and state before that is freed.

    Watermarks need times with a zone, so ts is taken as one in the session's zone."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    counted = timed.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), F.col(template).alias("template")).agg(F.count("*").alias("cnt"))
    return counted.select("template", F.col("w.start").cast("timestamp_ntz").alias("ts"), "cnt")


def templates(log: DataFrame) -> DataFrame:
    """A stream's rows with their normalised template."""
    found = text.templatize(text.statement_of(F.col("query")))
    # rows are chosen by their statement word, so that the patterns run once
    return log.filter(text.has_statement(F.col("query"))).withColumn("template", text.truncate_insert(text.normalize_template(found)))


def run_to_end(counts: DataFrame) -> DataFrame:
    """Runs a bounded stream to its end and returns all its counts, late rows among them, as a table.

    Each trigger replaces the table by its counts so far, so that one that runs again changes nothing."""
    folder, checkpoint = new_folder(counts.sparkSession, "counts"), new_folder(counts.sparkSession, "stream")
    write = lambda all_, trigger: all_.write.mode("overwrite").parquet(folder)
    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return counts.sparkSession.read.schema(counts.schema).parquet(folder)


def append_to(counts: DataFrame, path: str, checkpoint: str):
    """Starts writing finished buckets to Parquet; the checkpoint folder makes restarts exact."""
    return counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
