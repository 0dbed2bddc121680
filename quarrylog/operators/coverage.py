"""How much of the load the largest clusters cover, and their arrival series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import asof, bucketed, running_total

TOP = 3


def cluster_totals(assignments: DataFrame, counts: DataFrame) -> DataFrame:
    """(as_of, cluster, total): members' queries up to each date; unassigned templates are left out."""
    members = assignments.filter("cluster >= 0").withColumn("ts", F.col("as_of"))
    totals = running_total(counts, "template").select("template", "ts", "total")
    known = asof(members, totals, ["template"], "total")
    return known.groupBy("as_of", "cluster").agg(F.sum(F.coalesce("total", F.lit(0))).alias("total"))


def top_clusters(totals: DataFrame, k: int = TOP, *key: str) -> DataFrame:
    """The k clusters with the largest totals of each date, with their rank; of equal ones the smaller id first."""
    over = Window.partitionBy(*(key or ("as_of",))).orderBy(F.desc("total"), "cluster")
    return totals.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= k)


def coverage(totals: DataFrame, k: int = TOP) -> DataFrame:
    """(k, mean_share): the mean over dates of the share that the i largest clusters have, for i up to k."""
    by_date = Window.partitionBy("as_of")
    ranked = by_date.orderBy(F.desc("total"), "cluster")
    shares = totals.select(F.row_number().over(ranked).alias("k"), F.try_divide(F.sum("total").over(ranked.rowsBetween(Window.unboundedPreceding, 0)), F.sum("total").over(by_date)).alias("share"))
    return shares.filter(F.col("k") <= k).groupBy("k").agg(F.avg("share").alias("mean_share"))


def version_at(versions: DataFrame, date: Column) -> DataFrame:
    """The rows of the latest version up to a date."""
    return versions.join(versions.filter(F.col("as_of") <= date).agg(F.max("as_of").alias("as_of")), "as_of", "left_semi")


def cluster_series(assignments: DataFrame, counts: DataFrame, minutes: int = 10, tops: DataFrame | None = None) -> DataFrame:
    """(cluster, ts, cnt): members' arrivals of each day under that day's assignment, in right-labelled buckets.

    tops: if given, only clusters among the largest ones of the day.  Clusters with one row are left out."""
    days = assignments.filter("cluster >= 0")
    if tops is not None:
        days = days.join(tops, ["as_of", "cluster"], "left_semi")
    # a day's assignment holds for the day before it; the join is on template and day, not a range
    day = F.date_trunc("day", F.timestamp_add("MINUTE", F.lit(1440), F.col("ts"))).cast("timestamp_ntz")
    dated = counts.withColumn("day", day)
    joined = dated.join(days.withColumn("day", F.date_trunc("day", "as_of").cast("timestamp_ntz")), ["template", "day"])
    series = bucketed(joined.select("cluster", "ts", "cnt"), minutes, "cluster", label="right")
    long = series.groupBy("cluster").count().filter("count >= 2")
    return series.join(long, "cluster", "left_semi")
