"""Arrival series: counting, bucketing, dense grids, windows and as-of joins.

Every window has a key, so no task sees a whole table; counts are partly aggregated before each shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, time


def workload(log: DataFrame, template: str = "query") -> DataFrame:
    """(template, ts, cnt): queries per template and minute, from a log(ts, query).  Rows without a statement are left out."""
    statement = text.statement_of(F.col(template))
    rows = log.filter(text.has_statement(F.col(template))).select(text.templatize(statement).alias("template"), time.minute(F.col("ts")).alias("ts"))
    return rows.groupBy("template", "ts").agg(F.count("*").alias("cnt"))


def merged(*counts: DataFrame) -> DataFrame:
    """Partial counts of any origin added up, under normalised templates."""
    both = counts[0]
    for other in counts[1:]:
        both = both.unionByName(other)
    normal = text.truncate_insert(text.normalize_template(F.col("template")))
    return both.groupBy(normal.alias("template"), "ts").agg(F.sum("cnt").alias("cnt"))


def totals(counts: DataFrame, *key: str) -> DataFrame:
    return counts.groupBy(*key).agg(F.sum("cnt").alias("total"))


def bounds(counts: DataFrame) -> DataFrame:
    return counts.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def bucketed(counts: DataFrame, minutes: int, *key: str, label: str = "left") -> DataFrame:
    """Sums over [t, t + minutes) labelled t, or over (t - minutes, t] labelled t."""
    bucket = (time.floor_bucket if label == "left" else time.ceil_bucket)(F.col("ts"), minutes)
    return counts.groupBy(*key, bucket.alias("ts")).agg(F.sum("cnt").alias("cnt"))


def bucketed_rows(counts: DataFrame, n: int, *key: str) -> DataFrame:
    """Sums over every n rows in time order, labelled with the last one's time."""
    over = Window.partitionBy(*key).orderBy("ts")
    numbered = counts.withColumn("_b", F.floor((F.row_number().over(over) - 1) / n))
    return numbered.groupBy(*key, "_b").agg(F.max("ts").alias("ts"), F.sum("cnt").alias("cnt")).drop("_b")


def dense(counts: DataFrame, minutes: int, *key: str) -> DataFrame:
    """A row for each step from a key's first to its last, with 0 where nothing arrived."""
    spans = counts.groupBy(*key).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    grid = spans.select(*key, F.explode(time.grid(F.col("lo"), F.col("hi"), minutes)).alias("ts"))
    return grid.join(counts, [*key, "ts"], "left").select(*key, "ts", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def running_total(counts: DataFrame, *key: str) -> DataFrame:
    over = Window.partitionBy(*key).orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("total", F.sum("cnt").over(over))


def rolling_total(counts: DataFrame, minutes: int, *key: str) -> DataFrame:
    """Sums over (t - minutes, t] at every row."""
    over = Window.partitionBy(*key).orderBy(time.epoch_minutes(F.col("ts"))).rangeBetween(1 - minutes, 0)
    return counts.withColumn("total", F.sum("cnt").over(over))


def between(counts: DataFrame, lo, hi, closed: bool = False) -> DataFrame:
    """Rows with ts in [lo, hi), or in [lo, hi]."""
    return counts.filter((F.col("ts") >= lo) & ((F.col("ts") <= hi) if closed else (F.col("ts") < hi)))


def with_enough(counts: DataFrame, least: int, *key: str) -> DataFrame:
    """Rows of keys with a total of ``least`` or more."""
    enough = totals(counts, *key).filter(F.col("total") >= least)
    return counts.join(enough, list(key), "left_semi")


def long_enough(counts: DataFrame, least: int, *key: str) -> DataFrame:
    """Rows of keys with ``least`` points or more."""
    enough = counts.groupBy(*key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    return counts.join(enough, list(key), "left_semi")


def asof(left: DataFrame, right: DataFrame, key: Sequence[str], value: str, strict: bool = False) -> DataFrame:
    """Each left row with the value of the latest right row of its key, at its time or (strict) before it.

    One union and one window: no range join, and nothing is broadcast.  Right rows are unique per key and time."""
    marked = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(0 if strict else 1).alias("_side"), F.lit(True).alias("_left"))
    extra = [F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema if f.name not in (*key, "ts")]
    other = right.select(*key, "ts", value, *extra, F.lit(1 if strict else 0).alias("_side"), F.lit(False).alias("_left"))
    over = Window.partitionBy(*key).orderBy("ts", "_side").rowsBetween(Window.unboundedPreceding, -1)
    filled = marked.unionByName(other).withColumn(value, F.last(value, ignorenulls=True).over(over))
    return filled.filter("_left").select(*left.columns, value)


def lag_features(series: DataFrame, dims: int, horizon: int, *key: str) -> DataFrame:
    """(key, ts, x, y): the last ``dims`` values up to a time, and the one ``horizon`` steps later."""
    over = Window.partitionBy(*key).orderBy("ts")
    x = F.collect_list("cnt").over(over.rowsBetween(1 - dims, 0))
    y = F.lead("cnt", horizon).over(over)
    return series.select(*key, "ts", x.alias("x"), y.alias("y")).filter((F.size("x") == dims) & F.col("y").isNotNull())


def shifted(series: DataFrame, horizon: int, *key: str) -> DataFrame:
    """Each value with the one ``horizon`` steps later."""
    return series.withColumn("target", F.lead("cnt", horizon).over(Window.partitionBy(*key).orderBy("ts")))


def targets(series: DataFrame, horizons: Sequence[int], *key: str) -> DataFrame:
    """(key, ts, cnt, horizon, target): each value with the ones a list of horizons later, a row each; null beyond the end."""
    over = Window.partitionBy(*key).orderBy("ts")
    later = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead("cnt", h).over(over).alias("target")) for h in horizons])
    return series.withColumn("_a", later).withColumn("_t", F.explode("_a")).select(*series.columns, "_t.horizon", "_t.target")


def last_value_error(series: DataFrame, horizon: int, *key: str) -> DataFrame:
    """The error of predicting that nothing changes over a horizon."""
    before = F.lag("cnt", horizon).over(Window.partitionBy(*key).orderBy("ts"))
    return series.withColumn("error", F.col("cnt") - before).filter("error is not null")


def shifts(series: DataFrame, past: int, future: int, *key: str) -> DataFrame:
    """Each time with all values from ``past`` steps before to ``future`` steps after it, where they exist."""
    over = Window.partitionBy(*key).orderBy("ts").rowsBetween(-past, future)
    return series.withColumn("stack", F.collect_list("cnt").over(over)).filter(F.size("stack") == past + future + 1)


def round_robin(rows: DataFrame, n: int, order: Sequence[str], *key: str) -> DataFrame:
    """Rows dealt out in turn to n workers, within each key."""
    return rows.withColumn("worker", (F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1) % n)


def sampled_minutes(counts: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """At most n of the distinct times, the same ones on every run."""
    return counts.select("ts").distinct().orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.date_format("ts", "yyyy-MM-dd HH:mm")).cast("binary")), "ts").limit(n)
