"""Linear forecasts whose sums are taken in Spark, and tables of fitted models.

The walk over dates of ``forecast`` gives each date to one task.  Here a date's rows are rows of a table: lags and targets are
array columns, a date's regression is a sum of products over its rows (``gram``), and what is fitted is a row of a table of
models that can be kept and applied later, by as-of join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import shared_checkpoints
from ..functions import numeric
from .forecast import Settings, frames
from .gram import ridge
from .series import asof

#: Rows that a date's training span has beyond its lags and horizon, at least.
LEAST_ROWS = 12
MODEL = "ar"


def lagged(series: DataFrame, tops: DataFrame, s: Settings) -> DataFrame:
    """(as_of, ts, place, n, clusters, actual, v, x, shift, mean, deviation), a row for each date and step of its grid: counts of its
    clusters by rank, the same in log space, scaled by the training span, and the last ``s.lags`` of these (null where there
    are fewer)."""
    given = frames(series, tops, s)
    steps = given.groupBy("as_of", "ts").agg(F.array_sort(F.collect_list(F.struct("rank", "cluster", "cnt"))).alias("_c"))
    counts = steps.select("as_of", "ts", F.transform("_c", lambda c: c["cluster"]).alias("clusters"), F.transform("_c", lambda c: c["cnt"]).alias("actual"))
    # a date has the rows of its training days
    date = Window.partitionBy("as_of")
    placed = counts.withColumns({"place": F.row_number().over(date.orderBy("ts")) - 1, "n": F.count("*").over(date), "shift": 1 - F.min(F.array_min("actual")).over(date)})
    enough = placed.filter(F.col("n") - s.per_day - 2 * s.horizon >= s.lags + LEAST_ROWS)
    logs = enough.withColumn("v", F.transform("actual", lambda c: F.log(c + F.col("shift"))))
    trained = F.when(F.col("place") < F.col("n") - s.per_day - s.horizon, F.col("v"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    size = F.sum(F.when(trained.isNotNull(), F.size("v")).otherwise(0)).over(date)
    logs = logs.withColumn("mean", F.sum(total(trained)).over(date) / size)
    spread = F.sqrt(F.sum(total(F.transform(trained, lambda x: (x - F.col("mean")) * (x - F.col("mean"))))).over(date) / size)
    scaled = logs.withColumn("deviation", spread).withColumn("deviation", F.when(F.col("deviation") > 0, F.col("deviation")).otherwise(1.0))
    scaled = scaled.withColumn("v", F.transform("v", lambda x: (x - F.col("mean")) / F.col("deviation")))
    # models are fitted to these rows and applied to them
    shared_checkpoints(series.sparkSession)
    return scaled.checkpoint().withColumn("x", F.when(F.col("place") >= s.lags - 1, F.flatten(F.collect_list("v").over(date.orderBy("ts").rowsBetween(1 - s.lags, 0)))))


def fitted(rows: DataFrame, s: Settings, weight: float = 1.0) -> DataFrame:
    """(model, horizon, as_of, shift, mean, deviation, clusters, weights) of lagged rows: a regression for each date, on lags and targets
    that both lie in its training span."""
    ahead = Window.partitionBy("as_of").orderBy("ts")
    pairs = rows.withColumn("y", F.lead("v", s.horizon).over(ahead)).filter(F.col("x").isNotNull() & (F.col("place") + s.horizon < F.col("n") - s.per_day - s.horizon))
    weights = ridge(pairs, "x", "y", weight, "as_of").withColumnRenamed("matrix", "weights")
    kept = rows.filter("place = 0").select("as_of", "shift", "mean", "deviation", "clusters")
    return kept.join(weights, "as_of").select(F.lit(MODEL).alias("model"), F.lit(s.horizon * s.minutes).alias("horizon"), "as_of", "shift", "mean", "deviation", "clusters", "weights")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def applied(models: DataFrame, rows: DataFrame, s: Settings) -> DataFrame:
    """(model, horizon, as_of, cluster, ts, actual, predicted) of the last day of lagged rows, each date by the latest of models(model,
    horizon, as_of, ...) that is not later, for clusters that model knows in the same places."""
    after = Window.partitionBy("as_of").orderBy("ts")
    last = rows.withColumns({"x": F.lag("x", s.horizon).over(after)}).filter((F.col("place") >= F.col("n") - s.per_day) & F.col("x").isNotNull())
    names = models.filter(F.col("horizon") == s.horizon * s.minutes).select("model", "horizon").distinct()
    dates = last.select("as_of").distinct().join(F.broadcast(names)).select("model", "horizon", F.col("as_of").alias("ts"))
    # the number of models is that of dates
    known = models.select("model", "horizon", F.col("as_of").alias("ts"), F.struct(*[F.col(c).alias(f"m_{c}") for c in ("shift", "mean", "deviation", "clusters", "weights")]).alias("m"))
    chosen = asof(dates, known, ["model", "horizon"], "m").filter("m is not null").select("model", "horizon", F.col("ts").alias("as_of"), "m.*")
    both = last.join(chosen, "as_of").filter(F.col("clusters") == F.col("m_clusters"))
    # lags were scaled by the row's own date: bring them to the model's scale
    own, scale = ([F.col(f"{m}{c}") for c in ("shift", "mean", "deviation")] for m in ("", "m_"))
    # a count below what the model has seen is as little as it can tell
    above = lambda c: F.greatest(c, 1e-9 - F.col("m_shift"))
    x = F.transform("x", lambda v: numeric.log_scaled(above(numeric.log_restored(v, *own)), *scale))
    x = F.when((F.col("shift") == F.col("m_shift")) & (F.col("mean") == F.col("m_mean")) & (F.col("deviation") == F.col("m_deviation")), F.col("x")).otherwise(x)
    guess = F.transform("m_weights", lambda w: numeric.log_restored(_dot(w, F.col("_x")), *scale))
    found = both.withColumn("_x", x).withColumn("_p", F.arrays_zip("clusters", "actual", guess.alias("predicted")))
    return found.select("model", "horizon", "as_of", "ts", F.explode("_p").alias("_p")).select("model", "horizon", "as_of", F.col("_p.clusters").alias("cluster"), "ts", F.col("_p.actual").alias("actual"), F.col("_p.predicted").alias("predicted"))


def forecasts(series: DataFrame, tops: DataFrame, horizons: tuple[int, ...] = (1,), settings: Settings = Settings()) -> DataFrame:
    """What the walk gives for its linear model: each date by the model fitted for it."""
    out = None
    for horizon in horizons:
        s = Settings(**{**settings.__dict__, "horizon": horizon})
        rows = lagged(series, tops, s)
        found = applied(fitted(rows, s), rows, s)
        out = found if out is None else out.unionByName(found)
    return out
