"""Combined forecasts, their errors, and simple baselines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric

KEY = ("horizon", "cluster")


def paired(forecasts: DataFrame, a: str, b: str, *key: str) -> DataFrame:
    """Rows of two models at the same cluster, horizon and time: (key, ts, actual, a, b); predictions not below 0."""
    key = key or KEY
    side = lambda m, name: forecasts.filter(F.col("model") == m).select(*key, "ts", *(["actual"] if name == "a" else []), numeric.not_negative(F.col("predicted")).alias(name))
    return side(a, "a").join(side(b, "b"), [*key, "ts"])


def ensemble(pairs: DataFrame, *key: str) -> DataFrame:
    """The mean of a and b in log space, as ``predicted``; the shift is 2 less the least value of a key's pair."""
    key = key or KEY
    shift = pairs.groupBy(*key).agg((2 - F.least(F.min("a"), F.min("b"))).alias("shift"))
    return pairs.join(shift, list(key)).withColumn("predicted", numeric.log_mean(F.col("a"), F.col("b"), F.col("shift"))).drop("shift")


def hybrid(ensembles: DataFrame, kernel: DataFrame, *key: str) -> DataFrame:
    """The ensemble, but for spikes that the kernel model shows."""
    key = key or KEY
    other = kernel.select(*key, "ts", numeric.not_negative(F.col("predicted")).alias("kernel"))
    return ensembles.join(other, [*key, "ts"]).withColumn("predicted", numeric.spike(F.col("predicted"), F.col("kernel"))).drop("kernel")


def squared_errors(forecasts: DataFrame, *key: str) -> DataFrame:
    """(key, mse, mse_log, n): mean squared errors, plain and in log space, where the shift is 2 less the least value of
    a key's actual and predicted ones."""
    shift = forecasts.groupBy(*key).agg((2 - F.least(F.min("actual"), F.min("predicted"))).alias("shift"))
    difference = F.log(F.col("actual") + F.col("shift")) - F.log(F.col("predicted") + F.col("shift"))
    return forecasts.join(shift, list(key)).groupBy(*key).agg(F.avg(F.pow(F.col("actual") - F.col("predicted"), 2)).alias("mse"), F.avg(difference * difference).alias("mse_log"), F.count("*").alias("n"))


def pooled_errors(forecasts: DataFrame, file: tuple[str, ...], pool: tuple[str, ...]) -> DataFrame:
    """(pool, mse_log): log-space errors with a shift per file, averaged over all rows of a pool."""
    shift = forecasts.groupBy(*file).agg((2 - F.least(F.min("actual"), F.min("predicted"))).alias("shift"))
    difference = F.log(F.col("actual") + F.col("shift")) - F.log(F.col("predicted") + F.col("shift"))
    return forecasts.join(shift, list(file)).groupBy(*pool).agg(F.avg(difference * difference).alias("mse_log"))


def error_histogram(errors: DataFrame, column: str = "error", bins: int = 20, low: float = -15.0, high: float = 15.0) -> DataFrame:
    """(bin, n, density) over [low, high]; bins without rows are left out."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    counted = errors.filter(F.col(column).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(total)).select("bin", "n", (F.col("n") / (F.col("total") * width)).alias("density"))


def constant_error(series: DataFrame, *key: str) -> DataFrame:
    """(key, variance): the squared error of predicting the mean."""
    return series.groupBy(*key).agg(F.var_pop("cnt").alias("variance"))


def log_average(forecasts: DataFrame, models: tuple[str, ...], *key: str) -> DataFrame:
    """The mean of several models in log space, at times that all of them have."""
    key = key or KEY
    logs = forecasts.filter(F.col("model").isin(*models)).groupBy(*key, "ts").agg(F.count_distinct("model").alias("_n"), F.max("actual").alias("actual"), F.exp(F.avg(F.log(numeric.not_negative(F.col("predicted")) + 1))).alias("_e"))
    return logs.filter(F.col("_n") == len(models)).select(*key, "ts", "actual", (F.col("_e") - 1).alias("predicted"))


def template_errors(templates: DataFrame, *key: str) -> DataFrame:
    """(key, score) from (key, as_of, actual, allocated): the sum of log squared errors over the number of dates and 3000.
    Exact predictions, whose log error has no value, are left out."""
    error = F.pow(F.col("actual") - F.col("allocated"), 2)
    return templates.groupBy(*key).agg((F.sum(F.when(error > 0, F.log(error))) / F.count_distinct("as_of") / 3000).alias("score"))


def stacked(forecasts: DataFrame, models: tuple[str, ...], *key: str, train: int = 48, step: int = 12) -> DataFrame:
    """(key, ts, actual, predicted): models put together by ridge regressions on the ``train`` rows before every ``step`` ones.
    Each key is one group, of a row per time that all models have; the first ``train`` rows have no prediction."""
    key = key or KEY
    wide = forecasts.filter(F.col("model").isin(*models)).groupBy(*key, "ts").pivot("model", list(models)).agg(F.first("predicted")).dropna(subset=list(models))
    actual = forecasts.groupBy(*key, "ts").agg(F.max("actual").alias("actual"))
    joined = wide.join(actual, [*key, "ts"])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts")
        x, y = frame[list(models)].to_numpy(float), frame["actual"].to_numpy(float)
        predicted = np.full(len(y), np.nan)
        for at in range(train, len(y), step):
            a, b = x[at - train : at], y[at - train : at]
            predicted[at : at + step] = x[at : at + step] @ np.linalg.solve(a.T @ a + np.eye(len(models)), a.T @ b)
        return frame[[*key, "ts", "actual"]].assign(predicted=predicted)[~np.isnan(predicted)]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema if f.name in (*key, "ts", "actual"))
    return joined.groupBy(*key).applyInPandas(run, f"{schema}, predicted double")
