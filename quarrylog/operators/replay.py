"""Summaries of a trace that was run: batches, throughput, latency and kinds of scans."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import time
from ..functions.plans import scan_kind
from ..functions.text import bind_parameters, close_statement, has_statement, restore_literals, statement_of
from ..ordering import numbered
from .series import asof

# Trace minutes of a batch, seconds that it runs, latencies that p99 looks at, batches before recording.
BATCH_MINUTES, BATCH_SECONDS, LATENCIES, WARM_UP = 10, 1, 3000, 40
WORKERS = 24


def trace(log: DataFrame, tokens: DataFrame | None = None, parameters: bool = False) -> DataFrame:
    """(ts, conn, query): statements with their parameters, hashed literals that are known, and a semicolon."""
    query = F.col("query")
    log = log.filter(has_statement(query))
    if parameters:
        query = F.when(query.contains("execute"), bind_parameters(query, F.col("params"))).otherwise(query)
    query = close_statement(statement_of(query))
    if tokens is not None:
        # an enumeration dictionary is as small as a schema
        listed = tokens.agg(F.sort_array(F.collect_list(F.struct("token", "literal"))).alias("_tokens"))
        log = log.join(F.broadcast(listed))
        query = restore_literals(query, F.col("_tokens"))
    return log.select(time.minute(F.col("ts")).alias("ts"), "conn", query.alias("query"))


def batches(rows: DataFrame, minutes: int = BATCH_MINUTES) -> DataFrame:
    """Rows with the end of their batch (t - minutes, t]."""
    return rows.withColumn("batch", time.ceil_bucket(F.col("ts"), minutes))


def throughput(rows: DataFrame, minutes: int = BATCH_MINUTES, seconds: int = BATCH_SECONDS, warm_up: int = 0) -> DataFrame:
    """(batch, throughput): executed rows a second of each batch after the first ``warm_up`` ones."""
    counted = batches(rows, minutes).groupBy("batch").agg((F.count("*") / F.lit(seconds)).alias("throughput"))
    if not warm_up:
        return counted
    # a row a batch: the trace's length in batches bounds this window
    return counted.withColumn("_n", F.row_number().over(Window.orderBy("batch"))).filter(F.col("_n") > warm_up).drop("_n")


def p99(rows: DataFrame, value: str, order: tuple[str, ...], *key: str, last: int = LATENCIES, block_rows: int = 50_000) -> DataFrame:
    """Each row with the 99th percentile of the last latencies of its key: of n sorted ones that at n - n div 100 - 1.

    A key's rows are numbered by ranges and cut into blocks of ``block_rows`` in their order, each with the ``last - 1`` rows
    before it, so that no task holds more; a block keeps its latest values sorted while it goes along.  Nulls count for nothing."""
    step = max(block_rows, last)
    placed = numbered(rows, order, *key).withColumn("_b", F.floor(F.col("_n") / step).cast("long"))
    # the rows that the next block has to know go there too
    ahead = F.when(F.col("_n") % step > step - last, F.array(F.struct(F.col("_b").alias("b"), F.lit(True).alias("own")), F.struct((F.col("_b") + 1).alias("b"), F.lit(False).alias("own"))))
    dealt = placed.withColumn("_x", F.explode(F.coalesce(ahead, F.array(F.struct(F.col("_b").alias("b"), F.lit(True).alias("own")))))).withColumns({"_b": F.col("_x.b"), "_own": F.col("_x.own")}).drop("_x")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", p99 double"
    columns = [f.name for f in rows.schema]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_n")
        values, own = frame[value].to_numpy(float), frame["_own"].to_numpy(bool)
        kept: list[float] = []
        out = np.full(len(values), np.nan)
        for i, v in enumerate(values):
            if i >= last and not np.isnan(values[i - last]):
                del kept[bisect.bisect_left(kept, values[i - last])]
            if not np.isnan(v):
                bisect.insort(kept, v)
            if kept:
                out[i] = kept[len(kept) - len(kept) // 100 - 1]
        return frame[columns].assign(p99=out)[own]

    found = dealt.groupBy(*key, "_b").applyInPandas(run, schema)
    return found.withColumn("p99", F.when(~F.isnan("p99"), F.col("p99")))


def latest_p99(rows: DataFrame, value: str, order: tuple[str, ...], *key: str, last: int = LATENCIES) -> DataFrame:
    """(key, p99) of each key's last latencies; a key's rows are numbered by ranges and cut to those before they are gathered."""
    kept = numbered(rows, [F.desc(o) for o in order], *key).filter(F.col("_n") < last)
    listed = kept.groupBy(*key).agg(F.sort_array(F.collect_list(value)).alias("_l"))
    return listed.select(*key, F.get("_l", (F.size("_l") - F.floor(F.size("_l") / 100) - 1).cast("int")).alias("p99"))


def metrics(rows: DataFrame, value: str, indexes: DataFrame, minutes: int = BATCH_MINUTES, seconds: int = BATCH_SECONDS, warm_up: int = WARM_UP, last: int = LATENCIES) -> DataFrame:
    """(ts, throughput, p99, index) of the batches of a run, from rows(ts, id, value) of all workers; p99 is that of the last
    latencies up to the end of the batch, and indexes(ts, index) names what was built by then."""
    ordered = p99(rows, value, ("ts", "id"), last=last)
    by_batch = batches(ordered.withColumn("_at", F.col("ts")).withColumn("ts", time.minute(F.col("ts"))), minutes).groupBy("batch").agg((F.count("*") / F.lit(seconds)).alias("throughput"), F.max_by("p99", F.struct("_at", "id")).alias("p99"))
    # a row a batch
    kept = by_batch.withColumn("_n", F.row_number().over(Window.orderBy("batch"))).filter(F.col("_n") > warm_up)
    known = kept.select(F.lit(0).alias("_run"), F.col("batch").alias("ts"), "throughput", "p99")
    return asof(known, indexes.select(F.lit(0).alias("_run"), "ts", "index"), ["_run"], "index").drop("_run")


def scan_counts(plans: DataFrame, *key: str, entries: str = "entries") -> DataFrame:
    """(key, seq, idx, primary, foreign, secondary): plans by the kind of scan that their leaves show."""
    kinds = plans.withColumn("_k", scan_kind(F.col(entries)))
    count = lambda *k: F.count_if(F.col("_k").isin(*k))
    return kinds.groupBy(*key).agg(count("seq").alias("seq"), count("primary", "foreign", "secondary").alias("idx"), count("primary").alias("primary"), count("foreign").alias("foreign"), count("secondary").alias("secondary"))
