"""Clusters of templates by arrival pattern or by logical structure.

``online`` is the day-by-day procedure: greedy, in template order, against live centres, so that each workload is one
grouped-map group; after normalisation its templates are few beside its queries, and it needs their counts on at most
``max_minutes`` minutes only.  ``similarities`` and ``threshold_components`` are the distributed counterparts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import shared_checkpoints
from ..functions.numeric import EPSILON, cosine

DAY = 1440


def _cos(x: np.ndarray, y: np.ndarray) -> float:
    return float(x @ y) / (np.sqrt(float(x @ x) * float(y @ y)) + EPSILON)


def day_step(x: np.ndarray, active: np.ndarray, assigned: np.ndarray, next_id: int, rho: float) -> int:
    """Reassigns rows of x in order, in place (-1: none), then merges clusters; returns the next free id.

    A centre is the sum of its members' rows.  active: rows that a new template needs before it is assigned."""
    centres: dict[int, np.ndarray] = {}
    size: dict[int, int] = {}
    for c in np.unique(assigned[assigned >= 0]):
        centres[int(c)] = x[assigned == c].sum(axis=0)
        size[int(c)] = int((assigned == c).sum())
    names = sorted(centres)
    snapshot = np.stack([centres[c] / (np.linalg.norm(centres[c]) or 1) for c in names]) if names else None
    for t, row in enumerate(x):
        c = int(assigned[t])
        if c >= 0:
            if size[c] == 1 or _cos(row, centres[c]) > rho:
                continue
            centres[c] = centres[c] - row
            size[c] -= 1
            assigned[t] = -1
        elif not active[t]:
            continue
        if snapshot is not None:
            best = names[int(np.argmax(snapshot @ row))]
        else:
            best = max(centres, key=lambda k: (_cos(row, centres[k]), -k), default=None)
        if best is not None and size[best] > 0 and _cos(row, centres[best]) > rho:
            centres[best] = centres[best] + row
            size[best] += 1
            assigned[t] = best
        else:
            centres[next_id], size[next_id], assigned[t] = row.copy(), 1, next_id
            next_id += 1
    root = {c: c for c in centres if size[c] > 0}

    def find(c: int) -> int:
        while root[c] != c:
            c = root[c]
        return c

    for c in sorted(root):
        mine = find(c)
        others = sorted({find(o) for o in root} - {mine})
        if others:
            near = max(others, key=lambda o: (_cos(centres[mine], centres[o]), -o))
            if _cos(centres[mine], centres[near]) > rho:
                root[mine] = near
                centres[near] = centres[near] + centres[mine]
    for t in np.flatnonzero(assigned >= 0):
        assigned[t] = find(int(assigned[t]))
    return next_id


def _online(frame: pd.DataFrame, rho: float, lookback: int, max_minutes: int, seed: int) -> pd.DataFrame:
    minutes = frame["ts"].to_numpy().astype("datetime64[m]").astype(np.int64)
    counts = frame["cnt"].to_numpy().astype(float)
    names, template = np.unique(frame["template"].to_numpy().astype(str), return_inverse=True)
    first = int(minutes.min())
    assigned, next_id, rows = np.full(len(names), -1), 0, []
    rng = np.random.default_rng(seed)
    for day in range((int(minutes.max()) - first + 1) // DAY + 1):
        end = first + day * DAY
        if day:
            begin = max(first, end - lookback * DAY)
            grid = np.arange(begin, end)
            if len(grid) > max_minutes:
                grid = np.sort(rng.choice(grid, max_minutes, replace=False))
            inside = (minutes >= begin) & (minutes < end)
            at = np.searchsorted(grid, minutes[inside])
            hit = (at < len(grid)) & (grid[np.minimum(at, len(grid) - 1)] == minutes[inside])
            x = np.zeros((len(names), len(grid)))
            np.add.at(x, (template[inside][hit], at[hit]), counts[inside][hit])
            active = np.zeros(len(names), bool)
            active[template[(minutes >= end - DAY) & (minutes <= end)]] = True
            next_id = day_step(x, active, assigned, next_id, rho)
        rows.append(pd.DataFrame({"as_of": np.full(len(names), np.datetime64(end, "m").astype("datetime64[ns]")), "template": names, "cluster": assigned.astype(np.int32)}))
    return pd.concat(rows)


def online(counts: DataFrame, rho: float = 0.8, lookback_days: int = 30, max_minutes: int = 10_000, seed: int = 0, key: str = "project") -> DataFrame:
    """(key, as_of, template, cluster): assignments at the end of each whole day; -1 means none, as on the first date."""

    def run(k: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = _online(frame, rho, lookback_days, max_minutes, seed)
        out.insert(0, key, k[0])
        return out

    return counts.select(key, "template", "ts", "cnt").groupBy(key).applyInPandas(run, f"{key} string, as_of timestamp_ntz, template string, cluster int")


def online_logical(arrivals: DataFrame, vectors: DataFrame, rho: float = 0.8, key: str = "project") -> DataFrame:
    """The same on fixed vectors: arrivals(key, template, as_of) says from when a template counts, vectors(key, template,
    vector) what it is.  (key, as_of, template, cluster)."""
    both = arrivals.join(vectors, [key, "template"]).select(key, "template", "as_of", "vector")

    def run(k: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("template")
        x = np.array(frame["vector"].tolist(), float)
        since = frame["as_of"].to_numpy()
        assigned, next_id, rows = np.full(len(frame), -1), 0, []
        for date in np.unique(since):
            next_id = day_step(x, since <= date, assigned, next_id, rho)
            rows.append(pd.DataFrame({key: k[0], "as_of": date, "template": frame["template"].to_numpy(), "cluster": assigned.astype(np.int32)}))
        return pd.concat(rows)

    return both.groupBy(key).applyInPandas(run, f"{key} string, as_of timestamp_ntz, template string, cluster int")


def similarities(series: DataFrame, centres: DataFrame, key: str = "template", centre: str = "cluster") -> DataFrame:
    """(key, centre, cos) of every series with each centre that it shares a time with; the others' cosine is 0."""
    norm = lambda df, k: df.groupBy(k).agg(F.sum(F.col("cnt").cast("double") * F.col("cnt")).alias(f"n_{k}"))
    other = centres.select(centre, "ts", F.col("cnt").alias("c"))
    dots = series.join(other, "ts").groupBy(key, centre).agg(F.sum(F.col("cnt").cast("double") * F.col("c")).alias("d"))
    return dots.join(norm(series, key), key).join(norm(centres, centre), centre).select(key, centre, cosine(F.col("d"), F.col(f"n_{key}"), F.col(f"n_{centre}")).alias("cos"))


def nearest(similar: DataFrame, key: str = "template", centre: str = "cluster") -> DataFrame:
    """(key, centre, cos) of the most similar centre; of equal ones the first."""
    over = Window.partitionBy(key).orderBy(F.desc("cos"), centre)
    return similar.withColumn("_n", F.row_number().over(over)).filter("_n = 1").drop("_n")


def threshold_components(similar: DataFrame, rho: float, left: str, right: str) -> DataFrame:
    """(node, component) of the graph of pairs with cos > rho; a component's name is its smallest node.

    Each round takes the smallest label around a node and jumps to the label's own label, so that rounds grow with the
    logarithm of a component's diameter; they go on until nothing changes."""
    shared_checkpoints(similar.sparkSession)
    pairs = similar.filter(F.col("cos") > rho).select(F.col(left).alias("a"), F.col(right).alias("b"))
    nodes = similar.select(F.col(left).alias("node")).union(similar.select(F.col(right))).distinct()
    edges = pairs.union(pairs.select("b", "a")).union(nodes.select("node", "node")).distinct().checkpoint()
    labels = nodes.withColumn("component", F.col("node")).checkpoint()
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("component"))
        jump = near.alias("n").join(labels.alias("l"), F.col("n.component") == F.col("l.node")).select(F.col("n.a").alias("node"), F.col("l.component").alias("component"))
        after = jump.checkpoint()
        if after.exceptAll(labels).isEmpty():
            return labels
        labels = after
