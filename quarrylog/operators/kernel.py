"""Kernel regression of many rows on many rows, with what is far away summed up.

Training rows are parted by a k-d tree (``neighbours``), and each leaf's ball and sums are known.  For a test row, a leaf's weights lie
between exp(-(distance + radius)) and exp(-(distance - radius)) of its centre; where they all together cannot change the weights' sum
by more than a share of it, the leaf counts with its centre's weight.  The other leaves are summed row by row, in pairs of
blocks.  The driver has a sample, the tree and a row a leaf."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import shared_checkpoints
from ..ordering import bounded_sample
from .neighbours import SAMPLE, Tree, fitted_tree, in_blocks, leaves_for, matrix_of

#: Pairs of a test and a training row whose weights are in memory at once.
PAIRS = 1 << 20


def _leaves_of(tree: Tree) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column("v"))
                leaf = tree.leaf_of(x)
                away = np.sqrt(((x - tree.centres[leaf]) ** 2).sum(axis=1))
                yield pa.record_batch({"v": batch.column("v"), "y": batch.column("y"), "leaf": pa.array(leaf.astype(np.int32)), "away": pa.array(away)})

    return run


def _near_and_far(tree: Tree, radius: np.ndarray, n: np.ndarray, sums: np.ndarray, tolerance: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each near leaf, and one with leaf -1 and the sums of the far ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of(batch.column("v"))
            d = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (tree.centres**2).sum(axis=1) - 2 * x @ tree.centres.T, 0))
            low, high = n * np.exp(-(d + radius)), n * np.exp(-np.maximum(d - radius, 0))
            # the leaves with the least to lose, as many as may be off together
            off = high - low
            order = np.argsort(off, axis=1, kind="stable")
            allowed = tolerance * low.sum(axis=1, keepdims=True)
            far = np.zeros(off.shape, bool)
            np.put_along_axis(far, order, np.cumsum(np.take_along_axis(off, order, axis=1), axis=1) <= allowed, axis=1)
            weight = np.where(far, np.exp(-d), 0)
            row, leaf = np.nonzero(~far & (n > 0))
            some = np.flatnonzero(far.any(axis=1))
            at = pa.array(np.r_[row, some])
            zeros = np.zeros(len(row))
            yield pa.record_batch({"id": batch.column("id").take(at), "v": batch.column("v").take(at), "leaf": pa.array(np.r_[leaf, np.full(len(some), -1)].astype(np.int32)), "w": pa.array(np.r_[zeros, (weight * n).sum(axis=1)[some]]), "wy": pa.array(np.r_[zeros, (weight * sums).sum(axis=1)[some]])})

    return run


def _summed(asked: pa.Table, rows: pa.Table) -> pa.Table:
    """Sums of weights over one block for each test row of another."""
    z, x, y = matrix_of(asked.column("v")), matrix_of(rows.column("v")), rows.column("y").to_numpy()
    w, wy = np.zeros(len(z)), np.zeros(len(z))
    step = max(1, PAIRS // max(len(x), 1))
    for a in range(0, len(z) if len(x) else 0, step):
        # differences, as distances near 0 matter most
        d = np.zeros((len(z[a : a + step]), len(x)))
        for k in range(x.shape[1]):
            d += (z[a : a + step, k, None] - x[:, k]) ** 2
        part = np.exp(-np.sqrt(d))
        w[a : a + step], wy[a : a + step] = part.sum(axis=1), part @ y
    return pa.table({"id": asked.column("id"), "w": pa.array(w), "wy": pa.array(wy)})


def near_pairs(train: DataFrame, test: DataFrame, dims: int, test_id: str = "id", tolerance: float = 1e-9, leaves: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(asked, placed, balls): asked(id, v, leaf, w, wy) has a row for each test row and leaf to sum in full, and the sums of the other
    leaves (leaf -1); placed(v, y, leaf) the training rows.  None without training rows."""
    shared_checkpoints(train.sparkSession)
    both = train.select("x").union(test.select("x"))
    spread = both.agg(*[F.var_samp(F.get("x", F.lit(k))).alias(f"v{k}") for k in range(dims)]).first()
    scale = [float(np.sqrt(v)) if v else float("inf") for v in spread]
    scaled = F.array(*[F.get("x", F.lit(k)).cast("double") / F.lit(s) for k, s in enumerate(scale)])
    rows = train.select(scaled.alias("v"), F.col("y").cast("double").alias("y"))
    few, total = bounded_sample(rows, SAMPLE, F.xxhash64("v", "y"))
    sample = few.select("v").collect()
    if not sample:
        return None
    if leaves is None:
        leaves = leaves_for(total)
    tree = fitted_tree(np.array([r.v for r in sample], float), leaves)
    placed = rows.mapInArrow(_leaves_of(tree), "v array<double>, y double, leaf int, away double").checkpoint()
    balls = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.max("away").alias("away"), F.sum("y").alias("y")).checkpoint()
    radius, n, sums = np.zeros(leaves), np.zeros(leaves), np.zeros(leaves)
    for r in balls.collect():
        radius[r.leaf], n[r.leaf], sums[r.leaf] = r.away, r.n, r.y
    kind = test.schema[test_id].dataType.simpleString()
    given = test.select(F.col(test_id).alias("id"), scaled.alias("v"))
    asked = given.mapInArrow(_near_and_far(tree, radius, n, sums, tolerance), f"id {kind}, v array<double>, leaf int, w double, wy double").checkpoint()
    return asked, placed, balls.select("leaf", "n")


def kernel_regression(train: DataFrame, test: DataFrame, dims: int, test_id: str = "id", tolerance: float = 1e-9, leaves: int | None = None) -> DataFrame:
    """(test_id, predicted): the mean of y over all rows of train(x, y), weighted by exp(-d) with d the Euclidean distance of x in units of
    the standard deviations of both sets together.

    The weights' sum is within a share ``tolerance`` of the exact one, so that predictions are within 2 * tolerance * max |y|.  Ids
    are unique; null where all weights are 0."""
    kind = test.schema[test_id].dataType.simpleString()
    found = near_pairs(train, test, dims, test_id, tolerance, leaves)
    if found is None:
        return test.select(test_id, F.lit(None).cast("double").alias("predicted"))
    asked, placed, balls = found
    near = in_blocks(asked.filter("leaf >= 0").select("id", "v", "leaf"), placed, balls, "y").applyInArrow(_summed, f"id {kind}, w double, wy double")
    sums = near.union(asked.filter("leaf < 0").select("id", "w", "wy"))
    return sums.groupBy(F.col("id").alias(test_id)).agg(F.try_divide(F.sum("wy"), F.sum("w")).alias("predicted"))
