"""Nearest vectors by cosine, through a tree of balls that Spark partitions the vectors by.

A k-d tree over unit vectors is fitted on a bounded sample; its leaves part all vectors, and each leaf's ball (its sample's
mean, and the largest distance of any of its vectors from it) bounds the cosine that a query can have in it.  A query
first looks into its own leaf, and then into every other leaf whose bound reaches the k-th cosine it has found, so that the result
is exact; with ``visits`` it looks into so many leaves only, those with the nearest means.

Leaves and the queries that visit them are cut into blocks, and a pair of blocks is what a task holds: neither a large leaf nor
one that all queries visit lands in one task.  The driver has the sample, the tree and a row a leaf."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from ..checkpoints import shared_checkpoints
from ..ordering import bounded_sample

#: Vectors that the tree is fitted on, and that one leaf has about; leaves at least, for tables that are small.
SAMPLE, LEAF_ROWS, LEAST_LEAVES = 8192, 20_000, 16
#: Vectors and queries that a task compares at once.
VECTOR_BLOCK, QUERY_BLOCK = 8192, 1024
#: Cosines are told apart by this; bounds reach as much further.
DIGITS, SLACK = 9, 2e-9


@dataclass(frozen=True)
class Tree:
    """Inner nodes in the order of a heap: a vector goes right where its entry of the dimension is above the cut.  centres: one
    for each leaf, from left to right."""

    dims: np.ndarray
    cuts: np.ndarray
    centres: np.ndarray

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        inner = len(self.dims)
        for _ in range((inner + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.dims[node]] > self.cuts[node])
        return node - inner


def fitted_tree(sample: np.ndarray, leaves: int) -> Tree:
    """A tree of ``leaves`` (a power of two) that halves the sample along the dimension in which it is spread most."""
    inner = leaves - 1
    dims, cuts = np.zeros(inner, np.int64), np.zeros(inner)
    parts = {0: sample}
    for node in range(inner):
        part = parts.pop(node)
        if len(part):
            dims[node] = np.argmax(part.var(axis=0))
            cuts[node] = np.median(part[:, dims[node]])
        right = part[:, dims[node]] > cuts[node]
        parts[2 * node + 1], parts[2 * node + 2] = part[~right], part[right]
    centres = [parts[inner + k].mean(axis=0) if len(parts[inner + k]) else np.zeros(sample.shape[1]) for k in range(leaves)]
    return Tree(dims, cuts, np.array(centres))


def leaves_for(rows: int) -> int:
    """A power of two: by the number of rows, within what the sample can tell apart."""
    return min(1 << int(np.ceil(np.log2(max(LEAST_LEAVES, rows / LEAF_ROWS)))), SAMPLE // 4)


def matrix_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equally long lists."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def units(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(length > 0, length, 1.0)


def _placed(tree: Tree) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = units(matrix_of(batch.column("v")))
                leaf = tree.leaf_of(x)
                away = np.sqrt(((x - tree.centres[leaf]) ** 2).sum(axis=1))
                unit = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.record_batch({"id": batch.column("id"), "v": unit, "leaf": pa.array(leaf.astype(np.int32)), "away": pa.array(away)})

    return run


def _visits(tree: Tree, radius: np.ndarray, visits: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The leaves that a query has to look into besides its own, which has given it the cosine to reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column("v"))
                bound = x @ tree.centres.T + np.sqrt((x * x).sum(axis=1, keepdims=True)) * radius
                bound[:, radius < 0] = -np.inf
                own = batch.column("leaf").to_numpy()
                bound[np.arange(len(x)), own] = -np.inf
                enough = bound >= batch.column("reached").to_numpy()[:, None] - SLACK
                if visits is not None:
                    length = np.linalg.norm(tree.centres, axis=1)
                    promise = np.where(enough, x @ tree.centres.T / np.where(length > 0, length, 1.0), -np.inf)
                    enough &= np.argsort(np.argsort(-promise, axis=1, kind="stable"), axis=1, kind="stable") < visits - 1
                row, leaf = np.nonzero(enough & np.isfinite(bound))
                yield pa.record_batch({"id": batch.column("id").take(pa.array(row)), "v": batch.column("v").take(pa.array(row)), "leaf": pa.array(leaf.astype(np.int32))})

    return run


def _best(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best vectors of one block for each query of another."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        names = vectors.column("id").combine_chunks()
        order = np.argsort(np.array(names.to_pylist()), kind="stable")
        names, asked = names.take(pa.array(order)), queries.column("id").combine_chunks()
        cos = matrix_of(queries.column("v")) @ matrix_of(vectors.column("v"))[order].T if len(order) and len(asked) else np.zeros((len(asked), len(order)))
        cos[np.array(asked.to_pylist())[:, None] == np.array(names.to_pylist())] = -np.inf
        # of equal ones the first by name, as the names are in order
        best = np.argsort(-np.round(cos, DIGITS), axis=1, kind="stable")[:, :k]
        score = np.take_along_axis(cos, best, axis=1)
        row, column = np.nonzero(np.isfinite(score))
        return pa.table({"query": asked.take(pa.array(row)), "vector": names.take(pa.array(best[row, column])), "cos": pa.array(score[row, column])})

    return run


def in_blocks(asked: DataFrame, placed: DataFrame, leaves: DataFrame, *more: str) -> PandasCogroupedOps:
    """Pairs of blocks of asked(id, v, leaf) and of placed(v, leaf, more) of the same leaf, for ``applyInArrow``.  leaves(leaf, n) has
    a row a leaf."""
    counted = asked.groupBy("leaf").agg(F.count("*").alias("q")).join(F.broadcast(leaves), "leaf")
    parts = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    # a row a leaf
    plan = F.broadcast(counted.select("leaf", parts("n", VECTOR_BLOCK).alias("_nv"), parts("q", QUERY_BLOCK).alias("_nq")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("_at"), F.col(n)).cast("int")
    q = asked.withColumn("_at", F.monotonically_increasing_id()).join(plan, "leaf").withColumn("_bq", mine("_nq")).withColumn("_bv", every("_nv"))
    v = placed.withColumn("_at", F.monotonically_increasing_id()).join(plan, "leaf").withColumn("_bv", mine("_nv")).withColumn("_bq", every("_nq"))
    block = ["leaf", "_bq", "_bv"]
    return q.select(*block, "id", "v").groupBy(*block).cogroup(v.select(*block, "v", *more).groupBy(*block))


def _compared(asked: DataFrame, placed: DataFrame, leaves: DataFrame, k: int) -> DataFrame:
    """(query, vector, cos): of asked(id, v, leaf), the best k of each block of the leaf."""
    kind = placed.schema["id"].dataType.simpleString()
    return in_blocks(asked, placed, leaves, "id").applyInArrow(_best(k), f"query {kind}, vector {kind}, cos double")


def _top(found: DataFrame, k: int) -> DataFrame:
    over = Window.partitionBy("query").orderBy(F.desc(F.round("cos", DIGITS)), "vector")
    return found.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= k)


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int = 1, query_id: str = "query_id", vector_id: str = "vector_id", vector: str = "vector", leaves: int | None = None, visits: int | None = None) -> DataFrame:
    """(query_id, vector_id, cos, rank): the k nearest of all vectors, but for the one of the same id, to each query.

    Ids are unique and of one type; vectors have one length; those of length 0 have a cosine of 0 with all, and nulls are left out.
    leaves: a power of two (default: by the number of vectors); visits: leaves that a query looks into at most (default: all
    that can have one of its k, which is exact)."""
    spark = queries.sparkSession
    shared_checkpoints(spark)
    of = lambda df, name: df.filter(F.col(vector).isNotNull()).select(F.col(name).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    given, against = of(queries, query_id), of(vectors, vector_id)
    few, total = bounded_sample(against, SAMPLE, F.xxhash64("id"), "id")
    sample = few.select("v").collect()
    renamed = lambda df: df.select(F.col("query").alias(query_id), F.col("vector").alias(vector_id), "cos", "rank")
    kind = against.schema["id"].dataType.simpleString()
    if not sample:
        return renamed(spark.createDataFrame([], f"query {kind}, vector {kind}, cos double, rank int"))
    if leaves is None:
        leaves = leaves_for(total)
    tree = fitted_tree(units(np.array([r.v for r in sample], float)), leaves)
    schema = f"id {kind}, v array<double>, leaf int, away double"
    placed = against.mapInArrow(_placed(tree), schema).checkpoint()
    balls = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.max("away").alias("away")).checkpoint()
    radius = np.full(leaves, -1.0)
    for r in balls.collect():
        radius[r.leaf] = r.away
    asked = given.mapInArrow(_placed(tree), schema).select("id", "v", "leaf").checkpoint()
    own = _top(_compared(asked, placed, balls, k), k).checkpoint()
    if visits == 1:
        return renamed(own)
    reached = own.groupBy("query").agg(F.when(F.count("*") == k, F.min("cos")).alias("reached"))
    # fewer than k so far: every leaf can have one
    waiting = asked.join(reached, asked["id"] == reached["query"], "left").select("id", "v", "leaf", F.coalesce("reached", F.lit(-4.0)).alias("reached"))
    others = waiting.mapInArrow(_visits(tree, radius, visits), f"id {kind}, v array<double>, leaf int").checkpoint()
    return renamed(_top(own.drop("rank").union(_compared(others, placed, balls, k)), k))
