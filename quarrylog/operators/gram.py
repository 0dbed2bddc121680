"""Regressions and singular vectors from sums over rows.

Tasks add up products of the arrays of their rows with numpy, Spark adds up what tasks hand on, and only a matrix that is as
large as an array is squared is solved, one task for each key.  Nothing depends on how many rows there are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers that a task holds in its sums before it hands them on.
HELD = 1 << 22


def _arrays(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _numbered_keys(batch: pa.RecordBatch, key: tuple[str, ...]) -> tuple[list[tuple], np.ndarray]:
    rows = list(zip(*[batch.column(k).to_pylist() for k in key], strict=True)) if key else [()] * batch.num_rows
    known: dict[tuple, int] = {}
    number = np.array([known.setdefault(r, len(known)) for r in rows])
    return list(known), number


def products(rows: DataFrame, x: str, y: str | None = None, *key: str) -> DataFrame:
    """(key, i, j, v): the sums over a key's rows of x[i] * z[j], where z is x followed by y.  All arrays of a column have one length
    and no nulls; x alone gives a Gram matrix."""
    given = rows.select(*key, F.col(x).cast("array<double>").alias("_x"), (F.concat(x, y) if y else F.col(x)).cast("array<double>").alias("_z"))
    kinds = [f"`{k}` {given.schema[k].dataType.simpleString()}" for k in key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for k, m in sums.items():
                i, j = np.indices(m.shape)
                names = {n: pa.array([v] * m.size, kept[n]) for n, v in zip(key, k, strict=True)}
                yield pa.record_batch({**names, "i": pa.array(i.ravel().astype(np.int32)), "j": pa.array(j.ravel().astype(np.int32)), "v": pa.array(m.ravel())})
            sums.clear()

        kept: dict[str, pa.DataType] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            kept = {n: batch.schema.field(n).type for n in key}
            a, z = _arrays(batch.column("_x")), _arrays(batch.column("_z"))
            names, number = _numbered_keys(batch, key)
            for n, k in enumerate(names):
                part = a[number == n].T @ z[number == n]
                sums[k] = sums[k] + part if k in sums else part
                if sum(m.size for m in sums.values()) > HELD:
                    yield from handed()
        yield from handed()

    return given.mapInArrow(run, ", ".join([*kinds, "i int", "j int", "v double"])).groupBy(*key, "i", "j").agg(F.sum("v").alias("v"))


def solved(sums: DataFrame, how: Callable[[np.ndarray], np.ndarray], *key: str) -> DataFrame:
    """(key, matrix): what ``how`` makes of the matrix of each key's sums(key, i, j, v); a matrix is an array of its rows."""
    kinds = [f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in key]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((int(frame["i"].max()) + 1, int(frame["j"].max()) + 1))
        m[frame["i"], frame["j"]] = frame["v"]
        return pd.DataFrame({**{k: frame[k].iloc[:1] for k in key}, "matrix": [how(m).tolist()]})

    return sums.groupBy(*key).applyInPandas(run, ", ".join([*kinds, "matrix array<array<double>>"]))


def ridge_solution(m: np.ndarray, weight: float) -> np.ndarray:
    """A row for each target of (x'x + weight)^-1 x'y, from x'x and x'y side by side."""
    d = len(m)
    return np.linalg.solve(m[:, :d] + weight * np.eye(d), m[:, d:]).T


def ridge(rows: DataFrame, x: str, y: str, weight: float, *key: str) -> DataFrame:
    """(key, matrix): the ridge regression of the array y on the array x without intercept, a row of weights for each target."""
    return solved(products(rows, x, y, *key), lambda m: ridge_solution(m, weight), *key)


def two_stage_solution(m: np.ndarray, past: int, future: int, weight: float) -> np.ndarray:
    """From the Gram matrix of (past, future, extended): future and extended are regressed on past, and then what this makes of
    extended on what it makes of future; a row for each entry of extended."""
    pp = m[:past, :past]
    first = np.linalg.solve(pp + weight * np.eye(past), m[:past, past:])
    f, e = first[:, :future], first[:, future:]
    return np.linalg.solve(f.T @ pp @ f + weight * np.eye(future), f.T @ pp @ e).T


def two_stage(rows: DataFrame, past: str, future: str, extended: str, weight: float, *key: str) -> DataFrame:
    """(key, matrix): the two-stage regression of extended on future with past as the instrument.  One pass: both stages are functions of
    the sums of products of the three arrays."""
    sizes = rows.select(F.size(past).alias("p"), F.size(future).alias("f")).first()
    p, f = (sizes.p, sizes.f) if sizes else (0, 0)
    joined = rows.select(*key, F.concat(past, future, extended).alias("_all"))
    return solved(products(joined, "_all", None, *key), lambda m: two_stage_solution(m, p, f, weight), *key)


def singular_vectors(rows: DataFrame, x: str, k: int, spare: int = 8, rounds: int = 6, seed: int = 0) -> DataFrame:
    """(rank, value, vector): the k largest singular values of the matrix whose rows are the arrays x, and its right singular vectors.

    A random basis of k + spare vectors is multiplied by x'x again and again: each round is a pass in which tasks hand on
    d x (k + spare) sums, and no d x d matrix is made.  The basis goes to the tasks with the function, and is as large as those
    sums.  Vectors have their largest entry, whatever its sign, above 0."""
    spark = rows.sparkSession
    given = rows.select(F.col(x).cast("array<double>").alias("_x"))
    first = given.first()
    schema = "rank int, value double, vector array<double>"
    if first is None:
        return spark.createDataFrame([], schema)
    d = len(first["_x"])
    width = min(d, k + spare)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]

    def multiplied(q: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(q.shape)
            for batch in batches:
                if batch.num_rows:
                    a = _arrays(batch.column("_x"))
                    total += a.T @ (a @ q)
            i, j = np.indices(total.shape)
            yield pa.record_batch({"i": pa.array(i.ravel()), "j": pa.array(j.ravel()), "v": pa.array(total.ravel())})

        out = np.zeros(q.shape)
        for r in given.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            out[r.i, r.j] = r.v
        return out

    for _ in range(rounds if width < d else 0):
        basis = np.linalg.qr(multiplied(basis))[0]
    values, inner = np.linalg.eigh(basis.T @ multiplied(basis))
    order = np.argsort(-values)[:k]
    vectors = (basis @ inner[:, order]).T
    vectors *= np.sign(vectors[np.arange(len(order)), np.abs(vectors).argmax(axis=1)])[:, None]
    return spark.createDataFrame([(n + 1, float(np.sqrt(max(values[i], 0.0))), v.tolist()) for n, (i, v) in enumerate(zip(order, vectors, strict=True))], schema)
