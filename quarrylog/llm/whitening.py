"""Whitening of embeddings: covariance by sums of centred products, components by LAPACK.

Entries become whole numbers x = floor(SCALE * c) + SHIFT.  A first aggregation counts vectors and adds up each dimension; a
second one has a generated sum of products for each pair of dimensions of the upper triangle, in groups by the first of them.
Products are of what is centred at the dimension's mean, rounded to a whole number; the rest of the mean is taken off the
sums.  The driver gets these sums, some d * (d + 1) / 2 numbers whatever the rows, and decomposes them (``numpy.linalg.eigh``,
LAPACK's syevd).  Projections are generated expressions again.  No row is shuffled; each pass reads the vectors once.

Defined results: vectors that are null, or hold null or non-finite entries, or none, are left out; so are vectors of another
length than most have (of equally frequent lengths the longest counts).  Entries beyond 2 ** 52 / SCALE count as that.  A component
without variance has no whitening and is left out, and with it all components of a table of equal vectors.  A deviation beyond
a long is null.  Rows without an id, repeated rows and rows with one id are rows like any others; an empty table gives
no rows; further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

COMPONENTS = 8
# How entries become whole numbers.
SCALE, SHIFT = 1024, 100_000
#: Dimensions that a dimension meets in one group of sums.
BLOCK = 32
LARGEST = float(1 << 52)


@dataclass
class Whitening:
    """What is fitted: vectors, their length, sums by dimension, covariance; eigenvalues and unit components, largest first."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    components: np.ndarray

    @property
    def rank(self) -> int:
        """Components with variance, beyond the decomposition's rounding."""
        least = self.values[0] * len(self.values) * np.finfo(float).eps if len(self.values) else 0.0
        return int((self.values > least).sum())


def _finite(vector: str) -> Column:
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, odd)


def scaled(vectors: DataFrame, vector: str, row_id: str) -> DataFrame:
    """(vec_id, x): the vectors that count, in whole numbers, all of one length."""
    given = vectors.select(F.col(row_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(_finite("v"))
    # as many rows as lengths
    length = given.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    whole = lambda v: F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), v * SCALE))).cast("long") + SHIFT
    return given.filter(F.size("v") == (length.d if length else -1)).select("vec_id", F.transform("v", whole).alias("x"))


def _sums(x: DataFrame, d: int) -> tuple[int, list[int]]:
    row = x.agg(F.count("*"), *[F.sum(F.get("x", F.lit(i)).cast("decimal(20,0)")) for i in range(d)]).first()
    return row[0], [int(s or 0) for s in row[1:]]


def _covariance(centred: DataFrame, rest: np.ndarray, n: int) -> np.ndarray:
    """The covariance of centred(y), arrays that are centred up to ``rest``, the means of what they have now.

    One aggregation: a group for each dimension i and block of dimensions up to the upper triangle's end, with a generated
    sum of products for each dimension of the block, few enough to be compiled whatever the length.  Rows are not copied; a task
    hands on a row a group."""
    d = len(rest)
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(d) for j in range(i // BLOCK * BLOCK, d, BLOCK)])
    dealt = centred.select("y", F.explode(pairs).alias("p")).select("y", "p.i", "p.j")
    sums = dealt.groupBy("i", "j").agg(*[F.expr(f"sum(get(y, i) * get(y, j + {k})) AS s{k}") for k in range(BLOCK)])
    out = np.zeros((d, d))
    for row in sums.collect():
        for j in range(max(row.i, row.j), min(row.j + BLOCK, d)):
            out[row.i, j] = out[j, row.i] = row[f"s{j - row.j}"] / n - rest[row.i] * rest[j]
    return out


def fitted(x: DataFrame) -> Whitening:
    """The whitening of x(vec_id, x)."""
    first = x.select(F.size("x").alias("d")).first()
    if first is None:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)))
    n, sums = _sums(x, first.d)
    near = [(2 * s + n) // (2 * n) for s in sums]
    rest = np.array([(s - n * m) / n for s, m in zip(sums, near, strict=True)])
    centred = x.selectExpr(f"array({', '.join(f'CAST(x[{i}] - {m}L AS DOUBLE)' for i, m in enumerate(near))}) AS y")
    covariance = _covariance(centred, rest, n)
    values, vectors = np.linalg.eigh(covariance)
    return Whitening(n, sums, covariance, values[::-1], vectors[:, ::-1])


def whitened(x: DataFrame, fit: Whitening, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, deviation, w1, w2, ...) of x(vec_id, x): the sum over dimensions of (n * x - S) ** 2, exact (null beyond a long), and
    what is centred projected on each component, over the square root of its eigenvalue."""
    count = min(components, fit.rank)
    near = [(2 * s + fit.n) // (2 * fit.n) for s in fit.sums]
    rest = [s - fit.n * m for s, m in zip(fit.sums, near, strict=True)]
    # n * x - S = n * y - rest with y = x - near, of which the squares are summed
    y = [f"(x[{i}] - {m}L)" for i, m in enumerate(near)]
    added = lambda terms: terms[0] if len(terms) == 1 else f"try_add({added(terms[: len(terms) // 2])}, {added(terms[len(terms) // 2 :])})"
    squares = added([f"try_multiply({a}, {a})" for a in y]) if y else "0L"
    crossed = added([f"try_multiply({a}, {r}L)" for a, r in zip(y, rest, strict=True)]) if y else "0L"
    whole = lambda c: f"CAST({c} AS DECIMAL(38,0))"
    terms = f"try_add(try_subtract(try_multiply({whole(fit.n**2)}, {whole('squares')}), try_multiply({whole(2 * fit.n)}, {whole('crossed')})), {whole(sum(r * r for r in rest))})"
    axes = (fit.components[:, :count] / np.sqrt(fit.values[:count])).tolist()
    shifted = [f"({a} - {r / fit.n!r}D)" for a, r in zip(y, rest, strict=True)]
    projected = [" + ".join(f"{a} * {axes[i][k]!r}D" for i, a in enumerate(shifted)) + f" AS w{k + 1}" for k in range(count)]
    step = x.selectExpr("vec_id", f"{squares} AS squares", f"{crossed} AS crossed", *projected)
    return step.selectExpr("vec_id", f"try_cast({terms} AS BIGINT) AS deviation", *[f"w{k + 1}" for k in range(count)])


def identity_error(out: DataFrame, n: int) -> float:
    """The largest entry, whatever its sign, of the covariance of w1, w2, ... less the identity; each is centred first."""
    names = [c for c in out.columns if c.startswith("w")]
    if not names or not n:
        return 0.0
    means = np.array(out.agg(*[F.avg(c) for c in names]).first(), float)
    centred = out.selectExpr(f"array({', '.join(f'{c} - {m!r}D' for c, m in zip(names, means.tolist(), strict=True))}) AS y")
    return float(np.abs(_covariance(centred, np.zeros(len(names)), n) - np.eye(len(names))).max())


def whitening(vectors: DataFrame, vector: str = "embedding", row_id: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector that counts and component."""
    x = scaled(vectors, vector, row_id)
    fit = fitted(x)
    out = whitened(x, fit, components)
    count = len(out.columns) - 2
    kind = "array<struct<component:int,whitened:double,explained:double>>"
    share = [float(v / fit.values.sum()) for v in fit.values[:count]]
    rows = [F.struct(F.lit(k + 1).alias("component"), F.col(f"w{k + 1}").alias("whitened"), F.lit(share[k]).alias("explained")) for k in range(count)]
    listed = out.select("vec_id", "deviation", F.explode(F.array(*rows).cast(kind)).alias("r"))
    return listed.select("vec_id", "r.component", F.lit(fit.n).cast("long").alias("n"), "deviation", "r.whitened", "r.explained", F.lit(identity_error(out, fit.n)).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening(table(spark, sf_dir, "embeddings"))
