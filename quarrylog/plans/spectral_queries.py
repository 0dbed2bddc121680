"""Queries about features, products, singular values and regressions of windows of series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import gram, series
from . import fixtures as X

_OMEGA, _PHASE = arrays.frequencies(11, 4, 1e-5, seed=7)
_WEIGHT = 0.5


def _windows(spark, sf):
    """(cluster, ts, stack): eleven hours around each hour."""
    return series.shifts(X.hourly(spark, sf), 5, 5, "cluster").select("cluster", "ts", F.transform("stack", lambda v: v.cast("double")).alias("stack"))


def fourier_features(spark, sf):
    made = _windows(spark, sf).withColumn("f", arrays.fourier(F.col("stack"), _OMEGA, _PHASE))
    return made.select("cluster", "ts", *[F.round(F.get("f", F.lit(k)), 6).alias(f"f{k + 1}") for k in range(4)])


def kronecker_columns(spark, sf):
    made = _windows(spark, sf).withColumn("k", arrays.kronecker(F.slice("stack", 1, 2), F.slice("stack", 9, 3)))
    return made.select("cluster", "ts", F.array_join(F.transform("k", lambda v: v.cast("long").cast("string")), ",").alias("k"))


def singular_values(spark, sf):
    return gram.singular_vectors(_windows(spark, sf), "stack", 3).select("rank", F.round(F.col("value"), 4).alias("value"))


def two_stage_regression(spark, sf):
    parts = _windows(spark, sf).select("cluster", F.slice("stack", 4, 2).alias("past"), F.slice("stack", 6, 2).alias("future"), F.slice("stack", 8, 2).alias("extended"))
    found = gram.two_stage(parts, "past", "future", "extended", _WEIGHT, "cluster")
    entry = lambda i, j: F.round(F.get(F.get(F.col("matrix"), F.lit(i)), F.lit(j)), 6).alias(f"w{i + 1}{j + 1}")
    return found.select("cluster", *[entry(i, j) for i in (0, 1) for j in (0, 1)])


_STACK = f"""{X.HOURLY}, windows AS (SELECT cluster, ts, CAST(x AS DOUBLE[]) AS x FROM (SELECT cluster, ts, list(cnt) OVER (PARTITION BY cluster ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS x FROM hourly) WHERE len(x) = 11)"""
_FOURIER = ", ".join(f"round(sqrt(CAST(0.5 AS DOUBLE)) * cos(list_dot_product(x, {[float(v) for v in row]}::DOUBLE[]) + {float(p)!r}::DOUBLE), 6) AS f{k + 1}" for k, (row, p) in enumerate(zip(_OMEGA, _PHASE, strict=True)))

#: All eigenvalues of the windows' products, by rotations that make one entry zero after the other.
_SINGULAR = f"""WITH RECURSIVE {_STACK},
  entries AS (SELECT i, j, sum(x[CAST(i AS BIGINT)] * x[CAST(j AS BIGINT)]) AS v FROM windows, range(1, 12) AS a(i), range(1, 12) AS b(j) GROUP BY ALL),
  matrix AS (SELECT list(row ORDER BY i) AS a FROM (SELECT i, list(v ORDER BY j) AS row FROM entries GROUP BY i)),
  pairs AS (SELECT list({{'p': i, 'q': j}} ORDER BY i, j) AS pq FROM range(1, 12) AS a(i), range(1, 12) AS b(j) WHERE i < j),
  turns AS (SELECT 0 AS step, a FROM matrix
    UNION ALL SELECT step + 1, list_transform(b, lambda r, i: CASE WHEN i = p THEN list_transform(r, lambda v, j: c * v - s * b[q][j]) WHEN i = q THEN list_transform(r, lambda v, j: s * b[p][j] + c * v) ELSE r END)
    FROM (SELECT step, p, q, c, s, list_transform(a, lambda r: list_transform(r, lambda v, j: CASE WHEN j = p THEN c * v - s * r[q] WHEN j = q THEN s * r[p] + c * v ELSE v END)) AS b
    FROM (SELECT step, a, p, q, 1 / sqrt(1 + t * t) AS c, t / sqrt(1 + t * t) AS s
    FROM (SELECT step, a, p, q, CASE WHEN a[p][q] = 0 THEN 0 ELSE CASE WHEN tau < 0 THEN -1 ELSE 1 END / (abs(tau) + sqrt(1 + tau * tau)) END AS t
    FROM (SELECT step, a, p, q, (a[q][q] - a[p][p]) / (2 * a[p][q]) AS tau FROM (SELECT step, a, pq[step % 55 + 1].p AS p, pq[step % 55 + 1].q AS q FROM turns, pairs WHERE step < 550))))))
SELECT CAST(row_number() OVER (ORDER BY e DESC) AS INTEGER) AS rank, round(sqrt(e), 4) AS value FROM (SELECT unnest(list_transform(a, lambda r, i: r[i])) AS e FROM turns WHERE step = 550) QUALIFY rank <= 3"""

_SUMS = ", ".join(f"sum(x[{4 + i}] * x[{4 + j}]) AS g{i}{j}" for i in range(6) for j in range(i, 6))
#: Both stages with inverses of two by two matrices written out.
_TWO_STAGE = f"""WITH {_STACK}, g AS (SELECT cluster, {_SUMS} FROM windows GROUP BY cluster),
  a AS (SELECT *, g00 + {_WEIGHT} AS a, g11 + {_WEIGHT} AS d, (g00 + {_WEIGHT}) * (g11 + {_WEIGHT}) - g01 * g01 AS det FROM g),
  w AS (SELECT *, {", ".join(f"(d * g0{t} - g01 * g1{t}) / det AS u{t}, (a * g1{t} - g01 * g0{t}) / det AS v{t}" for t in range(2, 6))} FROM a),
  b AS (SELECT *, {", ".join(f"u{s} * (g00 * u{t} + g01 * v{t}) + v{s} * (g01 * u{t} + g11 * v{t}) AS h{s}{t}" for s in (2, 3) for t in range(2, 6))} FROM w),
  c AS (SELECT *, h22 + {_WEIGHT} AS e, h33 + {_WEIGHT} AS f, (h22 + {_WEIGHT}) * (h33 + {_WEIGHT}) - h23 * h32 AS det2 FROM b)
SELECT cluster, {", ".join(f"round((f * h2{t} - h23 * h3{t}) / det2, 6) AS w{t - 3}1, round((e * h3{t} - h32 * h2{t}) / det2, 6) AS w{t - 3}2" for t in (4, 5))} FROM c"""

QUERIES = {
    "fourier_features": (fourier_features, f"WITH {_STACK} SELECT cluster, ts, {_FOURIER} FROM windows"),
    "kronecker_columns": (kronecker_columns, f"WITH {_STACK} SELECT cluster, ts, array_to_string(flatten(list_transform(x[1:2], lambda a: list_transform(x[9:11], lambda b: CAST(a * b AS BIGINT)))), ',') AS k FROM windows"),
    "singular_values": (singular_values, _SINGULAR),
    "two_stage_regression": (two_stage_regression, _TWO_STAGE),
}
