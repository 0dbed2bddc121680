import random

import numpy as np
import pytest

from quarrylog.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>"
COLUMNS = {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}


def _brute(vectors, components=8):
    """(deviations, eigenvalues, whitened) by their definitions, in exact sums and one dense decomposition."""
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    count = min(components, len(values))
    return deviations, values, centred @ axes[:, :count] / np.sqrt(values[:count])


def _check(rows, ids, vectors):
    deviations, values, z = _brute(vectors)
    k = z.shape[1]
    assert len(rows) == len(vectors) * k
    got = {(r.vec_id, r.component): r for r in rows}
    signs = np.sign([np.dot([got[i, c + 1].whitened for i in ids], z[:, c]) for c in range(k)])
    for i, d, w in zip(ids, deviations, z, strict=True):
        for c in range(k):
            r = got[i, c + 1]
            assert r.n == len(vectors) and r.deviation == d
            assert r.whitened == pytest.approx(signs[c] * w[c], abs=1e-8)
            assert r.explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
            assert 0 <= r.identity_error < 1e-9


@pytest.mark.parametrize("d", [1, 3, 12])
def test_against_definitions(spark, d, monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 5)  # several groups a dimension
    rng = np.random.default_rng(d)
    mixed = rng.normal(size=(200, d)) @ rng.normal(size=(d, d)) + rng.normal(size=d) * 3
    vectors = mixed.astype(np.float32).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), SCHEMA).repartition(5)
    out = W.whitening(df)
    assert dict(out.dtypes) == COLUMNS
    _check(out.collect(), range(200), vectors)


def test_what_does_not_count(spark):
    rng = random.Random(4)
    good = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(40)]
    bad = [None, [], [1.0, None, 2.0, 3.0], [1.0, float("nan"), 0.0, 0.0], [float("inf")] * 4, [0.0, float("-inf"), 0.0, 0.0], [1.0, 2.0], [1.0] * 5]
    rows = list(enumerate(good)) + [(1000 + i, v) for i, v in enumerate(bad)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], f"{SCHEMA}, x string, n int, component string")
    _check(W.whitening(df).collect(), range(40), good)


def test_repeated_rows_and_ids(spark):
    vectors = [[0.5, 1.0], [0.5, 1.0], [-0.25, 2.0], [3.0, -1.0]]
    df = spark.createDataFrame([(1, vectors[0]), (1, vectors[1]), (1, vectors[2]), (None, vectors[3])], SCHEMA)
    rows = W.whitening(df).collect()
    deviations, _, z = _brute(vectors)
    assert sorted(r.deviation for r in rows) == sorted(2 * deviations)
    assert sorted(abs(r.whitened) for r in rows) == pytest.approx(sorted(np.abs(z).ravel()))
    assert sum(r.vec_id is None for r in rows) == 2


def test_no_variance(spark):
    for vectors in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 5):
        out = W.whitening(spark.createDataFrame(list(enumerate(vectors)), SCHEMA))
        assert dict(out.dtypes) == COLUMNS and out.collect() == []
    # a dimension that repeats another one adds no component
    rows = W.whitening(spark.createDataFrame([(i, [float(i), float(i), float(i % 3)]) for i in range(9)], SCHEMA)).collect()
    assert {r.component for r in rows} == {1, 2} and all(r.identity_error < 1e-9 for r in rows)


def test_extreme_entries(spark):
    rows = [(i, [i / 7, 1.0]) for i in range(6)] + [(6, [3.4e38, -3.4e38])]
    out = W.whitening(spark.createDataFrame(rows, SCHEMA), components=1).collect()
    assert len(out) == 7 and all(np.isfinite(r.whitened) for r in out) and {r.deviation for r in out} == {None}


def test_deviations_of_many_vectors_are_exact(spark):
    fit = W.Whitening(10**7, [10**12 + 3, 10**12 - 1], np.eye(2), np.array([1.0, 1.0]), np.eye(2))
    x = spark.createDataFrame([(1, [100_500, 99_321]), (2, [100_000, 100_000])], "vec_id long, x array<long>")
    want = [sum((fit.n * c - s) ** 2 for c, s in zip(v, fit.sums, strict=True)) for v in ((100_500, 99_321), (100_000, 100_000))]
    assert [r.deviation for r in W.whitened(x, fit).orderBy("vec_id").collect()] == [w if w < 2**63 else None for w in want]
