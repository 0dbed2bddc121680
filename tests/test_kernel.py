import numpy as np
import pytest

from quarrylog.operators import kernel, neighbours


def _frames(spark, x, y, z):
    train = spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double").repartition(4)
    return train, spark.createDataFrame([(f"t{i}", list(map(float, a))) for i, a in enumerate(z)], "id string, x array<double>")


def _exact(x, y, z):
    variance = np.var(np.concatenate([x, z]), axis=0, ddof=1)
    variance[variance == 0] = np.inf
    w = np.exp(-np.sqrt((((x[None] - z[:, None]) ** 2) / variance).sum(-1)))
    return w @ y / w.sum(axis=1)


@pytest.mark.parametrize(("blocks", "leaves"), [((8192, 1024), None), ((7, 2), 8), ((8192, 1024), 1)])
def test_kernel_regression_is_the_weighted_mean(spark, blocks, leaves, monkeypatch):
    monkeypatch.setattr(neighbours, "VECTOR_BLOCK", blocks[0])
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", blocks[1])
    monkeypatch.setattr(kernel, "PAIRS", 10 if blocks[0] == 7 else 1 << 20)
    rng = np.random.default_rng(7)
    x, y, z = rng.random((50, 3)), rng.random(50), rng.random((9, 3))
    x[:, 1] = z[:, 1] = 4.0  # a dimension without spread says nothing
    z[0] = x[0]
    found = {r.id: r.predicted for r in kernel.kernel_regression(*_frames(spark, x, y, z), 3, leaves=leaves).collect()}
    assert np.allclose([found[f"t{i}"] for i in range(9)], _exact(x, y, z), atol=1e-9)


def test_far_leaves_are_summed_up_within_the_bound(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((12, 2)) * 40
    x = centres[rng.integers(12, size=3000)] + 0.02 * rng.standard_normal((3000, 2))
    y = 10 * rng.standard_normal(3000) + x[:, 0]
    z = x[::30] + 0.01
    train, test = _frames(spark, x, y, z)
    exact = _exact(x, y, z)
    rows = {}
    for tolerance in (1e-12, 1e-2, 0.1):
        asked, _, balls = kernel.near_pairs(train, test, 2, tolerance=tolerance, leaves=64)
        sizes = {r.leaf: r.n for r in balls.collect()}
        rows[tolerance] = sum(sizes[r.leaf] for r in asked.filter("leaf >= 0").select("leaf").collect())
        found = {r.id: r.predicted for r in kernel.kernel_regression(train, test, 2, tolerance=tolerance, leaves=64).collect()}
        assert np.abs([found[f"t{i}"] - exact[i] for i in range(100)]).max() <= 2 * tolerance * np.abs(y).max() + 1e-9
    assert rows[1e-12] <= 3000 * 100 and rows[0.1] < 0.2 * 3000 * 100


def test_nothing_to_learn_or_to_ask(spark):
    train, test = _frames(spark, np.ones((3, 2)), np.arange(3.0), np.zeros((2, 2)))
    assert [r.predicted for r in kernel.kernel_regression(train.filter("y > 9"), test, 2).collect()] == [None, None]
    assert kernel.kernel_regression(train, test.filter("id = 'none'"), 2).collect() == []
