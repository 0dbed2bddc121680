import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylog.functions import arrays
from quarrylog.operators import forecast, gram, linear
from quarrylog.sources import tables

T0 = dt.datetime(2024, 1, 1)


def _frame(spark, keys, x, y):
    rows = [(k, a.tolist(), b.tolist()) for k, a, b in zip(keys, x, y, strict=True)]
    return spark.createDataFrame(rows, "k string, x array<double>, y array<double>").repartition(6)


@pytest.mark.parametrize("held", [1 << 22, 10])
def test_ridge_by_key_is_the_closed_form(spark, held, monkeypatch):
    monkeypatch.setattr(gram, "HELD", held)
    rng = np.random.default_rng(1)
    keys = rng.choice(["a", "b", "hot"], 400, p=[0.1, 0.1, 0.8])
    x, y = rng.standard_normal((400, 5)), rng.standard_normal((400, 2))
    df = _frame(spark, keys, x, y)
    found = {r.k: np.array(r.matrix) for r in gram.ridge(df, "x", "y", 0.7, "k").collect()}
    for k in ("a", "b", "hot"):
        a, b = x[keys == k], y[keys == k]
        assert np.allclose(found[k], np.linalg.solve(a.T @ a + 0.7 * np.eye(5), a.T @ b).T)
    whole = {(r.i, r.j): r.v for r in gram.products(df, "x").collect()}
    assert np.allclose([[whole[i, j] for j in range(5)] for i in range(5)], x.T @ x)
    assert gram.ridge(df.filter("k = 'none'"), "x", "y", 1.0, "k").collect() == []


def test_null_keys_and_two_keys(spark):
    df = spark.createDataFrame([(None, 1, [1.0], [2.0]), (None, 1, [3.0], [4.0]), ("a", 2, [1.0], [1.0])], "k string, n int, x array<double>, y array<double>")
    found = {(r.k, r.n): r.matrix[0][0] for r in gram.ridge(df, "x", "y", 1.0, "k", "n").collect()}
    assert found == {(None, 1): 14 / 11, ("a", 2): 0.5}


def test_two_stages_in_one_pass(spark):
    rng = np.random.default_rng(2)
    p = rng.standard_normal((500, 4))
    f = p @ rng.standard_normal((4, 3)) + rng.standard_normal((500, 3))
    e = f @ rng.standard_normal((3, 6)) + rng.standard_normal((500, 6))
    df = spark.createDataFrame([(a.tolist(), b.tolist(), c.tolist()) for a, b, c in zip(p, f, e, strict=True)], "p array<double>, f array<double>, e array<double>").repartition(5)
    found = np.array(gram.two_stage(df, "p", "f", "e", 1e-3).first().matrix)
    f_hat, e_hat = p @ forecast.ridge(p, f, 1e-3), p @ forecast.ridge(p, e, 1e-3)
    assert np.allclose(found, forecast.ridge(f_hat, e_hat, 1e-3).T)


@pytest.mark.parametrize(("n", "d", "k"), [(300, 40, 5), (50, 4, 3), (3, 20, 3)])
def test_singular_values_and_vectors(spark, n, d, k):
    rng = np.random.default_rng(n)
    a = rng.standard_normal((n, d)) * 0.8 ** np.arange(d) @ np.linalg.qr(rng.standard_normal((d, d)))[0]
    df = spark.createDataFrame([(r.tolist(),) for r in a], "x array<double>").repartition(4)
    found = gram.singular_vectors(df, "x", k, rounds=12).orderBy("rank").collect()
    _, values, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose([r.value for r in found], values[:k], rtol=1e-6)
    assert np.allclose(np.abs(np.sum(np.array([r.vector for r in found]) * vt[:k], axis=1)), 1, atol=1e-4)
    assert all(max(r.vector, key=abs) > 0 for r in found)
    assert gram.singular_vectors(df.limit(0), "x", 2).collect() == []


def test_array_columns(spark):
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((20, 3)), rng.standard_normal((20, 2))
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)], "a array<double>, b array<double>")
    omega, phase = arrays.frequencies(3, 4000, 0.1, seed=5)
    few = (omega[:6], phase[:6])
    rows = df.select("a", "b", arrays.kronecker(F.col("a"), F.col("b")).alias("k"), arrays.fourier(F.col("a"), *few).alias("f")).collect()
    for r in rows:
        assert np.allclose(r.k, np.kron(r.a, r.b))
        assert np.allclose(r.f, np.sqrt(2 / 6) * np.cos(few[0] @ r.a + few[1]))
    features = np.sqrt(2 / 4000) * np.cos(a @ omega.T + phase)
    kernel = np.exp(-0.1 * ((a[:, None] - a[None]) ** 2).sum(-1))
    assert np.abs(features @ features.T - kernel).max() < 0.1


@pytest.fixture(scope="module")
def series_and_tops(spark):
    rng = np.random.default_rng(9)
    hours = np.arange(24 * 16)
    rows = [(c, T0 + dt.timedelta(hours=int(h)), int(20 * c + 10 * c * np.sin(h / 24 * 2 * np.pi) + rng.integers(0, 5))) for c in (1, 2) for h in hours if (h + c) % 17]
    tops = [(T0 + dt.timedelta(days=d), c, 3 - c) for d in range(16) for c in (1, 2)]
    return spark.createDataFrame(rows, "cluster int, ts timestamp_ntz, cnt long"), spark.createDataFrame(tops, "as_of timestamp_ntz, cluster int, rank int")


@pytest.mark.parametrize("horizon", [1, 12])
def test_linear_forecasts_are_those_of_the_walk(spark, series_and_tops, horizon):
    found = sorted(map(tuple, linear.forecasts(*series_and_tops, (horizon,)).collect()))
    walk = sorted(map(tuple, forecast.forecasts(*series_and_tops, ("ar",), (horizon,)).collect()))
    assert len(found) == len(walk) > 200
    assert [f[:6] for f in found] == [w[:6] for w in walk]
    assert np.allclose([f[6] for f in found], [w[6] for w in walk])


def test_models_are_kept_and_applied(spark, series_and_tops, tmp_path):
    s = forecast.Settings()
    rows = linear.lagged(*series_and_tops, s)
    models = linear.fitted(rows, s)
    dates = sorted(r.as_of for r in models.select("as_of").collect())
    for date in dates:
        tables.append_table(models.filter(F.col("as_of") == date), "models", str(tmp_path))
    kept = tables.read_table(spark, "models", str(tmp_path))
    walk = {(r.as_of, r.cluster, r.ts): r.predicted for r in forecast.forecasts(*series_and_tops, ("ar",)).collect()}
    again = {(r.as_of, r.cluster, r.ts): r.predicted for r in linear.applied(kept, rows, s).collect()}
    assert again.keys() == walk.keys() and np.allclose([again[k] for k in walk], [walk[k] for k in walk])
    # without the later models, a date takes the latest one before it
    old = linear.applied(kept.filter(F.col("as_of") <= dates[1]), rows, s).collect()
    assert {r.as_of for r in old} == set(dates)
    early = [r for r in old if r.as_of <= dates[1]]
    assert np.allclose([r.predicted for r in early], [walk[r.as_of, r.cluster, r.ts] for r in early])
    late = [r for r in old if r.as_of == dates[-1]]
    error = lambda rs, of: np.mean([(np.log1p(r.actual) - np.log1p(max(of(r), 0))) ** 2 for r in rs])
    assert error(late, lambda r: r.predicted) < 4 * error(late, lambda r: walk[r.as_of, r.cluster, r.ts]) + 0.05


def test_appending_again_changes_nothing_else(spark, tmp_path):
    rows = [(T0 + dt.timedelta(days=d), f"t{k}", d * 10 + k) for d in range(3) for k in range(4)]
    df = spark.createDataFrame(rows, "as_of timestamp_ntz, template string, cluster int")
    for d in range(3):
        tables.append_table(df.filter(F.col("as_of") == T0 + dt.timedelta(days=d)), "assignments", str(tmp_path))
    read = lambda: sorted(map(tuple, tables.read_table(spark, "assignments", str(tmp_path)).select("as_of", "template", "cluster").collect()))
    assert read() == sorted(rows)
    tables.append_table(df.filter(F.col("as_of") == T0).withColumn("cluster", F.lit(-1)), "assignments", str(tmp_path))
    assert read() == sorted([(a, t, -1 if a == T0 else c) for a, t, c in rows])
    with pytest.raises(ValueError):
        tables.append_table(df.select("template"), "templates", str(tmp_path))
