import numpy as np
import pytest

from quarrylog.operators import forecast, varma


def _model(rng, p, q, k, size=0.2):
    root = rng.standard_normal((k, k))
    return varma.Varma(size * rng.standard_normal((p, k, k)), size * rng.standard_normal((q, k, k)), root @ root.T + np.eye(k))


def _simulated(rng, m, n):
    k = len(m.sigma)
    e = rng.multivariate_normal(np.zeros(k), m.sigma, n + 200)
    y = np.zeros_like(e)
    for t in range(len(e)):
        y[t] = e[t] + sum((m.ar[i] @ y[t - 1 - i] for i in range(min(len(m.ar), t))), np.zeros(k)) + sum((m.ma[j] @ e[t - 1 - j] for j in range(min(len(m.ma), t))), np.zeros(k))
    return y[200:]


def _dense(data, m):
    """The Gaussian log-likelihood with the covariance of all rows written out, from the moving averages that the model is."""
    n, k = data.shape
    psi = [np.eye(k)]
    for i in range(1, 400):
        psi.append((m.ma[i - 1] if i <= len(m.ma) else np.zeros((k, k))) + sum((m.ar[j] @ psi[i - 1 - j] for j in range(min(len(m.ar), i))), np.zeros((k, k))))
    gamma = [sum(psi[i + h] @ m.sigma @ psi[i].T for i in range(len(psi) - h)) for h in range(n)]
    cov = np.block([[gamma[a - b] if a >= b else gamma[b - a].T for b in range(n)] for a in range(n)])
    v = data.ravel()
    return -0.5 * (len(v) * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + v @ np.linalg.solve(cov, v))


@pytest.mark.parametrize(("p", "q", "k"), [(1, 0, 1), (0, 2, 2), (2, 1, 2), (3, 3, 1)])
def test_likelihood_is_that_of_the_dense_covariance(p, q, k):
    rng = np.random.default_rng(10 * p + q)
    m = _model(rng, p, q, k)
    data = _simulated(rng, m, 40)
    likelihood, predicted = varma.filtered(data, m)
    assert likelihood == pytest.approx(_dense(data, m), rel=1e-8)
    assert np.allclose(predicted[0], 0)


def test_innovations_have_the_right_derivatives():
    rng = np.random.default_rng(3)
    m = _model(rng, 2, 2, 2)
    data = _simulated(rng, m, 30)
    e, d = varma.innovations(data, m)
    blocks = np.concatenate([m.ar, m.ma])
    for at in rng.integers(0, blocks.size, 12):
        moved = []
        for h in (1e-6, -1e-6):
            b = blocks.ravel().copy()
            b[at] += h
            b = b.reshape(blocks.shape)
            moved.append(varma.innovations(data, varma.Varma(b[:2], b[2:], m.sigma))[0])
        assert np.allclose((moved[0] - moved[1]) / 2e-6, d[..., at], atol=1e-6)
    # after many rows the filter's shocks are these
    long = _simulated(rng, m, 400)
    assert np.allclose((long - varma.filtered(long, m)[1])[200:], varma.innovations(long, m)[0][200:], atol=1e-6)


def test_fitting_raises_the_likelihood_to_that_of_the_truth():
    rng = np.random.default_rng(4)
    truth = varma.Varma(np.array([[[0.6]], [[-0.3]]]), np.array([[[0.5]]]), np.eye(1))
    data = _simulated(rng, truth, 1500)
    model, likelihoods = varma.fitted(data, 2, 1)
    assert likelihoods == sorted(likelihoods) and likelihoods[-1] >= varma.filtered(data, truth)[0]
    assert abs(model.ar[0, 0, 0] - 0.6) < 0.12 and abs(model.ma[0, 0, 0] - 0.5) < 0.12
    error = data - varma.predictions(data, 2, 1)
    assert 0.9 < error.var() < 1.1 < data.var()


def test_odd_data_have_models_or_none():
    assert varma.fitted(np.zeros((10, 2)))[0] is None and np.isfinite(varma.predictions(np.ones((10, 2)))).all()
    for data in (np.zeros((200, 2)), np.ones((200, 1)), np.cumsum(np.ones((300, 2)), axis=0), np.tile([[1.0], [-1.0]], (150, 1)) * 1e3):
        assert np.isfinite(varma.predictions(data)).all()


def test_likelihoods_stay_likely():
    rng = np.random.default_rng(7)
    hours = np.arange(400)
    for seed in range(6):
        data = np.stack([np.sin(hours / 24 * 2 * np.pi + c) + 0.4 * rng.standard_normal(400) for c in range(4)], axis=1)
        data[: 100 * (seed % 3)] = -2.0  # a series that begins late
        data -= data.mean(axis=0)
        model, likelihoods = varma.fitted(data)
        predicted = varma.filtered(data, model)[1]
        assert likelihoods == sorted(likelihoods) and likelihoods[-1] < 1e4
        assert np.abs(predicted).max() < 10 and ((data - predicted) ** 2).mean() < 1.1 * data.var()
    growing = varma.Varma(np.array([[[1.8]]]), np.array([[[3.0]]]), np.eye(1))
    likelihood, predicted = varma.filtered(rng.standard_normal((500, 1)), growing)
    assert likelihood < 0 and np.abs(predicted).max() < 1000


def test_predictive_state_gradients():
    rng = np.random.default_rng(5)
    n, d, f, s, o = 6, 2, 7, 4, 3
    shapes = {"omega": (d, f), "phase": (f,), "u": (f, o), "ub": (o,), "w": (s, s * o), "wb": (s * o,), "d": (s, d), "db": (d,)}
    net = forecast._PredictiveState({k: rng.standard_normal(v) for k, v in shapes.items()})
    x, out, first = rng.standard_normal((n, d)), rng.standard_normal((n, d)), rng.standard_normal(s)
    loss = lambda: float((net.run(x, first)[0] * out).sum())
    loss()
    grads = net.back(out)
    for name, array in net.w.items():
        for _ in range(5):
            at = tuple(int(rng.integers(0, i)) for i in array.shape)
            old, values = array[at], []
            for h in (1e-6, -1e-6):
                array[at] = old + h
                values.append(loss())
            array[at] = old
            assert (values[0] - values[1]) / 2e-6 == pytest.approx(grads[name][at], abs=1e-5, rel=1e-5)


def test_training_does_not_lose_what_the_start_has():
    hours = np.arange(24 * 20)
    rng = np.random.default_rng(6)
    wave = np.stack([np.sin(hours / 24 * 2 * np.pi), np.cos(hours / 24 * 2 * np.pi)], axis=1) + 0.1 * rng.standard_normal((len(hours), 2))
    net, first, losses = forecast.predictive_state_fitted(wave, forecast.Settings(epochs=30, horizon=3))
    after = float(((net.run(wave[:-3], first)[0] - wave[3:]) ** 2).mean())
    assert losses == sorted(losses, reverse=True) and len(losses) > 3 and after == pytest.approx(losses[-1]) and losses[-1] < 0.95 * losses[0]
    assert np.allclose(np.linalg.norm(net.states, axis=1), 1)
