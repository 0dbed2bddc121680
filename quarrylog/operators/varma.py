"""Vector ARMA models of short series, by likelihood: what one date's task does with its own matrix.

The model is y(t) = A1 y(t-1) + ... + e(t) + M1 e(t-1) + ..., about the mean of y.  Its likelihood comes from a Kalman filter over a
state of max(p, q + 1) blocks.  Fitting begins with two regressions and goes on in scoring steps: innovations and
their derivatives give a direction, which is followed as far as the likelihood grows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Variances of a state of which nothing is known, where the model is not stationary.
DIFFUSE = 1e6
#: Predictions so many times as large as the data are none.
FAR = 100
#: What a covariance may still move when its gain is kept.
STILL = 1e-9
#: Scoring steps, and halvings of a step that is too long.
STEPS, HALVINGS = 10, 6


@dataclass
class Varma:
    ar: np.ndarray  # (p, k, k)
    ma: np.ndarray  # (q, k, k)
    sigma: np.ndarray  # (k, k)


def _system(m: Varma) -> tuple[np.ndarray, np.ndarray]:
    """Transition and loading of the state."""
    k = len(m.sigma)
    r = max(len(m.ar), len(m.ma) + 1)
    t, load = np.zeros((r * k, r * k)), np.zeros((r * k, k))
    load[:k] = np.eye(k)
    for i, a in enumerate(m.ar):
        t[i * k : (i + 1) * k, :k] = a
    for j, b in enumerate(m.ma):
        load[(j + 1) * k : (j + 2) * k] = b
    t[: (r - 1) * k, k:] += np.eye((r - 1) * k)
    return t, load


def stationary_covariance(t: np.ndarray, noise: np.ndarray) -> np.ndarray | None:
    """The covariance that a step leaves as it is, by doubling; None where there is none."""
    total, power = noise.copy(), t.copy()
    for _ in range(40):
        more = power @ total @ power.T
        if not np.isfinite(more).all() or np.abs(more).max() > 1e12:
            return None
        total = total + more
        if np.abs(more).max() <= 1e-13 * np.abs(total).max():
            return total
        power = power @ power
    return None


def filtered(data: np.ndarray, m: Varma) -> tuple[float, np.ndarray]:
    """(log-likelihood, one-step predictions).  Once the state's covariance stands still, its gain is kept."""
    n, k = data.shape
    t, load = _system(m)
    noise = load @ m.sigma @ load.T
    p = stationary_covariance(t, noise)
    p = DIFFUSE * np.eye(len(t)) if p is None else p
    a, out, total, start = np.zeros(len(t)), np.zeros((n, k)), 0.0, n
    for i, y in enumerate(data):
        f = p[:k, :k]
        try:
            # rounding of a system that grows shows here: its covariance is none any more
            root = np.linalg.cholesky(f)
            inverse = np.linalg.inv(f)
        except np.linalg.LinAlgError:
            return -np.inf, np.zeros((n, k))
        log_det = 2 * np.log(np.diag(root)).sum()
        gain = t @ p[:, :k] @ inverse
        after = t @ p @ t.T + noise - gain @ f @ gain.T
        still = np.abs(after - p).max() <= STILL * max(1.0, np.abs(p).max())
        p = (after + after.T) / 2
        v = y - a[:k]
        out[i] = a[:k]
        total -= 0.5 * (k * np.log(2 * np.pi) + log_det + v @ inverse @ v)
        a = t @ a + gain @ v
        if still:
            step = t.copy()
            step[:, :k] -= gain
            if np.abs(np.linalg.eigvals(step)).max() < 1:
                start = i + 1
                break
    if start < n:
        for i in range(start, n):
            out[i] = a[:k]
            a = step @ a + gain @ data[i]
        rest = data[start:] - out[start:]
        total -= 0.5 * ((n - start) * (k * np.log(2 * np.pi) + log_det) + np.einsum("ta,ab,tb->", rest, inverse, rest))
    if not np.isfinite(total) or np.abs(out).max(initial=0) > FAR * max(1.0, np.abs(data).max(initial=0)):
        return -np.inf, np.zeros((n, k))
    return float(total), out


def shocks_of(data: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """The innovations, from nothing before the first row."""
    e = data.copy()
    for i, a in enumerate(ar):
        e[i + 1 :] -= data[: -i - 1] @ a.T
    q = len(ma)
    if q:
        joined = np.concatenate(ma[::-1], axis=1)  # those of the oldest row first
        for t in range(1, len(e)):
            past = e[max(t - q, 0) : t].ravel()
            e[t] -= joined[:, len(joined) * q - len(past) :] @ past
    return e


def innovations(data: np.ndarray, m: Varma) -> tuple[np.ndarray, np.ndarray]:
    """(the innovations, their derivatives by all coefficients)."""
    n, k = data.shape
    e = shocks_of(data, m.ar, m.ma)
    lagged = [data] * len(m.ar) + [e] * len(m.ma)
    d = np.zeros((n, k, len(lagged) * k * k))
    for at, rows in enumerate(lagged):
        lag = 1 + (at if at < len(m.ar) else at - len(m.ar))
        for a in range(k):
            d[lag:, a, at * k * k + a * k : at * k * k + (a + 1) * k] = -rows[:-lag]
    for t in range(1, n):
        for j in range(min(len(m.ma), t)):
            d[t] -= m.ma[j] @ d[t - 1 - j]
    return e, d


def _regressed(data: np.ndarray, p: int, q: int) -> Varma:
    """A long autoregression gives the shocks, and values and shocks give the model."""
    n, k = data.shape
    long = min(2 * (p + q), max(n // 4, 1))
    lagged = lambda v, count, start: np.concatenate([v[start - i : len(v) - i] for i in range(1, count + 1)], axis=1)
    solve = lambda x, y: np.linalg.solve(x.T @ x + 1e-3 * np.eye(x.shape[1]), x.T @ y)
    x = lagged(data, long, long)
    shocks = np.zeros_like(data)
    shocks[long:] = data[long:] - x @ solve(x, data[long:])
    start = long + max(p, q)
    w = solve(np.concatenate([lagged(data, p, start), lagged(shocks, q, start)], axis=1), data[start:])
    blocks = w.reshape(p + q, k, k).transpose(0, 2, 1)
    e = shocks[start:]
    return Varma(blocks[:p], blocks[p:], e.T @ e / len(e) + 1e-6 * np.eye(k))


def fitted(data: np.ndarray, p: int = 6, q: int = 3, steps: int = STEPS) -> tuple[Varma | None, list[float]]:
    """(the model of data about 0, its log-likelihoods step by step, none less than the one before); None where data are few."""
    n, k = data.shape
    if n <= 2 * (p + q) + min(2 * (p + q), max(n // 4, 1)):
        return None, []
    model = _regressed(data, p, q)
    best = filtered(data, model)[0]
    if not np.isfinite(best):
        # nothing that the two regressions give can be used: white noise
        model = Varma(np.zeros((p, k, k)), np.zeros((q, k, k)), data.T @ data / n + 1e-6 * np.eye(k))
        best = filtered(data, model)[0]
    likelihoods = [best]
    for _ in range(steps):
        e, d = innovations(data, model)
        if not (np.isfinite(e).all() and np.isfinite(d).all()) or np.abs(d).max() > 1e9:
            break
        root = np.linalg.cholesky(np.linalg.inv(model.sigma)).T
        j = np.einsum("ab,tbm->tam", root, d).reshape(n * k, -1)
        h = j.T @ j
        move = -np.linalg.solve(h + 1e-6 * (np.trace(h) / len(h) + 1e-12) * np.eye(len(h)), j.T @ (e @ root.T).ravel())
        blocks = move.reshape(p + q, k, k)
        for halving in range(HALVINGS):
            ar, ma = model.ar + blocks[:p] / 2**halving, model.ma + blocks[p:] / 2**halving
            with np.errstate(over="ignore", invalid="ignore"):
                shocks = shocks_of(data, ar, ma)
            if not np.isfinite(shocks).all() or np.abs(shocks).max() > 1e9:
                continue
            tried = Varma(ar, ma, shocks.T @ shocks / n + 1e-9 * np.eye(k))
            likelihood = filtered(data, tried)[0]
            if likelihood > best:
                break
        else:
            break
        gain, model, best = likelihood - best, tried, likelihood
        likelihoods.append(best)
        if gain < 1e-4:
            break
    return model, likelihoods


def predictions(data: np.ndarray, p: int = 6, q: int = 3) -> np.ndarray:
    """In-sample one-step predictions of the model fitted to data; its mean where data are few."""
    mean = data.mean(axis=0) if len(data) else np.zeros(data.shape[1])
    model, _ = fitted(data - mean, p, q)
    return np.zeros_like(data) + mean if model is None else filtered(data - mean, model)[1] + mean
