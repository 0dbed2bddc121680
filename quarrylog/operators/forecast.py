"""Forecasts of cluster arrival rates, by walk-forward over dates.

Dates, models and horizons do not depend on each other, so each of their combinations is one grouped-map group with a
small matrix (training days x clusters).  Everything random is seeded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import varma
from .series import asof

# Lags of one day, chunk length and batch size by bucket minutes.
LAGS = {1: 1440, 5: 288, 10: 144, 20: 72, 30: 48, 60: 24, 120: 12}
CHUNKS = {1: 240, 5: 200, 10: 120, 20: 90, 30: 60, 60: 48, 120: 30}
BATCHES = {1: 30, 5: 20, 10: 15, 20: 12, 30: 8, 60: 4, 120: 2}


@dataclass(frozen=True)
class Settings:
    minutes: int = 60
    horizon: int = 1
    training_days: int = 25
    warm_up_days: int = 7
    skipped_days: int = 10
    epochs: int = 30
    seed: int = 0
    #: Whether rows after the training span count when values are scaled; off, so that nothing leaks.
    scale_on_all: bool = False

    @property
    def per_day(self) -> int:
        return 1440 // self.minutes

    @property
    def lags(self) -> int:
        return LAGS.get(self.minutes, self.per_day)


def lag_pairs(data: np.ndarray, horizon: int, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``lags`` consecutive observations, and the observation ``horizon`` steps after each."""
    n = max(len(data) - horizon - lags + 1, 0)
    if not n:
        return np.zeros((0, lags * data.shape[1])), np.zeros((0, data.shape[1]))
    view = np.lib.stride_tricks.sliding_window_view(data, lags, axis=0)[:n]
    return view.transpose(0, 2, 1).reshape(n, -1), data[lags + horizon - 1 : lags + horizon - 1 + n]


def ridge(x: np.ndarray, y: np.ndarray, weight: float = 1.0) -> np.ndarray:
    return np.linalg.solve(x.T @ x + weight * np.eye(x.shape[1]), x.T @ y)


def linear(train: np.ndarray, test: np.ndarray, s: Settings) -> np.ndarray:
    x, y = lag_pairs(train, s.horizon, s.lags)
    return lag_pairs(test, s.horizon, s.lags)[0] @ ridge(x, y)


def kernel(train: np.ndarray, test: np.ndarray, s: Settings) -> np.ndarray:
    """Weights exp(-d), with d the standardised Euclidean distance; variances are those of both sets together."""
    (x, y), (z, _) = lag_pairs(train, s.horizon, s.lags), lag_pairs(test, s.horizon, s.lags)
    if not len(x) or not len(z):
        return np.zeros((len(z), train.shape[1]))
    variance = np.var(np.concatenate([z, x]), axis=0, ddof=1)
    scale = np.sqrt(np.where(variance > 0, variance, 1.0))
    a, b = z / scale, x / scale
    d = np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0))
    w = np.exp(-d)
    return (w @ y) / np.maximum(w.sum(axis=1, keepdims=True), 1e-300)


def arma(train: np.ndarray, test: np.ndarray, s: Settings) -> np.ndarray:
    """Lags of the data and of the one-step predictions of an ARMA fitted to them, in one ridge regression; the test block has an
    ARMA of its own."""
    both = lambda d: np.concatenate([lag_pairs(d, s.horizon, s.lags)[0], lag_pairs(varma.predictions(d), s.horizon, s.lags)[0]], axis=1)
    return both(test) @ ridge(both(train), lag_pairs(train, s.horizon, s.lags)[1])


def _glorot(rng: np.random.Generator, *shape: int) -> np.ndarray:
    return rng.standard_normal(shape) * np.sqrt(2 / sum(shape))


def _clipped(grads: dict[str, np.ndarray], limit: float = 0.25) -> dict[str, np.ndarray]:
    norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
    return {k: g * min(1.0, limit / (norm + 1e-6)) for k, g in grads.items()}


def _rate(epoch: int) -> float:
    return 1.0 if epoch <= 100 else 0.2


def feed_forward(train: np.ndarray, test: np.ndarray, s: Settings) -> np.ndarray:
    """linear(10), linear(20) with ReLU and dropout, linear: from one observation to the one ``horizon`` steps later."""
    rng = np.random.default_rng(s.seed)
    d = train.shape[1]
    w = {"a": _glorot(rng, d, 10), "ab": np.zeros(10), "b": _glorot(rng, 10, 20), "bb": np.zeros(20), "c": _glorot(rng, 20, d), "cb": np.zeros(d)}
    x, y = train[: -s.horizon], train[s.horizon :]
    size = max(1, BATCHES.get(s.minutes, 4) * CHUNKS.get(s.minutes, 48))
    for epoch in range(1, s.epochs + 1):
        for at in range(0, len(x), size):
            p, q = x[at : at + size], y[at : at + size]
            h = p @ w["a"] + w["ab"]
            u = h @ w["b"] + w["bb"]
            keep = (rng.random(u.shape) >= 0.2) / 0.8
            v = np.maximum(u, 0) * keep
            e = 2 * (v @ w["c"] + w["cb"] - q) / q.size
            dv = (e @ w["c"].T) * keep * (u > 0)
            dh = dv @ w["b"].T
            g = _clipped({"c": v.T @ e, "cb": e.sum(0), "b": h.T @ dv, "bb": dv.sum(0), "a": p.T @ dh, "ab": dh.sum(0)})
            for k in w:
                w[k] -= _rate(epoch) * g[k]
    z = test[: -s.horizon]
    return (np.maximum((z @ w["a"] + w["ab"]) @ w["b"] + w["bb"], 0) @ w["c"] + w["cb"])[s.lags - 1 :]


class _Lstm:
    """One layer over (steps, batch, inputs)."""

    def __init__(self, rng: np.random.Generator, inputs: int, hidden: int):
        bound = 1 / np.sqrt(hidden)
        self.w = {"x": _glorot(rng, inputs, 4 * hidden), "h": rng.uniform(-bound, bound, (hidden, 4 * hidden)), "b": np.zeros(4 * hidden)}
        self.hidden = hidden

    def run(self, x: np.ndarray, state: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        h, c = state
        n = self.hidden
        self.trace, out = [], []
        for step in x:
            gates = step @ self.w["x"] + h @ self.w["h"] + self.w["b"]
            i, f, o = (1 / (1 + np.exp(-gates[:, k * n : (k + 1) * n])) for k in (0, 1, 2))
            g = np.tanh(gates[:, 3 * n :])
            new = f * c + i * g
            t = np.tanh(new)
            self.trace.append((step, h, c, i, f, o, g, t))
            h, c = o * t, new
            out.append(h)
        return np.stack(out), (h, c)

    def back(self, d_out: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        d_x = np.zeros((len(d_out), d_out.shape[1], self.w["x"].shape[0]))
        d_h = d_c = np.zeros(d_out.shape[1:])
        for k in range(len(d_out) - 1, -1, -1):
            step, h, c, i, f, o, g, t = self.trace[k]
            d_h = d_h + d_out[k]
            d_c = d_c + d_h * o * (1 - t**2)
            d = np.concatenate([d_c * g * i * (1 - i), d_c * c * f * (1 - f), d_h * t * o * (1 - o), d_c * i * (1 - g**2)], axis=1)
            grads["x"] += step.T @ d
            grads["h"] += h.T @ d
            grads["b"] += d.sum(0)
            d_x[k], d_h, d_c = d @ self.w["x"].T, d @ self.w["h"].T, d_c * f
        return d_x, grads


def recurrent(train: np.ndarray, test: np.ndarray, s: Settings) -> np.ndarray:
    """linear(25), two LSTM layers of 20, dropout, linear; truncated back-propagation through chunks of each batch row."""
    rng = np.random.default_rng(s.seed)
    d, emb, hid = train.shape[1], 25, 20
    w = {"e": _glorot(rng, d, emb), "eb": np.zeros(emb), "o": _glorot(rng, hid, d), "ob": np.zeros(d)}
    layers = [_Lstm(rng, emb, hid), _Lstm(rng, hid, hid)]
    batch = min(BATCHES.get(s.minutes, 4), max(1, len(train) // (2 * s.horizon + 2)))
    steps = len(train) // batch
    data = train[: steps * batch].reshape(batch, steps, d).transpose(1, 0, 2)
    chunk = CHUNKS.get(s.minutes, 48)
    zero = lambda n: [(np.zeros((n, hid)), np.zeros((n, hid))) for _ in layers]
    for epoch in range(1, s.epochs + 1):
        states = zero(batch)
        for at in range(0, steps - s.horizon, chunk):
            n = min(chunk, steps - s.horizon - at)
            x, y = data[at : at + n], data[at + s.horizon : at + s.horizon + n]
            a = x @ w["e"] + w["eb"]
            b, states[0] = layers[0].run(a, states[0])
            keep = [(rng.random(b.shape) >= 0.2) / 0.8 for _ in range(2)]
            c, states[1] = layers[1].run(b * keep[0], states[1])
            v = c * keep[1]
            e = 2 * (v @ w["o"] + w["ob"] - y) / y.size
            d_b, g1 = layers[1].back((e @ w["o"].T) * keep[1])
            d_a, g0 = layers[0].back(d_b * keep[0])
            flat = lambda m: m.reshape(-1, m.shape[-1])
            g = {"o": flat(v).T @ flat(e), "ob": flat(e).sum(0), "e": flat(x).T @ flat(d_a), "eb": flat(d_a).sum(0)}
            g = _clipped(g | {f"0{k}": m for k, m in g0.items()} | {f"1{k}": m for k, m in g1.items()})
            for k in w:
                w[k] -= _rate(epoch) * g[k]
            for j, layer in enumerate(layers):
                for k in layer.w:
                    layer.w[k] -= _rate(epoch) * g[f"{j}{k}"]
    x = test[: -s.horizon, None]
    b, _ = layers[0].run(x @ w["e"] + w["eb"], zero(1)[0])
    c, _ = layers[1].run(b, zero(1)[1])
    return (c @ w["o"] + w["ob"])[s.lags - 1 :, 0]


class _PredictiveState:
    """A state of length 1 that each observation's features update bilinearly: z = (b W) o, b = z / |z|, output b D."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.w = w

    def run(self, x: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(outputs, last state) over the rows of x."""
        w = self.w
        scale = np.sqrt(2 / len(w["phase"]))
        angle = x @ w["omega"] + w["phase"]
        features = scale * np.cos(angle)
        obs = features @ w["u"] + w["ub"]
        self.trace = (x, scale, angle, features, obs, [])
        out = []
        for o in obs:
            m = (b @ w["w"] + w["wb"]).reshape(-1, len(o))
            z = m @ o
            length = np.linalg.norm(z) or 1.0
            self.trace[-1].append((b, m, length))
            b = z / length
            out.append(b)
        self.states = np.array(out).reshape(len(x), -1)
        return self.states @ w["d"] + w["db"], b

    def back(self, d_out: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of all weights, given those of the outputs."""
        w = self.w
        x, scale, angle, features, obs, steps = self.trace
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["d"], g["db"] = self.states.T @ d_out, d_out.sum(axis=0)
        d_states, d_obs = d_out @ w["d"].T, np.zeros_like(obs)
        d_b = np.zeros(d_states.shape[1])
        for t in range(len(x) - 1, -1, -1):
            before, m, length = steps[t]
            d_b = d_b + d_states[t]
            d_z = (d_b - self.states[t] * (self.states[t] @ d_b)) / length
            d_m = np.outer(d_z, obs[t]).ravel()
            d_obs[t] = m.T @ d_z
            g["w"] += np.outer(before, d_m)
            g["wb"] += d_m
            d_b = w["w"] @ d_m
        g["u"], g["ub"] = features.T @ d_obs, d_obs.sum(axis=0)
        d_angle = -scale * np.sin(angle) * (d_obs @ w["u"].T)
        g["omega"], g["phase"] = x.T @ d_angle, d_angle.sum(axis=0)
        return g


def _two_stage_start(train: np.ndarray, s: Settings, window: int, features: int, states: int, width: float, weight: float) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(weights, first state) by two-stage regression: random Fourier features of past and future windows, projected by SVD."""
    rng = np.random.default_rng(s.seed)
    stack = lambda v, a, b: np.stack([v[i + a : i + b].ravel() for i in range(window, len(v) - window - s.horizon)])
    past, future, shifted = stack(train, -window, 0), stack(train, 0, window), stack(train, 1, window + 1)
    now = stack(train, 0, 1)
    target = np.stack([train[i + s.horizon] for i in range(window, len(train) - window - s.horizon)])

    def sampled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        omega, phase = rng.standard_normal((x.shape[1], features)) * np.sqrt(2 * width), rng.uniform(0, 2 * np.pi, features)
        _, _, vt = np.linalg.svd(np.sqrt(2 / features) * np.cos(x @ omega + phase), full_matrices=False)
        return omega, phase, vt[: min(states, len(vt))].T

    made = lambda x, f: np.sqrt(2 / features) * np.cos(x @ f[0] + f[1]) @ f[2]
    of_now, of_past, of_future = sampled(now), sampled(past), sampled(future)
    o, p, f, fs = made(now, of_now), made(past, of_past), made(future, of_future), made(shifted, of_future)
    extended = np.einsum("ti,tj->tij", fs, o).reshape(len(fs), -1)
    update = ridge(p @ ridge(p, f, weight), p @ ridge(p, extended, weight), weight)
    w = {"omega": of_now[0], "phase": of_now[1], "u": of_now[2], "ub": np.zeros(o.shape[1]), "w": update, "wb": np.zeros(update.shape[1]), "d": ridge(f, target, weight), "db": np.zeros(train.shape[1])}
    return w, f.mean(axis=0)


def predictive_state_fitted(train: np.ndarray, s: Settings, window: int = 5, features: int = 25, states: int = 20, width: float = 0.02, weight: float = 1e-3) -> tuple[_PredictiveState, np.ndarray, list[float]]:
    """(network, first state, training losses): a start by two-stage regression, then truncated back-propagation through chunks.  An
    epoch that raises the loss is taken back, and the next ones go in steps of a quarter."""
    w, first = _two_stage_start(train, s, window, features, states, width, weight)
    net = _PredictiveState(w)
    x, y = train[: -s.horizon], train[s.horizon :]
    chunk = CHUNKS.get(s.minutes, 48)
    loss = lambda: float(((net.run(x, first)[0] - y) ** 2).mean())
    losses, best, rate = [loss()], dict(net.w), _rate(1)
    for _ in range(s.epochs):
        b = first
        for at in range(0, len(x), chunk):
            p, q = x[at : at + chunk], y[at : at + chunk]
            out, b = net.run(p, b)
            g = _clipped(net.back(2 * (out - q) / q.size))
            for k in net.w:
                net.w[k] = net.w[k] - rate * g[k]
        if (after := loss()) < losses[-1]:
            losses.append(after)
            best = dict(net.w)
        else:
            net.w, rate = dict(best), rate / 4
    return net, first, losses


def predictive_state(train: np.ndarray, test: np.ndarray, s: Settings) -> np.ndarray:
    """A predictive-state network, run along the test block."""
    net, first, _ = predictive_state_fitted(train, s)
    return net.run(test[: -s.horizon], first)[0][s.lags - 1 :]


MODELS: dict[str, Callable[[np.ndarray, np.ndarray, Settings], np.ndarray]] = {"ar": linear, "arma": arma, "kr": kernel, "fnn": feed_forward, "rnn": recurrent, "psrnn": predictive_state}


def walk(values: np.ndarray, model: str, s: Settings) -> np.ndarray:
    """Predictions for the last day of a matrix of times x clusters that ends ``horizon`` steps after its date."""
    day = s.per_day
    train_end = len(values) - day - s.horizon
    base = values if s.scale_on_all else values[:train_end]
    shift = 1 - min(base.min(), values.min())
    logs = np.log(values + shift)
    mean, deviation = np.log(base + shift).mean(), np.log(base + shift).std() or 1.0
    scaled = (logs - mean) / deviation
    test = scaled[-min(len(scaled), s.warm_up_days * day + s.horizon + day) :]
    found = MODELS[model](scaled[:train_end], test, s)
    return np.exp(found[-day:] * deviation + mean) - shift


def frames(series: DataFrame, tops: DataFrame, s: Settings) -> DataFrame:
    """(as_of, cluster, rank, ts, cnt): for every date its clusters on the grid of training days and what follows up to the
    horizon, each step with the latest value before it, or 0."""
    first = tops.agg(F.min("as_of").alias("first"))
    days = F.least(F.lit(s.training_days), F.floor(F.timestamp_diff("MINUTE", F.col("first"), F.col("as_of")) / 1440))
    dated = tops.join(F.broadcast(first))
    steps = days * s.per_day
    begin = F.timestamp_add("MINUTE", (-steps * s.minutes).cast("int"), F.col("as_of"))
    end = F.timestamp_add("MINUTE", F.lit((s.horizon - 1) * s.minutes), F.col("as_of"))
    usable = dated.withColumn("days", days).filter(F.col("days") >= s.skipped_days)
    grid = usable.select("as_of", "cluster", "rank", F.explode(F.sequence(begin, end, F.expr(f"INTERVAL {s.minutes} MINUTE"))).alias("ts"))
    known = asof(grid, series.select("cluster", "ts", F.col("cnt").cast("double").alias("cnt")), ["cluster"], "cnt", strict=True)
    return known.select("as_of", "cluster", "rank", "ts", F.coalesce("cnt", F.lit(0.0)).alias("cnt"))


def forecasts(series: DataFrame, tops: DataFrame, models: tuple[str, ...] = ("ar", "kr"), horizons: tuple[int, ...] = (1,), settings: Settings = Settings()) -> DataFrame:
    """(model, horizon, as_of, cluster, ts, actual, predicted) for the last day before each date's horizon.

    series: (cluster, ts, cnt) in buckets of ``settings.minutes``; tops: (as_of, cluster, rank)."""
    out = None
    for horizon in horizons:
        s = Settings(**{**settings.__dict__, "horizon": horizon})
        todo = frames(series, tops, s).withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))

        found = todo.groupBy("model", "as_of").applyInPandas(_forecaster(s), "model string, horizon int, as_of timestamp_ntz, cluster int, ts timestamp_ntz, actual double, predicted double")
        out = found if out is None else out.unionByName(found)
    return out


def _forecaster(s: Settings) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """The grouped map of one date and model."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        model, as_of = key
        wide = frame.pivot_table(index="ts", columns="rank", values="cnt", fill_value=0.0).sort_index()
        clusters = frame.drop_duplicates("rank").set_index("rank")["cluster"].loc[wide.columns].to_numpy()
        values = wide.to_numpy(float)
        day = s.per_day
        parts = []
        if len(values) - day - s.horizon >= s.lags + s.horizon + 12:
            predicted = walk(values, model, s)
            for k, c in enumerate(clusters):
                parts.append(pd.DataFrame({"model": model, "horizon": s.horizon * s.minutes, "as_of": as_of, "cluster": c, "ts": wide.index[-day:], "actual": values[-day:, k], "predicted": predicted[:, k]}))
        names = ["model", "horizon", "as_of", "cluster", "ts", "actual", "predicted"]
        return pd.concat(parts) if parts else pd.DataFrame({n: [] for n in names})

    return run
