import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylog.operators import clustering, combine, coverage, forecast, replay, series
from quarrylog.streaming import counts as streaming

T0 = dt.datetime(2024, 1, 1)


def _minutes(n):
    return T0 + dt.timedelta(minutes=n)


def _counts(spark, rows):
    return spark.createDataFrame([(k, _minutes(m), c) for k, m, c in rows], "template string, ts timestamp_ntz, cnt long")


@pytest.mark.parametrize("strict", [False, True])
def test_asof_equals_brute_force(spark, strict):
    rng = np.random.default_rng(1)
    right = {(k, int(m)): int(c) for k in "ab" for m, c in zip(rng.choice(60, 20, replace=False), rng.integers(1, 99, 20), strict=True)}
    left = [(k, int(m)) for k in "abc" for m in rng.integers(0, 70, 30)]
    l = spark.createDataFrame([(k, _minutes(m), i) for i, (k, m) in enumerate(left)], "template string, ts timestamp_ntz, i int")
    r = _counts(spark, [(k, m, c) for (k, m), c in right.items()])
    found = {x.i: x.cnt for x in series.asof(l, r, ["template"], "cnt", strict).collect()}
    for i, (k, m) in enumerate(left):
        best = max(((n, c) for (j, n), c in right.items() if j == k and (n < m or (n == m and not strict))), default=(0, None))
        assert found[i] == best[1]


def test_counts_are_kept_by_every_bucketing(spark):
    c = _counts(spark, [("a", m, m % 5 + 1) for m in range(0, 3000, 7)])
    total = series.totals(c, "template").first().total
    for minutes in (10, 60, 120):
        for label in ("left", "right"):
            assert series.totals(series.bucketed(c, minutes, "template", label=label), "template").first().total == total
    assert series.totals(series.bucketed_rows(c, 9, "template"), "template").first().total == total
    assert series.totals(series.dense(c, 1, "template"), "template").first().total == total


def test_hours_of_a_long_bucket(spark):
    c = _counts(spark, [("a", 14 * 60 + 5, 1)])
    assert series.bucketed(c, 120, "template").first().ts == _minutes(14 * 60)
    assert series.bucketed(_counts(spark, [("a", 10, 1), ("a", 11, 1)]), 10, "template", label="right").orderBy("ts").collect()[0].ts == _minutes(10)


def test_p99_index(spark):
    for n in (1, 2, 99, 100, 101, 250):
        rows = spark.createDataFrame([(1, i, float(i)) for i in range(n)], "k int, i int, v double")
        assert replay.latest_p99(rows, "v", ("i",), "k").first().p99 == sorted(range(n))[-((n // 100) + 1)]


def test_empty_tables(spark):
    empty = _counts(spark, [])
    assert series.bucketed(empty, 10, "template").count() == 0
    assert series.dense(empty, 60, "template").count() == 0
    assert series.asof(empty.select("template", "ts"), empty, ["template"], "cnt").count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=6, max_size=6), min_size=1, max_size=8), st.sampled_from([0.5, 0.8, 0.95]))
def test_day_step_assigns_each_active_row_once(rows, rho):
    x = np.array(rows, float)
    assigned = np.full(len(x), -1)
    after = clustering.day_step(x, np.ones(len(x), bool), assigned, 0, rho)
    assert (assigned >= 0).all() and assigned.max() < after
    before = assigned.copy()
    clustering.day_step(x, np.ones(len(x), bool), assigned, after, rho)
    assert (assigned >= 0).all() and len(before) == len(assigned)


def test_day_step_cases():
    base = np.array([1.0, 2, 3, 0])
    assigned = np.full(4, -1)
    clustering.day_step(np.stack([base, base, 5 * base, np.array([0, 0, 0, 1.0])]), np.array([True, True, True, True]), assigned, 0, 0.8)
    assert assigned[0] == assigned[1] == assigned[2] != assigned[3]
    late = np.full(2, -1)
    clustering.day_step(np.stack([base, base]), np.array([True, False]), late, 0, 0.8)
    assert late[0] == 0 and late[1] == -1


def test_online_first_date_has_no_clusters(spark):
    rows = [(f"t{i}", d * 1440 + h * 60, 1 + (h % 3) * (i % 2)) for i in range(4) for d in range(3) for h in range(24)]
    counts = _counts(spark, rows).selectExpr("'p' AS project", "*")
    found = clustering.online(counts, 0.8).collect()
    first = min(r.as_of for r in found)
    assert all(r.cluster == -1 for r in found if r.as_of == first)
    assert all(r.cluster >= 0 for r in found if r.as_of == max(x.as_of for x in found))


def test_coverage_grows_with_k(spark):
    totals = spark.createDataFrame([(_minutes(0), c, 10 * c) for c in range(1, 6)], "as_of timestamp_ntz, cluster int, total long")
    shares = [r.mean_share for r in coverage.coverage(totals).orderBy("k").collect()]
    assert shares == sorted(shares) and shares[-1] <= 1 and len(shares) == 3


def test_components_of_a_chain(spark):
    rows = [(i, j, 0.9 if abs(i - j) == 1 and i // 10 == j // 10 else 0.1) for i in range(20) for j in range(20)]
    found = clustering.threshold_components(spark.createDataFrame(rows, "a int, b int, cos double"), 0.8, "a", "b")
    assert {r.node: r.component for r in found.collect()} == {i: i // 10 * 10 for i in range(20)}


def test_hybrid_edges(spark):
    rows = [("kr", 60, 1, _minutes(0), 1.0, 5000.0), ("ar", 60, 1, _minutes(0), 1.0, -3.0), ("rnn", 60, 1, _minutes(0), 1.0, 0.0)]
    f = spark.createDataFrame(rows, "model string, horizon int, cluster int, ts timestamp_ntz, actual double, predicted double")
    e = combine.ensemble(combine.paired(f, "ar", "rnn"))
    assert abs(e.first().predicted) < 1e-9
    assert combine.hybrid(e, f.filter("model = 'kr'")).first().predicted == 5000.0
    assert combine.log_average(f, ("ar", "other")).count() == 0


def test_linear_model_finds_a_period():
    data = np.stack([np.sin(np.arange(600) * 2 * np.pi / 24), np.cos(np.arange(600) * 2 * np.pi / 24)], axis=1) + 2
    s = forecast.Settings()
    for model, limit in (("ar", 0.05), ("arma", 0.05), ("kr", 0.6), ("fnn", 1.0), ("rnn", 1.5)):
        found = forecast.walk(data, model, s)
        assert found.shape == (24, 2) and np.mean((found - data[-24:]) ** 2) < limit, model


def test_ridge_is_the_closed_form():
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((50, 4)), rng.standard_normal((50, 2))
    assert np.allclose(forecast.ridge(x, y), np.linalg.inv(x.T @ x + np.eye(4)) @ x.T @ y)


def test_lag_pairs_match_their_definition():
    data = np.arange(40.0).reshape(20, 2)
    x, y = forecast.lag_pairs(data, 3, 4)
    assert len(x) == 20 - 3 - 4 + 1
    for i in range(len(x)):
        assert (x[i] == data[i : i + 4].ravel()).all() and (y[i] == data[i + 4 + 3 - 1]).all()


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a" if i % 3 else "b", _minutes(i % 50)) for i in range(500)]
    df = spark.createDataFrame(rows, "event_type string, ts timestamp_ntz")
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = streaming.stream(spark, str(tmp_path / "in"), "event_type string, ts timestamp_ntz")
    found = streaming.run_to_end(streaming.minute_counts(stream, "event_type"))
    batch = df.groupBy("event_type", "ts").count()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.collect()))


def test_long_chains_are_one_component(spark):
    chain = [(f"n{i:04}", f"n{i + 1:04}", 0.9) for i in range(300)] + [("x", "y", 0.1)]
    found = clustering.threshold_components(spark.createDataFrame(chain, "a string, b string, cos double"), 0.5, "a", "b").collect()
    assert {r.component for r in found if r.node.startswith("n")} == {"n0000"} and len(found) == 303


def test_rolling_p99_in_blocks(spark):
    rng = np.random.default_rng(8)
    rows = [(k, i, None if rng.random() < 0.05 else float(rng.integers(0, 1000))) for k in "ab" for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(3)
    for last, block in ((150, 50_000), (150, 160), (7, 10)):
        found = {(r.k, r.i): r.p99 for r in replay.p99(df, "v", ("i",), "k", last=last, block_rows=block).collect()}
        assert len(found) == len(rows)
        for k, i, _ in rows:
            window = sorted(v for kk, j, v in rows if kk == k and i - last < j <= i and v is not None)
            assert found[k, i] == (window[len(window) - len(window) // 100 - 1] if window else None)


def _plain_cos(x, y):
    dot = sum(a * y.get(t, 0) for t, a in x.items())
    return dot / ((sum(a * a for a in x.values()) * sum(a * a for a in y.values())) ** 0.5 + 1e-6)


def _plain_online(counts, rho, lookback):
    """Day by day, in the order of templates, with series as dictionaries of minutes."""
    names = sorted({t for t, _, _ in counts})
    first, last = min(m for _, m, _ in counts), max(m for _, m, _ in counts)
    assigned, fresh, out = dict.fromkeys(names, -1), 0, {}
    for day in range((last - first + 1) // 1440 + 1):
        end = first + 1440 * day
        if day:
            begin = max(first, end - lookback * 1440)
            rows = {t: {m: c for s, m, c in counts if s == t and begin <= m < end} for t in names}
            active = {t for t, m, _ in counts if end - 1440 <= m <= end}
            total = lambda members: {m: sum(rows[t].get(m, 0) for t in members) for t in members for m in rows[t]}  # noqa: B023, E731
            members = {c: [t for t in names if assigned[t] == c] for c in {a for a in assigned.values() if a >= 0}}
            centre = {c: total(ts) for c, ts in members.items()}
            start = dict(centre)
            for t in names:
                c = assigned[t]
                if c >= 0:
                    if len(members[c]) == 1 or _plain_cos(rows[t], centre[c]) > rho:
                        continue
                    members[c] = [s for s in members[c] if s != t]
                    centre[c] = total(members[c])
                    assigned[t] = -1
                elif t not in active:
                    continue
                pool = start or centre
                # the nearest of the centres of this morning, or of those that have come since, if there were none
                unit = lambda y: sum(v * v for v in y.values()) ** 0.5 or 1
                near = lambda k: sum(a * pool[k].get(m, 0) for m, a in rows[t].items()) / unit(pool[k]) if start else _plain_cos(rows[t], pool[k])  # noqa: B023, E731
                best = max(pool, key=lambda k: (round(near(k), 12), -k), default=None)
                if best is not None and members[best] and _plain_cos(rows[t], centre[best]) > rho:
                    members[best].append(t)
                    centre[best] = total(members[best])
                    assigned[t] = best
                else:
                    members[fresh], centre[fresh], assigned[t] = [t], dict(rows[t]), fresh
                    fresh += 1
            alive = sorted(c for c in members if members[c])
            into = {c: c for c in alive}
            for c in alive:
                mine = into[c]
                others = sorted(set(into.values()) - {mine})
                if others:
                    near_one = max(others, key=lambda o: (round(_plain_cos(centre[mine], centre[o]), 12), -o))
                    if _plain_cos(centre[mine], centre[near_one]) > rho:
                        centre[near_one] = {m: centre[near_one].get(m, 0) + centre[mine].get(m, 0) for m in {*centre[near_one], *centre[mine]}}
                        into = {k: near_one if v == mine else v for k, v in into.items()}
            assigned = {t: into[a] if a >= 0 else -1 for t, a in assigned.items()}
        for t in names:
            out[end, t] = assigned[t]
    return out


@pytest.mark.parametrize(("seed", "rho"), [(1, 0.5), (2, 0.8), (3, 0.65)])
def test_online_clusters_are_those_of_a_plain_procedure(spark, seed, rho):
    rng = np.random.default_rng(seed)
    shapes = rng.integers(0, 9, (4, 24)) * (rng.random((4, 24)) < 0.5)
    rows = []
    for t in range(12):
        for d in range(5):
            if t == 11 and d < 3:
                continue
            shape = shapes[(t + (d >= 3) * (t % 5 == 0)) % 4]
            rows += [(f"t{t:02}", 1440 * d + 60 * h, int(c + rng.integers(0, 3))) for h, c in enumerate(shape) if c + (h == t) > 0 and c > 0]
    counts = _counts(spark, rows).selectExpr("'p' AS project", "*")
    for lookback in (30, 2):
        found = {(int((r.as_of - T0).total_seconds() // 60), r.template): r.cluster for r in clustering.online(counts, rho, lookback).collect()}
        assert found == _plain_online(rows, rho, lookback)


def _plain_frames(hourly, clusters, day, training, horizon):
    """Values before each hour, from ``training`` days before a date up to its horizon."""
    hours = range(24 * (day - training), 24 * day + horizon)
    return np.array([[max(((h, c) for (k, h), c in hourly.items() if k == cluster and h < at), default=(0, 0.0))[1] for cluster in clusters] for at in hours], float)


def test_linear_and_kernel_forecasts_are_those_of_plain_formulas(spark):
    rng = np.random.default_rng(9)
    hourly = {(k, h): int(5 + 4 * np.sin(h / 4 + k) + rng.integers(0, 3)) for k in (1, 2) for h in range(24 * 14) if rng.random() < 0.9}
    series_ = spark.createDataFrame([(k, T0 + dt.timedelta(hours=h), c) for (k, h), c in hourly.items()], "cluster int, ts timestamp_ntz, cnt long")
    tops = spark.createDataFrame([(T0 + dt.timedelta(days=d), k, k) for d in range(14) for k in (1, 2)], "as_of timestamp_ntz, cluster int, rank int")
    found = forecast.forecasts(series_, tops, ("ar", "kr"), (1, 5)).collect()
    assert {r.horizon for r in found} == {60, 300} and {(r.as_of - T0).days for r in found} == {10, 11, 12, 13}
    for horizon in (1, 5):
        for day in (10, 13):
            values = _plain_frames(hourly, (1, 2), day, day, horizon)
            end = len(values) - 24 - horizon
            shift = 1 - values.min()
            logs = np.log(values + shift)
            mean, deviation = logs[:end].mean(), logs[:end].std()
            scaled = (logs - mean) / deviation
            pairs = [(scaled[i : i + 24].ravel(), scaled[i + 23 + horizon]) for i in range(end - horizon - 23)]
            x, y = np.array([p for p, _ in pairs]), np.array([q for _, q in pairs])
            first = len(scaled) - min(len(scaled), 7 * 24 + horizon + 24)
            tests = np.array([scaled[i : i + 24].ravel() for i in range(first, len(scaled) - horizon - 23)])
            weights = np.linalg.lstsq(np.r_[x, np.eye(x.shape[1])], np.r_[y, np.zeros((x.shape[1], 2))], rcond=None)[0]
            spread = np.sqrt(np.var(np.r_[tests, x], axis=0, ddof=1))
            for model in ("ar", "kr"):
                if model == "ar":
                    guess = tests[-24:] @ weights
                else:
                    guess = np.array([(w := np.exp(-np.sqrt((((x - t) / spread) ** 2).sum(axis=1)))) @ y / w.sum() for t in tests[-24:]])
                expected = np.exp(guess * deviation + mean) - shift
                mine = sorted((r.ts, r.cluster, r.predicted, r.actual) for r in found if r.model == model and r.horizon == 60 * horizon and r.as_of == T0 + dt.timedelta(days=day))
                assert len(mine) == 48 and np.allclose([m[2] for m in mine], expected.ravel()) and np.allclose([m[3] for m in mine], values[-24:].ravel())


def test_recurrent_layer_gradients():
    rng = np.random.default_rng(1)
    layer = forecast._Lstm(rng, 3, 4)
    x, out = rng.standard_normal((5, 2, 3)), rng.standard_normal((5, 2, 4))
    state = (np.zeros((2, 4)), np.zeros((2, 4)))
    layer.run(x, state)
    d_x, grads = layer.back(out)
    loss = lambda: float((layer.run(x, state)[0] * out).sum())
    for array, grad in [(layer.w[k], grads[k]) for k in layer.w] + [(x, d_x)]:
        for _ in range(6):
            at = tuple(int(rng.integers(0, s)) for s in array.shape)
            old, values = array[at], []
            for e in (1e-5, -1e-5):
                array[at] = old + e
                values.append(loss())
            array[at] = old
            assert abs((values[0] - values[1]) / 2e-5 - grad[at]) < 1e-6


@pytest.mark.parametrize("model", ["fnn", "rnn", "psrnn", "arma"])
def test_models_follow_a_daily_wave(model):
    hours = np.arange(24 * 30)
    wave = 20 + 10 * np.sin(hours / 24 * 2 * np.pi)
    values = np.stack([wave, 2 * wave], axis=1)
    settings_ = forecast.Settings(epochs=60)
    predicted = forecast.walk(values, model, settings_)
    error = np.log(values[-24:] + 1) - np.log(np.maximum(predicted, 0) + 1)
    assert predicted.shape == (24, 2) and (error**2).mean() < 0.5 * np.log(values + 1).var()
