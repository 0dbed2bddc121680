import random
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quarrylog.llm import _labels, quality_model, toxicity
from quarrylog.llm import _tokens as T


def test_network_gradients():
    net = toxicity.Network.fresh(np.arange(3, dtype=np.uint64))
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    rng = np.random.default_rng(0)
    x = rng.standard_normal((6, 6 * toxicity.HIDDEN))
    windows = rng.integers(0, 5, (4, 7))
    windows[1, 4:] = windows[2, 2:] = -1
    d = rng.standard_normal(4)
    net.logits(x, windows, keep=True)
    grads, d_x = net.gradients(d, windows, 5)
    for name in ("uf", "ub", "nf", "nb", "a", "ab", "v", "o", "ob"):
        w = net.weights[name]
        at = tuple(int(rng.integers(0, s)) for s in w.shape)
        old, values = w[at], []
        for e in (0.01, -0.01):
            w[at] = old + e
            values.append(float(net.logits(x, windows) @ d))
        w[at] = old
        assert abs((values[0] - values[1]) / 0.02 - float(grads[name][at])) < 1e-3, name
    old, values = x[2, 3], []
    for e in (0.01, -0.01):
        x[2, 3] = old + e
        values.append(float(net.logits(x, windows) @ d))
    assert abs((values[0] - values[1]) / 0.02 - d_x[2, 3]) < 1e-3


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 47, 48, 49, 200):
        e = toxicity.encode(pa.array([" ".join(f"w{i}" for i in range(n)), "other words"]))
        assert len(np.unique(e.windows[(e.row == 0)][e.windows[e.row == 0] >= 0])) == n


def _plain_score(net, text):
    """The score of one text by the definitions, a word and a step at a time."""
    w, h = {k: v.astype(float) for k, v in net.weights.items()}, toxicity.HIDDEN
    words = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in (text or "")).encode().lower().split(b" ")
    words = [x for x in words if x]
    if not words:
        return 0.0
    vocabulary = net.vocabulary.tolist()
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    inputs = []
    for word in words:
        known = xxhash.xxh64_intdigest(word, 42)
        padded = b" " + word + b" "
        grams = [padded[i : i + n] for n in (3, 4) for i in range(len(padded) - n + 1)]
        buckets = [int(T.mix(np.array([int.from_bytes(g, "little") + len(g) * 2**40], np.uint64))[0]) % toxicity.CHAR_BUCKETS for g in grams]
        inputs.append(np.r_[w["word"][vocabulary.index(known) + 1 if known in vocabulary else 0], np.mean([w["char"][b] for b in buckets], axis=0)])
    starts = [0] if len(words) <= toxicity.WINDOW else [*range(0, len(words) - toxicity.WINDOW, toxicity.STRIDE), len(words) - toxicity.WINDOW]
    logits = []
    for start in starts:
        part = inputs[start : start + toxicity.WINDOW]
        both = []
        for side, name in ((0, "f"), (1, "b")):
            state, states = np.zeros(h), []
            for x in part if side == 0 else part[::-1]:
                given = (x @ w["x"] + w["xb"])[3 * h * side : 3 * h * (side + 1)]
                past = state @ w[f"u{name}"]
                reset, stay = sigmoid(given[:h] + past[:h]), sigmoid(given[h : 2 * h] + past[h : 2 * h])
                new = np.tanh(given[2 * h :] + reset * (past[2 * h :] + w[f"n{name}"]))
                state = (1 - stay) * new + stay * state
                states.append(state)
            both.append(states if side == 0 else states[::-1])
        states = [np.r_[f, b] for f, b in zip(*both, strict=True)]
        level = np.array([np.tanh(s @ w["a"] + w["ab"]) @ w["v"] for s in states])
        share = np.exp(level - level.max()) / np.exp(level - level.max()).sum()
        logits.append(sum(p * s for p, s in zip(share, states, strict=True)) @ w["o"] + w["ob"][0])
    return sigmoid(np.log(np.sum(np.exp(logits))) + net.shift)


def test_scores_are_those_of_a_plain_forward_pass():
    rng = random.Random(9)
    texts, labels = _toxic_texts(rng, 120)
    net = toxicity.train(texts, labels, 0.4, steps=20)
    odd = [None, "", " .,!", "One", "Ünï-cödé & MIXED_case 7up!", " ".join(rng.choices(["word", "Wörd", "a", "x9"], k=toxicity.WINDOW)), " ".join(rng.choices(["word", "other", "b"], k=toxicity.WINDOW + 1)), " ".join(rng.choices(["z", "word", "more"], k=3 * toxicity.WINDOW + 5))]
    for text, score in zip([*texts[:12], *odd], net.scores(pa.array([*texts[:12], *odd])), strict=True):
        assert score == pytest.approx(_plain_score(net, text), abs=1e-4)


def _toxic_texts(rng, n):
    words = [f"word{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(n):
        w = rng.choices(words, k=rng.randint(5, 150))
        if i % 4 == 0:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["badbad", "uglything", f"nastyx{i}"])
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    return texts, np.array(labels)


def test_network_learns_words_and_spellings():
    rng = random.Random(0)
    texts, labels = _toxic_texts(rng, 240)
    net = toxicity.train(texts, labels, 0.25, steps=120)
    fresh, truth = _toxic_texts(rng, 200)
    score = net.scores(pa.array([*fresh, None, "", "..."]))
    assert ((score[:200] >= toxicity.THRESHOLD) == (truth == 1)).mean() > 0.95 and (score[200:] == 0).all()
    assert toxicity.train(texts[:3], np.zeros(3, int), 0.0) is None


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(quality_model.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = quality_model.train(x[:3000], y[:3000], y[:3000].mean())
    assert (0, 1) in [(a, b) for a, b, _ in model.pairs]
    assert ((model.scores(x[3000:]) >= quality_model.THRESHOLD) == (y[3000:] == 1)).mean() > 0.85


def test_features_of_odd_texts():
    x = quality_model.features(pa.array([None, "", " \n ", "a", "😀\x00|", "A" * 100_000, "x\n" * 1000]))
    assert x.shape == (7, len(quality_model.FEATURES)) and np.isfinite(x).all() and (x[:2] == 0).all()
    alone = quality_model.features(pa.array(["x\n" * 1000]))
    assert np.allclose(alone[0], x[6])


def test_scores_of_edge_tables(spark, edges, clashing, nothing, edge_rows, labels):
    for f in (toxicity.scored, quality_model.scored):
        rows = f(clashing, labels).collect()
        assert len(rows) == len(edge_rows) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        ones = [r.score for r in rows if r.doc_id == 1]
        assert ones[0] == ones[1]
        assert f(nothing, labels).count() == 0
        assert f(edges, labels.limit(0)).count() == len(edge_rows)


def test_held_out_labels_do_not_matter(spark, edges):
    import zlib

    ids = [i for i in range(300)]
    out = {i for i in ids if zlib.crc32(str(i).encode()) % 5 == 0}
    docs = spark.createDataFrame([(i, f"text {i} " + ("good words here. " * 5 if i % 2 else "| bad | ")) for i in ids], "doc_id long, text string")
    make = lambda flip: spark.createDataFrame([(i, (i % 2) ^ (flip and i in out), 0) for i in ids], "doc_id long, quality int, toxic int")
    a, b = ({r.doc_id: (r.score, r.held_out) for r in quality_model.scored(docs, make(f)).collect()} for f in (False, True))
    assert a == b and {i for i, (_, h) in a.items() if h} == out


def _flipped(spark, module, label, folds, fold):
    """Scores with true labels, and with those of held-out rows flipped."""
    import zlib

    ids = list(range(300))
    out = {i for i in ids if zlib.crc32(str(i).encode()) % folds == fold}
    docs = spark.createDataFrame([(i, f"text {i} " + ("good words here. " * 5 if i % 2 else "badword here | bad | ")) for i in ids], "doc_id long, text string")
    other = "toxic" if label == "quality" else "quality"
    make = lambda flip: spark.createDataFrame([(i, (i % 2) ^ (flip and i in out), 0) for i in ids], f"doc_id long, {label} int, {other} int")
    return out, *({r.doc_id: (r.score, r.held_out) for r in module.scored(docs, make(f)).collect()} for f in (False, True))


def test_held_out_toxic_labels_do_not_matter(spark):
    out, a, b = _flipped(spark, toxicity, "toxic", 3, 1)
    assert a == b and {i for i, (_, h) in a.items() if h} == out


def test_scores_add_up_table_entries():
    rng = np.random.default_rng(2)
    x = rng.random((900, 5))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.2 * rng.random(900) > 0.9).astype(int)
    model = quality_model.train(x, y, y.mean())
    for row, logit in zip(x[:50], model.logits(x[:50])):
        total = model.base
        for k in range(5):
            total += model.tables[k][sum(row[k] >= e for e in model.edges[k])]
        for a, b, grid in model.pairs:
            total += grid[sum(row[a] >= e for e in model.coarse[a]), sum(row[b] >= e for e in model.coarse[b])]
        assert abs(total - logit) < 1e-9


def test_best_cuts_are_those_of_a_search():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = int(rng.integers(2, 9))
        g, h = rng.standard_normal(n), rng.random(n) + 0.1
        worth = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + quality_model.SHRINK)  # noqa: B023, E731
        gain, at = quality_model._best_cut(g, h)
        gains = {k: worth(0, k) + worth(k, n) - worth(0, n) for k in range(1, n)}
        assert abs(gain - max(gains.values())) < 1e-9 and abs(gains[at] - gain) < 1e-9


def test_the_cut_lies_between_different_logits():
    logits = np.array([3.0, 2.0, 2.0, 2.0, 1.0, -np.inf])
    labels = np.array([1, 1, 0, 1, 0, 0])
    shift = _labels.shift_to(0.5, logits, labels, 0.5)
    assert ((logits + shift >= 0) == (logits >= 1.5)).all()
    assert _labels.shift_to(0.5, logits, np.ones(6, int), 1.0) == 0.0


def test_sample_has_one_text_of_each_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "a"), (2, "a"), (3, None), (None, "x")], "doc_id long, text string")
    known = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    rows, _ = _labels.training_rows(docs, known, "toxic", 1000, 999, 10)
    assert sorted(r.doc_id for r in rows.collect()) == [1, 2, 3]
    assert toxicity.scored(docs, known).count() == 504


def test_a_word_of_megabytes():
    text = "x" * 8_000_000
    began = time.perf_counter()
    assert np.isfinite(quality_model.features(pa.array([text, "a b " + text[:5000]]))).all() and time.perf_counter() - began < 5


@pytest.mark.parametrize(("module", "label", "precision", "recall"), [(quality_model, "quality", 0.97, 0.97), (toxicity, "toxic", 0.85, 0.75)])
def test_held_out_accuracy(spark, module, label, precision, recall):
    sf = "/root/testdata/sf0.1"
    known = spark.read.parquet(f"{sf}/labels.parquet").filter(f"{label} is not null")
    rows = module.scored(spark.read.parquet(f"{sf}/documents.parquet"), known).filter("held_out").join(known, "doc_id").select("predicted", F.col(label).alias("y")).collect()
    hits = sum(r.predicted == r.y == 1 for r in rows)
    assert hits >= precision * sum(r.predicted for r in rows) and hits >= recall * sum(r.y for r in rows) and len(rows) > 500
