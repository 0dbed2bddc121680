"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text becomes lower-cased words without ASCII punctuation.  A word's input is a learned vector of the word (one vector
for all words that fewer than ``MIN_DOCS`` training documents have) beside the mean of learned vectors of its three- and
four-byte grams.  Windows of ``WINDOW`` words start every ``STRIDE`` words, so that they overlap, and the last one ends
with the text; all of them are scored.  Two gated recurrent passes, one in each direction, an attention-weighted mean of
their states and a linear layer give a window's logit; a document's logit is the log-sum-exp of its windows'.

Training takes a bounded sample of labelled rows: for each label the ``TRAIN_DOCS`` first ones by hash, as far as their texts
take up to ``TRAIN_BYTES``; a text is never cut, and a row is never left out for its length.  Rows that the split holds
out are never read for training.  A step takes windows from all parts of a batch's documents: of one with label 0 that
has more than ``STEP_WINDOWS``, as many at random, whose sum is scaled to the number of its windows.  A fifth of the
sample trains nothing: the logit that separates its documents best (by F1, weighted to the labels' true shares) is moved to a
score of ``THRESHOLD``.

Defined results: null, empty and wordless texts score 0; if one of the labels has no training row, every score is 0;
repeated rows score alike; null labels are no labels, and a document with several takes the larger; an empty table gives
no rows; columns other than doc_id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _tokens as T
from ._common import reliable, slices, table
from ._labels import calibrating, held_out, shift_to, training_rows

THRESHOLD = 0.7
TRAIN_DOCS = 1500
TRAIN_BYTES = 32 << 20
MIN_DOCS = 3
WINDOW, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, CHAR_BUCKETS = 8, 8, 1 << 13
HIDDEN, ATTENTION = 8, 8
STEPS, BATCH_DOCS, RATE, DECAY = 240, 48, 0.02, 1e-4
STEP_WINDOWS = 32
SEED = 7
SCORE_BATCH = 4096


@dataclass
class Encoded:
    """Distinct words of a slice with their features, and the slice's windows over them (-1 past a text's end)."""

    word: np.ndarray  # hash of each distinct word
    gram: np.ndarray  # buckets of their grams, one after the other
    gram_at: np.ndarray  # where each word's grams begin
    windows: np.ndarray
    row: np.ndarray  # the row of each window


def encode(column: pa.Array) -> Encoded:
    words = T.lowered(T.words_of(column, T.PUNCTUATION))
    hashes, first = T.word_hashes(words), words.first
    distinct, sample, index = np.unique(hashes, return_index=True, return_inverse=True)
    spelt = T.joined(T.Words(words.buf, words.start[sample], words.end[sample], np.array([0, len(sample)])))
    # a blank before the first word, so that each word has one on both sides
    buf = np.r_[np.uint8(0x20), spelt.buf]
    begin, length = spelt.start, spelt.end - spelt.start + 2
    grams, owner = [], []
    for size in (3, 4):
        n = np.maximum(length - size + 1, 0)
        who = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + begin[who]
        value = np.zeros(len(at), np.uint64)
        for k in range(size):
            value |= buf[at + k].astype(np.uint64) << np.uint64(8 * k)
        grams.append(T.mix(value + np.uint64(size) * np.uint64(1 << 40)) % np.uint64(CHAR_BUCKETS))
        owner.append(who)
    owner_all = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    order = np.argsort(owner_all, kind="stable")
    gram = np.concatenate(grams)[order].astype(np.int64)
    gram_at = np.searchsorted(owner_all[order], np.arange(len(distinct)))
    count = np.diff(first)
    n = np.where(count == 0, 0, np.where(count <= WINDOW, 1, -(-(count - WINDOW) // STRIDE) + 1))
    row = np.repeat(np.arange(len(n)), n)
    start = STRIDE * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
    start = np.minimum(start, np.maximum(count[row] - WINDOW, 0))
    offset = start[:, None] + np.arange(WINDOW)
    inside = offset < count[row][:, None]
    windows = np.where(inside, index[np.minimum(first[row][:, None] + offset, max(len(index) - 1, 0))] if len(index) else -1, -1)
    return Encoded(distinct, gram, gram_at, windows, row)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Network:
    vocabulary: np.ndarray
    weights: dict[str, np.ndarray]
    shift: float = 0.0
    _trace: dict = field(default_factory=dict, repr=False)

    @classmethod
    def fresh(cls, vocabulary: np.ndarray, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        h, a, d = HIDDEN, ATTENTION, WORD_DIM + CHAR_DIM
        normal = lambda *shape: (rng.standard_normal(shape) * np.sqrt(1.0 / shape[0])).astype(np.float32)
        w = {"word": normal(len(vocabulary) + 1, WORD_DIM), "char": normal(CHAR_BUCKETS, CHAR_DIM), "x": normal(d, 6 * h), "xb": np.zeros(6 * h, np.float32)}
        w["word"] *= 0.1 * np.sqrt(len(w["word"]))
        w["char"] *= 0.3 * np.sqrt(len(w["char"]))
        for side in "fb":
            w |= {f"u{side}": normal(h, 3 * h), f"n{side}": np.zeros(h, np.float32)}
        w |= {"a": normal(2 * h, a), "ab": np.zeros(a, np.float32), "v": normal(a, 1)[:, 0], "o": normal(2 * h, 1)[:, 0], "ob": np.array([-1.0], np.float32)}
        return cls(vocabulary, w)

    def inputs(self, e: Encoded) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(input of every distinct word and of the padding, ids of the words, how many grams each has)."""
        at = np.minimum(np.searchsorted(self.vocabulary, e.word), max(len(self.vocabulary) - 1, 0))
        known = self.vocabulary[at] == e.word if len(self.vocabulary) else np.zeros(len(e.word), bool)
        ids = np.where(known, at + 1, 0)
        sizes = np.diff(np.r_[e.gram_at, len(e.gram)])
        x = np.zeros((len(e.word) + 1, WORD_DIM + CHAR_DIM), np.float32)
        x[:-1, :WORD_DIM] = self.weights["word"][ids]
        if len(e.word):
            x[:-1, WORD_DIM:] = np.add.reduceat(self.weights["char"][e.gram], e.gram_at, axis=0) / sizes[:, None]
        return x, ids, sizes

    def logits(self, projected: np.ndarray, windows: np.ndarray, keep: bool = False) -> np.ndarray:
        """Logits of windows over words with projected inputs; the last of these belongs to the padding."""
        w, h = self.weights, HIDDEN
        steps = windows.shape[1]
        mask = windows >= 0
        whole = bool(mask.all())
        states = np.empty((steps, len(windows), 2 * h), np.float32)
        trace = []
        for side, u, bias, order in ((0, w["uf"], w["nf"], range(steps)), (1, w["ub"], w["nb"], range(steps - 1, -1, -1))):
            state = np.zeros((len(windows), h), np.float32)
            table_ = np.ascontiguousarray(projected[:, 3 * h * side : 3 * h * (side + 1)])
            for t in order:
                given = table_[windows[:, t]]
                past = state @ u
                gates = _sigmoid(given[:, : 2 * h] + past[:, : 2 * h])
                reset, stay = gates[:, :h], gates[:, h:]
                past_n = past[:, 2 * h :] + bias
                new = np.tanh(given[:, 2 * h :] + reset * past_n)
                after = new + stay * (state - new)
                if not whole:
                    after = np.where(mask[:, t, None], after, state)
                if keep:
                    trace.append((side, t, state, reset, stay, past_n, new))
                state = after
                states[t, :, h * side : h * (side + 1)] = state
        hidden = np.tanh(states @ w["a"] + w["ab"])
        level = hidden @ w["v"]
        if not whole:
            level = np.where(mask.T, level, -1e9)
        level = np.exp(level - level.max(axis=0))
        share = level / level.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", share, states)
        if keep:
            self._trace = {"trace": trace, "states": states, "hidden": hidden, "share": share, "pooled": pooled, "mask": mask}
        return pooled @ w["o"] + w["ob"][0]

    def gradients(self, d_logit: np.ndarray, windows: np.ndarray, n_words: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the dense weights and of the projected inputs, after ``logits(..., keep=True)``."""
        w, h, k = self.weights, HIDDEN, self._trace
        g = {"o": k["pooled"].T @ d_logit, "ob": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * w["o"]
        d_states = k["share"][:, :, None] * d_pooled
        d_share = np.einsum("tbh,bh->tb", k["states"], d_pooled)
        d_level = k["share"] * (d_share - (k["share"] * d_share).sum(axis=0))
        g["v"] = np.einsum("tb,tba->a", d_level, k["hidden"])
        d_hidden = d_level[:, :, None] * w["v"] * (1 - k["hidden"] ** 2)
        flat = d_hidden.reshape(-1, ATTENTION)
        g["a"], g["ab"] = k["states"].reshape(-1, 2 * h).T @ flat, flat.sum(axis=0)
        d_states += d_hidden @ w["a"].T
        d_given = np.zeros((*windows.shape, 6 * h), np.float32)
        for side, name in ((0, "f"), (1, "b")):
            u = w[f"u{name}"]
            g[f"u{name}"], g[f"n{name}"] = np.zeros_like(u), np.zeros(h, np.float32)
            d_state = np.zeros((len(windows), h), np.float32)
            for s, t, before, reset, stay, past_n, new in reversed(k["trace"]):
                if s != side:
                    continue
                d_state = d_state + d_states[t, :, h * side : h * (side + 1)]
                live = k["mask"][:, t, None]
                d_after = d_state * live
                d_new = d_after * (1 - stay) * (1 - new**2)
                d_stay = d_after * (before - new) * stay * (1 - stay)
                d_reset = d_new * past_n * reset * (1 - reset)
                d_past_n = d_new * reset
                d_past = np.concatenate([d_reset, d_stay, d_past_n], axis=1)
                g[f"u{name}"] += before.T @ d_past
                g[f"n{name}"] += d_past_n.sum(axis=0)
                d_given[:, t, 3 * h * side : 3 * h * (side + 1)] = np.concatenate([d_reset, d_stay, d_new], axis=1)
                d_state = d_past @ u.T + d_after * stay + d_state * ~live
        return g, _summed(d_given.reshape(-1, 6 * h), windows.ravel() % (n_words + 1), n_words + 1)

    def document_logits(self, column: pa.Array) -> np.ndarray:
        """The logit of every text of a column; that of a text without words is minus infinity."""
        e = encode(column)
        x, _, _ = self.inputs(e)
        projected = x @ self.weights["x"] + self.weights["xb"]
        out = np.empty(len(e.row), np.float32)
        for at in range(0, len(out), SCORE_BATCH):
            out[at : at + SCORE_BATCH] = self.logits(projected, e.windows[at : at + SCORE_BATCH])
        return _pooled(out, e.row, len(column))

    def scores(self, column: pa.Array) -> np.ndarray:
        logits = self.document_logits(column).astype(np.float64)
        return np.where(np.isneginf(logits), 0.0, 1 / (1 + np.exp(-np.clip(logits + self.shift, -30, 30))))


def _summed(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows that go to each of n places."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        places, begin = np.unique(at[order], return_index=True)
        out[places] = np.add.reduceat(rows[order], begin, axis=0)
    return out


def _pooled(logits: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    out = np.full(rows, -np.inf)
    np.logaddexp.at(out, row, logits.astype(np.float64))
    return out


def train(texts: list[str], labels: np.ndarray, share: float, steps: int = STEPS, seed: int = SEED) -> Network | None:
    """A network for texts with labels 0 and 1; ``share``: how many labelled rows of all have label 1."""
    if not len(labels) or labels.min() == labels.max():
        return None
    rng = np.random.default_rng(seed)
    aside = calibrating(len(labels), seed)
    if len(np.unique(labels[aside])) < 2 or len(np.unique(labels[~aside])) < 2:
        aside = np.zeros(len(labels), bool)  # too few rows to set some aside
    judge = aside if aside.any() else ~aside
    judges, judged = [t for t, x in zip(texts, judge, strict=True) if x], labels[judge]
    texts, labels = [t for t, x in zip(texts, aside, strict=True) if not x], labels[~aside]
    e = encode(pa.array(texts, pa.string()))
    # documents that have a word, counted once each
    pairs = np.unique(np.stack([np.repeat(e.row, WINDOW), e.windows.ravel()], axis=1)[e.windows.ravel() >= 0], axis=0)
    counts = np.bincount(pairs[:, 1], minlength=len(e.word))
    net = Network.fresh(e.word[counts >= MIN_DOCS], seed)
    w = net.weights
    x, ids, sizes = net.inputs(e)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    begin = np.searchsorted(e.row, np.arange(len(labels) + 1))
    usable = [np.flatnonzero((labels == v) & (np.diff(begin) > 0)) for v in (0, 1)]
    if not len(usable[0]) or not len(usable[1]):
        return None
    for step in range(1, steps + 1):
        docs = np.concatenate([rng.choice(u, min(len(u), BATCH_DOCS // 2), replace=False) for u in usable])
        parts = [np.arange(begin[d], begin[d + 1]) for d in docs]
        taken = [p if labels[d] or len(p) <= STEP_WINDOWS else rng.choice(p, STEP_WINDOWS, replace=False) for d, p in zip(docs, parts, strict=True)]
        scale = np.log([len(p) / len(t) for p, t in zip(parts, taken, strict=True)])
        parts = taken
        rows = np.concatenate(parts)
        owner = np.repeat(np.arange(len(docs)), [len(p) for p in parts])
        used, local = np.unique(e.windows[rows], return_inverse=True)
        has_pad = int(len(used) > 0 and used[0] < 0)
        local = local.reshape(len(rows), WINDOW) - has_pad
        used = used[has_pad:]
        # inputs of the batch's words only; some words lose their own vector, so that the grams have to do
        word_ids = np.where(rng.random(len(used)) < 0.2, 0, ids[used])
        n = sizes[used]
        who = np.repeat(np.arange(len(used)), n)
        gram = e.gram[np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + e.gram_at[used][who]]
        x = np.zeros((len(used) + 1, WORD_DIM + CHAR_DIM), np.float32)
        x[:-1, :WORD_DIM] = w["word"][word_ids]
        x[:-1, WORD_DIM:] = np.add.reduceat(w["char"][gram], np.cumsum(n) - n, axis=0) / n[:, None]
        logits = net.logits(x @ w["x"] + w["xb"], local, keep=True)
        logits = logits + scale[owner]  # each window stands for as many as were left out beside it
        doc = _pooled(logits, owner, len(docs))
        wrong = _sigmoid(doc) - labels[docs]
        d_logit = (wrong[owner] * np.exp(logits - doc[owner]) / len(docs)).astype(np.float32)
        g, d_projected = net.gradients(d_logit, local, len(used))
        g["x"], g["xb"] = x.T @ d_projected, d_projected.sum(axis=0)
        d_x = d_projected @ w["x"].T
        g["word"] = _summed(d_x[:-1, :WORD_DIM], word_ids, len(w["word"]))
        g["char"] = _summed((d_x[:-1, WORD_DIM:] / n[:, None])[who], gram, CHAR_BUCKETS)
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for name, grad in g.items():
            m, v = moments[name]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            fixed = np.sqrt(v / (1 - 0.99**step)) + 1e-7
            w[name] -= rate * (m / (1 - 0.9**step) / fixed + (DECAY * w[name] if w[name].ndim > 1 else 0))
    net._trace = {}
    net.shift = shift_to(THRESHOLD, net.document_logits(pa.array(judges, pa.string())), judged, share)
    return net


def scored(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    sample, share = training_rows(docs, labels, "toxic", 3, 1, train_docs)
    sample = reliable(sample)
    # a window over a sample of 2 * train_docs rows
    before = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.sum(F.octet_length("text").cast("long")).over(before), F.lit(0))
    rows = sample.withColumn("upto", upto).filter(F.col("upto") < train_bytes).orderBy("doc_id").collect()
    net = train([r.text for r in rows], np.array([r.label for r in rows]), share)
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            for part in slices(batch, "text"):
                score = net.scores(part.column("text")) if net else np.zeros(part.num_rows)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "score": pa.array(score, pa.float64())})

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = given.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id"), 3, 1), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
