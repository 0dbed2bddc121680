"""Text quality by a generalised additive model with pairwise interactions.

Every text becomes ``FEATURES``: shares of characters by kind, word and line statistics, and repetition.  Each feature
is cut into bins at quantiles of the training sample.  Boosting goes round the features: in turn each gets a tree of up to
three leaves over its bins, fitted to the log-loss gradient, whose leaf values are added to the feature's lookup
table.  Then the pairs that explain most of what is left get tables of their own from trees with one cut on either
feature.  A score is the sum of the looked-up table entries, added for whole batches at once.

Training takes a bounded sample of labelled rows, the ``TRAIN_DOCS`` first ones by hash for each label, and only their
features reach the driver.  Held-out rows are never read for training.  A fifth of the sample trains nothing: the sum
that separates it best (by F1, weighted to the labels' true shares) is moved to a score of ``THRESHOLD``.

Defined results: null and empty texts have all features 0 and are scored like any other text; if one of the labels has
no training row, every score is 0.5; repeated rows score alike; null labels are no labels, and a document with several
takes the larger; an empty table gives no rows; columns other than doc_id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _tokens as T
from ._common import slices, table
from ._labels import calibrating, held_out, shift_to, training_rows

THRESHOLD = 0.3
TRAIN_DOCS = 6000
BINS = 32
ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 200, 80, 6, 0.1
PAIR_BINS = 8
SHRINK = 1.0
SEED = 11

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "symbol": b"#*$%&<>@^~_=+\\/{}[]",
    "bar": b"|",
    "bang": b"!?",
    "stop": b".",
    "comma": b",;:",
    "other": bytes(range(128, 256)),
}
FEATURES = ("chars", "words", "word_length", *_KINDS, "distinct", "most_frequent", "same_as_last", "repeated_grams", "capitals", "line_words", "repeated_lines", "open_lines", "marked_words")


def _runs(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row: distinct values, occurrences of the most frequent one, occurrences of those that repeat."""
    distinct, most, repeated = np.zeros(rows), np.zeros(rows), np.zeros(rows)
    if len(row):
        order = np.lexsort((value, row))
        r, v = row[order], value[order]
        begin = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (v[1:] != v[:-1])])
        n = np.diff(np.r_[begin, len(r)])
        distinct += np.bincount(r[begin], minlength=rows)
        np.maximum.at(most, r[begin], n)
        repeated += np.bincount(r[begin], weights=n * (n > 1), minlength=rows)
    return distinct, most, repeated


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for every text of a column."""
    words = T.words_of(column)
    _, at = T.buffer_of(column)
    rows, size = words.rows, int(at[-1])
    buf, first, count = words.buf[:size], words.first, np.diff(words.first)
    n_bytes, n_words = np.diff(at), np.maximum(count, 1)

    def per_row(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[edges])

    out = {"chars": np.log1p(n_bytes), "words": np.log1p(count)}
    length = words.end - words.start
    solid = np.maximum(np.diff(np.r_[0, np.cumsum(length)][first]), 1)
    out["word_length"] = np.where(count > 0, solid / n_words, 0)
    for name, kind in _KINDS.items():
        flag = np.zeros(256, bool)
        flag[list(kind)] = True
        out[name] = per_row(flag[buf], at) / solid
    hashes, row = T.word_hashes(words), words.row_of()
    distinct, most, _ = _runs(row, hashes, rows)
    # a root makes short and long texts comparable
    out["distinct"], out["most_frequent"] = distinct / np.sqrt(n_words), most / n_words
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    out["same_as_last"] = per_row(same, first) / n_words
    grams = T.rolling(hashes, 3)
    inside = row[: len(grams)] == row[len(row) - len(grams) :]
    out["repeated_grams"] = _runs(row[: len(grams)][inside], grams[inside], rows)[2] / n_words
    upper = (words.buf >= 65) & (words.buf <= 90)
    lower = (words.buf >= 97) & (words.buf <= 122)
    up, low = (np.r_[0, np.cumsum(f)] for f in (upper, lower))
    shouted = (up[words.end] - up[words.start] > 1) & (low[words.end] == low[words.start])
    out["capitals"] = per_row(shouted, first) / n_words
    # lines with a word; the first word of a line has a line feed, or the text's start, before it
    feeds = np.r_[0, np.cumsum(words.buf == 10)]
    head = np.ones(len(hashes), bool)
    head[1:] = (feeds[words.start[1:]] > feeds[words.end[:-1]]) | (row[1:] != row[:-1])
    heads = np.flatnonzero(head)
    tails = np.r_[heads[1:], len(hashes)] - 1
    n_lines = np.maximum(np.bincount(row[heads], minlength=rows), 1)
    out["line_words"] = np.log1p(count / n_lines)
    line = T.xxh64(words.buf, words.start[heads], words.end[tails]) if len(heads) else np.zeros(0, np.uint64)
    out["repeated_lines"] = _runs(row[heads], line, rows)[2] / n_lines
    ends = np.zeros(256, bool)
    ends[list(b".!?:;)\"'")] = True
    open_ = ~ends[words.buf[words.end - 1]] if len(hashes) else np.zeros(0, bool)
    out["open_lines"] = np.bincount(row[heads], weights=open_[tails] if len(heads) else None, minlength=rows) / n_lines
    marks = np.zeros(256, bool)
    marks[list(b"#*$%&|!")] = True
    out["marked_words"] = per_row(marks[words.buf[words.end - 1]] if len(hashes) else np.zeros(0, bool), first) / n_words
    return np.stack([np.asarray(out[name], np.float64) for name in FEATURES], axis=1)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain and the place of the best cut of a row of bins."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + SHRINK) + (all_g - left_g) ** 2 / (all_h - left_h + SHRINK) - all_g**2 / (all_h + SHRINK)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _leaves(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values of a tree of up to three leaves, for each bin."""
    gain, cut = _best_cut(g, h)
    cuts = [0, len(g)]
    if gain > 0:
        cuts = [0, cut, len(g)]
        (gain_l, l), (gain_r, r) = _best_cut(g[:cut], h[:cut]), _best_cut(g[cut:], h[cut:])
        if max(gain_l, gain_r) > 0:
            cuts = sorted({*cuts, l if gain_l >= gain_r else cut + r})
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + SHRINK)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The gain and the cell values of the best tree with one cut on each side of a grid."""
    cg, ch = (np.cumsum(np.cumsum(x, axis=0), axis=1) for x in (g, h))
    top, side, whole = (lambda c: c[:-1, :-1]), (lambda c: c[-1:, :-1]), (lambda c: c[-1, -1])
    parts = [(f(cg), f(ch)) for f in (top, lambda c: side(c) - top(c), lambda c: c[:-1, -1:] - top(c), lambda c: whole(c) - side(c) - c[:-1, -1:] + top(c))]
    gain = sum(x**2 / (y + SHRINK) for x, y in parts) - whole(cg) ** 2 / (whole(ch) + SHRINK)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty(g.shape)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for columns in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, columns] = g[rows, columns].sum() / (h[rows, columns].sum() + SHRINK)
    return float(gain[i, j]), out


@dataclass
class Model:
    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k, (edges, table_) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table_[np.searchsorted(edges, x[:, k], "right")]
        for a, b, grid in self.pairs:
            out += grid[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def train(x: np.ndarray, y: np.ndarray, share: float) -> Model | None:
    """A model for features x with labels 0 and 1; ``share``: how many labelled rows of all have label 1."""
    if not len(y) or y.min() == y.max():
        return None
    aside = calibrating(len(y), SEED)
    if (~aside).sum() < 2 or len(np.unique(y[~aside])) < 2 or len(np.unique(y[aside])) < 2:
        aside = np.zeros(len(y), bool)  # too few rows to set some aside
    every_x, every_y, x, y = x, y, x[~aside], y[~aside]
    model = Model([_cuts(v, BINS) for v in x.T], [_cuts(v, PAIR_BINS) for v in x.T])
    good = y == 1
    weight = np.where(good, 1 / good.sum(), 1 / (~good).sum()) * len(y) / 2
    bins = [np.searchsorted(e, v, "right") for e, v in zip(model.edges, x.T, strict=True)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    logit = np.zeros(len(y))

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for b, t in zip(bins, model.tables, strict=True):
            g, h = (np.bincount(b, weights=s, minlength=len(t)) for s in slopes())
            step = RATE * _leaves(g, h)
            t += step
            logit += step[b]
    coarse = [np.searchsorted(e, v, "right") for e, v in zip(model.coarse, x.T, strict=True)]
    width = [len(e) + 1 for e in model.coarse]

    def grid(a: int, b: int, at: tuple[np.ndarray, np.ndarray]) -> tuple[float, np.ndarray]:
        g, h = (np.bincount(coarse[a] * width[b] + coarse[b], weights=s, minlength=width[a] * width[b]).reshape(width[a], width[b]) for s in at)
        return _quadrants(g, h)

    left = slopes()
    gains = [(grid(a, b, left)[0], a, b) for a, b in combinations(range(x.shape[1]), 2) if width[a] > 1 and width[b] > 1]
    chosen = [(a, b, np.zeros((width[a], width[b]))) for _, a, b in sorted(gains, key=lambda v: (-v[0], v[1:]))[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, t in chosen:
            step = RATE * grid(a, b, slopes())[1]
            t += step
            logit += step[coarse[a], coarse[b]]
    model.pairs = chosen
    judge = aside if aside.any() else ~aside
    model.base = shift_to(THRESHOLD, model.logits(every_x[judge]), every_y[judge], share)
    return model


def scored(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(part.column("text"))
                yield pa.record_batch({"doc_id": part.column("doc_id"), "label": part.column("label"), "x": pa.array(list(x), pa.list_(pa.float64()))})

    sample, share = training_rows(docs, labels, "quality", 5, 0, train_docs)
    rows = sample.select(F.col("doc_id").cast("long"), F.col("label").cast("int").alias("label"), "text").mapInArrow(measure, "doc_id long, label int, x array<double>").orderBy("doc_id", "x").collect()
    fitted = train(np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r.label for r in rows]), share)
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = model.value
        for batch in batches:
            for part in slices(batch, "text"):
                score = fitted.scores(features(part.column("text"))) if fitted else np.full(part.num_rows, 0.5)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "score": pa.array(score, pa.float64())})

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = given.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id"), 5, 0), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
