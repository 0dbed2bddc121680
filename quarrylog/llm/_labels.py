"""Splits, bounded samples and calibration of the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shift_to(threshold: float, logits: np.ndarray, labels: np.ndarray, share: float) -> float:
    """What has to be added to logits so that the best place to cut, between two different ones, is at the threshold."""
    some = np.isfinite(logits)
    order = np.argsort(-logits[some], kind="stable")
    sorted_, good = logits[some][order], labels[some][order] == 1
    if not good.any() or good.all():
        return 0.0
    weight = np.where(good, share / good.sum(), (1 - share) / (~good).sum())
    f1 = 2 * np.cumsum(weight * good) / (np.cumsum(weight) + share)
    last = np.r_[sorted_[1:] != sorted_[:-1], True]  # equal ones stay together
    best = int(np.argmax(np.where(last, f1, -1.0)))
    cut = (sorted_[best] + sorted_[min(best + 1, len(sorted_) - 1)]) / 2
    return float(np.log(threshold / (1 - threshold)) - cut)


def calibrating(n: int, seed: int) -> np.ndarray:
    """Which of n sampled rows find the place to cut, a fifth; the others train."""
    return np.random.default_rng(seed).random(n) < 0.2


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, per_label: int) -> tuple[DataFrame, float]:
    """(doc_id, text, label) of a bounded sample outside the held-out fold, and the share of label 1 before sampling.

    The sample has the first ``per_label`` ids of each label by hash, and one text of each: the first one by hash."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out(F.col("doc_id"), folds, fold))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias("label"))
    share = known.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0]
    order = [F.xxhash64("doc_id"), "doc_id"]
    sample = known.filter("label = 1").orderBy(*order).limit(per_label).union(known.filter("label = 0").orderBy(*order).limit(per_label))
    # at most 2 * per_label rows
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = given.join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"), F.first("label").alias("label")), float(share)
