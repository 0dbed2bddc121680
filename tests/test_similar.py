import math
import random

import pytest
from pyspark.sql import functions as F

from quarrylog.operators import clustering, similar

SCHEMA = "template string, ts int, cnt long"


def _rows(seed, n, shapes, times, noise):
    """Series around a few shapes, each on times of its own and some that all share."""
    rng = random.Random(seed)
    base = [{t: rng.randint(1, 40) for t in rng.sample(range(times), times // 8)} for _ in range(shapes)]
    out = []
    for i in range(n):
        series = dict(base[i % shapes])
        for t in rng.sample(range(times), noise):
            series[t] = series.get(t, 0) + rng.randint(1, 3)
        for t in range(times, times + 3):
            series[t] = 1 + i % 3
        out += [(f"s{i:03}", t, c) for t, c in series.items()]
    return out


def _cos(rows):
    by = {}
    for k, t, c in rows:
        by.setdefault(k, {})[t] = c
    norm = {k: sum(c * c for c in s.values()) for k, s in by.items()}
    cos = lambda a, b: sum(c * by[b][t] for t, c in by[a].items() if t in by[b]) / (math.sqrt(norm[a] * norm[b]) + 1e-6)
    return by, cos


@pytest.mark.parametrize("rho", [0.3, 0.8, 0.95])
def test_no_pair_is_lost_and_few_are_measured(spark, rho):
    rows = _rows(1, 90, 9, 200, 12)
    by, cos = _cos(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    other = df.withColumnRenamed("template", "other")
    found = {(r.template, r.other): r.cos for r in similar.similar_above(df, other, rho, "template", "other").collect()}
    want = {(a, b): cos(a, b) for a in by for b in by if cos(a, b) > rho}
    assert want.keys() <= found.keys() and all(abs(found[p] - cos(*p)) < 1e-9 for p in found)
    pairs = similar.candidates(df, other, rho, "template", "other").count()
    assert len(want) <= pairs <= len(found) + 10 and clustering.similarities(df, other, "template", "other").count() == 90 * 90
    if rho == 0.95:
        assert pairs < 0.2 * 90 * 90


def test_nearest_is_among_what_is_measured(spark):
    rows, centres = _rows(2, 60, 6, 150, 25), _rows(2, 12, 12, 150, 5)
    df = spark.createDataFrame(rows + [("lone", 9999, 3)], SCHEMA)
    c = spark.createDataFrame(centres, SCHEMA).withColumnRenamed("template", "cluster")
    rounded = lambda s: sorted(map(tuple, clustering.nearest(s.withColumn("cos", F.round("cos", 6))).collect()))
    everything = clustering.similarities(df, c)
    assert rounded(similar.nearest_similar(df, c)) == rounded(everything)
    assert similar.nearest_candidates(df, c).count() < 0.5 * everything.count()


def test_equal_series_are_one(spark):
    rows = [(f"k{i:03}", t, 1 + t) for i in range(300) for t in range(4)] + [("z", 0, 5), ("a", 1, 2)]
    one, members = similar.distinct_series(spark.createDataFrame(rows, SCHEMA).repartition(6))
    assert {r.template for r in one.select("template").distinct().collect()} == {"k000", "z", "a"}
    assert {(r.template, r.same) for r in members.collect()} == {(k, "k000" if k[0] == "k" else k) for k, *_ in rows}


def test_zero_and_empty_series(spark):
    df = spark.createDataFrame([("a", 1, 0), ("b", 1, 2), ("c", 1, 4)], SCHEMA)
    other = df.withColumnRenamed("template", "other")
    assert {(r.template, r.other) for r in similar.similar_above(df, other, 0.5, "template", "other").collect()} == {(x, y) for x in "bc" for y in "bc"}
    none = df.filter("cnt > 9")
    assert similar.similar_above(none, other, 0.5, "template", "other").collect() == []
    assert similar.nearest_similar(none, none.withColumnRenamed("template", "cluster")).collect() == []
