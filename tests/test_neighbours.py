import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylog.operators import neighbours

SCHEMA = "vector_id long, vector array<double>"


def _frame(spark, v, schema=SCHEMA, name=int):
    return spark.createDataFrame([(name(i), [float(x) for x in row]) for i, row in enumerate(v)], schema)


def _nearest(v, i, k):
    length = np.linalg.norm(v, axis=1)
    cos = v @ v[i] / np.maximum(length * length[i], 1e-300)
    return sorted((j for j in range(len(v)) if j != i), key=lambda j: (-round(cos[j], 9), j))[:k]


def _clustered(n, groups, d, seed):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((groups, d))[rng.integers(groups, size=n)] + 0.05 * rng.standard_normal((n, d))


@pytest.mark.parametrize(("leaves", "blocks"), [(None, (8192, 1024)), (1, (8192, 1024)), (8, (7, 3)), (64, (8192, 1024))])
def test_exact_with_ties_zeros_and_nulls(spark, leaves, blocks, monkeypatch):
    monkeypatch.setattr(neighbours, "VECTOR_BLOCK", blocks[0])
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", blocks[1])
    rng = np.random.default_rng(6)
    v = rng.standard_normal((200, 6)).round(1)
    v[7] = 0
    v[20:25] = v[20]
    df = _frame(spark, v).union(spark.createDataFrame([(900, None)], SCHEMA)).repartition(5)
    q = df.filter("vector_id % 20 = 0 or vector_id = 7").withColumnRenamed("vector_id", "query_id")
    found = neighbours.nearest_vectors(q, df, 3, leaves=leaves).collect()
    assert len(found) == 33
    for i in [*range(0, 200, 20), 7]:
        assert [r.vector_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == i] == _nearest(v, i, 3)


def test_most_vectors_are_one(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "VECTOR_BLOCK", 50)
    rng = np.random.default_rng(1)
    v = rng.standard_normal((600, 4))
    v[:500] = v[0]
    df = _frame(spark, v)
    found = neighbours.nearest_vectors(df.filter("vector_id % 50 = 3").withColumnRenamed("vector_id", "query_id"), df, 2, leaves=16).collect()
    for i in range(3, 600, 50):
        assert [r.vector_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == i] == _nearest(v, i, 2)


def test_leaves_are_passed_over(spark):
    v = neighbours.units(_clustered(6000, 40, 16, 2))
    tree = neighbours.fitted_tree(v[:3000], 64)
    leaf = tree.leaf_of(v)
    assert len(set(leaf)) > 30
    radius = np.full(64, -1.0)
    np.maximum.at(radius, leaf, np.sqrt(((v - tree.centres[leaf]) ** 2).sum(axis=1)))
    asked = np.arange(0, 6000, 20)
    reached = np.array([np.sort((v[leaf == leaf[i]] @ v[i]))[-2] for i in asked])
    bound = v[asked] @ tree.centres.T + radius
    visited = ((bound >= reached[:, None]) & (radius >= 0)) * np.bincount(leaf, minlength=64)
    assert visited.sum() < 0.3 * len(asked) * len(v)  # pairs compared, of all pairs
    df = _frame(spark, v)
    queries = df.filter("vector_id % 20 = 0").withColumnRenamed("vector_id", "query_id")
    found = neighbours.nearest_vectors(queries, df, 2, leaves=64).collect()
    exact = {int(i): _nearest(v, i, 2) for i in asked}
    assert {i: [r.vector_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == i] for i in exact} == exact
    few = neighbours.nearest_vectors(queries, df, 2, leaves=64, visits=4).collect()
    assert np.mean([r.vector_id in exact[r.query_id] for r in few]) >= 0.9
    own = neighbours.nearest_vectors(queries, df, 2, leaves=64, visits=1).collect()
    assert 0.5 < np.mean([r.vector_id in exact[r.query_id] for r in own]) <= 1 and len(own) <= len(found)


def test_names_may_be_strings_and_k_may_be_large(spark):
    v = np.random.default_rng(3).standard_normal((12, 3))
    df = _frame(spark, v, "vector_id string, vector array<float>", lambda i: f"n{i:02}")
    found = neighbours.nearest_vectors(df.limit(2).withColumnRenamed("vector_id", "query_id"), df, 50, leaves=8)
    assert found.groupBy("query_id").count().select("count").distinct().collect()[0][0] == 11
    assert dict(found.dtypes) == {"query_id": "string", "vector_id": "string", "cos": "double", "rank": "int"}


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert neighbours.nearest_vectors(q, none).collect() == []
    assert neighbours.nearest_vectors(q.filter("query_id > 1"), _frame(spark, np.eye(2))).collect() == []


def test_queries_stay_in_tasks(spark, monkeypatch):
    rows = []
    kind = type(spark.range(1))
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: rows.append(self) or collect(self))
    v = np.random.default_rng(4).standard_normal((300, 3))
    df = _frame(spark, v).select((F.col("vector_id") + 1000).alias("vector_id"), "vector")
    neighbours.nearest_vectors(df.withColumnRenamed("vector_id", "query_id"), df, 1, leaves=8)
    assert {tuple(d.columns) for d in rows} == {("v",), ("leaf", "n", "away")}  # the sample and a row a leaf
