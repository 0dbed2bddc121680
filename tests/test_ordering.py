import random

import pytest
from pyspark.sql import functions as F

from quarrylog import ordering
from quarrylog.operators import replay
from quarrylog.sources import logs


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    keys = [None, "a", "b", "hot"]
    out = [(rng.choices(keys, [1, 2, 1, 6])[0], rng.choice([None, *range(50)]), i) for i in range(3000)]
    rng.shuffle(out)
    return out


def test_places_are_those_of_a_sort(spark, rows):
    df = spark.createDataFrame(rows, "k string, x int, id int").repartition(7)
    for order, by in ((["x", "id"], lambda r: (r[1] is not None, r[1] or 0, r[2])), ([F.desc("x"), F.desc("id")], lambda r: (r[1] is None, -(r[1] or 0), -r[2]))):
        got = {r.id: r._n for r in ordering.numbered(df, order, "k").collect()}
        for key in {r[0] for r in rows}:
            assert [got[r[2]] for r in sorted((r for r in rows if r[0] == key), key=by)] == list(range(sum(r[0] == key for r in rows)))
    got = [(r._n, r.id) for r in ordering.numbered(df, ["id"]).collect()]
    assert all(n == i for n, i in got) and len(got) == len(rows)


def test_ties_and_nothing(spark):
    df = spark.createDataFrame([("a", 1)] * 50 + [("b", 1)] * 3, "k string, x int")
    assert sorted((r.k, r._n) for r in ordering.numbered(df, ["x"], "k").collect()) == [("a", i) for i in range(50)] + [("b", i) for i in range(3)]
    assert ordering.numbered(df.filter("x > 1"), ["x"], "k").collect() == []


def test_one_key_is_spread_over_tasks(spark):
    df = spark.range(100_000).select(F.lit("one").alias("k"), F.shuffle(F.array("id")).getItem(0).alias("id")).repartition(8, F.rand(1))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in ordering.numbered(df, ["id"], "k").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(sizes) == 4 and max(sizes) < 2 * 100_000 / 4
    numbers = ordering.numbered(df, ["id"], "k").agg(F.count_if(F.col("id") == F.col("_n"))).first()[0]
    assert numbers == 100_000


def test_large_tables_of_counts_are_not_broadcast(spark, rows, monkeypatch):
    monkeypatch.setattr(ordering, "BROADCAST_OCTETS", 0)
    df = spark.createDataFrame(rows, "k string, x int, id int")
    got = sorted((str(r.k), r._n) for r in ordering.numbered(df, ["id"], "k").collect())
    assert got == sorted((str(k), n) for k in {r[0] for r in rows} for n in range(sum(r[0] == k for r in rows)))


def test_values_are_carried_over_blocks(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "b"]), i, rng.choice([None, None, None, str(i)])) for i in rng.sample(range(5000), 1000)]
    for width in (1, 7, 100, 10_000):
        got = {r.n: r.v for r in ordering.carried(spark.createDataFrame(rows, "k string, n int, v string"), "v", "n", "k", width=width).collect()}
        last = {}
        for k, n, v in sorted(rows, key=lambda r: r[1]):
            last[k] = v or last.get(k)
            assert got[n] == last[k]
        assert len(got) == len(rows)


@pytest.mark.parametrize("kind", ["string", "long"])
def test_rows_given_again_are_carried_to_as_often(spark, kind):
    rows = [(i % 2, i, i if i % 7 == 0 else None) for i in range(200) for _ in range(1 + i % 3)]
    df = spark.createDataFrame(rows, "k long, n long, v long").withColumn("v", F.col("v").cast(kind)).repartition(5)
    for width in (5, 1000):
        got = sorted((r.k, r.n, None if r.v is None else int(r.v)) for r in ordering.carried(df, "v", "n", "k", width=width).collect())
        assert got == sorted((k, n, max((m for m in range(k, n + 1, 2) if m % 7 == 0), default=None)) for k, n, _ in rows)


def _plans(spark):
    """Physical plans of what the session has run."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {runs.apply(i).executionId(): runs.apply(i).physicalPlanDescription() for i in range(runs.size())}


@pytest.mark.parametrize("kind", ["string", "long"])
def test_carrying_sorts_only_what_was_dealt_to_a_task(spark, monkeypatch, kind):
    monkeypatch.setattr(ordering, "TASK_ROWS", 100, raising=False)
    rows = spark.range(0, 3000, 1, 1).select((F.col("id") < 0).cast("string").alias("k"), F.col("id").alias("n"), F.when(F.col("id") % 70 == 3, F.col("id")).cast(kind).alias("v"))
    earlier = _plans(spark)
    df = ordering.carried(rows, "v", "n", "k", width=50).withColumn("task", F.spark_partition_id())
    got = df.collect()
    later = [plan for i, plan in _plans(spark).items() if i not in earlier]
    assert later and not any("SortAggregate" in plan for plan in later)
    sizes = {t: sum(r.task == t for r in got) for t in {r.task for r in got}}
    assert len(sizes) > 10 and max(sizes.values()) <= 400
    want = lambda n: None if n < 3 else (n - 3) // 70 * 70 + 3
    assert all((None if r.v is None else int(r.v)) == want(r.n) for r in got) and len(got) == 3000



def test_percentiles_of_one_run(spark):
    rng = random.Random(5)
    values = [rng.choice([None, *range(1000)]) for _ in range(700)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v int").repartition(5)
    got = {r.id: r.p99 for r in replay.p99(df, "v", ("id",), last=150, block_rows=160).collect()}
    for i in range(700):
        kept = sorted(v for v in values[max(0, i - 149) : i + 1] if v is not None)
        assert got[i] == (kept[len(kept) - len(kept) // 100 - 1] if kept else None)
    newest = sorted(v for v in values[-150:] if v is not None)
    assert [r.p99 for r in replay.latest_p99(df, "v", ("id",), last=150).collect()] == [newest[len(newest) - len(newest) // 100 - 1]]


def test_samples_are_bounded(spark):
    df = spark.range(20_000).repartition(50)
    for n in (100, 1000):
        few, total = ordering.bounded_sample(df, n, F.xxhash64("id"))
        assert total == 20_000 and few.count() == n
        assert sorted(few.collect()) == sorted(ordering.bounded_sample(df, n, F.xxhash64("id"))[0].collect())
    assert ordering.bounded_sample(spark.range(5), 10, "id")[0].count() == 5 and ordering.bounded_sample(spark.range(0), 10, "id")[1] == 0


def test_no_window_over_a_whole_file(spark):
    df = spark.createDataFrame([("f", i, f"{'160901 12:00:00' if i % 50 == 0 else ''} 7 Query\tselect {i}") for i in range(200)], "file string, line_no long, record string")
    parsed = logs.parse_mysql55(df)
    assert {r.ts_text for r in parsed.collect()} == {"160901 12:00:00"}
    for out in (parsed, logs.sampled(df, 50, "line_no")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert all("_block" in line or "_range" in line for line in windows), plan
    assert sorted(r.line_no for r in logs.sampled(df, 50, "line_no").collect()) == [0, 50, 100, 150]
    assert sorted(r.line_no for r in logs.first_rows(df, 1500, "line_no").collect()) == list(range(200))
