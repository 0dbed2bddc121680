"""Every named query against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quarrylog.plans import model_queries, series_queries, source_queries, spectral_queries, text_queries

SF = "/root/testdata/sf0.001"
QUERIES = text_queries.QUERIES | series_queries.QUERIES | model_queries.QUERIES | source_queries.QUERIES | spectral_queries.QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_same_rows_as_sql(spark, duck, name):
    query, sql = QUERIES[name]
    df = query(spark, SF)
    columns = sorted(df.columns)
    found = sorted(repr(tuple(_plain(r[c]) for c in columns)) for r in df.collect())
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert found == sorted(repr(tuple(_plain(r[i]) for i in at)) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if not sql))
def test_runs(spark, name):
    df = QUERIES[name][0](spark, SF)
    assert df.columns and df.count() >= 0


@pytest.mark.parametrize("name", ["ddl_columns", "catalog_scan", "column_weights", "index_difference"])
def test_no_task_sorts_what_it_reads(spark, name):
    """Lines are sorted where they have been dealt out by number, never in the tasks that read a file."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty()
    earlier = store.executionsCount()
    assert QUERIES[name][0](spark, SF).collect()
    bus.waitUntilEmpty()
    runs = store.executionsList()
    later = [runs.apply(i).physicalPlanDescription() for i in range(earlier, runs.size())]
    assert later and not any("SortAggregate" in plan for plan in later)


@pytest.mark.parametrize("name", ["ddl_columns", "catalog_scan", "column_weights", "index_difference"])
def test_parts_given_again_as_in_sql(spark, tmp_path, name):
    """A part that is in the table three times, or twice, has its columns so many times, and nothing else."""
    query, sql = QUERIES[name]
    parts = pq.read_table(f"{SF}/part.parquet")
    pq.write_table(pa.concat_tables([parts, parts, parts, parts.slice(5, 9)]), tmp_path / "part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(r[c] for c in columns)) for r in query(spark, str(tmp_path)).collect()) == want
