"""Queries that write files with the library's sinks, and read them with its sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import ordering
from ..checkpoints import new_folder
from ..functions import numeric, text
from ..operators import combine, coverage, replay, series, vectors
from ..sources import catalog, ddl, logs, tables
from . import fixtures as X


def _folder(spark):
    return new_folder(spark, "files")


def _line():
    return F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T"), F.date_format("ts", "HH:mm:ss"), F.lit(".5Z 7 Query "), "query")


def raw_log_scan(spark, sf):
    folder = _folder(spark)
    X.query_log(spark, sf).select(_line()).write.option("compression", "gzip").text(folder)
    lines = logs.read_lines(spark, f"{folder}/*.gz").filter("line <> ''")
    return logs.parse_mysql57(logs.assemble(lines, "mysql57")).select("day", "time", "query")


def anonymised_log_scan(spark, sf):
    folder = _folder(spark)
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(".123 EST"))
    rows = X.query_log(spark, sf).select(stamp.alias("ts_text"), "conn", stamp.alias("session_start"), "query", F.concat(F.lit("parameters: $1 = '"), "conn", F.lit("'")).alias("params"))
    tables.write_quoted_csv(rows, folder)
    return logs.read_anonymised(spark, folder, "postgresql").filter("rejected is null").select("ts_text", "conn", "query", "params")


def template_table(spark, sf):
    folder = _folder(spark)
    counts = X.event_counts(spark, sf).withColumn("template", F.concat(F.lit("a$"), "template", F.when(F.minute("ts") % 2 == 0, "$").otherwise("")))
    tables.write_table(counts, "template_counts", folder)
    return tables.read_template_counts(spark, folder)


def template_list(spark, sf):
    folder = _folder(spark)
    tables.write_templates(X.user_counts(spark, sf), folder)
    return spark.read.text(folder).select(F.col("value").alias("template"))


def template_order(spark, sf):
    """The places of the templates in their file."""
    folder = _folder(spark)
    tables.write_templates(X.query_log(spark, sf).select(F.concat_ws(" ", F.lit("select"), "conn").alias("template")), folder)
    lines = ordering.numbered(logs.read_lines(spark, folder), ["file", "line_no"])
    return lines.select(F.col("_n").alias("place"), F.col("line").alias("template"))


def broken_rows(spark, sf):
    """A log in which every seventh row is cut off, and what is read of it."""
    folder = _folder(spark)
    whole = F.concat(F.lit('"2024-01-01","00:00:00","'), "conn", F.lit('","Query","'), F.replace("query", F.lit('"'), F.lit('""')), F.lit('"'))
    X.query_log(spark, sf).select(F.when(F.col("id") % 7 == 0, F.concat(F.lit('"2024-01-01","'), F.col("id").cast("string"), F.lit('"'))).otherwise(whole)).write.text(folder)
    found = logs.read_anonymised(spark, folder, "mysql57", glob="*.txt")
    return found.select("conn", F.when(F.col("rejected").isNull(), F.col("query")).alias("query"), "rejected")


def series_files(spark, sf):
    folder = _folder(spark)
    X.hourly(spark, sf).select("cluster", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "cnt").write.partitionBy("cluster").csv(folder)
    found = tables.read_series_csv(spark, folder)
    return found.select(F.regexp_extract("file", "cluster=([0-9]+)", 1).cast("int").alias("cluster"), "ts", "cnt")


def cluster_tables(spark, sf):
    folder = _folder(spark)
    tops = coverage.top_clusters(coverage.cluster_totals(X.assignments(spark, sf), X.user_counts(spark, sf)))
    # half of the days a second time, which changes nothing
    for rows in (X.assignments(spark, sf), X.assignments(spark, sf).filter(F.dayofmonth("as_of") % 2 == 0)):
        tables.append_table(rows, "assignments", folder)
    tables.write_table(tops, "top_clusters", folder)
    tables.write_table(coverage.cluster_series(X.assignments(spark, sf), X.user_counts(spark, sf), 10, tops), "cluster_series", folder)
    series_ = tables.read_table(spark, "cluster_series", folder).groupBy("cluster").agg(F.sum("cnt").alias("cnt"))
    members = tables.read_table(spark, "assignments", folder).groupBy("cluster").agg(F.count("*").alias("members"))
    return members.join(series_, "cluster", "left").join(tables.read_table(spark, "top_clusters", folder).groupBy("cluster").agg(F.count("*").alias("days")), "cluster", "left")


def coverage_table(spark, sf):
    folder = _folder(spark)
    totals = coverage.cluster_totals(X.assignments(spark, sf), X.user_counts(spark, sf))
    tables.write_table(coverage.coverage(totals), "coverage", folder)
    tables.write_table(totals, "cluster_totals", folder)
    whole = tables.read_table(spark, "cluster_totals", folder).agg(F.sum("total").alias("all_totals"))
    return tables.read_table(spark, "coverage", folder).join(F.broadcast(whole)).select("k", F.round("mean_share", 6).alias("mean_share"), "all_totals")


def forecast_tables(spark, sf):
    folder = _folder(spark)
    infinite = F.when(F.hour("ts") == 3, float("inf")).when(F.hour("ts") == 4, -2.0).otherwise(F.col("predicted"))
    tables.write_table(X.forecasts(spark, sf).withColumn("predicted", infinite), "forecasts", folder)
    found = tables.read_table(spark, "forecasts", folder).filter("model = 'rnn' and horizon = 60")
    return tables.cleaned_predictions(found, "finite").select("cluster", "ts", F.round("predicted", 6).alias("finite"), F.round(numeric.not_negative(numeric.finite_or_zero(F.col("predicted"))), 6).alias("clamped"))


def trace_file(spark, sf):
    folder = _folder(spark)
    tables.write_trace(replay.trace(X.query_log(spark, sf)), folder)
    return spark.read.text(folder).select(*logs.parse_trace(F.col("value"))).groupBy("ts", "conn", "query").agg(F.count("*").alias("n"))


def replay_metrics(spark, sf):
    folder = _folder(spark)
    rows = X.read(spark, sf, "events").select(F.col("ts"), F.col("event_id").alias("id"), "value")
    workers = [rows.filter(F.pmod("id", F.lit(3)) == w) for w in range(3)]
    merged = workers[0].unionByName(workers[1]).unionByName(workers[2])
    indexes = spark.sql("SELECT timestamp_ntz'2024-01-03' AS ts, 'idx_a' AS index UNION ALL SELECT timestamp_ntz'2024-01-10', 'idx_b'")
    tables.write_table(replay.metrics(merged, "value", indexes), "replay", folder)
    return tables.read_table(spark, "replay", folder)


def rejected_records(spark, sf):
    lines = X.query_log(spark, sf).select("id", F.when(F.col("id") % 3 == 0, F.lit("no record")).otherwise(_line()).alias("record"))
    return logs.rejected(lines, "mysql57")


def schema_statements(spark, sf):
    statement = F.when(F.col("event_id") % 4 == 0, "USE db").when(F.col("event_id") % 4 == 1, "CREATE DATABASE x").when(F.col("event_id") % 4 == 2, "").otherwise(F.concat(F.lit("CREATE TABLE t"), F.col("event_id").cast("string"), F.lit(" (a int)")))
    return X.read(spark, sf, "events").select("event_id", statement.alias("statement")).filter(text.is_schema_statement(F.col("statement")))


def index_catalog(spark, sf):
    nations = X.read(spark, sf, "nation").select("*", F.explode(F.array(F.lit("c0"), F.lit("c1"))).alias("column_name"))
    statistics = nations.select(F.when(F.col("n_regionkey") == 0, "other").otherwise("db").alias("table_schema"), F.concat(F.lit("t"), F.col("n_regionkey").cast("string")).alias("table_name"), F.concat(F.lit("i"), (F.col("n_nationkey") % 3).cast("string")).alias("index_name"), "column_name")
    named = catalog.mysql_indexes(statistics, "db").select(F.lit("index").alias("what"), "table", F.col("index").alias("name"))
    return named.union(catalog.mysql_indexed_columns(statistics, "db").select(F.lit("column"), "table", "column"))


def postgresql_catalog(spark, sf):
    nations = X.read(spark, sf, "nation")
    key = F.col("n_nationkey").cast("long")
    pg_index = nations.select((key + 1000).alias("indexrelid"), (key % 5).alias("indrelid"), F.array((key % 2 + 1).cast("int"), F.lit(3)).alias("indkey"))
    pg_attribute = nations.filter("n_nationkey < 20").select((key % 5).alias("attrelid"), F.floor(key / 5).cast("int").alias("attnum"), F.concat(F.lit("a"), key.cast("string")).alias("attname"))
    names = nations.select((key + 1000).alias("oid"), F.when(key % 7 == 0, "pg_own").otherwise(F.concat(F.lit("i"), key.cast("string"))).alias("relname")).union(nations.filter("n_nationkey < 5").select(key, F.concat(F.lit("t"), key.cast("string"))))
    return catalog.postgresql_indexed_columns(pg_index, pg_attribute, names)


def catalog_scan(spark, sf):
    scanned = ddl.scanned(X.schema_dump(spark, sf))
    schema = F.element_at(F.array(F.lit("pg_catalog"), F.lit("information_schema"), F.lit("public")), F.least(F.length("data_type") % 4 + 1, F.lit(3)))
    return catalog.other_columns(scanned.select(schema.alias("table_schema"), F.col("table").alias("table_name"), F.col("column").alias("column_name"), "data_type"))


def identifier_functions(spark, sf):
    name = F.concat(F.lit("`"), "event_type", F.lit("`("))
    return X.read(spark, sf, "events").select("event_id", text.clean_identifier(name).alias("name"), text.drop_dollars(F.concat(F.lit("$"), "event_type", F.lit("$1"))).alias("plain"), text.index_statement(F.lit("a.b"), F.col("event_type")).alias("statement"))


def like_exemption(spark, sf):
    query = F.concat(F.lit("select 1 from orders where o_clerk LIKE '%"), "o_orderstatus", F.lit("%' and o_comment = 'secret'"))
    return X.read(spark, sf, "orders").select("o_orderkey", text.anonymize(query, X.SALT).alias("query"))


def one_hot(spark, sf):
    return X.read(spark, sf, "nation").select("n_nationkey", F.posexplode(numeric.one_hot(F.col("n_regionkey").cast("int"), 5)).alias("place", "value"))


def zero_places(spark, sf):
    vector = F.array(F.lit(0.0), F.col("n_regionkey").cast("double"), F.lit(0.0), F.col("n_nationkey").cast("double"))
    return vectors.without_zero_places(X.read(spark, sf, "nation").select("n_nationkey", vector.alias("vector"))).select("n_nationkey", F.array_join(F.transform("vector", lambda x: x.cast("int")), ",").alias("vector"))


def right_dense(spark, sf):
    return series.dense(series.bucketed(X.user_counts(spark, sf), 60, "template", label="right"), 60, "template")


def rho_grid(spark, sf):
    rows = X.forecasts(spark, sf).select("model", (F.lit(50) + 10 * (F.col("cluster") % 5)).alias("rho"), F.date_trunc("day", "ts").alias("as_of"), "actual", F.col("predicted").alias("allocated"))
    return combine.template_errors(rows, "model", "rho").select("model", "rho", F.round("score", 6).alias("score"))


_STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
_TOTALS = """run AS (SELECT template, ts, CAST(sum(cnt) OVER (PARTITION BY template ORDER BY ts) AS BIGINT) AS total FROM user_counts),
  totals AS (SELECT as_of, cluster, CAST(sum(coalesce(total, 0)) AS BIGINT) AS total FROM (SELECT a.as_of, a.cluster, r.total FROM assignments a ASOF LEFT JOIN run r ON a.template = r.template AND a.as_of >= r.ts WHERE a.cluster >= 0) GROUP BY ALL),
  ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY as_of ORDER BY total DESC, cluster) AS INTEGER) AS rank FROM totals)"""
_USERS = f"{X.USER_COUNTS}, {X.ASSIGNMENTS}, {_TOTALS}"
_SCORE = "round(sum(CASE WHEN actual <> predicted THEN ln((actual - predicted) ** 2) END) / count(DISTINCT date_trunc('day', ts)) / 3000, 6)"

QUERIES = {
    "raw_log_scan": (raw_log_scan, f"WITH {X.LOG} SELECT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M:%S') || '.5' AS time, query FROM log"),
    "anonymised_log_scan": (anonymised_log_scan, f"WITH {X.LOG} SELECT {_STAMP} || '.123 EST' AS ts_text, conn, query, 'parameters: $1 = ''' || conn || '''' AS params FROM log"),
    "template_table": (template_table, "SELECT 'a' || event_type AS template, date_trunc('minute', ts) AS ts, count(*) AS cnt FROM events GROUP BY ALL"),
    "template_list": (template_list, "SELECT DISTINCT 't' || (user_id % 50) AS template FROM events"),
    "template_order": (template_order, f"WITH {X.LOG} SELECT row_number() OVER (ORDER BY template) - 1 AS place, template FROM (SELECT DISTINCT 'select ' || conn AS template FROM log)"),
    "broken_rows": (broken_rows, f"""WITH {X.LOG} SELECT CASE WHEN id % 7 <> 0 THEN conn END AS conn, CASE WHEN id % 7 <> 0 THEN query END AS query, CASE WHEN id % 7 = 0 THEN '"2024-01-01","' || id || '"' END AS rejected FROM log"""),
    "series_files": (series_files, f"WITH {X.HOURLY} SELECT cluster, ts, cnt FROM hourly"),
    "cluster_tables": (cluster_tables, f"""WITH {_USERS},
        x AS (SELECT cluster, time_bucket(INTERVAL 10 MINUTE, u.ts - INTERVAL 1 MINUTE, TIMESTAMP '2000-01-01') AS b, CAST(sum(cnt) AS BIGINT) AS cnt FROM user_counts u JOIN assignments a ON a.template = u.template AND date_trunc('day', u.ts) + INTERVAL 1 DAY = a.as_of WHERE (as_of, cluster) IN (SELECT (as_of, cluster) FROM ranked WHERE rank <= 3) GROUP BY ALL),
        c AS (SELECT cluster, CAST(sum(cnt) AS BIGINT) AS cnt FROM x GROUP BY cluster HAVING count(*) >= 2), r AS (SELECT cluster, count(*) AS days FROM ranked WHERE rank <= 3 GROUP BY cluster)
        SELECT cluster, members, cnt, days FROM (SELECT cluster, count(*) AS members FROM assignments GROUP BY cluster) LEFT JOIN c USING (cluster) LEFT JOIN r USING (cluster)"""),
    "coverage_table": (coverage_table, f"WITH {_USERS} SELECT rank AS k, round(avg(share), 6) AS mean_share, (SELECT CAST(sum(total) AS BIGINT) FROM totals) AS all_totals FROM (SELECT rank, CAST(sum(total) OVER (PARTITION BY as_of ORDER BY rank) AS DOUBLE) / sum(total) OVER (PARTITION BY as_of) AS share FROM ranked) WHERE rank <= 3 GROUP BY ALL"),
    "forecast_tables": (forecast_tables, f"WITH {X.FORECASTS} SELECT cluster, ts, round(CASE hour(ts) WHEN 3 THEN 0 WHEN 4 THEN -2 ELSE predicted END, 6) AS finite, round(CASE WHEN hour(ts) IN (3, 4) THEN 0 ELSE predicted END, 6) AS clamped FROM forecasts WHERE model = 'rnn'"),
    "trace_file": (trace_file, f"WITH {X.LOG} SELECT date_trunc('minute', ts) AS ts, conn, CASE id % 5 WHEN 4 THEN substr(query, 7) ELSE query END || ';' AS query, count(*) AS n FROM log GROUP BY ALL"),
    "replay_metrics": (replay_metrics, """WITH b AS (SELECT event_id, ts, time_bucket(INTERVAL 10 MINUTE, date_trunc('minute', ts) - INTERVAL 1 MINUTE, TIMESTAMP '2000-01-01') + INTERVAL 10 MINUTE AS batch, row_number() OVER (ORDER BY ts, event_id) AS n FROM events),
        m AS (SELECT batch AS ts, CAST(count(*) AS DOUBLE) AS throughput, max(n) AS n, row_number() OVER (ORDER BY batch) AS k FROM b GROUP BY batch),
        v AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) AS n FROM events),
        p AS (SELECT m.ts, m.throughput, m.k, list_sort(list(v.value)) AS l FROM m JOIN v ON v.n <= m.n AND v.n > m.n - 3000 WHERE m.k > 40 GROUP BY ALL)
        SELECT ts, throughput, l[len(l) - len(l) // 100] AS p99, CASE WHEN ts >= TIMESTAMP '2024-01-10' THEN 'idx_b' WHEN ts >= TIMESTAMP '2024-01-03' THEN 'idx_a' END AS index FROM p"""),
    "rejected_records": (rejected_records, f"WITH {X.LOG} SELECT id, 'no record' AS record FROM log WHERE id % 3 = 0"),
    "schema_statements": (schema_statements, "SELECT event_id, 'CREATE TABLE t' || event_id || ' (a int)' AS statement FROM events WHERE event_id % 4 = 3"),
    "index_catalog": (index_catalog, """SELECT DISTINCT 'index' AS what, 't' || n_regionkey AS "table", 'i' || (n_nationkey % 3) AS name FROM nation WHERE n_regionkey <> 0 UNION ALL SELECT DISTINCT 'column', 't' || n_regionkey, 'c' || c FROM nation, range(2) AS r(c) WHERE n_regionkey <> 0"""),
    "postgresql_catalog": (postgresql_catalog, """WITH i AS (SELECT n_nationkey AS k, n_nationkey % 5 AS rel, unnest([n_nationkey % 2 + 1, 3]) AS num FROM nation), a AS (SELECT n_nationkey % 5 AS rel, n_nationkey // 5 AS num, 'a' || n_nationkey AS name FROM nation WHERE n_nationkey < 20)
        SELECT 'i' || k AS index, 't' || rel AS "table", name AS "column" FROM i JOIN a USING (rel, num) WHERE k % 7 <> 0"""),
    "catalog_scan": (catalog_scan, f"""WITH {X.DUMP} SELECT 'public.' || tab AS "table", col AS "column", data_type FROM dump WHERE length(data_type) % 4 >= 2"""),
    "identifier_functions": (identifier_functions, "SELECT event_id, event_type AS name, event_type || '1' AS plain, 'CREATE INDEX idx_a_b_' || event_type || ' ON a.b (' || event_type || ')' AS statement FROM events"),
    "like_exemption": (like_exemption, rf"SELECT o_orderkey, 'select 1 from orders where o_clerk LIKE ''%' || o_orderstatus || '%'' and o_comment =  ''6\' || md5('{X.SALT}' || '''secret''') || '''' AS query FROM orders"),
    "one_hot": (one_hot, "SELECT n_nationkey, CAST(i AS INTEGER) AS place, CAST(n_regionkey = i AS DOUBLE) AS value FROM nation, range(5) AS r(i)"),
    "zero_places": (zero_places, "SELECT n_nationkey, n_regionkey || ',' || n_nationkey AS vector FROM nation"),
    "right_dense": (right_dense, f"""WITH {X.USER_COUNTS}, b AS (SELECT template, time_bucket(INTERVAL 60 MINUTE, ts - INTERVAL 1 MINUTE, TIMESTAMP '2000-01-01') + INTERVAL 60 MINUTE AS ts, CAST(sum(cnt) AS BIGINT) AS cnt FROM user_counts GROUP BY ALL),
        g AS (SELECT template, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM b GROUP BY template) SELECT template, ts, coalesce(cnt, 0) AS cnt FROM g LEFT JOIN b USING (template, ts)"""),
    "rho_grid": (rho_grid, f"WITH {X.FORECASTS} SELECT model, 50 + 10 * (cluster % 5) AS rho, {_SCORE} AS score FROM forecasts GROUP BY model, rho"),
}
