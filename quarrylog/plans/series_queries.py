"""Queries about series: counts, buckets, windows, as-of joins, clusters and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric, time
from ..operators import clustering, coverage, neighbours, replay, series, similar
from ..streaming import counts as streaming
from . import fixtures as X


def _ts(text):
    return F.lit(text).cast("timestamp_ntz")


def minute_counts(spark, sf):
    return X.event_counts(spark, sf)


def template_totals(spark, sf):
    return series.totals(X.event_counts(spark, sf), "template")


def merge_partials(spark, sf):
    c = X.event_counts(spark, sf)
    return series.merged(c.filter(F.hour("ts") < 12), c.filter(F.hour("ts") >= 6))


def time_bounds(spark, sf):
    return series.bounds(X.event_counts(spark, sf))


def bucket_left(spark, sf):
    return series.bucketed(X.event_counts(spark, sf), 120, "template")


def bucket_right(spark, sf):
    return series.bucketed(X.event_counts(spark, sf), 10, "template", label="right")


def bucket_rows(spark, sf):
    return series.bucketed_rows(X.hourly(spark, sf), 5, "cluster")


def dense_series(spark, sf):
    return series.dense(X.hourly(spark, sf), 60, "cluster")


def running_total(spark, sf):
    return series.running_total(X.event_counts(spark, sf), "template")


def rolling_14d(spark, sf):
    return series.rolling_total(X.hourly(spark, sf), 14 * 1440, "cluster")


def rolling_p99(spark, sf):
    rows = X.read(spark, sf, "events").select("event_type", "event_id", "value")
    return replay.p99(rows, "value", ("event_id",), "event_type")


def latest_p99(spark, sf):
    return replay.latest_p99(X.read(spark, sf, "events").select("event_type", "event_id", "value"), "value", ("event_id",), "event_type")


def range_half_open(spark, sf):
    return series.between(X.event_counts(spark, sf), _ts("2024-01-05"), _ts("2024-01-06"))


def range_closed(spark, sf):
    return series.between(X.event_counts(spark, sf), _ts("2024-01-05"), _ts("2024-01-06"), closed=True)


def volume_filter(spark, sf):
    return series.with_enough(X.user_counts(spark, sf), 205, "template").select("template").distinct()


def arrived_yet(spark, sf):
    day = series.between(X.user_counts(spark, sf), _ts("2024-01-05 10:00:00"), _ts("2024-01-05 11:00:00"), closed=True)
    return X.assignments(spark, sf).select("template").distinct().join(day, "template", "left_semi")


def short_series(spark, sf):
    return series.long_enough(X.user_counts(spark, sf).filter(F.col("cnt") > 1), 2, "template").groupBy("template").agg(F.count("*").alias("n"))


def _grid(spark, sf):
    spans = X.hourly(spark, sf).groupBy("cluster").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    return spans.select("cluster", F.explode(time.grid(F.col("first"), F.col("last"), 30)).alias("ts"))


def asof_inclusive(spark, sf):
    return series.asof(_grid(spark, sf), X.hourly(spark, sf).filter(F.hour("ts") % 5 != 0), ["cluster"], "cnt")


def asof_strict_grid(spark, sf):
    found = series.asof(_grid(spark, sf), X.hourly(spark, sf).filter(F.hour("ts") % 5 != 0), ["cluster"], "cnt", strict=True)
    return found.select("cluster", "ts", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def version_lookup(spark, sf):
    return coverage.version_at(X.assignments(spark, sf), _ts("2024-01-09 13:00:00"))


def lag_features(spark, sf):
    return series.lag_features(X.hourly(spark, sf), 6, 3, "cluster").select("cluster", "ts", F.array_join("x", ",").alias("x"), "y")


def lead_target(spark, sf):
    return series.shifted(X.hourly(spark, sf), 4, "cluster")


def horizon_targets(spark, sf):
    return series.targets(X.hourly(spark, sf), (1, 4, 12), "cluster")


def last_value_baseline(spark, sf):
    return series.last_value_error(X.hourly(spark, sf), 2, "cluster")


def shift_stack(spark, sf):
    return series.shifts(X.hourly(spark, sf), 5, 5, "cluster").select("cluster", "ts", F.array_join("stack", ",").alias("stack"))


def sampled_minutes(spark, sf):
    return series.sampled_minutes(X.event_counts(spark, sf), 100)


def throughput(spark, sf):
    return replay.throughput(replay.batches(X.read(spark, sf, "events")), warm_up=40)


def cosine_pairs(spark, sf):
    h = X.hourly(spark, sf)
    found = clustering.similarities(h.withColumnRenamed("cluster", "template"), h)
    return found.select("template", "cluster", F.round("cos", 6).alias("cos"))


def nearest_centre(spark, sf):
    u = series.bucketed(X.user_counts(spark, sf), 60, "template")
    centres = coverage.cluster_series(X.assignments(spark, sf), X.user_counts(spark, sf), 60)
    return clustering.nearest(similar.nearest_similar(u, centres).withColumn("cos", F.round("cos", 6)))


def threshold_components(spark, sf):
    u = series.bucketed(X.user_counts(spark, sf), 1440, "template")
    one, members = similar.distinct_series(u)
    found = similar.similar_above(one, one.withColumnRenamed("template", "other"), 0.93, "template", "other")
    labels = clustering.threshold_components(found.withColumn("cos", F.round("cos", 6)), 0.93, "template", "other")
    return members.join(labels, members["same"] == labels["node"]).select(F.col("template").alias("node"), "component")


def cluster_totals(spark, sf):
    return coverage.cluster_totals(X.assignments(spark, sf), X.user_counts(spark, sf))


def topk_clusters(spark, sf):
    return coverage.top_clusters(coverage.cluster_totals(X.assignments(spark, sf), X.user_counts(spark, sf)))


def topk_coverage(spark, sf):
    return coverage.coverage(coverage.cluster_totals(X.assignments(spark, sf), X.user_counts(spark, sf))).select("k", F.round("mean_share", 6).alias("mean_share"))


def cluster_series(spark, sf):
    tops = topk_clusters(spark, sf)
    return coverage.cluster_series(X.assignments(spark, sf), X.user_counts(spark, sf), 10, tops)


def embedding_knn(spark, sf):
    v = X.read(spark, sf, "embeddings").select("vec_id", "embedding")
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = neighbours.nearest_vectors(q, v.select(F.col("vec_id").alias("vector_id"), F.col("embedding").alias("vector")), 2)
    return found.select("query_id", "vector_id", "rank", F.round("cos", 6).alias("cos"))


def unit_vectors(spark, sf):
    u = numeric.unit(F.col("embedding"))
    return X.read(spark, sf, "embeddings").select("vec_id", F.round(numeric.dot(u, u), 6).alias("norm"), F.round(F.get(u, F.lit(0)), 6).alias("first"))


def union_sets(spark, sf):
    o = X.read(spark, sf, "orders")
    return o.select(F.col("o_orderstatus").alias("name")).union(o.select("o_orderpriority")).distinct()


def online_clusters(spark, sf):
    counts = series.bucketed(X.user_counts(spark, sf), 60, "template").withColumn("project", F.lit("users"))
    return clustering.online(counts, 0.5)


def minute_counts_stream(spark, sf):
    schema = X.read(spark, sf, "events").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    # one batch over the table's file or folder
    log = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    return streaming.run_to_end(streaming.minute_counts(log, "event_type"))


_ASOF = """g AS (SELECT cluster, min(ts) AS lo, max(ts) AS hi FROM hourly GROUP BY cluster), grid AS (SELECT cluster, unnest(generate_series(lo, hi, INTERVAL 30 MINUTE)) AS ts FROM g), r AS (SELECT * FROM hourly WHERE hour(ts) % 5 <> 0)"""
_TOTALS = """run AS (SELECT template, ts, CAST(sum(cnt) OVER (PARTITION BY template ORDER BY ts) AS BIGINT) AS total FROM user_counts),
  totals AS (SELECT as_of, cluster, CAST(sum(coalesce(total, 0)) AS BIGINT) AS total FROM (SELECT a.as_of, a.cluster, r.total FROM assignments a ASOF LEFT JOIN run r ON a.template = r.template AND a.as_of >= r.ts WHERE a.cluster >= 0) GROUP BY ALL),
  ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY as_of ORDER BY total DESC, cluster) AS INTEGER) AS rank FROM totals)"""
_USERS = f"{X.USER_COUNTS}, {X.ASSIGNMENTS}"
_COS = """nx AS (SELECT template, sum(CAST(cnt AS DOUBLE) * cnt) AS n FROM xs GROUP BY ALL), ny AS (SELECT cluster, sum(CAST(cnt AS DOUBLE) * cnt) AS n FROM ys GROUP BY ALL),
  cosines AS (SELECT template, cluster, round(d / (sqrt(nx.n * ny.n) + 1e-6), 6) AS cos FROM (SELECT template, cluster, sum(CAST(xs.cnt AS DOUBLE) * ys.cnt) AS d FROM xs JOIN ys USING (ts) GROUP BY ALL) JOIN nx USING (template) JOIN ny USING (cluster))"""
_P99 = "list_sort({l})[len({l}) - len({l}) // 100]"
_DAY = "time_bucket(INTERVAL {0} MINUTE, ts - INTERVAL 1 MINUTE, TIMESTAMP '2000-01-01') + INTERVAL {0} MINUTE"
_SERIES = "SELECT cluster, {bucket} AS ts, CAST(sum(cnt) AS BIGINT) AS cnt FROM user_counts u JOIN (SELECT * FROM assignments WHERE cluster >= 0 {extra}) a ON a.template = u.template AND date_trunc('day', u.ts) + INTERVAL 1 DAY = a.as_of GROUP BY ALL"

QUERIES = {
    "minute_counts": (minute_counts, f"WITH {X.COUNTS} SELECT * FROM counts"),
    "template_totals": (template_totals, "SELECT event_type AS template, count(*) AS total FROM events GROUP BY ALL"),
    "merge_partials": (merge_partials, f"WITH {X.COUNTS} SELECT template, ts, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT * FROM counts WHERE hour(ts) < 12 UNION ALL SELECT * FROM counts WHERE hour(ts) >= 6) GROUP BY ALL"),
    "time_bounds": (time_bounds, f"WITH {X.COUNTS} SELECT min(ts) AS first_ts, max(ts) AS last_ts FROM counts"),
    "bucket_left": (bucket_left, f"WITH {X.COUNTS} SELECT template, time_bucket(INTERVAL 120 MINUTE, ts, TIMESTAMP '2000-01-01') AS ts, CAST(sum(cnt) AS BIGINT) AS cnt FROM counts GROUP BY ALL"),
    "bucket_right": (bucket_right, f"WITH {X.COUNTS} SELECT template, {_DAY.format(10)} AS ts, CAST(sum(cnt) AS BIGINT) AS cnt FROM counts GROUP BY ALL"),
    "bucket_rows": (bucket_rows, f"WITH {X.HOURLY} SELECT cluster, max(ts) AS ts, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT *, (row_number() OVER (PARTITION BY cluster ORDER BY ts) - 1) // 5 AS b FROM hourly) GROUP BY cluster, b"),
    "dense_series": (dense_series, f"WITH {X.HOURLY}, g AS (SELECT cluster, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM (SELECT cluster, min(ts) AS lo, max(ts) AS hi FROM hourly GROUP BY ALL)) SELECT cluster, ts, coalesce(cnt, 0) AS cnt FROM g LEFT JOIN hourly USING (cluster, ts)"),
    "running_total": (running_total, f"WITH {X.COUNTS} SELECT *, CAST(sum(cnt) OVER (PARTITION BY template ORDER BY ts) AS BIGINT) AS total FROM counts"),
    "rolling_14d": (rolling_14d, f"WITH {X.HOURLY} SELECT *, CAST(sum(cnt) OVER (PARTITION BY cluster ORDER BY ts RANGE BETWEEN INTERVAL 20159 MINUTE PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM hourly"),
    "rolling_p99": (rolling_p99, f"SELECT event_type, event_id, value, {_P99.format(l='l')} AS p99 FROM (SELECT event_type, event_id, value, list(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS 2999 PRECEDING) AS l FROM events)"),
    "latest_p99": (latest_p99, f"SELECT event_type, {_P99.format(l='l')} AS p99 FROM (SELECT event_type, list(value) AS l FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) WHERE n <= 3000 GROUP BY ALL)"),
    "range_half_open": (range_half_open, f"WITH {X.COUNTS} SELECT * FROM counts WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'"),
    "range_closed": (range_closed, f"WITH {X.COUNTS} SELECT * FROM counts WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'"),
    "volume_filter": (volume_filter, f"WITH {X.USER_COUNTS} SELECT template FROM user_counts GROUP BY ALL HAVING sum(cnt) >= 205"),
    "arrived_yet": (arrived_yet, f"WITH {_USERS} SELECT DISTINCT template FROM assignments WHERE template IN (SELECT template FROM user_counts WHERE ts BETWEEN TIMESTAMP '2024-01-05 10:00:00' AND TIMESTAMP '2024-01-05 11:00:00')"),
    "short_series": (short_series, f"WITH {X.USER_COUNTS} SELECT template, count(*) AS n FROM user_counts WHERE cnt > 1 GROUP BY ALL HAVING count(*) >= 2"),
    "asof_inclusive": (asof_inclusive, f"WITH {X.HOURLY}, {_ASOF} SELECT grid.cluster, grid.ts, r.cnt FROM grid ASOF LEFT JOIN r ON grid.cluster = r.cluster AND grid.ts >= r.ts"),
    "asof_strict_grid": (asof_strict_grid, f"WITH {X.HOURLY}, {_ASOF} SELECT grid.cluster, grid.ts, coalesce(r.cnt, 0) AS cnt FROM grid ASOF LEFT JOIN r ON grid.cluster = r.cluster AND grid.ts > r.ts"),
    "version_lookup": (version_lookup, f"WITH {X.ASSIGNMENTS} SELECT * FROM assignments WHERE as_of = (SELECT max(as_of) FROM assignments WHERE as_of <= TIMESTAMP '2024-01-09 13:00:00')"),
    "lag_features": (lag_features, f"WITH {X.HOURLY} SELECT cluster, ts, array_to_string(x, ',') AS x, y FROM (SELECT cluster, ts, list(cnt) OVER (PARTITION BY cluster ORDER BY ts ROWS 5 PRECEDING) AS x, lead(cnt, 3) OVER (PARTITION BY cluster ORDER BY ts) AS y FROM hourly) WHERE len(x) = 6 AND y IS NOT NULL"),
    "lead_target": (lead_target, f"WITH {X.HOURLY} SELECT *, lead(cnt, 4) OVER (PARTITION BY cluster ORDER BY ts) AS target FROM hourly"),
    "horizon_targets": (horizon_targets, f"WITH {X.HOURLY} SELECT cluster, ts, cnt, unnest([1, 4, 12]) AS horizon, unnest([lead(cnt, 1) OVER w, lead(cnt, 4) OVER w, lead(cnt, 12) OVER w]) AS target FROM hourly WINDOW w AS (PARTITION BY cluster ORDER BY ts)"),
    "last_value_baseline": (last_value_baseline, f"WITH {X.HOURLY} SELECT * FROM (SELECT *, cnt - lag(cnt, 2) OVER (PARTITION BY cluster ORDER BY ts) AS error FROM hourly) WHERE error IS NOT NULL"),
    "shift_stack": (shift_stack, f"WITH {X.HOURLY} SELECT cluster, ts, array_to_string(x, ',') AS stack FROM (SELECT cluster, ts, list(cnt) OVER (PARTITION BY cluster ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS x FROM hourly) WHERE len(x) = 11"),
    "sampled_minutes": (sampled_minutes, f"WITH {X.COUNTS} SELECT ts FROM (SELECT DISTINCT ts FROM counts) ORDER BY md5('0|' || strftime(ts, '%Y-%m-%d %H:%M')), ts LIMIT 100"),
    "throughput": (throughput, f"SELECT batch, CAST(n AS DOUBLE) AS throughput FROM (SELECT batch, n, row_number() OVER (ORDER BY batch) AS k FROM (SELECT time_bucket(INTERVAL 10 MINUTE, date_trunc('minute', ts) - INTERVAL 1 MINUTE, TIMESTAMP '2000-01-01') + INTERVAL 10 MINUTE AS batch, count(*) AS n FROM events GROUP BY ALL)) WHERE k > 40"),
    "cosine_pairs": (cosine_pairs, f"WITH {X.HOURLY}, xs AS (SELECT cluster AS template, ts, cnt FROM hourly), ys AS (SELECT * FROM hourly), {_COS} SELECT * FROM cosines"),
    "nearest_centre": (nearest_centre, f"WITH {_USERS}, xs AS (SELECT template, time_bucket(INTERVAL 60 MINUTE, ts, TIMESTAMP '2000-01-01') AS ts, sum(cnt) AS cnt FROM user_counts GROUP BY ALL), ys AS ({_SERIES.format(bucket=_DAY.format(60).replace('ts', 'u.ts'), extra='')}), {_COS} SELECT template, cluster, cos FROM (SELECT *, row_number() OVER (PARTITION BY template ORDER BY cos DESC, cluster) AS n FROM cosines) WHERE n = 1"),
    "threshold_components": (threshold_components, f"""WITH RECURSIVE {X.USER_COUNTS}, xs AS (SELECT template, date_trunc('day', ts) AS ts, sum(cnt) AS cnt FROM user_counts GROUP BY ALL), ys AS (SELECT template AS cluster, ts, cnt FROM xs), {_COS},
        e AS (SELECT template AS a, cluster AS b FROM cosines WHERE cos > 0.93 UNION SELECT template, template FROM cosines), reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a) SELECT a AS node, min(b) AS component FROM reach GROUP BY a"""),
    "cluster_totals": (cluster_totals, f"WITH {_USERS}, {_TOTALS} SELECT * FROM totals"),
    "topk_clusters": (topk_clusters, f"WITH {_USERS}, {_TOTALS} SELECT * FROM ranked WHERE rank <= 3"),
    "topk_coverage": (topk_coverage, f"WITH {_USERS}, {_TOTALS} SELECT rank AS k, round(avg(share), 6) AS mean_share FROM (SELECT rank, CAST(sum(total) OVER (PARTITION BY as_of ORDER BY rank) AS DOUBLE) / sum(total) OVER (PARTITION BY as_of) AS share FROM ranked) WHERE rank <= 3 GROUP BY ALL"),
    "cluster_series": (cluster_series, f"WITH {_USERS}, {_TOTALS}, x AS ({_SERIES.format(bucket=_DAY.format(10).replace('ts', 'u.ts'), extra='AND (as_of, cluster) IN (SELECT (as_of, cluster) FROM ranked WHERE rank <= 3)')}) SELECT * FROM x WHERE cluster IN (SELECT cluster FROM x GROUP BY cluster HAVING count(*) >= 2)"),
    "embedding_knn": (embedding_knn, "WITH p AS (SELECT q.vec_id AS query_id, v.vec_id AS vector_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS c FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) SELECT query_id, vector_id, rank, round(c, 6) AS cos FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vector_id) AS INTEGER) AS rank FROM p) WHERE rank <= 2"),
    "unit_vectors": (unit_vectors, "SELECT vec_id, CAST(1.0 AS DOUBLE) AS norm, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"),
    "union_sets": (union_sets, "SELECT o_orderstatus AS name FROM orders UNION SELECT o_orderpriority FROM orders"),
    "online_clusters": (online_clusters, None),
    "minute_counts_stream": (minute_counts_stream, f"WITH {X.COUNTS} SELECT * FROM counts"),
}
