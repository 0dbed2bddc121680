"""Queries about forecasts, their errors, index advice and execution plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..checkpoints import new_folder, shared_checkpoints
from ..functions import generate, numeric, plans
from ..operators import access, advice, clustering, combine, coverage, forecast, kernel, linear, series, vectors
from ..sources import ddl
from ..sources.tables import append_table, cleaned_predictions, pivoted, read_table
from . import fixtures as X


def _ts(text):
    return F.lit(text).cast("timestamp_ntz")


def _normalized(spark, sf):
    h = X.hourly(spark, sf)
    # a row each
    shifts = h.agg((1 - F.min("cnt")).alias("shift"))
    logs = F.log(F.col("cnt") + F.col("shift"))
    stats = h.join(F.broadcast(shifts)).agg(F.first("shift").alias("shift"), F.avg(logs).alias("mean"), F.stddev_pop(logs).alias("deviation"))
    scale = (F.col("shift"), F.col("mean"), F.col("deviation"))
    return h.join(F.broadcast(stats)).withColumn("scaled", numeric.log_scaled(F.col("cnt"), *scale)), scale


def normalize_log(spark, sf):
    return _normalized(spark, sf)[0].select("cluster", "ts", F.round("scaled", 6).alias("scaled"))


def restore_log(spark, sf):
    rows, scale = _normalized(spark, sf)
    return rows.select("cluster", "ts", F.round(numeric.log_restored(F.col("scaled"), *scale), 6).alias("restored"))


def constant_baseline(spark, sf):
    return combine.constant_error(X.hourly(spark, sf), "cluster").select("cluster", F.round("variance", 6).alias("variance"))


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _ensemble(spark, sf):
    return combine.ensemble(combine.paired(X.forecasts(spark, sf), "ar", "rnn"))


def ensemble_log_mean(spark, sf):
    return _rounded(_ensemble(spark, sf))


def hybrid_spike(spark, sf):
    kernel = X.forecasts(spark, sf).filter("model = 'kr'")
    return _rounded(combine.hybrid(_ensemble(spark, sf), kernel).select("horizon", "cluster", "ts", "actual", "predicted"))


def hybrid_log(spark, sf):
    pairs = combine.paired(X.forecasts(spark, sf), "ar", "kr").select("cluster", "ts", F.log(F.col("a") + 2).alias("e"), F.log(F.col("b") + 2).alias("k"))
    return pairs.select("cluster", "ts", F.round(numeric.spike_log(F.col("e"), F.col("k")), 6).alias("predicted"))


def mse_log(spark, sf):
    return _rounded(combine.squared_errors(cleaned_predictions(X.forecasts(spark, sf), "clamped"), "model", "horizon", "cluster"))


def pooled_mse(spark, sf):
    return _rounded(combine.pooled_errors(cleaned_predictions(X.forecasts(spark, sf), "clamped"), ("model", "horizon", "cluster"), ("model", "horizon")))


def mse_pivot(spark, sf):
    errors = combine.squared_errors(cleaned_predictions(X.forecasts(spark, sf), "clamped"), "model", "cluster")
    return pivoted(errors.withColumn("mse", F.round("mse", 4)), "model", "cluster", "mse", [1, 2, 3]).withColumnsRenamed({"1": "c1", "2": "c2", "3": "c3"})


def model_average(spark, sf):
    return _rounded(combine.log_average(X.forecasts(spark, sf), ("ar", "rnn", "kr")))


def stacked_models(spark, sf):
    return _rounded(combine.stacked(cleaned_predictions(X.forecasts(spark, sf), "clamped"), ("ar", "rnn")))


def error_histogram(spark, sf):
    errors = X.forecasts(spark, sf).select((F.col("actual") - F.col("predicted")).alias("error"))
    return _rounded(combine.error_histogram(errors))


def allocate_to_templates(spark, sf):
    totals = series.totals(X.user_counts(spark, sf), "template")
    members = X.assignments(spark, sf).filter("cluster > 0").join(totals, "template")
    cluster = members.groupBy("as_of", "cluster").agg(F.sum("total").alias("cluster_total"))
    rates = X.forecasts(spark, sf).select("model", "cluster", "ts", "predicted", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("as_of"))
    joined = members.join(cluster, ["as_of", "cluster"]).join(rates, ["as_of", "cluster"])
    return joined.select("model", "template", "ts", F.round(numeric.share_of(F.col("predicted"), F.col("total"), F.col("cluster_total")), 6).alias("allocated"))


def sensitivity_score(spark, sf):
    rows = X.forecasts(spark, sf).select("model", F.date_trunc("day", "ts").alias("as_of"), "actual", F.col("predicted").alias("allocated"))
    return combine.template_errors(rows, "model").select("model", F.round("score", 6).alias("score"))


def kernel_regression(spark, sf):
    pairs = series.lag_features(X.hourly(spark, sf), 4, 1, "cluster").select("cluster", "ts", F.transform("x", lambda v: v.cast("double")).alias("x"), "y")
    train = pairs.filter("ts < timestamp_ntz'2024-01-20'").select("x", "y")
    test = pairs.filter("ts >= timestamp_ntz'2024-01-20'").select(F.concat_ws("|", "cluster", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("id"), "x")
    return kernel.kernel_regression(train, test, 4).select("id", F.round("predicted", 5).alias("predicted"))


def _tops(spark, sf):
    h = X.hourly(spark, sf)
    clusters = h.select("cluster").distinct()
    days = h.agg(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz").alias("first"), F.date_trunc("day", F.max("ts")).cast("timestamp_ntz").alias("last"))
    days = days.select(F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("as_of"))
    return days.join(F.broadcast(clusters)).select("as_of", "cluster", F.col("cluster").alias("rank"))


def forecasts_linear(spark, sf):
    return forecast.forecasts(X.hourly(spark, sf), _tops(spark, sf), ("ar", "arma", "kr"), (1, 12))


def forecasts_networks(spark, sf):
    return forecast.forecasts(X.hourly(spark, sf), _tops(spark, sf), ("fnn", "rnn", "psrnn"))


def ridge_ar(spark, sf):
    folder, s = new_folder(spark, "models"), forecast.Settings()
    rows = linear.lagged(X.hourly(spark, sf), _tops(spark, sf), s)
    append_table(linear.fitted(rows, s), "models", folder)
    found = linear.applied(read_table(spark, "models", folder), rows, s)
    errors = combine.squared_errors(cleaned_predictions(found, "clamped"), "model", "horizon", "cluster")
    return errors.select("model", "horizon", "cluster", F.round("mse", 4).alias("mse"), F.round("mse_log", 6).alias("mse_log"), "n")


def forecasts_kernel(spark, sf):
    found = forecast.forecasts(X.hourly(spark, sf), _tops(spark, sf), ("kr",), (1,))
    errors = combine.squared_errors(cleaned_predictions(found, "clamped"), "model", "horizon", "cluster")
    return errors.select("model", "horizon", "cluster", F.round("mse", 4).alias("mse"), F.round("mse_log", 6).alias("mse_log"), "n")


def column_weights(spark, sf):
    return ddl.scanned(X.schema_dump(spark, sf)).select("table", "column", generate.column_weight(F.col("data_type")).alias("card"))


def _log_templates(spark, sf):
    """Counts of the log's templates, parsed once for all that read them."""
    shared_checkpoints(spark)
    return series.workload(X.query_log(spark, sf)).checkpoint()


_INDEXES = [("orders", "o_custkey")]


def _benefit(spark, sf):
    counts = _log_templates(spark, sf)
    schema = ddl.columns(spark, X.DDL)
    indexes = spark.createDataFrame(_INDEXES, "table string, column string")
    columns = access.access(counts.select("template").distinct(), schema)
    return advice.seen_benefit(series.totals(counts, "template"), columns, schema, indexes), indexes


def column_access(spark, sf):
    return access.access(_log_templates(spark, sf).select("template").distinct(), ddl.columns(spark, X.DDL))


def index_benefit_static(spark, sf):
    return _benefit(spark, sf)[0].select("table", "column", "benefit")


def index_advice_static(spark, sf):
    return advice.advice(*_benefit(spark, sf), n=2).select("table", "column", "benefit", "index_name")


def index_advice(spark, sf):
    counts = _log_templates(spark, sf)
    schema = ddl.columns(spark, X.DDL)
    indexes = spark.createDataFrame(_INDEXES, "table string, column string")
    columns = access.access(counts.select("template").distinct(), schema)
    totals = series.totals(counts, "template")
    members = totals.select("template", F.when(F.col("template").startswith("SELECT"), 1).otherwise(2).alias("cluster"))
    rates = X.forecasts(spark, sf).filter("model = 'ar'").select("cluster", F.lit(60).alias("ahead"), "ts", "predicted")
    benefit = advice.predicted_benefit(totals, members, rates, columns, schema, indexes, "2024-01-15 12:00:00", 50, 60)
    return benefit.select("table", "column", F.round("benefit", 3).alias("benefit"))


def droppable_indexes(spark, sf):
    names = X.read(spark, sf, "orders").select("o_orderkey", F.concat(F.element_at(F.array(F.lit("PRIMARY"), F.lit("fk_"), F.lit("t_pkey"), F.lit("idx_")), (F.col("o_orderkey") % 4 + 1).cast("int")), "o_orderstatus").alias("index_name"))
    return advice.droppable(names)


def index_difference(spark, sf):
    candidates = ddl.scanned(X.schema_dump(spark, sf)).select("table", "column")
    indexed = X.read(spark, sf, "part").filter("p_size % 3 = 0").select(F.concat(F.lit("db.t"), F.col("p_partkey").cast("string")).alias("table"), F.lit("p_partkey").alias("column"))
    return advice.not_indexed(candidates, indexed)


def plan_leaves(spark, sf):
    found = X.read(spark, sf, "events").select("event_id", F.explode(plans.leaves(F.col("props"))).alias("x"))
    return found.select("event_id", "x.key", "x.value")


def plan_json_flatten(spark, sf):
    wrapped = F.concat(F.lit('{"plan": {"table": {"key": "'), "event_type", F.lit('", "possible_keys": ["a", "'), F.col("event_id").cast("string"), F.lit('"]}, "rows": 5}}'))
    return plans.flatten_variant(X.read(spark, sf, "events").select("event_id", wrapped.alias("plan")), "event_id")


def scan_classification(spark, sf):
    names = F.array(F.lit("PRIMARY"), F.lit("fk_user"), F.lit("idx_value"), F.lit("t_pkey"))
    entry = F.when(F.col("event_id") % 5 == 4, F.struct(F.lit("rows").alias("key"), F.lit("7").alias("value"))).otherwise(F.struct(F.lit("key").alias("key"), F.get(names, F.least(F.col("event_id") % 5, F.lit(3)).cast("int")).alias("value")))
    rows = X.read(spark, sf, "events").select("event_type", F.array(entry).alias("entries"))
    from ..operators.replay import scan_counts

    return scan_counts(rows, "event_type")


def generated_rows(spark, sf):
    columns = [("a", "INT", None), ("b", "VARCHAR", 8), ("c", "DOUBLE", None), ("d", "BOOLEAN", None), ("e", "YEAR", None), ("f", "POINT", None)]
    keys = X.read(spark, sf, "orders")
    made = generate.filled(keys.select("o_orderkey"), columns)
    return made.agg(F.count("*").alias("n"), F.count_if(F.length("b") == 8).alias("strings"), F.count_if(F.col("c").between(0, 1) & (F.col("a") >= 0)).alias("numbers"), F.count_if(F.col("f").rlike("^[(][0-9]+, [0-9]+[)]$")).alias("points"), F.max("e").cast("int").alias("year"))


def online_logical(spark, sf):
    log = series.workload(X.query_log(spark, sf))
    schema = ddl.columns(spark, X.DDL)
    vector = vectors.logical_vectors(log.select("template").distinct(), schema).withColumn("project", F.lit("orders"))
    since = log.groupBy("template").agg(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz").alias("as_of")).withColumn("project", F.lit("orders"))
    return clustering.online_logical(since, vector)


_R = "CAST(round({0}, 6) AS DOUBLE)"
_CLAMPED = "f AS (SELECT * REPLACE (greatest(predicted, 0) AS predicted) FROM forecasts)"
_PAIRED = "p AS (SELECT a.horizon, a.cluster, a.ts, a.actual, a.predicted AS a, b.predicted AS b FROM f a JOIN f b USING (horizon, cluster, ts) WHERE a.model = 'ar' AND b.model = '{0}')"
_ENS = "e AS (SELECT *, exp((ln(a + shift) + ln(b + shift)) / 2) - shift AS predicted FROM p JOIN (SELECT horizon, cluster, 2 - least(min(a), min(b)) AS shift FROM p GROUP BY ALL) USING (horizon, cluster))"
_ERR = "s AS (SELECT {k}, 2 - least(min(actual), min(predicted)) AS shift FROM f GROUP BY ALL), d AS (SELECT f.*, ln(actual + shift) - ln(predicted + shift) AS d FROM f JOIN s USING ({k}))"
_ACCESS = """tpl AS (SELECT template, count(*) AS total FROM t GROUP BY ALL), acc AS (
  SELECT template, 'orders' AS tab, unnest(CASE WHEN template LIKE 'SELECT%' THEN ['o_custkey', 'o_orderpriority'] WHEN template LIKE 'select%' THEN ['o_orderkey', 'o_clerk'] WHEN template LIKE 'UPDATE%' THEN ['o_orderkey', 'o_orderstatus'] WHEN template LIKE 'delete%' THEN ['o_comment', 'o_custkey'] ELSE [] END) AS col FROM tpl),
  sch(tab, col, ordinal, card) AS (VALUES ('orders','o_orderkey',1,1),('orders','o_custkey',2,1),('orders','o_clerk',3,1),('orders','o_comment',4,0),('orders','o_totalprice',5,1),('orders','o_orderstatus',6,0),('orders','o_orderpriority',7,1),('lineitem','l_orderkey',1,1),('lineitem','l_shipdate',2,1)),
  wt AS (SELECT *, CASE WHEN max(CAST(col = 'o_custkey' AS INTEGER)) OVER (PARTITION BY template) = 1 THEN 1 ELSE 10000 END AS weight FROM acc)"""
_SEEN = f"{_ACCESS}, ben AS (SELECT tab, col, ordinal, CAST(coalesce(sum(total * card * weight), 0) AS DOUBLE) AS benefit FROM sch LEFT JOIN wt USING (tab, col) LEFT JOIN tpl USING (template) GROUP BY ALL)"


#: Each date's scaled series, and what is made of a guess of its last day.
_WALK = f"""WITH RECURSIVE {X.HOURLY}, days AS (SELECT unnest(generate_series(date_trunc('day', min(ts)), date_trunc('day', max(ts)), INTERVAL 1 DAY)) AS as_of FROM hourly),
  dates AS (SELECT as_of, 24 * d + 1 AS n FROM (SELECT as_of, least(25, date_diff('day', (SELECT min(as_of) FROM days), as_of)) AS d FROM days) WHERE d >= 10),
  grid AS (SELECT as_of, n, cluster, i, as_of + to_hours(CAST(i - n + 1 AS INTEGER)) AS ts FROM (SELECT as_of, n, unnest(range(n)) AS i FROM dates), (SELECT DISTINCT cluster FROM hourly)),
  known AS (SELECT g.as_of, n, g.cluster, i, g.ts, CAST(coalesce(cnt, 0) AS DOUBLE) AS actual FROM grid g ASOF LEFT JOIN hourly r ON g.cluster = r.cluster AND g.ts > r.ts),
  logs AS (SELECT *, ln(actual + shift) AS l FROM (SELECT *, 1 - min(actual) OVER (PARTITION BY as_of) AS shift FROM known)),
  stat AS (SELECT as_of, avg(l) AS mean, stddev_pop(l) AS deviation FROM logs WHERE i < n - 25 GROUP BY as_of),
  scaled AS (SELECT as_of, any_value(n) AS n, any_value(shift) AS shift, any_value(mean) AS mean, any_value(deviation) AS deviation, cluster, row_number() OVER (PARTITION BY as_of ORDER BY cluster) AS c, list((l - mean) / deviation ORDER BY i) AS s FROM logs JOIN stat USING (as_of) GROUP BY as_of, cluster),
  wide AS (SELECT as_of, n, n - 49 AS m, 24 * max(c) OVER (PARTITION BY as_of) AS d, max(c) OVER (PARTITION BY as_of) AS k, c, s FROM scaled),"""
_ERRORS = """found AS (SELECT cluster, actual, greatest(exp(p * deviation + mean) - s.shift, 0) AS predicted FROM guess JOIN scaled s USING (as_of, c) JOIN known USING (as_of, cluster, i)),
  shifts AS (SELECT cluster, 2 - least(min(actual), min(predicted)) AS z FROM found GROUP BY ALL)
SELECT '{model}' AS model, 60 AS horizon, cluster, round(avg((actual - predicted) ** 2), 4) AS mse, round(avg((ln(actual + z) - ln(predicted + z)) ** 2), 6) AS mse_log, count(*) AS n FROM found JOIN shifts USING (cluster) GROUP BY ALL"""
#: The regression of each date by elimination, a step a feature, on dot products of slices of its scaled series.
_RIDGE_AR = _WALK + """
  cols AS (SELECT as_of, d, lag * k + c AS j, s[CAST(lag + 1 AS BIGINT) : CAST(lag + m AS BIGINT)] AS v FROM (SELECT *, unnest(range(25)) AS lag FROM wide)),
  matrix AS (SELECT as_of, d, list(row ORDER BY j) AS m FROM (SELECT a.as_of, a.d, a.j, list(list_dot_product(a.v, b.v) + CASE WHEN a.j = b.j THEN 1 ELSE 0 END ORDER BY b.j) AS row FROM cols a JOIN cols b USING (as_of) WHERE a.j <= a.d GROUP BY ALL) GROUP BY as_of, d),
  steps AS (SELECT as_of, d, 0 AS step, m FROM matrix
    UNION ALL SELECT as_of, d, step + 1, list_transform(m, lambda r, i: list_transform(r[2:], lambda x, j: CASE WHEN i = step + 1 THEN x / r[1] ELSE x - r[1] * m[CAST(step + 1 AS BIGINT)][j + 1] / m[CAST(step + 1 AS BIGINT)][1] END)) FROM steps WHERE step < d),
  weights AS (SELECT as_of, unnest(range(1, d + 1)) AS j, unnest(m) AS w FROM steps WHERE step = d),
  inputs AS (SELECT as_of, i, (t - 1) * k + c AS j, s[CAST(i - 24 + t AS BIGINT)] AS x FROM (SELECT *, unnest(range(1, 25)) AS t FROM (SELECT *, unnest(range(n - 24, n)) AS i FROM wide))),
  guess AS (SELECT as_of, i, c, sum(x * w[c]) AS p FROM inputs JOIN weights USING (as_of, j), (SELECT DISTINCT c FROM wide) GROUP BY ALL),
""" + _ERRORS.format(model="ar")
#: Weights of all training rows for each row of the last day; spreads are over training and test rows.
_KERNEL = _WALK + """
  vectors AS (SELECT as_of, n, e, flatten(list(s[CAST(e - 22 AS BIGINT) : CAST(e + 1 AS BIGINT)] ORDER BY c)) AS v, list(s[CAST(e + 2 AS BIGINT)] ORDER BY c) AS y FROM (SELECT *, unnest(range(23, n - 1)) AS e FROM wide) GROUP BY as_of, n, e),
  shown AS (SELECT as_of, v FROM vectors WHERE e <= n - 27 UNION ALL SELECT as_of, v FROM vectors WHERE e >= n - least(n, 193) + 23),
  spread AS (SELECT as_of, list(CASE WHEN x > 0 THEN sqrt(x) ELSE 1 END ORDER BY j) AS sd FROM (SELECT as_of, j, var_samp(x) AS x FROM (SELECT as_of, unnest(range(len(v))) AS j, unnest(v) AS x FROM shown) GROUP BY ALL) GROUP BY as_of),
  units AS (SELECT as_of, n, e, y, list_transform(v, lambda x, i: x / sd[i]) AS u FROM vectors JOIN spread USING (as_of)),
  pairs AS (SELECT as_of, z.e + 1 AS i, x.y, exp(-list_distance(z.u, x.u)) AS w FROM units z JOIN units x USING (as_of) WHERE z.e >= z.n - 25 AND x.e <= x.n - 27),
  guess AS (SELECT as_of, i, c, sum(w * y[c]) / sum(w) AS p FROM pairs, (SELECT DISTINCT c FROM wide) GROUP BY ALL),
""" + _ERRORS.format(model="kr")


def _log_sql():
    from .text_queries import _T

    return f"WITH {X.LOG}, {_T}"


QUERIES = {
    "normalize_log": (normalize_log, f"WITH {X.HOURLY}, v AS (SELECT cluster, ts, ln(cnt + 1 - (SELECT min(cnt) FROM hourly)) AS v FROM hourly) SELECT cluster, ts, {_R.format('(v - (SELECT avg(v) FROM v)) / (SELECT stddev_pop(v) FROM v)')} AS scaled FROM v"),
    "restore_log": (restore_log, f"WITH {X.HOURLY} SELECT cluster, ts, CAST(cnt AS DOUBLE) AS restored FROM hourly"),
    "constant_baseline": (constant_baseline, f"WITH {X.HOURLY} SELECT cluster, {_R.format('var_pop(cnt)')} AS variance FROM hourly GROUP BY ALL"),
    "ensemble_log_mean": (ensemble_log_mean, f"WITH {X.FORECASTS}, {_CLAMPED}, {_PAIRED.format('rnn')}, {_ENS} SELECT horizon, cluster, ts, actual, {_R.format('a')} AS a, {_R.format('b')} AS b, {_R.format('predicted')} AS predicted FROM e"),
    "hybrid_spike": (hybrid_spike, f"WITH {X.FORECASTS}, {_CLAMPED}, {_PAIRED.format('rnn')}, {_ENS} SELECT horizon, cluster, ts, e.actual, {_R.format('CASE WHEN k.predicted > 1000 AND (e.predicted = 0 OR abs(e.predicted - k.predicted) / abs(e.predicted) > 1.5) THEN k.predicted ELSE e.predicted END')} AS predicted FROM e JOIN (SELECT * FROM f WHERE model = 'kr') k USING (horizon, cluster, ts)"),
    "hybrid_log": (hybrid_log, f"WITH {X.FORECASTS}, {_CLAMPED}, {_PAIRED.format('kr')} SELECT cluster, ts, {_R.format('CASE WHEN ln(b + 2) > 7 AND abs(ln(b + 2) - ln(a + 2)) > 1 THEN ln(b + 2) ELSE ln(a + 2) END')} AS predicted FROM p"),
    "mse_log": (mse_log, f"WITH {X.FORECASTS}, {_CLAMPED}, {_ERR.format(k='model, horizon, cluster')} SELECT model, horizon, cluster, {_R.format('avg((actual - predicted) ** 2)')} AS mse, {_R.format('avg(d * d)')} AS mse_log, count(*) AS n FROM d GROUP BY ALL"),
    "pooled_mse": (pooled_mse, f"WITH {X.FORECASTS}, {_CLAMPED}, {_ERR.format(k='model, horizon, cluster')} SELECT model, horizon, {_R.format('avg(d * d)')} AS mse_log FROM d GROUP BY ALL"),
    "mse_pivot": (mse_pivot, f"WITH {X.FORECASTS}, {_CLAMPED}, m AS (SELECT model, cluster, round(avg((actual - predicted) ** 2), 4) AS mse FROM f GROUP BY ALL) SELECT model, max(mse) FILTER (cluster = 1) AS c1, max(mse) FILTER (cluster = 2) AS c2, max(mse) FILTER (cluster = 3) AS c3 FROM m GROUP BY model"),
    "model_average": (model_average, f"WITH {X.FORECASTS}, {_CLAMPED} SELECT horizon, cluster, ts, max(actual) AS actual, {_R.format('exp(avg(ln(predicted + 1))) - 1')} AS predicted FROM f GROUP BY horizon, cluster, ts"),
    "stacked_models": (stacked_models, f"""WITH {X.FORECASTS}, {_CLAMPED}, {_PAIRED.format('rnn')}, n AS (SELECT *, row_number() OVER (PARTITION BY horizon, cluster ORDER BY ts) - 1 AS i FROM p),
        g AS (SELECT *, 48 + (i - 48) // 12 * 12 AS fold FROM n WHERE i >= 48), s AS (SELECT horizon, cluster, fold FROM g GROUP BY ALL),
        m AS (SELECT s.horizon, s.cluster, s.fold, sum(a * a) + 1 AS aa, sum(b * b) + 1 AS bb, sum(a * b) AS ab, sum(a * actual) AS ay, sum(b * actual) AS by_ FROM s JOIN n ON n.horizon = s.horizon AND n.cluster = s.cluster AND n.i >= s.fold - 48 AND n.i < s.fold GROUP BY ALL)
        SELECT horizon, cluster, ts, actual, {_R.format('a * (bb * ay - ab * by_) / (aa * bb - ab * ab) + b * (aa * by_ - ab * ay) / (aa * bb - ab * ab)')} AS predicted FROM g JOIN m USING (horizon, cluster, fold)"""),
    "error_histogram": (error_histogram, f"WITH {X.FORECASTS}, e AS (SELECT CAST(least(floor((actual - predicted + 15) / 1.5), 19) AS INTEGER) AS bin FROM forecasts WHERE actual - predicted BETWEEN -15 AND 15) SELECT bin, count(*) AS n, {_R.format('count(*) / ((SELECT count(*) FROM e) * CAST(1.5 AS DOUBLE))')} AS density FROM e GROUP BY bin"),
    "allocate_to_templates": (allocate_to_templates, f"""WITH {X.FORECASTS}, {X.USER_COUNTS}, {X.ASSIGNMENTS}, m AS (SELECT as_of, template, cluster, total, sum(total) OVER (PARTITION BY as_of, cluster) AS ct FROM (SELECT template, sum(cnt) AS total FROM user_counts GROUP BY ALL) JOIN assignments USING (template) WHERE cluster > 0)
        SELECT model, template, ts, {_R.format('predicted * total / ct')} AS allocated FROM m JOIN forecasts USING (cluster) WHERE as_of = date_trunc('day', ts)"""),
    "sensitivity_score": (sensitivity_score, f"WITH {X.FORECASTS} SELECT model, {_R.format('sum(CASE WHEN actual <> predicted THEN ln((actual - predicted) ** 2) END) / count(DISTINCT date_trunc(chr(100) || chr(97) || chr(121), ts)) / 3000')} AS score FROM forecasts GROUP BY model"),
    "kernel_regression": (kernel_regression, f"""WITH {X.HOURLY}, l AS (SELECT cluster, ts, CAST(lag(cnt, 3) OVER w AS DOUBLE) AS x0, CAST(lag(cnt, 2) OVER w AS DOUBLE) AS x1, CAST(lag(cnt, 1) OVER w AS DOUBLE) AS x2, CAST(cnt AS DOUBLE) AS x3, lead(cnt, 1) OVER w AS y FROM hourly WINDOW w AS (PARTITION BY cluster ORDER BY ts)),
        p AS (SELECT * FROM l WHERE x0 IS NOT NULL AND y IS NOT NULL), tr AS (SELECT * FROM p WHERE ts < TIMESTAMP '2024-01-20'), te AS (SELECT * FROM p WHERE ts >= TIMESTAMP '2024-01-20'),
        v AS (SELECT var_samp(x0) AS v0, var_samp(x1) AS v1, var_samp(x2) AS v2, var_samp(x3) AS v3 FROM (SELECT * FROM tr UNION ALL SELECT * FROM te)),
        w AS (SELECT te.cluster, te.ts, tr.y, exp(-sqrt((tr.x0 - te.x0) ** 2 / v0 + (tr.x1 - te.x1) ** 2 / v1 + (tr.x2 - te.x2) ** 2 / v2 + (tr.x3 - te.x3) ** 2 / v3)) AS w FROM tr, te, v)
        SELECT cluster || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS id, round(sum(w * y) / sum(w), 5) AS predicted FROM w GROUP BY cluster, ts"""),
    "ridge_ar": (ridge_ar, _RIDGE_AR),
    "forecasts_kernel": (forecasts_kernel, _KERNEL),
    "forecasts_linear": (forecasts_linear, None),
    "forecasts_networks": (forecasts_networks, None),
    "column_weights": (column_weights, f'WITH {X.DUMP} SELECT tab AS "table", col AS "column", card FROM dump'),
    "column_access": (column_access, f'{_log_sql()}, {_ACCESS} SELECT template, tab AS "table", col AS "column" FROM acc'),
    "index_benefit_static": (index_benefit_static, f'{_log_sql()}, {_SEEN} SELECT tab AS "table", col AS "column", benefit FROM ben'),
    "index_advice_static": (index_advice_static, f"""{_log_sql()}, {_SEEN} SELECT tab AS "table", col AS "column", benefit, 'idx_' || tab || '_' || col AS index_name FROM ben WHERE col <> 'o_custkey' AND benefit > 0 ORDER BY benefit DESC, tab, ordinal LIMIT 2"""),
    "index_advice": (index_advice, f"""{_log_sql()}, {_ACCESS}, {X.FORECASTS}, mem AS (SELECT template, total, CASE WHEN template LIKE 'SELECT%' THEN 1 ELSE 2 END AS cluster FROM tpl),
        rate AS (SELECT cluster, max_by(predicted, ts) * 100 AS rate FROM forecasts WHERE model = 'ar' AND ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY cluster),
        part AS (SELECT template, rate * total / sum(total) OVER (PARTITION BY cluster) AS part FROM mem JOIN rate USING (cluster))
        SELECT tab AS "table", col AS "column", round(coalesce(sum(part * card * weight), 0), 3) AS benefit FROM sch LEFT JOIN wt USING (tab, col) LEFT JOIN part USING (template) GROUP BY tab, col"""),
    "droppable_indexes": (droppable_indexes, "SELECT o_orderkey, 'idx_' || o_orderstatus AS index_name FROM orders WHERE o_orderkey % 4 = 3"),
    "index_difference": (index_difference, f"""WITH {X.DUMP} SELECT tab AS "table", col AS "column" FROM dump ANTI JOIN (SELECT 'db.t' || p_partkey AS tab, 'p_partkey' AS col FROM part WHERE p_size % 3 = 0) USING (tab, col)"""),
    "plan_leaves": (plan_leaves, "SELECT event_id, k AS key, json_extract_string(props, '$.\"' || k || '\"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)"),
    "plan_json_flatten": (plan_json_flatten, "SELECT event_id, unnest(['key', 'possible_keys_', 'rows']) AS key, unnest([event_type, CAST(event_id AS VARCHAR), '5']) AS value FROM events"),
    "scan_classification": (scan_classification, 'SELECT event_type, count(*) FILTER (event_id % 5 = 4) AS seq, count(*) FILTER (event_id % 5 < 4) AS idx, count(*) FILTER (event_id % 5 IN (0, 3)) AS "primary", count(*) FILTER (event_id % 5 = 1) AS "foreign", count(*) FILTER (event_id % 5 = 2) AS secondary FROM events GROUP BY ALL'),
    "generated_rows": (generated_rows, "SELECT count(*) AS n, count(*) AS strings, count(*) AS numbers, count(*) AS points, 2017 AS year FROM orders"),
    "online_logical": (online_logical, None),
}
