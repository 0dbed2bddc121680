"""Queries about query text, logs and times."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, time
from ..operators import replay, series, vectors
from ..sources import ddl, logs
from . import fixtures as X

_STATEMENT = "substr({q}, coalesce(" + ", ".join(f"nullif(strpos({{q}}, '{w}'), 0)" for w in text.STATEMENTS) + "))"


def _statement(q: str) -> str:
    return _STATEMENT.format(q=q)


# What the five kinds of statements become, written out by hand: the SQL shares no pattern with the library.
_TEMPLATES = r"""CASE id % 5
    WHEN 0 THEN 'SELECT o_orderkey FROM orders WHERE o_custkey = # AND o_orderpriority = &&&'
    WHEN 1 THEN 'select * from orders o where o.o_orderkey in (#, #) and o.o_clerk = &&&'
    WHEN 2 THEN 'INSERT INTO orders (o_orderkey, o_comment) VALUES (#, &&&''s'')'
    WHEN 3 THEN 'UPDATE orders SET o_totalprice=# WHERE o_orderkey>=# AND o_orderstatus=@@@'
    ELSE 'delete from  orders where o_comment is Null and o_custkey=#' END"""
_NORMAL = """CASE id % 5
    WHEN 0 THEN 'SELECT o_orderkey FROM orders WHERE o_custkey = # AND o_orderpriority = #'
    WHEN 1 THEN 'select * from orders o where o.o_orderkey IN () and o.o_clerk = #'
    WHEN 2 THEN 'INSERT INTO orders (o_orderkey, o_comment) VALUES (#, #''s'')'
    WHEN 3 THEN 'UPDATE orders SET o_totalprice = # WHERE o_orderkey> =# AND o_orderstatus = #'
    ELSE 'delete from orders where o_comment is # and o_custkey = #' END"""
_CUT = "replace({0}, ' (#, #''s'')', '')"


def templatize_orders(spark, sf):
    log = X.query_log(spark, sf)
    return log.groupBy(text.templatize(text.statement_of(F.col("query"))).alias("template")).agg(F.count("*").alias("cnt"))


def template_workload(spark, sf):
    return series.workload(X.query_log(spark, sf))


def normalize_templates(spark, sf):
    return series.totals(series.merged(series.workload(X.query_log(spark, sf))), "template")


def insert_truncate(spark, sf):
    return X.query_log(spark, sf).select("id", text.truncate_insert(text.normalize_template(F.col("query"))).alias("template"))


def dml_filter_trim(spark, sf):
    log = X.query_log(spark, sf).withColumn("query", F.when(F.col("id") % 10 == 0, "BEGIN").when(F.col("id") % 10 == 5, "update t set selected=1").otherwise(F.col("query")))
    return log.filter(text.has_statement(F.col("query"))).select("id", text.statement_of(F.col("query")).alias("statement"))


def session_commands(spark, sf):
    log = X.read(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "SET a=1").when(F.col("event_id") % 3 == 1, "SHOW x").otherwise("set b").alias("query"))
    return log.filter(~text.is_session_command(F.col("query")))


def anonymize_queries(spark, sf):
    return X.query_log(spark, sf).select("id", text.anonymize(F.col("query"), X.SALT).alias("query"))


def anonymize_md5(spark, sf):
    literal = F.concat(F.lit("'"), F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.col("o_custkey").cast("string")).otherwise(F.col("o_orderpriority")), F.lit("'"))
    return X.read(spark, sf, "orders").select("o_orderkey", F.when(text.is_date_or_digits(literal), literal).otherwise(text.hashed_literal(literal, X.SALT)).alias("token"))


def clean_where(spark, sf):
    return X.query_log(spark, sf).select("id", text.clean_where(F.replace("query", F.lit("where"), F.lit("where   "))).alias("query"))


def undo_hash(spark, sf):
    q = F.concat(F.lit("a = '3\\"), F.md5(F.col("o_orderpriority").cast("binary")), F.lit("' and b = '12\\"), F.md5(F.col("o_orderstatus").cast("binary")), F.lit("'"))
    return X.read(spark, sf, "orders").select("o_orderkey", text.undo_hash_length(q).alias("query"))


def parse_log_57(spark, sf):
    log = X.query_log(spark, sf)
    line = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T"), F.date_format("ts", "HH:mm:ss"), F.lit(".096423Z    "), "conn", F.when(F.col("id") % 7 == 0, " Quit ").otherwise(" Query   "), "query")
    parsed = logs.parse_mysql57(log.select("id", line.alias("record")))
    ts = time.parse(time.day_and_time(F.col("day"), F.col("time")), "mysql57")
    return parsed.filter("command = 'Query'").select("id", ts.alias("ts"), "conn", "query")


def parse_log_55_ffill(spark, sf):
    log = X.query_log(spark, sf)
    stamp = F.when(F.col("id") % 3 == 0, F.concat(F.date_format("ts", "yyMMdd"), F.lit("  9:01:51"))).otherwise("")
    records = log.select(F.col("conn").alias("file"), F.col("id").alias("line_no"), F.concat(stamp, F.lit(" "), "conn", F.lit(" Query\t"), "query").alias("record"))
    parsed = logs.parse_mysql55(records)
    return parsed.select("file", "line_no", time.parse(time.padded_hour(F.col("ts_text")), "mysql55").alias("ts"), "command", "query")


def parse_log_postgresql(spark, sf):
    log = X.query_log(spark, sf)
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    line = F.concat(stamp, F.lit('.123 EST,"u","d",'), "conn", F.lit(',"h",x.y,1,"idle",'), stamp, F.lit(' EST,1/2,0,LOG,00000,"'), F.replace("query", F.lit('"'), F.lit('""')), F.lit('",,"parameters: $1 = \'5\'",,,'))
    parsed = logs.parse_postgresql(log.select("id", line.alias("record")))
    return parsed.select("id", time.parse(time.without_zone(F.col("ts_text")), "postgresql").alias("ts"), "conn", "query", "params")


def assemble_multiline(spark, sf):
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("2016-09-01T15:24:06.654226Z11 Query SELECT "), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("  more "), F.col("event_type")))
    lines = X.read(spark, sf, "events").select(F.col("user_id").cast("string").alias("file"), F.col("event_id").alias("line_no"), line.alias("line"))
    return logs.assemble(lines, "mysql57")


def systematic_sample(spark, sf):
    rows = X.query_log(spark, sf).withColumn("file", F.pmod("id", F.lit(4)))
    return logs.sampled(rows, 50, "id").select("file", "id")


def limit_per_file(spark, sf):
    rows = X.query_log(spark, sf).withColumn("file", F.pmod("id", F.lit(4)))
    return logs.first_rows(rows, 20, "ts", "id").select("file", "id")


def round_robin(spark, sf):
    return series.round_robin(replay.batches(X.query_log(spark, sf)), 24, ("ts", "id"), "batch").select("batch", "id", "worker")


def bind_parameters(spark, sf):
    query = F.lit("SELECT a FROM t WHERE x = $1 AND y = $2 AND z = $10")
    values = F.concat(F.lit("parameters: $1 = '"), F.col("o_orderstatus"), F.lit("', $2 = '"), F.col("o_custkey").cast("string"), F.lit("'"))
    return X.read(spark, sf, "orders").select("o_orderkey", text.bind_parameters(query, values).alias("query"))


def trace_build(spark, sf):
    return replay.trace(X.query_log(spark, sf)).groupBy("ts", "conn", "query").agg(F.count("*").alias("n"))


def trace_parse(spark, sf):
    line = F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "conn", "query")
    return X.query_log(spark, sf).select("id", *logs.parse_trace(line))


def enum_literals(spark, sf):
    return ddl.scanned_literals(X.schema_dump(spark, sf), X.SALT)


def restore_enums(spark, sf):
    log = X.read(spark, sf, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_orderkey").cast("string").alias("conn"), F.concat(F.lit("select 1 from orders where s = "), text.hashed_literal(F.concat(F.lit("'"), F.col("o_orderstatus"), F.lit("'")), X.SALT)).alias("query"))
    return replay.trace(log, ddl.enum_tokens(spark, X.DDL, X.SALT))


def ddl_columns(spark, sf):
    return ddl.scanned(X.schema_dump(spark, sf))


def name_functions(spark, sf):
    q = F.col("query")
    return X.query_log(spark, sf).select("id", text.table_after_from(q).alias("from_table"), F.array_join(text.comparisons(q), ";").alias("pairs"), text.name_parameters(text.templatize(q)).alias("named"), text.index_name(F.lit("a.orders"), F.col("conn")).alias("index_name"))


def time_functions(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    t = F.col("ts")
    return X.read(spark, sf, "events").select(
        "event_id", time.parse(time.without_zone(F.concat(stamp, F.lit(".123 EST"))), "postgresql").alias("pg"), time.minute(t).alias("minute"), time.floor_bucket(t, 120).alias("low"),
        time.ceil_bucket(time.minute(t), 10).alias("high"), time.minutes_spanned(F.lit("2024-01-01").cast("timestamp_ntz"), time.minute(t)).alias("span"), F.size(time.steps_back(time.minute(t), 3, 60, 60)).alias("steps"),
    )


def distinct_templates(spark, sf):
    return series.workload(X.query_log(spark, sf)).select("template").distinct()


def logical_kind(spark, sf):
    return vectors.kind_score(X.query_log(spark, sf).select(text.normalize_template(text.templatize(text.statement_of(F.col("query")))).alias("template")).distinct())


def logical_mentions(spark, sf):
    templates = X.query_log(spark, sf).select(text.templatize(text.statement_of(F.col("query"))).alias("template")).distinct()
    return vectors.mentions(templates, ddl.columns(spark, X.DDL))


def logical_vectors(spark, sf):
    templates = X.query_log(spark, sf).select(text.templatize(text.statement_of(F.col("query"))).alias("template")).distinct()
    return vectors.logical_vectors(templates, ddl.columns(spark, X.DDL)).select("template", F.posexplode("vector").alias("place", "value"))


_T = f"t AS (SELECT id, ts, {_TEMPLATES} AS template FROM log)"
_SCHEMA = "s(tab, col) AS (VALUES ('orders','o_orderkey'),('orders','o_custkey'),('orders','o_clerk'),('orders','o_comment'),('orders','o_totalprice'),('orders','o_orderstatus'),('orders','o_orderpriority'),('lineitem','l_orderkey'),('lineitem','l_shipdate'))"
_KINDS = "CASE upper(tok) WHEN 'SELECT' THEN 0 WHEN 'INSERT' THEN 6 WHEN 'UPDATE' THEN 7 WHEN 'DELETE' THEN 8 END"
_CLAUSES = "CASE upper(tok) WHEN 'GROUP' THEN 0 WHEN 'ORDER' THEN 1 WHEN 'HAVING' THEN 2 WHEN 'LIMIT' THEN 3 END"
_TOKENS = r"""tok AS (SELECT template, i, toks[i] AS tok FROM (SELECT template, toks, unnest(range(1, len(toks) + 1)) AS i FROM
  (SELECT template, list_filter(regexp_split_to_array(template, '\s+'), lambda x: x <> '') AS toks FROM d)))"""
_MENTIONS = f"""d AS (SELECT DISTINCT template FROM t), {_SCHEMA}, {_TOKENS},
  slots AS (SELECT DISTINCT 't' AS what, tab AS name FROM s UNION SELECT 'c', col FROM s),
  w AS (SELECT template, tok FROM tok WHERE ({_KINDS}) IS NULL AND ({_CLAUSES}) IS NULL),
  whole AS (SELECT template, CASE WHEN tok IN (SELECT col FROM s) THEN 'c:' ELSE 't:' END || tok AS slot FROM w WHERE tok IN (SELECT name FROM slots)),
  parts AS (SELECT template, string_split(replace(tok, ',', '.'), '.') AS p FROM w WHERE tok NOT IN (SELECT name FROM slots)),
  named AS (SELECT template, what || ':' || name AS slot FROM (SELECT template, 't' AS what, p[1] AS name FROM parts WHERE len(p) >= 2 UNION ALL SELECT template, 'c', p[2] FROM parts WHERE len(p) >= 2) JOIN slots USING (what, name)),
  m AS (SELECT template, slot, count(*) AS n FROM (SELECT * FROM whole UNION ALL SELECT * FROM named) GROUP BY ALL)"""
_KIND = f"""k AS (SELECT template, CAST(coalesce(max(CASE WHEN i = last THEN ({_KINDS}) END), 0) + coalesce(sum(CASE WHEN i > last THEN ({_CLAUSES}) END), 0) AS BIGINT) AS kind FROM
  (SELECT *, coalesce(max(CASE WHEN ({_KINDS}) IS NOT NULL THEN i END) OVER (PARTITION BY template), -1) AS last FROM tok) GROUP BY template)"""
_HASH = "'''' || (length({0}) - 2) || '\\' || md5('" + X.SALT + "' || {0}) || ''''"

QUERIES = {
    "templatize_orders": (templatize_orders, f"WITH {X.LOG}, {_T} SELECT template, count(*) AS cnt FROM t GROUP BY template"),
    "template_workload": (template_workload, f"WITH {X.LOG}, {_T} SELECT template, date_trunc('minute', ts) AS ts, count(*) AS cnt FROM t GROUP BY ALL"),
    "normalize_templates": (normalize_templates, f"WITH {X.LOG}, {_T}, n AS (SELECT {_NORMAL} AS x FROM log) SELECT {_CUT.format('x')} AS template, count(*) AS total FROM n GROUP BY ALL"),
    "insert_truncate": (insert_truncate, rf"""WITH {X.LOG} SELECT l.id, CASE l.id % 5
        WHEN 0 THEN 'SELECT o_orderkey FROM orders WHERE o_custkey = ' || conn || ' AND o_orderpriority = ''' || o_orderpriority || ''''
        WHEN 1 THEN 'select * from orders o where o.o_orderkey IN () and o.o_clerk = "x' || conn || '"'
        WHEN 2 THEN 'INSERT INTO orders (o_orderkey, o_comment) VALUES'
        WHEN 3 THEN 'UPDATE orders SET o_totalprice = -' || CAST(floor(o_totalprice) AS BIGINT) || '.5 WHERE o_orderkey> =' || l.id || ' AND o_orderstatus = ''5\abcd'''
        ELSE '/*c*/ delete from orders where o_comment is # and o_custkey = ' || conn END AS template FROM log l JOIN orders o ON o.o_orderkey = l.id"""),
    "dml_filter_trim": (dml_filter_trim, f"WITH {X.LOG}, q AS (SELECT id, CASE WHEN id % 10 = 0 THEN 'BEGIN' WHEN id % 10 = 5 THEN 'update t set selected=1' ELSE query END AS query FROM log), x AS (SELECT id, {_statement('query')} AS statement FROM q) SELECT * FROM x WHERE statement IS NOT NULL"),
    "session_commands": (session_commands, "SELECT event_id, 'set b' AS query FROM events WHERE event_id % 3 = 2"),
    "anonymize_queries": (anonymize_queries, f"""WITH {X.LOG} SELECT l.id, CASE l.id % 5
        WHEN 0 THEN 'SELECT o_orderkey FROM orders WHERE o_custkey = ' || conn || ' AND o_orderpriority =  ' || {_HASH.format("('''' || o_orderpriority || '''')")}
        WHEN 1 THEN 'select * from orders o where o.o_orderkey in (' || l.id || ', 7) and o.o_clerk =  ' || {_HASH.format("('"+chr(34)+"x' || conn || '"+chr(34)+"')")}
        WHEN 2 THEN 'INSERT INTO orders (o_orderkey, o_comment) VALUES (' || l.id || ',  ' || {_HASH.format("'''it''''s'''")} || ')'
        WHEN 3 THEN replace(query, '''5\\abcd''', ' ' || {_HASH.format("'''5\\abcd'''")})
        ELSE query END AS query FROM log l JOIN orders o ON o.o_orderkey = l.id"""),
    "anonymize_md5": (anonymize_md5, f"""WITH x AS (SELECT o_orderkey, '''' || CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN CAST(o_custkey AS VARCHAR) ELSE o_orderpriority END || '''' AS lit FROM orders)
        SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN lit ELSE {_HASH.format("lit")} END AS token FROM x"""),
    "clean_where": (clean_where, rf"WITH {X.LOG} SELECT id, regexp_replace(replace(query, 'where', 'where   '), '(?i)(WHERE|ON)\s{{2,}}', '\1 ', 'g') AS query FROM log"),
    "undo_hash": (undo_hash, "SELECT o_orderkey, 'a = ''' || substr(md5(o_orderpriority), 1, 3) || ''' and b = ''' || substr(md5(o_orderstatus), 1, 12) || '''' AS query FROM orders"),
    "parse_log_57": (parse_log_57, f"WITH {X.LOG} SELECT id, date_trunc('second', ts) AS ts, conn, query FROM log WHERE id % 7 <> 0"),
    "parse_log_55_ffill": (parse_log_55_ffill, f"WITH {X.LOG} SELECT conn AS file, id AS line_no, last_value(CASE WHEN id % 3 = 0 THEN date_trunc('day', ts) + INTERVAL '9:01:51' HOUR TO SECOND END IGNORE NULLS) OVER (PARTITION BY conn ORDER BY id ROWS UNBOUNDED PRECEDING) AS ts, 'Query' AS command, query FROM log".replace("INTERVAL '9:01:51' HOUR TO SECOND", "to_seconds(32511)")),
    "parse_log_postgresql": (parse_log_postgresql, f"WITH {X.LOG} SELECT id, date_trunc('second', ts) AS ts, conn, query, 'parameters: $1 = ''5''' AS params FROM log"),
    "assemble_multiline": (assemble_multiline, """WITH l AS (SELECT user_id, event_id, event_id % 3 = 0 AS b, CASE WHEN event_id % 3 = 0 THEN '2016-09-01T15:24:06.654226Z11 Query SELECT ' || event_id ELSE '  more ' || event_type END AS line FROM events),
        n AS (SELECT *, sum(CAST(b AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM l)
        SELECT CAST(user_id AS VARCHAR) AS file, min(event_id) AS line_no, string_agg(line, ' ' ORDER BY event_id) AS record FROM n WHERE nth > 0 GROUP BY user_id, nth"""),
    "systematic_sample": (systematic_sample, "SELECT file, id FROM (SELECT o_orderkey % 4 AS file, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) AS n FROM orders) WHERE (n - 1) % 50 = 0"),
    "limit_per_file": (limit_per_file, f"WITH {X.LOG} SELECT file, id FROM (SELECT id % 4 AS file, id, row_number() OVER (PARTITION BY id % 4 ORDER BY ts, id) AS n FROM log) WHERE n <= 20"),
    "round_robin": (round_robin, f"WITH {X.LOG}, b AS (SELECT *, time_bucket(INTERVAL 10 MINUTE, ts - INTERVAL 1 MINUTE, TIMESTAMP '2000-01-01') + INTERVAL 10 MINUTE AS batch FROM log) SELECT batch, id, CAST((row_number() OVER (PARTITION BY batch ORDER BY ts, id) - 1) % 24 AS INTEGER) AS worker FROM b"),
    "bind_parameters": (bind_parameters, "SELECT o_orderkey, 'SELECT a FROM t WHERE x = ''' || o_orderstatus || ''' AND y = ''' || o_custkey || ''' AND z = ''' || o_orderstatus || '''0' AS query FROM orders"),
    "trace_build": (trace_build, f"WITH {X.LOG} SELECT date_trunc('minute', ts) AS ts, conn, {_statement('query')} || ';' AS query, count(*) AS n FROM log GROUP BY ALL"),
    "trace_parse": (trace_parse, f"WITH {X.LOG} SELECT id, date_trunc('minute', ts) AS ts, conn, query FROM log"),
    "enum_literals": (enum_literals, f"SELECT {_HASH.format('literal')} AS token, literal FROM (SELECT '''' || p_type || '''' AS literal FROM part UNION SELECT '''' || p_brand || '''' FROM part)"),
    "restore_enums": (restore_enums, "SELECT date_trunc('minute', o_orderdate) AS ts, CAST(o_orderkey AS VARCHAR) AS conn, 'select 1 from orders where s = ''' || o_orderstatus || ''';' AS query FROM orders"),
    "ddl_columns": (ddl_columns, f'WITH {X.DUMP} SELECT file, tab AS "table", col AS "column", ordinal, data_type FROM dump'),
    "name_functions": (name_functions, rf"""WITH {X.LOG} SELECT l.id, CASE WHEN l.id % 5 IN (0, 1, 4) THEN 'orders' END AS from_table, CASE l.id % 5
        WHEN 0 THEN 'o_custkey = ' || conn || ';o_orderpriority = ''' || o_orderpriority || ''''
        WHEN 3 THEN 'o_totalprice=-' || CAST(floor(o_totalprice) AS BIGINT) || '.5;o_orderkey>=' || l.id || ';o_orderstatus=''5\abcd'''
        WHEN 4 THEN 'o_custkey=' || conn ELSE '' END AS pairs,
        CASE WHEN l.id % 5 = 4 THEN '/*c*/ ' ELSE '' END || replace({_TEMPLATES.replace('CASE id', 'CASE l.id')}, '#', 'param_holder') AS named, 'idx_a_orders_' || conn AS index_name FROM log l JOIN orders o ON o.o_orderkey = l.id"""),
    "time_functions": (time_functions, """SELECT event_id, date_trunc('second', ts) AS pg, date_trunc('minute', ts) AS minute, time_bucket(INTERVAL 120 MINUTE, ts, TIMESTAMP '2000-01-01') AS low,
        time_bucket(INTERVAL 10 MINUTE, date_trunc('minute', ts) - INTERVAL 1 MINUTE, TIMESTAMP '2000-01-01') + INTERVAL 10 MINUTE AS high, date_diff('minute', TIMESTAMP '2024-01-01', date_trunc('minute', ts)) + 1 AS span, 4 AS steps FROM events"""),
    "distinct_templates": (distinct_templates, f"WITH {X.LOG}, {_T} SELECT DISTINCT template FROM t"),
    "logical_kind": (logical_kind, f"WITH {X.LOG}, {_T}, d AS (SELECT DISTINCT {_NORMAL} AS template FROM t), {_TOKENS}, {_KIND} SELECT * FROM k"),
    "logical_mentions": (logical_mentions, f"WITH {X.LOG}, {_T}, {_MENTIONS} SELECT * FROM m"),
    "logical_vectors": (logical_vectors, f"""WITH {X.LOG}, {_T}, {_MENTIONS}, {_KIND},
        o AS (SELECT what || ':' || name AS slot, CAST(row_number() OVER (ORDER BY what = 'c', name) + 1 AS INTEGER) AS place FROM slots)
        SELECT template, place, CAST(coalesce(n, 0) AS DOUBLE) AS value FROM (SELECT * FROM d, o) LEFT JOIN m USING (template, slot)
        UNION ALL SELECT template, 0, CAST(kind AS DOUBLE) FROM k UNION ALL SELECT template, 1, 0.0 FROM d"""),
}
