"""What the named queries take as logs, series, assignments and forecasts: views of the driver's tables, in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SALT = "a salt for tests"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query_log(spark: SparkSession, sf: str) -> DataFrame:
    """(id, ts, conn, query): five kinds of statements about orders."""
    k, c, p = "cast(o_orderkey as string)", "cast(o_custkey as string)", "cast(cast(floor(o_totalprice) as bigint) as string)"
    query = F.expr(
        f"""CASE o_orderkey % 5
        WHEN 0 THEN concat('SELECT o_orderkey FROM orders WHERE o_custkey = ', {c}, ' AND o_orderpriority = \\'', o_orderpriority, '\\'')
        WHEN 1 THEN concat('select * from orders o where o.o_orderkey in (', {k}, ', 7) and o.o_clerk = "x', {c}, '"')
        WHEN 2 THEN concat('INSERT INTO orders (o_orderkey, o_comment) VALUES (', {k}, ', \\'it\\'\\'s\\')')
        WHEN 3 THEN concat('UPDATE orders SET o_totalprice=-', {p}, '.5 WHERE o_orderkey>=', {k}, ' AND o_orderstatus=\\'5\\\\abcd\\'')
        ELSE concat('/*c*/ delete from  orders where o_comment is Null and o_custkey=', {c}) END"""
    )
    ts = F.timestamp_add("MINUTE", ((F.col("o_orderkey") * 37) % 1440).cast("int"), F.col("o_orderdate"))
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), ts.alias("ts"), F.col("o_custkey").cast("string").alias("conn"), query.alias("query"))


LOG = r"""log AS (
  SELECT o_orderkey AS id, o_orderdate + to_minutes(CAST((o_orderkey * 37) % 1440 AS INTEGER)) AS ts, CAST(o_custkey AS VARCHAR) AS conn,
    CASE o_orderkey % 5
      WHEN 0 THEN 'SELECT o_orderkey FROM orders WHERE o_custkey = ' || o_custkey || ' AND o_orderpriority = ''' || o_orderpriority || ''''
      WHEN 1 THEN 'select * from orders o where o.o_orderkey in (' || o_orderkey || ', 7) and o.o_clerk = "x' || o_custkey || '"'
      WHEN 2 THEN 'INSERT INTO orders (o_orderkey, o_comment) VALUES (' || o_orderkey || ', ''it''''s'')'
      WHEN 3 THEN 'UPDATE orders SET o_totalprice=-' || CAST(floor(o_totalprice) AS BIGINT) || '.5 WHERE o_orderkey>=' || o_orderkey || ' AND o_orderstatus=''5\abcd'''
      ELSE '/*c*/ delete from  orders where o_comment is Null and o_custkey=' || o_custkey END AS query
  FROM orders)"""


def event_counts(spark: SparkSession, sf: str) -> DataFrame:
    """(template, ts, cnt): events of each type per minute."""
    return read(spark, sf, "events").groupBy(F.col("event_type").alias("template"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("cnt"))


COUNTS = "counts AS (SELECT event_type AS template, date_trunc('minute', ts) AS ts, count(*) AS cnt FROM events GROUP BY ALL)"


def user_counts(spark: SparkSession, sf: str) -> DataFrame:
    """(template, ts, cnt): events of fifty groups of users per minute."""
    template = F.concat(F.lit("t"), (F.col("user_id") % 50).cast("string"))
    return read(spark, sf, "events").groupBy(template.alias("template"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("cnt"))


USER_COUNTS = "user_counts AS (SELECT 't' || (user_id % 50) AS template, date_trunc('minute', ts) AS ts, count(*) AS cnt FROM events GROUP BY ALL)"


def assignments(spark: SparkSession, sf: str) -> DataFrame:
    """(as_of, template, cluster): seven clusters of those groups, and none for some, at the end of every day."""
    days = read(spark, sf, "events").select(F.timestamp_add("DAY", F.lit(1), F.date_trunc("day", "ts").cast("timestamp_ntz")).alias("as_of")).distinct()
    groups = spark.range(50).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("template"), F.when(F.col("id") % 11 == 0, -1).otherwise(F.col("id") % 7).cast("int").alias("cluster"))
    return days.join(F.broadcast(groups))


ASSIGNMENTS = """assignments AS (
  SELECT as_of, 't' || i AS template, CAST(CASE WHEN i % 11 = 0 THEN -1 ELSE i % 7 END AS INTEGER) AS cluster
  FROM (SELECT DISTINCT date_trunc('day', ts) + INTERVAL 1 DAY AS as_of FROM events), range(50) AS r(i))"""


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """(cluster, ts, cnt): events per hour; a type is a cluster, numbered by name."""
    types = read(spark, sf, "events").select("event_type").distinct()
    numbered = types.withColumn("cluster", F.row_number().over(Window.orderBy("event_type")))
    hours = read(spark, sf, "events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("cnt"))
    return hours.join(F.broadcast(numbered), "event_type").select("cluster", "ts", "cnt")


HOURLY = """hourly AS (
  SELECT CAST(cluster AS INTEGER) AS cluster, ts, cnt FROM (SELECT event_type, date_trunc('hour', ts) AS ts, count(*) AS cnt FROM events GROUP BY ALL)
  JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) AS cluster FROM (SELECT DISTINCT event_type FROM events)) USING (event_type))"""


def forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """(model, horizon, cluster, ts, actual, predicted): three made-up models of the hourly series."""
    h = hourly(spark, sf).withColumns({"actual": F.col("cnt").cast("double"), "o": F.hour("ts")})
    model = lambda name, e: h.select(F.lit(name).alias("model"), F.lit(60).alias("horizon"), "cluster", "ts", "actual", e.cast("double").alias("predicted"))
    kr = F.when(F.col("o") % 7 == 0, F.col("cnt") * 500 + 1500).otherwise(F.col("cnt") - F.col("o") % 5)
    return model("ar", F.col("cnt") * 0.5 + 3).union(model("rnn", F.col("cnt") + F.col("o") % 3)).union(model("kr", kr))


FORECASTS = f"""{HOURLY}, forecasts AS (
  SELECT 'ar' AS model, 60 AS horizon, cluster, ts, CAST(cnt AS DOUBLE) AS actual, cnt * CAST(0.5 AS DOUBLE) + 3 AS predicted FROM hourly
  UNION ALL SELECT 'rnn', 60, cluster, ts, CAST(cnt AS DOUBLE), CAST(cnt + hour(ts) % 3 AS DOUBLE) FROM hourly
  UNION ALL SELECT 'kr', 60, cluster, ts, CAST(cnt AS DOUBLE), CAST(CASE WHEN hour(ts) % 7 = 0 THEN cnt * 500 + 1500 ELSE cnt - hour(ts) % 5 END AS DOUBLE) FROM hourly)"""

def schema_dump(spark: SparkSession, sf: str) -> DataFrame:
    """(file, line_no, line): a dump with a table for each part, in seven files.  Parts are dealt out first: they are few octets each and
    may all be in one row group, and lines take seven times as long to make and to scan."""
    k = F.col("p_partkey").cast("string")
    column = lambda name, kind: F.concat(F.lit("  `"), name, F.lit("` "), kind, F.lit(","))
    kind = F.element_at(F.array(*[F.lit(t) for t in ("int(11)", "double precision", "text", "timestamp without time zone", "varchar(15)")]), (F.col("p_size") % 5 + 1).cast("int"))
    enum = F.concat(F.lit("enum('"), "p_type", F.lit("','"), "p_brand", F.lit("') NOT NULL"))
    name = F.translate("p_name", " ", "_")
    lines = F.array(F.concat(F.lit("CREATE TABLE IF NOT EXISTS `db`.`t"), k, F.lit("` (")), column(F.lit("p_partkey"), F.lit("bigint NOT NULL")), column(name, kind), F.lit("  PRIMARY KEY (`p_partkey`),"), column(F.lit("kind"), enum), F.lit(") ENGINE=InnoDB;"), F.lit("  INSERT INTO x"))
    parts = read(spark, sf, "part").repartition("p_partkey").select(F.concat(F.lit("dump"), (F.col("p_partkey") % 7).cast("string")).alias("file"), "p_partkey", F.posexplode(lines).alias("i", "line"))
    return parts.select("file", (F.col("p_partkey") * 8 + F.col("i")).alias("line_no"), "line")


DUMP = """dump AS (
  SELECT 'dump' || (p_partkey % 7) AS file, 'db.t' || p_partkey AS tab, unnest(['p_partkey', replace(p_name, ' ', '_'), 'kind']) AS col, unnest([1, 2, 3]) AS ordinal,
    unnest(['BIGINT', ['INT', 'DOUBLE PRECISION', 'TEXT', 'TIMESTAMP WITHOUT TIME ZONE', 'VARCHAR'][p_size % 5 + 1], 'ENUM']) AS data_type, unnest([1, CASE WHEN p_size % 5 = 2 THEN 0 ELSE 1 END, 0]) AS card FROM part)"""

DDL = """CREATE TABLE `orders` (
  `o_orderkey` bigint NOT NULL,
  `o_custkey` int(11),
  `o_clerk` varchar(15),
  `o_comment` text,
  `o_totalprice` double,
  `o_orderstatus` enum('O','F','P'),
  `o_orderpriority` varchar(15),
  PRIMARY KEY (`o_orderkey`)
);
CREATE TABLE lineitem (
  l_orderkey bigint,
  l_shipdate timestamp,
  KEY l (l_orderkey)
);
"""
