"""Logical feature vectors of templates: statement kind, and how often tables and columns are named."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Statement kinds with their place, and the clauses that a SELECT adds.
KINDS = {"SELECT": 0, "INSERT": 6, "UPDATE": 7, "DELETE": 8}
CLAUSES = {"GROUP": 0, "ORDER": 1, "HAVING": 2, "LIMIT": 3}


def tokens(templates: DataFrame) -> DataFrame:
    """(template, nth, token) of the words between white space."""
    split = F.filter(F.split("template", r"\s+"), lambda t: t != "")
    return templates.select("template", F.posexplode(split).alias("nth", "token"))


def kind_score(templates: DataFrame) -> DataFrame:
    """(template, kind): the place of the last statement word, plus those of the clauses after it."""
    words = tokens(templates).withColumn("word", F.upper("token"))
    lookup = lambda table: F.coalesce(*[F.when(F.col("word") == w, F.lit(v)) for w, v in table.items()])
    marked = words.withColumns({"place": lookup(KINDS), "clause": lookup(CLAUSES)})
    last = F.max(F.when(F.col("place").isNotNull(), F.col("nth"))).over(Window.partitionBy("template"))
    marked = marked.withColumn("last", F.coalesce(last, F.lit(-1)))
    return marked.groupBy("template").agg((F.coalesce(F.max(F.when(F.col("nth") == F.col("last"), F.col("place"))), F.lit(0)) + F.coalesce(F.sum(F.when(F.col("nth") > F.col("last"), F.col("clause"))), F.lit(0))).cast("long").alias("kind"))


def mentions(templates: DataFrame, schema: DataFrame) -> DataFrame:
    """(template, slot, n): how often a template names each table and column, alone or as ``table.column``.

    schema: (table, column), small beside any log; slots are ``t:<table>`` and ``c:<column>``."""
    slots = schema.select(F.col("table").alias("name"), F.lit("t").alias("what")).union(schema.select("column", F.lit("c"))).distinct()
    names = slots.groupBy("name").agg(F.max(F.when(F.col("what") == "t", True)).alias("is_table"), F.max(F.when(F.col("what") == "c", True)).alias("is_column"))
    words = tokens(templates)
    words = words.filter(~F.upper("token").isin(*KINDS, *CLAUSES))
    whole = words.join(names, words["token"] == names["name"]).select("template", F.when(F.col("is_column"), F.concat(F.lit("c:"), F.col("token"))).otherwise(F.concat(F.lit("t:"), F.col("token"))).alias("slot"))
    rest = words.join(names, words["token"] == names["name"], "left_anti")
    parts = rest.withColumn("p", F.split("token", "[.,]")).filter(F.size("p") >= 2).select("template", F.explode(F.array(F.struct(F.lit("t").alias("what"), F.get("p", F.lit(0)).alias("name")), F.struct(F.lit("c").alias("what"), F.get("p", F.lit(1)).alias("name")))).alias("x"))
    named = parts.select("template", "x.what", "x.name").join(slots, ["what", "name"]).select("template", F.concat_ws(":", "what", "name").alias("slot"))
    return whole.unionByName(named).groupBy("template", "slot").agg(F.count("*").alias("n"))


def logical_vectors(templates: DataFrame, schema: DataFrame) -> DataFrame:
    """(template, vector): kind, an unused place, then tables and columns, each in the order of their names."""
    slots = schema.select(F.concat(F.lit("t:"), "table").alias("slot")).union(schema.select(F.concat(F.lit("c:"), "column"))).distinct()
    # tables before columns; the schema bounds this row
    order = slots.agg(F.sort_array(F.collect_list(F.struct((~F.col("slot").startswith("t:")).alias("c"), "slot"))).alias("slots")).select(F.transform("slots", lambda s: s["slot"]).alias("slots"))
    found = mentions(templates, schema).groupBy("template").agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("m"))
    base = kind_score(templates).join(found, "template", "left").join(F.broadcast(order))
    counts = F.transform("slots", lambda s: F.coalesce(F.try_element_at("m", s), F.lit(0)).cast("double"))
    return base.select("template", F.concat(F.array(F.col("kind").cast("double"), F.lit(0.0)), counts).alias("vector"))


def without_zero_places(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """The vectors without the places at which they add up to 0."""
    sums = vectors.select(F.posexplode(vector).alias("place", "value")).groupBy("place").agg(F.sum("value").alias("total")).filter("total <> 0")
    # one row, as long as a vector
    kept = sums.agg(F.sort_array(F.collect_list("place")).alias("_kept"))
    return vectors.join(F.broadcast(kept)).withColumn(vector, F.transform("_kept", lambda i: F.get(vector, i))).drop("_kept")
