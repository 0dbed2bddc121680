"""Execution plans as JSON: leaves, and the kind of scan that they show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys under which plans name an index, and marks of its kind.
INDEX_KEYS = ("possible_keys_", "key", "Index Name")
PRIMARY_MARKS, FOREIGN_MARKS = ("PRIMARY", "pkey"), ("fk_", "fkey")
CONST_TABLE = "no matching row in const table"


def leaves(plan: Column) -> Column:
    """array of (key, value) of a flat JSON object's leaves; members of a list under k have the key ``k_``."""
    parsed = F.from_json(plan, "map<string,string>")

    def leaf(e: Column) -> Column:
        items = F.from_json(e["value"], "array<string>")
        return F.when(e["value"].startswith("["), F.transform(F.coalesce(items, F.array()), lambda v: F.struct(F.concat(e["key"], F.lit("_")).alias("key"), v.alias("value")))).otherwise(F.array(F.struct(e["key"].alias("key"), e["value"].alias("value"))))

    return F.flatten(F.transform(F.map_entries(parsed), leaf))


def flatten_variant(plans: DataFrame, *keys: str, column: str = "plan") -> DataFrame:
    """(keys, key, value): leaves of JSON of any depth.  A leaf has the key next to it; in a list that of the list
    and ``_``; the last one of equal keys counts.  Each level is one ``variant_explode``."""
    level = plans.select(*keys, F.lit("").alias("name"), F.try_parse_json(column).alias("v"), F.array().cast("array<int>").alias("place")).filter("v is not null")
    out = None
    while True:
        kind = F.schema_of_variant("v")
        inner = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        leaf = level.filter(~inner).select(*keys, F.when(F.col("name").endswith("_"), F.expr("substring(name, 1, length(name) - 1)")).otherwise(F.col("name")).alias("key"), F.col("v").cast("string").alias("value"), "place")
        out = leaf if out is None else out.unionByName(leaf)
        nested = level.filter(inner)
        if nested.isEmpty():
            break
        nested.createOrReplaceTempView("_nested_variants")
        exploded = plans.sparkSession.sql(f"SELECT n.*, e.pos AS _pos, e.key AS _key, e.value AS _value FROM _nested_variants n, LATERAL variant_explode(n.v) e")
        name = F.when(F.col("_key").isNotNull(), F.concat("_key", F.lit("_"))).otherwise(F.concat("name", F.lit("_")))
        level = exploded.select(*keys, name.alias("name"), F.col("_value").alias("v"), F.concat("place", F.array("_pos")).alias("place"))
    return out.groupBy(*keys, "key").agg(F.max_by("value", "place").alias("value"))


def scan_kind(entries: Column) -> Column:
    """primary, foreign, secondary or seq, in this order of precedence, by the leaves of a plan."""
    has = lambda marks: lambda v: F.coalesce(*[F.when(v.contains(m), True) for m in marks], F.lit(False))
    named = F.filter(entries, lambda e: e["key"].isin(*INDEX_KEYS) & e["value"].isNotNull())
    primary = F.exists(entries, lambda e: F.coalesce(e["value"] == CONST_TABLE, F.lit(False))) | F.exists(named, lambda e: has(PRIMARY_MARKS)(e["value"]))
    foreign = F.exists(named, lambda e: ~has(PRIMARY_MARKS)(e["value"]) & has(FOREIGN_MARKS)(e["value"]))
    return F.when(primary, "primary").when(foreign, "foreign").when(F.size(named) > 0, "secondary").otherwise("seq")
