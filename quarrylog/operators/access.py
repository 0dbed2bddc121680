"""Which columns the WHERE clauses of a query name, with aliases resolved.  Column functions and joins only.

A query is cut into its clauses first.  Lists of tables (after FROM, JOIN and UPDATE) give names and aliases; references
in WHERE clauses are looked up among them.  A reference without a qualifier, or with one that names no table, is a
column of the first table of the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that end a list of tables, and words that end a WHERE clause.
LIST_ENDS = "from update join set where select group order having limit union values on using left right inner outer cross natural returning".split()
WHERE_ENDS = "select order group returning where".split()
#: What a parameter became; it is no column.
PARAMETER = "param_holder"

_NO_CODE = r"""(?s)--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*\""""
_REFERENCE = r"\w+(?:\s*\.\s*\w+)*"


def _clauses(code: Column, begins: str, ends: list[str]) -> Column:
    return F.regexp_extract_all(code, F.lit(rf"(?is)\b(?:{begins})\b(.*?)(?=\b(?:{'|'.join(ends)})\b|\z)"), F.lit(1))


def _parts(name: Column) -> Column:
    """A dotted name without the white space around its dots."""
    return F.regexp_replace(name, r"\s*\.\s*", ".")


def listed_tables(templates: DataFrame) -> DataFrame:
    """(template, at, name, short, alias): the entries of a query's lists of tables, in their order."""
    code = F.replace(F.regexp_replace("template", _NO_CODE, " "), F.lit("`"), F.lit(""))
    entries = F.flatten(F.transform(_clauses(code, "from|join|update", LIST_ENDS), lambda c: F.split(c, "[,()]")))
    rows = templates.select("template", F.posexplode(entries).alias("at", "entry"))
    shape = rf"^\s*({_REFERENCE})(?:\s+(?i:as\s+)?(\w+))?"
    name = _parts(F.regexp_extract("entry", shape, 1))
    return rows.select("template", "at", name.alias("name"), F.substring_index(name, ".", -1).alias("short"), F.regexp_extract("entry", shape, 2).alias("alias")).filter("name <> ''")


def references(templates: DataFrame) -> DataFrame:
    """(template, qualifier, column) of the names in WHERE clauses; the qualifier may be empty."""
    code = F.replace(F.regexp_replace("template", _NO_CODE, " "), F.lit("`"), F.lit(""))
    names = F.flatten(F.transform(_clauses(code, "where", WHERE_ENDS), lambda c: F.regexp_extract_all(c, F.lit(_REFERENCE), F.lit(0))))
    rows = templates.select("template", F.explode(F.array_distinct(F.transform(names, _parts))).alias("name"))
    column = F.substring_index("name", ".", -1)
    return rows.select("template", F.regexp_extract("name", r"^(?:.*\.)?(\w+)\.\w+$", 1).alias("qualifier"), column.alias("column")).filter(F.col("column") != PARAMETER)


def access(templates: DataFrame, schema: DataFrame) -> DataFrame:
    """(template, table, column) of templates(template), for the columns that schema(table, column) knows."""
    templates = templates.select("template").distinct()
    known = schema.select("table", "column").distinct()
    entries = listed_tables(templates)
    # a full name goes before its last part
    asked = entries.select("template", "at", "short", "alias", F.posexplode(F.array_distinct(F.array("name", "short"))).alias("nth", "table"))
    tables = asked.join(known.select("table").distinct(), "table").groupBy("template", "at", "short", "alias").agg(F.min_by("table", "nth").alias("table"))
    first = tables.groupBy("template").agg(F.min_by("table", "at").alias("first"))
    called = tables.select("template", "at", "table", F.explode(F.array_distinct(F.array(F.substring_index("table", ".", -1), "short", "alias"))).alias("qualifier"))
    called = called.filter("qualifier <> ''").groupBy("template", "qualifier").agg(F.min_by("table", "at").alias("table"))
    found = references(templates).join(first, "template").join(called, ["template", "qualifier"], "left")
    return found.select("template", F.coalesce("table", "first").alias("table"), "column").join(known, ["table", "column"], "left_semi").select("template", "table", "column").distinct()
