"""Index catalogues of databases, as tables that were read from them (over JDBC, say)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: First characters of the names of a system's own indexes.
OWN = "pg_"


def mysql_indexes(statistics: DataFrame, schema: str) -> DataFrame:
    """(index, table) of INFORMATION_SCHEMA.STATISTICS, once each."""
    return statistics.filter(F.col("table_schema") == schema).select(F.col("index_name").alias("index"), F.col("table_name").alias("table")).distinct()


def mysql_indexed_columns(statistics: DataFrame, schema: str) -> DataFrame:
    """(table, column) that some index has, once each."""
    return statistics.filter(F.col("table_schema") == schema).select(F.col("table_name").alias("table"), F.col("column_name").alias("column")).distinct()


def postgresql_indexed_columns(pg_index: DataFrame, pg_attribute: DataFrame, pg_class: DataFrame) -> DataFrame:
    """(index, table, column) from pg_index(indexrelid, indrelid, indkey), pg_attribute(attrelid, attnum, attname) and
    pg_class(oid, relname), without the system's own indexes."""
    name = lambda key, column: pg_class.select(F.col("oid").alias(key), F.col("relname").alias(column))
    keys = pg_index.select("indexrelid", "indrelid", F.explode("indkey").alias("attnum"))
    found = keys.join(pg_attribute.withColumnRenamed("attrelid", "indrelid"), ["indrelid", "attnum"]).join(name("indexrelid", "index"), "indexrelid").join(name("indrelid", "table"), "indrelid")
    return found.filter(~F.col("index").startswith(OWN)).select("index", "table", F.col("attname").alias("column"))


def other_columns(columns: DataFrame, own: tuple[str, ...] = ("pg_catalog", "information_schema")) -> DataFrame:
    """(table, column, data_type) of information_schema.columns, with the schema in the table's name, without a system's own."""
    return columns.filter(~F.col("table_schema").isin(*own)).select(F.concat_ws(".", "table_schema", "table_name").alias("table"), F.col("column_name").alias("column"), "data_type")
