"""Schema dumps: tables, columns, types and enumerations from CREATE TABLE text.

``scanned`` and ``scanned_literals`` take dumps as lines in Spark, whatever their size; ``columns`` and ``enum_tokens`` one text that
the caller has at hand.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import hashed_literal
from ..ordering import counted_carried, dealt

_TABLE = re.compile(r"\s*CREATE TABLE\s+(?:IF NOT EXISTS\s+)?[`\"]?([\w.`\"]+?)[`\"]?\s*\(", re.I)
_COLUMN = re.compile(r"\s*[`\"]?(\w+)[`\"]?\s+([A-Za-z]+(?: (?:varying|precision|without time zone|with time zone))?)\s*(?:\((\d+))?", re.I)
_ENUM = r"(?i)\benum\s*\((.*?)\)"
_BEGINS, _DECLARES = f"(?i)^{_TABLE.pattern}", f"(?i)^{_COLUMN.pattern}"
BLOCK_LINES = 1 << 18
#: Stands for a table's number where the last table has ended.
ENDED = -1
#: First words of lines that declare no column.
KEY_WORDS = frozenset(("KEY", "PRIMARY", "UNIQUE", "CONSTRAINT", "INDEX", "FOREIGN", "FULLTEXT"))


def parse(text: str) -> list[tuple[str, str, int, str]]:
    """(table, column, ordinal, type) of a dump."""
    out: list[tuple[str, str, int, str]] = []
    table, ordinal = None, 0
    for line in text.splitlines():
        if m := _TABLE.match(line):
            table, ordinal = m[1].replace("`", "").replace('"', ""), 0
        elif table and line.strip().startswith(")"):
            table = None
        elif table and (m := _COLUMN.match(line)) and m[1].upper() not in KEY_WORDS:
            ordinal += 1
            out.append((table, m[1], ordinal, m[2].upper()))
    return out


def columns(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse(text), "table string, column string, ordinal int, data_type string")


def scanned(lines: DataFrame) -> DataFrame:
    """(file, table, column, ordinal, data_type) of dumps as lines(file, line_no, line), which are numbered from 0 on.

    A line belongs to the table whose statement is the last one begun above it in its file, and has not ended.  The number of
    that statement's line is carried along blocks of lines; of the lines only names and types are.  A table's name is on its first line."""
    begun, line = F.regexp_extract("line", _BEGINS, 1), F.col("line")
    name = F.when(begun != "", F.translate(begun, '`"', ""))
    table = F.when(name != "", F.col("line_no").cast("long")).when(name.isNotNull() | F.ltrim(line).startswith(")"), ENDED)
    column, data_type = (F.when(begun == "", F.regexp_extract("line", _DECLARES, group)) for group in (1, 2))
    marked = lines.select("file", "line_no", table.alias("table"), name.alias("name"), column.alias("column"), F.upper(data_type).alias("data_type"))
    found, total = counted_carried(marked, "table", "line_no", "file", width=BLOCK_LINES)
    kept = found.filter((F.col("table") != ENDED) & (F.col("name").isNotNull() | ~F.upper("column").isin("", *KEY_WORDS)))
    # the first line and the columns of one table; rows that are given again have the place of their line
    one = Window.partitionBy("file", "table").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt(kept, total, "file", "table").select("*", F.first("name").over(one).alias("_name"), (F.dense_rank().over(one) - 1).alias("ordinal"))
    return placed.filter("ordinal > 0").select("file", F.col("_name").alias("table"), "column", "ordinal", "data_type")


def scanned_literals(lines: DataFrame, salt: str) -> DataFrame:
    """(token, literal): the hashed form of each literal of the enumerations of dumps as lines(line), once."""
    lists = F.explode(F.regexp_extract_all("line", F.lit(_ENUM), F.lit(1)))
    literals = lines.select(lists.alias("x")).select(F.explode(F.regexp_extract_all("x", F.lit("'[^']*'"), F.lit(0))).alias("literal")).distinct()
    return literals.select(hashed_literal(F.col("literal"), salt).alias("token"), "literal")


def enum_tokens(spark: SparkSession, text: str, salt: str) -> DataFrame:
    """(token, literal): the hashed form of each literal of the dump's enumerations."""
    literals = sorted({v for m in re.finditer(r"\benum\s*\((.*?)\)", text, re.I) for v in re.findall(r"'[^']*'", m[1])})
    rows = [(f"'{len(v) - 2}\\{hashlib.md5((salt + v).encode()).hexdigest()}'", v) for v in literals]
    return spark.createDataFrame(rows, "token string, literal string")


def catalog_columns(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(table, column, ordinal, data_type) of the session's catalog."""
    rows = [(t.name, c.name, i + 1, c.dataType.upper()) for t in spark.catalog.listTables(database) for i, c in enumerate(spark.catalog.listColumns(t.name, database))]
    return spark.createDataFrame(rows, "table string, column string, ordinal int, data_type string")
