"""Raw database logs: records from lines, and columns from records."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..ordering import carried, numbered

# Commands of MySQL logs, and the record formats.
COMMANDS = ("Connect", "Quit", "Init DB", "Query", "Field List", "Statistics")
_COMMAND = "|".join(COMMANDS)
MYSQL57 = rf"^(\d{{4}}-\d{{2}}-\d{{2}})T(\d{{2}}:\d{{2}}:\d{{2}}\.\d+)Z\s*(\d+)\s+({_COMMAND})\s+(.*)"
MYSQL55 = rf"^(\d{{6}}\s+\d+:\d+:\d+)?\s+(\d+)\s+({_COMMAND})\s+(.*)"
# Quoted fields of a csvlog double the quotes inside them.
_QUOTED = r'"(?:[^"]|"")*+"'
_ZONE = r"(?:[A-Z]{3})"
POSTGRESQL = (
    rf"^(\d{{4}}-\d{{2}}-\d{{2}} \d{{2}}:\d{{2}}:\d{{2}}.\d* {_ZONE}),{_QUOTED},{_QUOTED},(\d+),{_QUOTED},[^\"]*?,{_QUOTED},"
    rf"(\d{{4}}-\d{{2}}-\d{{2}} \d{{2}}:\d{{2}}:\d{{2}} {_ZONE}),.*?,\d+,LOG,\d{{5}},({_QUOTED}),+?({_QUOTED}).*"
)
BLOCK_LINES = 1 << 20
PREFIX = {"mysql57": MYSQL57, "mysql55": MYSQL55, "postgresql": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}.\d*"}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text and gzip files.  Plain files are read in splits.  A line's number is the first byte of its
    split and its place in there: numbers of a file grow with its lines, and leave gaps where splits meet."""
    given = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("_id"))
    nth = F.row_number().over(Window.partitionBy("file", "_at").orderBy("_id")) - 1
    return given.select("file", (F.col("_at") + nth).alias("line_no"), "line")


def read_zip_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of the members of zip archives, as UTF-8 with replacement."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        lines = archive.read(member).decode("utf-8", "replace").splitlines()
                        yield pd.DataFrame({"file": f"{name}/{member}", "line_no": range(len(lines)), "line": lines})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "file string, line_no int, line string")


def assemble(lines: DataFrame, kind: str) -> DataFrame:
    """(file, line_no, record): a line without a record's beginning belongs to the record above, after a space.

    Beginnings are counted in blocks of ``BLOCK_LINES`` line numbers, and the blocks of a file are added up, so that no task sees
    a whole file; the last record of a file counts like any other."""
    marked = lines.withColumns({"_begins": F.coalesce(F.col("line").rlike(PREFIX[kind]), F.lit(False)).cast("long"), "_block": F.floor(F.col("line_no") / BLOCK_LINES)})
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = marked.groupBy("file", "_block").agg(F.sum("_begins").alias("_n"))
    blocks = blocks.select("file", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("file", "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = marked.join(blocks, ["file", "_block"]).withColumn("nth", F.col("_before") + F.sum("_begins").over(inside)).filter("nth > 0")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ")
    return numbered.groupBy("file", "nth").agg(F.min("line_no").alias("line_no"), joined.alias("record")).drop("nth")


def _groups(record: Column, pattern: str, names: tuple[str, ...]) -> list[Column]:
    return [F.regexp_extract(record, f"(?s){pattern}", k + 1).alias(n) for k, n in enumerate(names)]


def parse_mysql57(records: DataFrame) -> DataFrame:
    """(..., day, time, conn, command, query) of the records that have the format."""
    found = records.filter(F.col("record").rlike(MYSQL57))
    return found.select(*[c for c in records.columns if c != "record"], *_groups(F.col("record"), MYSQL57, ("day", "time", "conn", "command", "query")))


def parse_mysql55(records: DataFrame, *key: str, order: str = "line_no") -> DataFrame:
    """(..., ts_text, conn, command, query); a record without a time has that of the last one before it in its file."""
    found = records.filter(F.col("record").rlike(MYSQL55))
    parsed = found.select(*[c for c in records.columns if c != "record"], *_groups(F.col("record"), MYSQL55, ("ts_text", "conn", "command", "query")))
    return carried(parsed.withColumn("ts_text", F.nullif("ts_text", F.lit(""))), "ts_text", order, *(key or ("file",)), width=BLOCK_LINES)


def parse_postgresql(records: DataFrame) -> DataFrame:
    """(..., ts_text, conn, session_start, query, params), the texts without the quotes of the file's format."""
    found = records.filter(F.col("record").rlike(f"(?s){POSTGRESQL}"))
    parsed = found.select(*[c for c in records.columns if c != "record"], *_groups(F.col("record"), POSTGRESQL, ("ts_text", "conn", "session_start", "query", "params")))
    plain = lambda c: F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"')).alias(c)
    return parsed.select(*[plain(c) if c in ("query", "params") else c for c in parsed.columns])


def rejected(records: DataFrame, kind: str) -> DataFrame:
    """The records that a parser leaves out, since they do not have its format."""
    pattern = {"mysql57": MYSQL57, "mysql55": MYSQL55, "postgresql": f"(?s){POSTGRESQL}"}[kind]
    return records.filter(~F.coalesce(F.col("record").rlike(pattern), F.lit(False)))


# Schemas of anonymised logs.
ANONYMISED = {
    "postgresql": "ts_text string, conn string, session_start string, query string, params string",
    "mysql57": "day string, time string, conn string, command string, query string",
    "mysql55": "ts_text string, conn string, command string, query string",
}


def read_anonymised(spark: SparkSession, path: str, kind: str, glob: str = "*.csv*") -> DataFrame:
    """Rows of (gzip) CSV logs with their file; rows of another shape are in ``rejected`` instead of ending the file."""
    schema = f"{ANONYMISED[kind]}, rejected string"
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "rejected")
    options = {"pathGlobFilter": glob, "recursiveFileLookup": True, "escape": '"', "multiLine": True, "ignoreCorruptFiles": True}
    return reader.options(**options).csv(path).withColumn("file", F.col("_metadata.file_path"))


def sampled(rows: DataFrame, every: int, *order: str, key: tuple[str, ...] = ("file",)) -> DataFrame:
    """Every n-th row of each file, from its first one on; a file's rows are numbered by ranges."""
    return numbered(rows, order, *key).filter(F.col("_n") % every == 0).drop("_n")


def first_rows(rows: DataFrame, n: int, *order: str, key: tuple[str, ...] = ("file",)) -> DataFrame:
    """The first n rows of each file.  Up to a thousand, each task cuts a file to its first n before they are brought together;
    for more, rows are numbered by ranges."""
    if n > 1000:
        return numbered(rows, order, *key).filter(F.col("_n") < n).drop("_n")
    over = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(over)).filter(F.col("_nth") <= n).drop("_nth")


def parse_trace(lines: Column) -> list[Column]:
    """Columns ts (whole minutes), conn and query of ``ts,conn,query`` lines; the query may have commas."""
    parts = F.split(lines, ",", 3)
    ts = F.date_trunc("minute", F.try_to_timestamp(F.get(parts, F.lit(0)))).cast("timestamp_ntz")
    return [ts.alias("ts"), F.get(parts, F.lit(1)).alias("conn"), F.get(parts, F.lit(2)).alias("query")]
