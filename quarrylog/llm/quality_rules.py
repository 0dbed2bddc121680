"""Line-first quality rules, in DataFrame expressions only.

Every line is judged by itself: symbols, navigation bars, shouting, boilerplate phrases, fragments without closing
punctuation.  Lines that fail are removed.  A document that loses more than half of its characters outside white
space is rejected, as is one that fails the base rules on its whole text (fewer than ten words, or more than a
fifth of its words in repeated five-word windows).

Five-word windows count as equal if the XXH64 of their words' XXH64 values is.  All arrays stay inside one
row; nothing is shuffled.

Defined results: null and empty texts have no words and fail the base rules; lines without a word count for nothing;
repeated rows are judged alike; an empty table gives no rows; other columns are ignored by the query and kept by
``cleaned``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import selected, table

MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
WINDOW = 5
MAX_LOST_PERCENT = 50
#: Phrases that mark a short line as boilerplate.
BOILERPLATE = "all rights reserved|cookie|javascript|privacy policy|terms of use|terms of service|subscribe|sign up|log in|click here|licensed under|lorem ipsum"
BOILERPLATE_WORDS = 20

_SPACE = " \t\n\x0b\f\r"
_GAP = "[ \\t-\\r]"
_SYMBOL = "[#*$%&|<>]"


def words(text: Column) -> Column:
    """The words of a text that is not null."""
    inner = F.btrim(text, F.lit(_SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"{_GAP}+"))


def _times(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _solid(text: Column) -> Column:
    """Characters outside white space."""
    return F.char_length(text).cast("long") - _times(text, _GAP)


def line_fails(line: Column, n: Column) -> Column:
    """Whether a line of n words fails.  What most lines do not have is looked for before it is counted."""
    bars = _times(line, "\\|")
    begins = "".join(sorted({c + c.upper() for c, *_ in BOILERPLATE.split("|")}))
    return (
        (line.rlike(_SYMBOL) & (10 * _times(line, _SYMBOL) > _solid(line)))
        | (line.contains("|") & (bars >= 2) & (n <= 4 * (bars + 1)))
        # capitals in such a number stand together somewhere, but for what is no small letter
        | ((n >= 3) & line.rlike("[A-Z][^a-z]*[A-Z]") & (_times(line, "[A-Z]") > 2 * _times(line, "[a-z]")))
        | ((n >= 3) & line.contains("!!") & (2 * _times(line, "!!") > n))
        | ((n <= BOILERPLATE_WORDS) & line.rlike(f"(?=[{begins}])(?i:{BOILERPLATE})"))
        | ((n <= 2) & ~line.rlike("[.!?:;)\"']" + _GAP + "*$"))
    )


def judged(docs: DataFrame) -> DataFrame:
    """docs with text (null: empty) and the columns of the query, and ``lines``: (line, fails) of those with a word."""
    has_word = lambda line: line.rlike("[^ \\t-\\r]")
    counted = lambda line: F.struct(line.alias("line"), _times(line, "[^ \\t-\\r]+").alias("n"))
    checked = lambda x: F.struct(x["line"].alias("line"), line_fails(x["line"], x["n"]).alias("fails"))
    step = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    step = step.withColumns({"_words": words(F.col("text")), "lines": F.transform(F.transform(F.filter(F.split("text", "\n", -1), has_word), counted), checked)})
    step = step.withColumns({"_h": F.transform("_words", lambda w: F.xxhash64(w)), "n_words": F.size("_words").cast("long")}).drop("_words")
    window = lambda i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(WINDOW)])
    step = step.withColumn("_s", F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")), window)).otherwise(F.array().cast("array<bigint>"))).drop("_h")
    # only texts that repeat a window go on to find where
    repeats = F.size(F.array_distinct("_s")) < F.size("_s")
    step = step.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_s", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_s")
    twin = lambda x, i: (F.get(F.col("_sorted"), i - 1)["h"].eqNullSafe(x["h"]) & (i > 0)) | F.get(F.col("_sorted"), i + 1)["h"].eqNullSafe(x["h"])
    step = step.withColumn("_at", F.sort_array(F.transform(F.filter("_sorted", twin), lambda x: x["i"]))).drop("_sorted")
    # a window covers its words up to the next repeated window
    reach = lambda a, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_at"), i + 1) - a, F.lit(WINDOW))).cast("long")
    step = step.withColumn("n_repeat_words", F.coalesce(F.aggregate(F.transform("_at", reach), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("_at")
    lost = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.when(x["fails"], _solid(x["line"])).otherwise(0))
    step = step.withColumns({"word_chars": _solid(F.col("text")), "n_symbols": _times(F.col("text"), _SYMBOL), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct(F.transform("lines", lambda x: x["line"])))).cast("long"), "lost_chars": lost})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    step = step.withColumn("base_failed", failed)
    return step.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST_PERCENT * F.col("word_chars")))


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents that are kept, without the lines that fail; n_chars, where it exists, follows the text."""
    other = {c: f"_given_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    out = selected(judged(docs.select("text", *[F.col(f"`{c}`").alias(a) for c, a in other.items()])), F.col("kept"))
    text = F.array_join(F.transform(F.filter("lines", lambda x: ~x["fails"]), lambda x: x["line"]), "\n")
    out = out.withColumn("text", F.when(F.col("lost_chars") > 0, text).otherwise(F.col("text")))
    if "n_chars" in other:
        out = out.withColumn(other["n_chars"], F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(other.get(c, c)).alias(c) for c in docs.columns])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*columns)


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, words[i:i + 4]) AS times
  FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), rep AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM g WHERE times > 1) GROUP BY r
), l AS (
  SELECT r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS solid,
         len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols, len(regexp_extract_all(line, '\|')) AS bars,
         len(regexp_extract_all(line, '[A-Z]')) AS upper_, len(regexp_extract_all(line, '[a-z]')) AS lower_,
         len(regexp_extract_all(line, '!!')) AS bangs
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
), ls AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines,
         sum(CASE WHEN 10 * symbols > solid OR (bars >= 2 AND n <= 4 * (bars + 1)) OR (n >= 3 AND upper_ > 2 * lower_)
                    OR (n >= 3 AND 2 * bangs > n)
                    OR (n <= 20 AND regexp_matches(line, '(?i)(?:all rights reserved|cookie|javascript|privacy policy|terms of use|terms of service|subscribe|sign up|log in|click here|licensed under|lorem ipsum)'))
                    OR (n <= 2 AND NOT regexp_matches(line, '[.!?:;)"''][\x20\x09-\x0D]*$'))
                  THEN solid ELSE 0 END) AS lost
  FROM l WHERE n > 0 GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars
  FROM w LEFT JOIN rep USING (r) LEFT JOIN ls USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost_chars <= 50 * word_chars AS kept,
       lost_chars
FROM m
"""
