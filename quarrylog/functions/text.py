"""Query text: templates, anonymisation, parameters and names, as column expressions.

Null in gives null out throughout.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Statement words in the order in which they are looked for.
STATEMENTS = ("select", "SELECT", "INSERT", "insert", "UPDATE", "update", "delete", "DELETE")
# Fixed values: (pattern, replacement) that turn constants into marks, in order.
TEMPLATE_STEPS = (
    (r"('\d+\\.*?')", "@@@"),
    (r"([^\\])'((')|(.*?([^\\])'))", r"\1&&&"),
    (r'([^\\])"((")|(.*?([^\\])"))', r"\1&&&"),
    (r"([^a-zA-Z])-?\d+(\.\d+)?", r"\1#"),
)
# Fixed values: (pattern, replacement) that make spellings of a template one, in order.
NORMAL_STEPS = (
    ("&&&", "#"),
    ("@@@", "#"),
    ("[nN]ull", "#"),
    ("NULL", "#"),
    (r"\s+", " "),
    (r"\( ", "("),
    (r" \)", ")"),
    (r"([^ ])\(", r"\1 ("),
    (r"\)([^ ])", r") \1"),
    (r" IN \([^\(]*?\)", " IN ()"),
    (r" in \([^\(]*?\)", " IN ()"),
    (r"([=<>,!\?])([^ ])", r"\1 \2"),
    (r"([^ ])=", r"\1 ="),
)


def _steps(text: Column, steps: tuple[tuple[str, str], ...]) -> Column:
    java = lambda replacement: replacement.replace("$", r"\$").replace("\\1", "$1").replace("\\2", "$2")
    return reduce(lambda c, s: F.regexp_replace(c, s[0], java(s[1])), steps, text)


def templatize(query: Column) -> Column:
    """The query with string constants as ``&&&``, hashed ones as ``@@@`` and numbers as ``#``."""
    return _steps(query, TEMPLATE_STEPS)


def normalize_template(template: Column) -> Column:
    """One spelling of marks, spaces and IN lists.  Not idempotent: to be applied once."""
    return _steps(template, NORMAL_STEPS)


def truncate_insert(template: Column) -> Column:
    """INSERT templates without what follows VALUES."""
    at = F.instr(template, "VALUES")
    return F.when((F.instr(template, "INSERT") > 0) & (at > 1), F.substring(template, F.lit(1), at + F.lit(5))).otherwise(template)


def statement_of(query: Column) -> Column:
    """The query from its statement word on; null if it has none.  Words are looked for in list order, so the select inside
    an insert wins."""
    places = [F.nullif(F.instr(query, w), F.lit(0)) for w in STATEMENTS]
    return F.substring(query, F.coalesce(*places), F.length(query))


def has_statement(query: Column) -> Column:
    """Whether a query has a statement word: to filter by before anything is computed from the statement."""
    return query.rlike("|".join(STATEMENTS))


def drop_dollars(template: Column) -> Column:
    return F.replace(template, F.lit("$"), F.lit(""))


def name_parameters(template: Column) -> Column:
    """``#`` spelt as a word, so that a tokenizer keeps it."""
    return F.replace(template, F.lit("#"), F.lit("param_holder"))


def is_session_command(query: Column) -> Column:
    """SET and SHOW, in capitals."""
    return query.startswith("SET") | query.startswith("SHOW")


def is_date_or_digits(literal: Column) -> Column:
    """Whether a quoted literal is an integer or looks like a date; these are not hashed."""
    inner = F.substring(literal, F.lit(2), F.length(literal) - 2)
    whole = r"^\s*[+-]?\d+(_\d+)*\s*$"
    part = lambda at, n: F.substring(inner, at, n).rlike(whole)
    dash = (F.substring(inner, 5, 1) == "-") | (F.substring(inner, 8, 1) == "-")
    return inner.rlike(whole) | (F.length(inner).isin(10, 19) & dash & part(1, 4) & part(6, 2) & part(9, 2))


def hashed_literal(literal: Column, salt: str) -> Column:
    """``'<length>\\<md5>'`` of a quoted literal."""
    return F.concat(F.lit("'"), (F.length(literal) - 2).cast("string"), F.lit("\\"), F.md5(F.concat(F.lit(salt), literal).cast("binary")), F.lit("'"))


# A query as quoted literals and what lies between them; doubled and escaped quotes stay inside a literal.
_PIECES = r"""'(?:[^'\\]|\\.|'')*+'|"(?:[^"\\]|\\.|"")*+"|[^'"]++|['"]"""


def anonymize(query: Column, salt: str) -> Column:
    """The query with its string literals hashed, but for numbers, dates, and patterns after LIKE."""
    pieces = F.regexp_extract_all(query, F.lit(_PIECES), F.lit(0))

    def piece(all_: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            literal = x.rlike("(?s)^(?:'.*'|\".*\")$") & (F.length(x) > 1)
            before = F.get(all_, i - 1)
            pattern = before.rlike(r"(?i)like[^\s]*\s*$") & x.rlike("[%_]")
            return F.when(~literal | is_date_or_digits(x) | F.coalesce(pattern, F.lit(False)), x).otherwise(F.concat(F.lit(" "), hashed_literal(x, salt)))

        return F.array_join(F.transform(all_, one), "")

    return F.get(F.transform(F.array(pieces), piece), F.lit(0))


def clean_where(query: Column) -> Column:
    """One space after WHERE and ON."""
    return F.regexp_replace(query, r"(?i)(WHERE|ON)\s{2,}", "$1 ")


def undo_hash_length(query: Column) -> Column:
    """Hashed literals cut to the length that they state."""
    token = r"'(\d+)\\([0-9a-f]*)'"
    found = F.regexp_extract_all(query, F.lit(token), F.lit(0))
    cut = lambda t: F.concat(F.lit("'"), F.substring(F.regexp_extract(t, token, 2), F.lit(1), F.regexp_extract(t, token, 1).cast("int")), F.lit("'"))
    return F.aggregate(found, query, lambda q, t: F.replace(q, t, cut(t)))


def bind_parameters(query: Column, parameters: Column) -> Column:
    """``$n`` replaced by the n-th quoted value of the parameter text, the highest number first."""
    values = F.regexp_extract_all(parameters, F.lit("'.+?'"), F.lit(0))
    numbered = F.reverse(F.transform(values, lambda v, i: F.struct(F.concat(F.lit("$"), (i + 1).cast("string")).alias("name"), v.alias("value"))))
    return F.coalesce(F.aggregate(numbered, query, lambda q, x: F.replace(q, x["name"], x["value"])), query)


def is_schema_statement(statement: Column) -> Column:
    """Whether a statement of a schema dump makes tables: those that choose or make a database, and scraps, do not."""
    return (F.length(statement) >= 3) & ~statement.contains("USE ") & ~statement.contains("DATABASE")


def close_statement(query: Column) -> Column:
    return F.concat(F.regexp_replace(query, ";\\z", ""), F.lit(";"))


def restore_literals(query: Column, tokens: Column) -> Column:
    """Hashed literals replaced by those that an array of (token, literal) knows."""
    return F.aggregate(tokens, query, lambda q, x: F.replace(q, x["token"], x["literal"]))


def table_after_from(query: Column) -> Column:
    return F.nullif(F.regexp_extract(query, r"(?i)\bfrom\s+([\w.`]+)", 1), F.lit(""))


def comparisons(query: Column) -> Column:
    """array of ``column operator value`` texts."""
    return F.regexp_extract_all(query, F.lit(r"[\w.]+\s*(?:=|<>|<=|>=|<|>)\s*(?:'[^']*'|[-\w.]+)"), F.lit(0))


def split_name(token: Column) -> Column:
    """The first two parts of ``table.column`` or ``table,column``; null if there are fewer."""
    parts = F.split(token, "[.,]")
    return F.when(F.size(parts) >= 2, F.slice(parts, 1, 2))


def clean_identifier(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, "[`(]", ""))


def index_name(table: Column, column: Column) -> Column:
    return F.concat(F.lit("idx_"), F.replace(table, F.lit("."), F.lit("_")), F.lit("_"), column)


def index_statement(table: Column, column: Column) -> Column:
    """DDL text for a recommended index."""
    return F.concat(F.lit("CREATE INDEX "), index_name(table, column), F.lit(" ON "), table, F.lit(" ("), column, F.lit(")"))
