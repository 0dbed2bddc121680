"""Personal data: patterns for direct identifiers, and information-theoretic sanitisation of what reveals them.
DataFrame expressions only.

1. Base spans.  E-mail addresses, IP addresses, card numbers and phone numbers by pattern and check.
2. Secrets.  A run of ``SECRET`` or more letters and digits, in which a letter follows a digit, has an information content
   that makes it as good as unique; it is a protected value too, and a span that the method adds.
3. Terms are the runs of letters and digits that these spans leave.  A run without a digit is its own term; identifiers are
   generalised to their form: ``9{16}`` is a number of 16 digits, ``h{40}`` a hexadecimal one of 40, and in other runs
   every digit is a 9.
4. Protected entities are the values found, and the classes of values (each kind, and any).  The corpus gives the numbers
   of documents with an entity, with a term, and with both: within ``REACH`` characters of each other for a value,
   anywhere in the document for a class.  Pointwise mutual information as a share of the information content of
   the entity says how much of it a term discloses: PMI(e; t) / IC(e) = 1 - log P(e | t) / log P(e).  Classes have
   many chance terms, so for them P(e | t) is the lower end of its Wilson interval at ``SURE`` standard deviations, and
   documents that share a value, directly or through others, are one observation: what they have in common tells
   of that value, not of its class.
5. Near copies (``near_copies``: five-word shingles of what spans leave, Jaccard similarity of 0.8 or more, none lost) among the
   documents with an entity are one observation in all these numbers.  A term that ``SUPPORT`` observations support, with which the entity is
   likelier than not (``LIKELY``), and that discloses ``REMOVE`` or more of some entity is removed wherever it stands; from ``GENERALISE`` on it is replaced by its class.

A match's position is the sum of the lengths of the gaps and matches before it, added up in chunks, and texts are cut
from blocks, so that the work grows with the text and not with its square.

Defined results: null and empty texts have no spans; repeated rows are kept, and count as one document in the
statistics; matches are leftmost and do not overlap within a kind, spans of different kinds may; terms overlap no
base span; an empty table gives no rows; other columns are ignored by the query and kept by ``sanitised``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import near_copies
from ._common import looked_up, modest, reliable, selected, table, written
from .simhash_dedup import components

KINDS = ("email", "ip", "card", "phone")
ACTIONS = ("generalise", "remove")
SECRET = 16
REACH = 80
SUPPORT = 3
LIKELY = 0.5
GENERALISE, REMOVE = 0.75, 0.9
SURE = 3.0
#: Up to so many terms are looked for in every text at once; more are first joined with the words of each text.
INLINE = 1000
#: Values that a running sum goes through at once, and characters of a block that texts are cut from.
CHUNK, BLOCK = 64, 4096
PLACEHOLDER = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "secret": "[SECRET]", "generalise": "[TERM]", "remove": ""}

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# A match can begin only where a run of its first class does, or where the last match ended; repetition that nothing
# has to give back is possessive.  The matches are those of the plain patterns, in linear time.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# What every match of a kind has in it, to look for before matches are searched one by one.
_NEED = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": "[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9][ ().0-9-]"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
# ASCII characters are listed one by one, which makes them a table look-up
_RUN = rf"[{string.ascii_letters}{string.digits}\p{{L}}\p{{N}}]+"
_EDGES = (r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])")
_SECRET = rf"{_EDGES[0]}(?=[A-Za-z0-9]*[0-9][A-Za-z])[A-Za-z0-9]{{{SECRET},}}{_EDGES[1]}"
_HEX = "(?=[0-9a-fA-F]*[0-9])(?=[0-9]*[a-fA-F])[0-9a-fA-F]"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = _digits(match)
    return {
        "email": F.lit(True),
        "ip": match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": F.length(digits).between(16, 19) & _luhn(digits),
        "phone": F.length(digits).between(8, 15),
    }[kind]


def _value(kind: str, match: Column) -> Column:
    return {"email": F.lower(match), "ip": match}.get(kind, _digits(match))


def _bound(value: Column, of) -> Column:
    """of(value) with the value computed once: lambdas would compute it again for every element."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _scan(values: Column, op) -> Column:
    """Running op (associative, with 0 as its start) over an array of whole numbers from 0 on."""
    none = F.array().cast("array<int>")
    begin = lambda: F.struct(F.lit(0).alias("at"), none.alias("out"))

    def inside(a: Column, x: Column) -> Column:
        return F.struct(op(a["at"], x).alias("at"), F.array_append(a["out"], op(a["at"], x)).alias("out"))

    def before(a: Column, chunk: Column) -> Column:
        return F.struct(op(a["at"], chunk["at"]).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))

    chunks = lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / CHUNK).cast("int") - 1, F.lit(0))), lambda c: F.aggregate(F.slice(v, c * CHUNK + 1, CHUNK), begin(), inside))
    joined = lambda found: F.flatten(F.zip_with(found, F.aggregate(found, begin(), before)["out"], lambda chunk, o: F.transform(chunk["out"], lambda y: op(o, y))))
    return _bound(values, lambda v: _bound(chunks(v), joined))


def _located(text: Column, matches: Column, pattern: Column | str) -> Column:
    """array of (start, end, match) of the matches of a pattern."""

    def walk(x: Column) -> Column:
        steps = F.transform(x["m"], lambda m, i: F.char_length(F.get(x["gaps"], i)) + F.char_length(m))
        one = lambda m, end: F.struct((end - F.char_length(m)).alias("start"), end.alias("end"), m.alias("match"))
        return F.zip_with(x["m"], _scan(steps, lambda a, b: a + b), one)

    return _bound(F.struct(matches.alias("m"), F.split(text, pattern, -1).alias("gaps")), walk)


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from start up to end of a text in blocks."""
    first = F.floor(start / BLOCK).cast("int")
    parts = F.slice(blocks, first + 1, F.floor((end - 1) / BLOCK).cast("int") - first + 1)
    piece = lambda b, k: F.substring(b, F.greatest(start - (first + k) * BLOCK, F.lit(0)) + 1, end - F.greatest(start, (first + k) * BLOCK))
    return F.when(end > start, F.array_join(F.transform(parts, piece), "")).otherwise("")


def _replaced(text: Column, spans: Column, put) -> Column:
    """The text with put(span, free, upto) for spans, an array of structs by start; ``upto`` is where the spans before end, and
    a span is free if it begins there or later."""

    def fill(x: Column) -> Column:
        upto = lambda i: F.when(i > 0, F.get(x["ends"], i - 1)).otherwise(0)
        pieces = F.transform(x["spans"], lambda s, i: F.concat(_cut(x["blocks"], upto(i), s["start"]), put(s, s["start"] >= upto(i), upto(i))))
        return F.concat(F.array_join(pieces, ""), _cut(x["blocks"], F.element_at(x["ends"], -1), x["n"]))

    ends = lambda s: _scan(F.transform(s, lambda y: y["end"]), lambda a, b: F.greatest(a, b))
    held = _bound(F.sort_array(spans), lambda s: F.struct(s.alias("spans"), ends(s).alias("ends"), _blocks(text).alias("blocks"), F.char_length(text).alias("n")))
    return F.when(F.size(spans) > 0, _bound(held, fill)).otherwise(text)


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with text (null: empty) and ``found``: array of (kind, start, end, value), by kind and start."""
    step = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    text = F.col("text")
    matches = {f"_m_{k}": F.when(text.rlike(_NEED[k]), F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))) for k in KINDS}
    step = step.withColumns(matches)
    parts = []
    for kind in KINDS:
        m = F.col(f"_m_{kind}")
        spans = _kept(kind, _located(text, m, PATTERNS[kind]))
        some = F.exists(m, _check(kind))
        parts.append(F.when(some, spans).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")))
    return step.withColumn("found", F.concat(*parts)).drop(*matches)


def _check(kind: str):
    return lambda m: _valid(kind, m)


def _kept(kind: str, spans: Column) -> Column:
    good = F.filter(spans, lambda x: _valid(kind, x["match"]))
    return F.transform(good, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), _value(kind, x["match"]).alias("value")))


def _blanked(text: Column, spans: Column) -> Column:
    """The text with blanks for the characters of spans, each at its place: what identifiers hold is no term."""
    places = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return _replaced(text, places, lambda s, free, upto: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], upto), F.lit(0))))


def _term(run: Column) -> Column:
    """The term of a run: itself, or the form of an identifier."""
    size = F.length(run).cast("string")
    form = F.when(run.rlike("^[0-9]+$"), F.concat(F.lit("9{"), size, F.lit("}"))).when(run.rlike("^[0-9a-fA-F]+$"), F.concat(F.lit("h{"), size, F.lit("}"))).otherwise(F.translate(run, "012345678", "9" * 9))
    return F.when(run.rlike("[0-9]"), form).otherwise(run)


def _term_pattern(term: Column) -> Column:
    """What the runs of a term match."""
    literal = F.replace(term, F.lit("9"), F.lit("[0-9]"))
    return F.when(term.rlike(r"^9\{"), F.concat(F.lit("[0-9]"), F.substring(term, 2, 1 << 30))).when(term.rlike(r"^h\{"), F.concat(F.lit(_HEX), F.substring(term, 2, 1 << 30))).otherwise(literal)


def _any_term(terms: Column) -> Column:
    """One pattern for the runs of an array of terms."""
    return F.concat(F.lit(f"{_EDGES[0]}(?:"), F.array_join(F.transform(F.sort_array(terms), _term_pattern), "|"), F.lit(f"){_EDGES[1]}"))


def _terms(text: Column) -> Column:
    """The distinct terms of a text."""
    formed = lambda runs: F.when(text.rlike("[0-9]"), F.array_distinct(F.transform(runs, _term))).otherwise(runs)
    return _bound(F.array_distinct(F.regexp_extract_all(text, F.lit(_RUN), F.lit(0))), formed)


def _near(blank: Column, n: Column, x: Column) -> Column:
    """Terms within ``REACH`` characters of a span, of a text in blocks with n characters; a run that the reach cuts is none,
    one at an end of the text is."""
    # a character more than the reach tells whether the run at its edge goes on
    before = F.concat(F.when(x["start"] > REACH, F.lit("")).otherwise(F.lit(" ")), _cut(blank, F.greatest(x["start"] - REACH - 1, F.lit(0)), x["start"]))
    after = F.concat(_cut(blank, x["end"], F.least(x["end"] + REACH + 1, n)), F.when(n - x["end"] > REACH, F.lit("")).otherwise(F.lit(" ")))
    left = F.regexp_extract_all(before, F.lit(rf"(?<=[^\p{{L}}\p{{N}}]){_RUN}+{_EDGES[1]}"), F.lit(0))
    right = F.regexp_extract_all(after, F.lit(rf"{_EDGES[0]}{_RUN}+(?=[^\p{{L}}\p{{N}}])"), F.lit(0))
    return F.array_distinct(F.transform(F.concat(left, right), _term))


def _blanked_docs(docs: DataFrame) -> DataFrame:
    """docs with ``found``, ``secrets`` and ``blank``, the text that they leave."""
    step = base_spans(docs)
    step = step.withColumn("_left", F.when(F.size("found") > 0, _blanked(F.col("text"), F.col("found"))).otherwise(F.col("text")))
    left = F.col("_left")
    secrets = F.transform(_located(left, F.regexp_extract_all(left, F.lit(_SECRET), F.lit(0)), _SECRET), lambda x: F.struct(F.lit("secret").alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("value")))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    # the second pattern is looked for only where the first one is
    step = step.withColumn("secrets", F.when(left.rlike("[0-9][A-Za-z]") & left.rlike(_SECRET), secrets).otherwise(none))
    return step.withColumn("blank", F.when(F.size("secrets") > 0, _blanked(left, F.col("secrets"))).otherwise(left)).drop("_left")


def _with_entities(docs: DataFrame) -> DataFrame:
    """(th, found, blank, rows, origin, family) of the distinct texts of docs that hold an entity; near copies have one
    origin, and origins that share a value one family."""
    th = near_copies.text_hash(F.col("text"))
    spans = selected(_blanked_docs(docs.select("text")).withColumn("found", F.concat("found", "secrets")), F.size("found") > 0)
    texts = written(spans.groupBy(th.alias("th")).agg(F.first("found").alias("found"), F.first("blank").alias("blank"), F.count("*").alias("rows")))
    sets = written(near_copies.native_sets(texts.select("th", F.col("blank").alias("text"))))
    grouped = near_copies.groups(near_copies.native_parts(sets), lambda nodes: sets.join(modest(nodes), "th", "left_semi"))
    origins = reliable(texts.select("th", "found").join(modest(grouped), "th", "left").select("th", F.coalesce("label", "th").alias("origin"), F.transform("found", _entity).alias("values")))
    values = reliable(origins.select("origin", F.explode("values").alias("entity")).distinct())
    # an address may be in most texts
    first = reliable(values.groupBy("entity").agg(F.min("origin").alias("v"), F.count("*").alias("n")).filter("n > 1"))
    shared = reliable(looked_up(values, first, "entity", "n").filter("origin <> v").select(F.col("origin").alias("u"), "v").distinct())
    families = reliable(components(shared).select(F.col("node").alias("origin"), F.col("label").alias("family")))
    named = reliable(origins.join(modest(families), "origin", "left").select("th", "origin", F.coalesce("family", "origin").alias("family")))
    return texts.join(modest(named), "th")


def _entity(x: Column) -> Column:
    return F.concat_ws(":", x["kind"], x["value"])


def revealing_terms(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE, sure: float = SURE) -> DataFrame:
    """(term, action, disclosure) from docs(text): terms that disclose a protected entity."""
    known = _with_entities(docs)
    places = lambda x: F.struct(_entity(x).alias("entity"), _near(F.col("b"), F.col("n"), x).alias("terms"))
    near = known.select("origin", "found", F.char_length("blank").alias("n"), _blocks(F.col("blank")).alias("b")).select("origin", F.explode(F.transform("found", places)).alias("x"))
    near = reliable(near.select("origin", "x.entity", F.explode_outer("x.terms").alias("term")).distinct())
    # of the terms of each origin and family, how many documents have them; near copies may differ in a few
    by_origin = written(known.select("origin", "family", "rows", F.explode(_terms(F.col("blank"))).alias("term")).groupBy("origin", "family", "term").agg(F.sum("rows").alias("rows")))
    by_family = by_origin.groupBy("family", "term").agg(F.sum("rows").alias("rows"))
    kinds = F.array_append(F.array_distinct(F.transform("found", lambda x: x["kind"])), F.lit("any"))
    classes = reliable(known.select("family", F.explode(kinds).alias("entity")).distinct())
    count, spare = F.count("*"), (F.sum("rows") - F.count("*")).alias("spare")
    views = [
        # pairs, entities and terms, where an origin or a family is one observation
        ("origin", near.filter("term is not null").groupBy("entity", "term").agg(count.alias("n_et")), near.select("origin", "entity").distinct(), by_origin, 0.0),
        ("family", by_family.join(classes, "family").groupBy("entity", "term").agg(count.alias("n_et")), classes, by_family, sure),
    ]
    views = [(unit, reliable(pairs.filter(F.col("n_et") >= support)), entities.groupBy("entity").agg(count.alias("n_e")), of.groupBy("term").agg(spare), z) for unit, pairs, entities, of, z in views]
    wanted = modest(reliable(views[0][1].select("term").union(views[1][1].select("term")).distinct()))
    # counted before the join, which then makes a row for each term and not for each place where it stands
    counted = _blanked_docs(docs.select("text")).select(F.explode(_terms(F.col("blank"))).alias("term")).groupBy("term").agg(count.alias("rows"))
    counted = reliable(counted.join(wanted, "term"))
    n_rows = docs.count()
    worst = None
    for unit, pairs, n_entity, spared, z in views:
        n_docs = float(max(n_rows - (known.agg((F.sum("rows") - F.count_distinct(unit)).alias("n")).first().n or 0), 1))
        n_term = counted.join(spared, "term", "left").select("term", (F.col("rows") - F.coalesce("spare", F.lit(0))).cast("double").alias("n_t"))
        information = F.log2(F.lit(n_docs) / F.col("n_e"))
        p, n = F.col("n_et") / F.col("n_t"), F.col("n_t")
        likely = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        share = F.when((information > 0) & (likely > 0) & (p >= LIKELY), 1 + F.log2(likely) / information).otherwise(F.lit(0.0))
        found = pairs.join(n_entity, "entity").join(n_term, "term").groupBy("term").agg(F.max(share).alias("disclosure"))
        worst = found if worst is None else worst.union(found).groupBy("term").agg(F.max("disclosure").alias("disclosure"))
    return worst.filter(F.col("disclosure") >= generalise).select("term", F.when(F.col("disclosure") >= remove, F.lit("remove")).otherwise(F.lit("generalise")).alias("action"), "disclosure")


def _one_pattern(found: list[Row]) -> str | None:
    """One pattern for (term, pattern) rows; plain terms are put together by their first characters."""
    plain: dict[str, list[str]] = {}
    forms = []
    for r in sorted(found):
        if r.pattern == r.term:
            plain.setdefault(r.term[0], []).append(r.term[1:])
        else:
            forms.append(r.pattern)
    parts = forms + [f"{first}(?:{'|'.join(rest)})" for first, rest in plain.items()]
    return f"{_EDGES[0]}(?:{'|'.join(parts)}){_EDGES[1]}" if parts else None


def detected(docs: DataFrame, inline: int = INLINE, **thresholds) -> DataFrame:
    """docs with text (null: empty), ``found`` and ``terms``: array of (kind, start, end), by kind (secrets, generalised and
    removed terms) and start."""
    flagged = reliable(revealing_terms(docs, **thresholds))
    if flagged.count() <= inline:
        rows = flagged.select("term", _term_pattern(F.col("term")).alias("pattern"), "action").collect()
        # looked for together first: most texts have none of them
        some = _one_pattern(rows)
        step = _blanked_docs(docs).withColumn("_some", F.col("blank").rlike(some) if some else F.lit(False))
        step = step.withColumns({f"_{a}": F.when(F.col("_some"), F.lit(_one_pattern([r for r in rows if r.action == a])).cast("string")) for a in ACTIONS}).drop("_some")
    else:
        patterns = [F.max(F.when(F.col("action") == a, F.col("pattern"))).alias(f"_{a}") for a in ACTIONS]
        doc = F.xxhash64("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")))
        keyed = _blanked_docs(docs.withColumn("_doc", doc))
        hits = keyed.select("_doc", F.explode(_terms(F.col("blank"))).alias("term")).join(modest(flagged), "term")
        hits = hits.groupBy("_doc", "action").agg(_any_term(F.collect_set("term")).alias("pattern")).groupBy("_doc").agg(*patterns)
        step = keyed.join(modest(reliable(hits)), "_doc", "left").drop("_doc")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    parts, made = [_as_kind("secret", F.col("secrets"))], {}
    for action in ACTIONS:
        given = F.col(f"_{action}")
        made[f"_t_{action}"] = F.when(given.isNotNull(), F.regexp_extract_all(F.col("blank"), given, F.lit(0)))
        parts.append(F.when(F.size(F.coalesce(F.col(f"_t_{action}"), F.array().cast("array<string>"))) > 0, _as_kind(action, _located(F.col("blank"), F.col(f"_t_{action}"), given))).otherwise(none))
    return step.withColumns(made).withColumn("terms", F.concat(*parts)).drop("blank", "secrets", *made, *[f"_{a}" for a in ACTIONS])


def _as_kind(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def sanitised(docs: DataFrame, **thresholds) -> DataFrame:
    """The documents with spans replaced: identifiers and generalised terms by their class, removed terms by nothing.
    Spans that overlap are one, of the first one's class.  n_chars, where it exists, follows the text."""
    other = {c: f"_given_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    step = detected(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(a) for c, a in other.items()]), **thresholds)
    places = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    step = step.withColumn("_spans", F.concat(places("found"), places("terms")))
    label = lambda kind: F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in PLACEHOLDER.items()])
    done = _replaced(F.col("text"), F.col("_spans"), lambda s, free, upto: F.when(free, label(s["kind"])).otherwise(""))
    step = step.withColumn("text", done)
    if "n_chars" in other:
        step = step.withColumn(other["n_chars"], F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return step.select(*[F.col(other.get(c, c)).alias(c) for c in docs.columns])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = [_count(kind) for kind in KINDS]
    base, terms = _listed(F.col("found")), _listed(F.col("terms"))
    spans = F.concat_ws(",", F.nullif(base, F.lit("")), F.nullif(terms, F.lit("")))
    n = [F.size("terms").cast("long").alias("n_terms"), (F.size("found") + F.size("terms")).cast("long").alias("n_spans")]
    return detected(docs).select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"), *n)


def _count(kind: str) -> Column:
    return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
