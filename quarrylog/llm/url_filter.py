"""URL filtering by rules and, where no rule fits, by a character language-model ratio; DataFrame expressions only.

The pages that rules decide are the examples: allowed and blocked ones train a variable-order Markov model each, over
the characters of host and path (digits count as one symbol).  A prediction of order k is smoothed towards that of order
k - 1.  Both models keep the same grams: those that occur ``least`` times (an argument; 1 keeps all), whatever the size of the
input; at each position the longest kept gram decides.  The score of a URL is the mean over its positions of the log-likelihood
difference (allowed less blocked).  A fifth of the examples, by hash, trains
nothing and calibrates the threshold: of the hundredths, that with the least balanced error.  Of rules of the same length that
fit, the last one by code point decides.

Defined results: null urls and urls without ``://`` have an empty host and path, no rule fits them and their score is
0; repeated rows are kept; without examples of both kinds every score and the threshold are 0, so that urls pass; an
empty table gives no rows; columns other than page_id and url are ignored.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import looked_up, modest, reliable, repeated, table

#: (verdict, rule); the longest rule that fits decides.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ORDER = 4
LEAST = 2
SMOOTHING = 2.0
HELD_OUT = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _positions(urls: DataFrame) -> DataFrame:
    """A row per position of ``padded``; column g<k> is the gram of order k that ends there."""
    grams = [F.substring(F.col("padded"), F.col("i") + ORDER - k, F.lit(k + 1)).alias(f"g{k}") for k in range(ORDER + 1)]
    return urls.withColumn("i", F.explode(F.sequence(F.lit(1), F.length("padded") - ORDER))).select(*urls.columns, *grams)


def _model(examples: DataFrame, order: int = ORDER, least: int = LEAST) -> list[DataFrame]:
    """For each order (gram, difference), from examples(padded, good, times)."""
    grams = _positions(examples).select("good", "times", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"g{k}").alias("gram")) for k in range(order + 1)])).alias("x"))
    good, bad = (F.sum(F.when(F.col("good") == v, F.col("times")).otherwise(0)) for v in (True, False))
    counts = reliable(grams.groupBy("x.k", "x.gram").agg(good.alias("n1"), bad.alias("n0")))
    total = counts.filter("k = 0").agg(F.coalesce(F.sum("n1"), F.lit(0)).alias("n1"), F.coalesce(F.sum("n0"), F.lit(0)).alias("n0"), F.count("*").alias("symbols")).first()
    if not total.n1 or not total.n0:
        return []
    context = F.expr("substring(gram, 1, k)")
    contexts = counts.filter("k > 0").groupBy("k", context.alias("context")).agg(F.sum("n1").alias("c1"), F.sum("n0").alias("c0"))
    kept = counts.filter((F.col("n1") + F.col("n0") >= least) | (F.col("k") == 0))
    flat = [(F.col(f"n{v}") + 1) / (getattr(total, f"n{v}") + total.symbols) for v in (1, 0)]
    level = kept.filter("k = 0").select("gram", flat[0].alias("p1"), flat[1].alias("p0"))
    levels = [level]
    for k in range(1, order + 1):
        below = level.select(F.col("gram").alias("shorter"), F.col("p1").alias("q1"), F.col("p0").alias("q0"))
        here = kept.filter(F.col("k") == k).withColumns({"context": context, "shorter": F.expr("substring(gram, 2)")})
        here = here.join(contexts.filter(F.col("k") == k).drop("k"), "context").join(below, "shorter")
        p = [(F.col(f"n{v}") + SMOOTHING * F.col(f"q{v}")) / (F.col(f"c{v}") + SMOOTHING) for v in (1, 0)]
        level = reliable(here.select("gram", p[0].alias("p1"), p[1].alias("p0")))
        levels.append(level)
    return [modest(reliable(x.select(F.col("gram").alias(f"g{k}"), (F.log("p1") - F.log("p0")).alias(f"d{k}")))) for k, x in enumerate(levels)]


def filtered(pages: DataFrame, rules=RULES, least: int = LEAST) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, score) of every row of pages(page_id, url)."""
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    # digits are one symbol; a lone symbol marks the end, and ORDER others the start
    body = F.translate(F.concat("host", "path"), string.digits, "0" * 10)
    padded = F.when(F.concat("host", "path") == "", F.lit("\x02" * ORDER)).otherwise(F.concat(F.lit("\x02" * ORDER), body, F.lit("\x03")))
    urls = urls.withColumns({"rule": rule, "said": verdict}).withColumn("padded", padded)
    urls = reliable(urls.groupBy(*urls.columns).agg(F.count("*").alias("times")))
    trains = F.pmod(F.crc32(F.col("padded").cast("binary")), F.lit(HELD_OUT)) != 0
    examples = urls.filter("said is not null and host <> ''").withColumns({"good": F.col("said") == "allow", "trains": trains})
    models = _model(examples.filter("trains").groupBy("padded", "good").agg(F.sum("times").alias("times")), least=least)
    key = ["page_id", "url", "host", "path", "rule", "said", "padded", "times"]
    row = [F.col("page_id").isNull(), F.coalesce("page_id", F.lit(0)), F.col("url")]
    if models:
        at = _positions(urls.filter("host <> '' or path <> ''").select(F.xxhash64(*row).alias("row"), "padded")).select("row", f"g{ORDER}")
        # the models are asked once for each distinct gram; those of lower orders are its ends
        longest = at.groupBy(f"g{ORDER}").agg(F.count("*").alias("times")).withColumns({f"g{k}": F.expr(f"substring(g{ORDER}, {ORDER - k + 1})") for k in range(ORDER)})
        joined = reduce(lambda df, kd: df.join(kd[1], f"g{kd[0]}", "left"), enumerate(models), longest)
        step = F.coalesce(*[F.col(f"d{k}") for k in range(len(models) - 1, -1, -1)], F.lit(0.0))
        steps = reliable(joined.select(f"g{ORDER}", F.round(step * 1e9).cast("long").alias("step"), "times"))
        # the sum is over whole billionths, so that its order does not matter
        scores = looked_up(at, steps, f"g{ORDER}", "times").groupBy("row").agg((F.sum("step") / F.count("*") / 1e9).alias("score"))
        scored = urls.filter("host <> '' or path <> ''").withColumn("row", F.xxhash64(*row)).join(scores, "row").select(*key, "score")
        scored = scored.unionByName(urls.filter("host = '' and path = ''").withColumn("score", F.lit(0.0)))
    else:
        scored = urls.withColumn("score", F.lit(0.0))
    scored = reliable(scored)
    threshold = _threshold(scored.filter(F.col("said").isNotNull() & (F.col("host") != "") & ~trains)) if models else 0.0
    said = F.coalesce("said", F.when(F.col("score") >= threshold, F.lit("allow")).otherwise(F.lit("block")))
    return repeated(scored.select("page_id", "url", "host", "path", "rule", said.alias("verdict"), "score", "times"), "times")


def _threshold(examples: DataFrame) -> float:
    """The least balanced error's score, among hundredths; in the middle of the gap between the scores beside it."""
    count = lambda said: F.sum(F.when(F.col("said") == said, F.col("times")).otherwise(0))
    # a mean of logarithms of ratios: a few thousand hundredths at most
    steps = examples.groupBy(F.floor(F.col("score") * 100).cast("int").alias("at")).agg(count("allow").alias("good"), count("block").alias("bad"))
    upto = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("at")
    lost = F.coalesce(F.sum("good").over(upto), F.lit(0)) / F.greatest(F.sum("good").over(all_), F.lit(1))
    passed = 1 - F.coalesce(F.sum("bad").over(upto), F.lit(0)) / F.greatest(F.sum("bad").over(all_), F.lit(1))
    below = F.coalesce(F.lag("at").over(Window.orderBy("at")) + 1, F.col("at"))
    best = steps.select("at", below.alias("below"), F.round(lost + passed, 9).alias("error")).orderBy("error", "at").first()
    return (best.below + best["at"]) / 200.0 if best else 0.0


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")
