"""Similar series without pairing all of them: a join of prefixes that norms bound.

Series are brought to length 1, and their times are put into one order, rare ones first.  What is left of a series after its first
times bounds the cosine that it can have with any series that has none of these times: two series can only reach a cosine if they
share a time in the prefixes that end where the rest becomes shorter than that cosine.  Pairs that share one carry the sum
of products over the shared times, to which the rest can add so much at most; only pairs that can still reach the cosine are
measured in full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import shared_checkpoints
from ..functions.numeric import cosine

#: Cosines are compared with so much to spare: for rounded ones, and for the constant in their denominator.
SLACK = 2e-6
#: Times of a series that the first guess at its nearest centre looks at; parts that a hot series' copies are dealt to.
GUESS_TIMES, PARTS = 3, 16


def _unit(df: DataFrame, key: str) -> DataFrame:
    """(key, ts, w): series of length 1; a series has a row a time."""
    square = F.col("cnt").cast("double") * F.col("cnt")
    length = F.sqrt(F.sum(square).over(Window.partitionBy(key)))
    return df.select(key, "ts", (F.col("cnt") / length).alias("w"), length.alias("_l")).filter("_l > 0").drop("_l")


def _prefixes(unit: DataFrame, frequency: DataFrame, key: str, reach: Column) -> DataFrame:
    """(key, ts, w, rest, last): the first times of each series, until the length of the rest is below ``reach``; that length, and the
    last of these times in the order."""
    ordered = unit.join(frequency, "ts")
    before = F.coalesce(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key).orderBy("_f", "ts").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    least = F.greatest(reach - SLACK, F.lit(0.0))
    kept = ordered.withColumn("_in", 1 - before >= least * least).filter("_in")
    own = Window.partitionBy(key)
    rest = F.sqrt(F.greatest(F.lit(0.0), 1 - F.sum(F.col("w") * F.col("w")).over(own)))
    return kept.select(key, "ts", "w", rest.alias("rest"), F.max(F.struct("_f", "ts")).over(own).alias("last"))


def _frequency(*sides: DataFrame) -> DataFrame:
    times = sides[0].select("ts")
    for side in sides[1:]:
        times = times.union(side.select("ts"))
    return times.groupBy("ts").agg(F.count("*").alias("_f"))


def _met(left: DataFrame, right: DataFrame, key: str, centre: str) -> DataFrame:
    """(key, centre, bound): pairs that share a time of both sides, and the cosine that they can have."""
    other = right.select(centre, "ts", F.col("w").alias("v"), F.col("rest").alias("_rest"), F.col("last").alias("_last"))
    shared = left.join(other, "ts").groupBy(key, centre)
    sums = shared.agg(F.sum(F.col("w") * F.col("v")).alias("dot"), F.sum(F.col("w") * F.col("w")).alias("ww"), F.sum(F.col("v") * F.col("v")).alias("vv"), *[F.max(c).alias(c) for c in ("rest", "_rest", "last", "_last")])
    left_over = lambda c: F.sqrt(F.greatest(F.lit(0.0), 1 - F.col(c)))
    # behind the prefix that ends first nothing is known to be shared
    bound = F.col("dot") + F.when(F.col("last") <= F.col("_last"), F.col("rest") * left_over("vv")).otherwise(F.col("_rest") * left_over("ww"))
    return sums.select(key, centre, bound.alias("bound"))


def candidates(series: DataFrame, centres: DataFrame, rho: float, key: str = "template", centre: str = "cluster") -> DataFrame:
    """(key, centre) of the pairs that can have a cosine of rho or more; all that have one are among them."""
    x, y = _unit(series, key), _unit(centres, centre)
    frequency = _frequency(x, y)
    met = _met(_prefixes(x, frequency, key, F.lit(rho)), _prefixes(y, frequency, centre, F.lit(rho)), key, centre)
    return met.filter(F.col("bound") >= rho - SLACK).select(key, centre)


def measured(pairs: DataFrame, series: DataFrame, centres: DataFrame, key: str = "template", centre: str = "cluster") -> DataFrame:
    """(key, centre, cos) of pairs(key, centre)."""
    norm = lambda df, k: df.groupBy(k).agg(F.sum(F.col("cnt").cast("double") * F.col("cnt")).alias(f"n_{k}"))
    other = centres.select(centre, "ts", F.col("cnt").alias("c"))
    dots = pairs.join(series.select(key, "ts", "cnt"), key).join(other, [centre, "ts"]).groupBy(key, centre).agg(F.sum(F.col("cnt").cast("double") * F.col("c")).alias("d"))
    return dots.join(norm(series, key), key).join(norm(centres, centre), centre).select(key, centre, cosine(F.col("d"), F.col(f"n_{key}"), F.col(f"n_{centre}")).alias("cos"))


def similar_above(series: DataFrame, centres: DataFrame, rho: float, key: str = "template", centre: str = "cluster") -> DataFrame:
    """(key, centre, cos) of all pairs of series(key, ts, cnt) and centres(centre, ts, cnt) with a cosine of rho or more, and of some a
    little below.  A series has one row a time; counts are not negative."""
    return measured(candidates(series, centres, rho, key, centre), series, centres, key, centre)


def nearest_candidates(series: DataFrame, centres: DataFrame, key: str = "template", centre: str = "cluster") -> DataFrame:
    """(key, centre) of the pairs among which is each series' nearest centre, of those that share a time with it.

    A first guess, the centre with the largest products at a series' heaviest times, is measured; no prefix needs to go further
    than the rest can make up for that cosine."""
    x, y = _unit(series, key), _unit(centres, centre)
    heavy = x.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("w"), "ts"))).filter(F.col("_n") <= GUESS_TIMES)
    guessed = heavy.join(y.select(centre, "ts", F.col("w").alias("v")), "ts").groupBy(key, centre).agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    guess = guessed.groupBy(key).agg(F.max_by(centre, F.struct("dot", centre)).alias(centre))
    reach = measured(guess, series, centres, key, centre).select(key, F.col("cos").alias("reach"))
    reached = x.join(reach, key, "left").withColumn("reach", F.coalesce("reach", F.lit(0.0)))
    frequency = _frequency(x, y)
    first = _prefixes(reached, frequency, key, F.col("reach"))
    whole = _prefixes(y, frequency, centre, F.lit(0.0))
    met = _met(first, whole, key, centre).join(reach, key, "left")
    return met.filter(F.col("bound") >= F.coalesce("reach", F.lit(0.0)) - SLACK).select(key, centre)


def nearest_similar(series: DataFrame, centres: DataFrame, key: str = "template", centre: str = "cluster") -> DataFrame:
    """(key, centre, cos) of pairs among which is each series' nearest centre."""
    return measured(nearest_candidates(series, centres, key, centre), series, centres, key, centre)


def distinct_series(series: DataFrame, key: str = "template") -> tuple[DataFrame, DataFrame]:
    """(series of one key for each set of equal ones, (key, same)): same is the smallest key with that series.  Series are known by
    two 64-bit hashes of their rows."""
    shared_checkpoints(series.sparkSession)
    listed = series.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ts", "cnt"))).alias("_l"))
    known = listed.select(key, F.xxhash64("_l").alias("_a"), F.xxhash64(F.lit(1), "_l").alias("_b")).checkpoint()
    first = known.groupBy("_a", "_b").agg(F.min(key).alias("same"))
    # many series may be equal: their rows are dealt to parts
    parts = first.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    members = known.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")).join(parts, ["_a", "_b", "_part"]).select(key, "same")
    return series.join(first.select(F.col("same").alias(key)), key, "left_semi"), members
