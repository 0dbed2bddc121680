"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame expressions only.

1. Targets.  Sources by code point, null last, weigh 1, 2, 3, 1, ... and share the words of all documents.  A target
   stops at ``MAX_EPOCHS`` times its source's words; the excess is shared again by weight until none is above.  The
   sources that stop are the first ones by the ratio of their limit to their weight, so running sums find them.
2. Blocks.  A seeded permutation makes a source's documents one stream of words, which is cut into blocks of
   ``block_words`` words or a little less, equal but for one word.  The target makes the source's exact block quota.
3. Splitting tree.  A second permutation deals the blocks out to ``2 ** depth`` shards' pools.  A pool offers each of its
   blocks ``MAX_EPOCHS`` times.  From the root down, a node hands its left half a hypergeometric draw of its quota
   (by inversion), out of what the pools below offer: the shards' quotas are multivariate hypergeometric,
   add up to the source's, and none is more than its pool offers.
4. A shard takes whole epochs of its pool and, of one more, the pool's first blocks in permuted order, until its quota is
   met; inside a shard the draws are ordered by a seeded hash.  What a document gives is the sum over its blocks.

Words before a document come from hash ranges, as many as keep ``RANGE_ROWS`` rows in each: a row is placed in its range,
and the ranges' sizes are added up.  No task sees a whole source, and equal rows are counted before they are placed.
Every draw is a function of the seed and the rows' identities: reruns agree.

Defined results: null and empty texts have size 0 and are taken 0 times; null is a source of its own; rows that repeat
are documents of their own, side by side in the stream; an empty table gives no rows; if all sizes are 0, all
targets are 0; columns other than doc_id, source and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import looked_up, reliable, table

MAX_EPOCHS = 3
BLOCK_WORDS = 64
DEPTH = 4
SEED = 20240607
#: Rows that a hash range should hold, and equal rows that one task makes of their count at once.
RANGE_ROWS = 50_000
REPEATS = 10_000
#: Standard deviations on each side of the mode that a hypergeometric draw looks at.
SPREAD = 9
#: A prime above any number of blocks, so that its multiples modulo a number of blocks are a permutation.
_PRIME = (1 << 61) - 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, row, size) of every row; ``row`` names it."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit("[^ \\t-\\r]+")).cast("long"), F.lit(0).cast("long"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("doc_id", "source", "text").alias("row"))


def _key(source: Column | str) -> Column:
    """A source's name that is never null."""
    c = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.concat(F.lit("="), c), F.lit("null"))


def targets(sized: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, s, source_size, target): one row per source, s its number by code point, null last.  The windows without a
    key go over one row a source, which they sort and never hold."""
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # strings compare by their UTF-8 bytes, which is by code point
    numbered = per_source.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    numbered = numbered.withColumns({"weight": (F.col("s") % 3 + 1).cast("long"), "cap": max_epochs * F.col("source_size")})
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "s").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(by_ratio), _long(0))
    free = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_ratio), _long(0))
    step = numbered.withColumns({"rest": rest, "free": free})
    # what is left for those before is enough to fill this one too
    step = step.withColumn("full", F.col("rest").cast("double") * F.col("weight") >= F.col("cap").cast("double") * F.col("free"))
    count = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))).over(whole), _long(0))
    level = (F.sum("source_size").over(whole) - count("cap", F.col("full"))).cast("double") / F.greatest(count("weight", ~F.col("full")), _long(1))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return step.select("source", F.col("s").cast("int").alias("s"), "source_size", target.alias("target"))


def _unit(*columns: Column | str) -> Column:
    """A number from 0 to 1 (exclusive) by the seeded hash of the columns."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *columns), 11).cast("double") + 0.5) / float(1 << 53)


def _hypergeometric(n: Column, good: Column, total: Column, u: Column) -> Column:
    """How many of ``good`` out of ``total`` are among n drawn ones, by inversion at u: weights are taken relative to
    the mode's, up to SPREAD standard deviations to either side."""
    low = F.greatest(F.lit(0).cast("long"), n + good - total)
    high = F.least(n, good)
    d = lambda c: c.cast("double")
    mode = F.floor((d(n) + 1) * (d(good) + 1) / (d(total) + 2))
    mode = F.least(F.greatest(mode, low), high)
    sd = F.sqrt(d(n) * d(good) / F.greatest(d(total), F.lit(1.0)) * (1 - d(good) / F.greatest(d(total), F.lit(1.0))) * (d(total) - d(n)) / F.greatest(d(total) - 1, F.lit(1.0)))
    reach = F.ceil(SPREAD * sd) + 10
    first, last = F.greatest(low, mode - reach), F.least(high, mode + reach)
    more = lambda w, k: w * (d(good - k + 1) * d(n - k + 1)) / (d(k) * d(total - good - n + k))  # noqa: E731  the weight of k from that of k - 1
    less = lambda w, k: w * (d(k + 1) * d(total - good - n + k + 1)) / (d(good - k) * d(n - k))  # noqa: E731  and from that of k + 1

    def choose(x: Column) -> Column:
        """Weights in the order mode, upwards, downwards; the first one whose sum reaches the level is chosen."""
        none = F.array().cast("array<bigint>")
        up = F.when(x["last"] > x["mode"], F.sequence(x["mode"] + 1, x["last"])).otherwise(none)
        down = F.when(x["first"] < x["mode"], F.sequence(x["mode"] - 1, x["first"], F.lit(-1).cast("long"))).otherwise(none)
        state = lambda w, total, at: F.struct(w.alias("w"), total.alias("sum"), at.alias("at"))

        def walk(level: Column) -> Column:
            def step(change):
                return lambda a, k: F.get(F.transform(F.array(change(a["w"], k)), lambda w: state(w, a["sum"] + w, F.when((a["at"] < 0) & (a["sum"] + w >= level), k).otherwise(a["at"]))), F.lit(0))

            start = state(F.lit(1.0), F.lit(1.0), F.when(level <= 1.0, x["mode"]).otherwise(F.lit(-1).cast("long")))
            upper = F.aggregate(up, start, step(more))
            return F.get(F.transform(F.array(upper), lambda s: F.aggregate(down, state(F.lit(1.0), s["sum"], s["at"]), step(less))), F.lit(0))

        return F.get(F.transform(F.array(walk(F.lit(float("inf")))["sum"] * u), lambda level: walk(level)["at"]), F.lit(0))

    # rounding can leave the last sum a little below its level
    held = F.array(F.struct(mode.alias("mode"), first.alias("first"), last.alias("last")))
    return F.get(F.transform(held, lambda x: F.greatest(choose(x), x["first"])), F.lit(0))


def split_quotas(quotas: DataFrame, depth: int = DEPTH, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(s, shard, pool, quota) from quotas(s, n_blocks, quota): ``pool`` is how many blocks a shard has of a source."""
    edge = lambda k, level: _div(k * F.col("n_blocks"), _long(1 << level))  # noqa: E731  where the pools of a node begin
    node = quotas.select("s", "n_blocks", _long(0).alias("shard"), F.col("quota").cast("long").alias("quota"))
    for level in range(depth):
        begin, middle, end = edge(F.col("shard"), level), edge(2 * F.col("shard") + 1, level + 1), edge(F.col("shard") + 1, level)
        left = _hypergeometric(F.col("quota"), max_epochs * (middle - begin), max_epochs * (end - begin), _unit(F.lit(level), "s", "shard"))
        halves = F.array(F.struct((2 * F.col("shard")).alias("shard"), F.col("left").alias("quota")), F.struct((2 * F.col("shard") + 1).alias("shard"), (F.col("quota") - F.col("left")).alias("quota")))
        node = node.withColumn("left", left).select("s", "n_blocks", F.explode(halves).alias("x")).select("s", "n_blocks", "x.shard", "x.quota")
    pool = edge(F.col("shard") + 1, depth) - edge(F.col("shard"), depth)
    return node.select("s", "shard", edge(F.col("shard"), depth).alias("begin"), pool.alias("pool"), "quota")


def plan(goals: DataFrame, block_words: int = BLOCK_WORDS, depth: int = DEPTH, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """goals with n_blocks, quota and, for every shard, where its pool begins and its ``epochs`` and ``more`` blocks."""
    some = F.greatest(F.col("source_size"), _long(1))
    n = F.ceil(F.col("source_size") / block_words).cast("long")
    quota = F.least(max_epochs * F.col("n_blocks"), F.round(F.col("target") * F.col("n_blocks") / some).cast("long"))
    cut = goals.withColumn("n_blocks", n).withColumn("quota", quota)
    shares = split_quotas(cut.select("s", "n_blocks", "quota"), depth, max_epochs)
    pool = F.greatest(F.col("pool"), _long(1))
    share = F.struct("shard", "begin", _div(F.col("quota"), pool).alias("epochs"), F.pmod(F.col("quota"), pool).alias("more"))
    listed = shares.groupBy("s").agg(F.sort_array(F.collect_list(share)).alias("shards"))
    return cut.join(listed, "s")


def placed(sized: DataFrame, goals: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, source, key, row, size, times, offset): distinct rows with their number, and the words of their source's
    stream before them."""
    order = F.xxhash64(F.lit(SEED), "row")
    rows = reliable(sized.groupBy("doc_id", "source", "row", "size").agg(F.count("*").alias("times")).withColumns({"key": _key("source"), "o": order}))
    bits = min(40, max(10, (rows.count() // range_rows).bit_length()))
    rows = rows.withColumn("bucket", F.shiftrightunsigned("o", 64 - bits))
    words = F.col("size") * F.col("times")
    ranges = rows.groupBy("key", "bucket").agg(F.sum(words).alias("w"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("key", "bucket", F.coalesce(F.sum("w").over(before), _long(0)).alias("w_before"))
    inside = Window.partitionBy("key", "bucket").orderBy("o", "row", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(ranges, ["key", "bucket"])
    offset = F.col("w_before") + F.coalesce(F.sum(words).over(inside), _long(0))
    return joined.select("doc_id", "source", "key", "row", "size", "times", offset.alias("offset"))


def _instances(rows: DataFrame) -> DataFrame:
    """Every row as often as it occurs, each with its own part of the stream."""
    one = rows.filter(F.col("times") <= REPEATS).select("*", F.explode(F.sequence(_long(0), F.col("times") - 1)).alias("nth"))
    parts = rows.filter(F.col("times") > REPEATS).select("*", F.explode(F.sequence(_long(0), F.col("times") - 1, _long(REPEATS))).alias("at")).repartition("row", "at")
    many = parts.select(*rows.columns, F.explode(F.sequence(F.col("at"), F.least(F.col("at") + REPEATS, F.col("times")) - 1)).alias("nth"))
    return one.unionByName(many).withColumn("offset", F.col("offset") + F.col("nth") * F.col("size"))


def _draws() -> Column:
    """array of (block, shard, epochs, words) of a row's blocks, from the columns of ``placed`` and ``plan``; blocks have
    ``small`` words, after ``longer`` ones with a word more."""
    n = F.col("n_blocks")
    edge = lambda b: b * F.col("small") + F.least(b, F.col("longer"))
    long_end = F.col("longer") * (F.col("small") + 1)
    block = lambda x: F.when(x < long_end, _div(x, F.col("small") + 1)).otherwise(F.col("longer") + _div(x - long_end, F.greatest(F.col("small"), _long(1))))

    def place(b: Column) -> Column:
        """Where the second permutation puts a block."""
        factor = F.pmod(_long(_PRIME), n)
        product = F.when(n < 1 << 31, F.pmod(b * factor, n)).otherwise(F.pmod(b.cast("decimal(19,0)") * factor.cast("decimal(19,0)"), n.cast("decimal(38,0)")).cast("long"))
        return F.pmod(product + F.pmod(F.xxhash64(F.lit(SEED + 2), "key"), n), n)

    def draw(x: Column) -> Column:
        shards = F.size("shards").cast("long")
        share = F.get("shards", (_div(x["place"] * shards + shards - 1 + n, n) - 1).cast("int"))
        epochs = share["epochs"] + F.when(x["place"] - share["begin"] < share["more"], 1).otherwise(0)
        words = F.least(edge(x["block"] + 1), F.col("offset") + F.col("size")) - F.greatest(edge(x["block"]), F.col("offset"))
        return F.struct(x["block"].alias("block"), share["shard"].alias("shard"), epochs.alias("epochs"), words.alias("words"))

    blocks = F.sequence(block(F.col("offset")), block(F.col("offset") + F.col("size") - 1))
    found = F.transform(F.transform(blocks, lambda b: F.struct(b.alias("block"), place(b).alias("place"))), draw)
    return F.when(F.col("size") > 0, found).otherwise(F.array().cast("array<struct<block:bigint,shard:bigint,epochs:bigint,words:bigint>>"))


def drawn(sized: DataFrame, block_words: int = BLOCK_WORDS, depth: int = DEPTH) -> DataFrame:
    """(doc_id, source, row, size, source_size, target, draws) of every row of sized; draws: array of (block, shard, epochs,
    words)."""
    per_source = reliable(plan(reliable(targets(sized)), block_words, depth).withColumn("key", _key("source")))
    rows = reliable(placed(sized, per_source))
    times = rows.groupBy("key").agg(F.count("*").alias("times"))
    known = reliable(per_source.drop("source", "s", "quota").join(times, "key"))
    joined = looked_up(rows.withColumnRenamed("times", "repeats"), known, "key", "times")
    every = _instances(joined.withColumnRenamed("repeats", "times"))
    n = F.greatest(F.col("n_blocks"), _long(1))
    every = every.withColumns({"small": _div(F.col("source_size"), n), "longer": F.pmod(F.col("source_size"), n)})
    return every.select("doc_id", "source", "row", "nth", "size", "source_size", "target", "key", _draws().alias("draws"))


def mixed_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS, depth: int = DEPTH) -> DataFrame:
    """(doc_id, source, row, nth, block, words, epoch, shard, place): what every shard draws; place orders a shard, and is the
    same for all parts of a block.  ``words`` is the part of the block that a document gives."""
    parts = drawn(reliable(sizes(docs)), block_words, depth).select("doc_id", "source", "key", "row", "nth", F.explode("draws").alias("x"))
    parts = parts.select("doc_id", "source", "key", "row", "nth", "x.block", "x.shard", "x.words", "x.epochs").filter("epochs > 0")
    parts = parts.select("*", F.explode(F.sequence(_long(0), F.col("epochs") - 1)).alias("epoch"))
    return parts.select("doc_id", "source", "row", "nth", "block", "words", "epoch", "shard", F.xxhash64(F.lit(SEED + 1), "key", "block", "epoch").alias("place"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, depth: int = DEPTH) -> DataFrame:
    """(doc_id, source, row, size, source_size, target, taken, n_shards) of every row of docs."""
    found = drawn(reliable(sizes(docs)), block_words, depth)
    taken = F.aggregate("draws", _long(0), lambda a, x: a + x["epochs"] * x["words"])
    shards = F.size(F.array_distinct(F.transform(F.filter("draws", lambda x: x["epochs"] > 0), lambda x: x["shard"])))
    return found.select("doc_id", "source", "row", "size", "source_size", "target", taken.alias("taken"), shards.cast("long").alias("n_shards"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "n_shards")
