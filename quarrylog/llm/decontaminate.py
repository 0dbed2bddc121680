"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items become lower-cased tokens without ASCII punctuation.  An item's seeds are its runs of ``MINIMUM``
tokens, or the whole of a shorter item, by Karp-Rabin fingerprints.

1. Filter.  Two bits for each seed, in a table of ``FILTER_BITS`` at most, go to all tasks.  One pass over the documents
   hands on those in which the fingerprint of a run of tokens has both bits set, with these fingerprints.
2. Join.  Seeds are joined by their fingerprints.  To cover enough of an item, a document has to share a known number
   of its seeds; leaving out fewer than that many of the item's most frequent seeds loses no pair, and so only the rest
   are joined.
3. Tiles, for each document with its items.  The longest match of unmarked tokens (the first one in the document,
   and then in the item) is marked; this goes on until no match of the minimum is left.  The longest length is
   found by bisection, with fingerprints rolled over what is unmarked, so that neither seeds nor matches are
   listed in pairs.  Each token is covered by one tile at most, so the share of the item's tokens under tiles measures
   what the document contains of it in whatever order.

Defined results: null and empty documents and items, and those without a token, match nothing; repeated rows of documents
give repeated rows, repeated items a row each; a null doc_id is kept; an empty table on either side gives no rows;
columns other than doc_id, item_id and text are ignored by ``contaminated`` and kept by ``decontaminated``, which knows
documents by their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _tokens as T
from ._common import looked_up, modest, octets, reliable, slices, table, written

MINIMUM = 5
COVERAGE = 0.5
#: The filter has up to 2 ** FILTER_BITS bits (16 MB), and SPARE times as many as seeds until then.
FILTER_BITS = 27
SPARE = 1024
#: Items of a document that one row may hold are a part of so many, at least, and take so many octets, about.
PARTS, PART_OCTETS = 16, 1 << 20
#: Items of a seed that one row may hold, about.
SEED_ITEMS = 1024


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = T.lowered(T.words_of(column, T.PUNCTUATION))
    return T.word_hashes(words), words.first


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of every ``size`` consecutive tokens; those of other sizes differ."""
    with np.errstate(over="ignore"):
        return T.mix(T.rolling(hashes, size) + np.uint64(size))


def _left(free: np.ndarray) -> np.ndarray:
    """How many free tokens in a row begin at each token."""
    at = np.arange(len(free))
    stop = np.where(free, len(free), at)
    return np.minimum.accumulate(stop[::-1])[::-1] - at


def tiles(doc: np.ndarray, item: np.ndarray, minimum: int = MINIMUM) -> list[tuple[int, int, int]]:
    """(document position, item position, length) of the tiles in the order in which they are marked."""
    if len(item) < minimum or len(doc) < minimum:
        return []
    seeds_d, seeds_i = T.rolling(doc, minimum), T.rolling(item, minimum)
    under = lambda hit, n: np.cumsum(np.r_[hit, np.zeros(n - len(hit), bool)].astype(np.int64) - np.r_[np.zeros(minimum, bool), hit, np.zeros(n, bool)][:n]) > 0
    hit = np.isin(seeds_d, seeds_i)
    if not hit.any():
        return []
    # only tokens under a seed can come under a tile; the others are left out, with a mark where they stood
    place = np.flatnonzero(under(hit, len(doc)))
    gap = np.flatnonzero(np.diff(place) > 1) + 1
    place = np.insert(place, gap, -1)
    tokens = np.where(place < 0, np.uint64(0), doc[place])
    free_d, free_i = place >= 0, under(np.isin(seeds_i, seeds_d), len(item))
    found: list[tuple[int, int, int]] = []
    longest = len(item)
    while True:
        left_d, left_i = _left(free_d), _left(free_i)

        def windows(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Where free windows of n tokens begin on both sides, and their fingerprints."""
            at_d, at_i = np.flatnonzero(left_d >= n), np.flatnonzero(left_i >= n)  # noqa: B023
            return at_d, T.rolling(tokens, n)[at_d], at_i, T.rolling(item, n)[at_i]

        low, high = minimum - 1, int(min(left_d.max(), left_i.max(), longest))
        while low < high:
            middle = (low + high + 1) // 2
            _, of_d, _, of_i = windows(middle)
            if np.isin(of_i, of_d).any():
                low = middle
            else:
                high = middle - 1
        if low < minimum:
            return found
        longest = low
        at_d, of_d, at_i, of_i = windows(longest)
        both = np.isin(of_d, of_i)
        at_d, of_d = at_d[both], of_d[both]
        # all matches are as long now, so they are marked in their order
        while len(at_d):
            i = int(at_d[0])
            j = int(at_i[of_i == of_d[0]][0])
            found.append((int(place[i]), j, longest))
            free_d[i : i + longest] = False
            free_i[j : j + longest] = False
            apart = (at_i <= j - longest) | (at_i >= j + longest)
            at_i, of_i = at_i[apart], of_i[apart]
            rest = (at_d >= i + longest) & np.isin(of_d, of_i)
            at_d, of_d = at_d[rest], of_d[rest]


def _needed(tokens: np.ndarray, coverage: float, minimum: int) -> np.ndarray:
    """The least number of an item's seeds under tiles that cover enough of it: tiles of the minimum have one each."""
    size = np.minimum(tokens, minimum)
    least = np.maximum(np.ceil(coverage * tokens - 1e-9).astype(np.int64), 1)
    totals = [np.minimum(np.maximum(least, size) + k, tokens) for k in range(minimum)]
    return np.min([t - (size - 1) * (t // np.maximum(size, 1)) for t in totals], axis=0)


def item_seeds(items: DataFrame, coverage: float, minimum: int) -> DataFrame:
    """(item, n, need, size, gram, times) of items(item, text): distinct seeds, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, first = _tokens(part.column("text"))
                n = np.diff(first)
                need = _needed(n, coverage, minimum)
                for row in np.flatnonzero(n):
                    size = min(int(n[row]), minimum)
                    gram, times = np.unique(_grams(hashes[first[row] : first[row + 1]], size), return_counts=True)
                    same = lambda v, t: pa.array(np.full(len(gram), v), t)  # noqa: B023, E731
                    yield pa.record_batch({"item": same(part.column("item")[int(row)].as_py(), pa.int64()), "n": same(n[row], pa.int64()), "need": same(need[row], pa.int64()), "size": same(size, pa.int32()), "gram": pa.array(gram.view(np.int64)), "times": pa.array(times)})

    return items.mapInArrow(run, "item long, n long, need long, size int, gram long, times long")


def _filter(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """The bits of all seeds, packed by 64, and how many bits number one."""
    bits = min(FILTER_BITS, max(16, (SPARE * seeds.count()).bit_length()))
    second = F.xxhash64("gram")
    places = seeds.select(F.explode(F.array(*[F.shiftrightunsigned(c, 64 - bits) for c in (F.col("gram"), second)])).alias("bit"))
    words = places.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))).alias("mask"))
    got = words.toArrow()  # 2 ** (FILTER_BITS - 6) rows at most
    packed = np.zeros(1 << (bits - 6), np.uint64)
    packed[got.column("word").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
    return packed, bits


def _passes(grams: np.ndarray, packed: np.ndarray, bits: int) -> np.ndarray:
    def has(x: np.ndarray) -> np.ndarray:
        bit = x >> np.uint64(64 - bits)
        return (packed[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1

    some = np.flatnonzero(has(grams))
    eight = np.ascontiguousarray(grams[some]).view(np.uint8)
    start = 8 * np.arange(len(some))
    return some[has(T.xxh64(np.r_[eight, np.zeros(64, np.uint8)], start, start + 8))]


def _candidates(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(row, doc_id, th, text, grams) of the documents with runs that pass the filter."""
    packed, bits = _filter(seeds)
    sizes = sorted(r.size for r in seeds.select("size").distinct().collect())  # MINIMUM rows at most
    held = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = held.value
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, first = _tokens(part.column("text"))
                rows, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for size in sizes:
                    of = _grams(hashes, size)
                    at = _passes(of, packed, bits)
                    row = np.searchsorted(first, at, "right") - 1
                    inside = at + size <= first[row + 1]
                    rows.append(row[inside])
                    grams.append(of[at[inside]])
                row, gram = np.concatenate(rows), np.concatenate(grams)
                order = np.lexsort((gram, row))
                row, gram = row[order], gram[order]
                new = np.r_[True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])][: len(row)]
                row, gram = row[new], gram[new]
                some = np.unique(row)
                offsets = np.r_[np.searchsorted(row, some), len(row)].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(gram.view(np.int64)))
                kept = part.select(["doc_id", "th", "text"]).take(pa.array(some))
                if kept.num_rows:
                    yield kept.append_column("grams", lists)

    found = docs.mapInArrow(run, "doc_id long, th long, text string, grams array<long>")
    return written(found.withColumn("row", F.monotonically_increasing_id()))


def _pairs(candidates: DataFrame, seeds: DataFrame) -> DataFrame:
    """(row, item) of the pairs that can share enough seeds."""
    grams = candidates.select("row", F.explode("grams").alias("gram"))
    known = grams.groupBy("gram").agg(F.count("*").alias("rows")).join(seeds, "gram")
    # the most frequent seeds are left out as long as they are fewer than an item needs
    upto = Window.partitionBy("item").orderBy(F.desc("rows"), "gram").rowsBetween(Window.unboundedPreceding, 0)
    chosen = known.withColumn("upto", F.sum("times").over(upto)).filter("upto >= need")
    chosen = reliable(chosen.select("gram", "item", "rows"))
    sizes = reliable(chosen.groupBy("gram").agg(F.max("rows").alias("rows"), F.count("*").alias("items"), F.ceil(F.count("*") / SEED_ITEMS).alias("parts")))
    own = looked_up(chosen, sizes.select("gram", "parts", "items"), "gram", "items").withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts")))
    lists = own.groupBy("gram", "part").agg(F.collect_list("item").alias("items"), F.max("rows").alias("rows"))
    lists = reliable(lists.select(F.struct("gram", "part").alias("key"), "items", "rows"))
    sizes = sizes.select("gram", "parts", "rows")
    # a seed of many items is asked for part by part
    asked = looked_up(grams, sizes, "gram", "rows").filter("parts is not null").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    hits = looked_up(asked.select("row", F.struct("gram", "part").alias("key")), lists, "key", "rows").filter("items is not null")
    return reliable(hits.select("row", F.explode("items").alias("item")).distinct())


_TILED = "doc_id long, th long, item long, n_tiles long, longest long, covered long, item_tokens long, coverage double"


def _tiled(candidates: DataFrame, pairs: DataFrame, items: DataFrame, coverage: float, minimum: int) -> DataFrame:
    """_TILED rows of the pairs with enough coverage."""
    times = pairs.groupBy("item").agg(F.count("*").alias("times"))
    asked = looked_up(pairs, reliable(items.join(times, "item")), "item", "times")
    # the whole benchmark, at worst, so that a document that holds it all has rows enough
    parts = max(PARTS, -(-octets(items) // PART_OCTETS))
    part = F.pmod(F.xxhash64("item"), F.lit(parts))
    asked = asked.groupBy("row", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("item", F.col("text").alias("item_text")))).alias("items"))
    both = candidates.select("row", "doc_id", "th", "text").join(asked, "row").select("doc_id", "th", "text", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _TILED.split(", ")]
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                doc, _ = _tokens(one.column("text"))
                of = one.column("items").flatten()
                hashes, first = _tokens(of.field("item_text"))
                rows = []
                for item, a, b in zip(of.field("item").to_pylist(), first[:-1], first[1:], strict=True):
                    found = tiles(doc, hashes[a:b], min(minimum, int(b - a)))
                    covered, n = sum(t for _, _, t in found), int(b - a)
                    if covered and covered >= coverage * n:
                        rows.append((one.column("doc_id")[0].as_py(), one.column("th")[0].as_py(), item, len(found), found[0][2], covered, n, covered / n))
                if rows:
                    yield pa.record_batch({c: pa.array(v, pa.float64() if c == "coverage" else pa.int64()) for c, v in zip(names, zip(*rows, strict=True), strict=True)})

    return both.mapInArrow(run, _TILED)


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _found(docs: DataFrame, benchmark: DataFrame, coverage: float, minimum: int) -> tuple[DataFrame, DataFrame]:
    """_TILED rows, and (item_id, item) of the benchmark: ``item`` numbers its distinct texts."""
    text = F.lower(F.col("text").cast("string"))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash(F.col("text")).alias("th"), text.alias("text")).filter("text <> ''")
    named = reliable(benchmark.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text")).filter("text <> ''"))
    items = reliable(named.select("text").distinct().withColumn("item", F.monotonically_increasing_id()))
    ids = named.join(items, "text").select("item_id", "item")
    seeds = reliable(item_seeds(items, coverage, minimum))
    candidates = _candidates(given, seeds)
    return _tiled(candidates, _pairs(candidates, seeds), items, coverage, minimum), ids


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, minimum: int = MINIMUM) -> DataFrame:
    """(doc_id, item_id, n_tiles, longest, covered, item_tokens, coverage) for each document and item of which the document
    covers ``coverage`` or more."""
    found, ids = _found(docs, benchmark, coverage, minimum)
    return found.join(modest(reliable(ids)), "item").select("doc_id", "item_id", "n_tiles", "longest", "covered", "item_tokens", "coverage")


def decontaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that hold no benchmark item."""
    found, _ = _found(docs, benchmark, coverage, MINIMUM)
    texts = reliable(found.groupBy("th").agg(F.count("*").alias("times")).withColumn("__found", F.lit(True)).withColumnRenamed("th", "__th"))
    marked = looked_up(docs.withColumn("__th", _text_hash(F.col("text"))), texts, "__th", "times")
    return marked.filter("__found is null").select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
