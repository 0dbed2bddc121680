"""Near copies: groups of texts by exact Jaccard similarity of word shingles.  No link is lost.

1. The shingles of a text are the hashes of its runs of ``SHINGLE`` words; a shorter text is one shingle.  A pair is a link if
   the exact Jaccard similarity of the two sets of shingles is ``SIMILARITY`` or more; groups are the components of the links.
2. A text of n shingles has at most n - ceil(SIMILARITY * n) that a near copy lacks.  A text with more shingles that no
   other text has is alone.  That is told from the shingles of one hash class of ``CLASSES`` first, which settles most texts,
   then from all shingles of the texts left.
3. Least hashes under ``BANDS`` x ``ROWS`` permutations make ``BANDS`` keys of a text that is left.  A key's texts are dealt to
   parts of about ``PART_ROWS``.  A text is paired with its part's shortest and longest one and, in the order of their lengths,
   with the next ``NEXT`` ones, and a part's shortest one with the key's.  These pairs give most groups at little cost; nothing
   depends on their being all.
4. Then every other pair is looked at.  With its shingles in one order for all texts, rare ones first, a text shares one of
   its first n - ceil(SIMILARITY * n) + 1 with every near copy, and what follows the first shared one bounds the overlap.  All
   pairs that this leaves and whose texts are not in one group by then are compared, in blocks of ``PART_ROWS`` texts.

Texts are known by a 64-bit hash ``th``, so that exact copies are one text.  Texts without words are near copies of each
other: their one shingle is zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import looked_up, modest, reliable, slices, written
from .simhash_dedup import components, majority, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
NEXT = 12
#: Texts of a key that are ordered together, or of a block that are compared with those of another.
PART_ROWS = 512
#: Shingles are told apart by so many classes of hashes (a power of two); those of the first are looked at first.
CLASSES = 4

_FACTORS = np.random.default_rng(5).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _sets(h: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """The distinct ones of each run of n hashes; zero for an empty run."""
    return [np.unique(x) if len(x) else np.zeros(1, np.int64) for x in np.split(h.view(np.int64), np.cumsum(n)[:-1])] if len(n) else []


def _lists(sets: list[np.ndarray]) -> pa.Array:
    at = np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))


def signed(texts: DataFrame) -> DataFrame:
    """(th, doc_id, n, fp, part) of every row of texts(th, doc_id, text); n is the number of its distinct shingles, fp the
    fingerprint of them all, part the distinct ones of the first class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, n = shingle_hashes(part.column("text"), SHINGLE)
                sets = _sets(h, n)
                sizes = np.array([len(x) for x in sets], np.int64)
                yield pa.record_batch({"th": part.column("th"), "doc_id": part.column("doc_id"), "n": pa.array(sizes), "fp": pa.array(majority(h, n).view(np.int64)), "part": _lists([x[x & (CLASSES - 1) == 0] for x in sets])})

    return texts.select("th", "doc_id", "text").mapInArrow(run, "th long, doc_id long, n long, fp long, part array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(th, shingles) of every row of texts(th, text); the shingles of a text are distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.record_batch({"th": part.column("th"), "shingles": _lists(_sets(*shingle_hashes(part.column("text"), SHINGLE)))})

    return texts.select("th", "text").mapInArrow(run, "th long, shingles array<long>")


def native_sets(texts: DataFrame) -> DataFrame:
    """``shingle_sets`` with DataFrame expressions only; its hashes are others."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    # bound once: the lambda would split the text for every shingle
    of = lambda w: F.when(F.size(w) > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - SHINGLE + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, SHINGLE))))).otherwise(F.array(F.lit(0).cast("long")))
    return texts.select("th", F.get(F.transform(F.array(words), of), F.lit(0)).alias("shingles"))


def native_parts(sets: DataFrame) -> DataFrame:
    """(th, n, part) of sets(th, shingles), as in ``signed``."""
    part = F.filter("shingles", lambda x: x.bitwiseAND(F.lit(CLASSES - 1)) == 0)
    return sets.select("th", F.size("shingles").cast("long").alias("n"), part.alias("part"))


def native_signed(sets: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(th, n, bands) of sets(th, shingles) with DataFrame expressions only; a permutation flips bits of the hashes."""
    least = lambda k: F.array_min(F.transform("shingles", lambda x: x.bitwiseXOR(F.lit(int(_FACTORS[k].view(np.int64))))))
    return sets.select("th", F.size("shingles").cast("long").alias("n"), F.array(*[F.xxhash64(*[least(b * rows + r) for r in range(rows)]) for b in range(bands)]).alias("bands"))


def candidates(texts: DataFrame) -> DataFrame:
    """(th, other): pairs to compare, of distinct texts(th, n, bands)."""
    keys = texts.select("th", "n", F.posexplode("bands").alias("band", "key")).select("th", "n", F.struct("band", "key").alias("key"))
    ends = keys.groupBy("key").agg(F.min(F.struct("n", "th")).alias("low"), F.count("*").alias("times")).filter("times > 1")
    ends = reliable(ends.select("key", F.col("low.th").alias("low"), F.col("times").alias("of"), "times"))
    shared = looked_up(keys, ends, "key", "times").filter("of > 1").withColumn("part", F.pmod(F.xxhash64("th"), F.ceil(F.col("of") / PART_ROWS)))
    order = Window.partitionBy("key", "part").orderBy("n", "th")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = shared.withColumns({"shortest": F.first("th").over(whole), "longest": F.last("th").over(whole)})
    to_key = F.when(F.col("th") == F.col("shortest"), F.col("low"))
    others = F.array("shortest", "longest", to_key, *[F.lead("th", k).over(order) for k in range(1, NEXT + 1)])
    pairs = shared.select("th", others.alias("others")).select("th", F.explode(F.array_distinct("others")).alias("other")).filter("th <> other")
    return pairs.select(F.least("th", "other").alias("th"), F.greatest("th", "other").alias("other")).distinct()


def links(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(u, v): the pairs(th, other) whose sets(th, shingles) are as similar."""
    both = pairs.join(sets.select(F.col("th").alias("other"), F.col("shingles").alias("b")), "other").join(sets.withColumnRenamed("shingles", "a"), "th")
    both = both.withColumn("common", F.size(F.array_intersect("a", "b")))
    # whole numbers, so that a similarity of just the limit counts
    enough = 1000 * F.col("common") >= round(1000 * similarity) * (F.size("a") + F.size("b") - F.col("common"))
    return both.filter(enough).select(F.col("th").alias("u"), F.col("other").alias("v"))


def _spare(n: Column) -> Column:
    """How many of its n shingles a text may have that a near copy lacks."""
    return n - F.ceil(round(1000 * SIMILARITY) * n / 1000)


def alone(shingles: DataFrame) -> DataFrame:
    """(th): texts that have no near copy, by the shingles(th, n, shingle) that no other text has; some of a text's shingles
    do as well as all, if every text gives those of the same classes.  Repeated rows do not matter."""
    one = shingles.groupBy("shingle").agg(F.min("th").alias("th"), F.max("th").alias("last"), F.min("n").alias("n")).filter("th = last")
    return one.groupBy("th").agg(F.count("*").alias("own"), F.first("n").alias("n")).filter(F.col("own") > _spare(F.col("n"))).select("th")


def _exploded(sets: DataFrame) -> DataFrame:
    return sets.select("th", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle"))


def firsts(sets: DataFrame) -> DataFrame:
    """(shingle, th, n, at): of distinct texts(th, shingles), rare shingles first, the places of those of which near copies share
    one; those that no other text has are left out."""
    shingles = _exploded(sets)
    often = reliable(shingles.groupBy("shingle").agg(F.count("*").alias("texts")).filter("texts > 1").withColumn("times", F.col("texts")))
    ordered = looked_up(shingles, often, "shingle", "times").groupBy("th", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("texts", F.lit(1)).alias("texts"), "shingle"))).alias("x"))
    head = F.slice("x", F.lit(1), (_spare(F.col("n")) + 1).cast("int"))
    return ordered.select("th", "n", F.posexplode(head).alias("at", "y")).filter("y.texts > 1").select("y.shingle", "th", "n", "at")


def unsettled(heads: DataFrame, labels: DataFrame) -> DataFrame:
    """(th, other): the pairs of texts that may be links by heads (``firsts``) and are not in one group of labels(th, label).

    The texts of a shingle that are not in its largest group are compared with all, in blocks, so that a large group of
    near copies costs nothing and no shingle's texts meet in one task."""
    named = reliable(heads.join(modest(labels), "th", "left").withColumn("label", F.coalesce("label", "th")))
    sizes = named.groupBy("shingle", "label").agg(F.count("*").alias("size")).groupBy("shingle").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.max("size").alias("most"), F.sum("size").alias("of"))
    parts = lambda n: F.ceil(n / PART_ROWS).cast("int")
    mixed = sizes.filter("most < of").select("shingle", "main", parts(F.col("of") - F.col("most")).alias("rows"), parts(F.col("of")).alias("columns"), F.col("of").alias("times"))
    dealt = reliable(looked_up(named, reliable(mixed), "shingle", "times").filter("main is not null"))
    own = lambda of: F.pmod(F.xxhash64("th"), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = dealt.filter("label <> main").select("shingle", "th", "n", "at", "label", own("rows").alias("row"), each("columns").alias("column"))
    right = dealt.select("shingle", F.col("th").alias("other"), F.col("n").alias("m"), F.col("at").alias("to"), F.col("label").alias("of"), (F.col("label") == F.col("main")).alias("is_main"), own("columns").alias("column"), each("rows").alias("row"))
    share = round(1000 * SIMILARITY)
    room = (1000 + share) * F.least(F.col("n") - F.col("at"), F.col("m") - F.col("to")) >= share * (F.col("n") + F.col("m"))
    on = ["shingle", "row", "column"]
    right = right.select(*[F.col(c).alias(f"{c}_") for c in on], "other", "m", "to", "of", "is_main")
    met = left.join(right, [F.col(c) == F.col(f"{c}_") for c in on] + [F.col("label") != F.col("of"), F.col("is_main") | (F.col("th") < F.col("other")), room])
    return met.select(F.least("th", "other").alias("th"), F.greatest("th", "other").alias("other")).distinct()


def groups(texts: DataFrame, sets: Callable[[DataFrame], DataFrame], more: DataFrame | None = None) -> DataFrame:
    """(th, label) of the texts(th, n, part) that have a near copy; part: the shingles of the first class, sets: gives
    (th, shingles) of a table of th, more: further pairs (th, other) to begin with.  Rows of texts may repeat."""
    far = reliable(alone(texts.select("th", "n", F.explode("part").alias("shingle"))))
    left = reliable(texts.select("th").distinct().join(modest(far), "th", "left_anti"))
    some = written(sets(left))
    some = reliable(some.join(modest(reliable(alone(_exploded(some)))), "th", "left_anti"))
    pairs = candidates(reliable(native_signed(some)))
    if more is not None:
        pairs = pairs.union(more.select(F.least("th", "other").alias("th"), F.greatest("th", "other").alias("other"))).distinct()
    found = reliable(links(reliable(pairs), some))
    named = lambda edges: reliable(components(edges).select(F.col("node").alias("th"), "label"))
    labels = named(found)
    further = reliable(links(reliable(unsettled(reliable(firsts(some)), labels)), some))
    return labels if further.isEmpty() else named(found.union(further))
