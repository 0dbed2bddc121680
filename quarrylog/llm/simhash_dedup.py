"""SimHash near-duplicate detection with a Gray-order hierarchical index.

1. A 64-bit SimHash per document from the XXH64 values of its three-word shingles.
2. The distinct fingerprints are dealt out by three bit blocks.  Two fingerprints that differ in at most two
   bits agree on one block at least, so every link lies inside some group (pigeonhole).  A group above
   ``hot_group`` rows is dealt out again by thirds of its other bits, up to ``LEVELS`` times; what is left of a group then
   shares 45 bits, and so has at most 2 ** 19 fingerprints.
3. Each group is sorted by Gray rank.  Upper nodes hold the bits that all fingerprints below them share, as
   a mask and a pattern.  Node pairs are compared from the root; a pair is dropped with everything below it
   as soon as the differences on the bits that both nodes share exceed the limit.
4. A group hands on one edge per linked fingerprint (towards the group's root of that component), never all
   pairs.  Components of these edges come from alternating large-star and small-star steps.

Defined results: null, empty and blank texts have fingerprint zero and link like any other fingerprint; repeated
rows keep their rows; a null doc_id is kept and counts as the largest id; an empty table gives no rows; columns
other than doc_id and text are ignored, so clashing names cannot matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common
from . import _tokens as T
from ._common import looked_up, octets, reliable, slices, table, written

SHINGLE = 3
MAX_BITS = 2
#: Bit blocks (offset, width) that fingerprints are dealt out by; one more than MAX_BITS.
BLOCKS = ((0, 22), (22, 21), (43, 21))
LEVELS = 4
#: Rows that a task should compare.
TASK_ROWS = 500_000
#: Pairs of nodes that are looked at in one numpy step.
STEP = 1 << 19

_LANES = ((np.arange(256, dtype=np.uint64)[:, None] >> np.arange(8, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).view("<u8").ravel()


def fingerprints(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of every text of a column, as uint64."""
    return majority(*shingle_hashes(column, shingle))


def shingle_hashes(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number of each text's hashes), in the order of the texts; a text of fewer words is one shingle."""
    words = T.joined(T.words_of(column), lower=True)
    count = np.diff(words.first)
    n = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.uint64), n
    row = np.repeat(np.arange(len(n)), n)
    head = np.arange(total) - (np.cumsum(n) - n)[row] + words.first[:-1][row]
    tail = head + np.minimum(count, shingle)[row] - 1
    return T.xxh64(words.buf, words.start[head], words.end[tail]), n


def majority(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each run of n hashes the bits that are set in over half of them."""
    out = np.zeros(len(n), np.uint64)
    if not len(h):
        return out
    begin = np.cumsum(n) - n
    # eight counters of eight bits per byte of the hash; at most 255 shingles are added up in them
    parts = -(-n // 255)
    part_row = np.repeat(np.arange(len(n)), parts)
    part_at = begin[part_row] + 255 * (np.arange(len(part_row)) - (np.cumsum(parts) - parts)[part_row])
    bytes_ = h.view(np.uint8).reshape(-1, 8)
    lanes = np.stack([np.add.reduceat(_LANES[bytes_[:, k]], part_at) for k in range(8)], axis=1)
    counts = np.ascontiguousarray(lanes).view(np.uint8).reshape(len(part_at), 64).astype(np.int64)
    some = np.flatnonzero(n)
    sums = np.add.reduceat(counts, (np.cumsum(parts) - parts)[some], axis=0)
    bits = 2 * sums > n[some, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp = fingerprints(part.column("text")).view(np.int64)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "fp": pa.array(fp)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The position of x in the reflected Gray sequence."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def linked(fp: np.ndarray, group: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """For every fingerprint the index of the smallest-index member of its component inside its group.

    Rows of a group are consecutive and in Gray order."""
    n = len(fp)
    root = np.arange(n)
    if n < 2:
        return root
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    levels = [(fp, fp, np.r_[first, n])]  # what all below share as ones, what any below has, groups' offsets
    while np.diff(levels[-1][2]).max() > 1:
        ones, some, at = levels[-1]
        size = np.diff(at)
        up = np.r_[0, np.cumsum((size + 1) // 2)]
        g = np.repeat(np.arange(len(size)), np.diff(up))
        left = at[g] + 2 * (np.arange(up[-1]) - up[g])
        right = np.minimum(left + 1, at[g + 1] - 1)
        levels.append((ones[left] & ones[right], some[left] | some[right], up))
    height = np.zeros(len(first), np.int64)
    for k in range(1, len(levels)):
        height[np.diff(levels[k - 1][2]) > 1] = k
    work = []
    for k in range(1, len(levels)):
        roots = levels[k][2][:-1][height == k]
        if len(roots):
            work.append((k, roots, roots))
    while work:
        k, a, b = work.pop()
        if len(a) > STEP:
            half = len(a) // 2
            work += [(k, a[:half], b[:half]), (k, a[half:], b[half:])]
            continue
        ones, some, at = levels[k]
        fixed = ~(ones[a] ^ some[a]) & ~(ones[b] ^ some[b])
        near = (np.bitwise_count((ones[a] ^ ones[b]) & fixed) <= max_bits) & ((a < b) | (k > 0))
        a, b = a[near], b[near]
        if not len(a):
            continue
        if k == 0:
            _union(root, a, b)
            continue
        below = levels[k - 1][2]
        g = np.searchsorted(at, a, "right") - 1
        left_a, left_b = below[g] + 2 * (a - at[g]), below[g] + 2 * (b - at[g])
        last = below[g + 1] - 1
        has_a, has_b = left_a < last, left_b < last
        apart = a < b
        pairs = [(left_a, left_b, np.ones(len(a), bool) if k > 1 else apart), (left_a, left_b + 1, has_b), (left_a + 1, left_b, has_a & apart), (left_a + 1, left_b + 1, has_a & has_b & (apart | (k > 1)))]
        work.append((k - 1, np.concatenate([x[m] for x, _, m in pairs]), np.concatenate([y[m] for _, y, m in pairs])))
    return _settled(root)


def _settled(root: np.ndarray) -> np.ndarray:
    while (root[root] != root).any():
        root[:] = root[root]
    return root


def _union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a[i] and b[i], for all i."""
    while len(a):
        _settled(root)
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))


def _thirds(used: int) -> list[int]:
    """Masks that add a third each of the bits outside a mask to it."""
    rest = [i for i in range(64) if not used >> i & 1]
    cut = [len(rest) * t // 3 for t in range(4)]
    return [used | sum(1 << i for i in rest[x:y]) for x, y in zip(cut, cut[1:], strict=False)]


def _group_keys(reps: DataFrame, hot_group: int) -> DataFrame:
    """(fp, key): the groups of every fingerprint."""
    masks = [((1 << width) - 1) << at for at, width in BLOCKS]
    signed = lambda mask: F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")
    path = F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1)))
    keyed = reps.select("fp", path.alias("path"))
    for level in range(LEVELS):
        shared = F.col("fp").bitwiseAND(F.get(F.array(*[signed(m) for m in masks]), F.col("path")))
        fresh = F.xxhash64(F.lit(level), "path", shared)
        keyed = reliable(keyed.withColumn("key", F.when(F.col("key").isNull(), fresh).otherwise(F.col("key")) if level else fresh))
        if level == LEVELS - 1:
            break
        hot = reliable(keyed.groupBy("key").count().filter(F.col("count") > hot_group).withColumn("hot", F.lit(True)))
        if hot.isEmpty():
            break
        # a hot group goes on in three; the others stay as they are
        marked = looked_up(keyed, hot, "key", "count")
        children = F.when(F.col("hot"), F.sequence(3 * F.col("path"), 3 * F.col("path") + 2)).otherwise(F.array(F.lit(-1)))
        keyed = marked.select("fp", F.when(F.col("hot").isNull(), F.col("key")).alias("key"), F.explode(children).alias("path"))
        masks = [m for mask in masks for m in _thirds(mask)]
    return keyed.select("fp", "key")


def edges(reps: DataFrame, max_bits: int = MAX_BITS, hot_group: int = 20_000) -> DataFrame:
    """(u, v): edges between distinct fingerprints whose components are those of all links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("fp").to_numpy(), b.column("key").to_numpy()) for b in batches]
        if not got:
            return
        fp = np.concatenate([x for x, _ in got]).view(np.uint64)
        key = np.concatenate([y for _, y in got])
        del got
        order = np.lexsort((gray_rank(fp), key))
        fp, key = fp[order], key[order]
        same = key[1:] == key[:-1]
        keep = np.r_[False, same] | np.r_[same, False]
        fp, key = fp[keep], key[keep]
        root = linked(fp, key, max_bits)
        moved = np.flatnonzero(root != np.arange(len(root)))
        for at in range(0, len(moved), 1 << 16):
            m = moved[at : at + (1 << 16)]
            yield pa.record_batch({"u": pa.array(fp[m].view(np.int64)), "v": pa.array(fp[root[m]].view(np.int64))})

    keyed = _group_keys(reps, hot_group)
    parts = max(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), keyed.count() // TASK_ROWS)
    return keyed.repartition(parts, "key").mapInArrow(run, "u long, v long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of an edge list (u, v); the label is the component's smallest node.

    Alternates large-star and small-star steps; each is one aggregation and one lookup by node, with no
    group gathered anywhere, and each step is checkpointed."""
    links = reliable(links.select("u", "v").filter("u <> v"))
    count = links.count()
    if not count:
        return links.select(F.col("u").alias("node"), F.col("v").alias("label"))

    def with_least(edges: DataFrame) -> DataFrame:
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("times"))
        # a node may have most of all edges: where they are many, they do not meet in one task
        return looked_up(edges, reliable(least), "u", "times") if count > TASK_ROWS else edges.join(least.drop("times"), "u")

    before = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: a node's larger neighbours go to its smallest one
        links = with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        links = reliable(links) if count > TASK_ROWS else links
        smaller = with_least(links)
        links = reliable(smaller.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return links.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label").union(links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, hot_group: int = 20_000) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs(doc_id, text)."""
    prints = reliable(document_fingerprints(docs))
    reps = reliable(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("times")))
    labels = components(edges(reps, max_bits, hot_group)).select(F.col("node").alias("fp"), "label")
    named = reliable(reps.join(labels, "fp", "left").select("fp", "least", F.col("times").alias("rows"), F.coalesce("label", "fp").alias("label")))
    ids = reliable(named.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("times")))
    of_fp = reliable(looked_up(named, ids, "label", "times").select("fp", "component_id", F.col("rows").alias("times")))
    return looked_up(prints, of_fp, "fp", "times").select("doc_id", "fp", "component_id")


def _close(signed: DataFrame) -> DataFrame:
    """(th, other): texts(th, fp) with one fingerprint, or with fingerprints that the index links."""
    reps = reliable(signed.groupBy("fp").agg(F.min("th").alias("rep"), F.count("*").alias("times")))
    same = looked_up(signed.select("th", "fp"), reps, "fp", "times").filter("th <> rep").select("th", F.col("rep").alias("other"))
    name = lambda fp, to: reps.select(F.col("fp").alias(fp), F.col("rep").alias(to))
    linked_ = edges(reps.select("fp")).join(name("u", "th"), "u").join(name("v", "other"), "v").select("th", "other")
    return same.union(linked_).filter("th <> other")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents of which each group of near copies keeps one row: the first by doc_id (nulls last), then by the text's
    hash; of rows with the same doc_id and text, one.

    Near copies have a Jaccard similarity of five-word shingles of 0.8 or more (``near_copies``), which is checked
    exactly.  Texts to compare are first those that the Gray-order index links by their five-word fingerprints.  At that similarity
    most fingerprints differ in more bits than blocks can index, so ``near_copies`` adds all others that can be links.

    Rows are known by doc_id and text together, so that rows without a doc_id, and different texts of one doc_id, are
    documents like any others."""
    from . import near_copies  # which has its components from here

    doc_id = F.col("doc_id").cast("long")
    row = lambda i, th: F.xxhash64(th, i.isNull(), F.coalesce(i, F.lit(0)))
    texts = docs.select(near_copies.text_hash(F.col("text")).alias("th"), doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"))
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    rows = written(near_copies.signed(texts))
    signed = reliable(rows.groupBy("th").agg(first_row, F.first("fp").alias("fp")))

    def sets(nodes: DataFrame) -> DataFrame:
        if octets(nodes) <= _common.BROADCAST_BYTES:
            return near_copies.shingle_sets(texts.join(F.broadcast(nodes), "th", "left_semi").dropDuplicates(["th"]))
        # copies go before texts are shuffled
        return near_copies.shingle_sets(texts.dropDuplicates(["th"]).join(nodes, "th", "left_semi"))

    labels = near_copies.groups(rows, sets, _close(signed))
    named = signed.select("th", "first").join(labels, "th", "left")
    best = named.groupBy(F.coalesce("label", "th")).agg(F.min(F.struct("first", "th")).alias("x"))
    keep = reliable(best.select(row(F.col("x.first.doc_id"), F.col("x.th")).alias("__keep")))
    given = docs.withColumn("__row", row(doc_id, near_copies.text_hash(F.col("text"))))
    again = rows.groupBy("doc_id", "th").agg(F.count("*").alias("__times")).filter("__times > 1")
    again = reliable(again.select(row(F.col("doc_id"), F.col("th")).alias("__row"), F.lit(True).alias("__again"), "__times"))
    if not again.isEmpty():
        # of equal rows one: tasks choose before anything is brought together
        marked = looked_up(given, again, "__row", "__times")
        columns = [F.col(f"`{c}`") for c in given.columns]
        chosen = marked.filter("__again").groupBy("__row").agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("__r")).select("__r.*")
        given = marked.filter("__again is null").select(*columns).union(chosen)
    return given.join(keep, F.col("__row") == F.col("__keep"), "left_semi").drop("__row")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
