"""Substring deduplication with prefix-partitioned suffix trees over words.

A window is ``WIDTH`` consecutive words of one document.  A word goes if a window that covers it has a word
sequence that also starts in a document with a smaller doc_id.  A suffix therefore matters to a depth of
``WIDTH`` words only, and a window is a suffix cut at that depth.

1. Anchors.  The anchor of a window is the least of the hashes of its 25-word grams, so equal windows have equal
   anchors.  Anchors that occur in one document only are left out, and with them the suffixes that cannot repeat.
2. Suffixes.  A remaining suffix is a string of ``WIDTH / STEP`` symbols, the fingerprints of its next ``STEP`` words, of the
   ``STEP`` after them, and so on.  Each map task first resolves the suffixes that it sees twice, and hands on only those
   of the smallest doc_id, as one row with the ranges of their positions.
3. Prefixes.  Suffixes are dealt out by their first symbol, in as many ranges as make groups of half of ``GROUP_ROWS``.
   The groups are counted, and a group that is larger is dealt out by a prefix of one symbol more, until all
   fit or whole suffixes are told apart.
4. Trees.  Suffixes are sorted by their symbols, which lays out a group's tree depth first: the longest common prefix
   of neighbours is the depth of the internal node above them.  A task goes along the sorted suffixes and keeps one node.  Deep
   nodes, of the full ``WIDTH`` words, are repeats; the first suffix in a node has its smallest doc_id, and those of
   other documents are removed windows.  Neighbouring removed windows join to ranges, the places of maximal repeats.

Symbols have 32 bits, so that equal suffixes agree in 160.  Rows that share a doc_id are told apart by their texts' hash.

Defined results: null and empty texts have no words and the hash of the empty string; rows with equal doc_id never
remove each other's words; a null doc_id counts as the largest possible one; repeated rows are kept; an empty table
gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _tokens as T
from ._common import looked_up, reliable, repeated, slices, table, written

WIDTH = 50
GRAM = 25
STEP = 10
#: Entries that a map task resolves at once.
FLUSH = 1 << 20
#: Suffixes that a group may hold (about a megabyte), and that a task should.
GROUP_ROWS = 16_384
TASK_ROWS = 2_000_000
_LAST = (1 << 63) - 1


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    out = x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


class _Windows:
    """The windows of a slice of documents: their rows, their positions in the row, and their anchors."""

    def __init__(self, column: pa.Array):
        words = T.words_of(column)
        hashes = T.word_hashes(words)
        count = np.diff(words.first)
        n = np.maximum(count - WIDTH + 1, 0)
        self.row = np.repeat(np.arange(len(n)), n)
        self.pos = np.arange(len(self.row)) - np.repeat(np.cumsum(n) - n, n)
        self.at = self.pos + words.first[:-1][self.row]
        self.hashes = hashes
        grams = T.rolling(hashes, GRAM)
        self.anchor = _sliding_min(grams, WIDTH - GRAM + 1)[self.at] if len(self.at) else np.zeros(0, np.uint64)

    def symbols(self, chosen: np.ndarray) -> list[np.ndarray]:
        grams = (T.rolling(self.hashes, STEP) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        return [grams[self.at[chosen] + k] for k in range(0, WIDTH, STEP)]


def _ids(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return part.column("id").to_numpy(), part.column("th").to_numpy()


def _ends(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys[0]):
        return np.zeros(0, bool)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _least(new: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id of each run, for every row, and whether the run has several ids."""
    run = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    low, high = np.minimum.reduceat(ids, begin), np.maximum.reduceat(ids, begin)
    return low[run], (low != high)[run]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, id, th, known): known anchors repeat inside this task's rows; the others are to be compared."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        anchor, ids, th = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((ids, anchor))
        anchor, ids, th = anchor[order], ids[order], th[order]
        new = _ends(anchor)
        _, several = _least(new, ids)
        for take, known in ((several, True), (~several | new, False)):
            take = take & (_ends(anchor, ids, th) if known else True)
            for at in range(0, len(where := np.flatnonzero(take)), 1 << 16):
                m = where[at : at + (1 << 16)]
                yield pa.record_batch({"anchor": pa.array(anchor[m].view(np.int64)), "id": pa.array(ids[m]), "th": pa.array(th[m]), "known": pa.array(np.full(len(m), known))})

    for batch in batches:
        for part in slices(batch, "text"):
            w = _Windows(part.column("text"))
            ids, th = _ids(part)
            new = _ends(w.row, w.anchor)
            held.append((w.anchor[new], ids[w.row[new]], th[w.row[new]]))
            size += int(new.sum())
            if size > FLUSH:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


_PATH = [f"s{k}" for k in range(WIDTH // STEP)]
_SUFFIX = f"id long, th long, ranges array<int>, {', '.join(f'{p} int' for p in _PATH)}"


def _runs(new: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Where groups begin, given the rows that begin one, and each group's runs of positions: start, stop, start, ..."""
    head = new.copy()
    head[1:] |= pos[1:] != pos[:-1] + 1
    begin = np.flatnonzero(head)
    last = np.r_[begin[1:], len(pos)] - 1
    flat = np.stack([pos[begin], pos[last] + 1], axis=1).astype(np.int32).ravel()
    first = np.flatnonzero(new)
    offsets = np.r_[2 * np.searchsorted(begin, first), len(flat)].astype(np.int32)
    return first, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _rows(ids: np.ndarray, th: np.ndarray, pos: np.ndarray, path: list[np.ndarray] | None, new: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of _SUFFIX, one for each group."""
    if not len(ids):
        return
    first, ranges = _runs(new, pos)
    for at in range(0, len(first), 1 << 16):
        m = first[at : at + (1 << 16)]
        symbols = [pa.array(p[m]) for p in path] if path else [pa.nulls(len(m), pa.int32())] * len(_PATH)
        yield pa.RecordBatch.from_arrays([pa.array(ids[m]), pa.array(th[m]), ranges.slice(at, len(m)), *symbols], names=["id", "th", "ranges", *_PATH])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes whose anchor repeats.  Rows without symbols are ranges that this task knows to be removed."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        ids, th, pos, *path = (np.concatenate(x) for x in zip(*held, strict=True))
        # one value brings equal suffixes together; their symbols tell whether they are
        with np.errstate(over="ignore"):
            mark = np.zeros(len(ids), np.uint64)
            for p in path:
                mark = T.mix(mark * np.uint64(0x9E3779B97F4A7C15) + p.view(np.uint32))
        order = np.lexsort((pos, th, ids, mark))
        ids, th, pos, path = ids[order], th[order], pos[order], [p[order] for p in path]
        node = _ends(*path)
        low, _ = _least(node, ids)
        gone = np.flatnonzero(ids > low)
        gone = gone[np.lexsort((pos[gone], th[gone], ids[gone]))]
        yield from _rows(ids[gone], th[gone], pos[gone], None, _ends(ids[gone], th[gone]))
        kept = ids == low
        begins = _ends(np.cumsum(node)[kept], th[kept])
        yield from _rows(ids[kept], th[kept], pos[kept], [p[kept] for p in path], begins)

    for batch in batches:
        for part in slices(batch, "text"):
            w = _Windows(part.column("text"))
            ids, th = _ids(part)
            wanted = part.column("anchors")
            row = np.repeat(np.arange(len(ids)), np.diff(wanted.offsets.to_numpy()))
            values = wanted.flatten().to_numpy().view(np.uint64)
            # membership by row: both sides are reduced to one 64-bit value
            with np.errstate(over="ignore"):
                tag = lambda a, r: a ^ T.mix(r.astype(np.uint64) + np.uint64(1))
                chosen = np.flatnonzero(np.isin(tag(w.anchor, w.row), tag(values, row)))
            if len(chosen):
                held.append((ids[w.row[chosen]], th[w.row[chosen]], w.pos[chosen], *w.symbols(chosen)))
                size += len(chosen)
            if size > FLUSH:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def common_prefixes(path: list[np.ndarray]) -> np.ndarray:
    """How many symbols each suffix shares with the one before it, from its start on; none for the first one."""
    shared = np.zeros(len(path[0]), np.int64)
    same = np.ones(max(len(path[0]) - 1, 0), bool)
    for p in path:
        same &= p[1:] == p[:-1]
        shared[1:] += same
    return shared


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, th, ranges) that the trees show to be removed, from sorted suffixes.  Only the last node outlives a batch."""
    last: list[np.ndarray] | None = None
    low = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("id").to_numpy()
        path = [batch.column(p).to_numpy() for p in _PATH]
        with_last = [np.r_[x, p] for x, p in zip(last, path, strict=True)] if last else [np.r_[p[:1] + 1, p] for p in path]
        begins = common_prefixes(with_last)[1:] < len(_PATH)
        begin = np.flatnonzero(begins)
        # the first suffix of a node is that of its smallest id; rows before the first node here belong to the last one
        least = np.r_[low, ids[begin]][np.cumsum(begins)]
        yield batch.select(["id", "th", "ranges"]).filter(pa.array(ids > least))
        last, low = [p[-1:] for p in path], int(least[-1])


def _grouped(suffixes: DataFrame, total: int) -> DataFrame:
    """suffixes with ``prefix``, the group that each belongs to; groups are as small as prefixes allow."""
    bits = max(4, (2 * total // GROUP_ROWS).bit_length())
    range_ = lambda n: F.shiftrightunsigned(F.xxhash64(*_PATH[:n]), 64 - bits)
    grouped = suffixes.withColumn("prefix", range_(1))
    for n in range(2, len(_PATH) + 1):
        crowded = reliable(grouped.groupBy("prefix").count().filter(F.col("count") > GROUP_ROWS).withColumn("crowded", F.lit(True)))
        if crowded.isEmpty():
            break
        grouped = looked_up(grouped, crowded, "prefix", "count").withColumn("prefix", F.when(F.col("crowded"), F.xxhash64("prefix", range_(n))).otherwise(F.col("prefix"))).drop("crowded")
    return grouped


def removed_ranges(docs: DataFrame) -> DataFrame:
    """(id, th, ranges): windows to remove, as ranges of start positions (start, stop, start, ...), of docs(id, th, text)."""
    anchors = docs.mapInArrow(_anchors, "anchor long, id long, th long, known boolean")
    # known ones need no comparison, so they are dealt out by document
    over = Window.partitionBy("known", F.when(F.col("known"), F.xxhash64("id", "th")).otherwise(F.col("anchor")))
    repeated = anchors.withColumn("lo", F.min("id").over(over)).withColumn("hi", F.max("id").over(over)).filter("known or lo < hi")
    wanted = repeated.groupBy("id", "th").agg(F.collect_set("anchor").alias("anchors"))
    found = written(docs.join(wanted, ["id", "th"]).mapInArrow(_suffixes, _SUFFIX))
    suffixes = found.filter(f"{_PATH[0]} is not null")
    total = suffixes.count()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_ROWS)
    dealt = _grouped(suffixes, total).repartition(parts, "prefix").drop("prefix").sortWithinPartitions(*_PATH, "id")
    return found.filter(f"{_PATH[0]} is null").select("id", "th", "ranges").union(dealt.mapInArrow(_trees, "id long, th long, ranges array<int>"))


def _cleaned(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = T.words_of(part.column("text"))
            edge = np.zeros(len(words.start) + 1, np.int64)
            gone = part.column("ranges")
            flat = gone.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(part.num_rows), np.diff(gone.offsets.to_numpy()) // 2)
            if len(row):
                np.add.at(edge, words.first[row] + flat[::2], 1)
                np.add.at(edge, words.first[row] + flat[1::2] - 1 + WIDTH, -1)
            copy = part.column("copy").to_numpy(zero_copy_only=False) & (np.diff(words.first) >= WIDTH)
            kept = (np.cumsum(edge[:-1]) == 0) & ~copy[words.row_of()]
            first = np.r_[0, np.cumsum(kept)][words.first]
            left = T.joined(T.Words(words.buf, words.start[kept], words.end[kept], first))
            n = np.diff(words.first)
            texts = [left.buf[left.start[a] : left.end[b - 1]].tobytes() if b > a else b"" for a, b in zip(first[:-1], first[1:], strict=True)]
            out = {"doc_id": part.column("doc_id"), "times": part.column("times"), "n_words": pa.array(n.astype(np.int64)), "n_removed": pa.array((n - np.diff(first)).astype(np.int64)), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())}
            yield pa.record_batch(out | ({"kept_text": pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())} if with_text else {}))


def _copies(docs: DataFrame) -> DataFrame:
    """docs with ``copy``: whether the whole text is that of a smaller id.  Texts without room for a window are none."""
    prints = docs.withColumn("key", F.when(F.octet_length("text") >= 2 * WIDTH - 1, F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))))
    least = prints.filter("key is not null").groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("times")).filter("least < most").drop("most")
    return looked_up(prints, reliable(least), "key", "times").withColumn("copy", F.coalesce(F.col("id") > F.col("least"), F.lit(False))).drop("key", "least")


def _once(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """docs(doc_id, id, th, text, copy) without the rows that repeat, and one row of each of these with ``times``; None if none do."""
    key = F.struct("id", "th").alias("key")
    again = docs.groupBy(key).agg(F.count("*").alias("times")).filter("times > 1").withColumn("again", F.lit(True))
    again = reliable(again)
    if again.isEmpty():
        return docs, None
    marked = looked_up(docs.withColumn("key", key), again, "key", "times")
    # tasks bring equal rows down to one before any are sent
    several = marked.filter("again").groupBy("doc_id", "id", "th").agg(F.first("text").alias("text"), F.first("copy").alias("copy"), F.count("*").alias("times"))
    return marked.filter("again is null").select(*docs.columns), written(several)


def without_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_words, n_removed, kept_sha256 and, if wanted, kept_text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(_LAST)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    # a whole copy has nothing to compare: each of its windows starts in the document that it copies
    single, several = _once(_copies(keyed))
    own = lambda df: df.filter("not copy").select("id", "th", "text")
    compared = own(single) if several is None else own(single).union(own(several))
    ranges = removed_ranges(compared).groupBy("id", "th").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]
    schema = "doc_id long, times long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")

    def cleaned(rows: DataFrame) -> DataFrame:
        joined = rows.join(ranges, ["id", "th"], "left").select("doc_id", "times", "text", "copy", F.coalesce("ranges", F.array().cast("array<int>")).alias("ranges"))
        return joined.mapInArrow(lambda b: _cleaned(b, with_text), schema)

    if several is None:
        return cleaned(single.withColumn("times", F.lit(1).cast("long"))).select(*names)
    ranges = written(ranges)
    copies = repeated(written(cleaned(several)), "times")
    return cleaned(single.withColumn("times", F.lit(1).cast("long"))).select(*names).union(copies.select(*names))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), with_text=False)


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT r, id, i, min(id) OVER (PARTITION BY array_to_string(words[i:i + 49], ' ')) AS least
  FROM (SELECT r, id, words, unnest(range(1, len(words) - 48)) AS i FROM d WHERE len(words) >= 50)
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 50)) AS j FROM w WHERE id > least
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n
  FROM (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM d) LEFT JOIN (SELECT r, j, true AS gone FROM gone) USING (r, j)
  WHERE gone IS NULL GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
