"""Periodic runs: stretches of words that repeat with a period, found on a harmonic grid.

A run is a stretch with smallest period p that is at least ``exponent`` periods and ``least`` words long and that no
neighbouring word extends keeping the period.  Its words that equal the word p further on are an unbroken interval of
max(least, exponent * p) - p words or more, so a grid of that step meets every run of period p.  Over all periods of a
text of n words that are about n log n / (exponent - 1) pairs of a period and a grid point.  All pairs of many texts are
measured at once: how far the words before and after a grid point agree with those a period on is found by binary search
over prefix hashes.  What is found is verified word by word, and a text's runs are told from one another by their ends.

Tasks work on slices of texts and blocks of pairs; nothing is shuffled and nothing is gathered.

Defined results: a null text has no words; a text without runs keeps its words, joined by one space; a row without a
doc_id, repeated rows and rows with the same doc_id are rows like any others; an empty table gives no rows; further columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import slices, table
from ._tokens import Words, joined, word_hashes, words_of
from .quality_rules import words as split_words

#: A run has so many periods, and so many words, at least.
EXPONENT, LEAST_WORDS = 4, 6
#: Pairs of a period and a grid point, or words to verify, that one numpy step works on.
BLOCK = 1 << 19
#: Prefix hashes are taken modulo this prime, with one of these bases.
PRIME = np.uint64(2**31 - 1)
BASES = (1_103_515_245, 1_664_525_013, 987_654_323, 69_069_069, 134_775_813)

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def distinct_words(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first, ids): equal numbers for equal words, and only for those, and where each of them is first.  Every word is compared
    with the first one of its hash."""
    _, first, ids = np.unique(word_hashes(words), return_index=True, return_inverse=True)
    length, like = words.end - words.start, first[ids]
    same = (length == length[like]).all()
    if same and len(ids):
        at = np.repeat(words.start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        same = (words.buf[at] == words.buf[at + np.repeat(words.start[like] - words.start, length)]).all()
    if not same:
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(words.buf[a:b].tobytes(), len(known)) for a, b in zip(words.start, words.end, strict=True)])
        _, first = np.unique(ids, return_index=True)
    return first, ids


class _Prefixes:
    """Prefix hashes of all words of a slice: sums of id * base ** place."""

    def __init__(self, ids: np.ndarray, base: int) -> None:
        n = len(ids)
        self.power = np.ones(n + 1, np.uint64)
        have, step = 1, base % int(PRIME)
        while have <= n:
            more = min(have, n + 1 - have)
            self.power[have : have + more] = self.power[:more] * np.uint64(step) % PRIME
            have, step = have + more, step * step % int(PRIME)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((ids.astype(np.uint64) + np.uint64(1)) % PRIME * self.power[:n] % PRIME, out=self.sums[1:])
        self.sums %= PRIME

    def agree(self, at: np.ndarray, period: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` words from ``at`` on have the hash of those a period on.  Equal words always do."""
        part = lambda a: self.sums[a + length] + PRIME - self.sums[a]
        return part(at) % PRIME * self.power[period] % PRIME == part(at + period) % PRIME

    def reach(self, at: np.ndarray, period: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
        """How many words from ``at`` on (or before it) agree with those a period on, up to ``limit``; never too few."""
        low, high = np.zeros(len(at), np.int64), limit + 1
        live = np.flatnonzero(high - low > 1)
        while len(live):
            middle = (low[live] + high[live]) // 2
            good = self.agree(at[live] - middle if back else at[live], period[live], middle)
            low[live[good]] = middle[good]
            high[live[~good]] = middle[~good]
            live = live[high[live] - low[live] > 1]
        return low


def _blocks(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which, nth) of all ``counts[which]`` items of each, ``BLOCK`` at a time."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    for low in range(0, total, BLOCK):
        high = min(low + BLOCK, total)
        a, b = np.searchsorted(ends, [low, high - 1], side="right")
        which = np.arange(a, b + 1)
        begin = np.maximum(ends[a : b + 1] - counts[a : b + 1], low)
        size = np.minimum(ends[a : b + 1], high) - begin
        which = np.repeat(which, size)
        yield which, np.arange(low, high) - (ends - counts)[which]


def _grid(sizes: np.ndarray, exponent: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place in it, period) of every grid point with a word a period on."""
    top = np.where(sizes >= least, sizes // exponent, 0)
    text = np.repeat(np.arange(len(sizes)), top)
    period = np.arange(len(text)) - np.repeat(np.cumsum(top) - top, top) + 1
    step = np.maximum(least, exponent * period) - period
    for which, nth in _blocks((sizes[text] - period - 1) // step + 1):
        yield text[which], nth * step[which], period[which]


def _found(ids: np.ndarray, first: np.ndarray, exponent: int, least: int, base: int) -> np.ndarray | None:
    """Rows (start, end, period) of all runs, in numbers of the slice's words; None if a hash has misled."""
    sizes = np.diff(first)
    prefixes = _Prefixes(ids, base)
    parts = [np.zeros((0, 3), np.int64)]
    for text, at, period in _grid(sizes, exponent, least):
        begin, end = first[text], first[text + 1]
        at = at + begin
        live = np.flatnonzero(ids[at] == ids[at + period])
        at, period, begin, end = at[live], period[live], begin[live], end[live]
        step = np.maximum(least, exponent * period) - period
        # one of the two halves must agree
        ahead, behind = (step + 1) // 2, step - (step + 1) // 2 + 1
        fits, fits_back = at + period + ahead <= end, at - behind >= begin
        good = fits & prefixes.agree(at, period, np.where(fits, ahead, 0))
        good |= fits_back & prefixes.agree(np.where(fits_back, at - behind, at), period, np.where(fits_back, behind, 0))
        at, period, begin, end, step = at[good], period[good], begin[good], end[good], step[good]
        after = prefixes.reach(at, period, end - at - period, back=False)
        before = prefixes.reach(at, period, at - begin, back=True)
        long = after + before >= step
        rows = np.stack([at - before, at + period + after, period], axis=1)[long]
        parts.append(np.unique(rows, axis=0) if len(rows) else rows)
    rows = np.unique(np.concatenate(parts), axis=0)
    # of one stretch the smallest period; the others that it has are its multiples
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    smallest = rows[new][np.cumsum(new) - 1, 2] if len(rows) else rows[:, 2]
    if (rows[:, 2] % np.maximum(smallest, 1)).any():
        return None
    rows = rows[new]
    for which, nth in _blocks(rows[:, 1] - rows[:, 0] - rows[:, 2]):
        at = rows[which, 0] + nth
        if (ids[at] != ids[at + rows[which, 2]]).any():
            return None
    return rows


def runs_of(ids: np.ndarray, first: np.ndarray, exponent: int = EXPONENT, least: int = LEAST_WORDS) -> np.ndarray:
    """Rows (start, end, period) by start, then period, of all runs in texts whose word numbers are ``ids[first[r]:first[r+1]]``.

    Where a hash has misled, which verifying shows, the slice is done anew with another base, at last word by word."""
    for base in BASES:
        if (rows := _found(ids, first, exponent, least, base)) is not None:
            break
    else:
        rows = _plain(ids, first, exponent, least)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _plain(ids: np.ndarray, first: np.ndarray, exponent: int, least: int) -> np.ndarray:
    rows: dict[tuple[int, int], int] = {}
    for a, b in zip(first[:-1], first[1:], strict=True):
        for period in range(1, int(b - a) // exponent + 1):
            same = np.r_[False, ids[a : b - period] == ids[a + period : b], False]
            edges = np.flatnonzero(same[1:] != same[:-1])
            for begin, end in edges.reshape(-1, 2):
                if end - begin + period >= max(least, exponent * period):
                    rows.setdefault((int(a + begin), int(a + end + period)), period)
    return np.array([(*k, p) for k, p in rows.items()], np.int64).reshape(-1, 3)


def _texts(words: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by one space."""
    counts = np.concatenate([[0], np.cumsum(kept)])[words.first]
    out = joined(Words(words.buf, words.start[kept], words.end[kept], counts))
    at = [(out.start[a], out.end[b - 1]) if b > a else (0, 0) for a, b in zip(counts[:-1], counts[1:], strict=True)]
    return pa.array([out.buf[a:b].tobytes() for a, b in at], pa.binary()).cast(pa.string())


def _measured(part: pa.RecordBatch, exponent: int, least: int) -> pa.RecordBatch:
    words = words_of(part.column("text"))
    rows = runs_of(distinct_words(words)[1], words.first, exponent, least)
    text = np.searchsorted(words.first, rows[:, 0], side="right") - 1
    # a run keeps its first period
    change = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(change, rows[:, 0] + rows[:, 2], 1)
    np.add.at(change, rows[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    offsets = pa.array(np.searchsorted(text, np.arange(words.rows + 1)).astype(np.int32))
    fields = pa.StructArray.from_arrays([pa.array(x) for x in (rows[:, 0] - words.first[text], rows[:, 1] - rows[:, 0], rows[:, 2])], fields=list(_RUNS.value_type))
    n_words = pa.array(np.diff(words.first).astype(np.int64))
    return pa.record_batch({"doc_id": part.column("doc_id"), "n_words": n_words, "runs": pa.ListArray.from_arrays(offsets, fields).cast(_RUNS), "collapsed": _texts(words, kept)})


def periodic_runs(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of docs(doc_id, text): runs are (start, length, period) by start, then
    period, in words from 0 on, and collapsed has the words that no run holds behind its first period, joined by one space."""
    if exponent < 2 or least < exponent:
        raise ValueError("a run has two periods at least, and as many words as periods")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield _measured(part, exponent, least)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return given.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def repeated(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) in which one text in ten, by h = crc32(doc_id), repeats its words from a place on: word i is word
    a + (i - a) % p from a = g % n on, where g = h div 10 and p = 1 + (n - a) div (3 + g % 8)."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    given = given.withColumns({"_g": F.floor(h / 10).cast("long"), "_w": F.when(h % 10 == 0, split_words(F.col("text")))})
    given = given.withColumn("_n", F.size("_w")).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    given = given.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    after = F.transform(F.sequence(F.col("_a"), F.col("_n") - 1), lambda i: F.get(F.col("_w"), F.col("_a") + (i - F.col("_a")) % F.col("_p")))
    text = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), after), " ")
    return given.select("doc_id", F.when(F.col("_a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def _greatest(runs: Column) -> Column:
    """The run with the greatest length / period, compared in whole numbers; of equal ones the first by start and period."""
    better = lambda a, b: (b["length"] * a["period"]) > (a["length"] * b["period"])
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(repeated(table(spark, sf_dir, "documents"))).withColumn("best", _greatest(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Equal words of a text at each distance, and unbroken sequences of them; the checksum bit by bit.
ORACLE_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, CAST(doc_id AS VARCHAR) AS s, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), h AS (
  SELECT *, len(w) AS n, xor(list_reduce([4294967295::BIGINT] || list_transform(range(8 * length(s)), lambda i: (ascii(substr(s, CAST(i // 8 + 1 AS BIGINT), 1)) >> CAST(i % 8 AS INTEGER)) & 1),
    lambda c, b: CASE WHEN xor(c & 1, b) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) AS h FROM t
), g AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h
), p AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM g
), d AS (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CAST(CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1 AS BIGINT)]) END AS w FROM p
), u AS (
  SELECT r, n, unnest(range(n)) AS i, unnest(w) AS word FROM d
), same AS (
  SELECT x.r, y.i - x.i AS q, x.i AS i FROM u x JOIN u y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), island AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM same) GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)
), run AS (
  SELECT r, start, length, min(q) AS period FROM island GROUP BY r, start, length
), gone AS (
  SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM u ANTI JOIN gone USING (r, i) GROUP BY r
), listed AS (
  SELECT r, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS text FROM run GROUP BY r
), best AS (
  SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY r ORDER BY length / period DESC, start, period) = 1
)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
  CAST((1000 * length) // period AS BIGINT) AS exponent_milli, sha256(coalesce(listed.text, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
