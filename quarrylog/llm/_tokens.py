"""Vectorised tokenisation and hashing of whole text columns.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``.  Everything works on the UTF-8 buffer of an Arrow
string column, so no Python code runs per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_PAD = 64
#: Strings above this length are hashed one by one; there are few of them in any number of bytes.
_LONG = 1 << 12
#: Spaces for texts whose punctuation does not count: every ASCII character but letters and digits.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])

# Fixed values of the XXH64 algorithm.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


@dataclass
class Words:
    """Words of a column: ``buf[start[i]:end[i]]``; those of row r are ``first[r]`` up to ``first[r + 1]``."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes, padded so that eight-byte reads stay inside, and its row offsets; null counts as empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(_PAD, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    size = int(at[-1] - at[0])
    buf = np.zeros(size + _PAD, np.uint8)
    if size:
        buf[:size] = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return buf, at - at[0]


def words_of(column: pa.Array, space: np.ndarray = _SPACE) -> Words:
    buf, at = buffer_of(column)
    size = int(at[-1])
    solid = ~space[buf[:size]]
    opens = np.ones(size, bool)
    opens[1:] = ~solid[:-1]
    opens[at[:-1][at[:-1] < size]] = True
    closes = np.ones(size, bool)
    closes[:-1] = ~solid[1:]
    closes[at[1:][at[1:] > 0] - 1] = True
    start = np.flatnonzero(solid & opens)
    end = np.flatnonzero(solid & closes) + 1
    return Words(buf, start, end, np.searchsorted(start, at))


def joined(words: Words, lower: bool = False) -> Words:
    """The same words in a buffer where one space parts them."""
    length = words.end - words.start
    start = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length + 1, out=start[1:])
    out = np.full(int(start[-1]) + _PAD, 0x20, np.uint8)
    out[int(start[-1]) :] = 0
    if len(length):
        shift = np.repeat(start[:-1] - words.start, length)
        within = np.arange(len(shift)) - np.repeat(np.cumsum(length) - length, length)
        source = within + np.repeat(words.start, length)
        taken = words.buf[source]
        out[source + shift] = _LOWER[taken] if lower else taken
    return Words(out, start[:-1], start[:-1] + length, words.first)


def lowered(words: Words) -> Words:
    """The same words with A-Z in lower case."""
    return Words(_LOWER[words.buf], words.start, words.end, words.first)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of every ``buf[start:end]``; buf must have 8 bytes more than the largest end."""
    n = len(start)
    if n == 0:
        return np.zeros(0, np.uint64)
    if len(long := np.flatnonzero(end - start > _LONG)):
        out = np.zeros(n, np.uint64)
        short = np.flatnonzero(end - start <= _LONG)
        out[short] = xxh64(buf, start[short], end[short], seed)
        out[long] = [xxhash.xxh64_intdigest(buf[start[k] : end[k]].data, seed) for k in long]
        return out
    with np.errstate(over="ignore"):
        lanes8 = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
        lanes4 = np.ndarray((len(buf) - 3,), "<u4", buf, strides=(1,))
        length = (end - start).astype(np.int64)
        base = np.uint64(seed)
        h = np.full(n, base + _P5, np.uint64)
        at = start.astype(np.int64)
        rest = length
        big = np.flatnonzero(length >= 32)
        if len(big):
            acc = [np.full(len(big), v, np.uint64) for v in (base + _P1 + _P2, base + _P2, base, base - _P1)]
            stripes, pos = length[big] // 32, at[big]
            live = np.arange(len(big))
            for k in range(int(stripes.max())):
                live = live[stripes[live] > k]
                for lane in range(4):
                    acc[lane][live] = _round(acc[lane][live], lanes8[pos[live] + 32 * k + 8 * lane])
            merged = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for lane in range(4):
                merged = (merged ^ _round(np.zeros(len(big), np.uint64), acc[lane])) * _P1 + _P4
            h[big] = merged
            at, rest = at.copy(), rest.copy()
            at[big] += 32 * stripes
            rest[big] -= 32 * stripes
        h += length.astype(np.uint64)
        eights = rest >> 3
        for k in range(int(eights.max())):
            m = np.flatnonzero(eights > k)
            h[m] = _rotl(h[m] ^ _round(np.zeros(len(m), np.uint64), lanes8[at[m] + 8 * k]), 27) * _P1 + _P4
        at = at + 8 * eights
        m = np.flatnonzero(rest & 4)
        h[m] = _rotl(h[m] ^ (lanes4[at[m]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at = at + (rest & 4)
        for k in range(3):
            m = np.flatnonzero((rest & 3) > k)
            h[m] = _rotl(h[m] ^ (buf[at[m] + k].astype(np.uint64) * _P5), 11) * _P1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    return h


def word_hashes(words: Words) -> np.ndarray:
    return xxh64(words.buf, words.start, words.end)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of h."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin fingerprints modulo 2**64 of every ``width`` consecutive hashes (rows are not looked at)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        out, have, block, filled = None, 0, h, 1
        # binary powers: a block of 2k hashes is its first k times base**k, plus its last k
        power = base
        todo = width
        while todo:
            if todo & 1:
                part = block[have : have + n]
                out = part.copy() if out is None else out * power + part
                have += filled
            todo >>= 1
            if todo:
                block = block[:-filled] * power + block[filled:]
                power = power * power
                filled *= 2
    return mix(out)
