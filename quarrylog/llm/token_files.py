"""Files of token ids: each document compressed on its own with a shared dictionary, found by an index of offsets.

``write_tokens`` brings documents into the order of their ids; tasks of a Spark data source of its own encode them and write
shards; ``read_tokens`` reads them back, all of them or those of some ids only.  A folder has

* ``dictionary-<sha256>``: the zstandard dictionary, trained on serialized id arrays of a bounded sample;
* ``*.ids``, one for each range of ids: magic, width of an id in octets, the dictionary's SHA-256 (zeros: none), then a
  zstandard frame for each document (its ids, little-endian), then the index and its place (``INDEX``, ``FOOTER``);
* ``manifest.json``: the shards in their order with documents, ids, and first and last doc_id.

A task writes its shard under a name of its own, and only what the manifest names counts, so that tasks may be lost, run
again or run twice.  Driver and manifest hold a row a shard.

Defined results: a null or empty text has the end id only; rows with one doc_id stand in order of a hash of their text; rows
without a doc_id come last; an empty table gives a folder without shards, which reads as no rows; a sample too small to
train on gives no dictionary; further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from tokenizers import Tokenizer

from ..ordering import bounded_sample
from ._common import new_folder, slices, table
from ._tokens import Words, buffer_of
from .periodic_runs import distinct_words

END_ID = 0
#: The dictionary is trained on so many documents at most, of texts up to so many octets, and has so many octets.
SAMPLE_DOCS, SAMPLE_OCTETS, DICTIONARY_OCTETS = 1000, 16 << 10, 64 << 10
LEVEL = 3
#: Ids that a batch read back holds, about; octets of text that are encoded at once.
BATCH_IDS, ENCODED_OCTETS = 1 << 18, 1 << 20
#: A worker keeps the ids of the last chunks, so many or twice as many, of so many octets at most.
KNOWN_CHUNKS, KNOWN_OCTETS = 1 << 19, 64

MAGIC = b"tokens01"
INDEX = np.dtype([("doc_id", "<i8"), ("no_id", "u1"), ("offset", "<u8"), ("n_tokens", "<u8")])
FOOTER = np.dtype([("index_at", "<u8"), ("n_docs", "<u8"), ("magic", "S8")])
HEADER = len(MAGIC) + 4 + 32

# Kinds of bytes: white space, ASCII letters and digits, marks (the apostrophe is none, as contractions start with it), bytes that may
# end white space beyond ASCII, and the first bytes of characters of two bytes that are none.
_SPACE, _ALNUM, _MARK, _MAY_END_SPACE, _OF_TWO, _OTHER = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[[i for i in range(128) if chr(i).isalnum()]] = _ALNUM
_KIND[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'"]] = _MARK
_KIND[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = _MAY_END_SPACE
_KIND[0xC3:0xE0] = _OF_TWO
_CUT = np.zeros((6, 6), bool)
_CUT[[_ALNUM, _MARK, _OTHER], _SPACE] = True
_CUT[_ALNUM, _MARK] = _CUT[_MARK, _ALNUM] = True


# ---------------------------------------------------------------- encoding


class Encoder:
    """A tokenizer, made of its vocabulary file's text; strings of special tokens are ordinary text."""

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.by_chunk = splits_at_space(vocabulary)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, given: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(given, add_special_tokens=False)]

    def _chunk_ids(self, given: list[bytes]) -> list[bytes]:
        if len(self.known) > KNOWN_CHUNKS:
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, given))
        new = [k for k, ids in enumerate(found) if ids is None]
        for k in new:
            found[k] = self.older.get(given[k])
        missing = [k for k in new if found[k] is None]
        for k, ids in zip(missing, self._ids([given[k].decode() for k in missing]), strict=True):
            found[k] = ids
        self.known.update((given[k], found[k]) for k in new if len(given[k]) <= KNOWN_OCTETS)
        return found

    def __call__(self, column: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): ids of text r, with the end id, are ``ids[first[r]:first[r + 1]]``.  Equal chunks are encoded once."""
        if self.by_chunk:
            chunks = chunks_of(column)
            one, number = distinct_words(chunks)
            data = chunks.buf.tobytes()
            known, row_first = self._chunk_ids([data[a:b] for a, b in zip(chunks.start[one].tolist(), chunks.end[one].tolist(), strict=True)]), chunks.first
        else:
            known = self._ids([t or "" for t in column.to_pylist()])
            number, row_first = np.arange(len(known)), np.arange(len(known) + 1)
        known = [*known, np.array([end_id], "<u4").tobytes()]
        length = np.array([len(x) for x in known]) // 4
        flat, begin = np.frombuffer(b"".join(known), "<u4"), np.cumsum(length) - length
        ends = row_first[1:] + np.arange(len(row_first) - 1)
        order = np.full(len(number) + len(ends), len(known) - 1)
        inner = np.ones(len(order), bool)
        inner[ends] = False
        order[inner] = number
        sizes = length[order]
        stop = np.cumsum(sizes)
        ids = flat[np.repeat(begin[order] - (stop - sizes), sizes) + np.arange(int(stop[-1]) if len(stop) else 0)]
        return ids, np.concatenate([[0], stop[ends]]).astype(np.int64)


@lru_cache(maxsize=1)
def _encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def splits_at_space(vocabulary: str) -> bool:
    """Whether this tokenizer parts texts as ``chunks_of`` does before it looks for tokens."""
    given = json.loads(vocabulary)
    kind = given.get("pre_tokenizer") or {}
    return kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not given.get("normalizer")


def chunks_of(column: pa.Array) -> Words:
    """The texts cut before white space that follows another character, and between ASCII letters or digits and marks."""
    buf, at = buffer_of(column)
    size = int(at[-1])
    b = buf[:size]
    cut = np.zeros(size, bool)
    kind = _KIND[b]
    cut[1:] = _CUT.ravel()[6 * kind[:-1] + kind[1:]]
    # such a byte behind the first of two is no white space
    odd = np.flatnonzero((kind[1:-1] == _MAY_END_SPACE) & (kind[2:] == _SPACE))
    cut[odd + 2] = kind[odd] == _OF_TWO
    cut[at[:-1][at[:-1] < size]] = True
    start = np.flatnonzero(cut)
    return Words(buf, start, np.r_[start[1:], size][: len(start)].astype(np.int64), np.searchsorted(start, at))


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids) of docs(doc_id, text), row by row in their order; ids are little-endian unsigned 32-bit integers.

    The driver reads the vocabulary, a file of fixed size, and broadcasts it."""
    sent = docs.sparkSession.sparkContext.broadcast(_vocabulary(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(sent.value)
        for batch in batches:
            for part in slices(batch, "text", ENCODED_OCTETS):
                ids, first = encode(part.column("text"), end_id)
                data = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((4 * first).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.record_batch({"doc_id": part.column("doc_id"), "ids": data})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def _vocabulary(tokenizer_path: str) -> str:
    with open(tokenizer_path, encoding="utf-8") as f:
        return f.read()


# ---------------------------------------------------------------- files


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that pyarrow has for a path or an URI, with or without an authority."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def _read(path: str) -> bytes:
    where, name = _place(path)
    with where.open_input_file(name) as f:
        return f.read()


def _write(path: str, data: bytes) -> None:
    where, name = _place(path)
    where.create_dir(name.rpartition("/")[0], recursive=True)
    with where.open_output_stream(name) as f:
        f.write(data)


def _dictionary(data: bytes, level: int = 0) -> zstandard.ZstdCompressionDict | None:
    if not data:
        return None
    found = zstandard.ZstdCompressionDict(data)
    if level:
        found.precompute_compress(level=level)
    return found


def trained_dictionary(sample: list[bytes], octets: int = DICTIONARY_OCTETS) -> bytes:
    """A dictionary for id arrays like the sample's; empty if the sample is too small to train on."""
    try:
        return zstandard.train_dictionary(octets, sample, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


@dataclass
class _Shard(WriterCommitMessage):
    file: str
    docs: int
    tokens: int
    first: int | None
    last: int | None


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, vocabulary: str, width: int, end_id: int, dictionary: bytes) -> None:
        self.path, self.vocabulary, self.width, self.end_id, self.dictionary = path, vocabulary, width, end_id, dictionary

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Shard:
        index: list[np.ndarray] = []
        name, at, out = f"{uuid.uuid4().hex}.ids", HEADER, None
        encode = _encoder(self.vocabulary)
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(self.dictionary, LEVEL))
        for part in (p for batch in iterator for p in slices(batch, "text", ENCODED_OCTETS)):
            if out is None:
                where, place = _place(f"{self.path}/{name}")
                where.create_dir(place.rpartition("/")[0], recursive=True)
                out = where.open_output_stream(place)
                out.write(MAGIC + np.array([self.width], "<u4").tobytes() + (hashlib.sha256(self.dictionary).digest() if self.dictionary else bytes(32)))
            ids, first = encode(part.column("text"), self.end_id)
            data = ids.astype(f"<u{self.width}").tobytes()
            frames = [compressor.compress(data[self.width * a : self.width * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            sizes = np.array([len(f) for f in frames])
            rows = np.zeros(part.num_rows, INDEX)
            rows["no_id"] = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            rows["doc_id"] = part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            rows["n_tokens"], rows["offset"] = np.diff(first), at + np.cumsum(sizes) - sizes
            out.write(b"".join(frames))
            at += int(sizes.sum())
            index.append(rows)
        if out is None:
            return _Shard("", 0, 0, None, None)
        listed = np.concatenate(index)
        out.write(listed.tobytes() + np.array([(at, len(listed), MAGIC)], FOOTER).tobytes())
        out.close()
        of = lambda r: None if r["no_id"] else int(r["doc_id"])
        return _Shard(name, len(listed), int(listed["n_tokens"].sum()), of(listed[0]), of(listed[-1]))

    def commit(self, messages: list[_Shard | None]) -> None:
        last = 1 << 63  # no doc_id comes after all
        shards = sorted((m for m in messages if m and m.docs), key=lambda m: (last if m.first is None else m.first, last if m.last is None else m.last))
        if self.dictionary:
            _write(f"{self.path}/dictionary-{hashlib.sha256(self.dictionary).hexdigest()}", self.dictionary)
        _write(f"{self.path}/manifest.json", json.dumps({"width": self.width, "dictionary": hashlib.sha256(self.dictionary).hexdigest() if self.dictionary else "", "shards": [vars(m) for m in shards]}).encode())

    def abort(self, messages: list[_Shard | None]) -> None:
        for m in messages:
            if m and m.file:
                where, place = _place(f"{self.path}/{m.file}")
                where.delete_file(place)


@dataclass
class _Part(InputPartition):
    file: str
    start: int
    wanted: list[int] | None


class _Reader(DataSourceReader):
    def __init__(self, path: str, wanted: list[int] | None) -> None:
        self.path, self.wanted = path, wanted

    def partitions(self) -> list[_Part]:
        parts, start = [], 0
        for shard in json.loads(_read(f"{self.path}/manifest.json"))["shards"]:
            low, high = shard["first"], shard["last"]
            wanted = self.wanted and [i for i in self.wanted if low is not None and i >= low and (high is None or i <= high)]
            if self.wanted is None or wanted:
                parts.append(_Part(shard["file"], start, wanted))
            start += shard["tokens"]
        return parts or [_Part("", 0, None)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        where, place = _place(f"{self.path}/{partition.file}")
        with where.open_input_file(place) as f:
            header = f.read(HEADER)
            width, digest = int(np.frombuffer(header, "<u4", 1, len(MAGIC))[0]), header[-32:]
            dictionary = b""
            if any(digest):
                dictionary = _read(f"{self.path}/dictionary-{digest.hex()}")
                if hashlib.sha256(dictionary).digest() != digest:
                    raise ValueError(f"{partition.file} was written with another dictionary")
            f.seek(f.size() - FOOTER.itemsize)
            footer = np.frombuffer(f.read(), FOOTER)[0]
            if header[: len(MAGIC)] != MAGIC or footer["magic"] != MAGIC:
                raise ValueError(f"{partition.file} is no file of token ids, or not a whole one")
            f.seek(int(footer["index_at"]))
            index = np.frombuffer(f.read(int(footer["n_docs"]) * INDEX.itemsize), INDEX)
            starts = partition.start + np.cumsum(index["n_tokens"].astype(np.int64)) - index["n_tokens"].astype(np.int64)
            ends = np.r_[index["offset"][1:], footer["index_at"]].astype(np.int64)
            rows = np.arange(len(index))
            if partition.wanted is not None:
                rows = rows[(index["no_id"] == 0) & np.isin(index["doc_id"], partition.wanted)]
            decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
            batch = (np.cumsum(index["n_tokens"][rows]) // BATCH_IDS).astype(np.int64)
            for rows_ in np.split(rows, np.flatnonzero(np.diff(batch)) + 1) if len(rows) else []:
                ids = []
                for r in rows_:
                    f.seek(int(index["offset"][r]))
                    raw = decompressor.decompress(f.read(int(ends[r] - index["offset"][r])))
                    ids.append(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes())
                names = pa.array(index["doc_id"][rows_], mask=index["no_id"][rows_] > 0)
                yield pa.record_batch({"doc_id": names, "start": pa.array(starts[rows_]), "n_tokens": pa.array(index["n_tokens"][rows_].astype(np.int64)), "ids": pa.array(ids, pa.binary())})


class TokenFiles(DataSource):
    """The format for ``spark.read.format`` and ``df.write.format``; options: tokenizer (a file), width, end_id and dictionary
    (hexadecimal) to write (doc_id, text), and doc_ids to read."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> _Reader:
        wanted = self.options.get("doc_ids")
        return _Reader(self.options["path"], None if wanted is None else sorted({int(i) for i in wanted.split(",") if i}))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], _vocabulary(self.options["tokenizer"]), int(self.options["width"]), int(self.options["end_id"]), bytes.fromhex(self.options.get("dictionary", "")))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, shards: int | None = None) -> None:
    """Encodes docs(doc_id, text) into a new folder of files of token ids, a shard for each of ``shards`` ranges of doc_id (as many
    as the session has shuffle partitions).  Many rows of one doc_id are parted by their text and by their place."""
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample, _ = bounded_sample(given, SAMPLE_DOCS, F.xxhash64("doc_id", "text"), "doc_id", where=F.octet_length("text") <= SAMPLE_OCTETS)
    width = 2 if max(Tokenizer.from_str(_vocabulary(tokenizer_path)).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    # a bounded sample
    arrays = [np.frombuffer(r.ids, "<u4").astype(f"<u{width}").tobytes() for r in encoded(sample, tokenizer_path, end_id).select("ids").collect()]
    order = [F.col("doc_id").asc_nulls_last(), F.col("_h"), F.col("_at")]
    keyed = given.withColumns({"_h": F.xxhash64("text"), "_at": F.monotonically_increasing_id()})
    ranged = keyed.repartitionByRange(shards or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    spark.dataSource.register(TokenFiles)
    out = ranged.select("doc_id", "text").write.format("token_files").mode("overwrite")
    out.option("tokenizer", tokenizer_path).option("width", width).option("end_id", end_id).option("dictionary", trained_dictionary(arrays).hex()).save(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files: start is the number of ids of all documents before, ids are little-endian
    unsigned 32-bit integers.  With doc_ids only their frames are read, out of the shards whose range has them."""
    spark.dataSource.register(TokenFiles)
    reader = spark.read.format("token_files")
    if doc_ids is not None:
        reader = reader.option("doc_ids", ",".join(map(str, doc_ids)))
    return reader.load(path)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_folder(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
