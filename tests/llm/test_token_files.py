import glob
import json
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrylog.llm import token_files as T

BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return t


def _plain(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_chunks_give_the_ids_of_whole_texts(tokenizer, monkeypatch):
    rng = random.Random(1)
    pieces = ["a", "Word", "don't", "'", ",", "(x", "-", "é.", "—", "'ll", "7'", "_", " ", "  ", "\n", "\t", "\r\n", " ", "\u0085", "　", " ", " ", "é", "è", "ß", "ó ", "日本 ", "😀", "12", "!?", "'s", "\x1c", "\x0b", "\x00", "<|endoftext|>", " ", " ", " ", "᠎", "​"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(3000)] + [None, "", " ", "x" * 5000, "long  " * 3000]
    encode = T.Encoder(T._vocabulary(BPE))
    assert encode.by_chunk
    monkeypatch.setattr(T, "KNOWN_CHUNKS", 500)  # what is known is forgotten, too
    for encode.by_chunk in (True, False, True):
        ids, first = encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [_plain(tokenizer, t) for t in texts]
    ids, first = encode(pa.array([], pa.string()))
    assert ids.tolist() == [] and first.tolist() == [0]


def test_other_tokenizers_are_not_cut():
    assert not T.splits_at_space(T._vocabulary(public_tokenizers.path("word_bpe_49k.json")))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = ["the", "quick", "brown", "fox", "jumps", "Über", "naïve", "x" * 40, "😀", "3.14"]
    out = [(i * 7 % 1009, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(1009)]
    out += [(-5, None), (2000, ""), (2001, "word " * 30_000), (None, "no id"), (None, None)] + [(1500, f"text {i % 3}") for i in range(300)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('tokens')}/new"
    T.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, BPE, shards=7)
    return path


def test_round_trip_in_order(spark, rows, folder, tokenizer):
    found = T.read_tokens(spark, folder).collect()
    assert len(found) == len(rows)
    key = lambda i: (i is None, i or 0)
    found.sort(key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((i for i, _ in rows), key=key)
    at, by_id = 0, {}
    for r in found:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert (r.start, r.n_tokens) == (at, len(ids))
        at += len(ids)
        by_id.setdefault(r.doc_id, []).append(ids)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(_plain(tokenizer, t))
    assert {i: sorted(x) for i, x in by_id.items()} == {i: sorted(x) for i, x in want.items()}


def test_files_have_what_they_say(folder):
    with open(f"{folder}/manifest.json") as f:
        manifest = json.load(f)
    assert manifest["width"] == 2 and len(manifest["shards"]) == 7  # one id with a quarter of the rows is parted
    assert {os.path.basename(p) for p in glob.glob(f"{folder}/*.ids")} == {s["file"] for s in manifest["shards"]}
    with open(f"{folder}/dictionary-{manifest['dictionary']}", "rb") as f:
        dictionary = zstandard.ZstdCompressionDict(f.read())
    shard = manifest["shards"][0]
    with open(f"{folder}/{shard['file']}", "rb") as f:
        data = f.read()
    assert data[12:44].hex() == manifest["dictionary"]
    footer = np.frombuffer(data[-T.FOOTER.itemsize :], T.FOOTER)[0]
    index = np.frombuffer(data[int(footer["index_at"]) : -T.FOOTER.itemsize], T.INDEX)
    assert len(index) == shard["docs"] and index["n_tokens"].sum() == shard["tokens"]
    a, b = index["offset"][3:5]
    ids = np.frombuffer(zstandard.ZstdDecompressor(dict_data=dictionary).decompress(data[int(a) : int(b)]), "<u2")
    assert len(ids) == index["n_tokens"][3] and ids[-1] == 0
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompress(data[int(a) : int(b)])  # each frame needs the shared dictionary


def test_single_documents(spark, rows, folder, tokenizer):
    found = T.read_tokens(spark, folder, doc_ids=[14, 2001, -5, 999_999])
    assert found.rdd.getNumPartitions() < 7  # the other shards are not opened
    texts = dict(rows)
    whole = {(r.doc_id, r.start) for r in T.read_tokens(spark, folder).select("doc_id", "start").collect()}
    got = found.collect()
    assert {r.doc_id for r in got} == {14, 2001, -5}
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == _plain(tokenizer, texts[r.doc_id]) and (r.doc_id, r.start) in whole
    assert T.read_tokens(spark, folder, doc_ids=[]).collect() == []


def test_a_damaged_file_is_an_error(spark, folder, tmp_path):
    for name in os.listdir(folder):
        with open(f"{folder}/{name}", "rb") as f:
            data = f.read()
        with open(f"{tmp_path}/{name}", "wb") as f:
            f.write(data[:-9] if name.endswith(".ids") else data)
    with pytest.raises(Exception, match="no file of token ids"):
        T.read_tokens(spark, str(tmp_path)).collect()


def test_orphans_of_lost_tasks_do_not_count(tmp_path):
    writer = T._Writer(str(tmp_path), T._vocabulary(BPE), 2, 0, b"")
    batch = pa.record_batch({"doc_id": pa.array([1, 2]), "text": pa.array(["a", None])})
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    writer.commit([kept, writer.write(iter([]))])
    parts = T._Reader(str(tmp_path), None).partitions()
    assert [p.file for p in parts] == [kept.file] and lost.file != kept.file
    assert [b.column("doc_id").to_pylist() for p in parts for b in T._Reader(str(tmp_path), None).read(p)] == [[1, 2]]
    writer.abort([kept, None])
    assert kept.file not in os.listdir(tmp_path)


def test_edges(spark, edges, edge_rows, nothing, clashing, tmp_path, tokenizer):
    for n, df in enumerate((edges, clashing)):
        T.write_tokens(df, f"{tmp_path}/{n}", BPE)
        found = T.read_tokens(spark, f"{tmp_path}/{n}").collect()
        assert sorted((str(r.doc_id), r.n_tokens) for r in found) == sorted((str(i), len(_plain(tokenizer, t))) for i, t, *_ in edge_rows)
    T.write_tokens(nothing, f"{tmp_path}/none", BPE)
    assert T.read_tokens(spark, f"{tmp_path}/none").collect() == []


def test_wide_vocabulary_and_end(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    T.write_tokens(df, f"{tmp_path}/x", BPE, end_id=1 << 20)
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in T.read_tokens(spark, f"{tmp_path}/x").collect()}
    assert ids[2] == [1 << 20] and len(ids[1]) == 3


def test_query(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    found = sorted(T.op12_token_files(spark, sf).collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy(F.col("doc_id")).select("doc_id", "text").collect()
    at, want = 0, []
    for doc_id, text in docs:
        ids = _plain(tokenizer, text)
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in found] == want
