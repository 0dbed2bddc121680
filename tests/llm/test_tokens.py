import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrylog.llm import _tokens as T
from quarrylog.llm._common import slices

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\n\t\x0b\x1c 😀.,;|", max_size=60)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_a_plain_split(texts):
    words = T.words_of(pa.array(texts, pa.string()))
    joined = T.joined(words, lower=True)
    hashes = T.word_hashes(words)
    for i, text in enumerate(texts):
        a, b = words.first[i], words.first[i + 1]
        expected = (text or "").encode().split()
        assert [words.buf[s:e].tobytes() for s, e in zip(words.start[a:b], words.end[a:b])] == expected
        assert [int(h) for h in hashes[a:b]] == [xxhash.xxh64(w, seed=42).intdigest() for w in expected]
        if b > a:
            assert joined.buf[joined.start[a] : joined.end[b - 1]].tobytes() == b" ".join(expected).lower()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=150), min_size=1, max_size=10))
def test_hash_is_xxh64(values):
    buf = np.frombuffer(b"".join(values) + bytes(64), np.uint8)
    end = np.cumsum([len(v) for v in values])
    found = T.xxh64(buf, end - [len(v) for v in values], end)
    assert [int(x) for x in found] == [xxhash.xxh64(v, seed=42).intdigest() for v in values]


def test_rolling_depends_on_its_window_only():
    h = T.mix(np.arange(300, dtype=np.uint64))
    for width in (1, 2, 7, 25, 50):
        all_ = T.rolling(h, width)
        assert len(all_) == 301 - width and all(T.rolling(h[i : i + width], width)[0] == all_[i] for i in (0, 3, 250))
        assert len(np.unique(all_)) == len(all_)


def test_slices_keep_all_rows():
    batch = pa.record_batch({"text": pa.array(["a" * 10, None, "", "b" * 100, "c"] * 5)})
    parts = list(slices(batch, "text", 50))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist() and len(parts) > 5
