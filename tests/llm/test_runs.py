import hashlib
import random
import time
import zlib

import duckdb
import numpy as np
import pytest

from quarrylog.llm import periodic_runs as P


def _brute(words, exponent=4, least=6):
    """All maximal stretches by their definition: for each period the unbroken sequences of equal words, smallest period first."""
    found = {}
    for p in range(1, len(words) // exponent + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, exponent * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def _collapsed(words, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def _texts(rng, n):
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            unit = rng.choices("abc", k=rng.randint(1, 6))
            parts += unit * rng.randint(1, 7) + unit[: rng.randint(0, len(unit))] + rng.choices("abcd", k=rng.randint(0, 5))
        out.append(parts)
    return out


def _thue_morse(n):
    return ["ab"[i.bit_count() % 2] for i in range(n)]


def test_runs_against_their_definition(spark):
    rng = random.Random(5)
    texts = _texts(rng, 300) + [["x"] * n for n in (0, 1, 5, 6, 7, 100, 999)] + [["a", "b"] * 40 + ["a"], _thue_morse(1 << 12), (_thue_morse(64) * 5)[:-3]]
    df = spark.createDataFrame([(i, " \n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for exponent, least in ((4, 6), (2, 2), (3, 9)):
        for r in P.periodic_runs(df, exponent, least).collect():
            runs = _brute(texts[r.doc_id], exponent, least)
            assert [tuple(x) for x in r.runs] == runs, (r.doc_id, exponent)
            assert r.n_words == len(texts[r.doc_id]) and r.collapsed == _collapsed(texts[r.doc_id], runs)


def test_a_hash_that_misleads_changes_nothing(monkeypatch):
    rng = random.Random(6)
    texts = _texts(rng, 200)
    ids = np.array([ord(w) for t in texts for w in t])
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    want = P.runs_of(ids, first).tolist()
    assert P._found(ids, first, 4, 6, 1) is None  # base 1: any two stretches with the same words in any order agree
    monkeypatch.setattr(P, "BASES", (1, P.BASES[0]))
    assert P.runs_of(ids, first).tolist() == want
    monkeypatch.setattr(P, "BASES", (1, 1))
    assert P.runs_of(ids, first).tolist() == want
    monkeypatch.setattr(P, "BLOCK", 7)
    monkeypatch.setattr(P, "BASES", (12345,))
    assert P.runs_of(ids, first).tolist() == want


def test_equal_hashes_of_words_are_told_apart(monkeypatch):
    words = P.words_of(__import__("pyarrow").array(["a b a b a b c a b", None, "b a"]))
    want = P.distinct_words(words)[1]
    monkeypatch.setattr(P, "word_hashes", lambda w: np.zeros(len(w.start), np.uint64))
    first, again = P.distinct_words(words)
    assert again[first].tolist() == list(range(len(first)))
    assert (want[:, None] == want).tolist() == (again[:, None] == again).tolist()


def test_long_text_of_one_word():
    ids, first = np.zeros(60_000, np.int64), np.array([0, 60_000])
    began = time.perf_counter()
    assert P.runs_of(ids, first).tolist() == [[0, 60_000, 1]]
    assert time.perf_counter() - began < 20


def test_query_repeats_a_tenth_and_digests_it(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(["one", "two", "three", "ü😀"], k=rng.randint(0, 60)))) for i in range(400)] + [(None, "a a a a a a b"), (7, None), (7, ""), (-3, "x\ty\x0bz\xa0q")] + [(500, "r s " * 9)] * 3
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = P.op11_periodic_runs(spark, str(tmp_path))
    assert dict(found.dtypes) | {} == {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"}
    want, changed = [], 0
    for doc_id, text in rows:
        words = [w for w in __import__("re").split("[\\x20\\t-\\r]+", text or "") if w]
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        runs = _brute(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest(listed), digest(_collapsed(words, runs))))
    got = [tuple(r) for r in found.collect()]
    assert changed > 20 and sorted(map(repr, got)) == sorted(map(repr, want))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(repr, con.execute(P.ORACLE_SQL).fetchall())) == sorted(map(repr, want))


def test_edges(spark, edges, edge_rows, nothing, clashing):
    want = {i: (len((t or "").split()), _brute((t or "").split())) for i, t, *_ in edge_rows if i != 6}
    for df in (edges, clashing):
        rows = P.periodic_runs(df).collect()
        assert len(rows) == len(edge_rows)
        for r in rows:
            if r.doc_id != 6:
                assert (r.n_words, [tuple(x) for x in r.runs]) == want[r.doc_id]
    assert P.periodic_runs(nothing).collect() == []
    with pytest.raises(ValueError):
        P.periodic_runs(edges, exponent=1)
