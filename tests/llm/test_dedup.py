import hashlib
import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pyspark.sql import functions as F

from quarrylog.llm import _tokens as T
from quarrylog.llm import _common, decontaminate, near_copies, pii, simhash_dedup, substring_dedup

ALPHABET = [f"w{i}" for i in range(40)]


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(ids, prints):
    root = list(range(len(ids)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_fingerprints_and_components(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(ALPHABET, k=rng.randint(0, 400))) for _ in range(60)]
    for t in texts[:25]:
        words = t.split()
        for _ in range(3):
            if words:
                words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    texts += [None, "", " ", "UPPER lower", "upper LOWER", "É é", "é É", "a\x1cb c"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    found = simhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), hot_group=4).collect()
    prints = [_fingerprint(t) for t in texts]
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in found} == dict(enumerate(prints))
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(_components(range(len(texts)), prints)))


def test_index_finds_every_link():
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([seeds] + [seeds ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(12)]))
    group = rng.integers(0, 3, len(fp))
    order = np.lexsort((simhash_dedup.gray_rank(fp), group))
    fp, group = fp[order], group[order]
    root = simhash_dedup.linked(fp, group)
    for g in range(3):
        at = np.flatnonzero(group == g)
        expected = _components(list(at), [int(x) for x in fp[at]])
        assert len(set(zip(root[at], expected))) == len(set(root[at])) == len(set(expected))


def test_groups_are_dealt_out_until_they_are_small(spark):
    rng = np.random.default_rng(12)
    near = (np.uint64(0xABCDEF0123456789) ^ rng.integers(0, 1 << 9, 200, dtype=np.uint64)) ^ (rng.integers(0, 1 << 9, 200, dtype=np.uint64) << np.uint64(30))
    fp = np.unique(np.r_[near, rng.integers(0, 2**63, 100, dtype=np.uint64)])
    reps = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    groups = {}
    for r in simhash_dedup._group_keys(reps, 10).collect():
        groups.setdefault(r.key, set()).add(r.fp & (1 << 64) - 1)
    together = {frozenset((a, b)) for g in groups.values() for a in g for b in g if a < b}
    values = [int(x) for x in fp]
    assert all(frozenset((a, b)) in together for a in values for b in values if a < b and (a ^ b).bit_count() <= 2)
    assert max(map(len, groups.values())) < 100
    links = simhash_dedup.edges(reps, hot_group=10)
    labels = {r.node & (1 << 64) - 1: r.label for r in simhash_dedup.components(links).collect()}
    expected = _components(list(range(len(values))), values)
    for i, a in enumerate(values):
        for j, b in enumerate(values[:i]):
            assert (expected[i] == expected[j]) == (labels.get(a, ("own", i)) == labels.get(b, ("own", j)))


def test_a_fingerprint_that_most_rows_have(spark, monkeypatch):
    rows = [(i, "") for i in range(300)] + [(1000 + i, f"text {i} of its own with words {i * 7}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    usual = sorted(map(tuple, simhash_dedup.near_duplicates(df).collect()))
    monkeypatch.setattr(_common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(_common, "HOT_SHARE", 10)
    assert sorted(map(tuple, simhash_dedup.near_duplicates(df).collect())) == usual and len(usual) == 350


def test_gray_neighbours_differ_in_one_bit():
    values = np.arange(256, dtype=np.uint64)
    by_rank = values[np.argsort(simhash_dedup.gray_rank(values))]
    assert (np.bitwise_count(by_rank[1:] ^ by_rank[:-1]) == 1).all()


def test_long_chains_are_one_component(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 40)]
    found = simhash_dedup.components(spark.createDataFrame(chain, "u long, v long")).collect()
    assert {r.node: r.label for r in found} == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)}


def test_a_node_that_most_edges_meet_at(spark, monkeypatch):
    monkeypatch.setattr(_common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(_common, "HOT_SHARE", 10)
    star = [(i, 500) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(5)]
    for rows in (500_000, 0):
        monkeypatch.setattr(simhash_dedup, "TASK_ROWS", rows)
        found = simhash_dedup.components(spark.createDataFrame(star, "u long, v long")).collect()
        assert {r.node: r.label for r in found} == {i: 1 for i in [*range(1, 400), 500]} | {1000 + i: 1000 for i in range(6)}


def test_of_equal_rows_one_is_kept(spark, monkeypatch):
    text = "A text of its own with some words in it, which a good many rows repeat as it is."
    rows = [(5, text, f"s{i % 3}") for i in range(200)] + [(5, "Another text with the same number as those, and no word more.", "x"), (None, text, "y"), (None, "A third text that has no number at all but stands here twice or so.", "z")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    usual = sorted(map(repr, simhash_dedup.deduplicated(df).collect()))
    assert len(usual) == 3 and sum(text in r and "doc_id=5" in r for r in usual) == 1
    monkeypatch.setattr(_common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(_common, "HOT_SHARE", 10)
    assert sorted(map(repr, simhash_dedup.deduplicated(df).collect())) == usual
    plan = simhash_dedup.deduplicated(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" not in plan


def test_rows_that_repeat_thousands_of_times(spark, monkeypatch):
    rng = random.Random(21)
    words = lambda n: " ".join(rng.choices(ALPHABET, k=n))
    shared, hot = words(70), words(300)
    base = [(1, f"{words(20)} {shared} {words(30)}"), (7, f"{shared} {hot}"), (9, f"{words(5)} {hot} {shared}"), (9, "short"), (None, shared + " x"), (12, None)]
    want = {}
    for r in substring_dedup.without_repeats(spark.createDataFrame(base, "doc_id long, text string")).collect():
        want.setdefault(r.doc_id, set()).add(tuple(r))
    took = []
    for times in (1000, 5000):
        rows = base + [base[1]] * times + [base[2]] * 3 + [base[4], base[5]] * 2
        monkeypatch.setattr(_common, "COPIES", 300)
        began = time.perf_counter()
        found = [tuple(r) for r in substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
        took.append(time.perf_counter() - began)
        assert len(found) == len(rows)
        for i in want:
            assert {r for r in found if r[0] == i} == want[i]
        assert sum(r[0] == 7 for r in found) == times + 1 and sum(r[0] is None for r in found) == 3
    assert took[1] < 2 * took[0] + 2


def _removed(rows, width=50):
    first = {}
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in texts:
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in texts:
        kept = [True] * len(w)
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < d:
                kept[p : p + width] = [False] * width
        out.append((d, len(w), len(w) - sum(kept), hashlib.sha256(b" ".join(x for x, k in zip(w, kept) if k)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("group_rows", [4096, 3])
def test_repeated_windows(spark, monkeypatch, group_rows):
    monkeypatch.setattr(substring_dedup, "GROUP_ROWS", group_rows)
    rng = random.Random(9)
    passages = [rng.choices(ALPHABET, k=rng.randint(49, 130)) for _ in range(6)]
    rows = []
    for i in range(70):
        words = rng.choices(ALPHABET, k=rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(passages)
        rows.append((i, " ".join(words) if i % 3 else "\n".join(words) + " "))
    rows += [(100, rows[5][1]), (101, rows[5][1]), (101, rows[5][1]), (102, " ".join(["same"] * 200)), (103, " ".join(["same"] * 90)), (104, None), (105, "")]
    rows += [(106, " ".join(["same", "pair"] * 80)), (107, " ".join(["pair", "same"] * 60 + rows[5][1].split()[:70])), (108, " ".join(["same"] * 120 + ["end"]))]
    rows += [((1 << 63) - 1, " ".join(["same"] * 60)), (-(1 << 63), " ".join(passages[0] + ["first"]))]
    rng.shuffle(rows)
    found = substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found.collect())
    assert got == _removed(rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in found.collect())


def test_common_prefixes_are_those_of_neighbours():
    rng = np.random.default_rng(3)
    path = rng.integers(0, 2, (5, 200)).astype(np.int32)
    path = path[:, np.lexsort(path[::-1])]
    shared = substring_dedup.common_prefixes(list(path))
    for i in range(1, 200):
        same = path[:, i] == path[:, i - 1]
        assert shared[i] == (5 if same.all() else int(np.argmin(same)))


def test_one_word_a_hundred_thousand_times(spark):
    rows = [(i, " ".join(["same"] * (100_000 - i))) for i in range(3)] + [(9, "x " * 60), (None, "same " * 50), (None, "same " * 70)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((r.n_words, r.n_removed) for r in substring_dedup.without_repeats(df, with_text=False).collect())
    assert found == sorted([(100_000, 0), (99_999, 99_999), (99_998, 99_998), (60, 0), (50, 50), (70, 70)])


def test_suffixes_of_a_repetitive_text_are_few(spark):
    batch = pa.record_batch({"id": pa.array([5]), "th": pa.array([1]), "text": pa.array([" ".join(["a", "b", "c"] * 5000)])})
    anchors = np.unique(substring_dedup._Windows(batch.column("text")).anchor).view(np.int64)
    rows = pa.Table.from_batches(substring_dedup._suffixes([batch.append_column("anchors", pa.array([anchors]))])).to_pylist()
    assert len(rows) == 3 and sum(b - a for r in rows for a, b in zip(r["ranges"][::2], r["ranges"][1::2])) == 15_000 - 49


def test_trees_do_not_depend_on_batches():
    rng = np.random.default_rng(8)
    path = rng.integers(0, 2, (5, 400)).astype(np.int32)
    ids = rng.integers(0, 6, 400)
    order = np.lexsort((ids, *path[::-1]))
    path, ids = path[:, order], ids[order]
    whole = pa.record_batch({"id": pa.array(ids), "th": pa.array(np.arange(400)), "ranges": pa.array([[i, i + 1] for i in range(400)]), **{f"s{k}": pa.array(path[k]) for k in range(5)}})
    least = {}
    for i in range(400):
        least.setdefault(tuple(path[:, i]), ids[i])
    expected = [i for i in range(400) if ids[i] > least[tuple(path[:, i])]]
    for size in (400, 64, 7, 1):
        parts = substring_dedup._trees(iter([whole.slice(at, size) for at in range(0, 400, size)] + [whole.slice(0, 0)]))
        assert [t for b in parts for t in b.column("th").to_pylist()] == expected


def _brute_tiles(doc, item, minimum=5):
    """Greedy string tiling as it is defined: the longest match of unmarked tokens, again and again."""
    marked_d, marked_i, covered = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not marked_d[i + n] and not marked_i[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < minimum:
            return covered
        marked_d[i : i + n] = marked_i[j : j + n] = [True] * n
        covered += n


def test_tiling_covers_what_greedy_tiling_covers(spark):
    rng = random.Random(2)
    items = [rng.choices(ALPHABET[:30], k=rng.randint(12, 40)) for _ in range(4)]
    docs = []
    for i in range(30):
        words = rng.choices(ALPHABET, k=rng.randint(5, 40))
        item = rng.choice(items)
        cut = rng.randint(0, len(item))
        if i % 3 == 0:
            words += item[cut:] + ["between"] + item[:cut]
        elif i % 3 == 1:
            words[2:2] = item[:cut]
        docs.append(words)
    d = spark.createDataFrame([(i, " ".join(w).upper() + ".") for i, w in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(j, ", ".join(w)) for j, w in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.covered for r in decontaminate.contaminated(d, b, coverage=0.0).collect()}
    expected = {(i, j): c for i, w in enumerate(docs) for j, item in enumerate(items) if (c := _brute_tiles(w, item))}
    assert found == expected
    half = {(r.doc_id, r.item_id): r.covered for r in decontaminate.contaminated(d, b).collect()}
    assert half == {k: c for k, c in expected.items() if 2 * c >= len(items[k[1]])} and len(half) > 5


def test_tiles_are_those_of_the_definition():
    rng = random.Random(11)
    for _ in range(300):
        words = rng.choice([2, 3, 30])
        doc, item = ([rng.randrange(words) for _ in range(rng.randint(0, 40))] for _ in range(2))
        at = rng.randint(0, len(doc))
        doc[at:at] = item[rng.randint(0, 20) :] + item[: rng.randint(0, 20)]
        minimum = rng.choice([1, 2, 5])
        h = lambda x: T.mix(np.array(x, np.uint64) + np.uint64(1))
        found = decontaminate.tiles(h(doc), h(item), minimum)
        assert sum(n for *_, n in found) == _brute_tiles(doc, item, minimum)
        assert all(doc[i : i + n] == item[j : j + n] for i, j, n in found) and [n for *_, n in found] == sorted((n for *_, n in found), reverse=True)


def test_needed_seeds_are_the_least_under_tiles():
    for n in range(1, 40):
        size = min(n, 5)
        for coverage in (0.0, 0.3, 0.5, 1.0):
            least = min(sum(t - size + 1 for t in parts) for total in range(max(1, math.ceil(coverage * n - 1e-9)), n + 1) for parts in _parts(total, size))
            assert decontaminate._needed(np.array([n]), coverage, 5)[0] == least, (n, coverage)


def _parts(total, least):
    """Few and many tiles of a total length: what the number of seeds depends on is how many there are."""
    for k in range(1, total // least + 1):
        yield [least] * (k - 1) + [total - least * (k - 1)]


def test_long_and_repetitive_texts(spark):
    rng = random.Random(4)
    many = ["same"] * 1_000_000
    mixed = rng.choices(["a", "b"], k=200_000)
    docs = spark.createDataFrame([(1, " ".join(many)), (2, " ".join(mixed)), (None, " ".join(["same"] * 600))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(["same"] * 500)), (2, " ".join(mixed[1000:1400])), (3, " ".join(["b", "c"] * 50))], "item_id long, text string")
    began = time.perf_counter()
    found = sorted((str(r.doc_id), r.item_id, r.covered) for r in decontaminate.contaminated(docs, bench).collect())
    assert found == [("1", 1, 500), ("2", 2, 400), ("None", 1, 500)] and time.perf_counter() - began < 90


def test_a_document_with_the_whole_benchmark(spark, monkeypatch):
    rng = random.Random(31)
    items = [" ".join(rng.choices(ALPHABET, k=rng.randint(8, 20))) + " the words that all items end with here" for _ in range(60)]
    docs = [(1, " and ".join(items)), (2, items[7]), (3, "nothing of it"), (4, " ".join(reversed(items)))] + [(10 + i, items[3] + f" tail {i}") for i in range(30)]
    docs, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    usual = sorted(map(tuple, decontaminate.contaminated(docs, benchmark).collect()))
    assert {r[1] for r in usual if r[0] == 1} == {r[1] for r in usual if r[0] == 4} == set(range(60)) and (2, 7) in {r[:2] for r in usual} and 3 not in {r[0] for r in usual}
    for module, name, value in ((_common, "BROADCAST_BYTES", 0), (_common, "HOT_SHARE", 10), (decontaminate, "SEED_ITEMS", 4), (decontaminate, "PART_OCTETS", 200)):
        monkeypatch.setattr(module, name, value)
    assert sorted(map(tuple, decontaminate.contaminated(docs, benchmark).collect())) == usual


def test_short_and_repeated_items(spark):
    docs = spark.createDataFrame([(1, "What is the answer, then?"), (2, "the answer is what"), (None, "THE ANSWER"), (None, "no such thing"), (4, None), (5, "... !")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the answer"), (2, "The Answer!"), (2, "the answer"), (3, "thing"), (4, ""), (5, None), (6, "?!"), (7, "is the answer then what")], "item_id long, text string")
    found = sorted((str(r.doc_id), r.item_id, r.covered) for r in decontaminate.contaminated(docs, bench).collect())
    expected = [(d, i, 2) for d in ("1", "2", "None") for i in (1, 2, 2)] + [("None", 3, 1)]
    assert found == sorted(expected)
    kept = decontaminate.decontaminated(docs, bench).collect()
    assert sorted(str(r.text) for r in kept) == ["... !", "None"]


def test_a_full_filter_and_a_shuffled_lookup_make_no_difference(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"before it goes {' '.join(f'b{i % 3}x{k}' for k in range(20))} and after") for i in range(9)], "doc_id long, text string")
    bench = spark.createDataFrame([(j, " ".join(f"b{j}x{k}" for k in range(20))) for j in range(3)] + [(9, "too short"), (10, None)], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 16)
    monkeypatch.setattr(decontaminate, "_passes", lambda grams, packed, bits: np.arange(len(grams)))
    monkeypatch.setattr(_common, "BROADCAST_BYTES", 0)
    assert whole == sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) and len(whole) == 9 and all(r[-1] == 1.0 for r in whole)
    assert decontaminate.decontaminated(docs, bench).count() == 0


def test_edges(spark, edges, clashing, nothing, edge_rows):
    assert simhash_dedup.near_duplicates(edges).count() == len(edge_rows)
    assert simhash_dedup.near_duplicates(nothing).count() == 0
    kept = simhash_dedup.deduplicated(clashing)
    assert kept.columns == clashing.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 1 in ids and 2 not in ids and 3 in ids and 4 not in ids and 5 not in ids and 6 in ids
    assert substring_dedup.without_repeats(clashing).count() == len(edge_rows)
    assert substring_dedup.without_repeats(nothing).count() == 0
    bench = spark.createDataFrame([(1, edge_rows[0][1]), (2, None), (3, "")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.contaminated(clashing, bench).collect()) == [1, 1, 2]
    assert decontaminate.contaminated(nothing, bench).count() == 0
    assert decontaminate.contaminated(edges, bench.limit(0)).count() == 0
    assert decontaminate.decontaminated(clashing, bench).count() == len(edge_rows) - 3


def test_one_document_of_each_group_of_near_copies_stays(spark):
    rng = random.Random(3)
    text = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(100)) for _ in range(8)]
    changed = lambda t, *at: " ".join("other" if k in at else w for k, w in enumerate(t.split()))
    rows = [(10, text[0]), (11, changed(text[0], 50)), (12, changed(text[0], 10, 90))]  # 91 and 86 of 96 shingles: one group
    rows += [(13, changed(text[0], 20, 40, 60, 80))]  # 76 of 96: another document
    rows += [(None, text[1]), (None, text[1]), (None, text[2]), (14, changed(text[2], 5))]
    rows += [(3, text[3]), (5, text[4]), (5, text[3]), (5, text[5]), (6, text[4])]  # doc_id 5: a copy of 3, the first of 6, one of its own
    kept = simhash_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    expected = [rows[0], rows[3], (None, text[1]), rows[7], (3, text[3]), (5, text[4]), (5, text[5])]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(expected, key=str)


def test_native_sets_link_like_those_of_arrow(spark):
    rows = [(1, "a b c d e f g h i j"), (2, "A  b c d e f g h i"), (3, "x y"), (4, "x  Y"), (5, ""), (6, " "), (7, "a b c d e f g z z z")]
    df = spark.createDataFrame(rows, "th long, text string")
    pairs = df.select("th").crossJoin(df.select(F.col("th").alias("other"))).filter("th < other")
    for sets in (near_copies.native_sets(df), near_copies.shingle_sets(df)):
        assert sorted(map(tuple, near_copies.links(pairs, sets).collect())) == [(1, 2), (3, 4), (5, 6)]


def _shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))}


def _groups_of(texts):
    """The least index in each text's group, from all pairs."""
    sets, root = [_shingles(t) for t in texts], list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def _families(n):
    """Pairs of near copies whose passage in common with all the others makes most of their MinHash keys those of all, and
    between whose lengths there are many others; no two families are near copies."""
    passage = " ".join(f"all{k}" for k in range(84))
    first = [f"{passage} {' '.join(f'f{i}x{k}' for k in range(13))}" for i in range(n)]
    return first + [f"{t} {' '.join(f'g{i}x{k}' for k in range(20))}" for i, t in enumerate(first)]


def test_no_near_copy_is_lost_in_a_key_of_many_texts(spark):
    texts = _families(100)
    assert _groups_of(texts) == [*range(100), *range(100)]
    kept = simhash_dedup.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(100))


def test_no_near_copy_of_a_text_with_an_entity_is_lost(spark):
    texts = _families(60)
    df = spark.createDataFrame([(i, f"{t} u{i}@corp.example") for i, t in enumerate(texts)], "doc_id long, text string")
    origins = {}
    for r in pii._with_entities(df).collect():
        origins.setdefault(r.origin, set()).add(re.search(r"f(\d+)x", r.blank)[1])
    assert len(origins) == 60 and all(len(x) == 1 for x in origins.values())


@pytest.mark.parametrize("quick", [True, False])
def test_groups_of_near_copies_are_those_of_all_pairs(spark, monkeypatch, quick):
    rng = random.Random(11)
    texts = ["", " ", "one two", "One  two", "one two three four five", "one two three four five six"]
    for family in range(12):
        words = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(4, 70))]
        for _ in range(rng.randrange(1, 14)):
            if rng.random() < 0.7:
                words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(words[rng.randrange(3) :] + [f"x{k}" for k in range(rng.randrange(4))]))
    texts = list(dict.fromkeys(texts))
    monkeypatch.setattr(near_copies, "PART_ROWS", 3)
    if not quick:
        monkeypatch.setattr(near_copies, "candidates", lambda texts: texts.select("th", F.col("th").alias("other")).limit(0))
        monkeypatch.setattr(_common, "BROADCAST_BYTES", 0)
    df = spark.createDataFrame(list(enumerate(texts)), "th long, text string")
    expected = _groups_of(texts)
    assert 20 < len(set(expected)) < len(texts) - 20
    sets = near_copies.native_sets(df)
    for parts, of in ((near_copies.native_parts(sets), sets), (near_copies.signed(df.withColumn("doc_id", F.col("th"))), near_copies.shingle_sets(df))):
        found = dict(map(tuple, near_copies.groups(parts, lambda nodes, of=of: of.join(nodes, "th", "left_semi")).collect()))
        assert [found.get(i, i) for i in range(len(texts))] == expected
