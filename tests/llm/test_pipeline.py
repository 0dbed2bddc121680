import glob
import importlib.util
import os
import re

import duckdb
import pytest

import corpus_pipeline
from quarrylog.llm import queries, quality_rules

WORDS = "The river runs past the old mill and the people of the village meet there every evening to talk about the day".split()


def _text(i, n=40):
    return " ".join(WORDS[(i * 7 + k * (i % 5 + 1)) % len(WORDS)] + str((i * 31 + k) % 977) for k in range(n)) + "."


def test_stages_by_hand(spark, tmp_path):
    item = " ".join(f"benchmark{k} token" for k in range(15))
    rows = [(i, _text(i), "en", f"s{i % 3}", 1) for i in range(30)]
    rows += [(100, _text(5), "en", "s1", 1), (101, f"{_text(60)} {item} {_text(61)}", "en", "s1", 1), (102, "too short", "en", "s0", 1), (103, f"{_text(70)} mail me@corp.example now.", "en", None, 1)]
    rows += [(104, None, None, None, None), (105, " | ".join(f"nav{k}" for k in range(40)), "en", "s2", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = set(range(30)) | {103}
    assert kept == [clean | {100, 101}, clean | {101}, clean, clean, clean]
    text = spark.read.parquet(str(tmp_path / "pii")).filter("doc_id = 103").first()
    assert "me@corp" not in text.text and "[EMAIL]" in text.text and text.n_chars == len(text.text)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


def test_documents_without_or_with_the_same_id(spark, tmp_path):
    names = "id th text_hash found terms kept lines size score label row key times".split()
    rows = [(None, _text(1), "en", "a", 1), (None, _text(2), "en", None, 1), (None, _text(2), "en", None, 1), (7, _text(3), "en", "a", 1), (7, _text(4), "en", "b", 1), (8, _text(3), "en", "b", 1)]
    rows += [(9, None, "en", "a", 1), (9, "", None, None, None), (10, f"{_text(20)} {' '.join(f'item{k}' for k in range(20))}", "en", "a", 1), (None, f"{_text(21)} {' '.join(f'item{k}' for k in range(20))}", "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"'x' AS {n}" for n in names])
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(f"item{k}" for k in range(20)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted([(None, _text(1)), (None, _text(2)), (7, _text(3)), (7, _text(4))], key=str)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 4


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_thirteen_queries_and_the_pipeline_are_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names
    assert queries.oracle_sql()["op7_quality_rules"] == quality_rules.ORACLE_SQL


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(importlib.util.find_spec("quarrylog").origin)
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"\bllm\b", open(os.path.join(folder, f)).read())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    df = queries.queries()[name](spark, sf)
    assert sorted(names) == sorted(df.columns)
    assert sorted(str([r[c] for c in names]) for r in df.collect()) == sorted(str(list(r)) for r in cursor.fetchall())
