"""A corpus pipeline of five stages over ``documents``.  Each stage takes all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.  All
but the last return the columns of documents; the last returns what the mix takes of each document.

Defined results: null and empty texts fail the quality rules and go; a document without a doc_id stays like any other, and
so do different texts of one doc_id, since stages know documents by their texts; of rows that repeat, the near-duplicate stage
keeps one; columns beside those of documents are kept up to the last stage, whatever their names; empty tables give no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylog.llm import decontaminate, mixing, pii, quality_rules, simhash_dedup
from quarrylog.llm._common import new_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that fail."""
    return quality_rules.cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard similarity of 0.8 or more, no link lost;
    op10's fingerprints are another contract): that of the smallest doc_id."""
    return simhash_dedup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and terms that reveal it, replaced."""
    return pii.sanitised(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): the words that the mix takes of each document."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("mixing", mix),
]

#: SQL cannot express near copies' components, the tiling and the seeded tree; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; what lies between two stages is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
