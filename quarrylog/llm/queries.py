"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import periodic_runs, quality_rules, substring_dedup
from .decontaminate import op5_decontaminate
from .html_text import op8_html_text
from .mixing import op6_mixing
from .periodic_runs import op11_periodic_runs
from .pii import op1_pii
from .quality_model import op3_quality
from .quality_rules import op7_quality_rules
from .simhash_dedup import op10_simhash
from .substring_dedup import op9_substring_dedup
from .token_files import op12_token_files
from .toxicity import op2_toxicity
from .url_filter import op4_url_filter
from .whitening import op13_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_url_filter": op4_url_filter,
    "op5_decontaminate": op5_decontaminate,
    "op6_mixing": op6_mixing,
    "op7_quality_rules": op7_quality_rules,
    "op8_html_text": op8_html_text,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_simhash": op10_simhash,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_files": op12_token_files,
    "op13_whitening": op13_whitening,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {**QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_rules": quality_rules.ORACLE_SQL, "op9_substring_dedup": substring_dedup.ORACLE_SQL, "op11_periodic_runs": periodic_runs.ORACLE_SQL}
