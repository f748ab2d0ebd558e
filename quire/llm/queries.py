"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontamination, license_scan, line_dedup, ngram_join, packing, quality_classifier, quality_rules, secret_scan, substring_dedup, warc
from quire.llm.common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": lambda s, d: license_scan.query(table(s, d, "documents")),
        "op2_quality_rules": lambda s, d: quality_rules.query(table(s, d, "documents")),
        "op3_secret_scan": lambda s, d: secret_scan.query(table(s, d, "documents")),
        "op4_substring_dedup": lambda s, d: substring_dedup.query(table(s, d, "documents")),
        "op5_ngram_join": lambda s, d: ngram_join.query(table(s, d, "documents")),
        "op6_quality_classifier": lambda s, d: quality_classifier.query(table(s, d, "documents"), table(s, d, "labels")),
        "op7_packing": lambda s, d: packing.query(table(s, d, "documents")),
        "op8_decontamination": lambda s, d: decontamination.query(table(s, d, "documents"), table(s, d, "benchmark")),
        "op9_line_dedup": lambda s, d: line_dedup.query(table(s, d, "documents")),
        "op10_warc": lambda s, d: warc.query(table(s, d, "pages")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality_rules.SQL, "op3_secret_scan": secret_scan.SQL, "op5_ngram_join": ngram_join.SQL, "op10_warc": warc.SQL}
