"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from erspark.llm import decontaminate, html_text, language_id, license_scan, packing, pii, quality_rules, secret_scan, simhash_dedup, substring_dedup
from erspark.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_language_id": language_id.op2_language_id,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_simhash_dedup": simhash_dedup.op6_simhash_dedup,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_pii": pii.op9_pii,
    "op10_html_text": html_text.op10_html_text,
}
