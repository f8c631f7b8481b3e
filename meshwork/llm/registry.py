"""The package's queries and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meshwork.llm import chat_format, exact_dedup, filter_audit, html_text, importance, license_scan, packing, quality_rules, simhash, source_mixing, substring_dedup, token_alignment, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": chat_format.op1_chat_format,
        "op2_importance": importance.op2_importance,
        "op3_license_scan": license_scan.op3_license_scan,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_simhash": simhash.op8_simhash,
        "op9_source_mixing": source_mixing.op9_source_mixing,
        "op10_packing": packing.op10_packing,
        "op11_html_text": html_text.op11_html_text,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_token_alignment": token_alignment.op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": chat_format.ORACLE_OP1,
        "op3_license_scan": license_scan.ORACLE_OP3,
        "op5_quality_rules": quality_rules.ORACLE_OP5,
        "op7_exact_dedup": exact_dedup.ORACLE_OP7,
        "op9_source_mixing": source_mixing.ORACLE_OP9,
        "op12_filter_audit": filter_audit.ORACLE_OP12,
    }
