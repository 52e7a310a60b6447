"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import decontaminate, language, licenses, merkle, near_duplicates, packing, personal, quality, ranked, rules, site_tree, token_counts, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.query,
    "op2_token_counts": token_counts.query,
    "op3_near_duplicates": near_duplicates.query,
    "op4_personal": personal.query,
    "op5_language": language.query,
    "op6_quality_rules": rules.query,
    "op7_decontaminate": decontaminate.query,
    "op8_site_tree": site_tree.query,
    "op9_quality": quality.query,
    "op10_licenses": licenses.query,
    "op11_url_filter": url_filter.query,
    "op12_ranked_search": ranked.query,
    "op13_merkle_manifest": merkle.query,
    # parts of three of them, for which there is SQL
    "length_histogram": token_counts.histogram_query,
    "quality_statistics": rules.statistics_query,
    "url_rules": url_filter.rules_query,
}

ORACLE_SQL: dict[str, str] = {
    "op3_near_duplicates": near_duplicates.ORACLE_SQL,
    "length_histogram": token_counts.HISTOGRAM_SQL,
    "quality_statistics": rules.STATISTICS_SQL,
    "op7_decontaminate": decontaminate.ORACLE_SQL,
    "op10_licenses": licenses.ORACLE_SQL,
    "url_rules": url_filter.RULES_SQL,
    "op12_ranked_search": ranked.ORACLE_SQL,
    "op13_merkle_manifest": merkle.ORACLE_SQL,
}
