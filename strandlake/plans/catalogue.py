"""Queries of the engine's operators on the driver's tables, and SQL of the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.plans import graph_queries, model_queries, record_queries, relational_queries, sequence_queries, source_queries

_PARTS = (sequence_queries, relational_queries, model_queries, graph_queries, source_queries, record_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for part in _PARTS for name, f in part.QUERIES.items()}

#: Sums that DuckDB makes 128 bits wide or exact decimals of, by query.
WIDE = {
    "alignment_tallies": ("matches", "mismatches", "novel_gaps", "graph_gaps", "deletions", "both_gaps"),
    "call_rate_accuracy": ("n_called",),
    "column_errors": ("observed",),
    "interval_overlap": ("overlap",),
    "kmer_counts_by_sample": ("s1", "s2"),
    "kmer_level_stats": ("total",),
    "log_length_bins": ("n_unique",),
    "pair_likelihood": ("min_mismatches",),
    "phred_scores": ("code_sum",),
    "read_likelihoods": ("mismatches",),
    "spatial_summary": ("invalid", "ok", "in_reference"),
}
DECIMAL = {"calibration_bins": ("weight",), "column_errors": ("expected",)}


def _typed(name: str, sql: str) -> str:
    """``sql`` with the types that Spark has."""
    casts = [f"CAST({c} AS BIGINT) AS {c}" for c in WIDE.get(name, ())] + [f"CAST({c} AS DOUBLE) AS {c}" for c in DECIMAL.get(name, ())]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql}) AS wide" if casts else sql


ORACLE_SQL: dict[str, str] = {name: _typed(name, sql) for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
