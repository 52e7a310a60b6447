"""Token counts: an exact histogram of encoded lengths answers every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.lineage import stash
from strandlake.llm import text as tx
from strandlake.llm.encode import default_tokenizer, encoder
from strandlake.llm.store import bounded, running_totals


def document_lengths(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every whole text; null and empty texts have 0.

    Every row gives one, repeated ones too; a null doc_id stays null; other
    columns are not read; an empty table gives no rows.
    """
    path = tokenizer or default_tokenizer()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in tx.released(batches):
            for first, n, _ in model.column(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(n)), pa.array(n)], ["doc_id", "n_tokens"])

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame, col: str = "n_tokens") -> DataFrame:
    """Documents and tokens for each length, with suffix sums over the longer ones.

    Returns for each length L that occurs: n_tokens (L), n_docs, docs_longer and
    tokens_longer (of documents longer than L), tokens_up_to (of those up to L),
    truncated_total (ids that remain when every document is cut to L),
    docs_up_to and quantile (share of documents no longer than L). A context
    limit that does not occur has the answers of the next smaller length, but
    for truncated_total, to which the longer documents add the difference.

    Null lengths count as 0; an empty table gives no rows.
    """
    by_length = lengths.select(F.coalesce(F.col(col).cast("long"), F.lit(0)).alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    by_length = stash(by_length.withColumn("_tokens", F.col("n_tokens") * F.col("n_docs")), "lengths")
    after = running_totals(by_length, "n_tokens", "n_docs", "docs_longer", descending=True)
    tokens = running_totals(by_length.select("n_tokens", "_tokens"), "n_tokens", "_tokens", "tokens_longer", descending=True)
    total = by_length.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("_docs"), F.coalesce(F.sum("_tokens"), F.lit(0)).alias("_all"))
    # the totals are one row
    joined = after.join(tokens.select("n_tokens", "tokens_longer"), "n_tokens").join(F.broadcast(total))
    up_to = F.col("_docs") - F.col("docs_longer")
    return joined.select(
        "n_tokens",
        "n_docs",
        "docs_longer",
        "tokens_longer",
        (F.col("_all") - F.col("tokens_longer")).alias("tokens_up_to"),
        (F.col("_all") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_total"),
        up_to.alias("docs_up_to"),
        (up_to / F.col("_docs")).alias("quantile"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(document_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def histogram_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of the documents' stated numbers of characters, which SQL has at hand, in place of tokens."""
    out = length_histogram(spark.read.parquet(f"{sf_dir}/documents.parquet"), "n_chars")
    return out.withColumn("quantile", F.round("quantile", 9))


HISTOGRAM_SQL = """
WITH h AS (SELECT coalesce(n_chars, 0) AS n_tokens, count(*) AS n_docs FROM documents GROUP BY 1),
s AS (SELECT *, coalesce(sum(n_docs) OVER w, 0) AS docs_longer, coalesce(sum(n_docs * n_tokens) OVER w, 0) AS tokens_longer, sum(n_docs) OVER () AS docs, sum(n_docs * n_tokens) OVER () AS total FROM h WINDOW w AS (ORDER BY n_tokens DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT n_tokens, n_docs, CAST(docs_longer AS BIGINT) AS docs_longer, CAST(tokens_longer AS BIGINT) AS tokens_longer, CAST(total - tokens_longer AS BIGINT) AS tokens_up_to, CAST(total - tokens_longer + n_tokens * docs_longer AS BIGINT) AS truncated_total, CAST(docs - docs_longer AS BIGINT) AS docs_up_to, round((docs - docs_longer) / docs, 9) AS quantile FROM s
"""
