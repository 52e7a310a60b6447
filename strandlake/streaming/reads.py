"""Streams of reads (read_id, mate, seq, at), at being the time at which a read came."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import sequences as sq
from strandlake.operators.kmer_table import counter


def paired(reads: DataFrame, within: str = "10 minutes") -> DataFrame:
    """(read_id, seq1, seq2, at) as soon as both mates are there, no matter which comes first.

    A mate that comes more than ``within`` after the other finds it no more, and
    what is older than that is forgotten, so the state does not grow with the
    stream. Mates that come again pair again.
    """
    one = lambda k: reads.where(F.col("mate") == k).select(F.col("read_id").alias(f"_id{k}"), F.col("seq").alias(f"seq{k}"), F.col("at").alias(f"_at{k}")).withWatermark(f"_at{k}", within)
    near = F.col("_at2").between(F.col("_at1") - F.expr(f"INTERVAL {within}"), F.col("_at1") + F.expr(f"INTERVAL {within}"))
    met = one(1).join(one(2), (F.col("_id1") == F.col("_id2")) & near)
    return met.select(F.col("_id1").alias("read_id"), "seq1", "seq2", F.greatest("_at1", "_at2").alias("at"))


def passing(pairs: DataFrame, known: DataFrame, k: int = 25, threshold: float = 0.3, most: int = 1_000_000) -> DataFrame:
    """Pairs (read_id, seq1, seq2, ...) both of whose mates, on one strand, have ``threshold`` of their k-mers in a set (kmer).

    Each pair is judged alone, so the stream keeps no state; the set, whose size
    is checked, is the one at the start. A mate without k-mers has none in it.
    """
    hits = counter(known, k, most)
    if hits is None:
        raise ValueError(f"more than {most} k-mers; join larger sets in batches")

    def share(text):
        n = F.greatest(F.length(text) - (k - 1), F.lit(0))
        return F.coalesce(F.try_divide(hits(text), n), F.lit(0.0))

    a, b = F.col("seq1"), F.col("seq2")
    judged = pairs.withColumns({"_f1": share(a), "_f2": share(sq.revcomp(b)), "_r1": share(sq.revcomp(a)), "_r2": share(b)})
    t = F.lit(threshold)
    return judged.where(((F.col("_f1") >= t) & (F.col("_f2") >= t)) | ((F.col("_r1") >= t) & (F.col("_r2") >= t))).drop("_f1", "_f2", "_r1", "_r2")


def coverage(reads: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, n_reads, n_bases) of each window of time, once no read of it can come any more."""
    rows = reads.withWatermark("at", late).groupBy(F.window("at", window)).agg(F.count("*").alias("n_reads"), F.sum(F.coalesce(F.length("seq"), F.lit(0))).alias("n_bases"))
    return rows.select(F.col("window.start").alias("start"), "n_reads", "n_bases")
