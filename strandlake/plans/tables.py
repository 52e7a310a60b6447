"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters as bases, in turn.
LETTERS, AS_BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna(text: Column) -> Column:
    """Letters a to z of a text as bases; all else goes."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), LETTERS, AS_BASES)


def dna_sql(text: str) -> str:
    return f"translate(regexp_replace(lower({text}), '[^a-z]', '', 'g'), '{LETTERS}', '{AS_BASES}')"


def kmers_sql(source: str, columns: str, text: str, k: int) -> str:
    """SELECT of ``columns`` and every k-mer of ``text`` as kmer."""
    return f"SELECT {columns}, substr({text}, CAST(i AS INT), {k}) AS kmer FROM {source}, unnest(range(1, greatest(length({text}) - {k - 1}, 0) + 1)) AS r(i)"


def revcomp_sql(s: str) -> str:
    return f"reverse(translate({s}, 'ACGTacgt', 'TGCAtgca'))"
