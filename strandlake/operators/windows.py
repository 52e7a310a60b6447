"""Runs, islands, running sums and choices within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlake.functions.expressions import draw


def islands(points: DataFrame, by: list[str], point: str) -> DataFrame:
    """(by, start, end, n): maximal runs of consecutive distinct integers."""
    rows = points.select(*by, F.col(point).cast("long").alias("_p")).distinct()
    rank = F.row_number().over(W.partitionBy(*by).orderBy("_p"))
    return rows.withColumn("_g", F.col("_p") - rank).groupBy(*by, "_g").agg(F.min("_p").alias("start"), F.max("_p").alias("end"), F.count("*").alias("n")).drop("_g")


def run_number(df: DataFrame, by: list[str], order: list[str], value: Column, out: str = "run") -> DataFrame:
    """Number, from 1, of the run of equal values that a row is in."""
    w = W.partitionBy(*by).orderBy(*order)
    new = F.when(value.eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(out, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def merged_segments(segments: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, first, a1, a2): runs of homozygous segments (a2 null) as one, heterozygous ones as they are."""
    w = W.partitionBy(*by).orderBy(order)
    same = F.col("a2").isNull() & F.lag(F.col("a2").isNull(), 1, False).over(w)
    rows = segments.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "a1"))), lambda x: x["a1"]), "")
    return rows.groupBy(*by, "_run").agg(F.min(order).alias("first"), text.alias("a1"), F.max("a2").alias("a2")).drop("_run")


def best_row(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


def on_change(value: Column, by: list[str], order: list[str]) -> Column:
    """The value where it differs from the one before, else -1."""
    before = F.lag(value).over(W.partitionBy(*by).orderBy(*order))
    return F.when(before.isNull() | (before != value), value).otherwise(F.lit(-1))


def carried_forward(value: Column, by: list[str], order: list[str]) -> Column:
    return F.last(value, ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def running_count(flag: Column, by: list[str], order: list[str]) -> Column:
    return F.sum(F.when(flag, 1).otherwise(0)).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def codon_number(residue: Column, by: list[str], order: list[str]) -> Column:
    """Number, from 0, of the codon that a residue (not a gap) is in; null at a gap."""
    return F.when(residue, F.floor((running_count(residue, by, order) - 1) / 3))


def clipped(segments: DataFrame, by: list[str], order: str, length: Column, start: int, stop: int) -> DataFrame:
    """Segments with from and to, the part of them in [start, stop] of the running length, counted in the segment from 1; others are left out."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = segments.withColumn("_end", F.sum(length).over(w)).withColumn("_begin", F.col("_end") - length + 1).where((F.col("_end") >= start) & (F.col("_begin") <= stop))
    return rows.withColumn("from", F.greatest(F.lit(start), F.col("_begin")) - F.col("_begin") + 1).withColumn("to", F.least(F.lit(stop), F.col("_end")) - F.col("_begin") + 1).drop("_end", "_begin")


def gap_runs(columns: DataFrame, by: list[str], order: str, base: str, other: str, gap: str = "_") -> DataFrame:
    """(by, kind, start, end, n): runs of columns in which the base (an insertion) or the other (a deletion) has a gap and not both."""
    kind = F.when((F.col(base) == gap) & (F.col(other) != gap), "insertion").when((F.col(other) == gap) & (F.col(base) != gap), "deletion")
    rows = run_number(columns.withColumn("kind", kind), by, [order], F.col("kind"), "_run").where(F.col("kind").isNotNull())
    return rows.groupBy(*by, "_run", "kind").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n")).drop("_run")


def top_rows(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group with their rank."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def random_best(df: DataFrame, by: list[str], value: str, key: str, seed: int = 1) -> DataFrame:
    """The row with the highest value of each group; among equal ones a draw by the key, the same on every run."""
    return best_row(df.withColumn("_draw", draw(F.lit(seed), F.col(key))), by, [F.col(value).desc(), "_draw", key]).drop("_draw")
