"""Calls against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import nomenclature as nm
from strandlake.functions.expressions import let
from strandlake.operators import aggregates as ag


def compared(calls: DataFrame, truth: DataFrame) -> DataFrame:
    """(individual_id, locus, n_compared, n_right, weight, q) of calls (.., a1, a2, q) against truth (.., t1, t2); missing alleles of either side do not count."""
    j = calls.join(truth, ["individual_id", "locus"])
    names = F.struct(*[nm.fields(F.col(c)).alias(c) for c in ("a1", "a2", "t1", "t2")])

    def judged(v: Column) -> Column:
        known = lambda a, t: v[a].isNotNull() & v[t].isNotNull()
        both = lambda a, t: F.when(known(a, t), 1).otherwise(0)
        hit = lambda a, t: F.when(known(a, t) & nm.fields_agree(v[a], v[t]), 1).otherwise(0)
        way = lambda x, y: F.struct((hit("a1", x) + hit("a2", y)).alias("right"), (both("a1", x) + both("a2", y)).alias("compared"))
        return F.struct(way("t1", "t2").alias("straight"), way("t2", "t1").alias("crossed"), (v["t1"].isNull() != v["t2"].isNull()).alias("one"))

    # names are taken apart once, and the better way round is chosen by alleles that are right
    better = lambda v: F.when(v["crossed"]["right"] > v["straight"]["right"], v["crossed"]).otherwise(v["straight"])
    chosen = let(let(names, judged), lambda v: F.struct(better(v).alias("way"), v["one"].alias("one")))
    rows = j.withColumn("_c", chosen)
    right = F.col("_c.way.right")
    return rows.select("individual_id", "locus", F.col("_c.way.compared").alias("n_compared"), right.alias("n_right"), F.when(F.col("_c.one") & (right == 0), 0.5).otherwise(1.0).alias("weight"), "q")


def type_report(calls: DataFrame, truth: DataFrame, least_quality: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Call rate and accuracy of each locus, and the calibration of the calls' probabilities."""
    rows = compared(calls, truth).where("n_compared > 0")
    by_locus = rows.groupBy("locus").agg(
        F.count("*").alias("n"),
        F.avg(F.when(F.col("q") >= least_quality, 1.0).otherwise(0.0)).alias("call_rate"),
        F.try_divide(F.sum(F.when(F.col("q") >= least_quality, F.col("n_right"))), F.sum(F.when(F.col("q") >= least_quality, F.col("n_compared")))).alias("accuracy"),
    )
    return by_locus, ag.calibration(rows, F.col("q"), F.col("n_right") == F.col("n_compared"), F.col("weight"))


def haplotype_report(calls: DataFrame, truth: DataFrame) -> DataFrame:
    """(individual_id, locus, flipped, ok, wrong) of haplotype strings (.., h1, h2) against (.., t1, t2) in the better phase."""
    j = calls.join(truth, ["individual_id", "locus"])
    c = nm.phase_choice(F.col("h1"), F.col("h2"), F.col("t1"), F.col("t2"))
    return j.select("individual_id", "locus", c.alias("c")).select("individual_id", "locus", "c.*")
