"""Probabilities as column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from strandlake.functions.expressions import upto

# Fixed values of the likelihoods: rates of an inserted and of a deleted base, the cap of a base's probability and what stands for none, and the rate of a k-mer that is not there.
P_INSERTION = P_DELETION = 0.001
P_CAP, P_LEAST = 0.999, 0.001
ABSENT_RATE = 0.01


def logavg(a: Column, b: Column) -> Column:
    """Logarithm of the mean of e**a and e**b."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))) - F.lit(math.log(2))


def logsumexp(values: Column) -> Column:
    """Logarithm of the sum of e**x over an array."""
    top = F.array_max(values)
    return top + F.ln(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def log_factorial(n: Column) -> Column:
    return F.aggregate(F.transform(upto(n, 1), lambda k: F.ln(k)), F.lit(0.0), lambda s, x: s + x)


def log_poisson(n: Column, rate: Column) -> Column:
    """Logarithm of the Poisson probability of n; a rate of 0 counts as ``ABSENT_RATE``."""
    r = F.when(rate <= 0, F.lit(ABSENT_RATE)).otherwise(rate)
    return n * F.ln(r) - r - log_factorial(n)


def poisson(n: Column, rate: Column) -> Column:
    return F.exp(log_poisson(n, rate))


def normal_density(x: Column, mean: Column, sd: Column, floor_at: float = 8.0) -> Column:
    """Normal density, no lower than it is ``floor_at`` deviations away."""
    z = F.least(F.abs(x - mean) / sd, F.lit(floor_at))
    return F.exp(-z * z / 2) / (sd * F.lit(math.sqrt(2 * math.pi)))


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series) -> pd.Series:
    """P-value of a chi-squared statistic with one degree of freedom."""
    return x.map(lambda v: math.erfc(math.sqrt(v / 2)) if v == v and v >= 0 else None).astype("float64")


def softmax(df: DataFrame, by: list[str], log_value: str, out: str) -> DataFrame:
    """Share of e**value within a group, by its largest value; even shares where none is finite."""
    w = W.partitionBy(*by)
    part = F.exp(F.col(log_value) - F.max(log_value).over(w))
    total = F.sum(part).over(w)
    return df.withColumn(out, F.when((total > 0) & ~F.isnan(total), part / total).otherwise(1 / F.count("*").over(w)))


def base_log_likelihood(graph: Column, read: Column, p_correct: Column, gap: str = "_") -> Column:
    """Log-likelihood of one column of an alignment: insertion, deletion, match or mismatch."""
    p = F.least(p_correct, F.lit(P_CAP))
    return (
        F.when((graph == gap) & (read == gap), F.lit(0.0))
        .when(graph == gap, F.lit(math.log(P_INSERTION) + math.log(0.25)))
        .when(read == gap, F.lit(math.log(P_DELETION)))
        .when(graph == read, F.ln(p))
        .otherwise(F.ln((1 - p) / 3))
    )


def _first_sign(allele: Column, genotype: Column, p_correct: Column, gap: str) -> Column:
    """Log-likelihood of a genotype's first sign at an allele's sign that is no gap."""
    p = F.when(p_correct <= 0, F.lit(P_LEAST)).otherwise(F.least(p_correct, F.lit(P_CAP)))
    first = F.substr(genotype, F.lit(1), F.lit(1))
    read = F.lit(math.log(1 - P_INSERTION - P_DELETION)) + F.when(allele == first, F.ln(p)).otherwise(F.ln((1 - p) / 3))
    return F.when(first == gap, F.lit(math.log(P_DELETION))).otherwise(read)


def typing_log_likelihood(allele: Column, genotype: Column, p_correct: Column, gap: str = "_") -> Column:
    """Log-likelihood of a read's genotype, of one or more signs, at one sign of an allele; every inserted sign costs the same."""
    insertion = math.log(P_INSERTION) + math.log(0.25)
    at_gap = F.when(genotype == gap, F.lit(0.0)).otherwise(F.length(genotype) * F.lit(insertion))
    return F.when(allele == gap, at_gap).otherwise(_first_sign(allele, genotype, p_correct, gap) + (F.length(genotype) - 1) * F.lit(insertion))


def position_log_likelihood(allele: Column, genotype: Column, p_correct: Column, gap: str = "_") -> Column:
    """Log-likelihood of a read's genotype at an allele of one or more signs; the length of an insertion is Poisson with mean 1.

    Sign by sign, the allele's last one takes what is left of the genotype, and
    where none is left the read has a gap.
    """
    insertion = F.lit(math.log(P_INSERTION) + math.log(0.25))
    poisson1 = lambda n: -1 - log_factorial(n)

    def at_sign(x: Column, g: Column) -> Column:
        at_gap = F.when(g == gap, F.lit(0.0)).otherwise(insertion + poisson1(F.length(g) - 1))
        more = F.when(F.length(g) > 1, insertion + poisson1(F.length(g) - 2)).otherwise(F.lit(0.0))
        return F.when(x == gap, at_gap).otherwise(_first_sign(x, g, p_correct, gap) + more)

    n = F.length(allele)
    part = lambda i: F.when(i > F.length(genotype), F.lit(gap)).when(i == n, F.substr(genotype, i, F.length(genotype))).otherwise(F.substr(genotype, i, F.lit(1)))
    signs = F.transform(F.sequence(F.lit(1), n), lambda i: at_sign(F.substr(allele, i, F.lit(1)), part(i)))
    return F.aggregate(signs, F.lit(0.0), lambda s, x: s + x)


def copy_number_posterior(df: DataFrame, observed: str, coverage: Column, most: int) -> DataFrame:
    """(observed, copies, posterior): for each distinct count, the share of each copy number from 0 to ``most`` in the sum of their Poisson probabilities."""
    rows = df.select(F.col(observed).cast("int").alias("observed")).distinct().withColumn("copies", F.explode(F.sequence(F.lit(0), F.lit(most))))
    rows = rows.withColumn("_p", poisson(F.col("observed"), F.col("copies") * coverage))
    return rows.select("observed", "copies", (F.col("_p") / F.sum("_p").over(W.partitionBy("observed"))).alias("posterior"))
