"""Names of alleles: fields, resolution, groups and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.expressions import let

# Signs of a missing allele, and prefixes of the loci that have allele names.
MISSING = ("?", "????", "0", "0000", "9999", "0+", "??:??", "NA", "")
PREFIXES = ("HLA", "KIR")


def is_missing(a: Column) -> Column:
    return a.isNull() | a.isin(*MISSING)


def strip_group(a: Column) -> Column:
    """Name without a group's trailing G."""
    return F.regexp_replace(a, "[Gg]$", "")


def fields(a: Column) -> Column:
    """Fields after the locus, e.g. A*01:01 has 01 and 01; null where missing."""
    bare = F.regexp_replace(strip_group(a), r"^.*\*", "")
    colons = F.when(F.instr(bare, ":") > 0, bare).otherwise(F.regexp_replace(bare, r"^(\d\d)(\d\d)", "$1:$2"))
    return F.when(~is_missing(a), F.split(colons, ":"))


def digits(a: Column, n: int) -> Column:
    """Name reduced to n digits (2 a field); null where it has fewer."""
    f = fields(a)
    return F.when(F.size(f) >= n // 2, F.array_join(F.slice(f, 1, n // 2), ":"))


def information(a: Column) -> Column:
    """Digits that a name resolves; 0 for a missing one."""
    return F.when(is_missing(a), F.lit(0)).otherwise(2 * F.size(fields(a)))


def fields_agree(x: Column, y: Column) -> Column:
    """Whether two names' fields agree as far as both go; those of a missing name, which are null, agree with everything."""
    n = F.greatest(F.least(F.size(x), F.size(y)), F.lit(1))
    return x.isNull() | y.isNull() | (F.slice(x, F.lit(1), n) == F.slice(y, F.lit(1), n))


def compatible(a: Column, b: Column) -> Column:
    """Whether two names agree in all fields that both have; a missing one agrees with everything."""
    return let(F.struct(fields(a).alias("x"), fields(b).alias("y")), lambda v: fields_agree(v["x"], v["y"]))


def two_digit(code: Column) -> Column:
    """A four-character code with its last two as 00."""
    return F.concat(F.substr(code, F.lit(1), F.lit(2)), F.lit("00"))


def is_typed_locus(locus: Column) -> Column:
    out = F.lit(False)
    for p in PREFIXES:
        out = out | locus.startswith(p)
    return out


def translate_name(locus: Column, code: Column) -> Column:
    """HLAA and 0101 as A*01:01."""
    return F.concat(F.regexp_replace(locus, "^HLA", ""), F.lit("*"), F.substr(code, F.lit(1), F.lit(2)), F.lit(":"), F.substr(code, F.lit(3), F.lit(2)))


def restrict_to_singletons(df: DataFrame, locus: str, code: str) -> DataFrame:
    """Two-digit codes that no four-digit code of their locus implies, and all four-digit ones."""
    two = F.col(code).endswith("00")
    implied = df.where(~two).select(F.col(locus), two_digit(F.col(code)).alias(code)).distinct()
    return df.where(~two).unionByName(df.where(two).join(implied, [locus, code], "left_anti"))


def group_of(alleles: DataFrame, groups: DataFrame, by: list[str], allele: str = "allele", group: str = "g_group") -> DataFrame:
    """The group that most of a set's alleles are in, the smaller name at a tie, and whether there is exactly one."""
    votes = alleles.join(groups, allele).groupBy(*by, group).agg(F.count("*").alias("n"))
    return votes.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(group).alias("g")))["g"].alias(group), (F.count("*") == 1).alias("perfect"))


def pair_agreement(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Alleles in which two unordered pairs agree: 0, 1 or 2."""
    one = lambda x, y: F.when(x == y, 1).otherwise(0)
    return F.greatest(one(a1, b1) + one(a2, b2), one(a1, b2) + one(a2, b1))


def phase_choice(a: Column, b: Column, x: Column, y: Column, missing: str = "?") -> Column:
    """(flipped, ok, wrong) of the better orientation of two strings against two others: fewer wrong, then more right signs; missing ones do not count."""

    def count(p: Column, q: Column, equal: bool) -> Column:
        pairs = F.zip_with(F.split(p, ""), F.split(q, ""), lambda u, v: F.when((u != missing) & (v != missing) & ((u == v) == F.lit(equal)), 1).otherwise(0))
        return F.aggregate(pairs, F.lit(0), lambda s, v: s + v)

    both = lambda flip, p, q: F.struct((count(a, p, False) + count(b, q, False)).alias("wrong"), (-(count(a, p, True) + count(b, q, True))).alias("less"), F.lit(flip).alias("flipped"))
    best = F.array_min(F.array(both(False, x, y), both(True, y, x)))
    return F.struct(best["flipped"].alias("flipped"), (-best["less"]).alias("ok"), best["wrong"].alias("wrong"))
