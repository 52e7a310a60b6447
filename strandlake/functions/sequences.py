"""Sequences, k-mers and alleles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions.expressions import chars, let, upto

# Complements, gap signs, and the codes of two bits.
BASES, COMPLEMENTS = "ACGTacgt", "TGCAtgca"
GAPS = "_-"
CODES = "0123"


def kmers(s: Column, k: int) -> Column:
    """All windows of ``k`` characters; a shorter string has none."""
    return let(chars(s), lambda c: F.transform(upto(F.size(c) - (k - 1), 1), lambda i: F.array_join(F.slice(c, i, k), "")))


def kmers_over_gaps(s: Column, k: int, gap: str = "_") -> Column:
    """For each place the k-mer that begins there and skips gaps; empty at a gap or where too few characters follow."""

    def one(c: Column, i: Column) -> Column:
        rest = F.filter(F.slice(c, i + 1, F.size(c)), lambda x: x != gap)
        return F.when((F.get(c, i) == gap) | (F.size(rest) < k), F.lit("")).otherwise(F.array_join(F.slice(rest, 1, k), ""))

    return let(chars(s), lambda c: F.transform(upto(F.size(c)), lambda i: one(c, i)))


def revcomp(s: Column) -> Column:
    """Reverse complement; other characters than bases stay."""
    return F.reverse(F.translate(s, BASES, COMPLEMENTS))


def canonical(s: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(s, revcomp(s))


def pack_kmer(s: Column) -> Column:
    """Two bits a base as a number, for up to 31 bases."""
    return F.conv(F.translate(s, BASES[:4], CODES), 4, 10).cast("long")


def unpack_kmer(n: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(n.cast("string"), 10, 4), k, "0"), CODES, BASES[:4])


def is_valid_kmer(s: Column) -> Column:
    """Whether all characters are A, C, G or T."""
    return s.rlike("^[ACGT]+$")


def first_valid(s: Column, k: int) -> Column:
    """Place, from 1, of the first ``k`` valid characters in a row; 0 if there are none."""
    return F.regexp_instr(s, F.lit(f"[ACGT]{{{k}}}"))


def split_string(s: Column, delimiter: str) -> Column:
    """Fields between a delimiter of one or more signs, taken literally; an empty delimiter gives the signs, and an empty last field stays."""
    return chars(s) if not delimiter else F.split(s, "\\Q" + delimiter + "\\E", -1)


def split_sign(s: Column, delimiter: str) -> Column:
    """Fields between one sign; an empty last field goes, and an empty text has none."""
    parts = F.split(s, "\\Q" + delimiter + "\\E", -1)
    return F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def bit(n: Column, place: Column) -> Column:
    """The bit of a number at a place, from 0."""
    return F.call_function("getbit", n, place)


def complement(c: Column) -> Column:
    return F.translate(c, BASES, COMPLEMENTS)


def remove_gaps(s: Column) -> Column:
    return F.translate(s, GAPS, "")


def phred_to_pcorrect(c: Column) -> Column:
    """Probability that a base is right, from its quality character (Phred + 33)."""
    return 1 - F.pow(F.lit(10.0), -(F.ascii(c) - 33) / F.lit(10.0))


def pcorrect_to_phred(p: Column) -> Column:
    """Quality character of a probability, at most code 255."""
    q = F.when(p >= 1, F.lit(255)).otherwise(F.least(F.lit(255), F.round(-10 * F.log10(1 - p)).cast("int") + 33))
    return F.char(q)


def chromosome(c: Column) -> Column:
    """Name without a leading chr, so that 6 and chr6 are the same."""
    return F.regexp_replace(c, "^chr", "")


def map_string(m: Column) -> Column:
    """k:v pairs joined by commas, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")


def hamming(a: Column, b: Column, unknown: str = "*") -> Column:
    """Places at which two equally long strings differ, places with an unknown sign left out."""
    pairs = F.zip_with(chars(a), chars(b), lambda x, y: F.when((x != unknown) & (y != unknown) & (x != y), 1).otherwise(0))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(1)))


def list_distance(a: Column, b: Column) -> Column:
    """Places at which two lists differ; the difference of their lengths counts as well."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


def _columns(g: Column, s: Column, gap: str) -> Column:
    """Columns of an alignment but those with a gap on both sides, true where the sides agree."""
    both = F.zip_with(chars(g), chars(s), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.transform(F.filter(both, lambda c: ~((c["x"] == gap) & (c["y"] == gap))), lambda c: c["x"] == c["y"])


def fraction_ok(g: Column, s: Column, gap: str = "_") -> Column:
    """Share of an alignment's columns that agree; columns of two gaps do not count."""
    return let(_columns(g, s, gap), lambda c: F.try_divide(F.size(F.filter(c, lambda x: x)).cast("double"), F.size(c).cast("double")))


def weighted_ok(g: Column, s: Column, quality: Column, gap: str = "_") -> Column:
    """Share as by ``fraction_ok``, each read base weighing its probability to be right; a gap in the read weighs one."""
    rank = lambda c, i: F.size(F.filter(F.slice(c, 1, i + 1), lambda x: x != gap))

    def weigh(gs: Column, ss: Column) -> Column:
        weight = lambda i: F.when(F.get(ss, i) == gap, F.lit(1.0)).otherwise(phred_to_pcorrect(F.substr(quality, rank(ss, i), F.lit(1))))
        rows = F.transform(upto(F.size(gs)), lambda i: F.struct(((F.get(gs, i) != gap) | (F.get(ss, i) != gap)).alias("use"), (F.get(gs, i) == F.get(ss, i)).alias("ok"), weight(i).alias("w")))
        return let(F.filter(rows, lambda r: r["use"]), lambda r: F.try_divide(_sum(F.transform(F.filter(r, lambda x: x["ok"]), lambda x: x["w"])), _sum(F.transform(r, lambda x: x["w"]))))

    return let(F.struct(chars(g).alias("g"), chars(s).alias("s")), lambda v: weigh(v["g"], v["s"]))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


# The standard genetic code, bases in the order T, C, A, G.
CODE_ORDER = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def translate_codons(s: Column) -> Column:
    """Amino acids of a sequence without its gaps, three bases each; X for a codon with other signs, a rest of one or two is left out."""

    def amino(i: Column, c: Column) -> Column:
        at = [F.instr(F.lit(CODE_ORDER), F.get(c, 3 * i + k)) for k in range(3)]
        good = (at[0] > 0) & (at[1] > 0) & (at[2] > 0)
        return F.when(good, F.substr(F.lit(AMINO_ACIDS), (at[0] - 1) * 16 + (at[1] - 1) * 4 + at[2], F.lit(1))).otherwise("X")

    return let(chars(remove_gaps(s)), lambda c: F.array_join(F.transform(upto(F.floor(F.size(c) / 3).cast("int")), lambda i: amino(i, c)), ""))
