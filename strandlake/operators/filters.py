"""Filters of reads, positions and records."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlake.functions import sequences as sq
from strandlake.functions.expressions import draw
from strandlake.operators.kmer_table import counter

#: K-mers of a set that goes to every worker at most, about 12 bytes and four a sign each.
KMERS = 1_000_000


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer partitions than there are; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def kmer_set(df: DataFrame, text: str, k: int, canonical: bool = False) -> DataFrame:
    """Distinct k-mers of a column."""
    kmer = F.explode(sq.kmers(F.col(text), k))
    rows = df.select(kmer.alias("kmer"))
    return rows.select(sq.canonical(F.col("kmer")).alias("kmer")).distinct() if canonical else rows.distinct()


def in_set(rows: DataFrame, known: DataFrame, out: str) -> DataFrame:
    """``rows`` with ``out``: 1 where their kmer is in the set."""
    return rows.join(known.select("kmer").distinct().withColumn(out, F.lit(1)), "kmer", "left")


def _n_kmers(text: Column, k: int) -> Column:
    return F.coalesce(F.greatest(F.length(text) - (k - 1), F.lit(0)), F.lit(0)).cast("long")


def kmer_fractions(reads: DataFrame, by: list[str], text: str, known: DataFrame, k: int, empty: float = 0.0, most: int = KMERS) -> DataFrame:
    """(by, n_kmers, n_hits, fraction): share of each read's k-mers that are in a set; ``empty`` where it has none.

    Null and short texts have no k-mers; rows that repeat ``by`` count
    together; an empty table gives no rows. A set of at most ``most`` k-mers is
    looked up where the read is, and a read's counts alone are shuffled; the
    k-mers of reads meet a larger set in a join.
    """
    hits = counter(known, k, most)
    if hits is not None:
        rows = reads.select(*by, _n_kmers(F.col(text), k).alias("n"), hits(F.col(text)).alias("h"))
        n, h = F.sum("n"), F.sum("h")
    else:
        rows = in_set(reads.select(*by, F.explode_outer(sq.kmers(F.col(text), k)).alias("kmer")), known, "_hit")
        n, h = F.count("kmer"), F.count("_hit")
    return rows.groupBy(*by).agg(n.alias("n_kmers"), h.alias("n_hits"), F.when(n > 0, h / n).otherwise(F.lit(empty)).alias("fraction"))


def _sides(rows: DataFrame, sides: dict[str, Column], sets: dict[str, tuple[DataFrame, bool]], k: int, most: int) -> DataFrame:
    """(read_id, n_x, s_x ...): k-mers of each side x of a read and how many of them each set s has, by reads' ids."""
    found = {s: counter(known, k, most, both) for s, (known, both) in sets.items()}
    if all(f is not None for f in found.values()):
        parts = rows.select("read_id", *[_n_kmers(c, k).alias(f"n_{x}") for x, c in sides.items()], *[f(c).alias(f"{s}_{x}") for s, f in found.items() for x, c in sides.items()])
        return parts.groupBy("read_id").agg(*[F.sum(c).alias(c) for c in parts.columns[1:]])
    each = F.array(*[F.struct(F.lit(x).alias("side"), c.alias("seq")) for x, c in sides.items()])
    kmers = rows.select("read_id", F.explode(each).alias("s")).select("read_id", "s.side", F.explode_outer(sq.kmers(F.col("s.seq"), k)).alias("raw"))
    for s, (known, both) in sets.items():
        kmers = in_set(kmers.withColumn("kmer", sq.canonical(F.col("raw")) if both else F.col("raw")), known, f"_{s}").drop("kmer")
    of = lambda x, c: F.count(F.when(F.col("side") == x, F.col(c)))
    return kmers.groupBy("read_id").agg(*[of(x, "raw").alias(f"n_{x}") for x in sides], *[of(x, f"_{s}").alias(f"{s}_{x}") for s in sets for x in sides])


def positive_filter(pairs: DataFrame, known: DataFrame, k: int = 25, threshold: float = 0.3, any_mate: bool = False, unique: DataFrame | None = None, least_unique: int = 10, most: int = KMERS) -> DataFrame:
    """(read_id, f1, f2, r1, r2, passed) for pairs (read_id, seq1, seq2).

    Fractions of k-mers in the set for both strands: forward takes the first
    mate and the second one's reverse complement, reverse the other way. A pair
    passes if both mates of one strand reach the threshold, or any mate where
    ``any_mate``; or if it has ``least_unique`` k-mers of ``unique`` on a strand.
    An empty or null mate has a fraction of 0; rows that repeat a read_id count
    together. Sets as for ``kmer_fractions``.
    """
    a, b = F.col("seq1"), F.col("seq2")
    sets = {"hit": (known, False)} | ({"own": (unique, False)} if unique is not None else {})
    sums = _sides(pairs, {"f1": a, "f2": sq.revcomp(b), "r1": sq.revcomp(a), "r2": b}, sets, k, most)
    out = sums.withColumns({x: F.coalesce(F.try_divide(f"hit_{x}", f"n_{x}"), F.lit(0.0)) for x in ("f1", "f2", "r1", "r2")})
    t = F.lit(threshold)
    passed = (F.greatest("f1", "f2", "r1", "r2") >= t) if any_mate else ((F.col("f1") >= t) & (F.col("f2") >= t)) | ((F.col("r1") >= t) & (F.col("r2") >= t))
    if unique is not None:
        passed = passed | (F.col("own_f1") + F.col("own_f2") >= least_unique) | (F.col("own_r1") + F.col("own_r2") >= least_unique)
    return out.select("read_id", "f1", "f2", "r1", "r2", passed.alias("passed"))


def negative_filter(reads: DataFrame, background: DataFrame, k: int = 25, threshold: float = 0.45, rescue: DataFrame | None = None, most: int = KMERS) -> DataFrame:
    """(read_id, n1, n2, passed) for reads (read_id, mate, seq): at least one mate has no more than ``threshold`` of its canonical k-mers in the background.

    A mate that is missing or has no k-mers counts as wholly background.
    ``rescue``: reads with one of these k-mers pass as well. Sets as for ``kmer_fractions``.
    """
    of = lambda m: F.when(F.col("mate") == m, F.col("seq"))
    other = F.when(~F.col("mate").isin(1, 2), F.col("seq"))
    sets = {"hit": (background, True)} | ({"own": (rescue, True)} if rescue is not None else {})
    sums = _sides(reads, {"1": of(1), "2": of(2), "3": other}, sets, k, most)
    out = sums.withColumns({f"n{m}": F.coalesce(F.try_divide(f"hit_{m}", f"n_{m}"), F.lit(1.0)) for m in (1, 2)})
    passed = (F.col("n1") <= threshold) | (F.col("n2") <= threshold)
    if rescue is not None:
        passed = passed | (F.col("own_1") + F.col("own_2") + F.col("own_3") >= 1)
    return out.select("read_id", "n1", "n2", passed.alias("passed"))


def without_minor_alleles(counts: DataFrame, position: list[str], n: str = "n", least: int = 100, share: float = 0.2) -> DataFrame:
    """Alleles' counts, less those under ``share`` where the coverage is at least ``least``."""
    total = F.sum(n).over(W.partitionBy(*position))
    return counts.withColumn("coverage", total).where((F.col("coverage") < least) | (F.col(n) >= share * F.col("coverage")))


def sane_pairs(pairs: DataFrame, mean: Column, sd: Column) -> DataFrame:
    """Pairs (strand1, strand2, start1, end1, start2, end2) on opposite strands, in order, whose gap is within five deviations of its mean."""
    forward_first = F.col("strand1") == "+"
    gap = F.when(forward_first, F.col("start2") - F.col("end1")).otherwise(F.col("start1") - F.col("end2"))
    return pairs.withColumn("distance", gap).where((F.col("strand1") != F.col("strand2")) & (F.abs(gap - mean) <= 5 * sd) & (gap > -(F.col("end1") - F.col("start1"))))


def primary_records(records: DataFrame, mapped: bool = True) -> DataFrame:
    """Alignment records that are primary, and mapped or not, by their flag's bits."""
    flag = F.col("flag")
    primary = (flag.bitwiseAND(256) == 0) & (flag.bitwiseAND(2048) == 0)
    return records.where(primary & ((flag.bitwiseAND(4) == 0) if mapped else (flag.bitwiseAND(4) != 0)))


def every_nth(df: DataFrame, order: list[str], n: int, by: list[str]) -> DataFrame:
    """Every n-th row of each group in order, the first one included."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where((F.col("_k") - 1) % n == 0).drop("_k")


def downsample(df: DataFrame, key: str, share: float) -> DataFrame:
    """Rows whose key hashes below ``share``: all rows of a key stay or go together, on every run."""
    return df.where(draw(F.col(key)) < int(share * 1_000_000))


def capped_starts(records: DataFrame, key: str, start: list[str], most: int) -> DataFrame:
    """Records of at most about ``most`` keys for each place where records start.

    A key is drawn where it first starts, and all its records stay or go with
    that; places with no more keys than that keep them all. Records without a
    place (pos 0) stay.
    """
    first = records.groupBy(key).agg(F.min(F.struct(*start)).alias("_at"))
    rate = F.lit(most) / F.count("*").over(W.partitionBy("_at"))
    kept = first.withColumn("_rate", rate).where((F.col("_at.pos") == 0) | (F.col("_rate") >= 1) | (draw(F.col(key)) <= F.col("_rate") * 1_000_000))
    return records.join(kept.select(key), key, "left_semi")


def extractable_contigs(stats: DataFrame, k: int, least_in: float = 0.8, least_length: int = 50, least_unique: float = 0.5, most_elsewhere: float = 0.3) -> DataFrame:
    """(contig_id, first_pos, last_pos) of contigs mostly in the region whose stretch between unique k-mers is long, mostly unique and seldom elsewhere; tests are left out."""
    good = (F.col("in_set") > least_in) & (F.col("stretch_length") > least_length) & (F.col("stretch_unique") > least_unique) & (F.col("stretch_elsewhere") <= most_elsewhere)
    return stats.where(good & ~F.col("contig_id").startswith("TEST")).select("contig_id", F.col("first_unique").alias("first_pos"), (F.col("last_unique") + k - 1).alias("last_pos"))


def masked(reference: DataFrame, intervals: DataFrame, fill: str = "N") -> DataFrame:
    """Sequences (chrom, seq) with all places of closed intervals (chrom, start, end), from 1, replaced; intervals may overlap or reach beyond the end.

    Intervals of a chromosome are merged first and its string is cut once, so
    the work is linear in its length.
    """
    w = W.partitionBy("chrom").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    parts = intervals.where("start <= end").withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy("chrom", "_run").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    lists = parts.groupBy("chrom").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("_m"))
    n = F.length("seq")
    last = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("_m", i - 1)["b"])
    a, b = (lambda m: F.greatest(m["a"], F.lit(1))), (lambda m: F.least(m["b"], n))
    piece = lambda m, i: F.concat(F.substr("seq", last(i) + 1, F.greatest(a(m) - last(i) - 1, F.lit(0))), F.repeat(F.lit(fill), F.greatest(b(m) - a(m) + 1, F.lit(0)).cast("int")))
    tail = F.substr("seq", F.get("_m", F.size("_m") - 1)["b"] + 1, n)
    return reference.join(lists, "chrom", "left").select("chrom", F.when(F.col("_m").isNull(), F.col("seq")).otherwise(F.concat(F.array_join(F.transform("_m", piece), ""), tail)).alias("seq"))


def call_or_nothing(quality: Column, covered: Column, least_quality: float, least_covered: float, call: Column, nothing: str = "??:??") -> Column:
    return F.when((quality < least_quality) | (covered < least_covered), F.lit(nothing)).otherwise(call)


def in_every(df: DataFrame, item: str, part: str) -> DataFrame:
    """Items that occur in every part."""
    parts = df.agg(F.countDistinct(part).alias("_all"))  # one row
    return df.groupBy(item).agg(F.countDistinct(part).alias("_n")).join(F.broadcast(parts)).where("_n = _all").select(item)


def useful_kmers(stats: DataFrame, repeats: DataFrame, most_observed: int) -> DataFrame:
    """K-mers (kmer, n_levels, max_copies, observed, p_within): on one level, no repeat, likely within two copies of their most, and observed less than the table has."""
    kept = stats.where((F.col("n_levels") == 1) & (F.col("p_within") >= 0.5) & (F.col("observed") < most_observed))
    return kept.join(repeats.select("kmer"), "kmer", "left_anti")


def greedy_windows(records: DataFrame, by: str = "chrom") -> DataFrame:
    """Records (pos, ref, ...) that do not overlap the span of the last one kept, in order of pos, ref and the other columns.

    A record beyond all before it is kept whatever those were, so each run of
    records that reach into one another is dealt out on its own, and the state
    runs along it.
    """
    import pandas as pd

    more = [c for c in records.columns if c not in (by, "pos", "ref")]
    w = W.partitionBy(by).orderBy("pos", "ref", *more)
    reach = F.max(F.col("pos") + F.length("ref") - 1).over(w.rowsBetween(W.unboundedPreceding, -1))
    runs = records.withColumn("_new", F.when(reach.isNull() | (F.col("pos") > reach), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")

    def keep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, end = None, -1
        for part in parts:
            rows = []
            for k, (name, run, pos, ref) in enumerate(zip(part[by], part["_run"], part["pos"], part["ref"], strict=True)):
                if (name, run) != at or pos > end:
                    rows.append(k)
                    at, end = (name, run), pos + len(ref) - 1
            yield part.iloc[rows].drop(columns="_run")

    sorted_ = runs.repartition(by, "_run").sortWithinPartitions(by, "_run", "pos", "ref", *more)
    return sorted_.mapInPandas(keep, records.schema)
