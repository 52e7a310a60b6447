"""Aggregates: counts, quantiles by index, calls, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strandlake.functions import sequences as sq


def kmer_counts(df: DataFrame, text: str, k: int) -> DataFrame:
    """(kmer, n) of canonical k-mers over all rows."""
    return df.select(F.explode(sq.kmers(F.col(text), k)).alias("_k")).groupBy(sq.canonical(F.col("_k")).alias("kmer")).agg(F.count("*").alias("n"))


def pileup(rows: DataFrame, spine: DataFrame, position: list[str], allele: str) -> DataFrame:
    """(position, coverage, alleles): alleles at each place of the spine with their counts, most frequent first; places without any have none."""
    counts = rows.groupBy(*position, allele).agg(F.count("*").alias("n"))
    lists = counts.groupBy(*position).agg(F.sum("n").alias("coverage"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), F.col(allele).alias("allele")))).alias("_l"))
    text = F.array_join(F.transform("_l", lambda x: F.concat_ws(":", x["allele"], (-x["less"]).cast("string"))), ",")
    return spine.join(lists, position, "left").select(*position, F.coalesce("coverage", F.lit(0)).alias("coverage"), F.coalesce(text, F.lit("")).alias("alleles"))


def sequence_clusters(df: DataFrame, by: list[str], sequence: list[str], member: str) -> DataFrame:
    """(by, members, n, cluster): members with the same sequence, clusters numbered from 1 by their smallest member."""
    groups = df.groupBy(*by, *sequence).agg(F.sort_array(F.collect_set(member)).alias("_m"))
    return groups.select(*by, F.array_join(F.transform("_m", lambda x: x.cast("string")), ",").alias("members"), F.size("_m").alias("n"), F.dense_rank().over(W.partitionBy(*by).orderBy(F.col("_m")[0])).alias("cluster"))


def weighted_quantiles(df: DataFrame, by: list[str], value: str, weight: Column, shares: dict[str, float]) -> DataFrame:
    """For each share the first value at which the running weight reaches it; values do not mix."""
    sums = df.groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    total = F.sum("_w").over(W.partitionBy(*by))
    run = sums.withColumn("_c", F.sum("_w").over(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("_t", total)
    return run.groupBy(*by).agg(*[F.min(F.when(F.col("_c") >= s * F.col("_t"), F.col(value))).alias(n) for n, s in shares.items()])


def insert_size(df: DataFrame, by: list[str], distance: str, weight: Column) -> DataFrame:
    """(by, mean, sd) of distances: the weighted median, and the larger of its differences from the 20 and 80 % quantiles."""
    q = weighted_quantiles(df, by, distance, weight, {"p20": 0.2, "p50": 0.5, "p80": 0.8})
    return q.select(*by, "p20", "p50", "p80", F.greatest(F.abs(F.col("p50") - F.col("p20")), F.abs(F.col("p80") - F.col("p50"))).alias("sd"))


def at_index(df: DataFrame, by: list[str], value: str, places: dict[str, str]) -> DataFrame:
    """Values at places of each group's order; a place is SQL over n, the group's size, counted from 0.

    Rows are ranked by a window, so no group is gathered into an array.
    """
    w = W.partitionBy(*by)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), (F.row_number().over(w.orderBy(value)) - 1).alias("_k"), F.count("*").over(w).alias("n"))
    return rows.groupBy(*by).agg(F.max("n").alias("n"), F.avg("_v").alias("mean"), *[F.max(F.when(F.col("_k") == F.expr(f"cast(floor({e}) as int)"), F.col("_v"))).alias(name) for name, e in places.items()])


#: Places of the upper median, of the rounded 10 and 90 % quantiles, and of the first decile.
UPPER_MEDIAN, ROUNDED_10, ROUNDED_90, DECILE = "n / 2", "(n - 1) * 0.1 + 0.5", "(n - 1) * 0.9 + 0.5", "n / 10"


def calibration(df: DataFrame, p: Column, right: Column, weight: Column) -> DataFrame:
    """(bin, n, weight, mean_p, share_right) in ten bins of the probability, 1 in the last."""
    b = F.least(F.floor(p * 10), F.lit(9)).cast("int")
    rows = df.select(b.alias("bin"), p.alias("_p"), F.when(right, 1.0).otherwise(0.0).alias("_r"), weight.cast("double").alias("_w"))
    total = F.sum("_w")
    return rows.groupBy("bin").agg(F.count("*").alias("n"), total.alias("weight"), F.try_divide(F.sum(F.col("_p") * F.col("_w")), total).alias("mean_p"), F.try_divide(F.sum(F.col("_r") * F.col("_w")), total).alias("share_right"))


def call_rate(df: DataFrame, by: list[str], called: Column, right: Column) -> DataFrame:
    n, c = F.count("*"), F.sum(F.when(called, 1).otherwise(0))
    return df.groupBy(*by).agg(n.alias("n"), c.alias("n_called"), (c / n).alias("call_rate"), F.try_divide(F.sum(F.when(called & right, 1).otherwise(0)), c).alias("accuracy"))


def min_mean_max(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Smallest, mean and largest value; the largest is null where there is one value only."""
    return df.groupBy(*by).agg(F.min(value).alias("min_value"), F.avg(value).alias("mean_value"), F.when(F.count(value) > 1, F.max(value)).alias("max_value"))


def kmer_levels(edges: DataFrame) -> DataFrame:
    """(kmer, n_levels, total, n_edges, max_in_edge) of edges (edge_id, level, kmer, n)."""
    return edges.groupBy("kmer").agg(F.countDistinct("level").alias("n_levels"), F.sum("n").alias("total"), F.countDistinct("edge_id").alias("n_edges"), F.max("n").alias("max_in_edge"))


def constellations(sets: DataFrame, key: str, bit: str, n: int) -> DataFrame:
    """(mask, n_keys) for each of the 2**n - 1 combinations of sets: keys in exactly those."""
    masks = sets.groupBy(key).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col(bit))).alias("mask")).groupBy("mask").agg(F.count("*").alias("n_keys"))
    every = sets.sparkSession.range(1, 2**n).select(F.col("id").cast("int").alias("mask"))
    return every.join(masks, "mask", "left").select("mask", F.coalesce("n_keys", F.lit(0)).alias("n_keys"))


def level_statistics(edges: DataFrame, level: str, from_node: str, to_node: str, symbol: str) -> DataFrame:
    return edges.groupBy(level).agg(F.countDistinct(from_node).alias("n_from"), F.countDistinct(to_node).alias("n_to"), F.count("*").alias("n_edges"), F.countDistinct(symbol).alias("n_symbols"))


def level_categories(edges: DataFrame, level: str, symbol: str, gap: str = "_", unknown: str = "*") -> DataFrame:
    """Whether a level has gaps, several first letters, several without gaps, none unknown."""
    first = F.substr(F.col(symbol), F.lit(1), F.lit(1))
    letters = F.countDistinct(F.when(~first.isin(gap, unknown), first))
    flags = edges.groupBy(level).agg(F.bool_or(first == gap).alias("indel"), F.bool_or(first == unknown).alias("has_unknown"), letters.alias("n_letters"))
    snp = F.col("n_letters") > 1
    return flags.select(level, "indel", snp.alias("snp"), (snp & ~F.col("indel") & ~F.col("has_unknown")).alias("clean_snp"), (snp & ~F.col("indel")).alias("snp_no_indel"), ((F.col("n_letters") > 1) & ~F.col("has_unknown")).alias("poly_no_unknown"))


def symbols_by_level(edges: DataFrame, level: str, symbol: str) -> DataFrame:
    """(level, symbols): symbols of a level with their numbers as one string."""
    counts = edges.groupBy(level, symbol).agg(F.count("*").alias("n"))
    return counts.groupBy(level).agg(sq.map_string(F.map_from_entries(F.collect_list(F.struct(symbol, "n")))).alias("symbols"))


def posterior_call(samples: DataFrame, by: list[str], total: Column) -> DataFrame:
    """(by, first, second, quality, filter) from sampled pairs (by, sample, a1, a2).

    First: the allele that most samples hold. Second: its most frequent partner
    in those. Smaller names win ties; quality is the product of both shares.
    """
    has = samples.select(*by, "sample", F.explode(F.array_distinct(F.array("a1", "a2"))).alias("first"))
    n1 = has.groupBy(*by, "first").agg(F.count("*").alias("n1"))
    top = n1.groupBy(*by).agg(F.min(F.struct((-F.col("n1")).alias("less"), F.col("first"))).alias("t")).select(*by, F.col("t.first").alias("first"), (-F.col("t.less")).alias("n1"))
    partner = samples.join(top, by).where((F.col("a1") == F.col("first")) | (F.col("a2") == F.col("first")))
    partner = partner.select(*by, "first", "n1", F.when(F.col("a1") == F.col("first"), F.col("a2")).otherwise(F.col("a1")).alias("second"))
    n2 = partner.groupBy(*by, "first", "n1", "second").agg(F.count("*").alias("n2"))
    best = n2.groupBy(*by, "first", "n1").agg(F.min(F.struct((-F.col("n2")).alias("less"), F.col("second"))).alias("t"))
    quality = (F.col("n1") / total) * (-F.col("t.less") / F.col("n1"))
    return best.select(*by, "first", F.col("t.second").alias("second"), quality.alias("quality"), F.when(quality > 0.7, "PASS").otherwise("FAIL").alias("filter"))


def column_errors(df: DataFrame, by: list[str], wrong: Column, rate: float) -> DataFrame:
    """(by, coverage, expected, observed, statistic): errors of a column against its rate, with the chi-squared statistic of both cells; null where there are not more than expected."""
    out = df.groupBy(*by).agg(F.count("*").alias("coverage"), F.sum(F.when(wrong, 1).otherwise(0)).alias("observed"))
    out = out.withColumn("expected", F.col("coverage") * F.lit(rate))
    d, right = F.pow(F.col("observed") - F.col("expected"), F.lit(2.0)), F.col("coverage") - F.col("expected")
    return out.withColumn("statistic", F.when(F.col("observed") > F.col("expected"), d / F.col("expected") + d / right))


def corrected_counts(counts: DataFrame, own: DataFrame) -> DataFrame:
    """Counts less those that the region itself has."""
    return counts.join(own.select("kmer", F.col("n").alias("_own")), "kmer", "left").select("kmer", (F.col("n") - F.coalesce("_own", F.lit(0))).alias("n"))


def shares(df: DataFrame, by: list[str], within: list[str] | None = None) -> DataFrame:
    counts = df.groupBy(*(within or []), *by).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*(within or []))))


def presence_stretches(rows: DataFrame, by: list[str], order: str, present: Column, unique: Column) -> DataFrame:
    """(by, n, in_set, unique, first_unique, last_unique, stretch): shares of k-mers in a set and unique, and the part of the row between the first and last unique one."""
    one = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), one(present).alias("in_set"), one(unique).alias("unique"), F.min(F.when(unique, F.col(order))).alias("first_unique"), F.max(F.when(unique, F.col(order))).alias("last_unique"))
    return out.withColumn("stretch", F.coalesce((F.col("last_unique") - F.col("first_unique") + 1) / F.col("n"), F.lit(0.0)))


def alignment_tallies(columns: DataFrame, by: list[str], gap: str = "_") -> DataFrame:
    """Matches, mismatches, gaps of either side and of both in alignment columns (g, s, level; level -1 is an insertion)."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g, s = F.col("g"), F.col("s")
    return columns.groupBy(*by).agg(
        n((g == s) & (g != gap)).alias("matches"),
        n((g != s) & (g != gap) & (s != gap)).alias("mismatches"),
        n((g == gap) & (s != gap) & (F.col("level") == -1)).alias("novel_gaps"),
        n((g == gap) & (s != gap) & (F.col("level") != -1)).alias("graph_gaps"),
        n((g != gap) & (s == gap)).alias("deletions"),
        n((g == gap) & (s == gap)).alias("both_gaps"),
    )


def coverage_estimate(total: Column, read_length: Column, k: int, genome: float = 3.2e9) -> Column:
    """Haploid k-mer coverage from the bases sequenced."""
    return total / (2 * F.lit(genome)) * (read_length - k + 1) / read_length


def mean_and_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, mean, median): the median is the upper one of an even number of values."""
    return at_index(df, by, value, {"median": UPPER_MEDIAN})


def graph_coverage(edge_kmers: DataFrame, counts: DataFrame, repeats: DataFrame, otherwise: float) -> DataFrame:
    """(coverage, n_kmers) of a haplotype: half the mean count of the k-mers (level, edge_id, kmer, copies) of levels with one edge, repeats, gaps and unknown ones left out; ``otherwise`` where there are none."""
    single = edge_kmers.groupBy("level").agg(F.countDistinct("edge_id").alias("_n")).where("_n = 1").select("level")
    plain = edge_kmers.join(single, "level", "left_semi").where(~F.col("kmer").isin("_", "*")).join(repeats.select("kmer"), "kmer", "left_anti")
    rows = plain.join(counts.select("kmer", "n"), "kmer", "left")
    total = rows.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n_kmers"), F.sum(F.coalesce("n", F.lit(0))).alias("_s"))
    return total.select(F.when(F.col("n_kmers") > 0, 0.5 * F.col("_s") / F.col("n_kmers")).otherwise(F.lit(otherwise)).alias("coverage"), "n_kmers")


def alignment_summary(pairs: DataFrame) -> DataFrame:
    """One row of pairs (strands_ok, distance, distance_ok, fraction1, fraction2): pairs, those in order, those at a likely distance, its mean and upper median, the mean fraction, pairs with a perfect mate and perfect mates."""
    n = lambda c: F.count(F.when(c, 1))
    perfect = lambda c: F.when(F.col(c) == 1, 1).otherwise(0)
    both = perfect("fraction1") + perfect("fraction2")
    whole = pairs.agg(F.count("*").alias("n_pairs"), n(F.col("strands_ok")).alias("n_ordered"), n(F.col("strands_ok") & F.col("distance_ok")).alias("n_likely"), F.avg((F.col("fraction1") + F.col("fraction2")) / 2).alias("mean_fraction"), n(both > 0).alias("n_one_perfect"), F.sum(both).alias("n_perfect"))
    middle = mean_and_median(pairs.where("strands_ok").withColumn("_all", F.lit(1)), ["_all"], "distance").select(F.col("mean").alias("mean_distance"), F.col("median").alias("median_distance"))
    return whole.join(middle, how="left")  # a row each
