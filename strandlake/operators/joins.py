"""Joins: mates, intervals, k-mer counts, origins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import sequences as sq
from strandlake.lineage import stash


def mate_pairs(reads: DataFrame, key: list[str], mate: str, columns: list[str]) -> DataFrame:
    """First and second mates of a key in one row; keys without both are left out."""
    one = lambda k, n: reads.where(F.col(mate) == k).select(*key, *[F.col(c).alias(f"{c}{n}") for c in columns])
    return one(1, 1).join(one(2, 2), key)


def interval_join(a: DataFrame, b: DataFrame, region: str, a_range: tuple[str, str], b_range: tuple[str, str], width: int, inside: bool = False) -> DataFrame:
    """Pairs of closed intervals of a region that overlap, or of which a lies ``inside`` b.

    Both sides go to bins of ``width``, so it is an equi-join that spills and
    splits like any other. A pair is reported by one bin alone, that in which
    the later of its starts lies, so no pass over the pairs is needed.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    (s1, e1), (s2, e2) = a_range, b_range
    x, y = a.withColumn("_bin", bins(s1, e1)), b.withColumn("_bin", bins(s2, e2))
    pairs = x.join(y, [region, "_bin"]).where((F.col(s1) <= F.col(e2)) & (F.col(s2) <= F.col(e1)))
    pairs = pairs.where(F.col("_bin") == F.floor(F.greatest(s1, s2) / width)).drop("_bin")
    return pairs.where((F.col(s2) <= F.col(s1)) & (F.col(e1) <= F.col(e2))) if inside else pairs


def _shift(x: Column, n: Column) -> Column:
    return F.call_function("shiftright", x, n)


def _levels(top: int, above: Column | None = None, own: bool = True) -> Column:
    """Levels from 0 to ``top``; those ``above`` a level, with or without its ``own``."""
    every = F.sequence(F.lit(0), F.lit(top))
    return every if above is None else F.filter(every, lambda n: n >= above if own else n > above)


def _top(rows: DataFrame, first: str, last: str) -> int:
    """Level of the largest block of 2 ** level places that an interval can hold."""
    longest = rows.agg(F.max(F.col(last) - F.col(first) + 1)).first()[0]
    return max(int(longest or 1), 1).bit_length() - 1


def _blocks(rows: DataFrame, first: str, last: str, top: int) -> DataFrame:
    """``rows`` with (_level, _node) for each of the blocks that their closed intervals consist of: two at most for each level, block n of a level being places n to n + 1 times 2 ** level."""
    begin, end = F.col(first).cast("long"), F.col(last).cast("long") + 1
    left, right = (lambda n: -_shift(-begin, n)), (lambda n: _shift(end, n))
    taken = lambda n, at, x: F.when((left(n) < right(n)) & (F.pmod(x, F.lit(2)) == 1), F.struct(n.alias("_level"), at.alias("_node")))
    each = F.flatten(F.transform(_levels(top), lambda n: F.array(taken(n, left(n), left(n)), taken(n, right(n) - 1, right(n)))))
    return rows.withColumn("_block", F.explode(F.filter(each, lambda x: x.isNotNull()))).select(*rows.columns, "_block.*")


def _upwards(rows: DataFrame, at: str, top: int) -> DataFrame:
    """``rows`` with (_level, _node) of all blocks around a place."""
    return rows.withColumn("_level", F.explode(_levels(top))).withColumn("_node", _shift(F.col(at).cast("long"), F.col("_level")))


def interval_totals(a: DataFrame, b: DataFrame, region: str, a_range: tuple[str, str], b_range: tuple[str, str], key: str) -> DataFrame:
    """(region, b_range, n, first_key, overlap): for each different closed interval of b that any of a overlaps, how many do, their smallest ``key``, and how many places they share in all.

    No pair is made, so the work does not grow with the number of pairs. What
    overlaps begins inside, or covers the first place. Intervals are cut into
    blocks of powers of two, a number of them that grows with the logarithm of
    the length, and sums by block are joined to the blocks of b. An interval
    that ends before it begins holds nothing; one without a region is left out.
    """
    (s1, e1), (s2, e2) = a_range, b_range
    node = [region, "_level", "_node"]
    held = a.where((F.col(s1) <= F.col(e1)) & F.col(region).isNotNull()).groupBy(region, s1, e1).agg(F.count("*").alias("_n"), F.min(key).alias("_k"))
    held = stash(held, "held")
    asked = stash(b.where((F.col(s2) <= F.col(e2)) & F.col(region).isNotNull()).select(region, s2, e2).distinct(), "asked")
    top_a, top_b = _top(held, s1, e1), _top(asked, s2, e2)
    cover = stash(_blocks(held, s1, e1, top_a).groupBy(*node).agg(F.sum("_n").alias("_n"), F.min("_k").alias("_k")), "cover")
    wanted = stash(_blocks(asked, s2, e2, top_b), "wanted")
    starts = stash(held.groupBy(region, F.col(s1).alias(s2)).agg(F.sum("_n").alias("_n"), F.min("_k").alias("_k")), "starts")
    begun = _upwards(starts, s2, top_b).groupBy(*node).agg(F.sum("_n").alias("_begun"), F.min("_k").alias("_k"))
    # places shared with a block: those of the blocks inside it, and all of its own for each block around it
    up = cover.where(F.col("_level") <= top_b).select(region, F.col("_level").alias("_l"), F.col("_node").alias("_m"), (F.col("_n") * F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_level"))).alias("_w"))
    up = up.withColumn("_level", F.explode(_levels(top_b, F.col("_l")))).withColumn("_node", _shift(F.col("_m"), F.col("_level") - F.col("_l")))
    inside = up.groupBy(*node).agg(F.sum("_w").alias("_inside"))
    mine = wanted.select(*node).distinct()
    around = mine.select(region, F.col("_level").alias("_l"), F.col("_node").alias("_m"), F.explode(_levels(top_a, F.col("_level"), own=False)).alias("_level")).withColumn("_node", _shift(F.col("_m"), F.col("_level") - F.col("_l")))
    around = around.join(cover, node).groupBy(region, F.col("_l").alias("_level"), F.col("_m").alias("_node")).agg(F.sum("_n").alias("_around"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = mine.join(begun, node, "left").join(inside, node, "left").join(around, node, "left")
    sums = sums.select(*node, zero("_begun").alias("_begun"), "_k", (zero("_inside") + zero("_around") * F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_level"))).alias("_w"))
    whole = wanted.join(stash(sums, "sums"), node).groupBy(region, s2, e2).agg(F.sum("_begun").alias("_begun"), F.min("_k").alias("_k"), F.sum("_w").alias("overlap"))
    at = _upwards(asked.select(region, s2).distinct(), s2, top_a).join(cover, node).groupBy(region, s2).agg(F.sum("_n").alias("_n"), F.min("_k").alias("_least"))
    # those that cover the first place, but for those that begin there and are counted already
    at = at.join(starts.select(region, s2, F.col("_n").alias("_here")), [region, s2], "left").select(region, s2, (F.col("_n") - zero("_here")).alias("_before"), "_least")
    out = whole.join(at, [region, s2], "left").select(region, s2, e2, (F.col("_begun") + zero("_before")).alias("n"), F.least("_k", "_least").alias("first_key"), "overlap")
    return out.where("n > 0")


def interval_inside(a: DataFrame, b: DataFrame, region: str, a_range: tuple[str, str], b_range: tuple[str, str]) -> DataFrame:
    """(region, b_range, n): for each different closed interval of b that any of a lies inside of, how many do, without making the pairs.

    Those that begin in a block of b's places are counted up to b's end, by a
    running sum over the different ends in the block.
    """
    (s1, e1), (s2, e2) = a_range, b_range
    node = [region, "_level", "_node"]
    asked = stash(b.where((F.col(s2) <= F.col(e2)) & F.col(region).isNotNull()).select(region, s2, e2).distinct(), "asked")
    top = _top(asked, s2, e2)
    held = a.where((F.col(s1) <= F.col(e1)) & F.col(region).isNotNull()).groupBy(region, s1, F.col(e1).alias("_end")).agg(F.count("*").alias("_n"))
    begun = _upwards(held, s1, top).groupBy(*node, "_end").agg(F.sum("_n").alias("_n"))
    wanted = stash(_blocks(asked, s2, e2, top), "wanted")
    marks = wanted.select(*node, F.col(e2).alias("_end"), F.lit(0).cast("long").alias("_n"), F.lit(True).alias("_asked")).distinct()
    both = begun.select(*node, "_end", "_n", F.lit(False).alias("_asked")).unionByName(marks)
    up_to = F.sum("_n").over(W.partitionBy(*node).orderBy("_end"))
    counted = both.withColumn("_n", up_to).where("_asked").select(*node, F.col("_end").alias(e2), "_n")
    return wanted.join(counted, [*node, e2]).groupBy(region, s2, e2).agg(F.sum("_n").alias("n")).where("n > 0")


def sample_counts(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """Wanted k-mers with their canonical form's count; 0 where there is none."""
    known = counts.select(F.col("kmer").alias("_key"), "n")
    return wanted.withColumn("_key", sq.canonical(F.col("kmer"))).join(known, "_key", "left").select("kmer", F.coalesce("n", F.lit(0)).alias("n"))


def only_in(base: DataFrame, other: DataFrame) -> DataFrame:
    """K-mers of ``base`` whose canonical form is not among that of ``other``."""
    key = lambda df: df.select(sq.canonical(F.col("kmer")).alias("kmer")).distinct()
    return key(base).join(key(other), "kmer", "left_anti")


def wanted_ids(records: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Records that are wanted, and wanted keys that no record has."""
    return records.join(wanted, key, "left_semi"), wanted.join(records, key, "left_anti")


def better_origin(a: DataFrame, b: DataFrame, key: list[str], score: str, tie: Column) -> DataFrame:
    """(key, origin, score) of the side with the higher score; a key of one side takes it, and ``tie`` (true for a) settles equal scores."""
    x, y = a.select(*key, F.col(score).alias("_x")), b.select(*key, F.col(score).alias("_y"))
    first = F.col("_y").isNull() | (F.col("_x") > F.col("_y")) | ((F.col("_x") == F.col("_y")) & tie)
    return x.join(y, key, "full").select(*key, F.when(F.coalesce(first, F.lit(False)), "a").otherwise("b").alias("origin"), F.greatest("_x", "_y").alias(score))


def shared_kmers(graph: DataFrame, reference: DataFrame) -> DataFrame:
    """(kmer, n_graph, n_reference) for canonical k-mers of the graph with their number in the reference."""
    count = lambda df, n: df.select(sq.canonical(F.col("kmer")).alias("kmer")).groupBy("kmer").agg(F.count("*").alias(n))
    return count(graph, "n_graph").join(count(reference, "n_reference"), "kmer", "left").select("kmer", "n_graph", F.coalesce("n_reference", F.lit(0)).alias("n_reference"))


def counts_by_sample(kmers: DataFrame, counts: DataFrame, samples: list[str]) -> DataFrame:
    """Wanted k-mers with a column of counts for each sample; 0 where a sample has none."""
    wide = counts.groupBy("kmer").pivot("sample", samples).agg(F.sum("n"))
    return kmers.join(wide, "kmer", "left").select("kmer", *[F.coalesce(F.col(f"`{s}`"), F.lit(0)).alias(s) for s in samples])


def seed_hits(reads: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(read_id, forward, reverse, strand): how many k-mers of a read, and of its reverse complement, an index (kmer, level) has; the strand with more, forward at a tie."""
    both = F.array(F.struct(F.lit("forward").alias("strand"), F.col("seq")), F.struct(F.lit("reverse").alias("strand"), sq.revcomp(F.col("seq")).alias("seq")))
    rows = reads.select("read_id", F.explode(both).alias("s")).select("read_id", "s.strand", F.explode(sq.kmers(F.col("s.seq"), k)).alias("kmer"))
    found = rows.join(index.select("kmer").distinct(), "kmer", "left_semi").groupBy("read_id").pivot("strand", ["forward", "reverse"]).count()
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return reads.select("read_id").join(found, "read_id", "left").select("read_id", n("forward").alias("forward"), n("reverse").alias("reverse"), F.when(n("reverse") > n("forward"), "reverse").otherwise("forward").alias("strand"))


def panel_alleles(records: DataFrame, panel: DataFrame, by: list[str]) -> DataFrame:
    """Records (.., allele) with known, whether the panel (.., allele) has the place, and present, whether it has the allele there."""
    places = panel.select(*by).distinct().withColumn("_place", F.lit(True))
    alleles = panel.select(*by, "allele").distinct().withColumn("_allele", F.lit(True))
    out = records.join(places, by, "left").join(alleles, [*by, "allele"], "left")
    return out.withColumn("known", F.coalesce("_place", F.lit(False))).withColumn("present", F.coalesce("_allele", F.lit(False))).drop("_place", "_allele")


def labelled(samples: DataFrame, populations: DataFrame, key: str, label: str, missing: str = "unknown") -> DataFrame:
    """Samples with the label of their population, or that of none."""
    return samples.join(populations.select(key, label), key, "left").withColumn(label, F.coalesce(label, F.lit(missing)))


def kmer_union(parts: list[DataFrame]) -> DataFrame:
    """Canonical k-mers of any of the sets, each once, with how many of them have it."""
    out = None
    for part in parts:
        one = part.select(sq.canonical(F.col("kmer")).alias("kmer")).distinct()
        out = one if out is None else out.unionByName(one)
    return out.groupBy("kmer").agg(F.count("*").alias("n_sets"))


def required_kmers(edges: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Different symbols of a graph's edges but gaps and unknown ones."""
    return edges.where(~F.col(symbol).isin("_", "*") & ~F.col(symbol).contains("*")).select(F.col(symbol).alias("kmer")).distinct()


def unique_alignments(alignments: DataFrame, identity: list[str], order: list) -> DataFrame:
    """One alignment of each identity, the first by ``order``."""
    from strandlake.operators.windows import best_row

    return best_row(alignments, identity, order)
