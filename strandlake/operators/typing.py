"""Allele typing: from base observations to the best pair of alleles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import nomenclature as nm
from strandlake.functions import probability as pr
from strandlake.functions import sequences as sq
from strandlake.lineage import stash
from strandlake.operators import aggregates as ag
from strandlake.operators import filters as fl

# The exons that type a locus; the gates of a position and of an alignment; how far a pair's distance may be from its mean.
BOTH_EXONS, SECOND_EXON = ("A", "B", "C", "E", "F", "G", "H", "J", "K", "L", "V"), ("DQA1", "DQB1", "DRB1", "DPA1", "DPB1", "DRA", "DRB3", "DRB4")
LEAST_POSITION_QUALITY, LEAST_ALIGNMENT_QUALITY = 0.7, 0.01
#: Places of all clusters that are broadcast at most.
ALLELES = 200_000


def exon_table(spark: SparkSession) -> DataFrame:
    """(locus, exon, exon_ord): the exons that type each locus, in order."""
    rows = [(locus, f"exon_{n}", n - 2) for locus in BOTH_EXONS for n in (2, 3)] + [(locus, "exon_2", 0) for locus in SECOND_EXON]
    return spark.createDataFrame(rows, "locus string, exon string, exon_ord int")


def exon_levels(alleles: DataFrame, levels: DataFrame, exons: DataFrame) -> DataFrame:
    """(locus, allele, exon_ord, exon_pos, pos, level, base): exon files' cells (locus, exon, allele, locus_id, exon_pos, base) at the levels (locus_id, level) of the graph.

    pos runs over the exons of a locus in order; cells of exons that do not
    type their locus, or of places that the graph does not have, are left out.
    Both tables of a region are small, so the planner broadcasts them.
    """
    cells = alleles.join(exons, ["locus", "exon"]).join(levels.select("locus_id", "level"), "locus_id")
    places = cells.select("locus", "exon_ord", "exon_pos").distinct()
    pos = places.withColumn("pos", (F.row_number().over(W.partitionBy("locus").orderBy("exon_ord", "exon_pos")) - 1).cast("int"))
    return cells.join(pos, ["locus", "exon_ord", "exon_pos"]).select("locus", "allele", "exon_ord", "exon_pos", "pos", "level", "base")


def allele_clusters(cells: DataFrame) -> DataFrame:
    """(locus, allele, cluster): alleles with the same bases at all places are one cluster, numbered from 0 by its first allele."""
    whole = cells.groupBy("locus", "allele").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("seq"))
    first = whole.groupBy("locus", "seq").agg(F.min("allele").alias("first"))
    number = first.withColumn("cluster", (F.row_number().over(W.partitionBy("locus").orderBy("first")) - 1).cast("int"))
    return whole.join(number, ["locus", "seq"]).select("locus", "allele", "cluster")


def emitted(alignments: DataFrame, least: float = LEAST_ALIGNMENT_QUALITY) -> DataFrame:
    """Alignments (pair, mate, mapq_genomic, ...) whose pair's first mate is above ``least`` in that alignment; a null quality is not."""
    kept = alignments.where((F.col("mate") == 1) & (F.col("mapq_genomic") > least)).select("pair", "aln").distinct()
    return alignments.join(kept, ["pair", "aln"], "left_semi")


def exon_positions(alignments: DataFrame) -> DataFrame:
    """(read_id, level, genotype, quality) of alignments (read_id, g, s, levels, quality): characters at novel levels (-1) are appended to the position before them.

    quality holds a sign for every column; insertions before the first level are left out.
    """
    cols = alignments.select("read_id", F.posexplode(F.arrays_zip(F.split("s", "").alias("s"), F.col("levels").alias("level"), F.split("quality", "").alias("q"))).alias("at", "c"))
    rows = cols.select("read_id", "at", F.col("c.s").alias("s"), F.col("c.level").alias("level"), F.col("c.q").alias("q"))
    run = F.sum(F.when(F.col("level") != -1, 1).otherwise(0)).over(W.partitionBy("read_id").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    text = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", c))), lambda x: x[c]), "")
    out = rows.withColumn("_run", run).where("_run > 0").groupBy("read_id", "_run").agg(F.max("level").alias("level"), text("s").alias("genotype"), text("q").alias("quality"))
    return out.drop("_run")


def read_likelihoods(observations: DataFrame, alleles: DataFrame, gap: str = "_") -> DataFrame:
    """(locus, cluster, read, ll, mismatches) of observations (locus, read, pos, genotype, p) against clusters (locus, cluster, pos, base).

    A genotype has one sign or, with an insertion, more. A gap in the read is
    no mismatch; places that no cluster has are left out. Where the clusters
    have few places, they go to every task and a read's rows are brought
    together once, for the sums and for what is made of a read's clusters next.
    """
    if alleles.limit(ALLELES + 1).count() <= ALLELES:
        observations, alleles = observations.repartition("locus", "read"), F.broadcast(alleles)
    met = observations.join(alleles, ["locus", "pos"])
    ll = pr.typing_log_likelihood(F.col("base"), F.col("genotype"), F.col("p"), gap)
    wrong = F.when((F.col("genotype") != gap) & (F.col("base") != F.col("genotype")), 1).otherwise(0)
    return met.groupBy("locus", "cluster", "read").agg(F.sum(ll).alias("ll"), F.sum(wrong).alias("mismatches"))


def pair_likelihoods(likelihoods: DataFrame) -> DataFrame:
    """(locus, c1, c2, ll, mean_mismatches, min_mismatches, p) of all pairs c1 <= c2 of a locus, p their share by likelihood.

    A read's clusters meet inside its own row, and the pairs' sums are combined
    before they are shuffled: what moves is the likelihoods once and a row for
    each pair and task.
    """
    one = F.sort_array(F.collect_list(F.struct("cluster", "ll", "mismatches")))
    reads = likelihoods.groupBy("locus", "read").agg(one.alias("s"))
    rest = lambda x, i: F.transform(F.slice("s", i + 1, F.size("s")), lambda y: F.struct(x.alias("a"), y.alias("b")))
    met = reads.select("locus", F.explode(F.flatten(F.transform("s", rest))).alias("x")).select("locus", "x.a", "x.b")
    sums = met.groupBy("locus", F.col("a.cluster").alias("c1"), F.col("b.cluster").alias("c2")).agg(
        F.sum(pr.logavg(F.col("a.ll"), F.col("b.ll"))).alias("ll"),
        F.sum((F.col("a.mismatches") + F.col("b.mismatches")) / 2.0).alias("mean_mismatches"),
        F.sum(F.least("a.mismatches", "b.mismatches")).alias("min_mismatches"),
    )
    return pr.softmax(sums, ["locus"], "ll", "p")


def allele_marginals(pairs: DataFrame) -> DataFrame:
    """(locus, cluster, p): share of all pairs that hold a cluster, a pair of equal ones counted once."""
    return pairs.select("locus", "p", F.explode(F.array_distinct(F.array("c1", "c2"))).alias("cluster")).groupBy("locus", "cluster").agg(F.sum("p").alias("p"))


def best_pairs(pairs: DataFrame, n: int = 1) -> DataFrame:
    """The n best pairs of each locus: likelihood, then mean mismatches, then the smaller clusters."""
    order = [F.col("ll").desc(), F.col("mean_mismatches"), "c1", "c2"]
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("locus").orderBy(*order))).where(F.col("rank") <= n)


def first_and_second(pairs: DataFrame) -> DataFrame:
    """(locus, first, q1, second, q2): the cluster with the highest marginal, the smaller at a tie; then its best partner, ties by fewest mismatches."""
    pairs = stash(pairs, "pairs")
    m = allele_marginals(pairs).groupBy("locus").agg(F.max_by("cluster", F.struct("p", (-F.col("cluster")).alias("less"))).alias("first"), F.max("p").alias("q1"))
    with_first = pairs.join(m, "locus").where((F.col("c1") == F.col("first")) | (F.col("c2") == F.col("first")))
    other = F.when(F.col("c1") == F.col("first"), F.col("c2")).otherwise(F.col("c1"))
    best = F.max_by(F.struct(other.alias("second"), F.col("p").alias("q2")), F.struct("p", (-F.col("min_mismatches")).alias("less"), (-other).alias("least")))
    return with_first.groupBy("locus", "first", "q1").agg(best.alias("b")).select("locus", "first", "q1", "b.second", "b.q2")


def usable(observations: DataFrame) -> DataFrame:
    """Observations (locus, read, pos, genotype, mapq_position, ...) that pass the gate of positions and whose genotype is not a rare one at a well covered place."""
    gated = observations.where(F.col("mapq_position") >= LEAST_POSITION_QUALITY)
    counts = gated.groupBy("locus", "pos", "genotype").agg(F.count("*").alias("n"))
    kept = fl.without_minor_alleles(counts, ["locus", "pos"]).select("locus", "pos", "genotype")
    return gated.join(kept, ["locus", "pos", "genotype"], "left_semi")


def type_alleles(observations: DataFrame, alleles: DataFrame) -> DataFrame:
    """(locus, first, q1, second, q2) by the whole chain: the gate of positions, the minor-allele filter, likelihoods, pairs, and the two best clusters of each locus."""
    return first_and_second(pair_likelihoods(read_likelihoods(usable(observations), alleles)))


def best_guess(observations: DataFrame, cells: DataFrame, typed: DataFrame, clusters: DataFrame, kmers: DataFrame | None = None, groups: DataFrame | None = None, k: int = 31) -> DataFrame:
    """Two rows a locus with the columns of the result table: (locus, chromosome, allele, q1, q2, avg_cov, cov_decile1, min_cov, prop_kmers, avg_col_error, n_unaccounted[, g_group, perfect]).

    allele: the members of a called cluster joined by semicolons. Coverage is of
    usable observations over the places of ``cells``, uncovered ones included;
    column errors are genotypes that neither called allele has. prop_kmers is
    the share of a called allele's k-mers in ``kmers`` (-1 without any), and
    ``groups`` (allele, g_group) adds the group that most members are in.
    """
    use = stash(usable(observations).select("locus", "pos", "genotype"), "usable")
    one = lambda n, cluster, q: F.struct(F.lit(n).alias("chromosome"), F.col(cluster).alias("cluster"), F.col(q).alias("q"))
    called = typed.select("locus", F.explode(F.array(one(1, "first", "q1"), one(2, "second", "q2"))).alias("c")).select("locus", "c.*")
    members = clusters.groupBy("locus", "cluster").agg(F.array_join(F.sort_array(F.collect_list("allele")), ";").alias("allele"), F.min("allele").alias("_one"))
    named = called.join(members, ["locus", "cluster"])
    places = cells.select("locus", "pos").distinct()
    counts = use.groupBy("locus", "pos", "genotype").agg(F.count("*").alias("n"))
    coverage = places.join(counts.groupBy("locus", "pos").agg(F.sum("n").alias("cov")), ["locus", "pos"], "left").select("locus", "pos", F.coalesce("cov", F.lit(0)).alias("cov"))
    depth = ag.at_index(coverage, ["locus"], "cov", {"cov_decile1": ag.DECILE, "min_cov": "0"}).select("locus", F.col("mean").alias("avg_cov"), "cov_decile1", "min_cov")
    bases = named.select("locus", F.col("_one").alias("allele"), "chromosome").join(cells, ["locus", "allele"])
    own = bases.groupBy("locus", "pos").agg(F.collect_set("base").alias("_own"))
    seen = counts.join(own, ["locus", "pos"]).withColumn("_wrong", ~F.array_contains("_own", F.col("genotype"))).withColumn("_t", F.sum("n").over(W.partitionBy("locus", "pos")))
    errors = seen.groupBy("locus").agg(
        F.try_divide(F.sum(F.when(F.col("_wrong"), F.col("n")).otherwise(0)), F.sum("n")).alias("avg_col_error"),
        F.sum(F.when(F.col("_wrong") & (F.col("_t") >= 30) & (F.col("n") >= 0.2 * F.col("_t")), 1).otherwise(0)).alias("n_unaccounted"),
    )
    out = named.join(typed.select("locus", F.col("q2").alias("_q2")), "locus").join(depth, "locus", "left").join(errors, "locus", "left")
    if kmers is not None:
        whole = bases.groupBy("locus", "chromosome", "exon_ord").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("exon_pos", "base"))), lambda x: x["base"]), "").alias("seq"))
        wanted = whole.select("locus", "chromosome", F.explode_outer(sq.kmers(sq.remove_gaps(F.col("seq")), k)).alias("raw")).withColumn("kmer", sq.canonical(F.col("raw")))
        share = called_kmers_present(wanted, kmers, ["locus", "chromosome"]).withColumnRenamed("share", "prop_kmers")
        out = out.join(share, ["locus", "chromosome"], "left")
    else:
        out = out.withColumn("prop_kmers", F.lit(-1.0))
    if groups is not None:
        votes = nm.group_of(clusters.join(called.select("locus", "cluster").distinct(), ["locus", "cluster"]), groups, ["locus", "cluster"])
        out = out.join(votes, ["locus", "cluster"], "left")
    more = ["g_group", "perfect"] if groups is not None else []
    return out.select("locus", "chromosome", "allele", F.col("q").alias("q1"), F.col("_q2").alias("q2"), "avg_cov", "cov_decile1", "min_cov", "prop_kmers", F.coalesce("avg_col_error", F.lit(0.0)).alias("avg_col_error"), F.coalesce("n_unaccounted", F.lit(0)).alias("n_unaccounted"), *more)


def unaccounted(counts: DataFrame, called: DataFrame, position: list[str], least: int = 30, share: float = 0.2) -> DataFrame:
    """Alleles of well covered positions with at least ``share`` that the call does not have."""
    total = F.sum("n").over(W.partitionBy(*position))
    seen = counts.withColumn("coverage", total).where((F.col("coverage") >= least) & (F.col("n") >= share * F.col("coverage")))
    return seen.join(called, [*position, "allele"], "left_anti")


def called_kmers_present(called: DataFrame, seen: DataFrame, by: list[str]) -> DataFrame:
    """(by, share) of a call's k-mers that the reads have; those with an unknown sign are never seen, and a call without k-mers has -1."""
    rows = called.join(seen.select("kmer", F.lit(1).alias("_s")), "kmer", "left")
    hit = F.when(~F.col("kmer").contains("*") & (F.col("_s") == 1), 1.0).otherwise(0.0)
    return rows.groupBy(*by).agg(F.coalesce(F.avg(F.when(F.col("kmer").isNotNull(), hit)), F.lit(-1.0)).alias("share"))


def haplotype_beam(observations: DataFrame, starts: dict[int, str] | None = None, width: int = 32) -> DataFrame:
    """(locus, h1, h2, score) by a beam over positions: every live pair is extended by all ordered pairs of the alleles seen there, and of the ones ``starts`` has for the position, and the best ``width`` stay.

    Each extension scores half the reads' mean likelihood, half the bases'. The
    beam runs along a locus, so this is a grouped function; its input is a
    locus' own alleles (locus, pos, allele, n, p).
    """
    import math

    def search(group: pd.DataFrame) -> pd.DataFrame:
        live = [("", "", 0.0)]
        for pos, rows in sorted(group.groupby("pos")):
            seen = sorted((a, n, p) for a, n, p in zip(rows["allele"], rows["n"], rows["p"], strict=True) if "N" not in a)
            have = {a for a, _, _ in seen}
            seen += [(a, 0, 0.0) for a in sorted(set((starts or {}).get(pos, "")) - have)]
            if not seen:
                continue
            total = max(1, sum(n for _, n, _ in seen))
            grown = []
            for h1, h2, score in live:
                for a, na, pa in seen:
                    for b, nb, pb in seen:
                        reads = (na + nb) / (2 * total) if a != b else na / total
                        grown.append((h1 + a, h2 + b, score + math.log(max(1e-200, 0.5 * reads + 0.5 * (pa + pb) / 2))))
            live = sorted(grown, key=lambda x: (-x[2], x[0], x[1]))[:width]
        return pd.DataFrame([(group["locus"].iloc[0], *live[0])], columns=["locus", "h1", "h2", "score"])

    return observations.groupBy("locus").applyInPandas(search, "locus string, h1 string, h2 string, score double")


def similar_haplotypes(called: DataFrame, reference: DataFrame, by: list[str], key: str) -> DataFrame:
    """(key, by, reference_id, distance) of each called haplotype (key, by, seq) to every reference (by, reference_id, reference_seq) of its locus, places unknown in either left out."""
    return called.join(reference, by).select(key, *by, "reference_id", sq.hamming(F.col("seq"), F.col("reference_seq")).alias("distance"))


def mapping_confidence(candidates: DataFrame) -> DataFrame:
    """Candidates' bases (pair, mate, strand, base, level, graph_char, mapq) with the sum of mapq of all candidates that put the base there."""
    w = W.partitionBy("pair", "mate", "strand", "base", "level", "graph_char")
    return candidates.withColumn("mapq_position", F.sum("mapq").over(w))


def chain_candidates(chains: DataFrame, lengths: DataFrame, k: int, error: float = 0.01, margin: float = 12.0) -> DataFrame:
    """(pair, mate, aln, graph, strand, first_pos, ll, pos, end): both mates' candidates from chains of seeds (pair, mate, strand, graph, first_pos, last_pos, first_level, last_level, n).

    A chain of ``n`` seeds covers n + ``k`` - 1 signs; ll is that of as many
    agreeing signs, and of the others of the mate's length (pair, mate, length)
    as errors. Candidates whose ll lies more than ``margin`` below their mate's
    best are cut: by their share of at most exp(-``margin``), never by their
    number. aln numbers what is left from 0, best first, ties by strand, graph
    and place. Mates without chains have no rows; repeated chains are one.
    """
    import math

    covered = F.least(F.col("n") + (k - 1), F.col("length"))
    rows = chains.distinct().join(lengths.distinct(), ["pair", "mate"]).withColumn("ll", covered * math.log1p(-error) + (F.col("length") - covered) * math.log(error / 3))
    best = rows.groupBy("pair", "mate").agg(F.max("ll").alias("_best"))  # the cut comes before any order
    kept = rows.join(best, ["pair", "mate"]).where(F.col("ll") >= F.col("_best") - margin)
    order = W.partitionBy("pair", "mate").orderBy(F.col("ll").desc(), "strand", "graph", "first_level", "first_pos")
    return kept.select("pair", "mate", (F.row_number().over(order) - 1).alias("aln"), "graph", "strand", "first_pos", "ll", F.col("first_level").alias("pos"), F.col("last_level").alias("end"))


def resolve_in_graphs(candidates: DataFrame, mean: float, sd: float) -> DataFrame:
    """(pair, graph, a1, a2, score, mapq) of mates' candidates (pair, mate, aln, graph, strand, ll, pos) that lie in one graph, on opposite strands.

    mapq is shared among all such places of the pair, in whichever graph. Pairs
    without one have no rows.
    """
    side = lambda m: candidates.where(F.col("mate") == m).select("pair", "graph", "strand", F.col("aln").alias(f"a{m}"), F.col("ll").alias(f"l{m}"), F.col("pos").alias(f"p{m}"))
    other = side(2).withColumn("strand", F.when(F.col("strand") == "+", "-").otherwise("+"))
    met = side(1).join(other, ["pair", "graph", "strand"])
    score = F.col("l1") + F.col("l2") + F.ln(pr.normal_density(F.abs(F.col("p2") - F.col("p1")).cast("double"), F.lit(mean), F.lit(sd)))
    out = pr.softmax(met.withColumn("score", score), ["pair"], "score", "mapq")
    return out.select("pair", "graph", "a1", "a2", "score", "mapq")


def resolve_pairs(candidates: DataFrame, mean: float, sd: float, outside: DataFrame | None = None) -> DataFrame:
    """(pair, a1, a2, score, mapq, mapq_genomic) for all combinations of the mates' candidates (pair, mate, aln, ll, pos): likelihoods and the distance's density, mapq their share.

    ``outside`` (pair, score) has pairs whose first alignment lies outside the
    graph: that is one more alternative, which mapq_genomic counts and mapq does not.
    """
    side = lambda k: candidates.where(F.col("mate") == k).select("pair", F.col("aln").alias(f"a{k}"), F.col("ll").alias(f"l{k}"), F.col("pos").alias(f"p{k}"))
    met = side(1).join(side(2), "pair")
    score: Column = F.col("l1") + F.col("l2") + F.ln(pr.normal_density(F.abs(F.col("p2") - F.col("p1")).cast("double"), F.lit(mean), F.lit(sd)))
    out = pr.softmax(met.withColumn("score", score), ["pair"], "score", "mapq").select("pair", "a1", "a2", "score", "mapq")
    if outside is None:
        return out.withColumn("mapq_genomic", F.col("mapq"))
    both = out.join(outside.select("pair", F.col("score").alias("_o")), "pair", "left")
    top = F.max(F.greatest("score", F.coalesce("_o", "score"))).over(W.partitionBy("pair"))
    total = F.sum(F.exp(F.col("score") - top)).over(W.partitionBy("pair")) + F.coalesce(F.exp(F.col("_o") - top), F.lit(0.0))
    return both.withColumn("mapq_genomic", F.exp(F.col("score") - top) / total).drop("_o")


def estimated_insert_size(candidates: DataFrame, every: int = 1) -> DataFrame:
    """(mean, sd) of the distance between mates over all combinations of candidates (pair, mate, aln, ll, pos), each weighing its share by likelihood alone; of every n-th pair."""
    some = candidates if every == 1 else candidates.join(fl.every_nth(candidates.select("pair", F.lit(1).alias("_all")).distinct(), ["pair"], every, ["_all"]).select("pair"), "pair", "left_semi")
    side = lambda k: some.where(F.col("mate") == k).select("pair", F.col("ll").alias(f"l{k}"), F.col("pos").alias(f"p{k}"))
    met = side(1).join(side(2), "pair").select("pair", (F.col("l1") + F.col("l2")).alias("score"), F.abs(F.col("p2") - F.col("p1")).alias("distance"), F.lit(1).alias("_all"))
    return ag.insert_size(pr.softmax(met, ["pair"], "score", "weight"), ["_all"], "distance", F.col("weight")).select(F.col("p50").alias("mean"), "sd")
