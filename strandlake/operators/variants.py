"""Variant records, genome strings and their evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import probability as pr
from strandlake.functions import sequences as sq
from strandlake.lineage import stash
from strandlake.operators import aggregates as ag
from strandlake.operators import graph

GAP = "_"
#: Signs in a piece of a reference.
PIECE = 1024


def records_to_segments(records: DataFrame, reference: DataFrame) -> DataFrame:
    """(chrom, seg_ord, a1, a2, pos) of a genome string from records (chrom, pos, ref, a1, a2) that do not overlap and a reference (chrom, seq).

    Alleles of a record are padded with gaps to the same length; what lies
    between records is the reference's. Positions count from 1; pos is a
    segment's first.
    """
    w = W.partitionBy("chrom").orderBy("pos")
    end = F.col("pos") + F.length("ref")
    sizes = reference.select("chrom", F.length("seq").alias("_length"))
    rows = records.withColumn("_from", F.coalesce(F.lag(end).over(w), F.lit(1))).withColumn("_next", F.lead("pos").over(w)).join(sizes, "chrom")
    size = F.greatest(F.length("a1"), F.length("a2"))
    pad = lambda c: F.rpad(F.col(c), size, GAP)
    none, k = F.lit(None).cast("string"), F.col("pos") * 3
    called = rows.select("chrom", k.alias("seg_ord"), F.col("pos").cast("long").alias("pos"), pad("a1").alias("a1"), F.when(F.col("a1") != F.col("a2"), pad("a2")).alias("a2"))
    # what lies between, from the first place to the one after the last
    place = lambda order, a, b: F.struct(order.alias("seg_ord"), a.cast("long").alias("pos"), F.least(b, F.col("_length") + 1).cast("long").alias("_to"))
    tail = F.when(F.col("_next").isNull(), place(k + 1, end, F.col("_length") + 1))
    between = rows.select("chrom", F.explode(F.array(place(k - 1, F.col("_from"), F.col("pos")), tail)).alias("s")).select("chrom", "s.*").where("pos < _to")
    whole = reference.join(records.select("chrom").distinct(), "chrom", "left_anti").select("chrom", F.lit(0).alias("seg_ord"), F.lit(1).cast("long").alias("pos"), F.col("seq").alias("a1"), none.alias("a2"))
    out = called.where(F.col("a1").isNotNull() & (F.col("a1") != "")).unionByName(_cut_out(between, reference).withColumn("a2", none)).unionByName(whole)
    return out.withColumn("seg_ord", F.row_number().over(W.partitionBy("chrom").orderBy("seg_ord")) - 1)


def _cut_out(places: DataFrame, reference: DataFrame) -> DataFrame:
    """(chrom, seg_ord, pos, a1) of what a reference has from pos to before _to.

    The reference is cut into pieces of ``PIECE`` signs once; a place meets the
    pieces it touches, never the whole sequence.
    """
    pieces = reference.select("chrom", F.posexplode(F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("_piece", "_text"))
    piece = lambda c: F.floor(F.col(c) / PIECE).cast("int")
    met = places.withColumns({"_a": F.col("pos") - 1, "_b": F.col("_to") - 1}).withColumn("_last", F.col("_b") - 1)
    met = met.withColumn("_piece", F.explode(F.sequence(piece("_a"), piece("_last")))).join(pieces, ["chrom", "_piece"])
    begin = F.col("_piece").cast("long") * PIECE
    a, b = F.greatest(F.col("_a") - begin, F.lit(0)), F.least(F.col("_b") - begin, F.lit(PIECE))
    parts = met.select("chrom", "seg_ord", "pos", "_piece", F.substr("_text", (a + 1).cast("int"), (b - a).cast("int")).alias("_text"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_piece", "_text"))), lambda x: x["_text"]), "")
    return parts.groupBy("chrom", "seg_ord", "pos").agg(joined.alias("a1"))


def evaluated(segments: DataFrame, counts: DataFrame, k: int, coverage: float, by: str = "chrom") -> DataFrame:
    """(by, total, different, invalid, present, optimality, weighted) of the k-mers of both haplotypes of a genome string.

    Optimality is the mean posterior probability of a k-mer's copy number given
    its count, over different k-mers and weighted by how often they occur.
    """
    text = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg_ord", "a1", "a2"))), lambda x: F.coalesce(x[c], x["a1"])), "")
    haps = segments.groupBy(by).agg(F.array(text("a1"), text("a2")).alias("_h")).select(by, F.explode("_h").alias("_s")).select(by, F.translate("_s", GAP, "").alias("_s"))
    rows = haps.select(by, F.explode(sq.kmers(F.col("_s"), k)).alias("raw")).select(by, sq.canonical(F.col("raw")).alias("kmer"), sq.is_valid_kmer(F.col("raw")).alias("valid"))
    each = rows.groupBy(by, "kmer").agg(F.count("*").cast("int").alias("copies"), F.bool_and("valid").alias("valid")).join(counts, "kmer", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("int"))
    top = F.greatest("copies", F.lit(2)) + 2
    parts = F.transform(F.sequence(F.lit(0), top), lambda c: pr.poisson(F.col("n"), c * F.lit(coverage)))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    posterior = F.when(F.col("valid"), F.coalesce(F.try_divide(F.get(parts, F.col("copies")), total), F.lit(0.0))).otherwise(F.lit(0.0))
    scored = each.withColumn("_p", posterior)
    return scored.groupBy(by).agg(
        F.sum("copies").alias("total"),
        F.count("*").alias("different"),
        F.sum(F.when(F.col("valid"), 0).otherwise(F.col("copies"))).alias("invalid"),
        F.sum(F.when(F.col("n") > 0, F.col("copies")).otherwise(0)).alias("present"),
        F.avg("_p").alias("optimality"),
        F.try_divide(F.sum(F.col("_p") * F.col("copies")), F.sum("copies")).alias("weighted"),
    )


def spatial_summary(levels: DataFrame, by: list[str]) -> DataFrame:
    """(by, induced, invalid, ok, in_reference) of flagged k-mers (valid, present, in_reference) at each level."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return levels.groupBy(*by).agg(F.count("*").alias("induced"), n(~F.col("valid")).alias("invalid"), n(F.col("present")).alias("ok"), n(F.col("in_reference")).alias("in_reference"))


def phase_parts(segments: DataFrame, k: int, by: str = "chrom") -> DataFrame:
    """(by, part, context, seg_ord, a1, a2): segments in parts that can be put into phase apart.

    A part ends with a run of agreed segments of 2 ``k`` signs or more (gaps do
    not count), so that neither a k-mer nor the signs that a choice is judged by
    reach from one part's open segments to those of the next. The last agreed
    segments before a part, enough for those signs, come with it once more as
    its context. Only numbers are put in order; the texts are joined to them by
    their segment, whose seg_ord is unique within ``by``.
    """
    segments = segments.where(F.col(by).isNotNull() & F.col("a1").isNotNull())
    order = W.partitionBy(by).orderBy("seg_ord")
    open_ = F.col("a2").isNotNull() & (F.col("a2") != F.col("a1"))
    sizes = segments.select(by, "seg_ord", open_.alias("_open"), F.when(open_, 0).otherwise(F.length(F.translate("a1", GAP, ""))).alias("_n"))
    # agreed signs up to and with each segment, and up to the open one before it
    rows = sizes.withColumn("_c", F.sum("_n").over(order)).withColumn("_was", F.last(F.when(F.col("_open"), F.col("_c")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("part", F.sum(F.when(F.col("_open") & (F.col("_c") - F.col("_was") >= 2 * k), 1).otherwise(0)).over(order))
    own = rows.select(by, "part", F.lit(False).alias("context"), "seg_ord")
    ends = rows.groupBy(by, "part").agg(F.max("_c").alias("_end"), F.max(F.when(F.col("_open"), F.col("seg_ord"))).alias("_open_at"))
    tail = rows.where("NOT _open").join(ends, [by, "part"]).where((F.col("seg_ord") > F.col("_open_at")) & (F.col("_end") - F.col("_c") < 2 * k))
    following = ends.select(by, (F.col("part") - 1).alias("part"))
    context = tail.join(following, [by, "part"], "left_semi").select(by, (F.col("part") + 1).alias("part"), F.lit(True).alias("context"), "seg_ord")
    return own.unionByName(context).join(segments.select(by, "seg_ord", "a1", "a2"), [by, "seg_ord"]).select(by, "part", "context", "seg_ord", "a1", "a2")


def phased(segments: DataFrame, counts: DataFrame, k: int, share: float = 0.9, most: int = 1000, by: str = "chrom", most_kmers: int = 2_000_000) -> DataFrame:
    """(by, h1, h2, support): segments put into phase so that most of the k-mers they make are in the counts.

    Open pairs of haplotypes grow by one segment in both orders and keep those
    above ``share`` of the best, at most ``most`` + 1; where none has support,
    the first stays. The order of segments matters within a part
    (``phase_parts``), which is a grouped function; a chromosome is as many
    tasks as it has parts. The result is that of the whole chromosome, with the
    bound ``most`` for each part. Segments without a chromosome or a1 are left
    out; a chromosome without open segments is one part, and no segments give no
    rows. Counts with a column ``by`` are each chromosome's own: k-mers of
    another one do not support its phase.
    """
    columns = ["_part", "h1", "h2", "found", "total"]
    schema = "_part string, h1 string, h2 string, found long, total long"

    def solve(name: str, mine: pd.DataFrame, have: frozenset) -> pd.DataFrame:
        mine = mine.sort_values(["context", "seg_ord"], ascending=[False, True], kind="stable")
        before = "".join(mine["a1"][mine["context"]])
        # no more than 2 k signs that are no gaps
        solid = [i for i, c in enumerate(before) if c != GAP]
        before = before[solid[-2 * k] :] if len(solid) > 2 * k else before
        own = mine[~mine["context"]]

        def tally(a: str, b: str, skip: int = 0) -> tuple[int, int]:
            found = [s[i : i + k] for s in (a.replace(GAP, ""), b.replace(GAP, "")) for i in range(max(0, skip - k + 1), len(s) - k + 1)]
            return sum(f in have for f in found), len(found)

        def score(a: str, b: str) -> float:
            found, n = tally(a, b)
            return found / n if n else 1.0

        live: list[tuple[float, str, str]] = [(1.0, before, before)]
        for a1, a2 in zip(own["a1"], own["a2"], strict=True):
            het = isinstance(a2, str) and a2 != a1
            grown = [(x + p, y + q) for _, x, y in live for p, q in (((a1, a2), (a2, a1)) if het else ((a1, a1),))]
            scored = sorted(((score(x[-(2 * k + len(a1)) :], y[-(2 * k + len(a1)) :]), x, y) for x, y in grown), key=lambda t: -t[0])
            best = scored[0][0]
            live = [s for s in scored if s[0] > share * best][: most + 1] if best > 0 else scored[:1]
        _, h1, h2 = live[0]
        # the k-mers that lie in the context alone are the part's before
        return pd.DataFrame([(name, h1[len(before) :], h2[len(before) :], *tally(h1, h2, len(before.replace(GAP, ""))))], columns=columns)

    # a name for a grouped function: the part's number before the first bar, then the chromosome
    name = F.concat(F.col("part").cast("string"), F.lit("|"), F.col(by).cast("string"))
    parts = stash(phase_parts(segments, k, by).withColumn("_part", name), "parts")
    chrom = lambda c: F.expr(f"substring({c}, instr({c}, '|') + 1)")
    # an empty name where all chromosomes share the counts
    owner = F.col(by).cast("string") if by in counts.columns else F.lit("")
    seen = counts.where("n > 0").select(owner.alias("_owner"), "kmer").where("_owner IS NOT NULL")
    both = stash(seen.unionByName(seen.withColumn("kmer", sq.revcomp(F.col("kmer")))).distinct(), "kmers")
    if both.limit(most_kmers + 1).count() <= most_kmers:
        sets: dict[str, set] = {}
        for name_of, kmer in both.select("_owner", "kmer").collect():
            sets.setdefault(name_of, set()).add(kmer)
        shared, owned = segments.sparkSession.sparkContext.broadcast({o: frozenset(x) for o, x in sets.items()}), by in counts.columns
        solved = parts.groupBy("_part").applyInPandas(lambda key, mine: solve(key[0], mine, shared.value.get(key[0].partition("|")[2] if owned else "", frozenset())), schema)
    else:
        # of more, each part takes those that its segments can make
        rows = parts.select(F.col("_part").alias("graph"), "seg_ord", "a1", "a2")
        made = graph.kmer_paths(graph.segments_to_edges(rows), k).select("graph", "kmer").distinct()
        made = made.withColumn("_owner", chrom("graph") if by in counts.columns else F.lit(""))
        own = made.join(both, ["_owner", "kmer"], "left_semi").select(F.col("graph").alias("_part"), "kmer")
        solved = parts.groupBy("_part").cogroup(own.groupBy("_part")).applyInPandas(lambda key, mine, kmers: solve(key[0], mine, frozenset(kmers["kmer"])), schema)
    rows = solved.select(chrom("_part").alias(by), F.expr("cast(substring(_part, 1, instr(_part, '|') - 1) as long)").alias("_n"), "h1", "h2", "found", "total")
    text = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", c))), lambda x: x[c]), "")
    return rows.groupBy(by).agg(text("h1").alias("h1"), text("h2").alias("h2"), F.coalesce(F.try_divide(F.sum("found"), F.sum("total")), F.lit(1.0)).alias("support"))


def haplotypes_to_records(columns: DataFrame) -> DataFrame:
    """(chrom, pos, ref, a1, a2) from aligned columns (chrom, at, pos, ref, h1, h2), gaps as signs; pos repeats at insertions.

    A block of columns stays open from one where a haplotype differs from the
    reference, or any of the three has a gap, to the next clean one; its record
    begins at the clean column before it, as the format needs for empty alleles.
    """
    w = W.partitionBy("chrom").orderBy("at")
    clean = (F.col("ref") == F.col("h1")) & (F.col("ref") == F.col("h2")) & (F.col("ref") != GAP)
    gap = (F.col("ref") == GAP) | (F.col("h1") == GAP) | (F.col("h2") == GAP)
    rows = columns.withColumn("_clean", clean).withColumn("_gap", gap)
    anchor = F.col("_clean") & F.coalesce(F.lead("_gap").over(w), F.lit(False))
    part = rows.withColumn("_open", ~F.col("_clean") | anchor).withColumn("_starts", anchor | (~F.col("_clean") & F.coalesce(F.lag("_clean").over(w), F.lit(True)) & ~F.coalesce(F.lag(anchor).over(w), F.lit(False))))
    runs = part.withColumn("_run", F.sum(F.when(F.col("_starts"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))).where("_open")
    text = lambda c: F.translate(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", c))), lambda x: x[c]), ""), GAP, "")
    return runs.groupBy("chrom", "_run").agg(F.min("pos").alias("pos"), text("ref").alias("ref"), text("h1").alias("a1"), text("h2").alias("a2")).drop("_run").where("ref <> a1 OR ref <> a2")


def amended(haplotypes: DataFrame, calls: DataFrame, by: str = "chrom") -> DataFrame:
    """(by, seq): haplotypes with called variants (by, pos, ref, alt) put in; a call whose reference does not fit there is left out.

    Calls are applied from the last to the first, so positions stay those of the haplotype.
    """

    def run(key: tuple, mine: pd.DataFrame, called: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, seq in zip(mine[by], mine["seq"], strict=True):
            for pos, ref, alt in sorted(zip(called["pos"], called["ref"], called["alt"], strict=True), reverse=True):
                i = int(pos) - 1
                if seq[i : i + len(ref)] == ref:
                    seq = seq[:i] + alt + seq[i + len(ref) :]
            out.append((name, seq))
        return pd.DataFrame(out, columns=[by, "seq"])

    return haplotypes.groupBy(by).cogroup(calls.groupBy(by)).applyInPandas(run, f"{by} string, seq string")


def expanded_cigars(records: DataFrame, reference: DataFrame) -> DataFrame:
    """(read_id, g, s, levels) of records (read_id, chrom, pos, cigar, seq): aligned strings, and reference positions (-1 at insertions); clipped signs are left out."""
    import re

    rows = records.join(reference.withColumnRenamed("seq", "_ref"), "chrom")
    kind = records.schema["read_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for key, pos, cigar, seq, ref in zip(p["read_id"], p["pos"], p["cigar"], p["seq"], p["_ref"], strict=True):
                g, s, levels, i, j = [], [], [], int(pos) - 1, 0
                for n, op in ((int(a), b) for a, b in re.findall(r"(\d+)([MIDNSHP=X])", cigar or "")):
                    if op in "M=X":
                        g.append(ref[i : i + n])
                        s.append(seq[j : j + n])
                        levels += range(i + 1, i + n + 1)
                        i, j = i + n, j + n
                    elif op == "I":
                        g.append(GAP * n)
                        s.append(seq[j : j + n])
                        levels += [-1] * n
                        j += n
                    elif op in "DN":
                        g.append(ref[i : i + n])
                        s.append(GAP * n)
                        levels += range(i + 1, i + n + 1)
                        i += n
                    elif op == "S":
                        j += n
                out.append((key, "".join(g), "".join(s), levels))
            yield pd.DataFrame(out, columns=["read_id", "g", "s", "levels"])

    return rows.select("read_id", "pos", "cigar", "seq", "_ref").mapInPandas(run, f"read_id {kind}, g string, s string, levels array<int>")


def compared_methods(methods: dict[str, DataFrame], counts: DataFrame, k: int, coverage: float, by: str = "chrom") -> DataFrame:
    """(method, by, ...) of the evaluation of each method's genome strings (by, seg_ord, a1, a2)."""
    out = None
    for name, segments in methods.items():
        one = evaluated(segments, counts, k, coverage, by).withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def method_constellations(methods: dict[str, DataFrame], k: int, by: str = "chrom") -> DataFrame:
    """(mask, n_keys): how many canonical k-mers the genome strings of exactly those methods have, the first method as the lowest bit."""
    out = None
    for n, segments in enumerate(methods.values()):
        text = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg_ord", "a1", "a2"))), lambda x: F.coalesce(x[c], x["a1"])), "")
        haps = segments.groupBy(by).agg(F.array(text("a1"), text("a2")).alias("_h")).select(F.explode("_h").alias("_s"))
        one = haps.select(F.explode(sq.kmers(F.translate("_s", GAP, ""), k)).alias("_k")).select(sq.canonical(F.col("_k")).alias("kmer"), F.lit(n).alias("bit"))
        out = one if out is None else out.unionByName(one)
    return ag.constellations(out.distinct(), "kmer", "bit", len(methods))


def contig_report(columns: DataFrame, by: list[str]) -> DataFrame:
    """Tallies of contigs' alignment columns (by, g, s, level) with the share of aligned signs that agree."""
    out = ag.alignment_tallies(columns, by)
    return out.withColumn("identity", F.try_divide(F.col("matches"), F.col("matches") + F.col("mismatches") + F.col("novel_gaps") + F.col("deletions")))
