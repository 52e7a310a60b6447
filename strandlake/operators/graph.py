"""Levelled variation graphs and de Bruijn graphs as tables of edges.

Edges are (graph, level, edge_id, from_id, to_id, locus_id, symbol, count).
Nodes of level l lead to nodes of level l + 1; a symbol is a base, a gap (_),
or unknown (*).
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import sequences as sq
from strandlake.functions.expressions import draw, upto
from strandlake.lineage import stash

GAP, UNKNOWN = "_", "*"
EDGES = "graph string, level int, edge_id long, from_id long, to_id long, locus_id string, symbol string, count double"


# --- building -----------------------------------------------------------------


def _ahead(rows: dict[str, str], variants: dict[str, list[str]], names: frozenset[str], level: int, n: int) -> set[str]:
    """Strings of the next ``n`` signs of some haplotypes, with their variants in place."""
    found = set()
    for h in names:
        base = rows[h][level + 1 : level + 1 + n]
        found.add(base)
        for v in variants.get(h, ()):
            other = v[level + 1 : level + 1 + n]
            found.add("".join(b if o == UNKNOWN else o for o, b in zip(other, base, strict=True)))
    return found


def _mergeable(rows: dict, variants: dict, a: frozenset, b: frozenset, level: int, want: int, length: int) -> bool:
    """Whether two groups of haplotypes go on alike for ``want`` signs that are no gaps, looking at most ten times as far."""
    look = want
    while look <= 10 * want and level + look <= length - 1:
        x, y = _ahead(rows, variants, a, level, look), _ahead(rows, variants, b, level, look)
        blank = UNKNOWN * look
        every = x | y
        if any(s[0] == GAP for s in every):
            return False
        if blank not in (x if len(x) == 1 else ()) and blank not in (y if len(y) == 1 else ()) and (x ^ y) - {blank}:
            return False
        seen = min(look - s.count(GAP) for s in every)
        if seen >= want:
            return True
        look = want + look - seen
    return False


def panel_graph(rows: dict[str, str], variants: dict[str, list[str]], loci: list[str], want: int) -> list[tuple]:
    """Edges (level, from, to, locus, symbol, count) of a segment; groups of haplotypes that continue alike share a node, joined pair by pair in order."""
    if not rows or not loci:
        return []
    where = {0: frozenset(rows)}
    edges, node = [], 0
    for level, locus in enumerate(loci):
        out: dict[tuple[int, str], set[str]] = defaultdict(set)
        for at, names in where.items():
            for h in names:
                out[at, rows[h][level]].add(h)
        groups = [([key], frozenset(names)) for key, names in sorted(out.items())]
        queue = [(i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))]
        gone: set[int] = set()
        while queue:
            i, j = queue.pop(0)
            if i in gone or j in gone:
                continue
            if _mergeable(rows, variants, groups[i][1], groups[j][1], level, want, len(loci)):
                gone |= {i, j}
                groups.append((groups[i][0] + groups[j][0], groups[i][1] | groups[j][1]))
                queue += [(k, len(groups) - 1) for k in range(len(groups) - 1) if k not in gone]
        if level == len(loci) - 1:
            groups, gone = [([k for g, (keys, _) in enumerate(groups) if g not in gone for k in keys], frozenset(rows))], set()
        where = {}
        for g, (keys, names) in enumerate(groups):
            if g in gone:
                continue
            node += 1
            where[node] = names
            for at, symbol in keys:
                extra = {v[level] for h in out[at, symbol] for v in variants.get(h, ())} - {UNKNOWN, symbol}
                taken = {s for a, s in out if a == at}
                edges.append((level, at, node, locus, symbol, float(len(out[at, symbol]))))
                edges += [(level, at, node, locus, s, 1.0) for s in sorted(extra - taken)]
    return edges


def graph_of_panel(panel: DataFrame, want: int = 25) -> DataFrame:
    """Edges of each segment's graph from a panel (segment, haplotype_id, locus_id, level, allele).

    Rows named SNPs_n_x are variants of x. Joining nodes goes level by level and
    each join depends on those before, so a segment is a grouped function; the
    segments are independent of each other.
    """

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["level", "haplotype_id"])
        loci = group.drop_duplicates("level")["locus_id"].tolist()
        lines = {h: "".join(g["allele"]) for h, g in group.groupby("haplotype_id")}
        variants: dict[str, list[str]] = defaultdict(list)
        for h in sorted(lines):
            if h.startswith("SNPs_"):
                variants[h.split("_", 2)[2]].append(lines[h])
        edges = panel_graph({h: s for h, s in lines.items() if not h.startswith("SNPs_")}, variants, loci, want)
        return pd.DataFrame([(group["segment"].iloc[0], lv, k, a, b, locus, s, c) for k, (lv, a, b, locus, s, c) in enumerate(edges)], columns=["graph", "level", "edge_id", "from_id", "to_id", "locus_id", "symbol", "count"])

    return panel.groupBy("segment").applyInPandas(build, EDGES)


def kmer_graph_of_panel(panel: DataFrame, k: int) -> DataFrame:
    """Edges that emit k-mers straight from a panel (segment, haplotype_id, locus_id, level, allele).

    A haplotype's edge at a level emits the k-mer that begins there over gaps,
    or a gap where it has one or too few signs follow. Haplotypes whose next
    k - 1 signs are alike share a node; counts are of haplotypes.
    """
    w = W.partitionBy("segment", "haplotype_id").orderBy("level")
    text = lambda n: F.array_join(F.collect_list("allele").over(w.rowsBetween(0, n - 1)), "")
    solid = panel.where(F.col("allele") != GAP).select("segment", "haplotype_id", "level", text(k).alias("_k"), text(k - 1).alias("_c"))
    rows = panel.select("segment", "haplotype_id", "locus_id", "level").join(solid, ["segment", "haplotype_id", "level"], "left")
    ahead = F.coalesce(F.first("_c", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)), F.lit(""))
    rows = rows.withColumn("_node", F.xxhash64("segment", "level", ahead))
    after = F.coalesce(F.lead("_node").over(w), F.xxhash64("segment", F.col("level") + 1, F.lit("")))
    rows = rows.withColumn("_to", after).withColumn("symbol", F.when(F.length("_k") == k, F.col("_k")).otherwise(GAP))
    edges = rows.groupBy("segment", "level", "locus_id", "_node", "_to", "symbol").agg(F.count("*").cast("double").alias("count"))
    number = F.xxhash64("segment", "level", "_node", "_to", "symbol")
    return edges.select(F.col("segment").alias("graph"), "level", number.alias("edge_id"), F.col("_node").alias("from_id"), F.col("_to").alias("to_id"), "locus_id", "symbol", "count")


def concatenated(edges: DataFrame, order: str = "graph") -> DataFrame:
    """One graph of all segments in order: levels and ids go on from segment to segment, and what ends one begins the next."""
    size = edges.groupBy(order).agg(F.max("level").alias("_l"), F.max("to_id").alias("_n"), F.max("edge_id").alias("_e"))
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)  # a row for each segment
    before = lambda c: F.coalesce(F.sum(F.col(c) + 1).over(w), F.lit(0))
    offset = size.select(order, F.col("_l").alias("_last"), before("_l").alias("_ol"), before("_n").alias("_on"), before("_e").alias("_oe"), F.lead(order).over(W.orderBy(order)).isNull().alias("_final"), (before("_n") + F.col("_n") + 1).alias("_next"))
    rows = edges.join(F.broadcast(offset), order)
    to = F.when((F.col("level") == F.col("_last")) & ~F.col("_final"), F.col("_next")).otherwise(F.col("to_id") + F.col("_on"))
    return rows.select(F.lit("all").alias("graph"), (F.col("level") + F.col("_ol")).cast("int").alias("level"), (F.col("edge_id") + F.col("_oe")).alias("edge_id"), (F.col("from_id") + F.col("_on")).alias("from_id"), to.alias("to_id"), "locus_id", "symbol", "count")


# --- k-mers --------------------------------------------------------------------


def list_ranks(rows: DataFrame, keep_jumps: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """Where chains end, by pointer doubling: ``rows`` (graph, edge_id, next) with (last, n), the last edge of the chain that begins with each and its edges.

    Chains may join, so that a next belongs to several, but never split. Each
    round doubles what every edge has covered and joins only edges whose chains
    go on, so a chain of n edges takes log n rounds. With ``keep_jumps`` the
    second result has (graph, edge_id, next) of each round: the edge 1, 2, 4, ...
    further on. No rows give none.
    """
    state = stash(rows.select("graph", "edge_id", "next", F.col("edge_id").alias("last"), F.lit(1).cast("long").alias("n")), "ranks")
    done, jumps = [], []
    while True:
        done.append(state.where("next IS NULL").select("graph", "edge_id", "last", "n"))
        active = state.where("next IS NOT NULL")
        if active.isEmpty():
            break
        if keep_jumps:
            jumps.append(active.select("graph", "edge_id", "next"))
        # an edge's next may have ended in any round before
        other = state.select("graph", "edge_id", "next", "last", "n")
        for d in done[:-1]:
            other = other.unionByName(d.withColumn("next", F.lit(None).cast("long")))
        ahead = other.select("graph", F.col("edge_id").alias("next"), F.col("next").alias("_next"), F.col("last").alias("_last"), F.col("n").alias("_n"))
        grown = active.select("graph", "edge_id", "next", "n").join(ahead, ["graph", "next"])
        state = stash(grown.select("graph", "edge_id", F.col("_next").alias("next"), F.col("_last").alias("last"), (F.col("n") + F.col("_n")).alias("n")), "ranks")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, jumps


def _chains(entries: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(graph, edge_id, path) of ``entries`` (graph, edge_id, n): the n edges from each on, in order; every jump halves what is left, and rows made are the edges of the paths."""
    items = entries.select("graph", F.col("edge_id").alias("entry"), F.lit(0).cast("long").alias("pos"), "edge_id", "n")
    for r in range(len(jumps) - 1, -1, -1):
        far = jumps[r].select("graph", "edge_id", F.col("next").alias("_far"))
        parted = items.join(far, ["graph", "edge_id"], "left").withColumn("_cut", (F.col("n") > 1 << r) & F.col("_far").isNotNull())
        near = F.struct("pos", F.col("edge_id").alias("edge_id"), F.when(F.col("_cut"), F.lit(1 << r).cast("long")).otherwise(F.col("n")).alias("n"))
        rest = F.struct((F.col("pos") + (1 << r)).alias("pos"), F.col("_far").alias("edge_id"), (F.col("n") - (1 << r)).alias("n"))
        items = parted.select("graph", "entry", F.explode(F.when(F.col("_cut"), F.array(near, rest)).otherwise(F.array(near))).alias("x")).select("graph", "entry", "x.*")
        if r % 4 == 0:
            items = stash(items, "chains")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "edge_id"))), lambda x: x["edge_id"])
    return items.groupBy("graph", F.col("entry").alias("edge_id")).agg(ordered.alias("path"))


def _gap_runs(edges: DataFrame, keep_jumps: bool = False) -> tuple[DataFrame, list[DataFrame]]:
    """(graph, edge_id, from_id, p, last, n) of the gap edges by which a path can enter a run, with the run's last edge and how many it has, and the jumps of ``list_ranks``."""
    ways = edges.groupBy("graph", F.col("from_id").alias("to_id")).agg(F.count("*").alias("_n"), F.min("edge_id").alias("_only"), F.bool_and(F.col("symbol") == GAP).alias("_gap"))
    gaps = edges.where(F.col("symbol") == GAP)
    linked = gaps.join(ways, ["graph", "to_id"], "left").select("graph", "edge_id", F.when((F.col("_n") == 1) & F.col("_gap"), F.col("_only")).alias("next"))
    ranks, jumps = list_ranks(linked, keep_jumps)
    share = F.col("count") / F.sum("count").over(W.partitionBy("graph", "from_id"))
    out = edges.select("graph", "from_id", "edge_id", "symbol", share.alias("p")).where(F.col("symbol") == GAP).drop("symbol")
    # a path comes to a run over an edge that is no gap, or where the way before it parts
    solid = edges.where(F.col("symbol") != GAP).select("graph", F.col("to_id").alias("from_id")).distinct()
    parting = ways.where("_n > 1").select("graph", F.col("to_id").alias("from_id"))
    entered = out.join(solid.unionByName(parting).distinct(), ["graph", "from_id"], "left_semi")
    return stash(entered.join(ranks, ["graph", "edge_id"]), "entries"), jumps


def gap_steps(edges: DataFrame) -> DataFrame:
    """(graph, from_id, to_id, path, p): runs of gap edges as one step each, from where a path can enter them to the first node that goes on otherwise or in several ways.

    Within a run every node has one way on, so a step's share is that of its
    first edge. Edges without gaps give no rows.
    """
    entries, jumps = _gap_runs(edges, keep_jumps=True)
    ends = edges.select("graph", F.col("edge_id").alias("last"), "to_id")
    single = entries.where("n = 1").select("graph", "edge_id", F.array("edge_id").alias("path"))
    paths = single.unionByName(_chains(entries.where("n > 1"), jumps)) if jumps else single
    return entries.join(ends, ["graph", "last"]).join(paths, ["graph", "edge_id"]).select("graph", "from_id", "to_id", "path", "p")


def kmer_paths(edges: DataFrame, k: int, slices: int = 8) -> DataFrame:
    """(graph, level, first_edge, path, kmer, p) of every path of ``k`` symbols from every edge that is no gap.

    Gap edges add no symbol; a run of them is one step, however long. p is the
    product of the edges' shares after the first one. The frontier grows by one
    join at a time and is written every ``slices`` joins, until no path lacks
    symbols any more. Paths that the graph's end cuts short give no row, nor
    does an empty graph; rows with a null symbol, from_id or to_id are no edges.
    """
    edges = edges.where(F.col("symbol").isNotNull() & F.col("from_id").isNotNull() & F.col("to_id").isNotNull())
    out = F.sum("count").over(W.partitionBy("graph", "from_id"))
    steps = edges.select("graph", "from_id", "to_id", F.array("edge_id").alias("path"), (F.col("count") / out).alias("p"), "symbol").where(F.col("symbol") != GAP)
    if not edges.where(F.col("symbol") == GAP).isEmpty():
        steps = stash(steps.unionByName(gap_steps(edges).withColumn("symbol", F.lit(""))), "steps")
    steps = steps.select("graph", F.col("from_id").alias("_node"), F.col("to_id").alias("_to"), F.col("path").alias("_path"), F.col("p").alias("_p"), F.col("symbol").alias("_s"))
    front = edges.where(F.col("symbol") != GAP).select("graph", "level", F.col("edge_id").alias("first_edge"), F.array("edge_id").alias("path"), F.col("symbol").alias("kmer"), F.lit(1.0).alias("p"), F.col("to_id").alias("_node"))
    done, n = None, 0
    while True:
        n += 1
        ended = front.where(F.length("kmer") == k)
        done = ended if done is None else done.unionByName(ended)
        grown = front.where(F.length("kmer") < k).join(steps, ["graph", "_node"])
        front = grown.select("graph", "level", "first_edge", F.concat("path", "_path").alias("path"), F.concat("kmer", "_s").alias("kmer"), (F.col("p") * F.col("_p")).alias("p"), F.col("_to").alias("_node"))
        if n % slices == 0 or n >= k - 1:
            front, done = stash(front, "front"), stash(done, "paths")
            if front.isEmpty():
                return done.drop("_node")


def kmer_graph(edges: DataFrame, k: int) -> DataFrame:
    """Edges that emit k-mers: one for each path, between the paths of its first and last k - 1 symbols."""
    paths = kmer_paths(edges, k)
    real = edges.where(F.col("symbol") != GAP).select("graph", "edge_id").alias("e")
    solid = paths.withColumn("_id", F.xxhash64("graph", "path"))
    steps = solid.select("graph", "_id", F.posexplode("path").alias("_i", "edge_id")).join(real, ["graph", "edge_id"])
    trail = steps.groupBy("graph", "_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "edge_id"))), lambda x: x["edge_id"]).alias("_t"))
    return solid.join(trail, ["graph", "_id"]).select("graph", "level", F.col("_id").alias("edge_id"), F.xxhash64(F.slice("_t", 1, k - 1)).alias("from_id"), F.xxhash64(F.slice("_t", 2, k - 1)).alias("to_id"), F.col("kmer").alias("symbol"), F.col("p").alias("count"))


def kmer_index(edges: DataFrame, k: int) -> DataFrame:
    """(kmer, graph, level, path, unique): where a k-mer lies in the graph, and whether on one level only."""
    paths = kmer_paths(edges, k)
    levels = paths.groupBy("kmer").agg((F.countDistinct("graph", "level") == 1).alias("unique"))
    return paths.join(levels, "kmer").select("kmer", "graph", "level", "path", "unique")


def run_ends(edges: DataFrame, before_gap: int | None = None) -> DataFrame:
    """(graph, level) of the levels of nodes at which runs end: where some node has not exactly one edge in and one out; with ``before_gap``, also that many levels before each at which a gap begins.

    A gap begins at a node with a gap edge out, but where that is its only way
    and the only way in is a gap too.
    """
    ends = edges.select("graph", F.col("level").alias("level"), F.col("from_id").alias("node"), F.lit(0).alias("_in"), F.lit(1).alias("_out"), F.lit(False).alias("_gap_in"), (F.col("symbol") == GAP).alias("_gap_out"))
    starts = edges.select("graph", (F.col("level") + 1).alias("level"), F.col("to_id").alias("node"), F.lit(1).alias("_in"), F.lit(0).alias("_out"), (F.col("symbol") == GAP).alias("_gap_in"), F.lit(False).alias("_gap_out"))
    nodes = ends.unionByName(starts).groupBy("graph", "level", "node").agg(F.sum("_in").alias("_in"), F.sum("_out").alias("_out"), F.bool_or("_gap_in").alias("_gap_in"), F.bool_or("_gap_out").alias("_gap_out"))
    single = (F.col("_in") == 1) & (F.col("_out") == 1)
    cuts = nodes.where(~single).select("graph", "level")
    if before_gap is not None:
        # the first level has no way in, so no gap begins there
        begins = nodes.where(F.col("_gap_out") & ~(single & F.col("_gap_in")))
        first = edges.groupBy("graph").agg(F.min("level").alias("_first"))
        cuts = cuts.unionByName(begins.join(first, "graph").where(F.col("level") - before_gap > F.col("_first")).select("graph", (F.col("level") - before_gap).alias("level")))
    return cuts.distinct()


def collapsed(edges: DataFrame, before_gap: int | None = None) -> DataFrame:
    """(graph, first_edge, first_level, last_level, from_id, to_id, locus_id, count, symbols): unbranched runs of levels, each of their paths as one edge.

    A run goes on while every node of a level has one edge in and one out, so
    the arms of a bubble become an edge each; with ``before_gap`` one also ends
    so many levels before a gap begins. count and locus_id are those of a
    path's first edge, symbols those of all its edges with their numbers.
    Edges are put in their paths by pointer doubling, so no task holds a run.
    An empty graph gives no rows; edges need a symbol and both nodes.
    """
    ends = run_ends(edges, before_gap)
    # inside a run the node before an edge has one edge in: the edge before
    inside = edges.join(ends, ["graph", "level"], "left_anti").select("graph", "edge_id", F.col("from_id").alias("_node"))
    before = inside.join(edges.select("graph", F.col("to_id").alias("_node"), F.col("edge_id").alias("next")), ["graph", "_node"]).select("graph", "edge_id", "next")
    ranks, _ = list_ranks(edges.select("graph", "edge_id").join(before, ["graph", "edge_id"], "left"))
    rows = edges.join(ranks.select("graph", "edge_id", F.col("last").alias("first_edge")), ["graph", "edge_id"])
    ordered = rows.groupBy("graph", "first_edge", "symbol").agg(
        F.count("*").alias("_k"), F.min("level").alias("_a"), F.max("level").alias("_b"),
        F.min_by(F.struct("from_id", "locus_id", "count"), "level").alias("_first"), F.max_by("to_id", "level").alias("_to"),
    )
    symbols = sq.map_string(F.map_from_entries(F.collect_list(F.struct("symbol", "_k"))))
    made = ordered.groupBy("graph", "first_edge").agg(F.min("_a").alias("first_level"), F.max("_b").alias("last_level"), F.min_by("_first", "_a").alias("_f"), F.max_by("_to", "_b").alias("to_id"), symbols.alias("symbols"))
    return made.select("graph", "first_edge", "first_level", "last_level", F.col("_f.from_id").alias("from_id"), "to_id", F.col("_f.locus_id").alias("locus_id"), F.col("_f.count").alias("count"), "symbols")


# --- upkeep --------------------------------------------------------------------


def _span(edges: DataFrame) -> DataFrame:
    """(graph, first, n): each graph's first level and how many levels lie between it and its last one."""
    return edges.groupBy("graph").agg(F.min("level").alias("_first"), (F.max("level") - F.min("level") + 1).alias("_n"))


def block_ways(edges: DataFrame) -> list[DataFrame]:
    """(graph, n, block, from_id, to_id) for blocks of 1, 2, 4, ... levels: which nodes at a block's start lead to which at its end.

    Two neighbouring blocks' relations joined on the nodes between them are that
    of the block of both, so a graph of n levels takes log n joins. A graph's
    last block may be a short one. A block has at most as many rows as the
    product of the nodes at its ends.
    """
    span = _span(edges)
    most = span.agg(F.max("_n")).first()[0] or 0
    ways = [stash(edges.join(span, "graph").select("graph", "_n", (F.col("level") - F.col("_first")).cast("long").alias("block"), "from_id", "to_id").distinct(), "ways")]
    while 1 << len(ways) < most:
        size = 1 << (len(ways) - 1)
        rows = ways[-1]
        left, half = rows.where("block % 2 = 0"), (F.col("block") / 2).cast("long").alias("block")
        right = rows.where("block % 2 = 1").select("graph", (F.col("block") - 1).alias("block"), F.col("from_id").alias("_mid"), F.col("to_id").alias("_to"))
        both = left.withColumnRenamed("to_id", "_mid").join(right, ["graph", "block", "_mid"]).select("graph", "_n", half, "from_id", F.col("_to").alias("to_id")).distinct()
        alone = left.where((F.col("block") + 1) * size >= F.col("_n")).select("graph", "_n", half, "from_id", "to_id")
        ways.append(stash(both.unionByName(alone), "ways"))
    return ways


def _reached(edges: DataFrame, ways: list[DataFrame], back: bool) -> DataFrame:
    """(graph, level, node) of nodes between levels from which the last level's end is reached (``back``), or that the first level's start reaches; from the largest blocks to the smallest."""
    span = _span(edges)
    size = 1 << len(ways)
    side, at, other = ("to_id", F.col("_n"), "from_id") if back else ("from_id", F.lit(0), "to_id")
    ends = edges.join(span, "graph").where(F.col("level") == F.col("_first") + (F.col("_n") - 1 if back else 0))
    known = stash(ends.select("graph", at.cast("long").alias("at"), F.col(side).alias("node")).distinct(), "reached")
    for k, rows in enumerate(reversed(ways)):
        size //= 2
        end = F.least((F.col("block") + 1) * size, F.col("_n")).cast("long")
        # of two blocks the one whose far end is known tells the nodes between them
        mine = rows.where("block % 2 = 1") if back else rows.where((F.col("block") % 2 == 0) & (end < F.col("_n")))
        start = F.col("block") * size
        step = mine.select("graph", (end if back else start).alias("at"), F.col(side).alias("node"), (start if back else end).alias("_at"), F.col(other).alias("_node"))
        found = step.join(known, ["graph", "at", "node"], "left_semi").select("graph", F.col("_at").alias("at"), F.col("_node").alias("node")).distinct()
        known = known.unionByName(found)
        if k % 4 == 3:
            known = stash(known, "reached")
    return known.join(span, "graph").select("graph", (F.col("at") + F.col("_first")).cast("int").alias("level"), "node")


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges on a path to the last level.

    Blocks of levels are composed (``block_ways``) and then taken apart from the
    last level on, so a graph of n levels takes log n joins each way, whatever
    its size. An empty graph has no edges; a graph with a level without edges
    keeps those after it.
    """
    if edges.isEmpty():
        return edges
    alive = _reached(edges, block_ways(edges), back=True)
    after = alive.select("graph", (F.col("level") - 1).alias("level"), F.col("node").alias("to_id"))
    return edges.join(after, ["graph", "level", "to_id"], "left_semi").select(*edges.columns)


def reversed_graph(edges: DataFrame) -> DataFrame:
    """The graph read backwards: its last level first, edges the other way round."""
    span = edges.groupBy("graph").agg((F.min("level") + F.max("level")).alias("_s"))
    back = {"level": (F.col("_s") - F.col("level")).cast("int"), "from_id": F.col("to_id"), "to_id": F.col("from_id")}
    return edges.join(span, "graph").select(*[back.get(c, F.col(c)).alias(c) for c in edges.columns])


def connected(edges: DataFrame) -> DataFrame:
    """Edges on a path from the first level to the last; a graph without such a path has none."""
    if edges.isEmpty():
        return edges
    ways = block_ways(edges)
    after = _reached(edges, ways, back=True).select("graph", (F.col("level") - 1).alias("level"), F.col("node").alias("to_id"))
    before = _reached(edges, ways, back=False).select("graph", "level", F.col("node").alias("from_id"))
    return edges.join(after, ["graph", "level", "to_id"], "left_semi").join(before, ["graph", "level", "from_id"], "left_semi").select(*edges.columns)


def without_unknown(edges: DataFrame) -> DataFrame:
    """Edges less those of an unknown sign where their node has another way on, and what no path from end to end needs then."""
    known = edges.where(F.col("symbol") != UNKNOWN).select("graph", "from_id", F.lit(True).alias("_other")).distinct()
    kept = edges.join(known, ["graph", "from_id"], "left").where((F.col("symbol") != UNKNOWN) | F.col("_other").isNull()).select(*edges.columns)
    return connected(kept)


def without_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges less those of some nodes (graph, node), and what no path from end to end needs then."""
    gone = lambda c: nodes.select("graph", F.col("node").alias(c))
    return connected(edges.join(gone("from_id"), ["graph", "from_id"], "left_anti").join(gone("to_id"), ["graph", "to_id"], "left_anti").select(*edges.columns))


def pruned(edges: DataFrame, edge_kmers: DataFrame, seen: DataFrame, least_edges: int = 10, most_absent: float = 0.5, protected: DataFrame | None = None) -> DataFrame:
    """Edges of wide levels whose k-mers the sample mostly has; where a level would lose all its edges, the first level from there on that lost any is protected and all starts anew."""
    hits = edge_kmers.join(seen.select("kmer", F.lit(1).alias("_s")), "kmer", "left").groupBy("graph", "edge_id").agg(F.avg(F.when(F.col("_s").isNull(), 1.0).otherwise(0.0)).alias("absent"))
    width = edges.groupBy("graph", "level").agg(F.count("*").alias("_n"))
    levels = edges.select("graph", "level").distinct()
    kept = protected if protected is not None else levels.limit(0)
    for _ in range(100):
        drop = edges.join(width, ["graph", "level"]).where(F.col("_n") >= least_edges).join(kept, ["graph", "level"], "left_anti").join(hits, ["graph", "edge_id"]).where(F.col("absent") >= most_absent).select("graph", "edge_id")
        left = trimmed(edges.join(drop, ["graph", "edge_id"], "left_anti"))
        empty = stash(levels.join(left.select("graph", "level").distinct(), ["graph", "level"], "left_anti"), "empty")
        if not empty.limit(1).count():
            return left
        more = edges.join(drop, ["graph", "edge_id"], "left_semi").select("graph", "level").distinct()
        first = empty.groupBy("graph").agg(F.min("level").alias("_l"))
        kept = stash(kept.unionByName(more.join(first, "graph").where("level >= _l").groupBy("graph").agg(F.min("level").alias("level"))), "kept")
    raise RuntimeError("levels still empty")


def problems(edges: DataFrame) -> DataFrame:
    """(graph, problem, n): levels with several loci, nodes on several levels, starts and ends in the middle, counts that are not positive."""
    nodes = edges.select("graph", F.col("from_id").alias("node"), F.col("level").alias("at")).unionByName(edges.select("graph", F.col("to_id").alias("node"), (F.col("level") + 1).alias("at"))).distinct()
    span = edges.groupBy("graph").agg(F.min("level").alias("_a"), F.max("level").alias("_b"))
    count = lambda df, name: df.groupBy("graph").agg(F.count("*").alias("n")).select("graph", F.lit(name).alias("problem"), "n")
    loci = edges.groupBy("graph", "level").agg(F.countDistinct("locus_id").alias("k")).where("k > 1")
    spread = nodes.groupBy("graph", "node").agg(F.count("*").alias("k")).where("k > 1")
    keys = lambda c: edges.select("graph", F.col(c).alias("node")).distinct()
    ends = nodes.join(span, "graph").where("at <= _b").join(keys("from_id"), ["graph", "node"], "left_anti")
    starts = nodes.join(span, "graph").where("at > _a").join(keys("to_id"), ["graph", "node"], "left_anti")
    out = [count(loci, "several loci"), count(spread, "several levels"), count(ends, "dead end"), count(starts, "no way in"), count(edges.where("count <= 0"), "count")]
    for df in out[1:]:
        out[0] = out[0].unionByName(df)
    return out[0]


def drawing(edges: DataFrame, first: int, last: int) -> DataFrame:
    """(graph, at, line): the levels ``first`` to ``last`` of each graph in the language of a graph drawer, a line for each edge with its symbol and count."""
    part = edges.where(F.col("level").between(first, last))
    line = F.concat(F.lit("  n"), F.col("from_id").cast("string"), F.lit(" -> n"), F.col("to_id").cast("string"), F.lit(' [label="'), F.col("symbol"), F.lit(" "), F.col("count").cast("long").cast("string"), F.lit('"];'))
    rows = part.select("graph", F.concat_ws(":", F.lpad(F.col("level").cast("string"), 12, "0"), F.lpad(F.col("edge_id").cast("string"), 20, "0")).alias("at"), line.alias("line"))
    graphs = part.select("graph").distinct()
    head, tail = graphs.select("graph", F.lit("").alias("at"), F.concat(F.lit('digraph "'), F.col("graph"), F.lit('" {')).alias("line")), graphs.select("graph", F.lit("~").alias("at"), F.lit("}").alias("line"))
    return head.unionByName(rows).unionByName(tail)


def node_sums(edges: DataFrame) -> DataFrame:
    """(graph, node, outgoing, incoming) sums of counts."""
    a = edges.groupBy("graph", F.col("from_id").alias("node")).agg(F.sum("count").alias("outgoing"))
    b = edges.groupBy("graph", F.col("to_id").alias("node")).agg(F.sum("count").alias("incoming"))
    return a.join(b, ["graph", "node"], "full").select("graph", "node", F.coalesce("outgoing", F.lit(0.0)).alias("outgoing"), F.coalesce("incoming", F.lit(0.0)).alias("incoming"))


def with_gaps(edges: DataFrame, share: float = 0.1, seed: int = 1) -> DataFrame:
    """Edges of which a share, drawn by hash and so the same on every run, becomes a gap."""
    return edges.withColumn("symbol", F.when(draw(F.lit(seed), F.col("graph"), F.col("edge_id"), most=10_000) < int(share * 10_000), GAP).otherwise(F.col("symbol")))


def path_strings(path: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, hap, aligned, plain, label) of paths (graph, hap, level, edge_id): symbols in order of levels, with and without gaps, and the edges' loci."""
    rows = path.join(edges.select("graph", "edge_id", "symbol", "locus_id"), ["graph", "edge_id"])
    text = lambda c, sep: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("level", c))), lambda x: x[c]), sep)
    out = rows.groupBy("graph", "hap").agg(text("symbol", "").alias("aligned"), text("locus_id", ",").alias("label"))
    return out.withColumn("plain", F.translate("aligned", GAP, ""))


def genome_string(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, seg_ord, a1, a2) of two haplotypes: runs on which they agree once (a2 null), others with both."""
    rows = paths.join(edges.select("graph", "edge_id", "symbol"), ["graph", "edge_id"]).groupBy("graph", "level").pivot("hap", [1, 2]).agg(F.first("symbol"))
    same = F.col("1") == F.col("2")
    w = W.partitionBy("graph").orderBy("level")
    rows = rows.withColumn("_new", F.when(same == F.lag(same).over(w), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_same", same)
    text = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("level", c))), lambda x: x[c]), "")
    return rows.groupBy("graph", F.col("_run").alias("seg_ord"), "_same").agg(text("1").alias("a1"), text("2").alias("b")).select("graph", "seg_ord", "a1", F.when(~F.col("_same"), F.col("b")).alias("a2"))


def segments_to_edges(segments: DataFrame) -> DataFrame:
    """Edges of a genome string (graph, seg_ord, a1, a2): both alleles of a segment side by side, from one node to the next."""
    w = W.partitionBy("graph").orderBy("seg_ord").rowsBetween(W.unboundedPreceding, -1)
    rows = segments.withColumn("_o", F.coalesce(F.sum(F.length("a1")).over(w), F.lit(0)))
    alleles = rows.select("graph", "_o", F.length("a1").alias("_n"), F.posexplode(F.array_distinct(F.filter(F.array("a1", "a2"), lambda x: x.isNotNull()))).alias("_h", "_s"))
    steps = alleles.select("graph", "_o", "_n", "_h", F.posexplode(F.split("_s", "")).alias("_i", "symbol"))
    level = (F.col("_o") + F.col("_i")).cast("int")
    node = lambda at, edge: F.when(edge, at * 4).otherwise(at * 4 + F.col("_h") + 1).cast("long")
    return steps.select("graph", level.alias("level"), (level * 4 + F.col("_h")).cast("long").alias("edge_id"), node(level, F.col("_i") == 0).alias("from_id"), node(level + 1, F.col("_i") == F.col("_n") - 1).alias("to_id"), F.concat(F.lit("L"), level.cast("string")).alias("locus_id"), "symbol", F.lit(1.0).alias("count"))


def gap_reach(edges: DataFrame) -> DataFrame:
    """(graph, from_id, to_id): where gaps alone lead from the ends of edges that are none; a run of gaps is one step."""
    ends = edges.select("graph", F.col("edge_id").alias("last"), F.col("to_id").alias("_to"))
    steps = stash(_gap_runs(edges)[0].join(ends, ["graph", "last"]).select("graph", F.col("from_id").alias("_mid"), "_to").distinct(), "gaps")
    solid = edges.where(F.col("symbol") != GAP)
    front = stash(solid.select("graph", F.col("to_id").alias("from_id"), F.col("to_id").alias("_mid")).distinct().join(steps, ["graph", "_mid"]).select("graph", "from_id", F.col("_to").alias("to_id")).distinct(), "reach")
    known = front
    while not front.isEmpty():
        grown = front.withColumnRenamed("to_id", "_mid").join(steps, ["graph", "_mid"]).select("graph", "from_id", F.col("_to").alias("to_id")).distinct()
        front = stash(grown.join(known, ["graph", "from_id", "to_id"], "left_anti"), "reach")
        known = known.unionByName(front)
    return known


def sequences_present(sequences: DataFrame, edges: DataFrame, text: str = "seq") -> DataFrame:
    """``sequences`` with present: whether some path of some graph spells them; gaps spell nothing.

    Texts go as pieces of 1, 2, 4, ... signs. A piece's ways (graph, from, to)
    are those of its halves, joined on the node between them, so a text of n
    signs takes log n joins; a piece that many texts share is searched once, a
    text of which a piece has no way is not followed further, and neither the
    graph nor the texts are sent or collected. An empty text is present, null is
    not; repeated rows and other columns stay. Without edges no text of a sign
    is present.
    """
    texts = stash(sequences.select(F.col(text).alias("_text")).where("_text <> ''").distinct().withColumn("_id", F.monotonically_increasing_id()), "texts")
    solid = edges.where((F.col("symbol") != GAP) & F.col("from_id").isNotNull() & F.col("to_id").isNotNull())
    signs = texts.select("_id", F.posexplode(F.split("_text", "")).alias("at", "sign")).where("sign <> ''")
    names = stash(signs.select("sign").distinct().withColumn("piece", F.monotonically_increasing_id()), "pieces")  # a row for each sign
    pieces = stash(signs.join(names, "sign").select("_id", F.col("at").cast("long").alias("at"), "piece"), "texts")
    ways = solid.join(names, solid["symbol"] == names["sign"]).select("piece", "graph", "from_id", "to_id").distinct()
    if not edges.where(F.col("symbol") == GAP).isEmpty():
        # a way ends where its last sign does, or where gaps lead from there
        over = ways.join(gap_reach(edges).select("graph", F.col("from_id").alias("to_id"), F.col("to_id").alias("_to")), ["graph", "to_id"]).select("piece", "graph", "from_id", F.col("_to").alias("to_id"))
        ways = ways.unionByName(over).distinct()
    ways = stash(ways, "ways")
    longest = texts.agg(F.max(F.length("_text"))).first()[0] or 0
    alive = lambda: ways.select("piece").distinct()
    for _ in range(max(longest - 1, 0).bit_length()):
        lost = pieces.join(alive(), "piece", "left_anti").select("_id").distinct()
        odd = F.col("at") % 2
        halves = pieces.join(lost, "_id", "left_anti").groupBy("_id", F.floor(F.col("at") / 2).alias("at"))
        pairs = stash(halves.agg(F.max(F.when(odd == 0, F.col("piece"))).alias("_left"), F.max(F.when(odd == 1, F.col("piece"))).alias("_right")), "pairs")
        whole = stash(pairs.select("_left", "_right").distinct().withColumn("piece", F.monotonically_increasing_id()), "pieces")
        pieces = pairs.join(whole, (pairs["_left"] == whole["_left"]) & pairs["_right"].eqNullSafe(whole["_right"])).select("_id", "at", "piece")
        # halves meet at a node first, then only those that a text has next to one another stay
        left = ways.select(F.col("piece").alias("_left"), "graph", "from_id", F.col("to_id").alias("_mid")).join(whole.select("_left").distinct(), "_left", "left_semi")
        right = ways.select(F.col("piece").alias("_right"), "graph", F.col("from_id").alias("_mid"), "to_id").join(whole.select("_right").distinct(), "_right", "left_semi")
        met = left.join(right, ["graph", "_mid"]).join(whole.where("_right IS NOT NULL"), ["_left", "_right"]).select("piece", "graph", "from_id", "to_id").distinct()
        last = ways.withColumnRenamed("piece", "_left").join(whole.where("_right IS NULL"), "_left").select("piece", "graph", "from_id", "to_id")
        ways = stash(met.unionByName(last), "ways")
    found = pieces.join(alive(), "piece", "left_semi").select("_id")
    hits = found.join(texts, "_id").select(F.col("_text").alias(text), F.lit(True).alias("present"))
    kept = [c for c in sequences.columns if c != "present"]
    return sequences.select(*kept).join(hits, text, "left").select(*kept, F.coalesce("present", F.col(text) == "", F.lit(False)).alias("present"))


# --- de Bruijn graphs -------------------------------------------------------------


def de_bruijn(reads: DataFrame, k: int, text: str = "seq") -> DataFrame:
    """(kmer, coverage, right, left) of canonical k-mers: how often, and which bases follow and go before it, in its own orientation."""
    # positions 0 to n - k, each with the base after and before
    base = lambda s, i: F.when((i >= 1) & (i <= F.length(s)), F.substr(s, F.greatest(i, F.lit(1)), F.lit(1))).otherwise("")
    s = F.col(text)
    row = lambda i: F.struct(F.substr(s, i + 1, F.lit(k)).alias("w"), base(s, i + k + 1).alias("next"), base(s, i).alias("prev"))
    rows = reads.select(F.explode(F.transform(upto(F.length(s) - (k - 1)), row)).alias("x")).select("x.*").where(F.col("w").rlike("^[ACGT]+$"))
    own = F.col("w") <= sq.revcomp(F.col("w"))
    comp = lambda c: F.translate(c, sq.BASES, sq.COMPLEMENTS)
    kept = rows.select(sq.canonical(F.col("w")).alias("kmer"), F.when(own, F.col("next")).otherwise(comp(F.col("prev"))).alias("r"), F.when(own, F.col("prev")).otherwise(comp(F.col("next"))).alias("l"))
    side = lambda c: F.array_join(F.array_sort(F.array_remove(F.collect_set(c), "")), "")
    return kept.groupBy("kmer").agg(F.count("*").alias("coverage"), side("r").alias("right"), side("l").alias("left"))


def neighbours(table: DataFrame) -> DataFrame:
    """(kmer, base, neighbour, coverage): each step to the right that the table has, with the canonical k-mer it leads to."""
    steps = table.select("kmer", F.explode(F.split("right", "")).alias("base")).where("base <> ''")
    steps = steps.withColumn("neighbour", sq.canonical(F.concat(F.expr("substring(kmer, 2)"), F.col("base"))))
    return steps.join(table.select(F.col("kmer").alias("neighbour"), "coverage"), "neighbour").select("kmer", "base", "neighbour", "coverage")


def without_errors(table: DataFrame, least: int = 2) -> DataFrame:
    """K-mers seen at least ``least`` times, with edges among themselves only."""
    kept = table.where(F.col("coverage") >= least)
    have = kept.select(F.col("kmer").alias("_n"))

    def side(name: str, make) -> DataFrame:
        steps = kept.select("kmer", F.explode(F.split(name, "")).alias("b")).where("b <> ''").withColumn("_n", sq.canonical(make(F.col("b")))).join(have, "_n")
        return steps.groupBy("kmer").agg(F.array_join(F.array_sort(F.collect_set("b")), "").alias(name))

    right = side("right", lambda b: F.concat(F.expr("substring(kmer, 2)"), b))
    left = side("left", lambda b: F.concat(b, F.expr("substring(kmer, 1, length(kmer) - 1)")))
    return kept.select("kmer", "coverage").join(right, "kmer", "left").join(left, "kmer", "left").select("kmer", "coverage", F.coalesce("right", F.lit("")).alias("right"), F.coalesce("left", F.lit("")).alias("left"))


def supernodes(table: DataFrame, rounds: int = 64) -> DataFrame:
    """(supernode, n, coverage): maximal runs of k-mers joined by steps that branch at neither end, named by their smallest k-mer."""
    ends = table.select("kmer", F.length("right").alias("_r"), F.length("left").alias("_l"))
    right = table.select("kmer", F.col("right").alias("b")).where("length(b) = 1").select("kmer", F.concat(F.expr("substring(kmer, 2)"), "b").alias("_raw"))
    left = table.select("kmer", F.col("left").alias("b")).where("length(b) = 1").select("kmer", F.concat("b", F.expr("substring(kmer, 1, length(kmer) - 1)")).alias("_raw"))
    steps = right.withColumn("way", F.lit("r")).unionByName(left.withColumn("way", F.lit("l"))).withColumn("other", sq.canonical(F.col("_raw")))
    # arriving from the left in its own orientation meets its left end, in the other its right end
    enters_left = (F.col("way") == "r") == (F.col("_raw") == F.col("other"))
    joined = steps.join(ends.select(F.col("kmer").alias("other"), "_r", "_l"), "other").where(F.when(enters_left, F.col("_l")).otherwise(F.col("_r")) == 1).where("kmer <> other")
    pairs = stash(joined.select("kmer", "other").unionByName(joined.select(F.col("other").alias("kmer"), F.col("kmer").alias("other"))).distinct(), "steps")
    names = stash(table.select("kmer", F.col("kmer").alias("name")), "names")
    for _ in range(rounds):
        ends = pairs.join(names.select("kmer", F.col("name").alias("_a")), "kmer").join(names.select(F.col("kmer").alias("other"), F.col("name").alias("_b")), "other").where("_b < _a")
        heard = ends.select(F.explode(F.array("kmer", "_a")).alias("kmer"), "_b").groupBy("kmer").agg(F.min("_b").alias("_h"))
        low = names.join(heard, "kmer", "left").select("kmer", F.col("name").alias("_was"), F.least("name", F.coalesce("_h", "name")).alias("name"))
        jump = low.select(F.col("kmer").alias("name"), F.col("name").alias("_j"))
        after = stash(low.join(jump, "name", "left").select("kmer", "_was", F.least("name", "_j").alias("name")), "names")
        names = after.select("kmer", "name")
        if not after.where("name < _was").limit(1).count():
            return names.join(table.select("kmer", "coverage"), "kmer").groupBy(F.col("name").alias("supernode")).agg(F.count("*").alias("n"), F.sum("coverage").alias("coverage"))
    raise RuntimeError(f"names still move after {rounds} rounds")


def presence(sequences: DataFrame, table: DataFrame, k: int, key: str = "seq_id", text: str = "seq") -> DataFrame:
    """(key, n, present, invalid, mean_coverage) of sequences' k-mers in a de Bruijn table."""
    rows = sequences.select(key, F.explode(sq.kmers(F.col(text), k)).alias("w")).select(key, "w", sq.canonical(F.col("w")).alias("kmer"))
    hit = rows.join(table.select("kmer", "coverage"), "kmer", "left")
    valid: Column = sq.is_valid_kmer(F.col("w"))
    return hit.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.when(F.col("coverage").isNotNull(), 1).otherwise(0)).alias("present"), F.sum(F.when(valid, 0).otherwise(1)).alias("invalid"), F.avg(F.coalesce("coverage", F.lit(0))).alias("mean_coverage"))




def within_steps(table: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, kmer, steps): k-mers of a de Bruijn table that so many steps or fewer lead to from each start (kmer), either way along; the fewest steps."""
    right = neighbours(table).select("kmer", F.col("neighbour").alias("other"))
    left = table.select("kmer", F.explode(F.split("left", "")).alias("b")).where("b <> ''").select("kmer", sq.canonical(F.concat(F.col("b"), F.expr("substring(kmer, 1, length(kmer) - 1)"))).alias("other"))
    steps = stash(right.unionByName(left.join(table.select(F.col("kmer").alias("other")), "other", "left_semi").select("kmer", "other")).distinct(), "steps")
    known = table.select("kmer").join(starts.select("kmer"), "kmer", "left_semi").select(F.col("kmer").alias("start"), "kmer", F.lit(0).alias("steps"))
    front = known
    for n in range(1, depth + 1):
        grown = front.select("start", "kmer").join(steps, "kmer").select("start", F.col("other").alias("kmer")).distinct()
        front = stash(grown.join(known.select("start", "kmer"), ["start", "kmer"], "left_anti").withColumn("steps", F.lit(n)), "front")
        if not front.limit(1).count():
            break
        known = known.unionByName(front)
    return known


def random_walks(table: DataFrame, starts: DataFrame, length: int, seed: int = 1) -> DataFrame:
    """(start, step, kmer) of a walk from each start (kmer) to the right, each step drawn among those the table has by their coverage; a walk ends where there is none."""
    steps = stash(neighbours(table).select("kmer", "neighbour", "coverage"), "steps")
    front = table.select("kmer").join(starts.select("kmer"), "kmer", "left_semi").select(F.col("kmer").alias("start"), F.lit(0).alias("step"), "kmer")
    out = front
    for n in range(1, length + 1):
        u = (draw(F.lit(seed), F.col("start"), F.lit(n), F.col("neighbour")) + 1) / 1_000_001.0
        # the largest of u ** (1 / weight) is drawn in proportion to the weights
        near = front.select("start", "kmer").join(steps, "kmer").withColumn("_u", F.pow(u, 1.0 / F.col("coverage")))
        front = stash(near.groupBy("start").agg(F.max_by("neighbour", F.struct("_u", "neighbour")).alias("kmer")).select("start", F.lit(n).alias("step"), "kmer"), "front")
        if not front.limit(1).count():
            break
        out = out.unionByName(front)
    return out
