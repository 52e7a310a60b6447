"""Alignment of sequences to sequences and to levelled graphs."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import sequences as sq
from strandlake.lineage import stash
from strandlake.operators.graph import list_ranks

# Scores of a match, a mismatch, an opened gap and each of its signs; a gap at an anchored end.
MATCH, MISMATCH, OPEN, EXTEND, ANCHOR = 2.0, -5.0, -4.0, -2.0, -1000.0
GAP = "_"


def needleman_wunsch(a: str, b: str, anchored: bool = True) -> tuple[float, str, str]:
    """Score and both aligned strings of a global alignment with affine gaps; with ``anchored`` no gap may stand at the start of either."""
    n, m = len(a), len(b)
    inf = -math.inf
    best = np.full((3, n + 1, m + 1), inf)
    best[0, 0, 0] = 0
    first = ANCHOR if anchored else 0.0
    for i in range(1, n + 1):
        best[1, i, 0] = first + OPEN + EXTEND * i
    for j in range(1, m + 1):
        best[2, 0, j] = first + OPEN + EXTEND * j
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[0, i, j] = best[:, i - 1, j - 1].max() + (MATCH if a[i - 1] == b[j - 1] else MISMATCH)
            best[1, i, j] = max(best[0, i - 1, j] + OPEN, best[1, i - 1, j], best[2, i - 1, j] + OPEN) + EXTEND
            best[2, i, j] = max(best[0, i, j - 1] + OPEN, best[2, i, j - 1], best[1, i, j - 1] + OPEN) + EXTEND
    i, j, k = n, m, int(best[:, n, m].argmax())
    score, x, y = float(best[k, n, m]), [], []
    while i or j:
        if k == 0:
            i, j, k = i - 1, j - 1, int(best[:, i - 1, j - 1].argmax())
            x.append(a[i])
            y.append(b[j])
        elif k == 1:
            from_ = best[:, i - 1, j] + np.array([OPEN, 0, OPEN])
            i, k = i - 1, int(from_.argmax())
            x.append(a[i])
            y.append(GAP)
        else:
            from_ = best[:, i, j - 1] + np.array([OPEN, OPEN, 0])
            j, k = j - 1, int(from_.argmax())
            x.append(GAP)
            y.append(b[j])
    return score, "".join(reversed(x)), "".join(reversed(y))


def aligned_pairs(pairs: DataFrame, key: str, a: str = "a", b: str = "b", anchored: bool = True) -> DataFrame:
    """(key, score, a, b) of the pairs' global alignments."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(k, *needleman_wunsch(x or "", y or "", anchored)) for k, x, y in zip(p[key], p[a], p[b], strict=True)]
            yield pd.DataFrame(rows, columns=[key, "score", "a", "b"])

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, a, b).mapInPandas(run, f"{key} {kind}, score double, a string, b string")


@dataclass
class Graph:
    """Edges in order of their levels, and those that enter each node."""

    edges: list[tuple[int, int, int, str, int]]  # level, from, to, symbol, edge_id
    into: dict[int, list[int]] = field(default_factory=lambda: defaultdict(list))
    order: list[int] = field(default_factory=list)
    level: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.edges.sort()
        for k, (level, a, b, _, _) in enumerate(self.edges):
            self.into[b].append(k)
            self.level.setdefault(a, level)
            self.level[b] = level + 1
        self.order = sorted(self.level, key=lambda v: (self.level[v], v))


def align_to_graph(text: str, graph: Graph, ends_free: bool = True, starts: set[int] | None = None, ends: set[int] | None = None) -> tuple[float, str, str, list[int]] | None:
    """Best alignment of a whole sequence to some path: score, graph and sequence strings, and levels (-1 where the graph has no sign).

    Gap edges cost nothing; a sign of the sequence that no edge takes, or an
    edge that no sign takes, opens or extends an affine gap. With ``ends_free``
    the path may begin and end on any level; ``starts`` and ``ends`` name the
    nodes where it must.
    """
    n = len(text)
    if not graph.edges or not n and not (starts and ends):
        return None
    first = min(graph.level.values())
    begins = lambda v: v in starts if starts is not None else ends_free or graph.level[v] == first
    signs = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    inf = -np.inf
    m, d, s = {}, {}, {}  # match, edge without sign, sign without edge
    insert = OPEN + EXTEND * np.arange(n + 1)
    insert[0] = 0

    def inserted(base: np.ndarray) -> np.ndarray:
        """Best of opening an insertion anywhere before, by a running maximum."""
        shift = EXTEND * np.arange(n + 1)
        run = np.maximum.accumulate(base - shift)
        out = np.full(n + 1, inf)
        out[1:] = run[:-1] + shift[1:] + OPEN
        return out

    for v in graph.order:
        a, b = np.full(n + 1, inf), np.full(n + 1, inf)
        if begins(v):
            a[0] = 0.0
        for k in graph.into[v]:
            _, u, _, symbol, _ = graph.edges[k]
            top = np.maximum(np.maximum(m[u], d[u]), s[u])
            if symbol == GAP:
                a, b = np.maximum(a, np.maximum(m[u], s[u])), np.maximum(b, d[u])
                continue
            step = np.where(signs == ord(symbol), MATCH, MISMATCH)
            a[1:] = np.maximum(a[1:], top[:-1] + step)
            b = np.maximum(b, np.maximum(np.maximum(m[u], s[u]) + OPEN, d[u]) + EXTEND)
        m[v], d[v] = a, b
        s[v] = inserted(np.maximum(a, b))
    last = max(graph.level.values())
    stops = [v for v in graph.order if (v in ends if ends is not None else ends_free or graph.level[v] == last)]
    top = lambda v, j: max(m[v][j], d[v][j], s[v][j])
    v = max(stops, key=lambda x: (top(x, n), -graph.level[x], -x))
    score = float(top(v, n))
    if not math.isfinite(score):
        return None
    g, q, levels = [], [], []
    j, state = n, max((m[v][n], 2, "m"), (d[v][n], 1, "d"), (s[v][n], 0, "s"))[2]
    near = lambda x, y: math.isfinite(x) and abs(x - y) < 1e-9
    while True:
        here = {"m": m, "d": d, "s": s}[state][v][j]
        if state == "m" and j == 0 and here == 0 and begins(v):
            break
        if state == "s":
            for i in range(j - 1, -1, -1):
                base = max(m[v][i], d[v][i])
                if near(base + OPEN + EXTEND * (j - i), here):
                    g += [GAP] * (j - i)
                    q += list(reversed(text[i:j]))
                    levels += [-1] * (j - i)
                    j, state = i, "m" if m[v][i] >= d[v][i] else "d"
                    break
            continue
        for k in graph.into[v]:
            level, u, _, symbol, _ = graph.edges[k]
            if symbol == GAP:
                options = [(m[u][j], "m"), (s[u][j], "s")] if state == "m" else [(d[u][j], "d")]
                hit = next((t for x, t in options if near(x, here)), None)
                if hit:
                    g.append(GAP)
                    q.append(GAP)
                    levels.append(level)
                    v, state = u, hit
                    break
            elif state == "m" and j:
                step = MATCH if text[j - 1] == symbol else MISMATCH
                hit = next((t for t, x in (("m", m), ("d", d), ("s", s)) if near(x[u][j - 1] + step, here)), None)
                if hit:
                    g.append(symbol)
                    q.append(text[j - 1])
                    levels.append(level)
                    v, j, state = u, j - 1, hit
                    break
            elif state == "d":
                hit = next((t for t, x, c in (("d", d, 0.0), ("m", m, OPEN), ("s", s, OPEN)) if near(x[u][j] + c + EXTEND, here)), None)
                if hit:
                    g.append(symbol)
                    q.append(GAP)
                    levels.append(level)
                    v, state = u, hit
                    break
        else:
            raise AssertionError("no way back")
    return score, "".join(reversed(g)), "".join(reversed(q)), levels[::-1]


def _reverse(s: str) -> str:
    return s[::-1].translate(str.maketrans(sq.BASES, sq.COMPLEMENTS))


def aligned_reads(reads: DataFrame, edges: DataFrame, most_edges: int = 500_000) -> DataFrame:
    """(read_id, score, reverse, g, s, levels) of reads on the strand that scores higher, forward at a tie.

    A region's graph goes to every task, so its size is checked first.
    """
    rows = [(r.level, r.from_id, r.to_id, r.symbol, r.edge_id) for r in edges.select("level", "from_id", "to_id", "symbol", "edge_id").limit(most_edges + 1).collect()]
    if len(rows) > most_edges:
        raise ValueError(f"more than {most_edges} edges; align by segments")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = Graph(list(rows))
        for p in parts:
            out = []
            for key, seq in zip(p["read_id"], p["seq"], strict=True):
                both = [(align_to_graph(x, graph), r) for r, x in ((False, seq or ""), (True, _reverse(seq or "")))]
                hits = [(a[0], not r, a, r) for a, r in both if a]
                if hits:
                    _, _, a, r = max(hits, key=lambda h: h[:2])
                    out.append((key, a[0], r, a[1], a[2], a[3]))
            yield pd.DataFrame(out, columns=["read_id", "score", "reverse", "g", "s", "levels"])

    kind = reads.schema["read_id"].dataType.simpleString()
    return reads.select("read_id", "seq").mapInPandas(run, f"read_id {kind}, score double, reverse boolean, g string, s string, levels array<int>")


def seed_chains(reads: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(read_id, graph, diagonal, first_pos, last_pos, first_level, n) of runs of consecutive seeds on a diagonal (level less position), for graphs whose levels advance with each sign."""
    seeds = reads.select("read_id", F.posexplode(sq.kmers(F.col("seq"), k)).alias("pos", "kmer")).join(index.select("kmer", "graph", "level").distinct(), "kmer")
    rows = seeds.select("read_id", "graph", "pos", "level", (F.col("level") - F.col("pos")).alias("diagonal"))
    rank = F.row_number().over(W.partitionBy("read_id", "graph", "diagonal").orderBy("pos"))
    runs = rows.withColumn("_g", F.col("pos") - rank)
    return runs.groupBy("read_id", "graph", "diagonal", "_g").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min("level").alias("first_level"), F.count("*").alias("n")).drop("_g")


def chains_in_graph(reads: DataFrame, kmers: DataFrame, k: int) -> DataFrame:
    """(read_id, graph, first_pos, last_pos, first_level, last_level, n) of chains of seeds in any graph: k-mers of a read, one sign apart, whose paths overlap in all but their ends.

    ``kmers`` has the edges of ``graph.kmer_graph``, whose nodes are the k - 1
    solid edges that two such paths share, so that one seed follows another is
    an equality of nodes, over gaps and bubbles too, and no edge list leaves its
    partition. A chain ends where a seed has several followers, or its follower
    several before it; chains are put together by pointer doubling. k is 2 or
    more. Reads that repeat a read_id are one read; reads without a text, or
    shorter than k, have no seeds; no reads or no k-mers give no rows.
    """
    # ways over different gaps are one seed
    index = kmers.select("graph", "level", "from_id", "to_id", F.col("symbol").alias("kmer")).distinct()
    seeds = reads.select("read_id", F.posexplode(sq.kmers(F.col("seq"), k)).alias("pos", "kmer")).distinct().join(index, "kmer").drop("kmer")
    seeds = stash(seeds.withColumn("seed", F.monotonically_increasing_id()), "seeds")
    after = seeds.select("read_id", "graph", (F.col("pos") - 1).alias("pos"), F.col("from_id").alias("to_id"), F.col("seed").alias("next"))
    links = stash(seeds.select("read_id", "graph", "pos", "to_id", "seed").join(after, ["read_id", "graph", "pos", "to_id"]).select("seed", "next"), "links")
    single = lambda c: links.groupBy(c).agg(F.count("*").alias("_n")).where("_n = 1").select(c)
    before = links.join(single("seed"), "seed").join(single("next"), "next").select(F.col("next").alias("edge_id"), F.col("seed").alias("next"))
    rows = seeds.select(F.lit("").alias("graph"), F.col("seed").alias("edge_id")).join(before, "edge_id", "left")
    heads = list_ranks(rows)[0].select(F.col("edge_id").alias("seed"), F.col("last").alias("_head"))
    return seeds.join(heads, "seed").groupBy("read_id", "graph", "_head").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min("level").alias("first_level"), F.max("level").alias("last_level"), F.count("*").alias("n")).drop("_head")


def best_chains(chains: DataFrame, most: int = 15) -> DataFrame:
    """The longest chains of each read with their rank; ties by the earlier place."""
    order = W.partitionBy("read_id").orderBy(F.col("n").desc(), "first_level", "first_pos")
    return chains.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def alignment_quality(alignments: DataFrame) -> DataFrame:
    """Alignments (read_id, g, s, ...) with the share of columns that agree and whether all do."""
    ok = sq.fraction_ok(F.col("g"), F.col("s"))
    return alignments.withColumn("fraction_ok", ok).withColumn("perfect", ok == 1.0)
