"""Seed and extend: reads on a levelled graph by exact chains, and alignment only of what lies between them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from strandlake.functions import sequences as sq
from strandlake.operators.align import EXTEND, GAP, MATCH, OPEN, Graph, align_to_graph

Edge = tuple[int, int, int, str, int]  # level, from, to, symbol, edge_id


@dataclass
class Chain:
    """Edges whose symbols spell a part of a sequence without an error; it begins at ``begin`` and has ``n`` signs."""

    begin: int
    n: int
    edges: list[Edge]

    @property
    def end(self) -> int:
        return self.begin + self.n

    @property
    def first(self) -> int:
        return self.edges[0][1]

    @property
    def last(self) -> int:
        return self.edges[-1][2]

    def without(self, signs: int) -> Chain | None:
        """The chain less its first signs; none if nothing is left."""
        left, k = signs, 0
        while k < len(self.edges) and (left or self.edges[k][3] == GAP):
            left -= self.edges[k][3] != GAP
            k += 1
        return Chain(self.begin + signs, self.n - signs, self.edges[k:]) if k < len(self.edges) else None


class Seeds:
    """A graph with an index of its k-mers: the edges that each begins with. Gap edges spell nothing and are passed over."""

    def __init__(self, edges: list[Edge], k: int):
        self.k = k
        self.out: dict[int, list[Edge]] = defaultdict(list)
        self.into: dict[int, list[Edge]] = defaultdict(list)
        for e in edges:
            self.out[e[1]].append(e)
            self.into[e[2]].append(e)
        self.level = {e[1]: e[0] for e in edges} | {e[2]: e[0] + 1 for e in edges if e[2] not in self.out}
        self._next: dict[int, list[tuple[Edge, ...]]] = {}
        self.index: dict[str, list[Edge]] = defaultdict(list)
        for e in edges:
            if e[3] != GAP:
                for word in self._words(e):
                    self.index[word].append(e)

    def steps(self, node: int) -> list[tuple[Edge, ...]]:
        """Ways from a node to the next sign: gap edges, then one with a sign; of several ways to the same edge, one."""
        if node not in self._next:
            found: dict[Edge, tuple[Edge, ...]] = {}
            live: list[tuple[Edge, ...]] = [(e,) for e in self.out.get(node, ())]
            seen = set()
            while live:
                way = live.pop()
                tip = way[-1]
                if tip[3] != GAP:
                    found.setdefault(tip, way)
                elif tip[2] not in seen:
                    seen.add(tip[2])
                    live += [(*way, e) for e in self.out.get(tip[2], ())]
            self._next[node] = list(found.values())
        return self._next[node]

    def _words(self, first: Edge) -> set[str]:
        """K-mers that begin with an edge."""
        live = {(first[2], first[3])}
        for _ in range(self.k - 1):
            live = {(way[-1][2], word + way[-1][3]) for node, word in live for way in self.steps(node)}
        return {word for _, word in live}

    def hits(self, text: str) -> int:
        return sum(text[i : i + self.k] in self.index for i in range(len(text) - self.k + 1))

    def chains(self, text: str) -> list[Chain]:
        """Maximal chains of a sequence, each begun by a k-mer that no chain before it runs through at that edge; of ways that meet in a node at one sign, one."""
        found, covered = [], set()
        for i in range(len(text) - self.k + 1):
            for seed in self.index.get(text[i : i + self.k], ()):
                if (i, seed) in covered:
                    continue
                live, n = {seed[2]: [seed]}, 1
                covered.add((i, seed))
                while live:
                    grown: dict[int, list[Edge]] = {}
                    for node, edges in live.items():
                        ways = [w for w in self.steps(node) if i + n < len(text) and w[-1][3] == text[i + n]]
                        if not ways and n >= self.k:
                            found.append(Chain(i, n, edges))
                        for w in ways:
                            covered.add((i + n, w[-1]))
                            grown.setdefault(w[-1][2], [*edges, *w])
                    live, n = grown, n + 1
        return found

    def near(self, node: int, signs: int, ahead: bool) -> list[Edge]:
        """Edges within so many signs of a node, gap edges not counted."""
        best, live, edges = {node: 0}, [node], set()
        while live:
            v = live.pop()
            for e in (self.out if ahead else self.into).get(v, ()):
                far = best[v] + (e[3] != GAP)
                if far > signs:
                    continue
                edges.add(e)
                u = e[2] if ahead else e[1]
                if far < best.get(u, signs + 1):
                    best[u] = far
                    live.append(u)
        return sorted(edges)

    def between(self, a: int, b: int) -> list[Edge]:
        """Edges on a path from one node to another."""
        if self.level[a] >= self.level[b]:
            return []
        reach, back, edges = {a}, {b}, []
        for e in self._levels(a, self.level[b]):
            if e[1] in reach:
                reach.add(e[2])
                edges.append(e)
        kept = []
        for e in reversed(edges):
            if e[2] in back:
                back.add(e[1])
                kept.append(e)
        return kept[::-1]

    def _levels(self, a: int, stop: int) -> list[Edge]:
        """Edges reachable from a node before a level, in order of levels."""
        seen, live, edges = {a}, [a], []
        while live:
            after = []
            for v in live:
                for e in self.out.get(v, ()):
                    if e[0] < stop:
                        edges.append(e)
                        if e[2] not in seen:
                            seen.add(e[2])
                            after.append(e[2])
            live = after
        return edges


Part = tuple[float, str, str, list[int]]


def _spelled(chain: Chain) -> Part:
    g = "".join(e[3] for e in chain.edges)
    return MATCH * chain.n, g, g, [e[0] for e in chain.edges]


def _inserted(text: str) -> Part:
    return (OPEN + EXTEND * len(text) if text else 0.0), GAP * len(text), text, [-1] * len(text)


def _filled(seeds: Seeds, text: str, a: int, b: int) -> Part | None:
    """Best alignment of what lies between two chains to the paths between them; none where there is no path."""
    if a == b:
        return _inserted(text)
    edges = seeds.between(a, b)
    return align_to_graph(text, Graph(edges), starts={a}, ends={b}) if edges else None


def _end(seeds: Seeds, text: str, node: int, ahead: bool) -> Part:
    """Best alignment of a sequence's end beyond a chain. No better path passes over more signs than it could win back."""
    if not text:
        return 0.0, "", "", []
    edges = seeds.near(node, 2 * len(text), ahead)
    plain = _inserted(text)
    found = align_to_graph(text, Graph(edges), starts={node}) if edges and ahead else align_to_graph(text, Graph(edges), ends={node}) if edges else None
    return found if found and found[0] > plain[0] else plain


def _ordered(chains: list[Chain], seeds: Seeds, barred: set[tuple[int, int]]) -> list[int]:
    """Numbers of the chains that together score best in order of sequence and graph, estimated; pairs that are barred do not follow one another."""
    order = sorted(range(len(chains)), key=lambda k: (chains[k].begin, chains[k].end))
    best: dict[int, tuple[float, int | None]] = {}
    for at, j in enumerate(order):
        c = chains[j]
        best[j] = (MATCH * c.n, None)
        for i in order[:at]:
            p = chains[i]
            lap = max(0, p.end - c.begin)
            if (i, j) in barred or p.begin >= c.begin or c.end <= p.end or seeds.level[p.last] > seeds.level[c.first] + lap + sum(e[3] == GAP for e in c.edges):
                continue
            skew = abs((c.begin + lap - p.end) - max(0, seeds.level[c.first] + lap - seeds.level[p.last]))
            score = best[i][0] + MATCH * (c.n - lap) + (OPEN + EXTEND * skew if skew else 0.0)
            if score > best[j][0]:
                best[j] = (score, i)
    k: int | None = max(best, key=lambda j: (best[j][0], -seeds.level[chains[j].first]))
    out = []
    while k is not None:
        out.append(k)
        k = best[k][1]
    return out[::-1]


def extend(text: str, seeds: Seeds) -> Part | None:
    """Score, graph and sequence strings, and levels of a whole sequence: the best chains in order, what lies between two of them and beyond the ends aligned to the graph there. None without a chain."""
    chains = seeds.chains(text)
    if not chains:
        return None
    barred: set[tuple[int, int]] = set()
    while True:
        picked = _ordered(chains, seeds, barred)
        parts, last = [_spelled(chains[picked[0]])], chains[picked[0]]
        for i, j in zip(picked[:-1], picked[1:], strict=True):
            c = chains[j].without(max(0, last.end - chains[j].begin))
            fill = _filled(seeds, text[last.end : c.begin], last.last, c.first) if c else None
            if fill is None:
                barred.add((i, j))
                break
            parts += [fill, _spelled(c)]
            last = c
        else:
            first = chains[picked[0]]
            whole = [_end(seeds, text[: first.begin], first.first, False), *parts, _end(seeds, text[last.end :], last.last, True)]
            return sum(p[0] for p in whole), "".join(p[1] for p in whole), "".join(p[2] for p in whole), [x for p in whole for x in p[3]]


def _reverse(s: str) -> str:
    return s[::-1].translate(str.maketrans(sq.BASES, sq.COMPLEMENTS))


def align(text: str, seeds: Seeds) -> tuple[Part, bool] | None:
    """The alignment on the strand with more k-mers in the graph, and whether that is the reverse one; on both at a tie, and the better one, forward if they are alike."""
    sides = [(seeds.hits(s), r, s) for r, s in ((False, text), (True, _reverse(text)))]
    top = max(n for n, _, _ in sides)
    found = [(extend(s, seeds), r) for n, r, s in sides if n == top and n]
    found = [(a, r) for a, r in found if a]
    return max(found, key=lambda x: (x[0][0], not x[1])) if found else None


_MADE: dict[int, Seeds] = {}


def seeded_reads(reads: DataFrame, edges: DataFrame, k: int = 25, most_edges: int = 500_000) -> DataFrame:
    """(read_id, score, reverse, g, s, levels) of reads (read_id, seq) by seed and extend; reads without a k-mer of the graph are left out.

    A region's graph, whose size is checked, goes to every executor once, and
    its index is made once by each worker.
    """
    rows = [tuple(r) for r in edges.select("level", "from_id", "to_id", "symbol", "edge_id").limit(most_edges + 1).collect()]
    if len(rows) > most_edges:
        raise ValueError(f"more than {most_edges} edges; align by segments")
    shared = reads.sparkSession.sparkContext.broadcast(rows)
    number = shared._jbroadcast.id()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if number not in _MADE:
            _MADE.clear()
            _MADE[number] = Seeds(shared.value, k)
        for p in parts:
            out = []
            for key, seq in zip(p["read_id"], p["seq"], strict=True):
                hit = align(seq or "", _MADE[number])
                if hit:
                    (score, g, s, levels), reverse = hit
                    out.append((key, score, reverse, g, s, levels))
            yield pd.DataFrame(out, columns=["read_id", "score", "reverse", "g", "s", "levels"])

    kind = reads.schema["read_id"].dataType.simpleString()
    return reads.select("read_id", "seq").mapInPandas(run, f"read_id {kind}, score double, reverse boolean, g string, s string, levels array<int>")
