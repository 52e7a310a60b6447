"""Runs of gaps and of unbranched levels, against plain walks."""

import random
from collections import Counter, defaultdict

import pytest

from strandlake.operators import graph


def frame(spark, rows):
    return spark.createDataFrame(rows, graph.EDGES)


def edge(level, number, a, b, symbol, count=1.0, name="g"):
    return (name, level, number, a, b, f"L{level}", symbol, count)


def plain_paths(rows, k):
    out = defaultdict(list)
    for r in rows:
        out[r[0], r[3]].append(r)
    total = {n: sum(r[7] for r in rs) for n, rs in out.items()}
    found = []

    def walk(g, level, first, path, kmer, p, node):
        if len(kmer) == k:
            found.append((g, level, first, tuple(path), kmer, round(p, 9)))
            return
        for r in out[g, node]:
            walk(g, level, first, path + [r[2]], kmer + r[6].replace("_", ""), p * r[7] / total[g, node], r[4])

    for r in rows:
        if r[6] != "_":
            walk(r[0], r[1], r[2], [r[2]], r[6], 1.0, r[4])
    return sorted(found)


def made_paths(df, k, **more):
    return sorted((r.graph, r.level, r.first_edge, tuple(r.path), r.kmer, round(r.p, 9)) for r in graph.kmer_paths(df, k, **more).collect())


def random_graph(seed, levels=12, width=2, gaps=0.5):
    rng, rows = random.Random(seed), []
    for name in ("g", "h"):
        for level in range(levels):
            for a in range(width):
                for b in {rng.randrange(width) for _ in range(rng.choice([1, 1, 2]))}:
                    rows.append(edge(level, len(rows), level * width + a, (level + 1) * width + b, "_" if rng.random() < gaps else rng.choice("ACGT"), float(rng.randint(1, 4)), name))
    return rows


@pytest.mark.parametrize("n", [1, 2, 60, 5000])
def test_paths_over_any_number_of_gaps(spark, n):
    rows = [edge(0, 0, 0, 1, "A")] + [edge(i, i, i, i + 1, "_") for i in range(1, n + 1)] + [edge(n + 1, n + 1, n + 1, n + 2, "C"), edge(n + 2, n + 2, n + 2, n + 3, "G", 1.0), edge(n + 2, n + 3, n + 2, n + 4, "T", 3.0)]
    got = made_paths(frame(spark, rows), 3)
    first = tuple(range(n + 2))
    assert got == [("g", 0, 0, (*first, n + 2), "ACG", 0.25), ("g", 0, 0, (*first, n + 3), "ACT", 0.75)]


@pytest.mark.parametrize("seed", range(3))
def test_paths_equal_plain_walks(spark, seed):
    """Gaps that part, join and end anywhere, in two graphs with the same nodes."""
    rows = random_graph(seed, gaps=(0.2, 0.5, 0.8)[seed])
    for k in (1, 3):
        assert made_paths(frame(spark, rows).repartition(3), k, slices=2) == plain_paths(rows, k)


def test_gaps_at_the_end_and_none_at_all(spark):
    rows = [edge(0, 0, 0, 1, "A"), edge(1, 1, 1, 2, "_"), edge(2, 2, 2, 3, "_")]
    assert made_paths(frame(spark, rows), 2) == [] and made_paths(frame(spark, rows), 1) == [("g", 0, 0, (0,), "A", 1.0)]
    assert made_paths(frame(spark, rows[:1] + [edge(1, 1, 1, 2, "C")]), 2) == [("g", 0, 0, (0, 1), "AC", 1.0)]
    assert made_paths(frame(spark, []), 2) == [] and made_paths(frame(spark, [("g", 0, 0, 0, 1, "L", None, 1.0)] + rows), 1) == [("g", 0, 0, (0,), "A", 1.0)]


def plain_runs(rows, before=None):
    """Segments of levels as a loop finds them, then each of their paths."""
    found = []
    for g in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == g]
        out, into = defaultdict(list), defaultdict(list)
        for r in mine:
            out[r[3]].append(r)
            into[r[4]].append(r)
        nodes = defaultdict(set)
        for r in mine:
            nodes[r[1]].add(r[3])
            nodes[r[1] + 1].add(r[4])
        first, last = min(nodes), max(nodes)
        wanted = set()
        for level in range(first + 1, last + 1):
            begins = any(e[6] == "_" and not (len(into[n]) == len(out[n]) == 1 and into[n][0][6] == "_") for n in nodes[level] for e in out[n])
            if before is not None and begins and level - before > first:
                wanted.add(level - before)
        level = first
        while level < last:
            stop = level + 1
            while stop not in wanted and all(len(into[n]) == len(out[n]) == 1 for n in nodes[stop]):
                stop += 1
            for r in [r for r in mine if r[1] == level]:
                path = [r]
                while path[-1][1] + 1 < stop:
                    path.append(out[path[-1][4]][0])
                symbols = ",".join(f"{s}:{n}" for s, n in sorted(Counter(e[6] for e in path).items()))
                found.append((g, r[2], level, stop - 1, r[3], path[-1][4], r[5], r[7], symbols))
            level = stop
    return sorted(found)


def made_runs(df, **more):
    return sorted(tuple(r) for r in graph.collapsed(df, **more).collect())


def lanes(sizes, name="g"):
    """Runs of levels with one way and with several side by side, in turn."""
    rows, level = [], 0
    for k, (length, width) in enumerate(sizes):
        for i in range(length):
            for w in range(width):
                a, b = (w if i else 0), (w if i < length - 1 else 0)
                rows.append(edge(level, len(rows), level * 10 + a, (level + 1) * 10 + b, "ACGT_"[(level * 3 + w * (k + 1)) % 5], float(w + 1), name))
            level += 1
    return rows


def test_arms_of_bubbles_are_one_edge_each(spark):
    rows = lanes([(3, 1), (4, 2), (2, 1)])
    got = made_runs(frame(spark, rows))
    assert got == plain_runs(rows) and [(r[2], r[3]) for r in got] == [(0, 2), (3, 6), (3, 6), (7, 8)]
    ladder = lanes([(1, 2), (1, 1)] * 6)
    assert made_runs(frame(spark, ladder)) == plain_runs(ladder) and len(plain_runs(ladder)) == 18


@pytest.mark.parametrize("before", [None, 1, 3])
def test_runs_equal_the_plain_rule(spark, before):
    rows = lanes([(7, 1), (9, 3), (1, 1), (1, 2), (70, 1), (33, 2)]) + lanes([(40, 2)], "h") + lanes([(1, 1)], "one") + [("r" + r[0], *r[1:]) for r in random_graph(4, levels=8, gaps=0.1)]
    assert made_runs(frame(spark, rows).repartition(5), before_gap=before) == plain_runs(rows, before)


def test_long_runs_take_few_rounds(spark):
    rows = [edge(i, i, i, i + 1, "_" if i % 300 == 299 else "ACGT"[i % 4]) for i in range(4000)]
    assert made_runs(frame(spark, rows)) == plain_runs(rows) and len(plain_runs(rows)) == 1
    assert made_runs(frame(spark, []), before_gap=2) == []


def plain_chains(reads, paths, k):
    """Seeds of each read and the runs of them that follow one another in one way only; a path is its solid edges."""
    found = []
    for read, seq in reads:
        seeds = [(g, i, level, trail) for i in range(len(seq) - k + 1) for g, level, kmer, trail in paths if kmer == seq[i : i + k]]
        after = {s: [t for t in seeds if t[0] == s[0] and t[1] == s[1] + 1 and t[3][:-1] == s[3][1:]] for s in seeds}
        before = {t: [s for s in seeds if t in after[s]] for t in seeds}
        goes = {s: ts[0] for s, ts in after.items() if len(ts) == 1 and len(before[ts[0]]) == 1}
        for s in set(seeds) - set(goes.values()):
            run = [s]
            while run[-1] in goes:
                run.append(goes[run[-1]])
            found.append((read, s[0], s[1], run[-1][1], min(x[2] for x in run), max(x[2] for x in run), len(run)))
    return sorted(found)


@pytest.mark.parametrize("seed", range(2))
def test_chains_of_seeds_in_branching_graphs(spark, seed):
    from strandlake.operators import align

    rows, k, rng = random_graph(seed + 5, levels=14, gaps=0.25), 3, random.Random(seed)
    solid = {(r[0], r[2]) for r in rows if r[6] != "_"}
    paths = sorted({(g, level, kmer, tuple(e for e in path if (g, e) in solid)) for g, level, _, path, kmer, _ in plain_paths(rows, k)})
    reads = [(i, "".join(rng.choice("ACGT") for _ in range(40))) for i in range(4)] + [(9, "AC"), (10, "")]
    for g in ("g", "h"):
        # reads that walk through the graph, as far as it goes
        node, text = 0, ""
        while out := [r for r in rows if r[0] == g and r[3] == node]:
            r = rng.choice(out)
            node, text = r[4], text + r[6].replace("_", "")
        reads.append((len(reads) + 10, text * 2))
    df = spark.createDataFrame([*reads, (99, None)], "read_id long, seq string")
    kmers = graph.kmer_graph(frame(spark, rows), k)
    got = sorted(tuple(r) for r in align.chains_in_graph(df.repartition(3), kmers, k).collect())
    assert got == plain_chains(reads, paths, k) and max(r[-1] for r in got) >= 4
    assert align.chains_in_graph(df.where("false"), kmers, k).count() == 0
