"""Phases of chromosomes solved in parts, against one solution of the whole."""

import random

from strandlake.operators import variants

K = 4


def plain(rows, have, share=0.9):
    """(h1, h2, support) of a chromosome's (seg_ord, a1, a2), from its first segment to its last, without a bound."""

    def score(a, b):
        found = [s[i : i + K] in have for s in (a.replace("_", ""), b.replace("_", "")) for i in range(len(s) - K + 1)]
        return sum(found) / len(found) if found else 1.0

    live = [(1.0, "", "")]
    for _, a1, a2 in sorted(rows):
        ways = [(a1, a1)] if a2 in (None, a1) else [(a1, a2), (a2, a1)]
        grown = [(x + p, y + q) for _, x, y in live for p, q in ways]
        n = 2 * K + len(a1)
        live = sorted(((score(x[-n:], y[-n:]), x, y) for x, y in grown), key=lambda t: -t[0])
        live = [t for t in live if t[0] > share * live[0][0]] if live[0][0] > 0 else live[:1]
    return live[0][1], live[0][2], score(*live[0][1:])


def made(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ACGT_") for _ in range(n))
    rows = []
    for at in range(14):
        a = word(rng.randint(1, 3))
        rows.append((len(rows), a, word(len(a))))
        for _ in range(rng.randint(0, 2)):  # agreed runs shorter and longer than 2 K, of one segment or two
            rows.append((len(rows), word(rng.choice([1, 3, 7, 15])), None))
    return rows


def test_parts_equal_the_whole(spark):
    rng = random.Random(5)
    chroms = {f"c|{n}": made(n) for n in range(12)} | {"agreed": [(0, "ACGT", None), (1, "GG", "GG")], "one": [(3, "A", "C")]}
    have = {"".join(rng.choice("ACGT") for _ in range(K)) for _ in range(190)}
    have |= {s.translate(str.maketrans("ACGT", "TGCA"))[::-1] for s in have}
    rows = [(c, *r) for c, rs in chroms.items() for r in rs] + [(None, 0, "A", "C"), ("one", 9, None, "C")]
    segments = spark.createDataFrame(rows, "chrom string, seg_ord int, a1 string, a2 string")
    counts = spark.createDataFrame([(x, 2) for x in have] + [("AAAA", 0)], "kmer string, n int")
    # the whole must not meet the bound for a comparison
    got = {r.chrom: (r.h1, r.h2, r.support) for r in variants.phased(segments, counts, K, most=1 << 20).collect()}
    assert got == {c: plain(rs, have) for c, rs in chroms.items()}
    parts = variants.phase_parts(segments, K).groupBy("chrom").agg({"part": "max"}).collect()
    assert sum(r[1] for r in parts) >= 10


def test_kmers_of_other_chromosomes_support_nothing(spark):
    rows = [(c, i, *a) for c, last in (("x", ("T", "G")), ("y", ("G", "T"))) for i, a in enumerate([("A", "C"), ("GT", None), last])]
    segments = spark.createDataFrame(rows, "chrom string, seg_ord int, a1 string, a2 string")
    # x goes A-G and C-T, y the other way
    counts = spark.createDataFrame([("x", "AGTG", 1), ("x", "CGTT", 1), ("y", "AGTT", 1), ("y", "CGTG", 1), (None, "AGTT", 1)], "chrom string, kmer string, n int")
    for most in (1000, 0):  # sent, and joined
        got = {r.chrom: (r.h1, r.h2, r.support) for r in variants.phased(segments, counts, K, most_kmers=most).collect()}
        assert got == {"x": ("AGTG", "CGTT", 1.0), "y": ("AGTT", "CGTG", 1.0)}
