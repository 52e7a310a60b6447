"""Pairs of a level's edges: dealt evenly before they grow, each likelihood once for edges alike."""

import math

from strandlake.operators import hmm


def edges(spark, n=30):
    rows = [(k % 2, k, 0, k % 3, 1.0 + k) for k in range(n)]
    return spark.createDataFrame(rows, "level int, edge_id long, from_id long, to_id long, count double").coalesce(1)


def many(df):
    return df.rdd.getNumPartitions() >= 4 * df.sparkSession.sparkContext.defaultParallelism


def test_pairs_of_a_small_input_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK", 4, raising=False)
    got = hmm.diploid_states(edges(spark))
    total = {level: sum(1.0 + k for k in range(level, 30, 2)) for level in (0, 1)}
    want = {(k % 2, k, m): (1.0 + k) * (1.0 + m) / total[k % 2] ** 2 for k in range(30) for m in range(30) if k % 2 == m % 2}
    rows = got.collect()
    assert len(rows) == len(want) and all(math.isclose(r.p, want[r.level, r.e1, r.e2]) for r in rows)
    assert many(got)


def test_transitions_of_a_small_input_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK", 4, raising=False)
    got = hmm.transitions(edges(spark))
    total = sum(1.0 + k for k in range(1, 30, 2))
    want = {(0, k, m): (1.0 + m) / total for k in range(0, 30, 2) if k % 3 == 0 for m in range(1, 30, 2)}
    rows = got.collect()
    assert len(rows) == len(want) and all(math.isclose(r.p, want[r.level, r.edge, r.next_edge]) for r in rows)
    assert many(got)


def test_edges_with_the_same_kmers_share_a_likelihood(spark, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK", 4)
    e = edges(spark)
    # edges of three kinds, a fourth without k-mers; one edge's k-mer in two rows; a k-mer of no edge here
    rows = [(k % 2, k, f"k{k % 4}", 1) for k in range(30) if k % 4 < 3 and k != 8] + [(0, 8, "k0", 1), (0, 8, "k0", 1), (0, 99, "k9", 1)]
    kmers = spark.createDataFrame(rows, "level int, edge_id long, kmer string, copies int")
    counts = spark.createDataFrame([("k0", 7), ("k1", 12), ("k9", 3)], "kmer string, n int")
    met = []
    plain = hmm.emissions
    monkeypatch.setattr(hmm, "emissions", lambda k, c, states, *rest: met.append(states.count()) or plain(k, c, states, *rest))
    key = lambda r: (r.level, r.e1, r.e2)
    want = {key(r): r.ll for r in plain(kmers, counts, hmm.diploid_states(e), 10.0, 0.01).collect()}
    got = {key(r): r.ll for r in hmm.pair_emissions(e, kmers, counts, 10.0, 0.01).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    assert met == [3 * 3 + 2 * 2] and len(want) == 450
