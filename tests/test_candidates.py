"""Candidates of both mates from chains, and the confidence that their places share."""

import math

from pyspark.sql import functions as F

from strandlake.operators import typing as ty

CHAINS = "pair int, mate int, strand string, graph string, first_pos int, last_pos int, first_level int, last_level int, n long"


def test_places_share_the_confidence(spark):
    chain = lambda p, m, s, g, at, n: (p, m, s, g, 0, n - 1, at, at + n - 1, n)
    rows = [chain(1, 1, "+", g, 10, 31) for g in ("a", "b", "c")] + [chain(1, 2, "-", g, 210, 31) for g in ("a", "b")]
    rows += [chain(1, 2, "+", "c", 210, 31)]  # the same strand is no pair
    rows += [chain(1, 1, "+", "a", 500, 5), chain(1, 1, "+", "a", 10, 31)]  # far below the best, and a repeated row
    rows += [chain(2, 1, "-", "a", 400, 31), chain(2, 2, "+", "a", 200, 31), chain(2, 2, "+", "a", 210, 30), chain(3, 1, "+", "a", 0, 31)]
    chains = spark.createDataFrame(rows, CHAINS)
    lengths = chains.select("pair", "mate", F.lit(40).alias("length"))
    got = ty.chain_candidates(chains, lengths, 10)
    assert sorted((r.pair, r.mate, r.aln, r.graph, r.pos) for r in got.collect()) == [
        (1, 1, 0, "a", 10), (1, 1, 1, "b", 10), (1, 1, 2, "c", 10), (1, 2, 0, "c", 210), (1, 2, 1, "a", 210), (1, 2, 2, "b", 210),
        (2, 1, 0, "a", 400), (2, 2, 0, "a", 200), (2, 2, 1, "a", 210), (3, 1, 0, "a", 0),
    ]
    out = {(r.pair, r.graph, r.a1, r.a2): r.mapq for r in ty.resolve_in_graphs(got, 200.0, 10.0).collect()}
    assert out[1, "a", 0, 1] == out[1, "b", 1, 2] == 0.5 and len(out) == 4
    # one error and ten signs of distance, one standard deviation, less
    odds = math.exp(-0.5) * (0.01 / 3) / 0.99
    assert math.isclose(out[2, "a", 0, 0], 1 / (1 + odds)) and math.isclose(out[2, "a", 0, 1], odds / (1 + odds))
    none = ty.chain_candidates(chains.limit(0), lengths, 10)
    assert none.count() == ty.resolve_in_graphs(none, 200.0, 10.0).count() == 0
