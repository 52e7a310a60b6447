"""Decoding by blocks of levels against decoding in one task."""

import random

import pytest

from strandlake.operators import hmm
from strandlake.operators.long_decode import decode_long

STATES, STEPS = "sample string, level int, state string, ll double, start double", "level int, from_state string, to_state string, p double"


def tables(spark, seed, sizes, ties):
    """Samples with other states on every level; with ``ties`` all scores are multiples of a half, so that many paths score alike."""
    rng, rows, moves = random.Random(seed), [], []
    names = {level: sorted(rng.sample("abcd", rng.randint(1, 3))) for level in range(-1, 200)}
    for sample, (first, n) in sizes.items():
        for level in range(first, first + n):
            for s in names[level]:
                rows.append((sample, level, s, float(rng.randint(-2, 0)) / 2 if ties else rng.uniform(-3, 0), -1.0))
    for level in range(-1, 199):
        for a in names[level]:
            for b in names[level + 1]:
                if rng.random() < 0.9 or (a, b) == (names[level][0], names[level + 1][0]):
                    moves.append((level, a, b, 1.0 if ties else rng.uniform(0.1, 1)))
    return spark.createDataFrame(rows, STATES), spark.createDataFrame(moves, STEPS)


def plain(df):
    return sorted((r.sample, r.draw, r.level, r.state, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("block", [1, 3, 16, 1000])
def test_equals_decoding_in_one_task(spark, block):
    sizes = {"one": (0, 1), "two": (5, 2), "edge": (16, 16), "long": (0, 150), "late": (47, 50)}
    for ties in (True, False):
        states, steps = tables(spark, block, sizes, ties)
        got, want = plain(decode_long(states.repartition(5), steps, block)), plain(hmm.decode(states, steps))
        assert got == want and len(got) == sum(n for _, n in sizes.values())


def test_odd_tables(spark):
    states, steps = tables(spark, 1, {"x": (0, 9)}, True)
    none = states.where("false")
    assert decode_long(none, steps, 4).count() == 0
    nulls = states.unionByName(spark.createDataFrame([(None, 1, "a", 0.0, 0.0), ("x", None, "a", 0.0, 0.0), ("x", 1, None, 0.0, 0.0)], STATES))
    assert plain(decode_long(nulls, steps, 4)) == plain(hmm.decode(states, steps))
    for hole in ("level <> 2", "level NOT BETWEEN 3 AND 5"):
        with pytest.raises(Exception, match="no consecutive numbers"):
            decode_long(states.where(hole), steps, 4).collect()
