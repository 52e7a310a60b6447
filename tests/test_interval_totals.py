"""Totals of intervals that meet, without their pairs, against all pairs."""

import random

from strandlake.operators import joins as jn
from strandlake.plans import relational_queries as rq

SF = "/root/testdata/sf0.001"


def made(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for key in range(n):
        first = rng.randint(-300, 300)
        rows.append((key, rng.choice(["x", "y"]), first, first + rng.choice([0, 1, 3, 7, rng.randint(0, longest)])))
    return rows + [(n, "x", 5, 4), (n + 1, None, 0, 9), (n + 2, *rows[0][1:])]  # one that holds nothing, one without a region, one twice


def frames(spark, longest):
    a, b = made(1, 150, longest[0]), made(2, 120, longest[1])
    return a, b, spark.createDataFrame(a, "key long, region string, s1 long, e1 long"), spark.createDataFrame(b, "id long, region string, s2 long, e2 int")


def no_pairs(*_, **__):
    raise AssertionError("pairs are made")


def test_totals_equal_those_of_all_pairs(spark):
    for longest in ((40, 600), (900, 20), (0, 0)):
        a, b, left, right = frames(spark, longest)
        want = {}
        for _, region, s2, e2 in b:
            met = [(k, min(e1, e2) - max(s1, s2) + 1) for k, r, s1, e1 in a if region and r == region and s1 <= e2 and s2 <= e1 and s1 <= e1 and s2 <= e2]
            if met:
                want[region, s2, e2] = (len(met), min(k for k, _ in met), sum(x for _, x in met))
        got = jn.interval_totals(left, right, "region", ("s1", "e1"), ("s2", "e2"), "key").collect()
        assert len(got) == len(want) and {(r.region, r.s2, r.e2): (r.n, r.first_key, r.overlap) for r in got} == want
    assert jn.interval_totals(left.limit(0), right, "region", ("s1", "e1"), ("s2", "e2"), "key").count() == 0


def test_overlap_query_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(jn, "interval_join", no_pairs)
    assert rq.interval_overlap(spark, SF).count() > 0


def test_overlap_filter_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(jn, "interval_join", no_pairs)
    assert rq.overlap_filter(spark, SF).count() > 0


def test_counts_inside_equal_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jn, "interval_join", no_pairs)
    for longest in ((10, 600), (300, 300)):
        a, b, left, right = frames(spark, longest)
        want = {}
        for _, region, s2, e2 in b:
            n = sum(1 for _, r, s1, e1 in a if region and r == region and s2 <= s1 <= e1 <= e2)
            if n:
                want[region, s2, e2] = n
        got = jn.interval_inside(left, right, "region", ("s1", "e1"), ("s2", "e2")).collect()
        assert len(got) == len(want) and {(r.region, r.s2, r.e2): r.n for r in got} == want
    assert rq.interval_contained(spark, SF).count() > 0
