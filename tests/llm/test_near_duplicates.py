import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.common import edited, empty, frame, odd_texts, prose, shingles

from strandlake.llm import near_duplicates as nd
from strandlake.llm.components import components


def brute(texts, ids):
    sets, label = [shingles(t) for t in texts], {i: i for i in ids}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(ids[a]), root(ids[b])
                label[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in zip(ids, sets)}


def test_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 16)
    base = prose(150, 9)
    texts = odd_texts() + [edited(base, k % 9, k) for k in range(60)] + [prose(80, 100 + k) for k in range(20)]
    ids = random.Random(3).sample(range(1000), len(texts))
    got = nd.near_duplicates(frame(spark, texts, ids)).collect()
    want = brute(texts, ids)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_blank_null_and_repeated_rows(spark):
    text = prose(30, 1)
    got = nd.near_duplicates(frame(spark, [None, "", " ", text, text, text, "a b"], [1, 2, 3, 9, 9, None, None])).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (9, 26, 9, True), (9, 26, 9, True), (None, 26, 9, False), (None, 1, None, True)], key=str
    )
    assert nd.near_duplicates(empty(spark)).count() == 0


def test_threshold_is_exact_at_a_tie():
    whole = np.arange(7, dtype=np.uint64)
    assert nd.links([whole[:7], whole[:6]], 6, 7) == [(0, 1)]
    assert nd.links([whole[:7], whole[:6]], 601, 700) == []
    assert nd.links([whole, whole, whole], 75, 100, np.array([0, 0, 0])) == []


def test_coordinates_agree_as_often_as_the_sets_resemble():
    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (300, 100, 100))
    x, y = (nd.signatures(np.sort(np.r_[shared, s]), np.array([0]), 512)[:, 0] for s in (a, b))
    assert abs((x == y).mean() - 0.6) < 0.08


def test_labels_reach_through_chains_and_never_stop_short(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}
    order = random.Random(1).sample(range(400), 400)
    chain = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    assert {r.component for r in components(chain, rounds=20).collect()} == {0}
    with pytest.raises(RuntimeError):
        components(edges, rounds=1)
    assert components(edges.where("a > 1000")).count() == 0


def test_all_alike_classes_of_a_bucket_join_whatever_its_leaders(spark, monkeypatch):
    rng = np.random.default_rng(4)
    unlike = rng.integers(0, 256, (40, nd.SIZE)).astype(np.uint8)
    unlike[39] = unlike[38]
    # 51 resembles its leader 50, and 52 resembles 51 but not 50
    chain = np.zeros((3, nd.SIZE), np.uint8)
    chain[1, 60:] = 1
    chain[2, 60:], chain[2, :28] = 1, 2
    rows = [(k, s.tobytes(), [7]) for k, s in enumerate(unlike)] + [(50 + k, s.tobytes(), [8]) for k, s in enumerate(chain)] + [(53, bytes([9] * nd.SIZE), [8])]
    classes = spark.createDataFrame(rows, "rep long, sketch binary, bands array<long>")
    spread, sketches = classes.select("rep", F.explode("bands").alias("bucket")), classes.select("rep", "sketch")
    # other buckets of the crowded one's classes, in which alike ones still meet
    deeper = lambda members: members.withColumn("bucket", F.floor(F.col("rep") / 2))
    for size, more in ((2048, None), (8, None), (8, deeper)):
        monkeypatch.setattr(nd, "SKETCHES", size)
        assert {r.node: r.component for r in components(nd._loose(spread, sketches, 53, more)).collect()} == {38: 38, 39: 38, 50: 50, 51: 50, 52: 50}


def test_linked_sets_share_one_of_their_rarest_shingles(spark):
    base = prose(60, 5)
    texts = [edited(base, k % 5, k) for k in range(30)] + [prose(40, 200 + k) for k in range(10)] + ["a b", "a b c d e f"]
    docs = frame(spark, texts).select("doc_id", "text")
    rows = nd._rarest(docs, docs.select(F.col("doc_id").alias("rep")), 75, 100, 5).collect()
    held = {}
    for r in rows:
        held.setdefault(r.rep, set()).add(r.bucket)
    sets = [shingles(t) for t in texts]
    for a in range(len(texts)):
        assert len(held[a]) == len(sets[a]) - -(-75 * len(sets[a]) // 100) + 1
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                assert held[a] & held[b]


def test_large_groups_in_several_parts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 4)
    monkeypatch.setattr(nd, "SKETCHES", 4)
    base = prose(120, 21)
    # some far from the others, alike among themselves, and a chain from one text to another
    texts = [edited(base, 2, k) for k in range(14)] + [edited(edited(base, 9, 77), 1, 100 + k) for k in range(7)] + [edited(base, 12, 300 + k) for k in range(6)]
    for k in range(8):
        texts.append(edited(texts[-1], 3, 500 + k))
    ids = random.Random(8).sample(range(1000), len(texts))
    got = nd.near_duplicates(frame(spark, texts, ids)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts, ids)


def test_links_are_met_once_a_round(spark, monkeypatch):
    from strandlake.llm import components as cp

    kept, plain = [], cp.stash
    monkeypatch.setattr(cp, "stash", lambda df, name, *rest: kept.append((name, plain(df, name, *rest))) or kept[-1][1])
    rows = [(a, a + 1) for a in range(20)] + [(a + 1, a) for a in range(20)] + [(3, 3), (None, 1), (7, 9), (7, 9), (50, 40)]
    got = {r.node: r.component for r in cp.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(21), 0) | {40: 40, 50: 40}
    assert [df.count() for name, df in kept if name == "edges"] == [22]
