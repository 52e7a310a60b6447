"""Reachability by blocks of levels, and texts searched in graphs, against plain walks."""

import random

from strandlake.operators import graph
from tests.test_graph_runs import edge, frame, random_graph


def plain_alive(rows, back):
    """Numbers of the edges that lead to the last level (or that the first leads to), of each graph by itself."""
    kept = set()
    for name in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == name]
        levels = sorted({r[1] for r in mine}, reverse=back)
        near, far = (3, 4) if back else (4, 3)
        live = {(levels[0] + back, r[far]) for r in mine if r[1] == levels[0]}
        for level in levels:
            for r in mine:
                if r[1] == level and (level + back, r[far]) in live:
                    kept.add(r[2])
                    live.add((level + (not back), r[near]))
    return kept


def test_edges_to_the_end_and_from_the_start(spark):
    rows = []
    for levels in (1, 2, 3, 7, 16, 21):  # graphs of all lengths, and one with a level that has no edges
        rows += [(f"{r[0]}{levels}", r[1], len(rows) + k, *r[3:]) for k, r in enumerate(random_graph(levels, levels, 4))]
    rows += [edge(v, 10_000 + v, v, v + 1, "A", name="cut") for v in range(5, 12) if v != 8]
    rows += [edge(v, 20_000 + v, v, v + 1, "A", name="long") for v in range(70)] + [edge(v, 30_000 + v, 5000 + v, 5001 + v, "C", name="long") for v in range(60)]
    e = frame(spark, rows)
    back, there = plain_alive(rows, True), plain_alive(rows, False)
    assert {r.edge_id for r in graph.trimmed(e).collect()} == back
    assert {r.edge_id for r in graph.connected(e).collect()} == back & there
    assert graph.trimmed(frame(spark, [])).count() == graph.connected(frame(spark, [])).count() == 0


def plain_present(rows, text):
    if not text:
        return text == ""
    out = {}
    for r in rows:
        out.setdefault((r[0], r[3]), []).append(r)
    live = {(r[0], r[4]) for r in rows if r[6] == text[0]}
    for c in text[1:]:
        queue = list(live)
        while queue:
            for r in out.get(queue.pop(), ()):
                if r[6] == "_" and (r[0], r[4]) not in live:
                    live.add((r[0], r[4]))
                    queue.append((r[0], r[4]))
        live = {(r[0], r[4]) for n in live for r in out.get(n, ()) if r[6] == c}
    return bool(live)


def test_texts_in_graphs_with_gaps(spark):
    rng = random.Random(1)
    rows = random_graph(1, 24, 2, 0.4)
    texts = ["".join(rng.choice("ACGT") for _ in range(rng.randint(1, 9))) for _ in range(150)] + ["", None, "ACGT", "ACGT", "N", "A N"]
    for _ in range(40):  # walks that are there, from anywhere
        r = rng.choice(rows)
        word = []
        while r:
            word.append(r[6])
            r = rng.choice([x for x in rows if x[0] == r[0] and x[3] == r[4]] or [None])
        texts.append("".join(word).replace("_", ""))
    ask = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "id int, seq string, present int")
    got = {r.id: (r.seq, r.present) for r in graph.sequences_present(ask, frame(spark, rows)).collect()}
    assert got == {i: (t, plain_present(rows, t)) for i, t in enumerate(texts)}
    assert sum(p for _, p in got.values()) > 40


def test_no_edges_or_no_texts(spark):
    ask = spark.createDataFrame([("A",), ("",), (None,)], "seq string")
    assert {r.seq: r.present for r in graph.sequences_present(ask, frame(spark, [])).collect()} == {"A": False, "": True, None: False}
    assert graph.sequences_present(ask.limit(0), frame(spark, [edge(0, 0, 0, 1, "A")])).count() == 0
