import random
import resource

import numpy as np
from tests.llm.common import frame

from strandlake.llm import personal, skip_chain


def plain_chain(unary, linked, chain):
    """Forward and backward, one node after another."""
    n, k = unary.shape
    f, b, turn = np.ones((n, k)), np.ones((n, k)), np.exp(chain)
    for i in range(1, n):
        f[i] = (f[i - 1] * np.exp(unary[i - 1])) @ turn if linked[i] else 1
        f[i] /= f[i].sum()
    for i in range(n - 2, -1, -1):
        b[i] = turn @ (b[i + 1] * np.exp(unary[i + 1])) if linked[i + 1] else 1
        b[i] /= b[i].sum()
    p = f * b * np.exp(unary)
    return p / p.sum(1, keepdims=True)


def plain_loopy(field, unary, linked, skip, rounds=400):
    """All edges pass damped messages at once, again and again."""
    edges = [(i - 1, i, field.chain) for i in np.flatnonzero(linked)] + [(a, b, field.skip) for a, b in skip]
    edges += [(b, a, p.T) for a, b, p in edges]
    message = {(j, e): np.zeros(unary.shape[1]) for j, e in enumerate(edges) for e in [j]}
    message = [np.zeros(unary.shape[1]) for _ in edges]
    half = len(edges) // 2
    for _ in range(rounds):
        belief = unary.copy()
        for (_, b, _), m in zip(edges, message):
            belief[b] += m
        new = []
        for j, (a, _, p) in enumerate(edges):
            out = np.log(np.exp((belief[a] - message[(j + half) % len(edges)])[:, None] + p).sum(0))
            new.append(0.5 * message[j] + 0.5 * (out - out.max()))
        message = new
    belief = unary.copy()
    for (_, b, _), m in zip(edges, message):
        belief[b] += m
    return skip_chain.softmax(belief)


def sample(n, seed, k=4):
    rng = np.random.default_rng(seed)
    linked = rng.random(n) < 0.9
    linked[0] = False
    return rng.standard_normal((n, k)) * 2, linked, rng.standard_normal((k, k)), rng


def test_chains_equal_a_plain_pass_across_blocks_and_segments(monkeypatch):
    for block, segment, n in ((1 << 15, 64, 1), (1 << 15, 64, 500), (50, 8, 333), (64, 16, 128), (7, 3, 40)):
        monkeypatch.setattr(skip_chain, "BLOCK", block)
        monkeypatch.setattr(skip_chain, "SEGMENT", segment)
        unary, linked, chain, _ = sample(n, n)
        unary[n // 3] = np.where(np.arange(4) == 1, 0, -50)
        assert np.allclose(skip_chain.chain_beliefs(unary, linked, chain), plain_chain(unary, linked, chain), atol=1e-9)
    linked[1:] = True
    assert np.allclose(skip_chain.chain_beliefs(unary, linked, chain), plain_chain(unary, linked, chain), atol=1e-9)


def test_skip_edges_reach_the_beliefs_of_plain_message_passing(monkeypatch):
    monkeypatch.setattr(skip_chain, "BLOCK", 16)
    unary, linked, chain, rng = sample(60, 2)
    skip = rng.standard_normal((4, 4)) / 3
    field = skip_chain.Field(np.zeros((4, 1)), chain / 2, skip + skip.T)
    edges = np.unique(np.sort(rng.integers(0, 60, (25, 2)), axis=1), axis=0)
    edges = edges[edges[:, 0] < edges[:, 1]]
    got = skip_chain.beliefs(field, unary, linked, edges, rounds=300, still=1e-7)
    assert np.allclose(got, plain_loopy(field, unary, linked, edges), atol=1e-4)


def _field():
    rng = random.Random(1)
    return personal.train_field([f"call +44 20 7946 {rng.randint(1000, 9999)} or mail bob{k}@example.com at 10.0.0.{k} items {k} {k * 7} key token=abcd{k}efghijklmnop12345" for k in range(100)], steps=100)


def test_graphs_are_those_of_small_texts(monkeypatch):
    """Reading words a few at a time gives the features, links and skip edges of the whole text's lists."""
    field = _field()
    texts = ["", "no mark", "Call +44 20 7946 0018, (020) 79460018 now; 0207946-0018 x@yahoo.example token: abcdefghij0123456789 abcdefghij01zz 79460018 x[at]yahoo.example (1) 2 3"]
    texts.append("  ".join([texts[-1]] * 5 + [str(k * 1234567) for k in range(40)]))
    for size in (8192, 3, 1):
        monkeypatch.setattr(personal, "WORDS", size)
        for text in texts:
            nodes = personal._nodes(text)
            features, chain, skips = personal._graph(nodes)
            got = personal._read(text, field, {})
            assert list(zip(got.starts.tolist(), got.ends.tolist())) == nodes.spans and np.flatnonzero(got.linked).tolist() == [b for _, b in chain]
            assert sorted(map(tuple, got.skip.tolist())) == skips
            want = np.array([field.node[:, f].sum(1) for f in features]).reshape(-1, len(field.node))
            assert np.allclose(got.unary, want, atol=1e-4)


def test_texts_together_are_as_texts_alone(monkeypatch):
    field, rng = _field(), random.Random(5)
    texts = [" ".join(rng.choice(["word", str(rng.randint(0, 10**9)), "+44 20 7946 0018", "79460018", "10.1.1.7", "a@b.example"]) for _ in range(rng.randint(0, 60))) for _ in range(50)]
    alone = [next(personal.find([t], field)).tolist() for t in texts]
    assert [x.tolist() for x in personal.find(texts, field)] == alone
    monkeypatch.setattr(personal, "NODES", 20)
    assert [x.tolist() for x in personal.find(iter(texts), field)] == alone


def test_long_texts_of_numbers_take_bounded_memory():
    """3 MB of small numbers, which is three quarters of a million nodes in one chain."""
    field, rng = _field(), random.Random(7)
    text = " ".join(str(rng.randint(0, 999)) for _ in range(750_000)) + " mail bob@example.com 555-0100 "
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = next(personal.find([text], field)).tolist()
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 300
    a = text.index("bob@")
    assert [0, a, a + 15, 1] in got


def test_training_is_bounded():
    texts = ["1 " * 50, "2 " * 1000, "3 token=abcdefghij0123456789k"]
    few, more = personal.train_field(texts, steps=5, most=100), personal.train_field([texts[0], texts[2]], steps=5)
    assert np.allclose(few.node, more.node) and np.allclose(few.skip, more.skip)


def test_a_batch_of_marked_texts_keeps_its_rows(spark):
    texts = [None, "", "10.0.0.1", "x", "a 10.0.0.2 b 10.0.0.3", None] * 40
    got = {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.spans] for r in personal.annotate(frame(spark, texts), _field()).collect()}
    assert all([s[:3] for s in got[i] if s[3]] == [("ip", *x[1:]) for x in personal.base_spans(t or "")] for i, t in enumerate(texts))
