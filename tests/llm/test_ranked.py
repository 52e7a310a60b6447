import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from tests.llm.common import empty, frame, lower, odd_texts, prose

from strandlake.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(lower(text))


def plain(docs, items, top=10):
    """All documents scored against all items; docs and items are (id, text)."""
    own = [(i, Counter(terms(t))) for i, t in docs]
    n, length = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    holding = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in own:
            score = 0
            for t in terms(text):
                if c[t]:
                    m = 25 + (75 * sum(c.values()) * n) // length
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * holding[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is not None, doc or 0, doc))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def made(spark, docs, items, **kw):
    table = frame(spark, [t for _, t in items]).select("doc_id", "text").collect()
    asked = spark.createDataFrame([(i, t, 3) for (i, _), (_, t) in zip(items, table)], "item_id long, text string, rank int")
    return sorted([tuple(r) for r in ranked.search(docs, asked, **kw).collect()], key=str)


def corpus():
    return odd_texts() + [prose(60 + 7 * i, i % 11, 90) for i in range(60)] + [" ".join(f"{w}{'-_.,'[i % 4]}" for i, w in enumerate(prose(50, 5, 60).split())), "Kelvin \u212a K k", "a'b-c_d 9x\x00y"]


def queries():
    return [(0, prose(20, 3, 90)), (1, "the one Two words WORDS k"), (2, None), (3, ""), (4, "zzz qqq"), (5, prose(40, 1, 400)), (5, "one one one"), (None, "one"), (7, "\u212a \u00c9T\u00c9 na\u00efve a b c 9x y")]


def test_equals_brute_force_on_odd_rows(spark):
    texts = corpus()
    ids = list(range(len(texts)))
    ids[7], ids[9], ids[20], ids[21] = 6, None, None, None
    docs = frame(spark, texts, ids)
    want = plain(list(zip(ids, texts)), queries())
    assert made(spark, docs, queries()) == want
    assert made(spark, docs.repartition(7), queries(), window=3) == want
    assert made(spark, docs, queries(), top=2, window=1) == plain(list(zip(ids, texts)), queries(), top=2)


def test_ties_go_by_id(spark):
    texts = ["same words here"] * 30 + ["other words"]
    got = made(spark, frame(spark, texts).repartition(5), [(1, "same words")], window=4)
    assert [(r[1], r[2]) for r in sorted(got, key=lambda r: r[1])] == [(k + 1, k) for k in range(10)]


def test_nothing_to_find(spark):
    assert made(spark, empty(spark), queries()) == [] and made(spark, frame(spark, [None, "", "..."]), queries()) == []
    assert ranked.search(frame(spark, ["a"]), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_rounds_make_no_difference(spark, monkeypatch):
    texts = corpus()
    want = plain(list(enumerate(texts)), queries())
    monkeypatch.setattr(ranked, "ITEMS", 3)
    monkeypatch.setattr(ranked, "POSTINGS", 50)
    assert made(spark, frame(spark, texts), queries()) == want


def test_a_word_of_the_same_hash_is_no_hit():
    vocabulary, counts = ranked.vocabulary(["alpha beta alpha"])
    assert sorted(counts[0].values()) == [1, 2]
    data, bounds = ranked.tx.utf8(pa.array(["alpha gamma beta"]))
    found = ranked.tx.words(data, bounds, gap=ranked._GAP)
    found.hashes[1] = found.hashes[0]
    at, number = ranked._hits(vocabulary, data, found)
    assert at.tolist() == [0, 2] and len(set(number.tolist())) == 2
    found.hashes[1], found.end[1] = found.hashes[2], found.begin[1] + 4
    assert ranked._hits(vocabulary, data, found)[0].tolist() == [0, 2]


def test_bits_are_those_of_the_postings():
    starts, docs = np.array([0, 3, 4]), np.array([0, 7, 8, 4095, 1, 2, 17])
    begin, place, value = ranked._bits(starts, docs)
    for k, want in enumerate(([0, 7, 8], [4095], [1, 2, 17])):
        occupied = np.zeros(512, np.uint8)
        occupied[place[begin[k] : begin[k + 1]]] = value[begin[k] : begin[k + 1]]
        assert np.flatnonzero(np.unpackbits(occupied)).tolist() == want
