import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from tests.llm.common import edited, empty, frame, odd_texts, prose, shingles, words

from strandlake.llm import decontaminate, gru, language, personal, quality, store
from strandlake.llm import text as tx


def test_words_and_shingles_equal_python():
    texts = [t or "" for t in odd_texts()]
    data, bounds = tx.utf8(pa.array(texts))
    found = tx.words(data, bounds)
    assert found.count.tolist() == [len(words(t)) for t in texts]
    s, of = tx.shingles(found)
    u, count = tx.distinct(s, of, len(texts))
    assert count.tolist() == [len(shingles(t)) for t in texts]
    assert len(np.unique(found.hashes)) == len({w for t in texts for w in words(t)})
    sliced, at = tx.utf8(pa.array(texts).slice(3, 4))
    assert tx.words(sliced, at).count.tolist() == found.count[3:7].tolist()


def test_recurrent_gradients():
    model = gru.new_model(["a", "b"], 3, 1)
    codes = np.random.default_rng(0).integers(0, 257, (6, 4))
    table, turn = model.table[0].astype(np.float64), model.turn[0].astype(np.float64)
    weight = np.random.default_rng(1).standard_normal((6, 3, 4)).astype(np.float32)
    loss = lambda: float((gru._forward(table.astype(np.float32), turn.astype(np.float32), codes, False)[0] * weight).sum())
    _, kept = gru._forward(model.table[0], model.turn[0], codes, True)
    d_table, d_turn = gru._backward(model.table[0], model.turn[0], codes, kept, weight)
    for w, d, i in ((table, d_table, (4, int(codes[2, 1]))), (turn, d_turn, (1, 2)), (turn, d_turn, (7, 0))):
        w[i] += 1e-2
        high = loss()
        w[i] -= 2e-2
        low = loss()
        w[i] += 1e-2
        assert abs((high - low) / 2e-2 - d[i]) < 2e-2


LANGUAGES = {"en": "the and of with this that", "fr": "le été où avec être ça", "de": "und über größe mit für das"}


def _languages(n, seed):
    rng = random.Random(seed)
    return [(lang, " ".join(rng.choice(pool.split()) for _ in range(30))) for lang, pool in LANGUAGES.items() for _ in range(n)]


def test_language_held_out_accuracy_and_odd_rows(spark):
    rows = _languages(40, 1)
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language.train_languages(docs, steps=80)
    fresh = _languages(10, 2)
    got = {r.doc_id: r for r in language.identify(frame(spark, [t for _, t in fresh]), model).collect()}
    assert sum(got[i].lang_pred == lang for i, (lang, _) in enumerate(fresh)) >= 0.95 * len(fresh)
    odd = language.identify(frame(spark, odd_texts() + ["123 !?"]), model).collect()
    assert all(0 <= r.score <= 1 for r in odd)
    assert {r.doc_id for r in odd if r.lang_pred == "und"} == {0, 1, 2, 16}
    assert language.identify(empty(spark), model).count() == 0
    none = language.train_languages(empty(spark))
    assert {r.lang_pred for r in language.identify(frame(spark, ["a b"]), none).collect()} == {"und"}


def test_labels_count_every_position_once():
    model = gru.new_model(["a", "b"], 4, 3)
    texts = ["", "x" * 200, "ab" * 50, "q"]
    data, bounds = tx.utf8(pa.array(texts))
    together = gru.label(model, data, bounds, 64)
    alone = np.concatenate([gru.label(model, *tx.utf8(pa.array([t])), 64) for t in texts])
    assert np.allclose(together, alone, atol=1e-5) and np.allclose(together.sum(1), 1, atol=1e-5)


def _plain_labels(model, text, length):
    """The mean distribution over a text's positions by scalar loops."""
    soft = lambda x: x / (1 + abs(x))
    codes = [b + 32 if 65 <= b <= 90 else b for b in text.encode()]
    total = np.zeros(len(model.names))
    for lo in range(0, len(codes), length):
        part, states = codes[lo : lo + length], []
        for way in (0, 1):
            h, out = np.zeros(model.turn[way].shape[1]), []
            for c in part if way == 0 else part[::-1]:
                x, u, n = model.table[way][:, c].astype(float), model.turn[way].astype(float) @ h, len(h)
                z, r = ([0.5 + 0.5 * soft(x[k] + u[k]) for k in range(a, a + n)] for a in (0, n))
                cand = [soft(x[2 * n + k] + r[k] * u[2 * n + k]) for k in range(n)]
                h = np.array([h[k] + z[k] * (cand[k] - h[k]) for k in range(n)])
                out.append(h)
            states.append(out if way == 0 else out[::-1])
        for f, b in zip(*states):
            e = np.exp(model.out[0] @ f + model.out[1] @ b + model.bias[:, 0])
            total += e / e.sum()
    return total / len(codes)


def test_labels_equal_a_plain_network():
    model = gru.new_model(["a", "b", "c"], 4, 5)
    texts = ["Hello, wörld", "x", "ab" * 150 + "é"]
    got = gru.label(model, *tx.utf8(pa.array(texts)), 100)
    assert np.allclose(got, [_plain_labels(model, t, 100) for t in texts], atol=1e-4)


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate(_languages(30, 4))]
    fold = lambda i, k: zlib.crc32(str(i).encode()) % k
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame(rows, schema)
    other = spark.createDataFrame([(i, t, "fr" if fold(i, 4) == 2 else lang) for i, t, lang in rows], schema)
    a, b = (language.train_languages(d, steps=5) for d in (docs, other))
    assert all(np.array_equal(x, y) for x, y in zip(a.weights, b.weights)) and a.names == b.names
    assert [r.h for r in docs.orderBy("doc_id").select((language.fold("doc_id", 4) == 2).alias("h")).collect()] == [fold(i, 4) == 2 for i, _, _ in rows]
    labels = [(i, i % 2, 0) for i, _, _ in rows] + [(None, 1, 0), (3, None, 0)]
    turned = [(i, 1 - q if i is not None and q is not None and fold(i, 5) == 0 else q, x) for i, q, x in labels]
    m, n = (quality.fit(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, turned))
    assert all(np.array_equal(x, y) for x, y in zip(m.weights, n.weights))


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (name, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if name == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if name == "card" and not (16 <= len(d) <= 19 and personal.luhn(d)):
                continue
            if name == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((k, *m.span()))
    return out


def test_patterns_equal_plain_expressions():
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice("a1@.+- 2(3)_%x9é\n0") for _ in range(rng.randint(0, 60)))
        assert personal.base_spans(text) == plain_spans(text), text
    assert len(personal.base_spans("1" * 50_000 + "@" * 1000)) == 0


TEXTS = ["mail me@x.example.com or +1 (988) 555-2485 now", "ip 10.0.0.255 and 10.0.0.256", "card 4041894974608795 é 4041894974608795", "nothing here", None, ""]


def test_annotation_masking_and_odd_rows(spark):
    field = personal.train_field([t for t in TEXTS * 20 if t])
    docs = frame(spark, TEXTS + odd_texts())
    got = {r.doc_id: r for r in personal.annotate(docs, field).collect()}
    for i, t in enumerate(TEXTS + odd_texts()):
        base = [(personal.KINDS.index(s.kind), s.start, s.end) for s in got[i].spans if s.base]
        assert base == plain_spans(t or "") and got[i].text == t
    masked = {r.doc_id: r.text for r in personal.annotate(docs, field, mask=True).collect()}
    assert masked[0] == "mail <EMAIL> or <PHONE> now" and masked[2].count("<CARD>") == 2 and masked[3] == TEXTS[3] and masked[4] is None
    assert personal.annotate(empty(spark), field).count() == 0
    digest = docs.sparkSession.range(1).select(personal.digest(personal.F.lit([]).cast(personal.SPANS))).first()[0]
    assert digest == "" and hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_messages_equal_enumeration_on_a_tree():
    rng = np.random.default_rng(2)
    k, n = len(personal.KINDS) + 1, 4
    skip = rng.standard_normal((k, k))
    field = personal.Field(rng.standard_normal((k, personal.FEATURES)), rng.standard_normal((k, k)), skip + skip.T)
    x, chain, skips = np.eye(personal.FEATURES)[:n], np.array([(0, 1), (1, 2)]), np.array([(1, 3)])
    total = np.zeros((n, k))
    for y in np.ndindex(*[k] * n):
        e = sum(field.node[y[i]] @ x[i] for i in range(n)) + field.chain[y[0], y[1]] + field.chain[y[1], y[2]] + field.skip[y[1], y[3]]
        for i in range(n):
            total[i, y[i]] += np.exp(e)
    assert np.allclose(personal.marginals(field, x, chain, skips, rounds=60), total / total.sum(1, keepdims=True), atol=1e-6)


def test_repeats_pull_a_doubtful_word_along():
    sure = np.zeros((len(personal.KINDS) + 1, personal.FEATURES))
    sure[3, 0], sure[3, 1] = 4.0, -3.5
    n = len(personal.KINDS) + 1
    field = personal.Field(sure, np.zeros((n, n)), np.eye(n) * 3)
    x = np.zeros((2, personal.FEATURES))
    x[:, 0], x[1, 1] = 1, 1
    none = np.zeros((0, 2), np.int64)
    assert personal.marginals(field, x, none, np.array([(0, 1)]))[1, 3] > personal.marginals(field, x, none, none)[1, 3] + 0.2


MENTIONS = {
    "call +1 (017) 555-7713 or " + "so " * 300 + "10175557713 there": ("phone", "10175557713"),
    "the 5557713 of +1 (017) 555-7713": ("phone", "5557713"),
    "host 97.51.17.173 is down; 97-51-17-173 again": ("ip", "97-51-17-173"),
    "mail und.34@mail7.example.com then und.34@mail7 ok": ("email", "und.34@mail7"),
    "card 4041 8949 7460 8795 and 4041.8949.7460.8795": ("card", "4041.8949.7460.8795"),
    'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" then 9b0b3c6a43eb78aa99cbd7049c572391524f37a8 x': ("secret", "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"),
}


def test_skip_edges_find_repeats_that_no_pattern_takes(spark):
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    line = lambda: f"mail a{digits(2)}@mail{digits(1)}.example.com or +1 ({digits(3)}) 555-{digits(4)} from {rng.randint(1, 255)}.{rng.randint(1, 255)}.{rng.randint(1, 255)}.1 card 4041894974608795 token = \"{rng.randbytes(20).hex()}\" in 3. and 2.0, all"
    field = personal.train_field([line() for _ in range(300)])
    alone = [t.split(" ", 1)[0] + " " + mention + " x" for t, (_, mention) in MENTIONS.items()]
    plain = ["on 2024-01-05 at 12:30 we paid 1,234.50 for 12 items, v2.0, id 123456789", "9807915762804490 and 9807915762804490", "see 1.2.3.² here"]
    docs = frame(spark, [*MENTIONS, *alone, *plain])
    got = {r.doc_id: [(s.kind, r.text[s.start : s.end]) for s in r.spans if not s.base] for r in personal.annotate(docs, field).collect()}
    unlinked = personal.Field(field.node, field.chain, np.zeros_like(field.skip))
    without = {r.doc_id: [(s.kind, r.text[s.start : s.end]) for s in r.spans if not s.base] for r in personal.annotate(docs, unlinked).collect()}
    assert all(m in got[i] for i, m in enumerate(MENTIONS.values()))
    assert sum(got[i] != without[i] for i in range(len(MENTIONS))) >= 5
    assert not any(got[i] for i in range(len(MENTIONS), len(MENTIONS) + len(alone) + len(plain)))


def test_field_sample_is_bounded_and_ordered(spark):
    docs = frame(spark, [f"n {k}" for k in range(50)] + ["n 1"] * 30, [*range(50), *[1] * 30])
    rows = docs.selectExpr("doc_id AS id", "text")
    a, b = store.bounded_sample(rows, 10, 10**6), store.bounded_sample(rows.repartition(7), 10, 10**6)
    assert a == b and 1 <= len(a) <= 10 and len(set(a)) == len(a)
    assert len(store.bounded_sample(rows, 10, 1)) == 1 and store.bounded_sample(rows.where("id < 0"), 10, 1) == []


def test_contamination_equals_brute_force(spark):
    items = [prose(n, 50 + n) for n in (3, 8, 20, 40, 64, 90)]
    docs = [prose(300, k) for k in range(12)]
    docs[1] = docs[1][:500] + " " + items[3] + " " + docs[1][500:]
    docs[2] = docs[2] + " " + edited(items[4], 2, 1)
    docs[3] = items[5].upper()
    docs[4] = items[0]
    docs[5] = prose(20_000, 77) + " " + items[2] + " " + prose(20_000, 78)
    docs += [None, "", docs[1]]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(98, None), (99, " "), (None, items[1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in decontaminate.contaminated(frame(spark, docs), table).collect()}
    want = {}
    for d, t in enumerate(docs):
        for i, s in enumerate(items):
            n, size = len(shingles(t) & shingles(s)), len(shingles(s))
            if n and 100 * n >= 75 * size:
                want[d, i] = (n, size)
    assert got == want and len(want) >= 6
    assert decontaminate.contaminated(empty(spark), table).count() == 0
    assert decontaminate.contaminated(frame(spark, docs), table.where("item_id < 0")).count() == 0


def test_short_items_inside_long_texts_are_all_found(spark):
    texts = [prose(2000, 700 + k).split(" ") for k in range(30)]
    items = [" ".join(w[60 * n : 60 * n + 4 + n]) for w in texts for n in range(1, 10)]
    items[3] = items[3].rsplit(" ", 1)[0] + " other"  # 4 shingles of which 3 are there
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in decontaminate.contaminated(frame(spark, [" ".join(w) for w in texts]), table).collect()}
    held = [shingles(" ".join(w)) for w in texts]
    want = {}
    for i, t in enumerate(items):
        own = shingles(t)
        want |= {(d, i): (len(own & s), len(own)) for d, s in enumerate(held) if 4 * len(own & s) >= 3 * len(own)}
    assert got == want and len(want) >= len(items) and want[0, 3] == (3, 4)


def test_quality_gradients_and_separation():
    rng = np.random.default_rng(0)
    m = quality.Model(*[rng.standard_normal(w.shape) * 0.3 for w in quality.train([], []).weights])
    x, text = quality.encode(*tx.utf8(pa.array([prose(n, n) for n in (5, 200, 400)])))
    x, y = x.astype(float), np.array([0.0, 1.0, 1.0])

    def loss():
        p, _ = quality.forward(m, x, text)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    p, keep = quality.forward(m, x, text)
    for w, g in zip(m.weights, quality.gradients(m, x, keep, p - y)):
        i = tuple(0 if s < 2 else s - 2 for s in w.shape)
        w[i] += 1e-5
        high = loss()
        w[i] -= 2e-5
        low = loss()
        w[i] += 1e-5
        assert abs((high - low) / 2e-5 - g[i]) < 1e-4
    good, bad = [prose(80, k) for k in range(60)], [prose(80, k).upper().replace(" ", "!! ") for k in range(60)]
    model = quality.train(good[:40] + bad[:40], [1] * 40 + [0] * 40)
    score = lambda texts: quality.forward(model, *quality.encode(*tx.utf8(pa.array(texts))))[0]
    assert (score(good[40:]) >= 0.3).mean() > 0.9 and (score(bad[40:]) < 0.3).mean() > 0.9


def test_quality_scores_odd_rows(spark):
    model = quality.train(["fine words here", "BAD!! BAD!!"] * 10, [1, 0] * 10)
    got = quality.score(frame(spark, odd_texts()), model).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got) and len(got) == len(odd_texts())
    assert got[0].score == got[1].score
    assert quality.score(empty(spark), model).count() == 0
    assert quality.train(["a"], [1]).bias[0] > 0 > quality.train(["a"], [0]).bias[0]
