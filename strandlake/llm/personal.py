"""Personal data: exact patterns, and a skip-chain conditional random field over what looks like it.

Nodes are the words of a text that hold a digit or an at sign. Neighbours in
the text are joined by chain edges; words with the same digits, name or host,
wherever they stand, by skip edges. Loopy message passing then settles the
labels of the whole text together: what is personal data in one place is so
elsewhere too, in a style that no pattern takes.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm import text as tx
from strandlake.llm.skip_chain import Field, beliefs, softmax
from strandlake.llm.store import bounded, bounded_sample

#: Kinds that patterns find, then the one that only the field does.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
_OTHER = 0
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# repeated groups give nothing back, as what follows them never needs it, and so keep no stack on long runs
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_HEX = re.compile(r"[0-9a-fA-F]+")
#: What announces a secret, and one with its value, from which the field learns.
_CUE = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api.?key|credential)[\"']?\s{0,2}[=:]\s{0,2}$")
_SECRET = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api.?key|credential)[\"']?\s{0,2}[=:]\s{0,2}[\"']?(?=[a-z_+/-]{0,256}[0-9])([a-z0-9_+/-]{20,})")
_MARK = np.zeros(256, bool)
_MARK[48:58] = _MARK[64] = True
_WORD = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@\[]*+(?:\[(?!at\])[^\x20\x09-\x0D0-9@\[]*+)*+(?:[0-9@]|\[at\])[^\x20\x09-\x0D]*")
_TRIM = "\"'()[]{}<>,;:!?"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Local part, at sign, domain with a dot; found from each at sign, so that long words cost no more than others."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        done = m.end() if m else done
        if m:
            found.append((a, m.end()))
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns, kinds as numbered in KINDS."""
    found = [(0, *s) for s in _emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
            found.append((3, *m.span()))
    return found


FEATURES = 24
#: Features of a word's neighbours: a plus or a bracket begins the one before, a bracket the one after, and something before the word announces a secret.
_BEFORE_PLUS, _BEFORE_BRACKET, _AFTER_BRACKET, _CUED = 16, 17, 18, 21
#: Nodes whose labels are settled together, where texts are shorter, and whose words are held at once.
NODES, WORDS = 1 << 15, 1 << 13
#: What announces a secret stands within so many characters before it.
_AHEAD = 24


@dataclass
class Nodes:
    """Words of one text that may be personal data: their places, whether a word is next to the one before, and whether something that announces a secret stands before it."""

    spans: list[tuple[int, int]]
    words: list[str]
    near: list[bool]
    cued: list[bool]


def _nodes(text: str) -> Nodes:
    spans = [m.span() for m in _WORD.finditer(text)]
    near = [k > 0 and spans[k][0] - spans[k - 1][1] <= 1 for k in range(len(spans))]
    return Nodes(spans, [text[a:b] for a, b in spans], near, [_CUE.search(text, max(0, a - _AHEAD), a) is not None for a, _ in spans])


def _own(word: str) -> list[int]:
    """Numbers of the features that hold for a word by itself."""
    core = word.strip(_TRIM + ".")
    digits = "".join(_DIGITS.findall(word))
    n, parts = len(digits), core.split(".")
    tests = {
        8: "@" in word,
        9: "@" in word and "." in word.split("@")[-1].strip("."),
        10: len(parts) == 4 and all(_DIGITS.fullmatch(p) and len(p) < 6 and int(p) < 256 for p in parts),
        11: _DIGITS.fullmatch(core) is not None,
        12: any(c.isalpha() for c in core),
        13: word.startswith("+"),
        14: word.startswith("("),
        15: "-" in core and _DIGITS.fullmatch(core.replace("-", "")) is not None,
        19: 16 <= n <= 19 and luhn(digits),
        20: "[at]" in word,
        22: len(core) >= 20,
        23: _HEX.fullmatch(core) is not None and len(core) >= 20,
    }
    return [0, 1 + (n > 0) + (n > 3) + (n > 6) + (n > 9) + (n > 15) + (n > 19)] + [k for k, t in tests.items() if t]


def _features(word: str, before: str, after: str, cued: bool) -> list[int]:
    """Numbers of the features that hold for a word between its neighbours."""
    tests = {_BEFORE_PLUS: before.startswith("+"), _BEFORE_BRACKET: before.startswith("("), _AFTER_BRACKET: after.startswith("("), _CUED: cued}
    return _own(word) + [k for k, t in tests.items() if t]


def _keys(word: str, run: str) -> set[str]:
    """What a word shares with its like: its digits, those of the run of neighbours it is in, the last seven of many, an address, its name or its host, or the head of a long word."""
    core = word.strip(_TRIM + ".").lower()
    name, at, host = core.replace("[at]", "@").partition("@")
    if not at and len(core) >= 20 and any(c.isalpha() for c in core):
        return {"long " + core[:12]}
    keys = {f"{k} {part}" for k, part in (("name", name), ("host", host.split(".")[0])) if at and len(part) >= 4}
    for digits in ("".join(_DIGITS.findall(word)), run):
        if len(digits) >= 7:
            keys |= {digits, digits[-7:] if len(digits) >= 10 else ""}
    return keys - {""}


def _graph(nodes: Nodes) -> tuple[list[list[int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """The nodes' features, chain edges and skip edges. Skip edges join the first node of a key with every other one, so that any two are two steps apart."""
    words, near, n = nodes.words, nodes.near, len(nodes.words)
    features = [_features(words[k], words[k - 1] if near[k] else "", words[k + 1] if k + 1 < n and near[k + 1] else "", nodes.cued[k]) for k in range(n)]
    runs, begin = [""] * n, 0
    for k in range(1, n + 1):
        if k == n or not near[k]:
            digits = "".join(d for w in words[begin:k] for d in _DIGITS.findall(w)) if 1 < k - begin <= 8 else ""
            runs[begin:k] = [digits] * (k - begin)
            begin = k
    skips, first = set(), {}
    for k, w in enumerate(words):
        for key in _keys(w, runs[k]):
            if first.setdefault(key, k) != k:
                skips.add((first[key], k))
    return features, [(k - 1, k) for k in range(1, n) if near[k]], sorted(skips)


def _batch(graphs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature matrix and both kinds of edges of several texts' graphs as one."""
    base = np.cumsum([0, *(len(g[0]) for g in graphs)])
    rows = [(base[i] + k, f) for i, g in enumerate(graphs) for k, fs in enumerate(g[0]) for f in fs]
    x = np.zeros((int(base[-1]), FEATURES))
    if rows:
        x[tuple(np.array(rows).T)] = 1
    chain, skip = (np.array([(base[i] + a, base[i] + b) for i, g in enumerate(graphs) for a, b in g[k]], np.int64).reshape(-1, 2) for k in (1, 2))
    return x, chain, skip


def _restyled(kind: int, words: list[str], rng: random.Random) -> list[str]:
    """A mention of personal data as no pattern would have it."""
    core = [w.strip(_TRIM + ".") for w in words]
    digits = "".join(d for w in words for d in _DIGITS.findall(w))
    if KINDS[kind] == "email":
        name, _, host = core[0].partition("@")
        return [rng.choice([f"{name}@{host.split('.')[0]}", f"{name}[at]{host}"])]
    if KINDS[kind] == "ip":
        return [core[0].replace(".", rng.choice("-:,"))]
    if KINDS[kind] == "card":
        return [rng.choice(".:").join(digits[i : i + 4] for i in range(0, len(digits), 4))]
    if KINDS[kind] == "phone":
        return rng.choice([[digits], [digits[-7:]], [".".join("".join(_DIGITS.findall(w)) for w in words)]])
    return [rng.choice([core[0], core[0].lower(), core[0][:24]])]


def _plain(rng: random.Random) -> str:
    """A number, or a word with digits, that is no personal data."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    dotted = rng.choice("-:,").join(str(rng.randint(0, 255)) for _ in range(4))
    quads = rng.choice(".:").join(n(4) for _ in range(4))
    return rng.choice([n(rng.randint(1, 9)), n(rng.randint(1, 20)), f"{n(1)}.{n(1)}", f"20{n(2)}-{n(2)}-{n(2)}", f"{n(2)}:{n(2)}", f"{n(3)},{n(3)}", dotted, quads, f"{n(3)}-{n(4)}", f"({n(2)})", f"v{n(1)}.{n(2)}", "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([24, 32, 40, 64]))), f"@user{n(3)}", f"a{n(2)}[at]b"])


def _covering(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """The label of the first kind of span that covers some of each place, or none's. Places are in order and apart, as are the spans of a kind."""
    out = np.full(len(starts), _OTHER, np.int8)
    if not spans or not len(starts):
        return out
    kinds, a, b = np.array(spans, np.int64).T
    lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
    for kind in np.unique(kinds)[::-1].tolist():
        some = kinds == kind
        length = np.maximum(hi[some] - lo[some], 0)
        out[np.repeat(lo[some] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))] = kind + 1
    return out


def _labelled(text: str, rng: random.Random) -> tuple[Nodes, list[int]]:
    """Nodes of a text with the label of the pattern that covers each; then, set apart, mentions of half of its personal data in other styles, and plain numbers, of which some come twice."""
    nodes = _nodes(text)
    spans = base_spans(text) + [(len(KINDS) - 1, *m.span(1)) for m in _SECRET.finditer(text)]
    places = np.array(nodes.spans, np.int64).reshape(-1, 2)
    labels = _covering(places[:, 0], places[:, 1], spans).tolist()
    mentions, begin = [], 0
    for k in range(1, len(labels) + 1):
        if k == len(labels) or not nodes.near[k] or labels[k] != labels[begin]:
            if labels[begin] and rng.random() < 0.5:
                mentions.append((labels[begin], _restyled(labels[begin] - 1, nodes.words[begin:k], rng)))
            begin = k
    for _ in range(rng.randint(1, 4)):
        mentions += [(_OTHER, [_plain(rng)])] * rng.choice([1, 1, 2])
    for label, words in mentions:
        for k, w in enumerate(words):
            nodes.words.append(w)
            nodes.near.append(k > 0)
            nodes.cued.append(False)
            labels.append(label)
    return nodes, labels


def train_field(texts: list[str], steps: int = 600, rate: float = 1.0, decay: float = 1e-4, seed: int = 3, most: int = 500_000) -> Field:
    """Weights by pseudo-likelihood: each node is to name its label, given its neighbours' labels.

    The patterns label what they cover, but the field also sees mentions of the
    same data in styles that no pattern takes, and plain numbers in those very
    styles: what tells them apart is whether the text has the data elsewhere.
    At most ``most`` words are learned from; texts that would go beyond teach nothing.
    """
    rng, made, words = random.Random(seed), [], 0
    for t in texts:
        if words + sum(1 for _ in islice(_WORD.finditer(t), most + 1)) <= most:
            made.append(_labelled(t, rng))
            words += len(made[-1][1])
    labels = [y for _, ys in made for y in ys]
    x, chain, skip = _batch([_graph(nodes) for nodes, _ in made])
    n = len(KINDS) + 1
    y = np.array(labels, np.int64)
    one = np.eye(n)[y]
    w, c, s = np.zeros((n, FEATURES)), np.zeros((n, n)), np.zeros((n, n))
    if not len(y):
        return Field(w, c, s)

    def heard(edges: np.ndarray, way: int) -> np.ndarray:
        out = np.zeros((len(y), n))
        np.add.at(out, edges[:, 1 - way], one[edges[:, way]])
        return out

    left, right, near = heard(chain, 0), heard(chain, 1), heard(skip, 0) + heard(skip, 1)
    for _ in range(steps):
        d = one - softmax(x @ w.T + left @ c + right @ c.T + near @ s)
        w += rate * (d.T @ x * 10 / len(y) - decay * w)
        c += rate * ((left.T @ d + d.T @ right) * 10 / len(y) - decay * c)
        g = near.T @ d * 10 / len(y)
        s += rate * ((g + g.T) / 2 - decay * s)
    return Field(w, c, s)


def marginals(field: Field, x: np.ndarray, chain: np.ndarray, skip: np.ndarray, known: np.ndarray | None = None, rounds: int = 30) -> np.ndarray:
    """Beliefs (nodes, labels) of nodes with features ``x``; chain edges join neighbours, ``known`` has the labels of nodes that are certain, and 0."""
    unary = x @ field.node.T
    _settle(unary, known)
    linked = np.zeros(len(x), bool)
    linked[chain[:, 1]] = True
    return beliefs(field, unary, linked, skip, rounds, still=0.0)


def _settle(unary: np.ndarray, known: np.ndarray | None) -> None:
    if known is not None:
        unary[known > 0] = np.where(np.arange(unary.shape[1]) == known[known > 0][:, None], 0.0, -50.0)


@dataclass
class Graph:
    """The nodes of one text: where they are, whether each is next to the one before, their scores by features, and skip edges."""

    starts: np.ndarray
    ends: np.ndarray
    linked: np.ndarray
    unary: np.ndarray
    skip: np.ndarray


def _pairs(keys: list[np.ndarray], nodes: list[np.ndarray]) -> np.ndarray:
    """Skip edges from the first node of each key to its others."""
    key, node = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (keys, nodes))
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.r_[True, key[1:] != key[:-1]][: len(key)]
    first = node[np.flatnonzero(new)][np.cumsum(new) - 1] if len(key) else node
    apart = first != node
    return np.unique(np.stack([first[apart], node[apart]], 1), axis=0) if apart.any() else np.zeros((0, 2), np.int64)


def _read(text: str, field: Field, scores: dict[str, np.ndarray]) -> Graph:
    """The graph of a text, whose words are looked at ``WORDS`` at a time; ``scores`` keeps those of words seen before."""
    places = np.fromiter((x for m in _WORD.finditer(text) for x in m.span()), np.int64).reshape(-1, 2)
    starts, ends = np.ascontiguousarray(places[:, 0]), np.ascontiguousarray(places[:, 1])
    n, k = len(starts), len(field.node)
    linked = np.zeros(n, bool)
    linked[1:] = starts[1:] - ends[:-1] <= 1
    unary = np.empty((n, k), np.float32)
    # runs of two to eight neighbours, whose digits are a key of each
    begin = np.flatnonzero(~linked)
    length = np.diff(np.r_[begin, n])
    short = begin[(length > 1) & (length <= 8)].tolist()
    size = dict(zip(short, length[(length > 1) & (length <= 8)].tolist(), strict=True))
    weights, plain = field.node.T.astype(np.float32), np.zeros(k, np.float32)
    keys, nodes, run, left, last = [], [], "", 0, ""
    for lo in range(0, n, WORDS):
        hi = min(lo + WORDS, n)
        words = [text[a:b] for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)]
        some_keys, some_nodes = [], []
        if len(scores) > 8 * WORDS:
            scores.clear()
        for i, w in enumerate(words):
            own = scores.get(w)
            if own is None:
                own = scores[w] = weights[_own(w)].sum(0)
            unary[lo + i] = own
            if lo + i in size:
                left = size[lo + i]
                run = "".join(d for a, b in zip(starts[lo + i : lo + i + left].tolist(), ends[lo + i : lo + i + left].tolist(), strict=True) for d in _DIGITS.findall(text[a:b]))
            elif not left:
                run = ""
            left = max(left - 1, 0)
            if len(w) >= 7 or len(run) >= 7 or "@" in w or "[at]" in w:
                for key in _keys(w, run):
                    some_keys.append(hash(key))
                    some_nodes.append(lo + i)
        keys.append(np.array(some_keys, np.int64))
        nodes.append(np.array(some_nodes, np.int64))
        first = [w[0] for w in [last or " ", *words]]
        after = text[starts[hi]] if hi < n else " "
        last = words[-1]
        near, next_near = linked[lo:hi], np.r_[linked[lo + 1 : hi + 1], np.zeros(max(0, hi + 1 - n), bool)]
        marks = np.array([*first, after])
        cued = np.array([_CUE.search(text, max(0, a - _AHEAD), a) is not None for a in starts[lo:hi].tolist()])
        for feature, holds in ((_BEFORE_PLUS, near & (marks[:-2] == "+")), (_BEFORE_BRACKET, near & (marks[:-2] == "(")), (_AFTER_BRACKET, next_near & (marks[2:] == "(")), (_CUED, cued)):
            unary[lo:hi] += np.where(holds[:, None], weights[feature], plain)
    return Graph(starts, ends, linked, unary, _pairs(keys, nodes))


def _more(text: str, graph: Graph, belief: np.ndarray, touched: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    """Words that the field is ``least`` sure of and no pattern touches."""
    kinds = belief.argmax(1)
    sure = np.flatnonzero((kinds != _OTHER) & (belief.max(1) >= least) & (touched == _OTHER))
    more: list[tuple[int, int, int]] = []
    for s, e, kind in zip(graph.starts[sure].tolist(), graph.ends[sure].tolist(), (kinds[sure] - 1).tolist(), strict=True):
        word = text[s:e]
        s += len(word) - len(word.lstrip(_TRIM))
        e -= len(word) - len(word.rstrip(_TRIM + "."))
        if more and more[-1][0] == kind == 3 and s - more[-1][2] <= 2:
            more[-1] = (kind, more[-1][1], e)
        elif s < e:
            more.append((kind, s, e))
    return more


def find(texts: Iterator[str] | list[str], field: Field, least: float = 0.9) -> Iterator[np.ndarray]:
    """For each text, rows (kind, start, end, base) in order of kind and start: the patterns' spans, and words the field is ``least`` sure of that none of them touches. What a pattern covers is certain.

    Texts go together as far as ``NODES`` nodes; one with more goes alone.
    """
    scores: dict[str, np.ndarray] = {}
    held: list[tuple[str, Graph, list, np.ndarray]] = []

    def settled() -> Iterator[np.ndarray]:
        sizes = [len(g.starts) for _, g, _, _ in held]
        base = np.cumsum([0, *sizes])
        unary = np.concatenate([g.unary for _, g, _, _ in held])
        _settle(unary, np.concatenate([known for *_, known in held]))
        skip = np.concatenate([g.skip + b for (_, g, _, _), b in zip(held, base[:-1], strict=True)])
        belief = beliefs(field, unary, np.concatenate([g.linked for _, g, _, _ in held]), skip)
        for k, (text, graph, spans, touched) in enumerate(held):
            more = _more(text, graph, belief[base[k] : base[k + 1]], touched, least)
            rows = np.array([(*x, 1) for x in spans] + [(*x, 0) for x in more], np.int64).reshape(-1, 4)
            # in order of kind and place; of equal ones, the pattern's last
            yield rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]

    total = 0
    for text in texts:
        graph, spans = _read(text, field, scores), base_spans(text)
        if held and total + len(graph.starts) > NODES:
            yield from settled()
            held, total = [], 0
        held.append((text, graph, spans, _covering(graph.starts, graph.ends, spans)))
        total += len(graph.starts)
    if held:
        yield from settled()


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))


def fit(docs: DataFrame, texts: int = 3000, chars: int = 10_000_000, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """The field, learned from at most ``texts`` texts with a digit or an at sign, those with the smallest hashes, as far as ``chars`` characters go.

    Repeated rows count once; an empty table, and one without such texts, give a field that finds nothing.
    """
    some = docs.where(F.col(text_col).rlike("[0-9@]")).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return train_field([r["text"] for r in bounded_sample(some, texts, chars)])


def masked(text: str, spans: np.ndarray) -> str:
    """``text`` with each span, or run of overlapping ones, as its kind in angle brackets."""
    out, done = [], 0
    for kind, a, b, _ in spans[np.lexsort((-spans[:, 2], spans[:, 1]))].tolist():
        if a >= done:
            out += [text[done:a], f"<{KINDS[kind].upper()}>"]
        done = max(done, b)
    return "".join(out) + text[done:]


def annotate(docs: DataFrame, field: Field, mask: bool = False, text_col: str = "text") -> DataFrame:
    """``docs`` with spans added: personal data of each whole text, in code points with exclusive ends; with ``mask`` they are replaced in the text.

    A null text stays null and has no spans, as has an empty one; repeated rows
    are each annotated; a clashing column of this name is replaced; an empty
    table stays empty.
    """

    names = pa.array(KINDS, pa.string())

    @F.arrow_udf(T.StructType([T.StructField("spans", SPANS), T.StructField("masked", T.StringType())]))
    def scan(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in tx.released(columns):
            data, bounds = tx.utf8(column)
            seen = np.concatenate([np.zeros(1, np.int64), np.cumsum(_MARK[data[bounds[0] : bounds[-1]]])])
            marks = np.flatnonzero(np.diff(seen[bounds - bounds[0]]))
            texts = (bytes(data[bounds[i] : bounds[i + 1]]).decode() for i in marks.tolist())
            count, found, new = np.zeros(len(column) + 1, np.int64), [np.zeros((0, 4), np.int64)], [None] * len(column)
            for i, got in zip(marks.tolist(), find(texts, field), strict=True):
                found.append(got)
                count[i + 1] = len(got)
                if mask and len(got):
                    new[i] = masked(bytes(data[bounds[i] : bounds[i + 1]]).decode(), got)
            kind, start, end, base = np.concatenate(found).T
            rows = pa.StructArray.from_arrays([names.take(pa.array(kind)), pa.array(np.ascontiguousarray(start)), pa.array(np.ascontiguousarray(end)), pa.array(base > 0)], ["kind", "start", "end", "base"])
            spans = pa.ListArray.from_arrays(pa.array(np.cumsum(count).astype(np.int32)), rows)
            yield pa.StructArray.from_arrays([spans, pa.array(new, pa.string())], ["spans", "masked"])

    # evaluated once, whatever stands above it; only texts that change come back
    found = bounded(docs).withColumn("_found", scan.asNondeterministic()(F.col(text_col).cast("string")))
    text = F.coalesce("_found.masked", text_col).alias(text_col) if mask else F.col(text_col)
    return found.select(*[text if c == text_col else F.col(c) for c in docs.columns if c != "spans"], F.col("_found.spans").alias("spans"))


def digest(spans: F.Column) -> F.Column:
    """kind:start:end, comma-joined; the spans are in order already."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = F.filter("spans", lambda s: s["base"])
    found = annotate(docs, fit(docs))
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(kind) for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
