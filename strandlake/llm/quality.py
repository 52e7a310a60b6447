"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded by the shares of its
byte-class pairs and how much its words repeat, a gated attention learned from
document labels alone weighs the passages, and the weighted passage
representation is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import text as tx
from strandlake.llm.language import fold
from strandlake.llm.store import bounded, bounded_sample, fewest_hashes

#: Bytes in a passage.
PASSAGE = 512
_CLASSES = 14
FEATURES = _CLASSES * _CLASSES + _CLASSES + 3


def _byte_classes() -> np.ndarray:
    """Vowels, other small letters, capitals, digits, space, line feed, other white space, full stop and comma, marks of a sentence, quotes and brackets, signs, bars and slashes, lead bytes, other high bytes."""
    c = np.full(256, 10, np.int64)
    for k, some in enumerate((b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\t\x0b\x0c\r", b".,", b"!?;:", b"'\"()[]{}-")):
        c[list(some)] = k
    c[list(b"|/\\<>")] = 11
    c[0xC0:], c[0x80:0xC0] = 12, 13
    return c


_CLASS = _byte_classes()


def encode(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passages, features) and the text of each passage; every byte of every text is in one passage, and an empty text has one empty passage."""
    lo, n_texts = int(bounds[0]), len(bounds) - 1
    raw, size = data[lo : int(bounds[-1])], np.diff(bounds)
    many = np.maximum(1, -(-size // PASSAGE))
    text = np.repeat(np.arange(n_texts), many)
    first = np.cumsum(many) - many
    n = len(text)
    x = np.zeros((n, FEATURES), np.float32)
    if len(raw):
        of = np.repeat(first, size) + (np.arange(len(raw)) - np.repeat(bounds[:-1] - lo, size)) // PASSAGE
        c = _CLASS[raw]
        length = np.bincount(of, minlength=n)
        single = np.bincount(of * _CLASSES + c, minlength=n * _CLASSES).reshape(n, _CLASSES)
        pair_of = of[:-1] * (_CLASSES * _CLASSES) + c[:-1] * _CLASSES + c[1:]
        pairs = np.bincount(pair_of[of[1:] == of[:-1]], minlength=n * _CLASSES * _CLASSES).reshape(n, -1)
        by = np.maximum(length, 1)[:, None]
        x[:, : _CLASSES * _CLASSES] = np.sqrt(pairs / by)
        x[:, _CLASSES * _CLASSES : -3] = np.sqrt(single / by)
        found = tx.words(data, bounds)
        if len(found.hashes):
            order = np.lexsort((found.hashes, found.text))
            h, t = found.hashes[order], found.text[order]
            again = np.bincount(t[1:][(h[1:] == h[:-1]) & (t[1:] == t[:-1])], minlength=n_texts)
            x[:, -3] = (again / np.maximum(found.count, 1))[text]
    x[:, -2] = np.minimum(1, np.log1p(size) / 14)[text]
    x[:, -1] = 1
    return x, text


@dataclass
class Model:
    """Encoder (hidden, features), attention value and gate (units, hidden), attention weights (units), score (hidden), bias."""

    encoder: np.ndarray
    value: np.ndarray
    gate: np.ndarray
    attend: np.ndarray
    score: np.ndarray
    bias: np.ndarray

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.encoder, self.value, self.gate, self.attend, self.score, self.bias]


def _segments(text: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, text[1:] != text[:-1]])


def forward(m: Model, x: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, dict]:
    """Probability of label 1 for each text, and what backpropagation needs."""
    at = _segments(text)
    rank = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(text)]))
    h = np.maximum(0, x @ m.encoder.T)
    v, g = np.tanh(h @ m.value.T), 1 / (1 + np.exp(-(h @ m.gate.T)))
    e = (v * g) @ m.attend
    a = np.exp(e - np.maximum.reduceat(e, at)[rank])
    a /= np.add.reduceat(a, at)[rank]
    z = np.add.reduceat(a[:, None] * h, at)
    p = 1 / (1 + np.exp(-np.clip(z @ m.score + m.bias[0], -30, 30)))
    return p, {"at": at, "rank": rank, "h": h, "v": v, "g": g, "a": a, "z": z}


def gradients(m: Model, x: np.ndarray, keep: dict, d: np.ndarray) -> list[np.ndarray]:
    """Gradients of all weights, ``d`` being that of the loss by each text's score before the logistic function."""
    at, rank, h, v, g, a, z = (keep[k] for k in ("at", "rank", "h", "v", "g", "a", "z"))
    d_z = d[:, None] * m.score
    each = d_z[rank]
    d_a = (each * h).sum(1)
    d_e = a * (d_a - np.add.reduceat(a * d_a, at)[rank])
    d_vg = d_e[:, None] * m.attend
    d_v, d_g = d_vg * g * (1 - v * v), d_vg * v * g * (1 - g)
    d_h = (a[:, None] * each + d_v @ m.value + d_g @ m.gate) * (h > 0)
    return [d_h.T @ x, d_v.T @ h, d_g.T @ h, (v * g).T @ d_e, z.T @ d, d.sum(keepdims=True)]


def train(texts: list[str], labels: list[int], hidden: int = 16, units: int = 8, epochs: int = 30, batch: int = 64, rate: float = 0.01, seed: int = 5) -> Model:
    """Weights by Adam on the mean logistic loss of documents, both labels weighing the same."""
    rng = np.random.default_rng(seed)
    normal = lambda *s: (rng.standard_normal(s) / s[-1] ** 0.5).astype(np.float32)
    m = Model(normal(hidden, FEATURES) * 3, normal(units, hidden), normal(units, hidden), normal(units), normal(hidden), np.zeros(1, np.float32))
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        m.score[:] = 0
        m.bias[:] = 4 if len(y) and y[0] else -4 if len(y) else 0
        return m
    data, bounds = tx.utf8(pa.array(texts, pa.string()))
    parts = [(i, *encode(data, bounds[i : j + 1])) for i, j in tx.runs(bounds)]
    x, text = np.concatenate([p for _, p, _ in parts]), np.concatenate([i + t for i, _, t in parts])
    edge = np.searchsorted(text, np.arange(len(y) + 1))
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    first, second, step = [np.zeros_like(w) for w in m.weights], [np.zeros_like(w) for w in m.weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            some = order[lo : lo + batch]
            rows = np.concatenate([np.arange(edge[i], edge[i + 1]) for i in some])
            p, keep = forward(m, x[rows], np.repeat(np.arange(len(some)), np.diff(edge)[some]))
            step += 1
            for w, g, a, b in zip(m.weights, gradients(m, x[rows], keep, (p - y[some]) * weight[some] / len(some)), first, second, strict=True):
                g = g + 1e-4 * w
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


def fit(docs: DataFrame, labels: DataFrame, texts: int = 4000, chars: int = 40_000_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model learned from at most ``texts`` labelled texts, those with the smallest hashes, as far as ``chars`` characters go.

    Labels of documents whose crc32(id) mod 5 is 0 are never seen. Null texts
    and ids, and null labels, teach nothing; of several labels of one id the
    highest counts; equal rows count once. No labels give a model that scores all
    texts alike.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, 5) != 0))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max("quality").alias("label"))
    known = fewest_hashes(known, F.xxhash64("id"), texts).orderBy("_hash", "id").limit(texts).drop("_hash")
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "id")
    got = bounded_sample(rows, texts, chars)
    return train([r["text"] for r in got], [int(r["label"] > 0) for r in got])


def score(docs: DataFrame, model: Model, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1, higher: label 1 likelier) and predicted (1 from ``least`` on) added.

    All passages of a text count. A null text is scored as an empty one, which
    is one empty passage; repeated rows have equal scores; clashing columns of
    these names are replaced; an empty table stays empty.
    """

    @F.arrow_udf("double")
    def probability(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in tx.released(columns):
            data, bounds = tx.utf8(column)
            parts = [forward(model, *encode(data, bounds[i : j + 1]))[0] for i, j in tx.runs(bounds)]
            yield pa.array(np.concatenate(parts).astype(np.float64) if parts else np.zeros(0))

    # evaluated once, whatever stands above it
    found = bounded(docs).withColumn("_score", probability.asNondeterministic()(F.col(text_col).cast("string")))
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    return found.select(*kept, F.col("_score").alias("score"), (F.col("_score") >= least).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
