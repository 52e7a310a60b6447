"""K-mers of whole columns of texts against a table that fits a worker's memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import sequences as sq

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[U(1), np.full(n - 1, base, U)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(31))


class KmerTable:
    """Words of one length by their hashes; a hit is confirmed sign by sign, so the counts are exact."""

    def __init__(self, words: list[str], k: int):
        self.k = k
        kept = sorted({w for w in words if len(w) == k})
        signs = np.frombuffer("".join(kept).encode("utf-32-le"), np.uint32).reshape(-1, k) if kept else np.zeros((0, k), np.uint32)
        hashes = self._hashes(signs.ravel(), len(kept) * k)[::k] if kept else np.zeros(0, U)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.signs = hashes[order], signs[order]
        #: The most words that share a hash, one but for rare accidents.
        self.most = int(np.unique(hashes, return_counts=True)[1].max()) if kept else 0
        low = np.zeros(1 << 16, bool)
        low[self.hashes & U(0xFFFF)] = True
        self.low = low

    def _hashes(self, signs: np.ndarray, n: int) -> np.ndarray:
        """A hash of the k signs from each place on; those at the end reach beyond it and mean nothing."""
        sums = np.cumsum((signs.astype(U) + U(1)) * _powers(_BASE, n))
        ends = np.minimum(np.arange(n) + self.k - 1, n - 1)
        return _mixed((sums[ends] - np.r_[U(0), sums[:-1]]) * _powers(_INVERSE, n))

    def _run(self, text: str, bounds: np.ndarray) -> np.ndarray:
        """Hits in each of the texts that lie at ``bounds`` in one string."""
        signs = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n, out = len(signs), np.zeros(len(bounds) - 1, np.int64)
        if n < self.k or not len(self.hashes):
            return out
        h = self._hashes(signs, n)
        of = np.repeat(np.arange(len(out)), np.diff(bounds))
        at = np.flatnonzero(self.low[h & U(0xFFFF)])
        at = at[at + self.k <= bounds[of[at] + 1]]
        first = np.searchsorted(self.hashes, h[at])
        hit = np.zeros(len(at), bool)
        for more in range(self.most):
            j = np.minimum(first + more, len(self.hashes) - 1)
            same = np.flatnonzero((self.hashes[j] == h[at]) & ~hit)
            hit[same] = (signs[at[same][:, None] + np.arange(self.k)] == self.signs[j[same]]).all(1)
        return np.bincount(of[at[hit]], minlength=len(out))

    def count(self, column: pa.Array, run: int = 1 << 18) -> np.ndarray:
        """How many k-mers of each text the table has; a null has none."""
        texts = ["" if t is None else t for t in column.to_pylist()]
        size = np.array([len(t) for t in texts], np.int64)
        total = np.r_[0, np.cumsum(size)]
        out, a = [np.zeros(0, np.int64)], 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(total, total[a] + run, side="right")) - 1)
            out.append(self._run("".join(texts[a:b]), total[a : b + 1] - total[a]))
            a = b
        return np.concatenate(out)


_TABLES: dict[int, KmerTable] = {}


def counter(known: DataFrame, k: int, most: int, both_strands: bool = False) -> Callable[[Column], Column] | None:
    """A function that counts a text's k-mers in a set (kmer) of at most ``most``; none where the set is larger.

    With ``both_strands`` the set is of canonical k-mers and a k-mer counts
    whose canonical form it has. The set goes to every executor once, and each
    worker arranges it once.
    """
    rows = known.select("kmer") if not both_strands else known.where(F.col("kmer") == sq.canonical(F.col("kmer"))).select(F.explode(F.array("kmer", sq.revcomp(F.col("kmer")))).alias("kmer"))
    words = [r[0] for r in rows.where(F.length("kmer") == k).distinct().limit(most + 1).collect()]
    if len(words) > most:
        return None
    shared = known.sparkSession.sparkContext.broadcast(words)
    number = shared._jbroadcast.id()

    @F.arrow_udf("long")
    def hits(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if number not in _TABLES:
            if len(_TABLES) > 3:
                _TABLES.clear()
            _TABLES[number] = KmerTable(shared.value, k)
        for column in columns:
            yield pa.array(_TABLES[number].count(column), pa.int64())

    return hits
