"""Simulated haplotypes, genotypes and reads; every draw comes from a seed and the row's own key, so reruns agree."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.expressions import draw

BASES = "ACGT"
_COMPLEMENT = str.maketrans("ACGTN", "TGCAN")


def _rng(seed: int, *key: object) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32("|".join(map(str, key)).encode())])


def random_sequence(n: int, rng: np.random.Generator) -> str:
    return "".join(np.array(list(BASES))[rng.integers(0, 4, n)])


def mutated(seq: str, rate: float, rng: np.random.Generator) -> str:
    """A sequence of which each base becomes another one with probability ``rate``."""
    s = np.array(list(seq))
    for i in np.flatnonzero(rng.random(len(s)) < rate):
        s[i] = rng.choice([b for b in BASES if b != s[i]])
    return "".join(s)


def _read(seq: str, quality: np.ndarray, insertions: float, deletions: float, rng: np.random.Generator, n: int) -> tuple[str, str]:
    """A read of ``n`` bases from the start of ``seq``, with errors by its qualities and small insertions and deletions."""
    out, i = [], 0
    while len(out) < n and i < len(seq):
        r = rng.random()
        if r < insertions:
            out.append(str(rng.choice(list(BASES))))
        elif r < insertions + deletions:
            i += 1
        else:
            wrong = rng.random() < 10 ** (-quality[len(out)] / 10)
            out.append(str(rng.choice([b for b in BASES if b != seq[i]])) if wrong else seq[i])
            i += 1
    return "".join(out), "".join(chr(33 + int(q)) for q in quality[: len(out)])


def simulated_reads(haplotypes: DataFrame, coverage: float = 15, read_length: int = 101, insert_mean: float = 200, insert_sd: float = 15, quality: tuple[float, float] = (35, 4), insertions: float = 0.0001, deletions: float = 0.0001, seed: int = 1) -> DataFrame:
    """(hap_id, read_id, mate, seq, qual, pos) of read pairs from haplotypes (hap_id, seq).

    Starts are Poisson at each position, the distance between the reads is
    normal, qualities are normal and rule the errors; the second mate is on the
    other strand. Haplotypes go independently of one another.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for name, seq in zip(p["hap_id"], p["seq"], strict=True):
                rng = _rng(seed, name)
                for start in np.repeat(np.arange(len(seq)), rng.poisson(coverage / (2 * read_length), len(seq))):
                    second = start + read_length + int(round(rng.normal(insert_mean, insert_sd)))
                    if second < 0 or second + read_length > len(seq):
                        continue
                    for mate, at, part in ((1, start, seq[start:]), (2, second, seq[: second + read_length][::-1].translate(_COMPLEMENT))):
                        q = np.clip(np.rint(rng.normal(*quality, read_length)), 2, 60)
                        s, qual = _read(part, q, insertions, deletions, rng, read_length)
                        rows.append((name, f"{name}:{start}:{second}:{len(rows) // 2}", mate, s, qual, int(at) + 1))
            yield pd.DataFrame(rows, columns=["hap_id", "read_id", "mate", "seq", "qual", "pos"])

    return haplotypes.select("hap_id", "seq").mapInPandas(run, "hap_id string, read_id string, mate int, seq string, qual string, pos int")


def perturbed(haplotypes: DataFrame, rate: float = 0.001, seed: int = 1) -> DataFrame:
    """Haplotypes (hap_id, seq) with point mutations."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"hap_id": p["hap_id"], "seq": [mutated(s, rate, _rng(seed, h)) for h, s in zip(p["hap_id"], p["seq"], strict=True)]})

    return haplotypes.select("hap_id", "seq").mapInPandas(run, "hap_id string, seq string")


def random_paths(edges: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """(graph, hap, level, edge_id) of ``n`` paths through each graph, every step drawn by the edges' counts; a walk is sequential, a graph is a group."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = {v: g for v, g in group.groupby("from_id")}
        first = group[group["level"] == group["level"].min()]
        rows = []
        for hap in range(1, n + 1):
            rng = _rng(seed, group["graph"].iloc[0], hap)
            at = first
            while at is not None and len(at):
                w = at["count"].to_numpy(float)
                e = at.iloc[int(rng.choice(len(at), p=w / w.sum()))]
                rows.append((e["graph"], hap, int(e["level"]), int(e["edge_id"])))
                at = out.get(e["to_id"])
        return pd.DataFrame(rows, columns=["graph", "hap", "level", "edge_id"])

    return edges.groupBy("graph").applyInPandas(run, "graph string, hap int, level int, edge_id long")


def phased_at_random(genotypes: DataFrame, seed: int = 1) -> DataFrame:
    """Genotypes (individual_id, locus_id, a1, a2) as haplotypes h1 and h2, in either order by the key's hash."""
    flip = draw(F.lit(seed), F.col("individual_id"), F.col("locus_id"), most=2) == 1
    return genotypes.select("individual_id", "locus_id", F.when(flip, F.col("a2")).otherwise(F.col("a1")).alias("h1"), F.when(flip, F.col("a1")).otherwise(F.col("a2")).alias("h2"))


def individual(panel: DataFrame, name: str, hidden: str | None = None) -> DataFrame:
    """One individual's alleles; those of loci that begin with ``hidden`` are unknown."""
    allele = F.col("allele") if hidden is None else F.when(F.col("locus_id").startswith(hidden), "?").otherwise(F.col("allele"))
    return panel.where(F.col("haplotype_id") == name).withColumn("allele", allele)
