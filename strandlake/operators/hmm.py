"""Diploid paths through a levelled graph: states, emissions, decoding."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import probability as pr
from strandlake.lineage import stash

FLOOR = 1e-200
#: Edges in a block.
BLOCK = 512


def edge_fractions(edges: DataFrame) -> DataFrame:
    """Edges (level, edge_id, from_id, to_id, count) with their share of their node's outgoing counts."""
    sums = edges.groupBy("level", "from_id").agg(F.sum("count").alias("_out"))
    return edges.join(sums, ["level", "from_id"]).withColumn("fraction", F.col("count") / F.col("_out")).drop("_out")


def _blocks(rows: DataFrame, by: list[str], items: list[str], name: str) -> DataFrame:
    """(by, name): the ``items`` of a group's rows in arrays of about ``BLOCK``."""
    size = rows.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
    placed = rows.join(size, by).withColumn("_block", F.pmod(F.xxhash64(*items), F.col("_blocks")))
    return placed.groupBy(*by, "_block").agg(F.collect_list(F.struct(*items)).alias(name)).drop("_block")


def _expanded(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` of blocks as pairs of their items, structs ``a`` and ``b``.

    Pairs of blocks are dealt evenly to many tasks before they grow, so neither
    few groups nor small inputs leave the growth to a few tasks.
    """
    tasks = 8 * pairs.sparkSession.sparkContext.defaultParallelism
    rest = [c for c in pairs.columns if c not in (a, b)]
    dealt = pairs.repartition(tasks)
    return dealt.select(*rest, b, F.explode(a).alias(a)).select(*rest, a, F.explode(b).alias(b))


def diploid_states(edges: DataFrame) -> DataFrame:
    """(level, e1, e2, p): ordered pairs of a level's edges; p, the product of the fractions, starts a path at the first level."""
    f = edge_fractions(edges)
    a, b = (_blocks(f, ["level"], ["edge_id", "fraction"], x) for x in ("a", "b"))
    return _expanded(a.join(b, "level"), "a", "b").select("level", F.col("a.edge_id").alias("e1"), F.col("b.edge_id").alias("e2"), (F.col("a.fraction") * F.col("b.fraction")).alias("p"))


def transitions(edges: DataFrame) -> DataFrame:
    """(level, edge, next_edge, p): an edge goes on with those that leave its end, by their fractions."""
    f = edge_fractions(edges)
    a = _blocks(f.select("level", "edge_id", F.col("to_id").alias("node")), ["level", "node"], ["edge_id"], "a")
    b = _blocks(f.select((F.col("level") - 1).alias("level"), "edge_id", F.col("from_id").alias("node"), "fraction"), ["level", "node"], ["edge_id", "fraction"], "b")
    return _expanded(a.join(b, ["level", "node"]), "a", "b").select("level", F.col("a.edge_id").alias("edge"), F.col("b.edge_id").alias("next_edge"), F.col("b.fraction").alias("p"))


def emissions(edge_kmers: DataFrame, counts: DataFrame, states: DataFrame, coverage: float, error_rate: float, level_kmers: DataFrame | None = None) -> DataFrame:
    """(level, e1, e2, ll): log-likelihood of a level's k-mer counts under each pair of edges.

    A pair's log-likelihood is that of all the level's k-mers being absent, plus
    a change for each that one of its edges has, so a state meets its own k-mers only.
    ``level_kmers`` (level, kmer) are the levels' k-mers, those of the edges where they are not given.
    """
    every = edge_kmers.select("level", "kmer").distinct() if level_kmers is None else level_kmers
    kmers = every.join(counts, "kmer", "left").select("level", "kmer", F.coalesce("n", F.lit(0)).cast("int").alias("n"))
    absent = pr.log_poisson(F.col("n"), F.lit(error_rate * coverage))
    kmers = kmers.withColumn("_absent", F.greatest(absent, F.lit(math.log(FLOOR))))
    base = kmers.groupBy("level").agg(F.sum("_absent").alias("_base"))
    ends = states.select("level", "e1", "e2", F.explode(F.array("e1", "e2")).alias("edge_id"))
    copies = ends.join(edge_kmers, ["level", "edge_id"]).groupBy("level", "e1", "e2", "kmer").agg(F.sum("copies").alias("copies"))
    present = F.greatest(pr.log_poisson(F.col("n"), F.col("copies") * coverage), F.lit(math.log(FLOOR)))
    change = copies.join(kmers, ["level", "kmer"]).groupBy("level", "e1", "e2").agg(F.sum(present - F.col("_absent")).alias("_d"))
    out = states.select("level", "e1", "e2").join(base, "level", "left").join(change, ["level", "e1", "e2"], "left")
    return out.select("level", "e1", "e2", (F.coalesce("_base", F.lit(0.0)) + F.coalesce("_d", F.lit(0.0))).alias("ll"))


def pair_emissions(edges: DataFrame, edge_kmers: DataFrame, counts: DataFrame, coverage: float, error_rate: float, digits: int | None = None) -> DataFrame:
    """(level, e1, e2, ll): ``emissions`` of all ordered pairs of a level's ``edges``, rounded to ``digits``.

    Edges of a level with the same k-mers as often are one class; a
    log-likelihood is worked out once for each pair of classes, and only then
    given to the pairs of their edges.
    """
    kmers = edge_kmers.groupBy("level", "edge_id", "kmer").agg(F.sum("copies").alias("copies"))
    profile = kmers.groupBy("level", "edge_id").agg(F.sort_array(F.collect_list(F.struct("kmer", "copies"))).alias("_kmers"))
    # an edge without k-mers has null, which groups as any other
    profiled = stash(edges.select("level", "edge_id").join(profile, ["level", "edge_id"], "left"), "profiles")
    classes = stash(profiled.groupBy("level", F.to_json("_kmers").alias("_same")).agg(F.min("edge_id").alias("_class"), F.first("_kmers").alias("_kmers")), "classes")
    members = profiled.withColumn("_same", F.to_json("_kmers")).select("level", "edge_id", "_same")
    named = members.join(classes.select("level", "_same", "_class"), (members["level"] == classes["level"]) & members["_same"].eqNullSafe(classes["_same"])).select(members["level"], "edge_id", "_class")
    own = classes.select("level", F.col("_class").alias("edge_id"), F.explode("_kmers").alias("k")).select("level", "edge_id", "k.*")
    a, b = (classes.select("level", F.col("_class").alias(x)) for x in ("e1", "e2"))
    ll = emissions(own, counts, a.join(b, "level"), coverage, error_rate, kmers.select("level", "kmer").distinct())
    ll = ll if digits is None else ll.withColumn("ll", F.round("ll", digits))
    a, b = (_blocks(named.withColumnRenamed("_class", x), ["level", x], ["edge_id"], f"_{x}") for x in ("e1", "e2"))
    pairs = ll.join(a, ["level", "e1"]).join(b, ["level", "e2"]).select("level", "ll", "_e1", "_e2")
    return _expanded(pairs, "_e1", "_e2").select("level", F.col("_e1.edge_id").alias("e1"), F.col("_e2.edge_id").alias("e2"), "ll")


def error_rate(counts: DataFrame, coverage: float, start: float = 0.01, least_change: float = 2.0, rounds: int = 50) -> float:
    """Error rate by expectation and maximisation on k-mers (n, group) of two-state levels, until the log-likelihood gains less than ``least_change``.

    Each round is one aggregate over all k-mers; only its sums come to the
    driver. No k-mers give ``start``; a likelihood that still gains after
    ``rounds`` raises RuntimeError.
    """
    rate, last = start, -math.inf
    per_count = counts.groupBy("n").agg(F.count("*").alias("w"))
    for _ in range(rounds):
        absent, present = F.exp(pr.log_poisson(F.col("n"), F.lit(rate * coverage))), F.exp(pr.log_poisson(F.col("n"), F.lit(coverage)))
        share = F.try_divide(absent, absent + present)
        ll = F.ln(F.greatest(0.5 * absent + 0.5 * present, F.lit(FLOOR)))
        s = per_count.agg(F.sum(F.col("w") * ll).alias("ll"), F.sum(F.col("w") * share * F.col("n")).alias("errors"), F.sum(F.col("w") * share).alias("weight")).first()
        if s is None or s["weight"] in (None, 0) or s["ll"] - last < least_change:
            return rate
        rate, last = max(1e-6, s["errors"] / s["weight"] / coverage), s["ll"]
    raise RuntimeError(f"the likelihood still gains after {rounds} rounds")


def viterbi(ll: list[np.ndarray], start: np.ndarray, steps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best paths (samples, levels) as numbers of states and their log-probabilities, for samples with the same states; the first of equal ones wins.

    ll: for each level (samples, states); start: (samples, states); steps: from each level's states (rows) to the next one's.
    """
    score, back = start + ll[0], []
    for t, here in zip(steps, ll[1:], strict=True):
        through = score[:, :, None] + t
        back.append(through.argmax(1))
        score = through.max(1) + here
    k = score.argmax(1)
    every = np.arange(len(k))
    best, path = score[every, k], [k]
    for pointer in reversed(back):
        path.append(pointer[every, path[-1]])
    return np.stack(path[::-1], 1), best


def sampled_paths(ll: list[np.ndarray], start: np.ndarray, steps: list[np.ndarray], n: int, seed: int) -> list[list[int]]:
    """State numbers of ``n`` paths of one sample drawn from the posterior: forward sums, scaled at each level, then draws backwards."""
    rng = np.random.default_rng(seed)
    forward = [start + ll[0]]
    for t, here in zip(steps, ll[1:], strict=True):
        through = forward[-1][:, None] + t
        top = np.where(np.isfinite(m := through.max(0)), m, 0)
        with np.errstate(divide="ignore"):
            forward.append(np.log(np.exp(through - top).sum(0)) + top + here)

    def draw(x: np.ndarray) -> int:
        p = np.exp(x - x.max())
        return int(rng.choice(len(p), p=p / p.sum()))

    out = []
    for _ in range(n):
        path = [draw(forward[-1])]
        for k in range(len(ll) - 2, -1, -1):
            path.append(draw(forward[k] + steps[k][:, path[-1]]))
        out.append(path[::-1])
    return out


def all_best_paths(ll: list[np.ndarray], start: np.ndarray, steps: list[np.ndarray], most: int = 1000) -> list[list[int]]:
    """State numbers of the paths of one sample that score as the best one and end as it does, in order, ``most`` of them; a step back branches where several states score alike."""
    score, before = [start + ll[0]], []
    for t, here in zip(steps, ll[1:], strict=True):
        through = score[-1][:, None] + t
        before.append(through == through.max(0))
        score.append(through.max(0) + here)
    paths = [[int(score[-1].argmax())]]
    for ties in reversed(before):
        paths = [[int(k), *p] for p in paths for k in np.flatnonzero(ties[:, p[0]])][:most]
    return sorted(paths)


_DECODED = "sample string, draw int, level int, state string, score double"


class _Steps:
    """Tables of log-probabilities between the states of one level and the next, made once for each pair of state lists."""

    def __init__(self, level: np.ndarray, a: np.ndarray, b: np.ndarray, p: np.ndarray):
        order = np.argsort(level, kind="stable")
        self.level, self.a, self.b, self.p = level[order], a[order], b[order], p[order]
        self.made: dict[tuple, np.ndarray] = {}

    def __call__(self, level: int, here: tuple, after: tuple) -> np.ndarray:
        key = (level, here, after)
        if key not in self.made:
            t = np.full((len(here), len(after)), -np.inf)
            rows, columns = {s: i for i, s in enumerate(here)}, {s: i for i, s in enumerate(after)}
            lo, hi = np.searchsorted(self.level, [level, level + 1])
            for f, g, p in zip(self.a[lo:hi], self.b[lo:hi], self.p[lo:hi], strict=True):
                if f in rows and g in columns and p > 0:
                    t[rows[f], columns[g]] = math.log(p)
            if len(self.made) > 100_000:
                self.made.clear()
            self.made[key] = t
        return self.made[key]


def _decoded(rows: pd.DataFrame, steps: _Steps, samples: int, seed: int, ties: int = 0) -> pd.DataFrame:
    """Paths of whole samples, whose rows are in order of sample, level and state; samples with the same levels and states go together."""
    name, level, state = rows["sample"].to_numpy(), rows["level"].to_numpy(np.int64), rows["state"].to_numpy()
    ll, start = rows["ll"].to_numpy(float), rows["start"].to_numpy(float)
    code = pd.factorize(state)[0]
    edge = np.r_[0, np.flatnonzero(name[1:] != name[:-1]) + 1, len(name)]
    alike: dict[tuple, list[int]] = {}
    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        alike.setdefault((level[i:j].tobytes(), code[i:j].tobytes()), []).append(i)
    parts = []
    for (shape, _), firsts in alike.items():
        mine = np.frombuffer(shape, np.int64)
        at = np.array(firsts)
        cut = np.r_[0, np.flatnonzero(mine[1:] != mine[:-1]) + 1, len(mine)]
        levels = mine[cut[:-1]]
        names = [tuple(state[firsts[0] + a : firsts[0] + b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        table = [steps(int(levels[k]), names[k], names[k + 1]) for k in range(len(levels) - 1)]
        each = [ll[at[:, None] + np.arange(a, b)] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        begin = start[at[:, None] + np.arange(cut[1])]
        path, score = viterbi(each, begin, table)
        parts.append((np.repeat(name[at], len(levels)), 0, np.tile(levels, len(at)), state[(at[:, None] + cut[:-1] + path).ravel()], np.repeat(score, len(levels))))
        for k in range(len(at)) if ties else ():
            for d, tied in enumerate(all_best_paths([x[k] for x in each], begin[k], table, ties)):
                if tied != path[k].tolist():
                    parts.append((np.repeat(name[at[k]], len(levels)), -d - 1, levels, state[at[k] + cut[:-1] + np.array(tied)], np.repeat(score[k], len(levels))))
        for k in range(len(at)) if samples else ():
            for d, drawn in enumerate(sampled_paths([x[k] for x in each], begin[k], table, samples, seed), 1):
                parts.append((np.repeat(name[at[k]], len(levels)), d, levels, state[at[k] + cut[:-1] + np.array(drawn)], np.full(len(levels), np.nan)))
    return pd.concat([pd.DataFrame({"sample": a, "draw": d, "level": v, "state": s, "score": x}) for a, d, v, s, x in parts]) if parts else pd.DataFrame(columns=["sample", "draw", "level", "state", "score"])


def decode(states: DataFrame, steps: DataFrame, samples: int = 0, seed: int = 1, most_steps: int = 1_000_000, ties: int = 0) -> DataFrame:
    """(sample, draw, level, state, score): the best path of each sample as draw 0, then ``samples`` paths from its posterior; up to ``ties`` others that are as good and end alike have negative numbers.

    states: (sample, level, state, ll, start), start the log-probability to
    begin with, used at the first level; steps: (level, from_state, to_state, p),
    the same for all samples. The recursion runs along the levels, so a sample
    stays in one task, which decodes many at once; its memory is a batch's
    samples. Steps of at most ``most_steps`` rows go to every task once; more
    are joined to each sample by level.
    """
    steps = steps.select("level", "from_state", "to_state", "p")
    rows = states.select(F.col("sample").cast("string").alias("sample"), F.col("level").cast("int").alias("level"), F.col("state").cast("string").alias("state"), "ll", "start")
    if (table := steps.limit(most_steps + 1).toPandas()).shape[0] > most_steps:

        def one(key: tuple, mine: pd.DataFrame, moves: pd.DataFrame) -> pd.DataFrame:
            mine = mine.sort_values(["level", "state"])
            return _decoded(mine, _Steps(*(moves[c].to_numpy() for c in ("level", "from_state", "to_state", "p"))), samples, seed, ties)

        each = rows.select(F.col("sample").alias("_sample"), F.col("level").alias("_level")).distinct().join(steps, F.col("_level") == F.col("level")).drop("_level")
        return rows.groupBy("sample").cogroup(each.groupBy("_sample")).applyInPandas(one, _DECODED)
    shared = states.sparkSession.sparkContext.broadcast(table)

    def many(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        moves = _Steps(*(shared.value[c].to_numpy() for c in ("level", "from_state", "to_state", "p")))
        held: list[pd.DataFrame] = []
        for part in parts:
            if not len(part):
                continue
            cut = int(part["sample"].searchsorted(part["sample"].iloc[-1]))
            if cut or (held and held[-1]["sample"].iloc[-1] != part["sample"].iloc[-1]):
                yield _decoded(pd.concat([*held, part.iloc[:cut]], ignore_index=True), moves, samples, seed, ties)
                held = []
            held.append(part.iloc[cut:])
        if held:
            yield _decoded(pd.concat(held, ignore_index=True), moves, samples, seed, ties)

    return rows.repartition("sample").sortWithinPartitions("sample", "level", "state").mapInPandas(many, _DECODED)
