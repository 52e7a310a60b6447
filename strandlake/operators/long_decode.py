"""Decoding of samples whose levels are too many for one task.

Levels are cut into blocks. Each block is one matrix, from the states before it
to those at its end, in which a product takes a maximum of sums; a scan over a
sample's blocks gives the scores that enter each; with them every block traces
its own pointers back. Only matrices and the blocks' ends meet in a sample's
task: its levels by ``block``, times its states squared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.lineage import stash
from strandlake.operators.hmm import _Steps

_ROWS = "sample string, block long, kind string, level int, a string, b string, x double, y double"
_DECODED = "sample string, draw int, level int, state string, score double"


class _Block:
    """Levels, states and steps of one block of a sample, and, where it has one, the level before it."""

    def __init__(self, rows: pd.DataFrame):
        kind = rows["kind"].to_numpy()
        own = rows[(kind == "state") | (kind == "before")].sort_values(["level", "a"])
        moves = rows[kind == "step"]
        steps = _Steps(*(moves[c].to_numpy() for c in ("level", "a", "b", "x")))
        self.sample, self.number = rows["sample"].iloc[0], int(rows["block"].iloc[0])
        level, names, ll, start = own["level"].to_numpy(), own["a"].to_numpy(), own["x"].to_numpy(float), own["y"].to_numpy(float)
        cut = np.r_[0, np.flatnonzero(np.diff(level)) + 1, len(level)]
        self.levels = level[cut[:-1]]
        if (np.diff(self.levels) != 1).any():
            raise ValueError(f"levels of sample {self.sample} are no consecutive numbers")
        self.names = [tuple(names[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
        self.ll = [ll[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]
        self.start = start[: cut[1]]
        self.goes_on = (own["kind"].to_numpy() == "before").any()
        self.steps = [steps(int(at), a, b) for at, a, b in zip(self.levels[:-1], self.names[:-1], self.names[1:], strict=True)]

    def matrix(self) -> np.ndarray:
        """Best scores from each state before the block, or from its beginning, to each at its end."""
        first = np.where(np.eye(len(self.names[0])) > 0, 0.0, -np.inf) if self.goes_on else (self.start + self.ll[0])[None]
        for t, here in zip(self.steps, self.ll[1:], strict=True):
            first = (first[:, :, None] + t).max(1) + here
        return first

    def pointers(self, entry: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Scores at the end, and for each level the best state of the one before; of equal ones the first."""
        score, back = entry if self.goes_on else self.start + self.ll[0], []
        for t, here in zip(self.steps, self.ll[1:], strict=True):
            through = score[:, None] + t
            back.append(through.argmax(0))
            score = through.max(0) + here
        return score, back

    def entry(self, rows: pd.DataFrame) -> np.ndarray | None:
        known = rows[rows["kind"] == "entry"]
        found = dict(zip(known["a"], known["x"], strict=True))
        return np.array([found[s] for s in self.names[0]]) if self.goes_on else None


def _products(rows: pd.DataFrame) -> pd.DataFrame:
    block = _Block(rows)
    m = block.matrix()
    ends, begins = block.names[-1], block.names[0] if block.goes_on else (None,)
    made = [(block.sample, block.number, a, b, m[i, j]) for i, a in enumerate(begins) for j, b in enumerate(ends)]
    return pd.DataFrame(made, columns=["sample", "block", "a", "b", "x"])


def _entries(rows: pd.DataFrame) -> pd.DataFrame:
    """Scores that enter each block of a sample, from the blocks' matrices in order."""
    made, score = [], None
    for number, mine in rows.sort_values("block").groupby("block"):
        if mine["a"].isna().all() != (score is None):
            raise ValueError(f"levels of sample {mine['sample'].iloc[0]} are no consecutive numbers")
        if score is not None:
            made += [(mine["sample"].iloc[0], number, s, x) for s, x in score.items()]
        through = mine["x"] + (mine["a"].map(score) if score is not None else 0.0)
        score = through.groupby(mine["b"]).max().to_dict()
    return pd.DataFrame(made, columns=["sample", "block", "a", "x"])


def _ways(rows: pd.DataFrame) -> pd.DataFrame:
    """From each state at a block's end, the state before the block on its best path, and its score."""
    block = _Block(rows)
    score, back = block.pointers(block.entry(rows))
    at = np.arange(len(score))
    for pointer in reversed(back):
        at = pointer[at]
    before = [block.names[0][k] if block.goes_on else None for k in at]
    return pd.DataFrame({"sample": block.sample, "block": block.number, "a": before, "b": block.names[-1], "x": score})


def _chosen(rows: pd.DataFrame) -> pd.DataFrame:
    """The state at each block's end on the sample's best path, and its score; from the last block back."""
    made, state, best = [], None, None
    for number, mine in sorted(rows.groupby("block"), reverse=True):
        mine = mine.sort_values("b")
        if state is None:
            state, best = mine["b"].iloc[int(mine["x"].to_numpy().argmax())], mine["x"].max()
        made.append((mine["sample"].iloc[0], number, state, best))
        state = mine.loc[mine["b"] == state, "a"].iloc[0]
    return pd.DataFrame(made, columns=["sample", "block", "a", "x"])


def _traced(rows: pd.DataFrame) -> pd.DataFrame:
    block = _Block(rows)
    _, back = block.pointers(block.entry(rows))
    end = rows[rows["kind"] == "end"].iloc[0]
    at = [block.names[-1].index(end["a"])]
    for pointer in reversed(back):
        at.append(int(pointer[at[-1]]))
    path = [(level, names[k]) for level, names, k in zip(block.levels, block.names, reversed(at), strict=True)][int(block.goes_on) :]
    return pd.DataFrame([(block.sample, 0, level, state, end["x"]) for level, state in path], columns=["sample", "draw", "level", "state", "score"])


def decode_long(states: DataFrame, steps: DataFrame, block: int = 2048) -> DataFrame:
    """(sample, draw, level, state, score): the best path of each sample, as ``hmm.decode`` finds it, with no task that holds a sample's levels.

    states and steps are those of ``hmm.decode``; a sample's levels must be
    consecutive numbers, else the job fails. Of paths that score alike the one
    is taken that ``hmm.decode`` takes; where sums are not exact, rounding may
    part scores that would be alike. An empty table gives no rows; rows with a
    null sample, level or state are left out.
    """
    at = F.floor(F.col("level") / F.lit(block)).cast("long")
    none = F.lit(None)
    known = states.where(F.col("sample").isNotNull() & F.col("level").isNotNull() & F.col("state").isNotNull())
    own = known.select(F.col("sample").cast("string").alias("sample"), at.alias("block"), F.lit("state").alias("kind"), F.col("level").cast("int").alias("level"), F.col("state").cast("string").alias("a"), none.cast("string").alias("b"), F.col("ll").cast("double").alias("x"), F.col("start").cast("double").alias("y"))
    own = stash(own, "states")
    # the last level of a block also stands before the next one
    blocks = own.select("sample", "block").distinct()
    before = own.where((F.col("level") + 1) % block == 0).withColumns({"block": F.col("block") + 1, "kind": F.lit("before")}).join(blocks, ["sample", "block"], "left_semi")
    into = F.floor((F.col("level") + 1) / F.lit(block)).cast("long")
    moves = steps.select(into.alias("block"), F.lit("step").alias("kind"), F.col("level").cast("int").alias("level"), F.col("from_state").cast("string").alias("a"), F.col("to_state").cast("string").alias("b"), F.col("p").cast("double").alias("x"))
    dealt = stash(own.unionByName(before.select(own.columns)).unionByName(blocks.join(moves, "block").withColumn("y", none.cast("double")).select(own.columns)), "blocks")

    def with_rows(more: DataFrame, kind: str) -> DataFrame:
        rows = more.select("sample", "block", F.lit(kind).alias("kind"), none.cast("int").alias("level"), "a", none.cast("string").alias("b"), "x", none.cast("double").alias("y"))
        return dealt.unionByName(rows)

    products = stash(dealt.groupBy("sample", "block").applyInPandas(_products, "sample string, block long, a string, b string, x double"), "products")
    entries = stash(products.groupBy("sample").applyInPandas(_entries, "sample string, block long, a string, x double"), "entries")
    dealt = stash(with_rows(entries, "entry"), "entered")
    ways = dealt.groupBy("sample", "block").applyInPandas(_ways, "sample string, block long, a string, b string, x double")
    ends = stash(ways.groupBy("sample").applyInPandas(_chosen, "sample string, block long, a string, x double"), "ends")
    return with_rows(ends, "end").groupBy("sample", "block").applyInPandas(_traced, _DECODED)
