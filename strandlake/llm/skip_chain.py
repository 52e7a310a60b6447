"""Marginals of skip-chain conditional random fields.

A sequence of nodes has chain edges between neighbours and skip edges between
any two. What only chain edges join is solved exactly, forward and backward;
skip edges pass loopy messages between such solutions, and only chains that a
message still moves are solved again. All work goes in blocks of nodes or
edges, so memory is that of the nodes' unary scores and beliefs, in single
precision, whatever the length of a chain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Nodes, or edges, that are worked on at once, and nodes of a segment of them.
BLOCK, SEGMENT = 1 << 15, 64


@dataclass
class Field:
    """Weights of the nodes (labels, features), the chain (left, right) and the skips (labels, labels; symmetric)."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class _Segments:
    """A block of nodes in segments that are run side by side. ``linked[i]``: node i is joined with the one before; it has an entry more, for the node after the last."""

    def __init__(self, scores: np.ndarray, linked: np.ndarray, turn: np.ndarray):
        n, k = scores.shape
        rows = -(-n // SEGMENT)
        weight = np.ones((rows * SEGMENT, k))
        weight[:n] = np.exp(scores - scores.max(1, keepdims=True))
        joined = np.ones(rows * SEGMENT, bool)
        joined[:n] = linked[1:]
        self.n, self.k, self.rows, self.turn = n, k, rows, turn
        # node s of every segment lies together
        self.weight = np.ascontiguousarray(weight.reshape(rows, SEGMENT, k).transpose(1, 0, 2))
        self.apart = [np.flatnonzero(~x) for x in joined.reshape(rows, SEGMENT).T]
        # nodes that only fill the last segment pass on what reaches them
        self.fill = rows * SEGMENT - n

    def enters(self, enter: np.ndarray) -> np.ndarray:
        """The message that reaches each segment, and the one that reaches the node after the last: first what each segment does to any message, then one after another."""
        effect = np.broadcast_to(np.eye(self.k), (self.rows, self.k, self.k)).copy()
        for s in range(SEGMENT):
            step = effect * self.weight[s][:, None, :]
            new = (step.reshape(-1, self.k) @ self.turn).reshape(step.shape)
            cut = self.apart[s]
            if len(cut):
                new[cut] = step[cut].sum(2, keepdims=True)
            if s >= SEGMENT - self.fill:
                new[-1] = effect[-1]
            effect = new if s % 4 else new / new.max((1, 2), keepdims=True)
        first = np.empty((self.rows + 1, self.k))
        first[0] = enter
        for g in range(self.rows):
            m = first[g] @ effect[g]
            first[g + 1] = m / m.max()
        return first

    def inside(self, first: np.ndarray) -> np.ndarray:
        """The message that reaches each node."""
        out, now = np.empty((SEGMENT, self.rows, self.k)), first[: self.rows]
        for s in range(SEGMENT):
            out[s] = now
            now = (now * self.weight[s]) @ self.turn
            now[self.apart[s]] = 1.0
            now /= now.max(1, keepdims=True)
        return out.transpose(1, 0, 2).reshape(-1, self.k)[: self.n]


def chain_beliefs(unary: np.ndarray, linked: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Exact marginals (nodes, labels) of nodes with log scores ``unary``, each joined with the one before where ``linked``."""
    n, k = unary.shape
    out, turn = np.empty((n, k), unary.dtype), np.exp(chain - chain.max())
    ends, cuts, enters, at = np.r_[linked, False], range(0, n, BLOCK), [], np.ones(k)
    for a in cuts:
        enters.append(_Segments(unary[a : a + BLOCK].astype(float), ends[a : a + BLOCK + 1], turn).enters(at))
        at = enters[-1][-1]
    back = np.ones(k)
    for a in reversed(cuts):
        scores, joins = unary[a : a + BLOCK].astype(float), ends[a : a + BLOCK + 1]
        forward = _Segments(scores, joins, turn).inside(enters.pop())
        # the other way, a node's link is that of the node after it
        other = _Segments(scores[::-1], joins[::-1], turn.T)
        first = other.enters(back)
        back = first[-1]
        out[a : a + BLOCK] = softmax(np.log(np.maximum(forward, 1e-300)) + np.log(np.maximum(other.inside(first)[::-1], 1e-300)) + scores)
    return out


def _blocks(n: int) -> Iterator[slice]:
    return (slice(a, a + BLOCK) for a in range(0, n, BLOCK))


def beliefs(field: Field, unary: np.ndarray, linked: np.ndarray, skip: np.ndarray, rounds: int = 30, still: float = 0.01, free: int = 4) -> np.ndarray:
    """Marginals with the skip edges (edges, 2) too: exact without any, else after at most ``rounds`` of messages along them, or when none moves by ``still``. All but the ``free`` first rounds are damped."""
    found = chain_beliefs(unary, linked, field.chain)
    m, k = len(skip), unary.shape[1]
    if not m:
        return found
    run = np.cumsum(~linked)
    begin = np.r_[np.flatnonzero(np.diff(run, prepend=run[0] - 1)), len(run)]
    number = run - run[0]
    source, target = np.r_[skip[:, 0], skip[:, 1]], np.r_[skip[:, 1], skip[:, 0]]
    message = np.zeros((2 * m, k), unary.dtype)
    for r in range(rounds):
        moved = np.zeros(2 * m, bool)
        new = np.empty_like(message)
        for s in _blocks(2 * m):
            opposite = (np.arange(s.start, min(s.stop, 2 * m)) + m) % (2 * m)
            out = (np.log(np.maximum(found[source[s]].astype(float), 1e-30)) - message[opposite])[:, :, None] + field.skip
            top = out.max(1)
            heard = np.log(np.exp(out - top[:, None, :]).sum(1)) + top
            old = 0.0 if r < free else 0.5
            new[s] = old * message[s] + (1 - old) * (heard - heard.max(1, keepdims=True))
            moved[s] = np.abs(new[s] - message[s]).max(1) > still
        message = new
        if not moved.any():
            break
        chains = np.unique(number[target[moved]])
        lengths = begin[chains + 1] - begin[chains]
        nodes = np.repeat(begin[chains] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        place = np.full(len(unary), -1, np.int64)
        place[nodes] = np.arange(len(nodes))
        scores = unary[nodes].copy()
        for s in _blocks(2 * m):
            to = place[target[s]]
            np.add.at(scores, to[to >= 0], message[s][to >= 0])
        found[nodes] = chain_beliefs(scores, linked[nodes], field.chain)
    return found
