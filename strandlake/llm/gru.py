"""A bidirectional gated recurrent network over bytes, in numpy.

Every position gets a distribution over classes from the states of both
directions; a text's distribution is the mean over its positions. Arrays are
laid out (unit, lane), where a lane is a window of one text, so that thousands
of windows advance together. Gates and candidates use x / (1 + |x|) in place of
the sigmoid and the hyperbolic tangent, which numpy evaluates far faster.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from strandlake.llm import text as tx

F32 = np.float32
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (F32(1) + np.abs(x))


def _slope(y: np.ndarray) -> np.ndarray:
    """Derivative of x / (1 + |x|) by its value."""
    return np.square(F32(1) - np.abs(y))


@dataclass
class Model:
    """Weights: for each direction the bytes' table (3H, 257), the recurrence (3H, H) and the output (classes, H); the bias; the class names."""

    table: list[np.ndarray]
    turn: list[np.ndarray]
    out: list[np.ndarray]
    bias: np.ndarray
    names: list[str]

    @property
    def weights(self) -> list[np.ndarray]:
        return [*self.table, *self.turn, *self.out, self.bias]


PAD = 256


def new_model(names: list[str], hidden: int, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    normal = lambda *s, by: (rng.standard_normal(s) * by).astype(F32)
    return Model([normal(3 * hidden, 257, by=0.5) for _ in range(2)], [normal(3 * hidden, hidden, by=0.6 / hidden**0.5) for _ in range(2)], [normal(len(names), hidden, by=0.3) for _ in range(2)], np.zeros((len(names), 1), F32), names)


def _forward(table: np.ndarray, turn: np.ndarray, codes: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (steps, H, lanes) over codes (steps, lanes); padding leaves a state as it is."""
    steps, lanes = codes.shape
    n = turn.shape[1]
    h = np.zeros((n, lanes), F32)
    states, kept = np.empty((steps, n, lanes), F32), []
    for t in range(steps):
        x = np.take(table, codes[t], axis=1)
        u = turn @ h
        gates = x[: 2 * n] + u[: 2 * n]
        s = _soft(gates)
        z, r = F32(0.5) + F32(0.5) * s[:n], F32(0.5) + F32(0.5) * s[n:]
        c = _soft(x[2 * n :] + r * u[2 * n :])
        live = codes[t] != PAD
        after = np.where(live, h + z * (c - h), h)
        if keep:
            kept.append((h, s, z, r, c, u[2 * n :], live))
        h = after
        states[t] = h
    return states, kept


def _backward(table: np.ndarray, turn: np.ndarray, codes: np.ndarray, kept: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the table and the recurrence by backpropagation through time."""
    n = turn.shape[1]
    d_table, d_turn = np.zeros_like(table), np.zeros_like(turn)
    d_h = np.zeros_like(d_states[0])
    for t in range(len(codes) - 1, -1, -1):
        h, s, z, r, c, u_c, live = kept[t]
        d_h = d_h + d_states[t]
        d_in = np.where(live, d_h, F32(0))
        d_c = d_in * z * _slope(c)
        d_z = d_in * (c - h) * F32(0.5) * _slope(s[:n])
        d_r = d_c * u_c * F32(0.5) * _slope(s[n:])
        d_u = np.concatenate([d_z, d_r, d_c * r])
        d_x = np.concatenate([d_z, d_r, d_c])
        d_turn += d_u @ h.T
        order = np.argsort(codes[t], kind="stable")
        code = codes[t][order]
        at = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        d_table[:, code[at]] += np.add.reduceat(d_x[:, order], at, axis=1)
        d_h = d_h - d_in * z + turn.T @ d_u
    return d_table, d_turn


def _softmax(x: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def train(windows: list[bytes], classes: list[int], names: list[str], hidden: int, steps: int, length: int, batch: int = 192, rate: float = 0.02, seed: int = 7) -> Model:
    """Weights fitted by Adam to windows of at most ``length`` bytes; every position is to name its window's class."""
    model = new_model(names, hidden, seed)
    if not windows or len(names) < 2:
        return model
    rng = np.random.default_rng(seed)
    all_codes = np.full((len(windows), length), PAD, np.int64)
    for i, w in enumerate(windows):
        got = _FOLD[np.frombuffer(w[:length], np.uint8)]
        all_codes[i, : len(got)] = got
    target = np.asarray(classes)
    groups = [np.flatnonzero(target == k) for k in range(len(names))]
    groups = [g for g in groups if len(g)]
    first, second = [np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(g, batch // len(groups)) for g in groups])
        codes = all_codes[pick].T
        live = codes != PAD
        fore, kept_f = _forward(model.table[0], model.turn[0], codes, True)
        back, kept_b = _forward(model.table[1], model.turn[1], codes[::-1], True)
        logits = np.matmul(model.out[0], fore) + np.matmul(model.out[1], back[::-1]) + model.bias
        d = _softmax(logits, 1)
        d[:, target[pick], np.arange(len(pick))] -= 1
        d *= (live / max(1, live.sum()))[:, None, :].astype(F32)
        out = [np.einsum("tcb,thb->ch", d, fore), np.einsum("tcb,thb->ch", d, back[::-1])]
        d_f, d_b = np.matmul(model.out[0].T, d), np.matmul(model.out[1].T, d)[::-1]
        (tf, uf), (tb, ub) = _backward(model.table[0], model.turn[0], codes, kept_f, d_f), _backward(model.table[1], model.turn[1], codes[::-1], kept_b, d_b)
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(model.weights, [tf, tb, uf, ub, *out, d.sum((0, 2))[:, None]], first, second, strict=True):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(F32)
    return model


LANES = 4096


def _states(table: np.ndarray, turn: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """States as by ``_forward``, into arrays that are made once; padding is read as any code and must be masked later."""
    steps, lanes = codes.shape
    n = turn.shape[1]
    states = np.empty((steps, n, lanes), F32)
    x, u, s, a = (np.empty((3 * n, lanes), F32) for _ in range(4))
    h = np.zeros((n, lanes), F32)
    g, ga, z, r, c, ca = s[: 2 * n], a[: 2 * n], s[:n], s[n : 2 * n], s[2 * n :], a[2 * n :]
    for t in range(steps):
        np.take(table, codes[t], axis=1, out=x, mode="clip")
        np.matmul(turn, h, out=u)
        np.add(x[: 2 * n], u[: 2 * n], out=g)
        np.abs(g, out=ga)
        ga += F32(1)
        g /= ga
        g *= F32(0.5)
        g += F32(0.5)
        np.multiply(r, u[2 * n :], out=c)
        c += x[2 * n :]
        np.abs(c, out=ca)
        ca += F32(1)
        c /= ca
        c -= h
        c *= z
        h = np.add(h, c, out=states[t])
    return states


def label(model: Model, data: np.ndarray, bounds: np.ndarray, length: int) -> np.ndarray:
    """Mean distribution over the positions of each text at ``bounds`` in ``data``, (texts, classes); an empty text has the even one.

    Every byte of every text is labelled, in windows of ``length`` bytes.
    """
    n_texts, k = len(bounds) - 1, len(model.names)
    size = np.diff(bounds)
    many = -(-size // length)
    text = np.repeat(np.arange(n_texts), many)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    start = bounds[:-1][text] + nth * length
    live = np.minimum(length, bounds[1:][text] - start)
    order = np.argsort(-live, kind="stable")
    total = np.zeros((n_texts, k))
    for lo in range(0, len(order), LANES):
        lanes = order[lo : lo + LANES]
        steps = int(live[lanes[0]])
        step = np.arange(steps)[:, None]
        inside = step < live[lanes]
        fore = start[lanes] + np.minimum(step, live[lanes] - 1)
        back = start[lanes] + np.maximum(live[lanes] - 1 - step, 0)
        ahead = np.matmul(model.out[0], _states(model.table[0], model.turn[0], _FOLD[data[fore]]))
        behind = np.matmul(model.out[1], _states(model.table[1], model.turn[1], _FOLD[data[back]]))
        turned = np.maximum(live[lanes] - 1 - step, 0)
        if (live[lanes] == steps).all():
            ahead += behind[::-1]
        else:
            ahead += np.take_along_axis(behind, turned[:, None, :], 0)
        ahead += model.bias
        np.exp(np.clip(ahead, -30, 30, out=ahead), out=ahead)
        ahead *= (inside / ahead.sum(1))[:, None, :].astype(F32)
        sums = ahead.sum(0)
        for c in range(k):
            total[:, c] += np.bincount(text[lanes], weights=sums[c], minlength=n_texts)
    return np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], 1 / max(k, 1))


def runs(bounds: np.ndarray):
    return tx.runs(bounds, 1 << 20)
