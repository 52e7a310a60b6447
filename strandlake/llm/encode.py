"""Token ids of a public byte-level BPE vocabulary, for whole columns of texts."""

from __future__ import annotations

import base64
import json
from functools import cache, cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa

from strandlake.llm import text as tx

RUN = 1 << 22
_SPACE, _LINE = 32, 10
# White space beyond ASCII, which joins with what stands beside it.
_WIDE = "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_LEADS = np.zeros(256, bool)
_LEADS[sorted({c.encode()[0] for c in _WIDE})] = True
_ENDS = np.sort([int.from_bytes(c.encode().ljust(3, b"\0"), "big") for c in _WIDE])


def wide_spaces(raw: np.ndarray) -> np.ndarray:
    """Where white space beyond ASCII begins in UTF-8 bytes."""
    at = np.flatnonzero(_LEADS[raw])
    if not len(at):
        return at
    after = np.r_[raw, np.zeros(2, np.uint8)]
    code = (raw[at].astype(np.int64) << 16) | (after[at + 1].astype(np.int64) << 8) | np.where(raw[at] == 0xC2, 0, after[at + 2])
    return at[_ENDS[np.minimum(np.searchsorted(_ENDS, code), len(_ENDS) - 1)] == code]


def default_tokenizer() -> str:
    """Path of the vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes columns of texts as ``tokenizers`` does, adding no special tokens.

    A byte-level BPE splits a text before it merges: a single space opens a new
    piece and a single line feed is one, so words with what stands before them
    can be encoded apart, in any order. Each run of texts is cut into words at
    once and every different word of it encoded once, all in one call; texts
    with other white space, or with the text of an added token, are encoded
    whole. Where the vocabulary lies beside the JSON file as ranks too, the
    same ids come from the faster library; added tokens only the other knows.
    """

    def __init__(self, path: str, entries: int = 300_000):
        self.path, self.entries = path, entries
        self.added = [t["content"].encode() for t in json.loads(Path(path).read_text(encoding="utf-8")).get("added_tokens") or []]
        self._forget()
        ranks = Path(path).with_suffix(".tiktoken")
        if ranks.exists():
            import public_tokenizers
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.open("rb"))}
            model = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            self.encode = lambda text: model.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)
            self.size = np.zeros(max(table.values()) + 1, np.int64)
            self.size[list(table.values())] = [len(k) for k in table]
        else:
            self.encode = self.whole
            self.size = None

    @cached_property
    def model(self):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(self.path)
        model.no_truncation()
        model.no_padding()
        return model

    def whole(self, text: str) -> np.ndarray:
        """Ids of a text that may hold added tokens."""
        return np.asarray(self.model.encode(text, add_special_tokens=False).ids, np.uint32)

    def _added(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which texts hold the text of an added token."""
        out, held = np.zeros(len(bounds) - 1, bool), raw.tobytes()
        for token in self.added:
            at = held.find(token)
            while at >= 0:
                k = int(np.searchsorted(bounds, at, side="right")) - 1
                out[k] |= at + len(token) <= bounds[k + 1]
                at = held.find(token, at + 1)
        return out

    def _forget(self) -> None:
        self.known = np.zeros(0, tx.U)
        self.begin = self.stop = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _look_up(self, keys: np.ndarray, raw: np.ndarray, a: np.ndarray, b: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of sorted, distinct ``keys`` begin and end in the pool; those not there yet are encoded."""
        at = np.searchsorted(self.known, keys)
        new = at == len(self.known)
        new[~new] = self.known[at[~new]] != keys[~new]
        if new.any():
            ids, begin, stop = self._pieces(raw, a[new], b[new], lead[new])
            base = len(self.pool)
            self.begin = np.insert(self.begin, at[new], begin + base)
            self.stop = np.insert(self.stop, at[new], stop + base)
            self.known = np.insert(self.known, at[new], keys[new])
            self.pool = np.concatenate([self.pool, ids])
            at = np.searchsorted(self.known, keys)
        return self.begin[at], self.stop[at]

    def _pieces(self, raw: np.ndarray, a: np.ndarray, b: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words with what stands before them, one after another, and where each begins and ends in them."""
        if self.size is None:
            got = [self.encode(bytes(raw[i - (c > 0) : j]).decode()) for i, j, c in zip(a.tolist(), b.tolist(), lead.tolist(), strict=True)]
            stop = np.cumsum([len(x) for x in got])
            return np.concatenate(got) if got else np.zeros(0, np.uint32), np.r_[0, stop[:-1]].astype(np.int64), stop.astype(np.int64)
        length = b - a + 1
        stop = np.cumsum(length)
        start = stop - length
        flat = raw[np.maximum(np.repeat(a - 1 - start, length) + np.arange(int(length.sum())), 0)]
        flat[start] = np.where(lead == _SPACE, _SPACE, _LINE)
        ids = self.encode(flat.tobytes().decode())
        edge = np.searchsorted(np.cumsum(self.size[ids]), stop) + 1
        return ids, np.r_[0, edge[:-1]] + (lead == 0), edge

    def _run(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of one run, and how many each text has."""
        lo, n_texts = int(bounds[0]), len(bounds) - 1
        raw, starts, stops = data[lo : int(bounds[-1])], bounds[:-1] - lo, bounds[1:] - lo
        found = tx.words(data, bounds, lower=False)
        a, b, n = found.begin, found.end, len(found.begin)
        head = np.ones(n, bool)
        head[1:] = found.text[1:] != found.text[:-1]
        tail = np.ones(n, bool)
        tail[:-1] = head[1:]
        gap = a - starts[found.text]
        gap[1:][~head[1:]] = (a[1:] - b[:-1])[~head[1:]]
        lead = np.where(head, 0, raw[np.maximum(a - 1, 0)] if n else 0)
        wrong = np.where(head, gap != 0, (gap != 1) | ((lead != _SPACE) & (lead != _LINE)))
        wrong |= tail & (b != stops[found.text])
        odd = np.zeros(n_texts, bool)
        odd[found.text[wrong]] = True
        odd |= (found.count == 0) & (stops > starts)
        odd[np.searchsorted(starts, wide_spaces(raw), side="right") - 1] = True
        special = self._added(raw, np.r_[starts, stops[-1:]])
        odd |= special
        h, of = found.hashes, found.text
        if odd.any():
            take = ~odd[of]
            a, b, lead, h, of = a[take], b[take], lead[take], h[take], of[take]
        keys, first, inverse = np.unique(h + lead.astype(tx.U) * tx.U(0x9E3779B97F4A7C15), return_index=True, return_inverse=True)
        out, count = np.zeros(0, np.uint32), np.zeros(n_texts, np.int64)
        if len(first):
            if len(self.known) > self.entries:
                self._forget()
            start, stop = self._look_up(keys, raw, a[first], b[first], lead[first])
            length = (stop - start)[inverse]
            total = np.cumsum(length)
            out = self.pool[np.repeat(start[inverse] - total + length, length) + np.arange(int(total[-1]))]
            count = np.bincount(of, weights=length, minlength=n_texts).astype(np.int64)
        if odd.any():
            parts = np.split(out, np.cumsum(count)[:-1])
            for i in np.flatnonzero(odd).tolist():
                parts[i] = (self.whole if special[i] else self.encode)(bytes(raw[starts[i] : stops[i]]).decode())
                count[i] = len(parts[i])
            out = np.concatenate(parts)
        return out, count

    def column(self, column: pa.Array, end: int | None = None):
        """(first text, counts, ids) of each run of a string column; null counts as empty, ``end`` follows each text's ids."""
        data, bounds = tx.utf8(column)
        for i, j in tx.runs(bounds, RUN):
            ids, count = self._run(data, bounds[i : j + 1])
            if end is not None:
                ids, count = np.insert(ids, np.cumsum(count), end).astype(np.uint32), count + 1
            yield i, count, ids


@cache
def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary."""
    return Encoder(path)
