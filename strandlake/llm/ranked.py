"""Ranked lexical search: integer term scores, summed window by window of documents.

One pass over the documents writes postings in windows of a fixed number of
documents, with the statistics that weights need. A second one traverses each
window's postings: the scores of an item's terms are added into one array of
the window's size, a bitset tells which documents were touched, and those
above an item's tenth best so far go into its heap. Only the heaps are shuffled.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.lineage import stash
from strandlake.llm import text as tx
from strandlake.llm.store import bounded

#: Documents of a window (at most 65,536), whose scores fill 32 KB, and postings beyond which one is closed early.
WINDOW, POSTINGS = 4096, 1 << 20
#: Items of a round, and their characters; a round's terms are sent to every worker.
ITEMS, CHARS = 50_000, 25_000_000
_GAP = np.zeros(256, bool)
_GAP[:128] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _GAP[_a:_b] = False
_INDEX = "ids array<long>, lengths binary, terms binary, starts binary, docs binary, tfs binary"


@dataclass
class Terms:
    """Terms of a round's items: sorted hashes, with their bytes one after another from ``begin`` on, and a table that tells by 16 bits which hashes can be there."""

    hashes: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    data: np.ndarray
    low: np.ndarray


def _lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def _spelled(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Bytes of the words at ``begin``, one word after another."""
    first = np.cumsum(length) - length
    return data[np.repeat(begin - first, length) + np.arange(int(length.sum()))]


def vocabulary(texts: list[str]) -> tuple[Terms, list[dict[int, int]]]:
    """Different terms of all texts, and for each text how often it has each, by their numbers."""
    data, bounds = tx.utf8(pa.array(texts, pa.string()))
    found = tx.words(data, bounds, gap=_GAP)
    hashes, first, number = np.unique(found.hashes, return_index=True, return_inverse=True)
    length = (found.end - found.begin)[first]
    low = np.zeros(1 << 16, bool)
    low[hashes & tx.U(0xFFFF)] = True
    spelled = _spelled(_lowered(data[bounds[0] :]), found.begin[first], length)
    terms = Terms(hashes, np.cumsum(length) - length, length, spelled, low)
    counts = [dict(Counter(x.tolist())) for x in np.split(number, np.cumsum(found.count)[:-1])] if texts else []
    return terms, counts


def _hits(terms: Terms, raw: np.ndarray, found: tx.Words) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that are among the terms, sign by sign, and the terms' numbers."""
    at = np.flatnonzero(terms.low[found.hashes & tx.U(0xFFFF)])
    if not len(at) or not len(terms.hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    number = np.minimum(np.searchsorted(terms.hashes, found.hashes[at]), len(terms.hashes) - 1)
    length = found.end[at] - found.begin[at]
    same = (terms.hashes[number] == found.hashes[at]) & (terms.length[number] == length)
    at, number, length = at[same], number[same], length[same]
    if not len(at):
        return at, number
    differ = _lowered(_spelled(raw, found.begin[at], length)) != _spelled(terms.data, terms.begin[number], length)
    if differ.any():
        good = np.add.reduceat(differ, np.cumsum(length) - length) == 0
        at, number = at[good], number[good]
    return at, number


def _postings(terms: Terms, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: first text, texts, terms of each with repeats, and (text, term, times) in order of text and term."""
    data, bounds = tx.utf8(column)
    for i, j in tx.runs(bounds):
        found = tx.words(data, bounds[i : j + 1], gap=_GAP)
        at, number = _hits(terms, data[bounds[i] : bounds[j]], found)
        size = max(1, len(terms.hashes))
        pair, tf = np.unique(found.text[at] * size + number, return_counts=True)
        yield i, j - i, found.count, pair // size, pair % size, tf


def index(docs: DataFrame, terms: Terms, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each window of at most ``window`` documents: their ids and lengths, and postings of ``terms``, which each worker is sent once, as blobs.

    Of the term ``terms[k]``, ``docs`` and ``tfs`` have the places in the
    window and the counts from ``starts[k]`` on; lengths count all terms of a
    whole text. Windows are cut along the input, with no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, held, n, postings = sent.value, [], 0, 0

        def row() -> pa.RecordBatch:
            number, doc, tf = (np.concatenate([h[k] for h in held]) for k in (2, 3, 4))
            order = np.argsort(number, kind="stable")
            present, starts = np.unique(number[order], return_index=True)
            blobs = (np.concatenate([h[1] for h in held]).astype("<i8"), present.astype("<i4"), starts.astype("<i4"), doc[order].astype("<u2"), tf[order].astype("<i4"))
            ids = pa.concat_arrays([h[0] for h in held])
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([lists, *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], ["ids", "lengths", "terms", "starts", "docs", "tfs"])

        for batch in tx.released(batches):
            ids = batch.column(0)
            for first, count, length, text, number, tf in _postings(terms, batch.column(1)):
                done = 0
                while done < count:
                    some = min(count - done, window - n)
                    lo, hi = np.searchsorted(text, [done, done + some])
                    held.append((ids.slice(first + done, some), length[done : done + some], number[lo:hi], text[lo:hi] - done + n, tf[lo:hi]))
                    n, postings, done = n + some, postings + hi - lo, done + some
                    if n == window or postings >= POSTINGS:
                        yield row()
                        held, n, postings = [], 0, 0
        if held:
            yield row()

    return bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(build, _INDEX)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's documents holding each term; term -1 has the documents with any term, and -2 the terms of all with repeats."""
    total: Counter = Counter()
    for batch in batches:
        for lengths, present, starts, docs in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            n = np.frombuffer(lengths, "<i8")
            total[-1] += int((n > 0).sum())
            total[-2] += int(n.sum())
            held = np.diff(np.r_[np.frombuffer(starts, "<i4"), len(docs) // 2])
            total.update(dict(zip(np.frombuffer(present, "<i4").tolist(), held.tolist(), strict=True)))
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["term", "n"])


def statistics(indexed: DataFrame) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, terms of all, and documents holding each term of the round: a number for each of a round's terms comes back."""
    sums = indexed.select("lengths", "terms", "starts", "docs").mapInArrow(_sums, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    got = {r["term"]: r["n"] for r in sums.collect()}
    return got.pop(-1, 0), got.pop(-2, 0), got


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class _Best:
    """The ``top`` highest scores of one item, those of equal score with the smallest ids; a null id comes before all others."""

    def __init__(self, top: int):
        self.top, self.heap = top, []

    def least(self) -> int:
        """Only scores from here on can still enter."""
        return self.heap[0][0] if len(self.heap) == self.top else 1

    def add(self, score: int, doc: int | None) -> None:
        entry = (score, doc is None, -(doc or 0))
        if len(self.heap) < self.top:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)


def _bits(starts: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A bit for each document of the window, for each term: where a term's bytes begin, their places in the bitset and their values. Bytes without a bit are left out."""
    new = np.ones(len(docs), bool)
    new[1:] = docs[1:] >> 3 != docs[:-1] >> 3
    new[starts] = True
    first = np.flatnonzero(new)
    values = np.bitwise_or.reduceat((128 >> (docs & 7)).astype(np.uint8), first)
    return np.r_[np.searchsorted(first, starts), len(first)], docs[first] >> 3, values


def score(indexed: DataFrame, counts: list[dict[int, int]], documents: int, length: int, weights: np.ndarray, top: int = 10) -> DataFrame:
    """(item, doc_id, score): at most ``top`` documents of each item from each task; ``item`` is the place in ``counts``."""
    plan = [(np.array(sorted(c), np.int64), np.array([c[k] for k in sorted(c)], np.int64)) for c in counts]
    sent = indexed.sparkSession.sparkContext.broadcast((plan, weights))

    def harvest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weights = sent.value
        best, place = [_Best(top) for _ in plan], np.full(len(weights) + 1, -1, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column(0)[k].values
                n, present, starts, docs, tfs = (np.frombuffer(batch.column(c)[k].as_py(), kind).astype(np.int64) for c, kind in ((1, "<i8"), (2, "<i4"), (3, "<i4"), (4, "<u2"), (5, "<i4")))
                if not len(docs):
                    continue
                ends = np.r_[starts[1:], len(docs)]
                m = 25 + (75 * n * documents) // max(1, length)
                impact = weights[np.repeat(present, ends - starts)] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[docs]))
                place[present] = np.arange(len(present))
                held, sums = _bits(starts, docs), np.zeros(len(n), np.int64)
                for (terms, times), own in zip(plan, best, strict=True):
                    at = place[terms]
                    there = at >= 0
                    at = at[there]
                    if not len(at):
                        continue
                    occupied = np.zeros(-(-len(n) // 8), np.uint8)
                    for t, q in zip(at.tolist(), times[there].tolist(), strict=True):
                        a, b = starts[t], ends[t]
                        sums[docs[a:b]] += impact[a:b] if q == 1 else q * impact[a:b]
                        begin, end = held[0][t], held[0][t + 1]
                        occupied[held[1][begin:end]] |= held[2][begin:end]
                    touched = np.flatnonzero(np.unpackbits(occupied, count=len(n)))
                    got = sums[touched]
                    sums[touched] = 0
                    # the best first, so that the rest need not be looked at
                    good = np.flatnonzero(got >= own.least())
                    for x in good[np.argsort(-got[good], kind="stable")].tolist():
                        if got[x] < own.least():
                            break
                        own.add(int(got[x]), ids[int(touched[x])].as_py())
                place[present] = -1
        rows = [(i, None if null else -doc, s) for i, own in enumerate(best) for s, null, doc in own.heap]
        if rows:
            item, doc, value = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(value, pa.int64())], ["item", "doc_id", "score"])

    return indexed.mapInArrow(harvest, "item long, doc_id long, score long")


def _round(docs: DataFrame, items: list[Row], top: int, window: int, **columns: str) -> DataFrame:
    spark = docs.sparkSession
    terms, counts = vocabulary([r["text"] for r in items])
    # rows of some MB: a row group is closed by its size from the first row on
    indexed = stash(index(docs, terms, window, **columns), "postings", options={"parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1})
    documents, length, holding = statistics(indexed)
    weights = np.array([weight(documents, holding.get(k, 0)) for k in range(len(terms.hashes))], np.int64)
    # what the tasks' heaps hold is written, as ranking would otherwise score twice when an executor is lost
    found = stash(score(indexed, counts, documents, length, weights, top), "heaps")
    order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = spark.createDataFrame(pa.table({"item": pa.array(range(len(items)), pa.int64()), "item_id": pa.array([r["item_id"] for r in items], pa.int64())}))
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = 10, window: int = WINDOW, item_col: str = "item_id", item_text: str = "text", **columns: str) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0, best first, equal scores by doc_id.

    Terms are runs of ASCII letters, digits and signs beyond ASCII in whole
    texts, A-Z lower-cased. Null and empty documents and items have no terms;
    such items, and those whose terms no document holds, give no rows. Every
    row is a document, those that repeat a doc_id too, and a null doc_id comes
    before others of its score; every row of items is searched for, one with a
    null or repeated id too; other columns are not read; no documents or no
    items give no rows. Items go in rounds of about 50,000 and 25 million
    characters, each with its own postings, whatever their number.
    """
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    rounds = max(1, -(-size["n"] // ITEMS), -(-size["chars"] // CHARS))
    out = None
    for r in range(rounds):
        some = asked if rounds == 1 else asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == r)
        got = _round(docs, some.orderBy("item_id", "text").collect(), top, window, **columns)
        out = got if out is None else out.unionByName(got)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Every document against every item, by joins of their terms.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS big_n, sum(len(w))::BIGINT AS big_l FROM d),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) AS x GROUP BY r, t),
f AS (SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY t, big_n),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
m AS (SELECT r, doc_id, 25 + (75 * len(w) * big_n) // big_l AS m FROM d, s WHERE len(w) > 0),
c AS (SELECT item_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM i JOIN f USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY item_id, r),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 10
"""
