"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are parted by size. For a class of items with at most U shingles a
document becomes overlapping blocks of 2U shingles, so every passage of U lies
whole in one, and a contained item resembles that block far more than it does
the document. A block and an item that share a coordinate of their signatures
are candidates, as are a document and an item of few shingles that share any;
an item's containment in the document is then counted exactly.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import text as tx
from strandlake.llm.near_duplicates import signatures
from strandlake.llm.store import bounded

#: Coordinates of a signature; a block with a Jaccard similarity of 0.17 or more, the least for 0.75 of an item, is missed once in 150,000.
SIZE = 64
#: Shingles of the smallest blocks' halves.
UNIT = 16
#: Items with fewer shingles would be less alike to the smallest blocks than that; they are looked up by their shingles.
SHORT = 8
#: Items searched for at once, and characters of them; more go in rounds over the documents. An item takes about 1,300 bytes of a worker's memory, and a character of it one or two.
ITEMS, CHARS = 50_000, 25_000_000


@dataclass
class Class:
    """Items of one size class: the length of half a block in units, and for each coordinate its sorted values, their items and a filter on the low 16 bits."""

    units: int
    values: np.ndarray
    items: np.ndarray
    low: np.ndarray


@dataclass
class Index:
    ids: list[int]
    sets: list[np.ndarray]
    classes: list[Class]
    #: Sorted shingles of the short items, their items and a filter on the low 16 bits.
    short: np.ndarray
    short_items: np.ndarray
    short_low: np.ndarray


def build_index(items: list[tuple[int, str | None]], width: int) -> Index:
    """Signatures of test items by size class; items without words are left out."""
    kept = [(i, t) for i, t in items if i is not None and t and t.strip()]
    data, bounds = tx.utf8(pa.array([t for _, t in kept], pa.string()))
    s, of = tx.shingles(tx.words(data, bounds), width)
    u, count = tx.distinct(s, of, len(kept))
    full = np.flatnonzero(count)
    sets = [p for p in np.split(u, np.cumsum(count)[:-1]) if len(p)] if len(kept) else []
    few = [k for k, p in enumerate(sets) if len(p) < SHORT]
    short = np.concatenate([np.zeros(0, tx.U), *(sets[k] for k in few)])
    order = np.argsort(short)
    short_low = np.zeros(1 << 16, bool)
    short_low[short & tx.U(0xFFFF)] = True
    index = Index([kept[i][0] for i in full], sets, [], short[order], np.repeat(np.array(few, np.int64), [len(sets[k]) for k in few])[order], short_low)
    groups = defaultdict(list)
    for k, p in enumerate(sets):
        if len(p) < SHORT:
            continue
        groups[max(1, 1 << (-(-len(p) // UNIT) - 1).bit_length())].append(k)
    for units, some in sorted(groups.items()):
        sig = signatures(np.concatenate([sets[k] for k in some]), np.cumsum([0, *(len(sets[k]) for k in some[:-1])]), SIZE)
        order = np.argsort(sig, axis=1)
        values = np.take_along_axis(sig, order, 1)
        low = np.zeros((SIZE, 1 << 16), bool)
        low[np.arange(SIZE)[:, None], values & np.uint32(0xFFFF)] = True
        index.classes.append(Class(units, values, np.array(some, np.int32)[order], low))
    return index


def _candidates(index: Index, s: np.ndarray, of: np.ndarray) -> set[tuple[int, int]]:
    """(text, item) where a block of the text and the item share a coordinate, or the text and a short item a shingle; ``s`` are shingles in text order."""
    found = set()
    hit = np.flatnonzero(index.short_low[s & tx.U(0xFFFF)])
    if len(hit):
        a, b = np.searchsorted(index.short, s[hit], "left"), np.searchsorted(index.short, s[hit], "right")
        for d, x, y in zip(of[hit[b > a]].tolist(), a[b > a].tolist(), b[b > a].tolist(), strict=True):
            found.update((d, int(i)) for i in index.short_items[x:y])
    if not index.classes:
        return found
    begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    size = np.diff(np.r_[begin, len(s)])
    units = -(-size // UNIT)
    first_unit = np.cumsum(units) - units
    inner = np.arange(int(units.sum())) - np.repeat(first_unit, units)
    sig = signatures(s, np.repeat(begin, units) + inner * UNIT, SIZE)
    text = np.repeat(of[begin], units)
    for c in index.classes:
        halves = np.flatnonzero(inner % c.units == 0)
        half = np.minimum.reduceat(sig, halves, axis=1) if c.units > 1 else sig
        owner = text[halves]
        joined = half.copy()
        same = np.flatnonzero(owner[1:] == owner[:-1])
        joined[:, same] = np.minimum(half[:, same], half[:, same + 1])
        for k in range(SIZE):
            v = joined[k]
            hit = np.flatnonzero(c.low[k][v & np.uint32(0xFFFF)])
            if not len(hit):
                continue
            a, b = np.searchsorted(c.values[k], v[hit], "left"), np.searchsorted(c.values[k], v[hit], "right")
            for h, x, y in zip(hit[b > a].tolist(), a[b > a].tolist(), b[b > a].tolist(), strict=True):
                found.update((int(owner[h]), int(i)) for i in c.items[k, x:y])
    return found


def search(docs: DataFrame, index: Index, num: int = 75, den: int = 100, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): items of ``index``, which each worker is sent once, of which a document holds ``num / den`` of the shingles or more.

    Nulls, repeats, other columns and empty tables as in ``contaminated``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in tx.released(batches):
            data, bounds = tx.utf8(batch.column(1))
            for i, j in tx.runs(bounds):
                s, of = tx.shingles(tx.words(data, bounds[i : j + 1]), width)
                if not len(s):
                    continue
                edge = np.searchsorted(of, np.arange(j - i + 1))
                rows, whole = [], {}
                for d, k in sorted(_candidates(index, s, of)):
                    if d not in whole:
                        whole = {d: np.unique(s[edge[d] : edge[d + 1]])}
                    item = index.sets[k]
                    at = np.minimum(np.searchsorted(whole[d], item), len(whole[d]) - 1)
                    shared = int((whole[d][at] == item).sum())
                    if den * shared >= num * len(item):
                        rows.append((i + d, index.ids[k], shared, len(item)))
                if rows:
                    of_doc, item_id, shared, n = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of_doc)), pa.array(item_id, pa.int64()), pa.array(shared, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "item_id", "n_shared", "n_item"])

    frame = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return frame.mapInArrow(scan, "doc_id long, item_id long, n_shared long, n_item long")


def contaminated(docs: DataFrame, items: DataFrame, num: int = 75, den: int = 100, width: int = 5, item_col: str = "item_id", item_text: str = "text", **columns: str) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for every document and test item whose distinct ``width``-word shingles it holds to ``num / den``.

    A-Z are lower-cased; an item with fewer words is one shingle, found only in
    a document that is that very sequence. Null and empty texts and items match
    nothing; repeated rows, of either table, each give their own; a null doc_id
    stays null, items with a null id are left out; other columns are not read;
    no items or no documents give no rows. Items are searched for in rounds of
    about 50,000 of them and 25 million characters, whatever their number.
    """
    test = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    size = test.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    rounds = max(1, -(-size["n"] // ITEMS), -(-size["chars"] // CHARS))
    out = None
    for r in range(rounds):
        some = test.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == r)
        index = build_index([tuple(x) for x in some.orderBy("item_id", "text").collect()], width)
        got = search(docs, index, num, den, width, **columns)
        out = got if out is None else out.unionByName(got)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Words are split and lower-cased as above; every shingle is compared as text.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 75 * n_item
"""
