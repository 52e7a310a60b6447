"""Near duplicates by circulant MinHash, with exact Jaccard verification.

Two permutations make a signature: the first scatters shingles over 2**32
places, the second, shifted round by k places, gives coordinate k. Documents
whose sets are equal are one class. Bands of the signatures deal classes to
buckets; each class is held against its bucket's leader by its signature, and
what resembles one another closely enough forms loose groups, in linear work.
Where a bucket then has classes of several groups, all of its classes are held
against one another; the classes of a crowded bucket meet by their rarest
shingles instead, of which linked sets share one. So every linked pair that
shares a band is compared or in one group. Inside a loose group every link is
decided on the full sets, in blocks, so no task holds all of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from strandlake.lineage import stash
from strandlake.llm import text as tx
from strandlake.llm.components import components
from strandlake.llm.store import bounded

BANDS, ROWS = 32, 4
SIZE = BANDS * ROWS
#: Classes in a block.
BLOCK = 512
#: Sketches in a block of a bucket.
SKETCHES = 2048
#: Ids that are broadcast at most; more are joined by a shuffle.
IDS = 1_000_000
_FMIX = (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def signatures(hashes: np.ndarray, starts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Coordinates (size, sets) of the sets that begin at ``starts`` in ``hashes``; no set is empty."""
    out = np.empty((size, len(starts)), np.uint32)
    step = 1 << 15
    first = (tx.mix(hashes) >> tx.U(32)).astype(np.uint32)
    cuts = [0]
    while cuts[-1] < len(starts):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(starts, starts[cuts[-1]] + step))))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        j = min(j, len(starts))
        places = first[starts[i] : starts[j] if j < len(starts) else len(first)]
        at = starts[i:j] - starts[i]
        x, y = np.empty_like(places), np.empty_like(places)
        for k in range(size):
            np.subtract(places, np.uint32(k), out=x)
            for c, s in zip((*_FMIX, None), (16, 13, 16), strict=True):
                np.right_shift(x, np.uint32(s), out=y)
                np.bitwise_xor(x, y, out=x)
                if c is not None:
                    np.multiply(x, c, out=x)
            out[k, i:j] = np.minimum.reduceat(x, at)
    return out


_SKETCH = "doc_id long, n_shingles long, high long, low long, bands array<long>, sketch binary"


def _sketch(width: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.released(batches):
            data, bounds = tx.utf8(batch.column(1))
            for i, j in tx.runs(bounds):
                s, of = tx.shingles(tx.words(data, bounds[i : j + 1]), width)
                u, count = tx.distinct(s, of, j - i)
                full = np.flatnonzero(count)
                starts = (np.cumsum(count) - count)[full]
                high, low = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                bands, sketches = [None] * (j - i), [None] * (j - i)
                if len(full):
                    high[full] = np.add.reduceat(tx.mix(u), starts).view(np.int64)
                    low[full] = np.add.reduceat(tx.mix(u ^ tx.U(0xD6E8FEB86659FD93)), starts).view(np.int64)
                    sig = signatures(u, starts)
                    key = np.zeros((BANDS, len(full)), tx.U)
                    for r in range(ROWS):
                        key = tx.mix(key * tx.U(31) + sig[r::ROWS].astype(tx.U) + tx.U(1))
                    key = tx.mix(key ^ np.arange(BANDS, dtype=tx.U)[:, None]).view(np.int64).T
                    small = np.ascontiguousarray((sig & np.uint32(255)).astype(np.uint8).T)
                    for p, k in enumerate(full.tolist()):
                        bands[k], sketches[k] = key[p], small[p].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(count.astype(np.int64)), pa.array(high), pa.array(low), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                    ["doc_id", "n_shingles", "high", "low", "bands", "sketch"],
                )

    return sketch


def _sets(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.released(batches):
            data, bounds = tx.utf8(batch.column(1))
            for i, j in tx.runs(bounds):
                s, of = tx.shingles(tx.words(data, bounds[i : j + 1]), width)
                u, count = tx.distinct(s, of, j - i)
                parts = np.split(u, np.cumsum(count)[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([p.tobytes() for p in parts], pa.binary())], ["rep", "shingles"])

    return sets


def _tokens(width: int):
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.released(batches):
            data, bounds = tx.utf8(batch.column(1))
            for i, j in tx.runs(bounds):
                s, of = tx.shingles(tx.words(data, bounds[i : j + 1]), width)
                u, count = tx.distinct(s, of, j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(i, j), count))), pa.array(np.repeat(count, count)), pa.array(u.view(np.int64))], ["rep", "n", "bucket"])

    return tokens


def links(sets: list[np.ndarray], num: int, den: int, *apart: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with ``den * both >= num * either``, by overlaps counted exactly.

    Shingles that only one set has decide nothing and are left out of the
    count matrix; the others become its columns, in slices. Only pairs that
    differ in each of the labels ``apart`` count.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    of = np.repeat(np.arange(n), size)
    _, column, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = many[column] > 1
    rank = np.cumsum(many > 1) - 1
    of, column = of[keep], rank[column[keep]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    shared = np.zeros((n, n), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (lo, lo + 4096))
        part = np.zeros((n, 4096), np.float32)
        part[of[a:b], column[a:b] - lo] = 1
        shared += part @ part.T
    both = np.rint(shared).astype(np.int64)
    linked = den * both >= num * (size[:, None] + size[None, :] - both)
    for label in apart:
        linked &= label[:, None] != label[None, :]
    label, found = np.arange(n), []
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        x, y = int(i), int(j)
        while label[x] != x:
            label[x] = label[label[x]]
            x = int(label[x])
        while label[y] != y:
            label[y] = label[label[y]]
            y = int(label[y])
        if x != y:
            label[max(x, y)] = min(x, y)
            found.append((int(i), int(j)))
    return found


def _verify(num: int, den: int):
    def verify(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep", ignore_index=True)
        apart = [group["part"].to_numpy()] + [group["block"].to_numpy()] * bool(group["lo"].iloc[0] != group["hi"].iloc[0])
        rep = group["rep"].to_numpy()
        got = links([np.frombuffer(x, tx.U) for x in group["shingles"]], num, den, *apart)
        return pd.DataFrame({"a": rep[[i for i, _ in got]], "b": rep[[j for _, j in got]]}, dtype="int64")

    return verify


@F.pandas_udf(IntegerType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Coordinates on which two sketches agree."""
    if not len(a):
        return pd.Series([], dtype="int32")
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).sum(1).astype(np.int32))


def _alike(x: np.ndarray, y: np.ndarray, least: int) -> np.ndarray:
    """Which rows of two tables of sketches agree on ``least`` coordinates."""
    same = np.zeros((len(x), len(y)), np.uint8)
    for a, b in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), strict=True):
        same += a[:, None] == b[None, :]
    return same >= least


def merged(group: np.ndarray, sketch: np.ndarray, side: np.ndarray, least: int) -> np.ndarray:
    """The smallest of ``group`` that each class reaches by sketches that agree on ``least`` coordinates; between two sides only, where there are two."""
    one, two = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
    alike = _alike(sketch[one], sketch[two], least)
    i, j = np.nonzero(alike)
    i, j = one[i], two[j]
    apart = group[i] != group[j]
    i, j, label = i[apart], j[apart], group.copy()
    while (label[i] != label[j]).any():
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
    return label


def _merge(least: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of one bucket's pair of blocks that sketches join; rows come in order of bucket and pair."""
        held = None

        def judge(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = [rows.column(c).to_numpy() for c in ("bucket", "lo", "hi")]
            group, side = rows.column("group").to_numpy(), rows.column("block").to_numpy()
            sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(group), -1)
            new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in zip([0, *new.tolist()], [*new.tolist(), len(group)], strict=True):
                if keys[1][i] != keys[2][i] and side[i:j].min() == side[i:j].max() or (group[i:j] == group[i]).all():
                    continue
                label = merged(group[i:j], sketch[i:j], side[i:j], least)
                moved = label != group[i:j]
                a.append(group[i:j][moved])
                b.append(label[moved])
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
            last = np.ones(rows.num_rows, bool)
            for c in ("bucket", "lo", "hi"):
                x = rows.column(c).to_numpy()
                last &= x == x[-1]
            cut = int(last.argmax())
            if cut:
                yield from judge(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None:
            yield from judge(held)

    return merge


def _rest(held: DataFrame, sketches: DataFrame, found: DataFrame, least: int, most_blocks: int | None) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of loose groups, joined where a bucket has alike classes in both, a class alone being a group of its own; and the classes of buckets left over.

    All classes of a bucket with several groups meet, in pairs of blocks; a
    bucket of more than ``most_blocks`` is left over. Two classes alone in a
    bucket have met as class and leader.
    """
    loose = components(found)
    grouped = held.where("n > 2").select("rep", "bucket").join(loose.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "bucket", F.coalesce("component", "rep").alias("group"))
    grouped = stash(grouped, "grouped")
    mixed = grouped.groupBy("bucket").agg(F.count("*").alias("n"), F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("bucket", F.ceil(F.col("n") / SKETCHES).cast("int").alias("blocks"))
    mixed = stash(mixed, "mixed")
    small = F.lit(True) if most_blocks is None else F.col("blocks") <= most_blocks
    placed = grouped.join(mixed.where(small), "bucket").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("lo"), F.greatest(k, F.col("block")).alias("hi")))
    dealt = placed.join(sketches.select("rep", "sketch"), "rep").withColumn("pair", F.explode(other)).select("bucket", F.col("pair.lo").alias("lo"), F.col("pair.hi").alias("hi"), "block", "group", "sketch")
    sorted_ = dealt.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return stash(sorted_.mapInArrow(_merge(least), "a long, b long").distinct(), "rest"), grouped.join(mixed.where(~small), "bucket", "left_semi").select("rep").distinct()


def _rarest(base: DataFrame, members: DataFrame, num: int, den: int, width: int) -> DataFrame:
    """(rep, bucket): each set's rarest shingles among ``members``, as many as it takes for any two sets that are linked to share one."""
    needed = base.join(members.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    tokens = stash(needed.mapInArrow(_tokens(width), "rep long, n long, bucket long").distinct(), "tokens")
    counts = tokens.groupBy("bucket").agg(F.count("*").alias("_df"))
    rank = F.row_number().over(W.partitionBy("rep").orderBy("_df", "bucket"))
    least = F.ceil(F.lit(num) * F.col("n") / F.lit(den)).cast("long")
    return tokens.join(counts, "bucket").withColumn("_k", rank).where(F.col("_k") <= F.col("n") - least + 1).select("rep", "bucket").distinct()


def _loose(spread: DataFrame, sketches: DataFrame, least: int, deeper: Callable[[DataFrame], DataFrame] | None = None, rounds: int = 3) -> DataFrame:
    """Pairs (a, b) that join into one group all classes that share a bucket (rep, bucket) and agree on ``least`` coordinates.

    A bucket's leader is the class that stands in the fullest buckets. Classes
    unlike their leader meet again without it, under another one; what the
    leaders leave apart in a bucket is compared in blocks. The classes of
    crowded buckets, of more than one block, get other buckets from ``deeper``
    instead, in which every linked pair still meets, and go through all this
    once more.
    """
    full = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    held = stash(spread.join(full, "bucket"), "buckets")
    weight = held.groupBy("rep").agg(F.sum("n").alias("weight"))
    weighed = stash(sketches.join(weight, "rep").select("rep", "sketch", "weight"), "sketches")
    left = held.select("rep", "bucket").join(weighed.select("rep", "weight"), "rep")
    found = None
    for _ in range(rounds):
        lead = left.groupBy("bucket").agg(F.count("*").alias("n"), F.max(F.struct("weight", (-F.col("rep")).alias("less"))).alias("top")).where("n > 1")
        lead = lead.select("bucket", (-F.col("top.less")).alias("leader"))
        met = left.join(lead, "bucket").where("rep != leader")
        pairs = met.select("rep", "leader").distinct()
        a = weighed.select("rep", F.col("sketch").alias("x"))
        b = weighed.select(F.col("rep").alias("leader"), F.col("sketch").alias("y"))
        judged = stash(pairs.join(a, "rep").join(b, "leader").select("rep", "leader", (_agreement("x", "y") >= least).alias("alike")), "judged")
        alike = judged.where("alike").select(F.col("rep").alias("a"), F.col("leader").alias("b"))
        found = alike if found is None else found.unionByName(alike)
        left = stash(met.join(judged.where("not alike"), ["rep", "leader"]).select("rep", "bucket", "weight"), "left")
    found = found.distinct()
    more, crowd = _rest(held, weighed, found, least, None if deeper is None else 1)
    found = found.unionByName(more)
    if deeper is not None:
        crowd = stash(crowd, "crowd")
        if crowd.limit(1).count():
            found = found.unionByName(_loose(deeper(crowd), sketches.join(crowd, "rep", "left_semi"), least, rounds=rounds))
    return found.distinct()


def near_duplicates(docs: DataFrame, num: int = 75, den: int = 100, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked where ``den * |A and B| >= num * |A or B|``.

    Sets are the distinct ``width``-word shingles of the whole texts, with A-Z
    lower-cased; fewer words make one shingle. component_id is the smallest
    doc_id reachable, and kept tells whether that is the document's own.

    Null, empty and blank texts have no shingles, link with nothing and are
    kept. Equal sets are one class, however many rows share it, and are never
    compared in pairs. Rows that repeat a doc_id give a row each and count as
    one document. A null doc_id takes the component of its class and is kept
    only where no document with an id shares it. Other columns are not read;
    an empty table gives no rows. Links of at least 0.75 share a band with a
    probability of 0.999995 or more.
    """
    base = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = stash(base.mapInArrow(_sketch(width), _SKETCH), "shingles")
    some = rows.where("n_shingles > 0")
    reps = stash(some.groupBy("high", "low").agg(F.min("doc_id").alias("rep")), "classes")
    classes = some.join(reps, ["high", "low"]).where("doc_id = rep").groupBy("rep").agg(F.min(F.struct("n_shingles", "sketch", "bands")).alias("one")).select("rep", "one.sketch", "one.bands")
    classes = stash(classes, "classes")
    spread = classes.select("rep", F.explode("bands").alias("bucket")).distinct()
    loose = components(_loose(spread, classes.select("rep", "sketch"), int(SIZE * 0.42), lambda members: _rarest(base, members, num, den, width)))
    linked = _linked(base, loose, num, den, width)
    final = components(linked)
    named = reps.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("high", "low", F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "high", "low").join(named, ["high", "low"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def _sets_of(base: DataFrame, placed: DataFrame, width: int) -> DataFrame:
    """``placed`` (rep, ...) with the shingles of each set."""
    ids = placed.select(F.col("rep").alias("doc_id")).distinct()
    needed = base.join(F.broadcast(ids) if ids.limit(IDS + 1).count() <= IDS else ids, "doc_id", "left_semi")
    return needed.mapInArrow(_sets(width), "rep long, shingles binary").groupBy("rep").agg(F.first("shingles").alias("shingles")).join(placed, "rep")


def _linked(base: DataFrame, loose: DataFrame, num: int, den: int, width: int) -> DataFrame:
    """Links (a, b) inside the loose groups, decided on the full sets; enough of them to connect all that is linked.

    A group of more than one block is first compared inside its blocks, to each
    of which its first class comes along. What that leaves in several parts
    goes on: the classes outside the largest part are held against all of the
    group but their own part, in pairs of blocks. So the work on a group is its
    size times a block, and its size times what lies outside its largest part.
    """
    size = loose.groupBy("component").agg(F.count("*").alias("n"))
    placed = loose.join(size, "component").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select(F.col("node").alias("rep"), "component", "blocks", "block")
    placed = stash(placed, "placed")
    along = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: (k == F.col("block")) | (F.col("rep") == F.col("component")))
    first = _sets_of(base, placed, width).select("rep", "shingles", "component", F.explode(along).alias("lo")).withColumns({"hi": F.col("lo"), "block": F.col("lo"), "part": F.col("rep")})
    found = stash(first.groupBy("component", "lo", "hi").applyInPandas(_verify(num, den), "a long, b long"), "links")
    large = placed.where("blocks > 1").select("rep", "component")
    if not large.limit(1).count():
        return found
    parted = stash(large.join(components(found).select(F.col("node").alias("rep"), F.col("component").alias("part")), "rep", "left").select("rep", "component", F.coalesce("part", "rep").alias("part")), "parts")
    sizes = parted.groupBy("component", "part").agg(F.count("*").alias("n"))
    several = sizes.groupBy("component").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", (-F.col("part")).alias("less"))).alias("top")).where("parts > 1")
    several = several.select("component", (-F.col("top.less")).alias("main"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("few"), F.ceil(F.col("top.n") / BLOCK).cast("int").alias("rest"))
    open_ = parted.join(several, "component").withColumn("inner", F.col("part") == F.col("main"))
    hashed = F.xxhash64("rep")
    open_ = stash(open_.withColumn("block", F.when(F.col("inner"), F.col("few") + F.pmod(hashed, F.col("rest"))).otherwise(F.pmod(hashed, F.col("few"))).cast("int")), "open")
    if not open_.limit(1).count():
        return found
    against = F.sequence(F.lit(0), F.when(F.col("inner"), F.col("few") - 1).otherwise(F.col("few") + F.col("rest") - 1))
    pair = F.transform(against, lambda k: F.struct(F.least(k, F.col("block")).alias("lo"), F.greatest(k, F.col("block")).alias("hi")))
    dealt = _sets_of(base, open_, width).withColumn("pair", F.explode(pair)).select("rep", "shingles", "block", "part", "component", F.col("pair.lo").alias("lo"), F.col("pair.hi").alias("hi"))
    return found.unionByName(stash(dealt.groupBy("component", "lo", "hi").applyInPandas(_verify(num, den), "a long, b long"), "links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs of texts that share a shingle, their whole sets compared, and what is reachable from each.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, other) AS (SELECT a, b FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT node, least(node, min(other)) AS component FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""
