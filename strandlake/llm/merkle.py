"""Merkle manifest of a data set: a tree over each group's rows, a tree over the groups, and a proof for every row.

Rows are sorted by range, so a partition holds a run of each of its groups.
How many rows of a group stand in the partitions before gives every row its
place. Each task builds the complete subtrees of the aligned blocks it holds;
what a partition's end cuts goes on as few ragged nodes, shuffled by the
coordinate of their block, and the upper levels are finished a few at a time.
No task ever holds more than a block of nodes, however large a group is.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.lineage import stash

FAN = 3
#: Levels that a task builds of a block, and levels that each later round adds.
HEIGHT, LIFT = 7, 6
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"
_ARROW_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def leaf(*fields: Column) -> Column:
    """SHA-256, as lower-case hexadecimal text, of the fields one after another: each its count of UTF-8 bytes, a colon and the value, or a dash for null."""

    def one(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(one, fields)), 256)


def fold(start: Column, path: Column) -> Column:
    """The digest at a path's end: on each level the run of the node, its siblings on the left and right included, is hashed."""
    return F.aggregate(path, start, lambda node, level: F.sha2(F.concat(level["left"], node, level["right"]), 256))


def path_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda level: F.concat(level["left"], level["right"])), ""), 256)


def _h(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with part, pos (rows of the key before it in this partition), first (of the partition's first key) and last (of its key; null for the partition's last row)."""
    part, at, opened, held = TaskContext.get().partitionId(), 0, 0, None

    def out(rows: pa.RecordBatch, pos: np.ndarray, first: np.ndarray, last: pa.Array) -> pa.RecordBatch:
        n = rows.num_rows
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(n, part, np.int32)), pa.array(pos), pa.array(first), last], [*rows.schema.names, "part", "pos", "first", "last"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.concat_batches([held, batch])
        n, key = rows.num_rows - 1, rows.column("key")
        ends = pc.not_equal(key.slice(0, n), key.slice(1)).to_numpy(zero_copy_only=False)
        run = np.cumsum(np.r_[0, ends]).astype(np.int64)
        pos = np.arange(n + 1) - np.r_[-at, 1 + np.flatnonzero(ends)][run]
        if n:
            yield out(rows.slice(0, n), pos[:n], run[:n] + opened == 0, pa.array(ends))
        at, opened, held = int(pos[n]), opened + int(run[n]), rows.slice(n)
    if held is not None:
        yield out(held, np.array([at]), np.array([opened == 0]), pa.array([None], pa.bool_()))


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` (key, ord, digest, ...) in order, with at (place in the whole key) and last (of the whole key).

    Equal keys and ords are in the order of their digests; rows that are the
    same there too can stand for one another, and their places in the input
    keep a range from being one task's.
    """
    ranged = stash(rows.withColumn("_place", F.monotonically_increasing_id()), "leaves").repartitionByRange("key", "ord", "digest", "_place").sortWithinPartitions("key", "ord", "digest", "_place").drop("_place")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    # what follows needs the order in which a partition was written; a file may be read in pieces, each of which is in order
    dealt = stash(ranged.mapInArrow(_numbered, kind + ", part int, pos long, first boolean, last boolean"), "sorted")
    before = W.partitionBy("key").orderBy("part")
    counts = dealt.groupBy("key", "part").agg(F.count("*").alias("n"))
    spans = counts.select("part", F.coalesce(F.sum("n").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.lead("part").over(before).isNotNull().alias("goes_on"))
    # only a partition's first key can begin before it, and only its last can go on: a row for each partition, whatever the number of keys
    parts = spans.groupBy("part").agg(F.max("base").alias("base"), F.max("goes_on").alias("goes_on"))
    return dealt.join(F.broadcast(parts), "part").select(
        *rows.columns,
        (F.col("pos") + F.when(F.col("first"), F.col("base")).otherwise(0)).cast("long").alias("at"),
        F.coalesce("last", ~F.col("goes_on")).alias("last"),
    )


def _levels(first: int, digests: list[str], last: bool, height: int) -> list[tuple[int, list[str]]]:
    """Complete subtrees over consecutive nodes from number ``first``: for each level its first number and its digests. ``last``: no node comes after them."""
    levels = [(first, digests)]
    while len(levels) <= height:
        a, nodes = levels[-1]
        if last and first == 0 and len(nodes) == 1:
            break
        b = a + len(nodes)
        lo, hi = -(-a // FAN), (-(-b // FAN) if last else b // FAN)
        if lo >= hi:
            break
        levels.append((lo, [_h(nodes[FAN * p - a : FAN * p - a + FAN]) for p in range(lo, hi)]))
    return levels


def _subtrees(rows: pa.RecordBatch, cuts: np.ndarray, height: int) -> pa.RecordBatch:
    """Rows of whole runs, which begin at ``cuts``, with the path of each to the top of the subtree it is in, and that top; its digest is on the first row of the subtree alone."""
    every, places, lasts = rows.column("digest").to_pylist(), rows.column("at").to_numpy(), rows.column("last").to_pylist()
    left, right, entries, depths, tops, digests, wholes = [], [], [], [], [], [], []
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), rows.num_rows], strict=True):
        first, last = int(places[lo]), lasts[hi - 1]
        levels = _levels(first, every[lo:hi], last, height)
        at = np.arange(first, first + hi - lo)
        depth, begin = np.zeros(hi - lo, np.int64), []
        for level, (a, nodes) in enumerate(levels[:-1]):
            begin.append(len(left) - a)
            for j in range(a, a + len(nodes)):
                k = j - j % FAN - a
                # a run that begins or ends elsewhere has no parent here, and these entries no rows
                left.append("".join(nodes[max(k, 0) : j - a]))
                right.append("".join(nodes[j - a + 1 : k + FAN]))
            up, made = at // FAN ** (level + 1), levels[level + 1]
            depth[(depth == level) & (up >= made[0]) & (up < made[0] + len(made[1]))] += 1
        if begin:
            each = np.array(begin) + at[:, None] // FAN ** np.arange(len(begin))
            entries.append(each[np.arange(len(begin)) < depth[:, None]])
        top = at // FAN**depth
        new = np.r_[True, (depth[1:] != depth[:-1]) | (top[1:] != top[:-1])]
        depths.append(depth)
        tops.append(top)
        digests += [levels[d][1][t - levels[d][0]] if x else None for d, t, x in zip(depth.tolist(), top.tolist(), new.tolist(), strict=True)]
        wholes += [bool(last and first == 0)] * (hi - lo)
    depth, taken = np.concatenate(depths), pa.array(np.concatenate([np.zeros(0, np.int64), *entries]))
    pairs = pa.StructArray.from_arrays([pa.array(left, pa.string()).take(taken), pa.array(right, pa.string()).take(taken)], ["left", "right"])
    path = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(depth)].astype(np.int32)), pairs)
    more = [path, pa.array(depth), pa.array(np.concatenate(tops)), pa.array(digests, pa.string()), pa.array(wholes)]
    return pa.RecordBatch.from_arrays([*(rows.column(c) for c in rows.schema.names if c not in ("at", "last")), *more], [*(c for c in rows.schema.names if c not in ("at", "last")), "path", "level", "number", "top", "whole"])


def _local(height: int):
    block = FAN**height

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = batch if held is None else pa.concat_batches([held, batch])
            n = rows.num_rows
            if not n:
                continue
            key, at, new = rows.column("key"), rows.column("at").to_numpy(), np.ones(n, bool)
            new[1:] = pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False) | (at[1:] != at[:-1] + 1) | (at[1:] % block == 0)
            cuts = np.flatnonzero(new)
            held = rows.slice(int(cuts[-1]))
            if len(cuts) > 1:
                yield _subtrees(rows.slice(0, int(cuts[-1])), cuts[:-1], height)
        if held is not None:
            yield _subtrees(held, np.zeros(1, np.int64), height)

    return build


def _climb(height: int):
    """All nodes of one key below one coordinate of level ``height``: each with its path to that node, or to the key's root where nothing else is left of the key."""

    def finish(rows: pa.Table) -> pa.Table:
        given = list(zip(rows.column("level").to_pylist(), rows.column("number").to_pylist(), rows.column("digest").to_pylist(), strict=True))
        nodes: dict[int, dict[int, str]] = defaultdict(dict)
        for level, number, digest in given:
            nodes[level][number] = digest
        level, highest = min(nodes), max(nodes)
        while level < height and not (level >= highest and set(nodes[level]) == {0}):
            here = nodes[level]
            for p in {j // FAN for j in here}:
                nodes[level + 1][p] = _h([here[j] for j in range(FAN * p, FAN * p + FAN) if j in here])
            level += 1
        (number, digest), whole = next(iter(nodes[level].items())), level < height or (min(x[0] for x in given) == height and number == 0)
        paths = []
        for low, j, _ in given:
            path = []
            for k in range(low, level):
                run = range(j - j % FAN, j - j % FAN + FAN)
                path.append({"left": "".join(nodes[k].get(i, "") for i in run if i < j), "right": "".join(nodes[k].get(i, "") for i in run if i > j)})
                j //= FAN
            paths.append(path)
        n = len(given)
        more = [pa.array(paths, _ARROW_PATH), pa.array([level] * n, pa.int64()), pa.array([number] * n, pa.int64()), pa.array([digest] + [None] * (n - 1), pa.string()), pa.array([whole] * n)]
        return pa.Table.from_arrays([*(rows.column(c) for c in ("key", "level", "number")), *more], ["key", "level", "number", "path", "up_level", "up_number", "top", "whole"])

    return finish


def trees(rows: DataFrame, height: int = HEIGHT, lift: int = LIFT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A tree over the rows (key, ord, digest, ...) of each key in the order of ord; every ``FAN`` nodes, the last of a level fewer, become one.

    Returns the rows with (path, level, number) of the subtree they are in;
    (key, level, number, above), the paths of those subtrees to the key's root;
    and (key, digest), the roots. A key's only row is its root.
    """
    placed = _placed(rows)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    local = stash(placed.mapInArrow(_local(height), f"{kind}, path {_PATH}, level long, number long, top string, whole boolean"), "subtrees")
    tops = local.where(F.col("top").isNotNull()).select("key", "level", "number", F.col("top").alias("digest"), "whole")
    roots, rounds = [tops.where("whole")], []
    # first the ragged nodes up to the level of blocks, then all nodes of that level a few levels higher, and so on
    left, top = tops.where("not whole").drop("whole"), height
    while True:
        low = left.where(F.col("level") < top)
        block = F.expr(f"cast(floor(number / power({FAN}, {top} - level)) as long)") if not rounds else F.expr(f"number div {FAN**lift}")
        climbed = stash((low if not rounds else left).groupBy("key", block.alias("_block")).applyInArrow(_climb(top), f"key string, level long, number long, path {_PATH}, up_level long, up_number long, top string, whole boolean"), "climbed")
        made = climbed.where(F.col("top").isNotNull()).select("key", F.col("up_level").alias("level"), F.col("up_number").alias("number"), F.col("top").alias("digest"), "whole")
        roots.append(made.where("whole"))
        # nodes that are on the level of blocks already have no way to go in the first round
        left = made.where("not whole").drop("whole") if rounds else made.where("not whole").drop("whole").unionByName(left.where(F.col("level") == top))
        rounds.append(climbed)
        if left.isEmpty():
            break
        top += lift
    none = F.array().cast(_PATH)
    above = rounds[-1].select("key", "level", "number", F.col("path").alias("above"))
    for k in range(len(rounds) - 2, -1, -1):
        up = above.select("key", F.col("level").alias("up_level"), F.col("number").alias("up_number"), F.col("above").alias("_more"))
        joined = rounds[k].join(up, ["key", "up_level", "up_number"], "left").select("key", "level", "number", F.concat("path", F.coalesce("_more", none)).alias("above"))
        above = joined if k else joined.unionByName(above.where(F.col("level") == height))
    every = roots[0]
    for r in roots[1:]:
        every = every.unionByName(r)
    above = roots[0].select("key", "level", "number", none.alias("above")).unionByName(above)
    return local.drop("top", "whole"), above, every.select("key", "digest")


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group_col: str = "source", order_col: str = "doc_id", carry: dict[str, Column] | None = None, height: int = HEIGHT, lift: int = LIFT) -> DataFrame:
    """(order, group, leaf, subroot, root, path, and what ``carry`` names): every row's leaf with its proof.

    A row's leaf is ``leaf`` of ``columns``. The leaves of a group, in the
    order of ``order_col``, have the group's subroot; the subroots, by group,
    the root. ``path`` has the siblings, left and right, of each level up to
    the root: ``fold(leaf, path)`` is the root, and of a changed row is not.
    ``carry`` are columns made of the row as it is read.

    A null field is a dash, an empty one has no bytes; the null group comes
    first, as does a null in the order; rows with the same order are in that of
    their leaves, and rows that repeat are leaves of their own; whole texts
    count, however long; columns not named are not read; an empty table has no
    rows and no root. ``order_col`` is a whole number.
    """
    carried = carry or {}
    # the null group as the empty text, before all others
    key = F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit("")).alias("key")
    rows = docs.select(key, F.col(order_col).cast("long").alias("ord"), leaf(*(F.col(c) for c in columns)).alias("digest"), *(c.alias(f"_{name}") for name, c in carried.items()))
    local, above, subroots = trees(rows, height, lift)
    subroots = stash(subroots, "subroots")
    own, over, root = trees(subroots.select(F.lit("").alias("key"), F.col("key").alias("ord"), "digest"), height, lift)
    groups = own.join(over, ["key", "level", "number"]).join(F.broadcast(root.select("key", F.col("digest").alias("root"))), "key")
    groups = groups.select(F.col("ord").alias("key"), F.col("digest").alias("subroot"), "root", F.concat("path", "above").alias("_high"))
    tops = above.join(groups, "key").select("key", "level", "number", "subroot", "root", F.concat("above", "_high").alias("_above"))
    group = F.when(F.col("key") != "", F.expr("substring(key, 2)"))
    return local.join(tops, ["key", "level", "number"]).select(
        F.col("ord").alias(order_col), group.alias(group_col), F.col("digest").alias("leaf"), "subroot", "root", F.concat("path", "_above").alias("path"), *(F.col(f"_{name}").alias(name) for name in carried)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    chosen = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n")
    changed = leaf(*(F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in COLUMNS))
    found = manifest(docs, carry={"tampered": F.when(chosen, changed)})
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path"))
    proven = found.select("doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle() -> str:
    """All levels by recursion; a leaf's path and its fold go up one level at a time."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    fields = " || ".join(field(c) for c in COLUMNS[:-1])
    up = lambda key: f"""SELECT {key}, level + 1 AS level, i // 3 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, (max(n) + 2) // 3 AS n"""
    return f"""
WITH RECURSIVE bits(k, j, c) AS (SELECT k, 0, k::BIGINT FROM range(256) AS r(k) UNION ALL SELECT k, j + 1, xor(c >> 1, (c & 1) * 3988292384) FROM bits WHERE j < 8),
crc AS (SELECT list(c ORDER BY k) AS t FROM bits WHERE j = 8),
d AS (SELECT row_number() OVER (ORDER BY source NULLS FIRST, doc_id) AS r, doc_id, coalesce('+' || source, '') AS g, {fields} AS head, text,
  list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])) % 2 = 1 AS chosen FROM documents, crc),
leaves AS (SELECT r, doc_id, g, sha256(head || {field("text")}) AS leaf,
  CASE WHEN chosen THEN sha256(head || {field("replace(text, chr(10), '')")}) ELSE sha256(head || {field("text")}) END AS shown,
  row_number() OVER (PARTITION BY g ORDER BY r) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
low(g, level, i, h, n) AS (SELECT g, 0, i, leaf, n FROM leaves UNION ALL ({up("g")} FROM low WHERE n > 1 GROUP BY g, level, i // 3)),
subroots AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high(level, i, h, n) AS (SELECT 0, i, subroot, n FROM subroots UNION ALL ({up("0 AS z").replace("0 AS z, ", "")} FROM high WHERE n > 1 GROUP BY level, i // 3)),
root AS (SELECT h AS root FROM high WHERE n = 1),
lows AS (SELECT a.g, a.level, a.i, a.n, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM low AS a JOIN low AS b ON a.g = b.g AND a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL),
highs AS (SELECT a.level, a.i, a.n, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM high AS a JOIN high AS b ON a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL),
walk(doc, g, level, i, n, proof, h) AS (SELECT r, g, 0, i, n, '', shown FROM leaves
  UNION ALL SELECT doc, w.g, w.level + 1, w.i // 3, (w.n + 2) // 3, proof || l || r, sha256(l || h || r) FROM walk AS w JOIN lows AS s ON w.g = s.g AND w.level = s.level AND w.i = s.i WHERE w.n > 1),
rise(doc, level, i, n, proof, h) AS (SELECT doc, 0, s.i, s.n, proof, h FROM walk AS w JOIN subroots AS s USING (g) WHERE w.n = 1
  UNION ALL SELECT doc, w.level + 1, w.i // 3, (w.n + 2) // 3, proof || l || r, sha256(l || h || r) FROM rise AS w JOIN highs AS s ON w.level = s.level AND w.i = s.i WHERE w.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM rise JOIN leaves ON leaves.r = rise.doc JOIN subroots USING (g), root WHERE rise.n = 1
"""


ORACLE_SQL = _oracle()
