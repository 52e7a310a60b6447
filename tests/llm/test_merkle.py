import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F
from tests.llm.common import empty, frame, odd_texts

from strandlake.llm import merkle


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def tree(leaves):
    """The root and each leaf's siblings (left, right) by level."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            lo = i - i % 3
            paths[k].append(("".join(level[lo:i]), "".join(level[i + 1 : lo + 3])))
        level = [h(level[i : i + 3]) for i in range(0, len(level), 3)]
        at = [i // 3 for i in at]
    return level[0], paths


def plain(rows):
    """(doc_id, source, leaf, subroot, root, path) of rows (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(((r[0] is not None, r[0] or 0), leaf(r), r[0]))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    low = {s: tree([x[1] for x in sorted(groups[s], key=lambda x: x[:2])]) for s in sources}
    root, high = tree([low[s][0] for s in sources]) if sources else (None, [])
    return sorted([(x[2], s, x[1], low[s][0], root, low[s][1][k] + high[n]) for n, s in enumerate(sources) for k, x in enumerate(sorted(groups[s], key=lambda x: x[:2]))], key=str)


def made(docs, **sizes):
    return sorted([(r.doc_id, r.source, r.leaf, r.subroot, r.root, [tuple(x) for x in r.path]) for r in merkle.manifest(docs, **sizes).collect()], key=str)


def rows_of(docs):
    return [tuple(r) for r in docs.select(*merkle.COLUMNS).collect()]


def test_equals_plain_trees_on_odd_rows(spark):
    texts = odd_texts()
    docs = frame(spark, texts + texts[:6], [*range(len(texts) - 2), None, None, 0, 0, 3, 3, None, 7])
    source = F.expr("CASE pmod(hash(text, doc_id), 4) WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'é' ELSE 'z' END")
    docs = docs.withColumn("source", source).withColumn("n_chars", F.length("text").cast("long"))
    docs = docs.withColumns({c: F.lit(1) for c in ("key", "ord", "digest", "at", "level", "number", "leaf", "path", "root")})
    want = plain(rows_of(docs))
    assert made(docs) == want and made(docs.repartition(5), height=1, lift=1) == want
    assert made(empty(spark)) == []


def test_groups_that_many_partitions_cut(spark):
    """Sizes around powers of three, cut by ranges of a few rows, with blocks of 9 and rounds of one level."""
    sizes = {"one": 1, "two": 2, "nine": 9, "ten": 10, "more": 28, "81": 81, "hot": 700}
    rows = [(7 * i, s, None, i, f"{s} {i}\nx") for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(9)
    want = plain(rows)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts, height, lift in ((37, 2, 1), (11, 2, 2), (3, 3, 6)):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert made(docs, height=height, lift=lift) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_equal_rows_are_leaves_of_their_own(spark):
    rows = [(1, "a", "en", 1, "x")] * 40 + [(1, "a", "en", 1, "y")] * 5 + [(2, None, None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(6)
    assert made(docs, height=1, lift=1) == plain(rows)


def test_long_texts_and_kept_line_ends(spark, tmp_path):
    texts = ["a\nb" * 400_000, "no line end", "\n", None, "", "x\ny"] * 3
    docs = frame(spark, texts).withColumn("source", F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("s"), F.col("doc_id") % 2)))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in merkle.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, source, digest, subroot, root, path in plain(rows_of(docs)):
        r, changed = got[i], zlib.crc32(str(i).encode()) % 2 == 0 and "\n" in (texts[i] or "")
        node = digest if not changed else leaf((i, source, None, None, texts[i].replace("\n", "")))
        for left, right in path:
            node = h([left, node, right])
        assert (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) == (digest, subroot, root, h(x + y for x, y in path), node, node == root)
        assert r.verified != changed
    assert any(not r.verified for r in got.values()) and any(r.verified for r in got.values())
