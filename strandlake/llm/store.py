"""Bounded batches and samples, and running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Bytes of texts that go to a Python worker at once, and rows that a scan holds as one batch.
BATCH, ROWS = 2 << 20, 512


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session that scans batches of ``ROWS`` texts and hands Python workers about ``BATCH`` bytes, however long the texts are."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    df.sparkSession.conf.set("spark.sql.parquet.columnarReaderBatchSize", ROWS)
    return df


def fewest_hashes(rows: DataFrame, hashed: Column, most: int) -> DataFrame:
    """``rows`` with _hash, about twice ``most`` of those with the smallest, but all where there are fewer.

    The rows are counted first, so the cut is one comparison and no task ever
    sends more than its share of them on, however many tasks there are.
    """
    share = min(1.0, (2 * most + 1000) / max(1, rows.count()))
    cut = (1 << 63) - 1 if share == 1 else int(share * (1 << 64)) - (1 << 63)
    return rows.withColumn("_hash", hashed).where(F.col("_hash") <= cut)


def bounded_sample(rows: DataFrame, texts: int, chars: int) -> list[Row]:
    """At most ``texts`` rows of (id, text, ...), those with the smallest hashes of both, as far as ``chars`` characters go, but one at least.

    The order is total but for repeated rows, of which one is taken, so the
    sample is the same however the rows are dealt.
    """
    some = fewest_hashes(rows, F.xxhash64("id", "text"), texts)
    total, last = 0, None
    for r in dict(some.select("_hash", F.length("text").alias("n")).orderBy("_hash", "n").limit(texts).collect()).items():
        total += r[1] or 0
        if last is not None and total > chars:
            break
        last = r[0]
    if last is None:
        return []
    return sorted(some.where(F.col("_hash") <= last).dropDuplicates(["_hash"]).collect(), key=lambda r: r["_hash"])


def running_totals(df: DataFrame, key: str, value: str, out: str, descending: bool = False) -> DataFrame:
    """Exclusive running sum of ``value`` by the non-negative integer ``key``, in two levels.

    Keys go in blocks of 1024: a window over the blocks' sums, then one inside
    each block, so that no single task ever orders all keys.
    """
    block = F.floor(F.col(key) / F.lit(1024)).cast("long")
    order = lambda c: F.col(c).desc() if descending else F.col(c).asc()
    blocked = df.withColumn("_block", block)
    blocks = (
        blocked.groupBy("_block")
        .agg(F.sum(value).alias("_sum"))
        .withColumn("_base", F.sum("_sum").over(W.orderBy(order("_block")).rowsBetween(W.unboundedPreceding, -1)))
        .select("_block", F.coalesce("_base", F.lit(0)).alias("_base"))
    )
    inside = W.partitionBy("_block").orderBy(order(key)).rowsBetween(W.unboundedPreceding, -1)
    return (
        blocked.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(blocks, "_block")
        .withColumn(out, (F.col("_base") + F.col("_in")).cast("long"))
        .drop("_block", "_in", "_base")
    )
