"""Packing: concatenate all documents' ids and cut them into fixed windows.

Pass one encodes each document once and writes its ids with its place among
its task's ids. Prefix sums over the tasks' totals give every document its
global offset; pass two cuts documents where windows end. Only the last
window can be short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.lineage import stash
from strandlake.llm import text as tx
from strandlake.llm.encode import default_tokenizer, encoder
from strandlake.llm.store import bounded, running_totals

_IDS = "doc_id long, part long, start long, n long, ids binary"


def encode_documents(docs: DataFrame, tokenizer: str, end: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, part, start, n, ids): little-endian 32-bit ids of each text, and where they begin among those of its task.

    A null or empty text has no ids but ``end``; every row gives one, repeated
    ones too, a null doc_id stays null, whole texts are encoded however long,
    other columns are not read, an empty table gives no rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in tx.released(batches):
            for first, count, ids in model.column(batch.column(1), end):
                n, total = len(count), np.cumsum(count)
                values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.r_[0, total * 4].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(np.full(n, part)), pa.array(at + total - count), pa.array(count), values], ["doc_id", "part", "start", "n", "ids"])
                at += int(total[-1])

    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, _IDS)


def pack(docs: DataFrame, length: int = 2048, end: int = 1, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most ``length`` ids.

    A document is the ids of its text, then ``end``. Returns a row for each
    piece: doc_id, start (ids of the document before it), length, ids (binary,
    little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A null or empty text is the id ``end`` alone; a null doc_id stays null;
    repeated rows are packed as often as they come; a document longer than a
    sequence goes on in the next ones; other columns are not carried; an empty
    table gives no pieces.
    """
    ids = stash(encode_documents(docs, tokenizer or default_tokenizer(), end, id_col, text_col), "ids")
    totals = ids.groupBy("part").agg(F.sum("n").alias("total"))
    # one row for each input split: a few bytes each, whatever the texts hold
    offsets = running_totals(totals, "part", "total", "base").select("part", "base")
    at = F.col("base") + F.col("start")
    windows = F.sequence(F.floor(at / length), F.floor((at + F.col("n") - 1) / length))
    cut = (
        ids.join(F.broadcast(offsets), "part")
        .select("doc_id", "n", "ids", at.alias("at"), F.explode(windows).alias("sequence_id"))
        .withColumn("start", F.greatest(F.lit(0), F.col("sequence_id") * length - F.col("at")))
        .withColumn("stop", F.least(F.col("n"), (F.col("sequence_id") + 1) * length - F.col("at")))
    )
    return cut.select(
        "doc_id",
        F.col("start").cast("long").alias("start"),
        (F.col("stop") - F.col("start")).cast("long").alias("length"),
        F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * (stop - start) as int))").alias("ids"),
        F.col("n").alias("doc_tokens"),
        F.col("sequence_id").cast("long").alias("sequence_id"),
        (F.col("at") + F.col("start") - F.col("sequence_id") * length).cast("long").alias("offset"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
