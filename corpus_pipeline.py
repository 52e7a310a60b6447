"""From documents to packed training sequences.

Each stage is one operator over all that the stage before kept. Stages are
written as Parquet in the shared folder and read again, so a lost executor
costs a stage's tasks, not the whole run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.lineage import stash
from strandlake.llm import decontaminate, language, near_duplicates, packing, personal

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text whose best language has a lower mean probability than this has none; four even classes have 0.25 each.
LEAST_LANGUAGE = 0.3


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with _id: the doc_id, or for a null one a number made of the text, above all that are in use."""
    return docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))))


def _without(keyed: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose _id is not among ``ids``, which are broadcast only where they are few enough."""
    ids = stash(ids.select("_id").distinct(), "dropped")
    few = ids.limit(near_duplicates.IDS + 1).count() <= near_duplicates.IDS
    return keyed.join(F.broadcast(ids) if few else ids, "_id", "left_anti")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without a letter, or with no likely one, go. A null lang is filled in.

    Null and empty texts have no letter and go, however long a text is all of it
    counts; rows that repeat stay as often as they come, a null doc_id stays
    null, columns beside those of documents go, and an empty table stays empty.
    Where no lang is known at all nothing can be learned, and nothing stays.
    """
    found = language.identify(docs.select(*COLUMNS), language.train_languages(docs))
    known = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id, and one row of each doc_id and text.

    Rows with a null doc_id are documents of their own, as many as there are
    texts, and give way to any with one. Rows that repeat a doc_id with another
    text stay or go together. Null and empty texts are no duplicates of one
    another, but one row of each doc_id; whole texts count, however long.
    Columns beside those of documents go; an empty table stays empty.
    """
    keyed = _keyed(docs.select(*COLUMNS))
    found = near_duplicates.near_duplicates(keyed, id_col="_id")
    left = _without(keyed, found.where(~F.col("kept")).select(F.col("doc_id").alias("_id")))
    twice = stash(keyed.groupBy("_id").count().where("count > 1").select("_id"), "twice")
    if not twice.limit(1).count():
        return left.select(*COLUMNS)
    again = left.join(twice, "_id", "left_semi").groupBy("_id", F.xxhash64("text").alias("_text")).agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return left.join(twice, "_id", "left_anti").select(*COLUMNS).unionByName(again.select("row.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to three quarters or more.

    Null and empty texts hold none and stay, as does everything where there are
    no items; rows that repeat stay or go together, a null doc_id is judged by
    its text, whole texts count. Columns beside those of documents go; an empty
    table stays empty.
    """
    keyed = _keyed(docs.select(*COLUMNS))
    held = decontaminate.contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_id")
    return _without(keyed, held.select(F.col("doc_id").alias("_id"))).select(*COLUMNS)


def personal_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked and n_chars counted anew.

    A null text stays null, with a null n_chars; every row stays, repeated ones
    too, and whole texts are masked. Columns beside those of documents go; an
    empty table stays empty.
    """
    clean = personal.annotate(docs.select(*COLUMNS), personal.fit(docs), mask=True)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids, with the ids and their checksum.

    A null or empty text is the closing id alone; every row is packed, repeated
    ones as often as they come, a null doc_id stays null; an empty table gives
    no pieces.
    """
    return packing.pack(docs).withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_stage),
    ("packing", packing_stage),
]

#: Trained models and a tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
