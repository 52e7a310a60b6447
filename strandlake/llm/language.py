"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import gru
from strandlake.llm import text as tx
from strandlake.llm.store import bounded, fewest_hashes

#: Texts without a letter have no language.
UNKNOWN = "und"
#: Bytes of a window that the network learns from, and of one that it labels; its state begins anew in each.
WINDOW, READ = 64, 256


def fold(id_col: str, k: int) -> F.Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(k))


def sample_windows(rows: DataFrame, text_col: str, label: F.Column, id_col: str, texts: int, windows: int, size: int) -> list:
    """(label, windows) of at most ``texts`` rows, those with the smallest hashes of id and text; windows lie evenly over each whole text.

    Rows that are equal count once, so the sample is the same however the rows are dealt.
    """
    step = F.length(text_col) / windows
    cut = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda k: F.substr(F.col(text_col), F.floor(k * step).cast("int") + 1, F.lit(size)))
    some = fewest_hashes(rows, F.xxhash64(id_col, text_col), texts)
    got = {(r["_hash"], r["label"]): r for r in some.select("_hash", label.cast("string").alias("label"), cut.alias("windows")).orderBy("_hash", "label").limit(texts).collect()}
    return [got[k] for k in sorted(got)]


def train_languages(docs: DataFrame, hidden: int = 8, texts: int = 1500, steps: int = 500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> gru.Model:
    """A network learned from at most ``texts`` texts with a language; those whose crc32(id) mod 4 is 2 are held out.

    Rows with a null text, id or language teach nothing, nor do windows without
    a sign; equal rows count once; other columns are not read. No such rows, or
    one language alone, give a network that knows no more than that.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, 4) != 2))
    got = sample_windows(rows, text_col, F.col(lang_col), id_col, texts, 8, WINDOW)
    names = sorted({r["label"] for r in got})
    pairs = [(w.encode()[k : k + WINDOW], names.index(r["label"])) for r in got for w in r["windows"] if w and w.strip() for k in range(0, len(w.encode()), WINDOW)]
    return gru.train([w for w, _ in pairs], [c for _, c in pairs], names, hidden, steps, WINDOW)


def identify(docs: DataFrame, model: gru.Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score added: the class with the highest mean probability over all positions, and that mean.

    A null text or one without a letter is ``und`` with a score of 0, as is
    everything where no language was learned. All bytes of a text count. Clashing
    columns of these names are replaced; an empty table stays empty.
    """
    names = pa.array([*model.names, UNKNOWN])

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def label(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in tx.released(columns):
            data, bounds = tx.utf8(column)
            parts = [gru.label(model, data, bounds[i : j + 1], READ) for i, j in gru.runs(bounds)] if model.names else []
            p = np.concatenate(parts) if parts else np.ones((len(column), 1))
            yield pa.StructArray.from_arrays([names.take(pa.array(p.argmax(1))), pa.array(np.clip(p.max(1), 0, 1), pa.float64())], ["lang_pred", "score"])

    # evaluated once, whatever stands above it
    found = bounded(docs).withColumn("_label", label.asNondeterministic()(F.col(text_col)))
    worded = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(model.names))
    added = {"lang_pred": F.when(worded, F.col("_label.lang_pred")).otherwise(UNKNOWN), "score": F.when(worded, F.col("_label.score")).otherwise(0.0)}
    kept = [c for c in docs.columns if c not in added]
    return found.select(*kept, *[value.alias(name) for name, value in added.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs.select("doc_id", "text"), train_languages(docs)).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
