import os

import corpus_pipeline
import numpy as np
from tests.llm.common import edited, prose, shingles
from tests.llm.test_models import LANGUAGES

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_columns(spark, tmp_path):
    base = [prose(120, k) for k in range(30)]
    item = prose(40, 900)
    texts = base + [edited(base[0], 1, 5), base[1], base[2] + " " + item, base[3] + " write to me@x.example.com", None, "123 456", ""]
    langs = [list(LANGUAGES)[0]] * len(texts)
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in now.select("doc_id").collect()}
    assert kept["language"] == set(range(34))
    assert kept["near_duplicates"] == set(range(34)) - {30, 31} - ({33} if len(shingles(texts[3]) & shingles(texts[33])) >= 0.75 * len(shingles(texts[3]) | shingles(texts[33])) else set()) - ({32} if len(shingles(texts[2]) & shingles(texts[32])) >= 0.75 * len(shingles(texts[2]) | shingles(texts[32])) else set())
    assert 32 not in kept["decontamination"] and kept["decontamination"] >= set(range(30))
    assert kept["packing"] == kept["personal_data"] == kept["decontamination"]
    rows = now.collect()
    assert sum(r.length for r in rows) == sum(len(np.frombuffer(r.ids, "<u4")) for r in rows)


def _tables(spark, path, rows, items=()):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id string, spans int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_stages_with_null_and_repeated_ids_and_clashing_columns(spark, tmp_path):
    a, b, c, item = prose(120, 1), prose(120, 2), prose(120, 3), prose(40, 4)
    texts = [(1, a), (2, edited(a, 1, 9)), (None, a), (None, b), (None, b), (3, b + " " + item), (None, c + " " + item), (4, c), (4, c), (4, prose(90, 5)), (5, None), (6, ""), (6, ""), (7, "x" * 60_000)]
    docs = _tables(spark, str(tmp_path), [(i, t, "en", "s", 1, "clash", 0) for i, t in texts], [(1, item)])
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path)).collect()
    want = [(1, a), (3, b + " " + item), (4, c), (4, texts[9][1]), (5, None), (6, ""), (7, "x" * 60_000)]
    near = lambda s, t: len(shingles(s) & shingles(t)) >= 0.75 * len(shingles(s) | shingles(t))
    assert not near(b, texts[5][1]) and not near(c, texts[6][1]) and near(a, texts[1][1])
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([*want, (None, b), (None, texts[6][1])], key=str)
    left = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted([x for x in texts if not (x[1] or "").endswith(item)], key=str)
    masked = corpus_pipeline.personal_stage(spark, docs, str(tmp_path))
    assert tuple(masked.columns) == corpus_pipeline.COLUMNS and masked.count() == len(texts)
    assert {(r.doc_id, r.n_chars) for r in masked.where("doc_id IN (5, 6)").collect()} == {(5, None), (6, 0)}


def test_stages_of_an_empty_table(spark, tmp_path):
    now = _tables(spark, str(tmp_path), [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or tuple(out.columns) == corpus_pipeline.COLUMNS)
        now = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def test_run_covers_the_smallest_tables(spark):
    if os.path.isdir(SF):
        out = corpus_pipeline.run(spark, SF)
        assert out.count() > 0 and set(out.columns) >= {"doc_id", "start", "length", "ids_crc32"}
