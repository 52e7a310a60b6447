"""Genome strings from records: the reference in pieces, none of which goes along whole with a record."""

from pyspark.sql import functions as F

from strandlake.operators import variants


def test_places_span_pieces_of_the_reference(spark, monkeypatch):
    seq = "ACG\nTTGCATé" * 3
    monkeypatch.setattr(variants, "PIECE", 4, raising=False)
    reference = spark.createDataFrame([("1", seq), ("2", "ACGT"), ("3", "")], "chrom string, seq string")
    records = spark.createDataFrame([("1", 1, seq[0], "G", "GT"), ("1", 2, seq[1], "C", "C"), ("1", 20, seq[19:21], "A", "A"), ("2", 4, "T", "A", "C"), ("9", 1, "A", "A", "C")], "chrom string, pos int, ref string, a1 string, a2 string")
    got = [tuple(r) for r in variants.records_to_segments(records, reference).select("chrom", "seg_ord", "pos", "a1", "a2").orderBy("chrom", "seg_ord").collect()]
    one = [(1, "G_", "GT"), (2, "C", None), (3, seq[2:19], None), (20, "A", None), (22, seq[21:], None)]
    assert got == [("1", n, *r) for n, r in enumerate(one)] + [("2", 0, 1, "ACG", None), ("2", 1, 4, "A", "C"), ("3", 0, 1, "", None)]


def test_no_record_takes_the_whole_reference_along(spark):
    n = 200
    reference = spark.createDataFrame([("1", "ACGTTGCA" * 5000)], "chrom string, seq string")
    records = spark.range(n).select(F.lit("1").alias("chrom"), (F.col("id") * 150 + 3).cast("int").alias("pos"), F.lit("G").alias("ref"), F.lit("G").alias("a1"), F.lit("T").alias("a2"))
    out = variants.records_to_segments(records, reference)
    assert out.count() == 2 * n + 1
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert any("_piece" in line for line in joins)
