"""Nulls, repeats, ties and empty tables, as the operators' docstrings have them."""

from pyspark.sql import functions as F

from strandlake.operators import aggregates, filters, hmm, joins, seeding, variants, windows
from strandlake.operators import typing as ty


def test_empty_tables_give_no_rows(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    reads, kmers = none("read_id string, seq string"), none("kmer string, n int")
    edges = none("graph string, level int, edge_id long, from_id long, to_id long, locus_id string, symbol string, count double")
    for out in (
        filters.kmer_fractions(reads, ["read_id"], "seq", kmers, 5),
        filters.positive_filter(none("read_id string, seq1 string, seq2 string"), kmers, 5),
        filters.negative_filter(none("read_id string, mate int, seq string"), kmers, 5),
        filters.greedy_windows(none("chrom string, pos int, ref string")),
        filters.masked(none("chrom string, seq string"), none("chrom string, start int, end int")),
        filters.capped_starts(none("read_id string, chrom string, pos int"), "read_id", ["chrom", "pos"], 3),
        joins.panel_alleles(none("pos int, allele string"), none("pos int, allele string"), ["pos"]),
        joins.kmer_union([kmers, kmers]),
        windows.random_best(none("g string, v int, k int"), ["g"], "v", "k"),
        hmm.decode(none("sample string, level int, state string, ll double, start double"), none("level int, from_state string, to_state string, p double")),
        ty.type_alleles(none("locus string, read int, pos int, genotype string, p double, mapq_position double"), none("locus string, cluster int, pos int, base string")),
        ty.pair_likelihoods(none("locus string, cluster int, read int, ll double, mismatches int")),
        seeding.seeded_reads(reads, edges, 5),
        variants.phased(none("chrom string, seg_ord int, a1 string, a2 string"), kmers, 5),
    ):
        assert out.count() == 0
    assert aggregates.graph_coverage(none("level int, edge_id int, kmer string, copies int"), kmers, kmers, 7.0).first().coverage == 7.0
    assert aggregates.alignment_summary(none("strands_ok boolean, distance int, distance_ok boolean, fraction1 double, fraction2 double")).first().n_pairs == 0


def test_repeated_reads_count_together_and_nulls_have_no_kmers(spark):
    known = spark.createDataFrame([("AAA",)], "kmer string")
    reads = spark.createDataFrame([("r", "AAAA"), ("r", "CCCC"), ("n", None), ("s", "AA"), (None, "AAA")], "read_id string, seq string")
    for most in (0, 1000):
        got = {r.read_id: (r.n_kmers, r.n_hits, r.fraction) for r in filters.kmer_fractions(reads, ["read_id"], "seq", known, 3, 0.5, most).collect()}
        assert got == {"r": (4, 2, 0.5), "n": (0, 0, 0.5), "s": (0, 0, 0.5), None: (1, 1, 1.0)}


def test_masks_that_overlap_and_reach_beyond_the_end(spark):
    ref = spark.createDataFrame([("1", "ACGTACGTAC"), ("2", "ACGT"), ("3", "")], "chrom string, seq string")
    spans = spark.createDataFrame([("1", 2, 4), ("1", 3, 3), ("1", 4, 5), ("1", 9, 99), ("2", -5, 1), ("3", 1, 2), ("9", 1, 2), ("2", 4, 3)], "chrom string, start int, end int")
    assert {r.chrom: r.seq for r in filters.masked(ref, spans).collect()} == {"1": "ANNNNCGTNN", "2": "NCGT", "3": ""}


def test_keys_stay_or_go_whole_where_starts_are_capped(spark):
    rows = [(f"k{i}", "1", 5) for i in range(200)] + [(f"k{i}", "2", 7) for i in range(200)] + [("u", "*", 0)] * 3
    kept = filters.capped_starts(spark.createDataFrame(rows, "read_id string, chrom string, pos int"), "read_id", ["chrom", "pos"], 50).collect()
    by = {}
    for r in kept:
        by[r.read_id] = by.get(r.read_id, 0) + 1
    assert by.pop("u") == 3 and set(by.values()) == {2} and 20 <= len(by) <= 90


def test_draws_and_ties_are_the_same_on_every_run(spark):
    df = spark.createDataFrame([("a", 1, k) for k in range(50)], "g string, v int, k int")
    first = windows.random_best(df, ["g"], "v", "k", 3).first().k
    assert {windows.random_best(df.repartition(n), ["g"], "v", "k", 3).first().k for n in (1, 2, 5)} == {first}
    assert len({windows.random_best(df, ["g"], "v", "k", s).first().k for s in range(6)}) > 1
    median = aggregates.mean_and_median(df.withColumn("w", F.col("k").cast("double")), ["g"], "w").first()
    assert (median.n, median["mean"], median.median) == (50, 24.5, 25.0)


def test_a_table_counts_kmers_as_sets_do():
    import random

    import numpy as np
    import pyarrow as pa

    from strandlake.operators.kmer_table import KmerTable

    rng = random.Random(6)
    texts = [None, "", "ab"] + ["".join(rng.choice("abé日😀") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    known = {t[i : i + 4] for t in texts[3:60] if t for i in range(len(t) - 3)}
    table = KmerTable([*known, "abc"], 4)
    want = [sum((t or "")[i : i + 4] in known for i in range(len(t or "") - 3)) for t in texts]
    assert table.count(pa.array(texts)).tolist() == want == table.count(pa.array(texts), run=16).tolist()
    # words that share a hash are told apart by their signs
    table.hashes, table.most = np.zeros(len(table.hashes), np.uint64), len(table.hashes)
    table.low[:] = True
    table._hashes = lambda signs, n: np.zeros(n, np.uint64)
    assert table.count(pa.array(texts)).tolist() == want
    assert KmerTable([], 3).count(pa.array(["abc"])).tolist() == [0]
