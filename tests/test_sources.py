import pytest
from pyspark.sql import functions as F

from strandlake.sources import alignments, bam, cortex, results, text


def put(tmp_path, name, content):
    (tmp_path / name).write_text(content)
    return str(tmp_path / name)


def test_panels(spark, tmp_path):
    path = put(tmp_path, "a.txt", "IndividualID Chromosome S1_0_1 rs2_1_2\nh1 6 A ?\nh2 6 C _\n")
    got = sorted((r.haplotype_id, r.chromosome, r.locus_id, r.level, r.allele or "") for r in text.read_haplotypes(spark, path).collect())
    assert got == [("h1", "6", "S1_0_1", 0, "A"), ("h1", "6", "rs2_1_2", 1, ""), ("h2", "6", "S1_0_1", 0, "C"), ("h2", "6", "rs2_1_2", 1, "_")]
    put(tmp_path, "segments.txt", "a.txt\n")
    assert text.read_segments(spark, str(tmp_path)).count() == 4
    g = text.read_genotypes(spark, put(tmp_path, "g.txt", "IndividualID L1\ni1 T/A\n")).first()
    assert (g.a1, g.a2) == ("A", "T")
    text.write_matrix(text.read_haplotypes(spark, path), str(tmp_path / "out"), "haplotype_id", "locus_id", "level", "allele")
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["IndividualID S1_0_1 rs2_1_2", "h1 A ?", "h2 C _"]
    with pytest.raises(Exception, match="width"):
        text.read_haplotypes(spark, put(tmp_path, "bad.txt", "IndividualID L1 L2\nh1 A\n")).collect()


def test_lists_and_counts(spark, tmp_path):
    assert sorted(r.kmer for r in text.read_kmers(spark, put(tmp_path, "k", "ACG\nTTT\n"), 3).collect()) == ["ACG", "TTT"]
    with pytest.raises(Exception, match="not 3"):
        text.read_kmers(spark, put(tmp_path, "k2", "ACGT\n"), 3).collect()
    counts, totals = text.read_counts(spark, put(tmp_path, "c", "ACG 4\nTTT -1\nMeanReadLen 100\nTotalKMerCoverage 7\nTotalSeq 9\n"))
    assert sorted((r.kmer, r.n, r.is_repeat) for r in counts.collect()) == [("ACG", 4, False), ("TTT", 0, True)]
    assert tuple(totals.first()) == (100, 7, 9)
    assert text.read_positions(spark, put(tmp_path, "p", "a 1\nb 2 +\n")).count() == 2


def test_sequences(spark, tmp_path):
    df = text.read_fasta(spark, put(tmp_path, "f.fa", ">one first\nACGT\nAC\n>two\nGG\n"))
    assert {r.chrom: r.seq for r in df.collect()} == {"one": "ACGTAC", "two": "GG"}
    text.write_fasta(df, str(tmp_path / "fa"), 4)
    assert {r.chrom: r.seq for r in text.read_fasta(spark, str(tmp_path / "fa")).collect()} == {"one": "ACGTAC", "two": "GG"}
    fq = text.read_fastq(spark, put(tmp_path, "r.fq", "@x/1\nACGT\n+\nIIII\n@y/2\nGG\n+\n##\n"))
    assert sorted(map(tuple, fq.collect())) == [("x", 1, "ACGT", "IIII"), ("y", 2, "GG", "##")]
    text.write_fastq(fq, str(tmp_path / "fq"))
    assert sorted(map(tuple, text.read_fastq(spark, str(tmp_path / "fq") + "/part-*").collect())) == sorted(map(tuple, fq.collect()))


def test_records(spark, tmp_path):
    vcf = text.read_vcf(spark, put(tmp_path, "v.vcf", "##x\n#CHROM\nchr6\t5\t.\tA\tC,G\t.\tPASS\t.\tDP:GT\t3:1/2\n6\t9\trs1\tT\tTA\t.\tPASS\t.\tGT\t0|1\n"))
    assert sorted((r.chrom, r.pos, r.a1, r.a2) for r in vcf.collect()) == [("6", 5, "C", "G"), ("6", 9, "T", "TA")]
    text.write_vcf(vcf, str(tmp_path / "vcf"))
    back = text.read_vcf(spark, str(tmp_path / "vcf"))
    assert sorted((r.chrom, r.pos, r.a1, r.a2) for r in back.collect()) == [("6", 5, "C", "G"), ("6", 9, "T", "TA")]
    row = spark.createDataFrame([("r", 0, "6", [3, 4, -1, 5], "AC_G", "ACTG", 60, "IIII")], "read_id string, flag int, chrom string, levels array<int>, g string, s string, mapq int, qual string")
    alignments.write_sam(row, str(tmp_path / "sam"))
    sam = text.read_sam(spark, str(tmp_path / "sam")).first()
    assert (sam.pos, sam.cigar, sam.seq) == (3, "2M1I1M", "ACTG")


def test_graphs_groups_and_tables(spark, tmp_path):
    nodes = spark.createDataFrame([(0, 0, False), (1, 1, True)], "node_id long, level int, terminal boolean")
    edges = spark.createDataFrame([(0, "L", 2.0, "A", 0, 1)], "edge_id long, locus_id string, count double, symbol_code string, from_id long, to_id long")
    text.write_graph(nodes, edges, str(tmp_path / "g"))
    n, e = text.read_graph(spark, str(tmp_path / "g") + "/part-*")
    assert sorted(map(tuple, n.collect())) == [(0, 0, False), (1, 1, True)] and tuple(e.first()) == (0, "L", 2.0, "A", 0, 1)
    s = text.read_genome_string(spark, put(tmp_path, "s", "AC\nG,T\n")).orderBy("seg_ord").collect()
    assert [tuple(r) for r in s] == [(0, "AC", None), (1, "G", "T")]
    m = text.read_genomic_mapping(spark, put(tmp_path, "m", "6:1,6:2\n\n6:3\n"))
    assert sorted(map(tuple, m.collect())) == [(0, "6", 1), (0, "6", 2), (2, "6", 3)]
    g = text.read_groups(spark, put(tmp_path, "n", "# c\nA*;01/02;01G\nB*;07;\n"))
    assert sorted(map(tuple, g.collect())) == [("A", "01", "01G"), ("A", "02", "01G"), ("B", "07", "07")]
    t = text.read_truth(spark, put(tmp_path, "t", "IndividualID\tHLAA\tHLADQA\ni\t01:01;01:02\t?\n"))
    assert sorted((r.locus, r.alleles) for r in t.collect()) == [("A", ["01:01", "01:02"]), ("DQA1", None)]
    text.write_tsv(edges, str(tmp_path / "tsv"))
    assert text.read_tsv(spark, str(tmp_path / "tsv")).select(F.col("locus_id")).first()[0] == "L"


def test_cortex(spark, tmp_path):
    rows = [("ACGTA", 3, 17), ("TTTTT", 1, 0), ("GATTC", 250, 255)]
    cortex.write(f"{tmp_path}/x.ctx", 5, rows)
    spark.dataSource.register(cortex.CortexSource)
    got = spark.read.format("cortex").option("records", 2).load(f"{tmp_path}/x.ctx").collect()
    assert sorted((r.kmer, r.coverage[0], r.edges[0]) for r in got) == sorted(rows)
    assert cortex.unpack(cortex.pack("ACGTACGTACGTACGTACGTACGTACGTACGTACGTA", 2), 37) == "ACGTACGTACGTACGTACGTACGTACGTACGTACGTA"


def test_bam_equals_its_rows_by_region(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = []
    for k in range(3000):
        n = rng.randint(20, 60)
        pos = rng.randint(1, 900_000)
        rows.append((f"r{k}", rng.choice([0, 16, 256]), rng.choice(["6", "7"]), pos, 60, f"{n - 5}M2D5M" if k % 3 else f"{n}M", "6", pos + 200, 250, "".join(rng.choice("ACGTN") for _ in range(n)), "".join(chr(33 + rng.randint(0, 60)) for _ in range(n))))
    rows += [(f"u{k}", 4, "*", 0, 0, "*", "*", 0, 0, "ACG", "*") for k in range(40)]
    path = f"{tmp_path}/x.bam"
    bam.write(path, [("chr6", 1_000_000), ("chr7", 1_000_000)], [(*r[:2], "chr" + r[2] if r[2] != "*" else "*", *r[3:6], "chr" + r[6] if r[6] != "*" else "*", *r[7:]) for r in rows], block=3000)
    spark.dataSource.register(bam.BamSource)
    read = lambda **o: sorted(map(tuple, spark.read.format("bam").options(width=50_000, **o).load(path).collect()))
    assert read() == sorted(rows)
    span = lambda r: sum(int(x) for x, op in __import__("re").findall(r"(\d+)([MD])", r[5]))
    near = [r for r in rows if r[2] == "6" and r[3] <= 300_000 and r[3] + span(r) - 1 >= 100_000]
    assert read(regions="chr6:100000-300000") == sorted(near) and len(near) > 100
    assert read(regions="6:100000-300000", unmapped="true") == sorted(near + rows[-40:])
    assert read(regions="8:1-5") == []
    import os

    os.remove(path + ".bai")
    assert read() == sorted(rows)
    # without an index a file is parted at its blocks, whatever the parts' size
    size = os.path.getsize(path)
    for split in (700, size // 6):
        parts = spark.read.format("bam").option("split", split).load(f"file://{path}")
        assert sorted(map(tuple, parts.collect())) == sorted(rows) and parts.rdd.getNumPartitions() == -(-size // split)
    with pytest.raises(Exception, match="index"):
        read(regions="6:1-5")
    # records that go on from block to block
    import struct
    import zlib

    blocks = bam.Blocks(path)
    whole, out = blocks.read(1 << 30), []
    for i in range(0, len(whole), 777):
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(whole[i : i + 777]) + deflate.flush()
        out.append(b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff\x06\0BC\2\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(whole[i : i + 777]), len(whole[i : i + 777])))
    with open(f"{tmp_path}/cut.bam", "wb") as f:
        f.write(b"".join(out) + bam.LAST_BLOCK)
    parts = spark.read.format("bam").option("split", 20_000).load(f"{tmp_path}/cut.bam")
    assert sorted(map(tuple, parts.collect())) == sorted(rows) and parts.rdd.getNumPartitions() > 5


def test_bam_folders(spark, tmp_path):
    rows = [(f"r{k}", 0, "6" if k % 3 else "*", k * 7 % 500 + 1 if k % 3 else 0, 9, "3M" if k % 3 else "*", "*", 0, 0, "ACG", "III") for k in range(900)]
    df = spark.createDataFrame(rows, bam.FIELDS).withColumn("_ref", F.lit(1))
    spark.dataSource.register(bam.BamSource)
    for n, some in (("many", df), ("none", df.limit(0))):
        bam.write_files(some, f"file:{tmp_path}/{n}", [("6", 1000)], records=100)
    load = lambda n, **o: sorted(map(tuple, spark.read.format("bam").options(**o).load(f"{tmp_path}/{n}").collect()))
    assert load("many") == sorted(rows) and load("none") == []
    assert load("many", regions="6:1-3") == sorted(r for r in rows if r[2] == "6" and r[3] <= 3)


def test_aligned_reads_and_names(spark, tmp_path):
    rows = [(i, a, m, f"x{i}/{m}", 1.5 * a, m == 2, 0.75, 0.5, "II_I" if a else None, "AC_G", "ACTG", [3, 4, -1, 5], "ACTG", "IIII") for i in range(3) for a in range(2) for m in (1, 2)]
    df = spark.createDataFrame(rows, "pair long, aln int, mate int, read_id string, score double, reverse boolean, mapq double, mapq_genomic double, mapq_pos string, g string, s string, levels array<int>, seq string, qual string")
    alignments.write_alignments(df, f"{tmp_path}/a", 200.0, 15.0)
    assert tuple(alignments.read_insert_size(spark, f"{tmp_path}/a").first()) == (200.0, 15.0)
    back = [(*r[:8], r[8] or None, *r[9:]) for r in alignments.read_alignments(spark, f"{tmp_path}/a").collect()]
    assert sorted(back, key=lambda r: r[:3]) == rows
    old = put(tmp_path, "old", "IS 1 2\nAligned pair 7\n" + "".join(f"\tRead q/{m}A0\n\t\t2\n\t\t0\n\t\t0.25\n\t\tA\n\t\tA\n\t\t9\n\t\tA\n\t\tI\n" for m in (1, 2)))
    assert [(r.pair, r.mate, r.mapq, r.mapq_genomic, r.mapq_pos) for r in alignments.read_alignments(spark, old).collect()] == [(7, 1, 0.25, 2.0, None), (7, 2, 0.25, 2.0, None)]
    names = spark.createDataFrame([(0.5, "6", 10, 20, False, 0.25, "6", 50, 60, True), (0.5, "6", 50, 60, True, 0.25, "6", 10, 20, False), (0.5, "6", 10, 20, False, None, None, None, None, None)], "ll1 double, chrom1 string, start1 int, end1 int, reverse1 boolean, ll2 double, chrom2 string, start2 int, end2 int, reverse2 boolean")
    text_ = [r[0] for r in names.select(alignments.alignment_name()).collect()]
    assert text_ == ["normalAlignment=0.5[6:10-20];0.25[6:50-60];1;30", "normalAlignment=0.5[6:50-60];0.25[6:10-20];1;30", "normalAlignment=0.5[6:10-20];NA;NA;NA"]
    parsed = spark.createDataFrame([(f"read:{t}/1:FROM:x",) for t in text_] + [("plain/1",)], "n string").select(alignments.parsed_name(F.col("n")).alias("p")).collect()
    assert [r.p and (r.p.ll1, r.p.chrom1, r.p.start1, r.p.end2, r.p.strands_ok, r.p.distance) for r in parsed] == [(0.5, "6", 10, 60, True, 30), (0.5, "6", 50, 20, True, 30), (0.5, "6", 10, None, None, None), None]


def test_cigars_against_a_mapping(spark):
    rows = [("r", "AC_GTA_", "TC_G_AT", [1, 2, 3, 4, 5, 6, -1]), ("n", "__", "AC", [-1, -1])]
    df = spark.createDataFrame(rows, "read_id string, g string, s string, levels array<int>")
    mapping = spark.createDataFrame([(2, 101), (3, 102), (4, 103), (5, 104), (6, 108)], "level int, pos int")
    assert [tuple(r) for r in alignments.cigars(df, mapping).collect()] == [("r", 101, 108, "1S1M1D1M4D1M1S")]


def test_result_tables_and_small_files(spark, tmp_path):
    rows = [("A", 1, "A*01;A*02", 0.9, 0.8, 12.5, 3, 1, -1.0, 0.01, 2), ("A", 2, "A*03", 0.8, 0.8, 12.5, 3, 1, 0.5, 0.01, 2)]
    schema = "locus string, chromosome int, allele string, q1 double, q2 double, avg_cov double, cov_decile1 int, min_cov int, prop_kmers double, avg_col_error double, n_unaccounted int"
    for s in ("s1", "s2"):
        results.write_table(spark.createDataFrame(rows, schema), f"{tmp_path}/{s}/guess", results.BEST_GUESS, ["locus", "chromosome"])
    table, state = results.collect_samples(spark, ["s1", "s2", "s3"], f"{tmp_path}/{{sample}}/guess", results.BEST_GUESS, schema)
    assert sorted(tuple(r)[:-1] for r in table.collect()) == sorted(rows * 2) and {r.sample: r.found for r in state.collect()} == {"s1": True, "s2": True, "s3": False}
    results.write_parameters(spark, {"Loci": "A,B", "full": 1}, f"{tmp_path}/p")
    assert sorted(map(tuple, results.read_parameters(spark, f"{tmp_path}/p").collect())) == [("Loci", "A,B"), ("full", "1")]
    results.write_lines(spark.createDataFrame([("b",), ("a",), ("b",)], "read string"), "read", f"{tmp_path}/ids")
    assert [r.value for r in spark.read.text(f"{tmp_path}/ids").collect()] == ["a", "b"]
    put(tmp_path, "A_12_exon_2.txt", "IndividualID p1 p2\nA*01 A _\n")
    assert sorted(map(tuple, results.read_exons(spark, f"{tmp_path}/A_12_exon_2.txt").collect())) == [("A", "exon_2", "A*01", "p1", 0, "A"), ("A", "exon_2", "A*01", "p2", 1, "_")]
    q = put(tmp_path, "q", "readLength\tqualityScore\tpositionInRead\tN\tExpectedCorrect\tEmpiricalCorrect\n100\t30\t0\t5\t0.9\t0.8\n")
    assert tuple(results.read_quality_matrix(spark, q).first()) == (100, 30, 0, 5.0, 0.9, 0.8)
    with pytest.raises(ValueError):
        results.read_quality_matrix(spark, put(tmp_path, "q2", "a\tb\n1\t2\n"))
    head, seqs = results.read_short_alignments(spark, put(tmp_path, "s", "a 1\nb 2\nc 3\nd 4\nA*01 AC_G\n"))
    assert sorted(map(tuple, head.collect())) == [("a", 1), ("b", 2), ("c", 3), ("d", 4)] and tuple(seqs.first()) == ("A*01", "AC_G")
    haps = spark.createDataFrame([("1", 0, "A"), ("1", 1, "CT"), ("2", 0, "A"), ("2", 1, "_")], "hap string, level int, symbol string")
    results.write_chromotypes(haps, f"{tmp_path}/c")
    assert sorted(map(tuple, results.read_chromotypes(spark, f"{tmp_path}/c").collect())) == sorted(map(tuple, haps.collect()))
    with pytest.raises(Exception, match="two lines"):
        results.read_chromotypes(spark, put(tmp_path, "c2", "1 x A C\n2 x A\n")).collect()
    for content in (">x one\nac-\nGT\n>y\nACG.T\n", "CLUSTAL\n\nx  AC- 3\ny  ACG 3\n   ** \n\nx  GT 5\ny  .T 5\n"):
        got = results.read_alignment_blocks(spark, put(tmp_path, "b", content)).collect()
        assert {h: "".join(r.allele for r in sorted(got, key=lambda r: r.level) if r.haplotype_id == h) for h in "xy"} == {"x": "AC_GT", "y": "ACG_T"}


def test_a_graph_file_is_read_in_splits(spark, tmp_path):
    edge = lambda i: text.SEPARATOR.join([str(i), f"L{i}", "1.5", "A", str(i), str(i + 1)])
    node = lambda i: text.SEPARATOR.join([str(i), str(2 * i), str(i % 2)])
    for name, n in (("a", 400), ("b", 3)):  # either section may come first, and again
        parts = ["EDGES:", *map(edge, range(n)), "", "NODES:\r", *[node(i) + "\r" for i in range(n)], " EDGES: ", edge(n)]
        (tmp_path / name).write_text("\n".join(parts), newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        nodes, edges = text.read_graph(spark, str(tmp_path))
        assert nodes.rdd.getNumPartitions() > 2
        assert sorted(map(tuple, nodes.collect())) == sorted((i, 2 * i, i % 2 == 1) for n in (400, 3) for i in range(n))
        assert sorted(map(tuple, edges.collect())) == sorted((i, f"L{i}", 1.5, "A", i, i + 1) for n in (400, 3) for i in range(n + 1))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
