"""Queries that write a table in one of the formats and read it again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.lineage import shared_dir
from strandlake.operators import filters as fl
from strandlake.operators import typing as ty
from strandlake.plans.tables import dna, dna_sql, kmers_sql, revcomp_sql, table
from strandlake.sources import alignments, bam, cortex, results, text

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _put(df: DataFrame, name: str, order: list[str] | None = None) -> str:
    """Path of a text file of the column value, in one piece where its order counts."""
    path = _path(df.sparkSession, name)
    (df.orderBy(*order).select("value").coalesce(1) if order else df.select("value")).write.text(path)
    return path


def _sign(letters: str, number: Column) -> Column:
    return F.substr(F.lit(letters), (number % len(letters) + 1).cast("int"), F.lit(1))


# --- panels: brands as haplotypes, sizes as loci

_GRID = """b AS (SELECT DISTINCT p_brand FROM part), z AS (SELECT p_size, CAST(dense_rank() OVER (ORDER BY p_size) - 1 AS INT) AS lv FROM (SELECT DISTINCT p_size FROM part) x),
c AS (SELECT p_brand, p_size, min(p_partkey) AS k FROM part GROUP BY 1, 2), g AS (SELECT b.p_brand AS h, z.p_size, lv, k FROM b CROSS JOIN z LEFT JOIN c ON b.p_brand = c.p_brand AND z.p_size = c.p_size)"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every brand with every size, both fixed lists of the tables, and the smallest part of each cell."""
    p = table(spark, sf_dir, "part")
    cells = p.groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("k"))
    return p.select("p_brand").distinct().crossJoin(F.broadcast(p.select("p_size").distinct())).join(cells, ["p_brand", "p_size"], "left").withColumn("locus", F.concat(F.lit("L"), F.col("p_size").cast("string")))


@query(f"WITH {_GRID} SELECT h AS haplotype_id, 'L' || p_size AS locus_id, lv AS level, substr('ACGT_', CAST(k % 5 + 1 AS INT), 1) AS allele FROM g")
def panel_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "panel")
    text.write_matrix(_grid(spark, sf_dir).withColumn("allele", _sign("ACGT_", F.col("k"))), path, "p_brand", "locus", "p_size", "allele")
    return text.read_haplotypes(spark, path).select("haplotype_id", "locus_id", "level", "allele")


@query(f"""WITH {_GRID}, a AS (SELECT *, substr('ACGT', CAST(k % 4 + 1 AS INT), 1) AS x, substr('ACGT', CAST(k // 4 % 4 + 1 AS INT), 1) AS y FROM g)
SELECT h AS individual_id, 'L' || p_size AS locus_id, least(x, y) AS a1, greatest(x, y) AS a2 FROM a""")
def genotype_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, k = _path(spark, "genotypes"), F.col("k")
    text.write_matrix(_grid(spark, sf_dir).withColumn("v", F.concat(_sign("ACGT", k), F.lit("/"), _sign("ACGT", F.floor(k / 4)))), path, "p_brand", "locus", "p_size", "v")
    return text.read_genotypes(spark, path)


@query("SELECT 'p' || p_partkey AS locus_id, CAST(p_size AS INT) AS pos, CASE WHEN p_partkey % 3 = 0 THEN '+' WHEN p_partkey % 3 = 1 THEN '-' END AS strand FROM part")
def positions_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    strand = F.when(key % 3 == 0, "+").when(key % 3 == 1, "-")
    return text.read_positions(spark, _put(table(spark, sf_dir, "part").select(F.concat_ws(" ", F.concat(F.lit("p"), key.cast("string")), F.col("p_size").cast("string"), strand).alias("value")), "positions"))


@query(f"""WITH {_GRID}, s AS (SELECT *, p_size % 3 AS n, CAST(dense_rank() OVER (PARTITION BY p_size % 3 ORDER BY p_size) - 1 AS INT) AS level FROM g)
SELECT 'part' || n || '.txt' AS segment, CAST(n AS INT) AS seg_ord, h AS haplotype_id, 'L' || p_size AS locus_id, level, substr('ACGT_', CAST(k % 5 + 1 AS INT), 1) AS allele FROM s""")
def segment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, grid = _path(spark, "segments"), _grid(spark, sf_dir).withColumn("allele", _sign("ACGT_", F.col("k")))
    for n in range(3):
        text.write_matrix(grid.where(F.col("p_size") % 3 == n), f"{folder}/part{n}.txt", "p_brand", "locus", "p_size", "allele")
    spark.createDataFrame([(f"part{n}.txt",) for n in range(3)], "value string").coalesce(1).write.text(f"{folder}/segments.txt")
    return text.read_segments(spark, folder)


@query("""SELECT p_partkey AS edge_id, 'L' || p_size AS locus_id, p_retailprice AS count, substr('ACGT_', CAST(p_partkey % 5 + 1 AS INT), 1) AS symbol_code, CAST(p_size AS BIGINT) AS from_id, CAST(p_size + 1 AS BIGINT) AS to_id, CAST(p_size * 2 AS INT) AS level, p_size = 7 AS terminal FROM part""")
def graph_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, size = _path(spark, "graph"), F.col("p_size")
    p = table(spark, sf_dir, "part")
    nodes = p.select(size.cast("long").alias("node_id")).distinct().select("node_id", (F.col("node_id") * 2).cast("int").alias("level"), (F.col("node_id") == 7).alias("terminal"))
    edges = p.select(F.col("p_partkey").alias("edge_id"), F.concat(F.lit("L"), size.cast("string")).alias("locus_id"), F.col("p_retailprice").alias("count"), _sign("ACGT_", F.col("p_partkey")).alias("symbol_code"), size.cast("long").alias("from_id"), (size + 1).cast("long").alias("to_id"))
    text.write_graph(nodes, edges, path)
    n, e = text.read_graph(spark, f"{path}/part-*")
    return e.join(n.withColumnRenamed("node_id", "from_id"), "from_id")


# --- k-mers and sequences: passages as bases

_BENCH = f"bench AS (SELECT item_id, {dna_sql('text')} AS seq FROM benchmark)"


def _bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", dna(F.col("text")).alias("seq"))


@query(f"WITH {_BENCH} SELECT DISTINCT kmer FROM ({kmers_sql('bench', 'item_id', 'seq', 9)}) x")
def kmer_list_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.read_kmers(spark, _put(fl.kmer_set(_bench(spark, sf_dir), "seq", 9).select(F.col("kmer").alias("value")), "kmers"), 9)


@query(f"""WITH {_BENCH}, k AS (SELECT kmer, count(*) AS n FROM ({kmers_sql("bench", "item_id", "seq", 7)}) x GROUP BY 1)
SELECT kmer, CASE WHEN n > 3 THEN 0 ELSE n END AS n, n > 3 AS is_repeat, CAST(101 AS BIGINT) AS mean_read_len, CAST(5000 AS BIGINT) AS total_kmer_cov, CAST(90000 AS BIGINT) AS total_seq FROM k""")
def kmer_count_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of at most three; what occurs more often is marked as a repeat."""
    from strandlake.functions import sequences as sq

    n = _bench(spark, sf_dir).select(F.explode(sq.kmers(F.col("seq"), 7)).alias("kmer")).groupBy("kmer").count()
    rows = n.select(F.concat_ws(" ", "kmer", F.when(F.col("count") > 3, -1).otherwise(F.col("count")).cast("string")).alias("value"))
    totals = spark.createDataFrame([("MeanReadLen 101",), ("TotalKMerCoverage 5000",), ("TotalSeq 90000",)], "value string")
    counts, sums = text.read_counts(spark, _put(rows.unionByName(totals), "counts"))
    return counts.join(F.broadcast(sums))  # one row


@query(f"""WITH n AS (SELECT n_nationkey, rpad({dna_sql("n_name")}, 9, 'ACGTTGCAA') AS s FROM nation)
SELECT least(s, {revcomp_sql("s")}) AS kmer, CAST(n_nationkey * 1000 + 7 AS BIGINT) AS coverage, CAST(n_nationkey * 10 AS INT) AS edges FROM n""")
def cortex_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nations, a fixed list, as k-mers of a binary graph."""
    from strandlake.functions import sequences as sq

    n = table(spark, sf_dir, "nation").select("n_nationkey", sq.canonical(F.rpad(dna(F.col("n_name")), 9, "ACGTTGCAA")).alias("kmer"))
    path = _path(spark, "ctx")
    cortex.write(path, 9, [(r.kmer, r.n_nationkey * 1000 + 7, r.n_nationkey * 10) for r in n.collect()])
    spark.dataSource.register(cortex.CortexSource)
    return spark.read.format("cortex").option("records", 10).load(path).select("kmer", F.get("coverage", 0).alias("coverage"), F.get("edges", 0).alias("edges"))


@query(f"WITH {_BENCH} SELECT 'item' || item_id AS chrom, seq FROM bench")
def fasta_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "fasta")
    text.write_fasta(_bench(spark, sf_dir).select(F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("chrom"), "seq"), path)
    return text.read_fasta(spark, path)


@query(f"""SELECT 'c' || conv_id || '.' || turn AS read_id, CAST(turn % 2 + 1 AS TINYINT) AS mate, {dna_sql("text")} AS seq, repeat('I', length({dna_sql("text")})) AS qual FROM conversations WHERE length({dna_sql("text")}) > 0""")
def fastq_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "fastq")
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("read_id"), (F.col("turn") % 2 + 1).alias("mate"), dna(F.col("text")).alias("seq")).where(F.length("seq") > 0)
    text.write_fastq(c.withColumn("qual", F.repeat(F.lit("I"), F.length("seq"))), path)
    return text.read_fastq(spark, f"{path}/part-*")


# --- alignments


_BAM = """r AS (SELECT CAST(o_orderkey AS VARCHAR) AS read_id, CAST(o_orderkey % 2 * 16 AS INT) AS flag, CASE WHEN o_orderkey % 10 = 0 THEN '*' WHEN o_custkey % 2 = 0 THEN '6' ELSE '7' END AS chrom, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE CAST(o_custkey * 997 % 900000 + 1 AS INT) END AS pos, CASE WHEN o_orderkey % 10 = 0 THEN '*' ELSE '4M2D3M' END AS cigar FROM orders)"""


def _bam(spark: SparkSession, sf_dir: str) -> str:
    """A folder of binary files of all orders as reads; every tenth key has no place."""
    key, lost = F.col("o_orderkey"), F.col("o_orderkey") % 10 == 0
    star = lambda c: F.when(lost, "*").otherwise(c)
    rows = table(spark, sf_dir, "orders").select(
        key.cast("string").alias("read_id"),
        (key % 2 * 16).cast("int").alias("flag"),
        star(F.when(F.col("o_custkey") % 2 == 0, "chr6").otherwise("chr7")).alias("chrom"),
        F.when(lost, 0).otherwise(F.col("o_custkey") * 997 % 900_000 + 1).cast("int").alias("pos"),
        (key % 61).cast("int").alias("mapq"),
        star(F.lit("4M2D3M")).alias("cigar"),
        F.lit("*").alias("mate_chrom"),
        F.lit(0).alias("mate_pos"),
        F.lit(0).alias("insert_size"),
        F.lit("ACGTACG").alias("seq"),
        F.lit("IIIIIII").alias("qual"),
    )
    path = _path(spark, "bam")
    bam.write_files(rows, path, [("chr6", 1_000_000), ("chr7", 1_000_000)], records=4000)
    spark.dataSource.register(bam.BamSource)
    return path


@query(f"""WITH {_BAM} SELECT read_id, flag, chrom, pos, cigar FROM r WHERE chrom = '*' OR chrom = '6' AND pos <= 500000 AND pos + 8 >= 200000""")
def bam_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region of a folder of binary files written by tasks, with the records that have no place."""
    return spark.read.format("bam").options(regions="6:200000-500000", unmapped="true", width=100_000).load(_bam(spark, sf_dir)).select("read_id", "flag", "chrom", "pos", "cigar")


_PAIRS = """o AS (SELECT o_custkey AS pair, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS aln, o_orderkey, o_totalprice FROM orders),
a AS (SELECT pair, aln, CAST(m AS INT) AS mate, 'c' || pair || '/' || m AS read_id, round(o_totalprice) AS score, m = 2 AS reverse, (o_orderkey % 64) / 64.0 AS mapq, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE (o_orderkey % 32) / 32.0 END AS mapq_genomic FROM o, unnest(range(1, 3)) AS r(m))"""


@query(f"""WITH {_PAIRS}, e AS (SELECT DISTINCT pair, aln FROM a WHERE mate = 1 AND mapq_genomic > 0.01)
SELECT a.pair, a.aln, a.mate, read_id, score, reverse, CAST(mapq AS DOUBLE) AS mapq, CAST(mapq_genomic AS DOUBLE) AS mapq_genomic, 'AC_G' AS g, 'ACTG' AS s, '5 6 -1 7' AS levels FROM a JOIN e ON a.pair = e.pair AND a.aln = e.aln""")
def aligned_reads_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as a pair's alignments; those that pass the gate are written and read."""
    from pyspark.sql import Window as W

    o = table(spark, sf_dir, "orders").withColumn("aln", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    key = F.col("o_orderkey")
    a = o.select(F.col("o_custkey").alias("pair"), "aln", F.explode(F.array(F.lit(1), F.lit(2))).alias("mate"), key.alias("k"), F.round("o_totalprice").alias("score"))
    a = a.select(
        "pair", "aln", "mate", F.concat(F.lit("c"), F.col("pair").cast("string"), F.lit("/"), F.col("mate").cast("string")).alias("read_id"), "score", (F.col("mate") == 2).alias("reverse"), (F.col("k") % 64 / 64.0).cast("double").alias("mapq"),
        F.when(F.col("k") % 3 == 0, 0.0).otherwise((F.col("k") % 32 / 32.0).cast("double")).alias("mapq_genomic"), F.lit("IIII").alias("mapq_pos"), F.lit("AC_G").alias("g"), F.lit("ACTG").alias("s"), F.array(*map(F.lit, (5, 6, -1, 7))).alias("levels"), F.lit("ACTG").alias("seq"), F.lit("IIII").alias("qual"),
    )
    path = _path(spark, "aligned")
    alignments.write_alignments(ty.emitted(a), path, 200.0, 15.0)
    back = alignments.read_alignments(spark, path)
    return back.select("pair", "aln", "mate", "read_id", "score", "reverse", "mapq", "mapq_genomic", "g", "s", F.array_join(F.transform("levels", lambda x: x.cast("string")), " ").alias("levels"))


@query("""WITH x AS (SELECT p_partkey AS k, 3 + p_partkey % 5 AS a, p_partkey % 3 AS i, 4 + p_size % 4 AS b, p_size % 2 AS d FROM part)
SELECT 'r' || k AS read_id, '6' AS chrom, CAST(1000 + k AS INT) AS pos, CASE WHEN i = 0 AND d = 0 THEN (a + b + 3) || 'M' WHEN i = 0 THEN (a + b) || 'M' || d || 'D3M' WHEN d = 0 THEN a || 'M' || i || 'I' || (b + 3) || 'M' ELSE a || 'M' || i || 'I' || b || 'M' || d || 'D3M' END AS cigar,
repeat('A', CAST(a AS INT)) || repeat('T', CAST(i AS INT)) || repeat('C', CAST(b AS INT)) || 'TTT' AS seq FROM x""")
def sam_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments to a graph whose levels lie 1,000 after the reference's positions."""
    key, size = F.col("p_partkey"), F.col("p_size")
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("r"), key.cast("string")).alias("read_id"), key.cast("int").alias("k"), (3 + key % 5).cast("int").alias("a"), (key % 3).cast("int").alias("i"), (4 + size % 4).cast("int").alias("b"), (size % 2).cast("int").alias("d"))
    rep = lambda c, n: F.expr(f"repeat('{c}', {n})")
    g, s = F.concat(rep("A", "a"), rep("_", "i"), rep("C", "b"), rep("G", "d"), F.lit("TTT")), F.concat(rep("A", "a"), rep("T", "i"), rep("C", "b"), rep("_", "d"), F.lit("TTT"))
    levels = F.expr("concat(sequence(k, k + a - 1), array_repeat(-1, i), sequence(k + a, k + a + b + d + 2))")
    rows = p.select("read_id", F.lit(0).alias("flag"), F.lit("6").alias("chrom"), g.alias("g"), s.alias("s"), levels.alias("levels"), F.lit(30).alias("mapq"), F.lit("*").alias("qual"))
    top = p.agg(F.max("k").alias("m"))  # one row
    mapping = top.select(F.explode(F.sequence(F.lit(0), F.col("m") + 30)).alias("level")).withColumn("pos", F.col("level") + 1000)
    path = _path(spark, "sam")
    alignments.write_sam(rows, path, mapping)
    return text.read_sam(spark, path).select("read_id", "chrom", "pos", "cigar", "seq")


_NAMED = """n AS (SELECT o_orderkey, o_orderkey % 9 = 0 AS none, o_orderkey % 2 = 0 AS r1, o_orderkey % 5 < 3 AS r2, CAST(o_custkey + 100 AS INT) AS s1, CAST(o_custkey + 140 AS INT) AS e1, CAST(o_orderkey % 3000 + 100 AS INT) AS s2, CAST(o_orderkey % 3000 + 130 AS INT) AS e2 FROM orders)"""


@query(f"""WITH {_NAMED}, d AS (SELECT *, CASE WHEN none OR r1 = r2 THEN NULL WHEN NOT r1 AND s1 < s2 THEN s2 - e1 WHEN r1 AND e1 > e2 THEN s1 - e2 END AS distance FROM n)
SELECT o_orderkey, 0.5 AS ll1, '6' AS chrom1, s1 AS start1, e1 AS end1, CASE WHEN none THEN NULL ELSE 0.25 END AS ll2, CASE WHEN none THEN NULL ELSE s2 END AS start2, CASE WHEN none THEN NULL ELSE distance IS NOT NULL END AS strands_ok, distance FROM d""")
def read_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of both mates put into names and taken out of them."""
    key = F.col("o_orderkey")
    some = lambda c: F.when(key % 9 != 0, c)
    o = table(spark, sf_dir, "orders").select(
        key, F.lit(0.5).alias("ll1"), F.lit("6").alias("chrom1"), (F.col("o_custkey") + 100).cast("int").alias("start1"), (F.col("o_custkey") + 140).cast("int").alias("end1"), (key % 2 == 0).alias("reverse1"),
        some(F.lit(0.25)).alias("ll2"), some(F.lit("6")).alias("chrom2"), (key % 3000 + 100).cast("int").alias("start2"), (key % 3000 + 130).cast("int").alias("end2"), (key % 5 < 3).alias("reverse2"),
    )
    named = o.select(key, F.concat(F.lit("read:"), alignments.alignment_name(), F.lit("/1:FROM:x")).alias("name"))
    return named.select(key, alignments.parsed_name(F.col("name")).alias("p")).select(key, "p.ll1", "p.chrom1", "p.start1", "p.end1", "p.ll2", "p.start2", "p.strands_ok", "p.distance")


@query("""SELECT CAST(p_partkey % 3 + 1 AS VARCHAR) AS chrom, CAST(p_partkey AS INT) AS pos, 'GT' AS ref, CASE WHEN p_partkey % 2 = 0 THEN 'GT' ELSE 'G' END AS a1, CASE WHEN p_partkey % 5 = 0 THEN 'GTTA' ELSE 'GT' END AS a2, CASE WHEN p_size > 25 THEN 'PASS' ELSE 'FAIL' END AS filter FROM part""")
def vcf_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, path = F.col("p_partkey"), _path(spark, "vcf")
    rows = table(spark, sf_dir, "part").select((key % 3 + 1).cast("string").alias("chrom"), key.cast("int").alias("pos"), F.lit("GT").alias("ref"), F.when(key % 2 == 0, "GT").otherwise("G").alias("a1"), F.when(key % 5 == 0, "GTTA").otherwise("GT").alias("a2"), F.when(F.col("p_size") > 25, "PASS").otherwise("FAIL").alias("filter"))
    text.write_vcf(rows, path)
    return text.read_vcf(spark, path).select("chrom", "pos", "ref", "a1", "a2", "filter")


# --- small files


@query("SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INT) AS seg_ord, substr('ACGT', CAST(p_size % 4 + 1 AS INT), 1) AS a1, CASE WHEN p_partkey % 3 = 0 THEN 'TT' END AS a2 FROM part")
def genome_string_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    path = _put(p.select("p_partkey", F.concat_ws(",", _sign("ACGT", F.col("p_size")), F.when(F.col("p_partkey") % 3 == 0, "TT")).alias("value")), "genome", ["p_partkey"])
    return text.read_genome_string(spark, f"{path}/part-*")


@query("SELECT CAST(h AS VARCHAR) AS hap, CAST(row_number() OVER (PARTITION BY h ORDER BY p_partkey) - 1 AS INT) AS level, substr('ACGT_', CAST((p_partkey + h * p_size) % 5 + 1 AS INT), 1) AS symbol FROM part, unnest([1, 2]) AS r(h)")
def chromotype_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "chromotypes")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.array(F.lit(1), F.lit(2))).alias("h"))
    results.write_chromotypes(p.select(F.col("h").cast("string").alias("hap"), F.col("p_partkey").alias("level"), _sign("ACGT_", F.col("p_partkey") + F.col("h") * F.col("p_size")).alias("symbol")), path)
    return results.read_chromotypes(spark, path)


@query("SELECT 100 AS \"readLength\", CAST(p_size AS INT) AS \"qualityScore\", CAST(p_partkey AS INT) AS \"positionInRead\", 1.0::DOUBLE AS \"N\", p_retailprice AS \"ExpectedCorrect\", p_size / 2 AS \"EmpiricalCorrect\" FROM part")
def quality_matrix_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "qualities")
    p = table(spark, sf_dir, "part").select(F.lit(100).alias("readLength"), F.col("p_size").alias("qualityScore"), F.col("p_partkey").alias("positionInRead"), F.lit(1.0).alias("N"), F.col("p_retailprice").alias("ExpectedCorrect"), (F.col("p_size") / 2).alias("EmpiricalCorrect"))
    text.write_tsv(p, path)
    return results.read_quality_matrix(spark, path)


@query(f"WITH {_GRID} SELECT 'A' AS locus, 'exon_2' AS exon, h AS allele, 'L' || p_size AS locus_id, lv AS exon_pos, coalesce(substr('ACGT_', CAST(k % 5 + 1 AS INT), 1), '?') AS base FROM g")
def exon_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_path(spark, 'exons')}/A_12_exon_2.txt"
    text.write_matrix(_grid(spark, sf_dir).withColumn("allele", _sign("ACGT_", F.col("k"))), path, "p_brand", "locus", "p_size", "allele")
    return results.read_exons(spark, path)


@query("""WITH s AS (SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INT) AS level FROM supplier)
SELECT level, CAST(r AS VARCHAR) AS region, CAST(s_suppkey * 10 + r AS INT) AS pos FROM s, unnest([6, 7]) AS x(r) WHERE s_suppkey % 4 <> 0""")
def genomic_mapping_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels by supplier; every fourth has no place."""
    s = table(spark, sf_dir, "supplier")
    place = lambda r: F.concat(F.lit(f"{r}:"), (F.col("s_suppkey") * 10 + r).cast("string"))
    path = _put(s.select("s_suppkey", F.when(F.col("s_suppkey") % 4 != 0, F.concat_ws(",", place(6), place(7))).otherwise("").alias("value")), "mapping", ["s_suppkey"])
    return text.read_genomic_mapping(spark, f"{path}/part-*")


@query("""WITH g AS (SELECT p_brand, CAST(p_size % 5 AS INT) AS n, string_agg(DISTINCT CAST(p_size AS VARCHAR), '/' ORDER BY CAST(p_size AS VARCHAR)) AS l FROM part GROUP BY 1, 2)
SELECT p_brand AS locus, unnest(string_split(l, '/')) AS allele, CASE WHEN n = 0 THEN l ELSE 'G' || n END AS g_group FROM g""")
def group_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").groupBy("p_brand", (F.col("p_size") % 5).alias("n")).agg(F.array_join(F.array_sort(F.collect_set(F.col("p_size").cast("string"))), "/").alias("l"))
    rows = p.select(F.concat_ws(";", F.concat("p_brand", F.lit("*")), "l", F.when(F.col("n") == 0, "").otherwise(F.concat(F.lit("G"), F.col("n").cast("string")))).alias("value"))
    return text.read_groups(spark, _put(rows, "groups"))


@query("SELECT 's' || s_suppkey AS allele, repeat('AC_', CAST(s_suppkey % 5 + 1 AS INT)) AS seq FROM supplier")
def short_alignment_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(" "), F.expr("repeat('AC_', cast(s_suppkey % 5 + 1 as int))")).alias("value"))
    head = spark.createDataFrame([(k - 4, f"n{k} {k}") for k in range(4)], "s_suppkey long, value string")
    return results.read_short_alignments(spark, f"{_put(head.unionByName(s), 'short', ['s_suppkey'])}/part-*")[1]


@query("""SELECT CASE WHEN o_orderstatus = 'F' THEN 's1' ELSE 's2' END AS sample, CAST(o_orderkey AS VARCHAR) AS id, o_totalprice / 1000000 AS p, -o_totalprice AS ll, CAST(o_custkey AS DOUBLE) AS mean_mismatches FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def sample_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of pairs of two samples, and a third that has none, collected."""
    folder, o = _path(spark, "results"), table(spark, sf_dir, "orders")
    rows = o.select("o_orderstatus", F.col("o_orderkey").cast("string").alias("id"), (F.col("o_totalprice") / 1000000).alias("p"), (-F.col("o_totalprice")).alias("ll"), F.col("o_custkey").cast("double").alias("mean_mismatches"))
    for sample, status in (("s1", "F"), ("s2", "O")):
        results.write_table(rows.where(F.col("o_orderstatus") == status), f"{folder}/{sample}/pairs", results.PAIRS, ["id"])
    return results.collect_samples(spark, ["s1", "s2", "s3"], f"{folder}/{{sample}}/pairs", results.PAIRS, "id string, p double, ll double, mean_mismatches double")[0]


@query("""WITH n AS (SELECT n_name, 'A*' || n_nationkey AS a, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE [n_nationkey || ':01', n_nationkey || ':02'] END AS q FROM nation)
SELECT n_name AS individual_id, 'A' AS locus, a AS alleles FROM n UNION ALL SELECT n_name, 'DQA1', array_to_string(q, '|') FROM n""")
def truth_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, key = _path(spark, "truth"), F.col("n_nationkey").cast("string")
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("IndividualID"), F.concat(F.lit("A*"), key).alias("HLAA"), F.when(F.col("n_nationkey") % 3 == 0, "?").otherwise(F.concat(key, F.lit(":01;"), key, F.lit(":02"))).alias("HLADQA"))
    text.write_tsv(n, path)
    return text.read_truth(spark, path).select("individual_id", "locus", F.array_join("alleles", "|").alias("alleles"))


@query("""SELECT 'h' || n_nationkey AS haplotype_id, CAST(i AS INT) AS level, CASE WHEN (n_nationkey + i) % 7 = 0 THEN '_' ELSE substr('ACGT', CAST((n_nationkey * i) % 4 + 1 AS INT), 1) END AS allele FROM nation, unnest(range(0, 90)) AS r(i)""")
def alignment_block_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as aligned sequences, in lines of sixty signs."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(89))).alias("i"))
    sign = F.when((F.col("n_nationkey") + F.col("i")) % 7 == 0, "-").otherwise(F.lower(_sign("ACGT", F.col("n_nationkey") * F.col("i"))))
    seq = n.groupBy("n_nationkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", sign.alias("c")))), lambda x: x["c"]), "").alias("seq"))
    path = _path(spark, "blocks")
    text.write_fasta(seq.select(F.concat(F.lit("h"), F.col("n_nationkey").cast("string")).alias("chrom"), "seq").coalesce(1), path)
    return results.read_alignment_blocks(spark, f"{path}/part-*")
