"""Readers and writers of the text formats; every reader gives a long table."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Signs of a missing allele; sections of a graph file and the separator of its fields; sentinel rows of a count file.
MISSING = ("?", "????")
SECTIONS, SEPARATOR = ("CODE:", "NODES:", "EDGES:"), "|||"
SENTINELS = {"MeanReadLen": "mean_read_len", "TotalKMerCoverage": "total_kmer_cov", "TotalSeq": "total_seq"}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of a text file's lines."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), "value")


def _known(c: Column) -> Column:
    return F.when(~c.isin(*MISSING), c)


def read_matrix(spark: SparkSession, path: str, fixed: tuple[str, ...] = ("IndividualID",), optional: tuple[str, ...] = ("Chromosome",)) -> DataFrame:
    """(row_id, columns kept, locus_id, level, value) of a space-separated matrix whose first line names the loci."""
    rows = lines(spark, path).select("file", F.split(F.trim("value"), r"\s+").alias("v")).where(F.size("v") > 1)
    names = rows.where(F.get("v", 0).isin(*fixed)).select("file", F.col("v").alias("names"))
    body = rows.where(~F.get("v", 0).isin(*fixed)).join(F.broadcast(names), "file")  # a header for each file
    skip = F.when(F.get("names", 1).isin(*optional), 2).otherwise(1)
    width = F.assert_true(F.size("v") == F.size("names"), F.concat(F.lit("width of a row in "), F.col("file")))
    cells = body.select("file", F.get("v", 0).alias("row_id"), F.when(F.get("names", 1).isin(*optional), F.get("v", 1)).alias("chromosome"), skip.alias("_skip"), F.coalesce(width.cast("string"), F.lit("")).alias("_ok"), F.posexplode(F.arrays_zip(F.col("names").alias("l"), F.col("v").alias("x"))).alias("_i", "c"))
    return cells.where(F.col("_i") >= F.col("_skip")).where("_ok = ''").select("file", "row_id", "chromosome", F.col("c.l").alias("locus_id"), (F.col("_i") - F.col("_skip")).cast("int").alias("level"), F.col("c.x").alias("value"))


def read_haplotypes(spark: SparkSession, path: str) -> DataFrame:
    """(haplotype_id, chromosome, locus_id, level, allele); missing alleles are null."""
    return read_matrix(spark, path).select(F.col("row_id").alias("haplotype_id"), "chromosome", "locus_id", "level", _known(F.col("value")).alias("allele"))


def read_genotypes(spark: SparkSession, path: str) -> DataFrame:
    """(individual_id, locus_id, a1, a2), the alleles in order."""
    pair = F.array_sort(F.split("value", "/"))
    return read_matrix(spark, path).select(F.col("row_id").alias("individual_id"), "locus_id", _known(F.get(pair, 0)).alias("a1"), _known(F.get(pair, 1)).alias("a2"))


def write_matrix(df: DataFrame, path: str, row: str, column: str, order: str, value: str) -> None:
    """A matrix file of a long table: one line for each row, one field for each column, by the columns' order."""
    names = [r[column] for r in df.select(column, order).distinct().orderBy(order).collect()]
    cells = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, F.coalesce(value, F.lit("?")).alias("v")))), lambda x: x["v"]), " ")
    body = df.groupBy(row).agg(cells.alias("c")).select(F.lit(1).alias("k"), F.concat_ws(" ", row, "c").alias("value"))
    head = df.sparkSession.range(1).select(F.lit(0).alias("k"), F.lit(" ".join(["IndividualID", *names])).alias("value"))
    head.unionByName(body).orderBy("k", "value").select("value").coalesce(1).write.mode("overwrite").text(path)


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """(locus_id, pos, strand)."""
    v = F.split(F.trim("value"), r"\s+")
    return lines(spark, path).select(v.alias("v")).where(F.size("v").isin(2, 3)).select(F.get("v", 0).alias("locus_id"), F.get("v", 1).cast("int").alias("pos"), F.get("v", 2).alias("strand"))


def read_segments(spark: SparkSession, folder: str, listing: str = "segments.txt") -> DataFrame:
    """Panels (segment, seg_ord, haplotype_id, locus_id, level, allele) of the files that a listing names, in its order."""
    names = [r.value.strip() for r in spark.read.text(f"{folder}/{listing}").collect() if r.value.strip()]
    out = None
    for k, name in enumerate(names):
        part = read_haplotypes(spark, f"{folder}/{name}").select(F.lit(name).alias("segment"), F.lit(k).alias("seg_ord"), "haplotype_id", "locus_id", "level", "allele")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError(f"{folder}/{listing} names no file")
    return out


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, level, terminal) and edges (edge_id, locus_id, count, symbol_code, from_id, to_id) of graph files in sections.

    A file is read in splits, as any text. A line's section is that of the last
    header before it, by the place of its split and its own place inside; what
    is sent is a file's headers.
    """
    bare = F.regexp_replace("value", r"^\s+|\s+$", "")
    # ids rise inside a split, and a split lies in one task
    at = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("_file"), at.alias("_at"), "value", bare.alias("_bare"))
    heads = rows.where(F.col("_bare").isin(*SECTIONS)).groupBy("_file").agg(F.collect_list(F.struct("_at", "_bare")).alias("_heads"))
    lines_ = rows.where((F.col("_bare") != "") & ~F.col("_bare").isin(*SECTIONS)).join(F.broadcast(heads), "_file")  # a row for each file
    section = F.array_max(F.filter("_heads", lambda h: h["_at"] < F.col("_at")))["_bare"]
    rows = lines_.select(section.alias("section"), F.split(F.regexp_replace("value", r"\r+$", ""), re.escape(SEPARATOR)).alias("fields"))
    f = lambda i: F.get("fields", i)
    nodes = rows.where(F.col("section") == "NODES:").select(f(0).cast("long").alias("node_id"), f(1).cast("int").alias("level"), (f(2) == "1").alias("terminal"))
    edges = rows.where(F.col("section") == "EDGES:").select(f(0).cast("long").alias("edge_id"), f(1).alias("locus_id"), f(2).cast("double").alias("count"), f(3).alias("symbol_code"), f(4).cast("long").alias("from_id"), f(5).cast("long").alias("to_id"))
    return nodes, edges


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph file of nodes (node_id, level, terminal) and edges (edge_id, locus_id, count, symbol_code, from_id, to_id)."""
    head = lambda k, name: nodes.sparkSession.range(1).select(F.lit(k).alias("k"), F.lit(0).cast("long").alias("i"), F.lit(name).alias("value"))
    n = nodes.select(F.lit(1).alias("k"), F.col("node_id").alias("i"), F.concat_ws(SEPARATOR, "node_id", "level", F.col("terminal").cast("int")).alias("value"))
    e = edges.select(F.lit(3).alias("k"), F.col("edge_id").alias("i"), F.concat_ws(SEPARATOR, "edge_id", "locus_id", "count", "symbol_code", "from_id", "to_id").alias("value"))
    out = head(0, "NODES:").unionByName(n).unionByName(head(2, "EDGES:")).unionByName(e)
    out.orderBy("k", "i").select("value").coalesce(1).write.mode("overwrite").text(path)


def read_kmers(spark: SparkSession, path: str, k: int) -> DataFrame:
    """(kmer) of a list with one a line; another width is an error."""
    kmer = F.trim("value")
    checked = F.when(F.length(kmer) == k, kmer).otherwise(F.raise_error(F.concat(F.lit(f"not {k} characters: "), kmer)))
    return spark.read.text(path).where(kmer != "").select(checked.alias("kmer"))


def read_counts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """K-mer counts (kmer, n, is_repeat; -1 marks a repeat) and the one row of totals that stands among them."""
    v = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.get(v, 0).alias("kmer"), F.get(v, 1).cast("long").alias("n")).where("n IS NOT NULL")
    counts = rows.where(~F.col("kmer").isin(*SENTINELS)).select("kmer", F.greatest("n", F.lit(0)).alias("n"), (F.col("n") == -1).alias("is_repeat"))
    return counts, rows.agg(*[F.max(F.when(F.col("kmer") == name, F.col("n"))).alias(c) for name, c in SENTINELS.items()])


def read_fasta(spark: SparkSession, path: str, whole_header: bool = False) -> DataFrame:
    """(chrom, seq); the name is the header's first word, or all of it."""
    rows = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    return rows.select((head if whole_header else F.regexp_extract("value", r"^(\S*)", 1)).alias("chrom"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s+", "").alias("seq"))


def write_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    wrapped = F.rtrim(F.regexp_replace("seq", f"(.{{1,{width}}})", "$1\n"))
    df.select(F.concat(F.lit(">"), F.col("chrom"), F.lit("\n"), F.regexp_replace(wrapped, r"\n$", "")).alias("value")).write.mode("overwrite").text(path)


def read_fastq(spark: SparkSession, path: str, mate: int | None = None) -> DataFrame:
    """(read_id, mate, seq, qual) of records of four lines; /1 and /2 go from the names.

    Lines belong together by fours from the start, so a file goes to one task;
    large samples come as many files.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for content in p["content"]:
                rows = [line.rstrip("\r") for line in bytes(content).decode().split("\n")]
                found = [(rows[i][1:].split()[0], rows[i + 1], rows[i + 3]) for i in range(0, len(rows) - 3, 4) if rows[i].startswith("@")]
                yield pd.DataFrame(found, columns=["name", "seq", "qual"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "name string, seq string, qual string")
    own = F.regexp_extract("name", r"/([12])$", 1)
    return rows.select(F.regexp_replace("name", r"/[12]$", "").alias("read_id"), (F.lit(mate) if mate else F.when(own != "", own.cast("int"))).cast("tinyint").alias("mate"), "seq", "qual")


def write_fastq(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\n", F.concat(F.lit("@"), F.col("read_id"), F.coalesce(F.concat(F.lit("/"), F.col("mate").cast("string")), F.lit(""))), "seq", F.lit("+"), "qual").alias("value")).write.mode("overwrite").text(path)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment records; names of chromosomes lose a leading chr."""
    v = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@")).where(F.size(v) >= 11)
    names = (("read_id", "string"), ("flag", "int"), ("chrom", "string"), ("pos", "int"), ("mapq", "int"), ("cigar", "string"), ("mate_chrom", "string"), ("mate_pos", "int"), ("insert_size", "int"), ("seq", "string"), ("qual", "string"))
    return rows.select(*[F.get(v, i).cast(t).alias(n) for i, (n, t) in enumerate(names)]).withColumn("chrom", F.regexp_replace("chrom", "^chr", ""))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, id, ref, alt array, filter, gt array, a1, a2) of the first sample; both phased and unphased genotypes."""
    v = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).where(F.size(v) >= 8).select(v.alias("v"))
    field = F.array_position(F.split(F.get("v", 8), ":"), "GT")
    gt = F.when(field > 0, F.get(F.split(F.get("v", 9), ":"), (field - 1).cast("int")))
    out = rows.select(F.regexp_replace(F.get("v", 0), "^chr", "").alias("chrom"), F.get("v", 1).cast("int").alias("pos"), F.get("v", 2).alias("id"), F.get("v", 3).alias("ref"), F.split(F.get("v", 4), ",").alias("alt"), F.get("v", 6).alias("filter"), F.transform(F.split(gt, r"[/|]"), lambda x: x.try_cast("int")).alias("gt"))
    allele = lambda i: F.when(F.get("gt", i) == 0, F.col("ref")).otherwise(F.get("alt", F.get("gt", i) - 1))
    return out.withColumn("a1", allele(0)).withColumn("a2", F.coalesce(allele(1), allele(0)))


def write_vcf(df: DataFrame, path: str, sample: str = "SAMPLE") -> None:
    """Records (chrom, pos, ref, a1, a2, filter) with their genotype; alleles other than the reference are numbered in order."""
    alts = F.array_distinct(F.filter(F.array("a1", "a2"), lambda x: x != F.col("ref")))
    number = lambda c: F.when(F.col(c) == F.col("ref"), F.lit(0)).otherwise(F.array_position("_alts", F.col(c))).cast("string")
    rows = df.withColumn("_alts", alts).select("chrom", "pos", F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", F.when(F.size("_alts") > 0, F.array_join("_alts", ",")).otherwise("."), F.lit("."), "filter", F.lit("."), F.lit("GT"), F.concat_ws("/", number("a1"), number("a2"))).alias("value"))
    head = df.sparkSession.createDataFrame([("", -2, "##fileformat=VCFv4.2"), ("", -1, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample]))], "chrom string, pos int, value string")
    head.unionByName(rows.withColumn("pos", F.col("pos").cast("int"))).orderBy("chrom", "pos").select("value").coalesce(1).write.mode("overwrite").text(path)


def read_genome_string(spark: SparkSession, path: str) -> DataFrame:
    """(seg_ord, a1, a2) of a file with a segment a line, its alleles joined by a comma."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for content in p["content"]:
                rows = [x.strip().split(",") for x in bytes(content).decode().split("\n") if x.strip()]
                yield pd.DataFrame([(i, x[0], x[1] if len(x) > 1 else None) for i, x in enumerate(rows)], columns=["seg_ord", "a1", "a2"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "seg_ord int, a1 string, a2 string")


def read_genomic_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(level, region, pos) of a file with a level a line, its places joined by commas."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for content in p["content"]:
                found = [(i, *place.rsplit(":", 1)) for i, line in enumerate(bytes(content).decode().split("\n")) for place in line.strip().split(",") if ":" in place]
                yield pd.DataFrame([(i, r, int(x)) for i, r, x in found], columns=["level", "region", "pos"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "level int, region string, pos int")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(locus, allele, g_group) of lines locus*;a/b/c;group; without a group the alleles' own text is it."""
    v = F.split("value", ";")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).where(F.size(v) >= 2)
    group = F.coalesce(F.when(F.trim(F.get(v, 2)) != "", F.trim(F.get(v, 2))), F.get(v, 1))
    return rows.select(F.regexp_replace(F.get(v, 0), r"\*$", "").alias("locus"), F.explode(F.split(F.get(v, 1), "/")).alias("allele"), group.alias("g_group"))


def read_tsv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Tables with a header line: quality matrices, truth, results of many samples (a glob), with the file they came from."""
    return spark.read.csv(path, sep="\t", header=header).withColumn("file", F.input_file_name())


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(individual_id, locus, alleles array) of a table with a column for each locus; old names of two loci are brought up to date, ? is missing, ; separates alternatives."""
    df = spark.read.csv(path, sep="\t", header=True)
    loci = [c for c in df.columns if c != "IndividualID"]
    out = df.unpivot(["IndividualID"], loci, "locus", "_v").withColumn("locus", F.regexp_replace(F.regexp_replace("locus", "^HLA", ""), "^(DQA|DPA|DQB|DPB|DRB)$", "$11"))
    return out.select(F.col("IndividualID").alias("individual_id"), "locus", F.when(F.col("_v") != "?", F.split("_v", ";")).alias("alleles"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)
