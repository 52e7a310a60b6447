"""Tables that typing leaves behind, and the small files that it starts from."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.sources.text import lines, read_matrix

# Names of the columns of the tables, in order.
BEST_GUESS = {"locus": "Locus", "chromosome": "Chromosome", "allele": "Allele", "q1": "Q1", "q2": "Q2", "avg_cov": "AverageCoverage", "cov_decile1": "CoverageFirstDecile", "min_cov": "MinimumCoverage", "prop_kmers": "proportionkMersCovered", "avg_col_error": "LocusAvgColumnError", "n_unaccounted": "NColumns_UnaccountedAllele_fGT0.2"}
PAIRS = {"id": "ClusterID", "p": "P", "ll": "LL", "mean_mismatches": "Mismatches_avg"}
COLUMN_ERRORS = {"column": "Column", "coverage": "Coverage", "expected": "ExpectedIncompatible", "observed": "ObservedIncompatible", "p": "p"}
SIMILAR = {"locus": "Locus", "six_digits_only": "6DigitOnly", "haplotype": "Haplotype", "alternative": "Alternative", "reference_id": "ReferenceAllele", "distance": "AbsoluteDifferences", "share": "RelativeDifference"}
QUALITIES = "readLength int, qualityScore int, positionInRead int, N double, ExpectedCorrect double, EmpiricalCorrect double"


def write_table(df: DataFrame, path: str, names: dict[str, str], order: list[str], more: dict[str, str] | None = None) -> None:
    """A tab-separated table with a header line, its columns named by ``names`` and in order of rows."""
    names = names | (more or {})
    df.orderBy(*order).select(*[F.col(c).alias(n) for c, n in names.items()]).coalesce(1).write.mode("overwrite").option("emptyValue", "").csv(path, sep="\t", header=True)


def read_table(spark: SparkSession, path: str, names: dict[str, str], schema: str) -> DataFrame:
    """The table with its own names again, typed by ``schema``."""
    df = spark.read.csv(path, sep="\t", header=True)
    kinds = dict(part.rsplit(" ", 1) for part in schema.split(", "))
    return df.select(*[F.col(f"`{n}`").cast(kinds[c]).alias(c) for c, n in names.items() if n in df.columns])


def pair_rows(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(locus, id, p, ll, mean_mismatches): pairs of clusters with their members, a;b/c, as the table of pairs has them."""
    members = clusters.groupBy("locus", "cluster").agg(F.array_join(F.sort_array(F.collect_list("allele")), ";").alias("m"))
    one = lambda k: members.select("locus", F.col("cluster").alias(f"c{k}"), F.col("m").alias(f"m{k}"))
    return pairs.join(one(1), ["locus", "c1"]).join(one(2), ["locus", "c2"]).select("locus", F.concat_ws("/", "m1", "m2").alias("id"), "p", "ll", "mean_mismatches")


def pileup_rows(observations: DataFrame, places: DataFrame) -> DataFrame:
    """(locus, exon_ord, exon_pos, n, genotypes) of observations (locus, exon_ord, exon_pos, read, genotype, quality, mapq_position): genotypes as G (codes) [position quality | read], uncovered places with none."""
    codes = F.array_join(F.transform(F.split("quality", ""), lambda x: F.ascii(x).cast("string")), ", ")
    one = F.concat("genotype", F.lit(" ("), codes, F.lit(") ["), F.col("mapq_position").cast("string"), F.lit(" | "), F.col("read").cast("string"), F.lit("]"))
    lists = observations.groupBy("locus", "exon_ord", "exon_pos").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("read", one.alias("t")))), lambda x: x["t"]), ", ").alias("genotypes"))
    return places.join(lists, ["locus", "exon_ord", "exon_pos"], "left").select("locus", "exon_ord", "exon_pos", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("genotypes", F.lit("")).alias("genotypes"))


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One value a line, each once and in order: read names, say."""
    df.select(F.col(column).cast("string").alias("value")).distinct().orderBy("value").coalesce(1).write.mode("overwrite").text(path)


def write_parameters(spark: SparkSession, values: dict[str, object], path: str) -> None:
    """Lines name = value."""
    spark.createDataFrame([(f"{k} = {v}",) for k, v in values.items()], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of lines name = value."""
    return spark.read.text(path).where(F.col("value").contains(" = ")).select(F.substring_index("value", " = ", 1).alias("name"), F.expr("substring(value, instr(value, ' = ') + 3)").alias("value"))


def collect_samples(spark: SparkSession, samples: list[str], pattern: str, names: dict[str, str], schema: str) -> tuple[DataFrame, DataFrame]:
    """Tables of many samples as one with a column sample, and (sample, found) for each of them.

    ``pattern`` has {sample} where a sample's name goes; one without a table is
    told as not found and is no error.
    """
    context = spark.sparkContext
    paths = {s: pattern.replace("{sample}", s) for s in samples}
    hadoop = {s: context._jvm.org.apache.hadoop.fs.Path(p) for s, p in paths.items()}
    found = {s: p.getFileSystem(context._jsc.hadoopConfiguration()).exists(p) for s, p in hadoop.items()}
    state = spark.createDataFrame([(s, found[s]) for s in samples], "sample string, found boolean")
    out = None
    for s in (s for s in samples if found[s]):
        part = read_table(spark, paths[s], names, schema).withColumn("sample", F.lit(s))
        out = part if out is None else out.unionByName(part)
    return (spark.createDataFrame([], f"{schema}, sample string") if out is None else out), state


def read_exons(spark: SparkSession, path: str) -> DataFrame:
    """(locus, exon, allele, locus_id, exon_pos, base) of exon files named locus_n_exon_k, whose lines are alleles."""
    name = F.regexp_extract("file", r"([^/]+?)(?:\.txt)?(?:/part-[^/]*)?$", 1)
    cells = read_matrix(spark, path).withColumn("_n", name)
    return cells.select(F.regexp_extract("_n", r"^([^_]+)_", 1).alias("locus"), F.regexp_extract("_n", r"(exon_\d+)", 1).alias("exon"), F.col("row_id").alias("allele"), "locus_id", F.col("level").alias("exon_pos"), F.col("value").alias("base"))


def read_quality_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Empirical base qualities in their six columns; another header is an error."""
    want = [part.split(" ")[0] for part in QUALITIES.split(", ")]
    have = spark.read.csv(path, sep="\t", header=True).columns
    if have != want:
        raise ValueError(f"columns {have}, not {want}")
    return spark.read.csv(path, sep="\t", header=True, schema=QUALITIES)


def read_short_alignments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The four numbers (name, number) at the head of a file of aligned alleles, and its (allele, seq)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for content in p["content"]:
                rows = [(k, line.split()) for k, line in enumerate(bytes(content).decode().split("\n")) if line.strip()]
                if any(len(v) != 2 for _, v in rows):
                    raise ValueError("not two fields in a line")
                yield pd.DataFrame([(k < 4, *v) for k, v in rows], columns=["head", "name", "value"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "head boolean, name string, value string")
    return rows.where("head").select("name", F.col("value").cast("int").alias("number")), rows.where("NOT head").select(F.col("name").alias("allele"), F.col("value").alias("seq"))


def read_chromotypes(spark: SparkSession, path: str) -> DataFrame:
    """(hap, level, symbol) of a file with a line for each of two haplotypes: two fields, then a symbol for each level; other numbers of lines, or lines that differ in length, are an error."""
    rows = lines(spark, path).where(F.trim("value") != "").select(F.split(F.trim("value"), " ").alias("v"))
    rows = rows.select(F.get("v", 0).alias("name"), F.slice("v", F.lit(3), F.size("v")).alias("s"))
    sound = rows.agg(((F.count("*") == 2) & (F.min(F.size("s")) == F.max(F.size("s")))).alias("_ok"))  # one row
    checked = rows.join(F.broadcast(sound)).where(F.when(F.col("_ok"), True).otherwise(F.raise_error(F.lit("not two lines of one length"))))
    return checked.select(F.col("name").alias("hap"), F.posexplode("s").alias("level", "symbol"))


def write_chromotypes(haplotypes: DataFrame, path: str, individual: str = "sample") -> None:
    """A file of chromotypes from (hap, level, symbol)."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("level", "symbol"))), lambda x: x["symbol"]), " ")
    haplotypes.groupBy("hap").agg(text.alias("t")).orderBy("hap").select(F.concat_ws(" ", F.col("hap").cast("string"), F.lit(individual), "t").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_alignment_blocks(spark: SparkSession, path: str, name_pattern: str = r"^(\S+)", gap: str = "_") -> DataFrame:
    """(haplotype_id, level, allele) of an alignment in blocks: as FASTA with equally long sequences, or as lines of a name and a piece that come again in each block.

    Points and hyphens are gaps, bases are capital; a file is read in order, so
    it goes to one task. Sequences of different lengths are an error.
    """
    import re

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for content in p["content"]:
                found: dict[str, list[str]] = {}
                rows = bytes(content).decode().split("\n")
                fasta, name = any(r.startswith(">") for r in rows), None
                for r in rows:
                    if fasta and r.startswith(">"):
                        m = re.search(name_pattern, r[1:])
                        name = m[1] if m else r[1:].strip()
                        found[name] = []
                    elif fasta and name is not None:
                        found[name].append(r.strip())
                    elif m := re.match(r"(\S+)\s+([A-Za-z._*-]+)(?:\s+\d+)?\s*$", r):
                        found.setdefault(m[1], []).append(m[2])
                text = {k: re.sub("[.-]", gap, "".join(v)).upper() for k, v in found.items()}
                if len({len(s) for s in text.values()}) > 1:
                    raise ValueError("sequences of different lengths")
                yield pd.DataFrame([(k, i, c) for k, s in text.items() for i, c in enumerate(s)], columns=["haplotype_id", "level", "allele"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "haplotype_id string, level int, allele string")
