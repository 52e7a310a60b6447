"""Aligned reads: their text format, read names that carry an alignment, and records for other tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What begins a pair, and the lines of one read; the quality that stands for none.
PAIR, LINES, NO_QUALITY = "Aligned pair ", 9, 2.0


def read_insert_size(spark: SparkSession, path: str) -> DataFrame:
    """(mean, sd) from the first line of a file of aligned reads."""
    v = F.split("value", " ")
    return spark.read.text(path).where(F.col("value").startswith("IS ")).limit(1).select(F.get(v, 1).cast("double").alias("mean"), F.get(v, 2).cast("double").alias("sd"))


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """(pair, aln, mate, read_id, score, reverse, mapq, mapq_genomic, mapq_pos, g, s, levels, seq, qual) of a file of aligned reads.

    A pair's first line separates the records, so a file of any size is split
    over tasks. mapq_genomic is 2 where the file has none; mapq_pos has a sign
    for each column, or is null.
    """
    records = spark.read.option("lineSep", PAIR).text(path).where(~F.col("value").startswith("IS ") & (F.trim("value") != ""))
    line = F.transform(F.filter(F.split("value", "\r?\n"), lambda x: x != ""), lambda x: F.regexp_replace(x, "^\t+", ""))
    rows = records.select(line.alias("v")).select(F.get("v", 0).cast("long").alias("pair"), F.col("v"))
    count = F.floor((F.size("v") - 1) / LINES).cast("int")
    each = rows.select("pair", "v", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1))).alias("k"))
    at = lambda i: F.get("v", F.col("k") * LINES + 1 + i)
    name, quality = F.regexp_replace(at(0), "^Read ", ""), F.split(at(3), " ")
    return each.select(
        "pair",
        F.coalesce(F.when(name.rlike(r"A\d+$"), F.regexp_extract(name, r"A(\d+)$", 1).cast("int")), F.floor(F.col("k") / 2).cast("int")).alias("aln"),
        (F.col("k") % 2 + 1).alias("mate"),
        F.regexp_replace(name, r"A\d+$", "").alias("read_id"),
        at(1).cast("double").alias("score"),
        (at(2) == "1").alias("reverse"),
        F.get(quality, 0).cast("double").alias("mapq"),
        F.coalesce(F.get(quality, 1).cast("double"), F.lit(NO_QUALITY)).alias("mapq_genomic"),
        F.get(quality, 2).alias("mapq_pos"),
        at(4).alias("g"),
        at(5).alias("s"),
        F.transform(F.split(at(6), " "), lambda x: x.cast("int")).alias("levels"),
        at(7).alias("seq"),
        at(8).alias("qual"),
    )


def write_alignments(alignments: DataFrame, path: str, mean: float, sd: float) -> None:
    """A file of aligned reads, in order of pairs and their alignments."""
    number = lambda c: F.col(c).cast("string")
    quality = F.concat_ws(" ", number("mapq"), number("mapq_genomic"), F.coalesce("mapq_pos", F.lit("")))
    body = [quality, F.col("g"), F.col("s"), F.array_join(F.transform("levels", lambda x: x.cast("string")), " "), F.col("seq"), F.col("qual")]
    block = F.concat_ws("\n\t\t", F.concat(F.lit("\tRead "), F.col("read_id"), F.lit("A"), number("aln")), number("score"), F.col("reverse").cast("int").cast("string"), *body)
    pairs = alignments.groupBy("pair").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("aln", "mate", block.alias("text")))), lambda x: x["text"]), "\n").alias("text"))
    rows = pairs.select("pair", F.concat(F.lit(PAIR), number("pair"), F.lit("\n"), F.col("text")).alias("value"))
    head = alignments.sparkSession.range(1).select(F.lit(-1).cast("long").alias("pair"), F.lit(f"IS {mean} {sd}").alias("value"))
    head.unionByName(rows).orderBy("pair").select("value").write.mode("overwrite").text(path)


def _place(ll: str, chrom: str, a: str, b: str) -> Column:
    return F.when(F.col(ll).isNull(), "NA").otherwise(F.concat(F.col(ll).cast("string"), F.lit("["), F.col(chrom), F.lit(":"), F.col(a).cast("string"), F.lit("-"), F.col(b).cast("string"), F.lit("]")))


def alignment_name() -> Column:
    """normalAlignment=place;place;strands;distance from the columns ll, chrom, start, end and reverse of both mates, numbered 1 and 2.

    A mate without a likelihood is NA. Strands are in order where the mates lie
    on one chromosome, on different strands, the forward one first; the
    distance is from its end to the other's start.
    """
    c = F.col
    placed = c("chrom1").isNotNull() & c("chrom2").isNotNull()
    opposite = (c("chrom1") == c("chrom2")) & (c("reverse1") != c("reverse2"))
    first, second = opposite & ~c("reverse1") & (c("start1") < c("start2")), opposite & c("reverse1") & (c("end1") > c("end2"))
    strands = F.when(placed, F.when(first | second, "1").otherwise("0")).otherwise("NA")
    distance = F.when(placed & first, c("start2") - c("end1")).when(placed & second, c("start1") - c("end2"))
    return F.concat(F.lit("normalAlignment="), F.concat_ws(";", _place("ll1", "chrom1", "start1", "end1"), _place("ll2", "chrom2", "start2", "end2"), strands, F.coalesce(distance.cast("string"), F.lit("NA"))))


def parsed_name(name: Column) -> Column:
    """A struct (ll, chrom, start, end of both mates; strands_ok, distance) of a read's name; null where it holds no alignment, fields null where NA."""
    text = F.regexp_extract(name, r"normalAlignment=([^/\s]*)", 1)
    part = F.split(text, ";")
    number = lambda x, kind: F.when(~x.isin("", "NA"), x).cast(kind)

    def place(i: int) -> list[Column]:
        x = F.get(part, i - 1)
        of = lambda k: F.regexp_extract(x, r"^([^\[]+)\[([^:]+):(-?\d+)-(-?\d+)\]$", k)
        return [number(of(1), "double").alias(f"ll{i}"), number(of(2), "string").alias(f"chrom{i}"), number(of(3), "int").alias(f"start{i}"), number(of(4), "int").alias(f"end{i}")]

    return F.when(F.size(part) == 4, F.struct(*place(1), *place(2), (number(F.get(part, 2), "int") == 1).alias("strands_ok"), number(F.get(part, 3), "int").alias("distance")))


def cigars(alignments: DataFrame, mapping: DataFrame | None = None, by: str = "read_id", gap: str = "_") -> DataFrame:
    """(by, pos, end, cigar) of alignments (by, g, s, levels) against the reference.

    ``mapping`` (level, pos) has the reference position of graph levels; without
    it levels are positions. A column at a position is a match or, with a gap in
    the read, a deletion, as are positions that the path jumps over; a read's
    sign elsewhere is an insertion, clipped before the first and after the last
    match. Reads without a match are left out.
    """
    cols = alignments.select(by, F.posexplode(F.arrays_zip(F.split("g", "").alias("g"), F.split("s", "").alias("s"), F.col("levels").alias("level"))).alias("i", "x"))
    cols = cols.select(by, "i", F.col("x.level").alias("level"), F.col("x.g").alias("g"), F.col("x.s").alias("s"))
    if mapping is None:
        cols = cols.withColumn("ref", F.when((F.col("level") >= 0) & (F.col("g") != gap), F.col("level")))
    else:
        cols = cols.join(mapping.select("level", F.col("pos").alias("ref")), "level", "left")
    rows = cols.where(F.col("ref").isNotNull() | (F.col("s") != gap))
    rows = rows.withColumn("op", F.when(F.col("ref").isNull(), "I").when(F.col("s") == gap, "D").otherwise("M"))
    w, whole = W.partitionBy(by).orderBy("i"), W.partitionBy(by)
    match = F.when(F.col("op") == "M", F.col("i"))
    rows = rows.withColumn("_first", F.min(match).over(whole)).withColumn("_last", F.max(match).over(whole)).withColumn("_before", F.last("ref", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    inside = F.col("i").between(F.col("_first"), F.col("_last"))
    rows = rows.where(F.col("_first").isNotNull() & (inside | (F.col("op") == "I"))).withColumn("op", F.when(inside, F.col("op")).otherwise("S"))
    jump = F.when((F.col("i") > F.col("_first")) & (F.col("ref") > F.col("_before") + 1), F.col("ref") - F.col("_before") - 1).otherwise(0)
    steps = rows.select(by, "i", "ref", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("D").alias("op"), jump.alias("n")), F.struct(F.lit(1).alias("k"), F.col("op").alias("op"), F.lit(1).alias("n")))).alias("x"))
    steps = steps.select(by, "i", "ref", "x.*").where("n > 0")
    order = W.partitionBy(by).orderBy("i", "k")
    run = F.sum(F.when(F.col("op") == F.lag("op").over(order), 0).otherwise(1)).over(order)
    runs = steps.withColumn("run", run).groupBy(by, "run", "op").agg(F.sum("n").alias("n"), F.min(F.when(F.col("op") == "M", F.col("ref"))).alias("a"), F.max(F.when(F.col("op") == "M", F.col("ref"))).alias("b"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", "n", "op"))), lambda p: F.concat(p["n"].cast("string"), p["op"])), "")
    return runs.groupBy(by).agg(F.min("a").alias("pos"), F.max("b").alias("end"), text.alias("cigar"))


def write_sam(alignments: DataFrame, path: str, mapping: DataFrame | None = None) -> None:
    """Records of alignments (read_id, flag, chrom, g, s, levels, mapq, qual), their places and CIGAR strings by ``cigars``."""
    row = alignments.join(cigars(alignments, mapping), "read_id")
    text = lambda c: F.col(c).cast("string")
    row.select(F.concat_ws("\t", "read_id", text("flag"), "chrom", text("pos"), text("mapq"), "cigar", F.lit("*"), F.lit("0"), (F.col("end") - F.col("pos") + 1).cast("string"), F.translate("s", "_", ""), "qual").alias("value")).write.mode("overwrite").text(path)
