"""Queries of reads, records, genome strings and graphs that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.functions import sequences as sq
from strandlake.operators import aggregates as ag
from strandlake.operators import align, graph, hmm, simulate, validate, variants
from strandlake.operators import filters as fl
from strandlake.operators import joins as jn
from strandlake.operators import typing as ty
from strandlake.operators import windows as wn
from strandlake.plans import sequence_queries as sqs
from strandlake.plans.tables import dna, dna_sql, kmers_sql, revcomp_sql, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _sign(letters: str, number: Column) -> Column:
    return F.substr(F.lit(letters), (number % len(letters) + 1).cast("int"), F.lit(1))


def _sign_sql(letters: str, number: str) -> str:
    return f"substr('{letters}', CAST(({number}) % {len(letters)} + 1 AS INT), 1)"


# --- filters of reads


@query(f"""
WITH {sqs._READS}, {sqs._BENCH}, known AS (SELECT DISTINCT kmer FROM ({kmers_sql("bench", "item_id", "seq", 8)}) x WHERE item_id % 4 = 0),
uniq AS (SELECT kmer FROM ({kmers_sql("bench", "item_id", "seq", 8)}) x GROUP BY kmer HAVING count(*) = 1),
sides AS (SELECT read_id, 'f1' AS side, seq1 AS seq FROM pairs UNION ALL SELECT read_id, 'f2', {revcomp_sql("seq2")} FROM pairs UNION ALL SELECT read_id, 'r1', {revcomp_sql("seq1")} FROM pairs UNION ALL SELECT read_id, 'r2', seq2 FROM pairs),
k AS ({kmers_sql("sides", "read_id, side", "seq", 8)}), f AS (SELECT read_id, side, count(known.kmer) / count(*) AS f, count(uniq.kmer) AS u FROM k LEFT JOIN known ON k.kmer = known.kmer LEFT JOIN uniq ON k.kmer = uniq.kmer GROUP BY read_id, side),
w AS (SELECT p.read_id, max(CASE WHEN side = 'f1' THEN f END) AS f1, max(CASE WHEN side = 'f2' THEN f END) AS f2, max(CASE WHEN side = 'r1' THEN f END) AS r1, max(CASE WHEN side = 'r2' THEN f END) AS r2, sum(CASE WHEN side LIKE 'f%' THEN u END) AS fu, sum(CASE WHEN side LIKE 'r%' THEN u END) AS ru FROM pairs p LEFT JOIN f ON p.read_id = f.read_id GROUP BY p.read_id)
SELECT read_id, round(coalesce(f1, 0.0), 9) AS f1, round(coalesce(r2, 0.0), 9) AS r2, coalesce(greatest(f1, f2, r1, r2), 0) >= 0.4 OR coalesce(fu, 0) >= 3 OR coalesce(ru, 0) >= 3 AS passed FROM w""")
def unique_rescue_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positive filter for long reads, in which unique k-mers let a pair pass too."""
    bench = sqs._bench(spark, sf_dir)
    every = bench.select("item_id", F.explode(sq.kmers(F.col("seq"), 8)).alias("kmer"))
    uniq = every.groupBy("kmer").count().where("count = 1").select("kmer")
    pairs = jn.mate_pairs(sqs._pairs(spark, sf_dir), ["read_id"], "mate", ["seq"])
    out = fl.positive_filter(pairs, every.where("item_id % 4 = 0").select("kmer").distinct(), 8, 0.4, any_mate=True, unique=uniq, least_unique=3)
    return out.select("read_id", F.round("f1", 9).alias("f1"), F.round("r2", 9).alias("r2"), "passed")


@query(f"""
WITH {sqs._READS}, {sqs._BENCH}, c AS (SELECT item_id, least(kmer, {revcomp_sql("kmer")}) AS kmer FROM ({kmers_sql("bench", "item_id", "seq", 8)}) x), bg AS (SELECT DISTINCT kmer FROM c), re AS (SELECT DISTINCT kmer FROM c WHERE item_id % 9 = 0),
k AS (SELECT read_id, mate, least(kmer, {revcomp_sql("kmer")}) AS kmer FROM ({kmers_sql("reads", "read_id, mate", "seq", 8)}) x),
f AS (SELECT read_id, mate, count(bg.kmer) / count(*) AS f, count(re.kmer) AS u FROM k LEFT JOIN bg ON k.kmer = bg.kmer LEFT JOIN re ON k.kmer = re.kmer GROUP BY read_id, mate),
w AS (SELECT r.read_id, coalesce(max(CASE WHEN r.mate = 1 THEN f END), 1.0) AS n1, coalesce(max(CASE WHEN r.mate = 2 THEN f END), 1.0) AS n2, sum(coalesce(u, 0)) AS u FROM reads r LEFT JOIN f ON r.read_id = f.read_id AND r.mate = f.mate GROUP BY r.read_id)
SELECT read_id, round(n1, 9) AS n1, round(n2, 9) AS n2, n1 <= 0.2 OR n2 <= 0.2 OR u >= 1 AS passed FROM w""")
def background_rescue_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = sqs._bench(spark, sf_dir)
    background, rescue = fl.kmer_set(bench, "seq", 8, canonical=True), fl.kmer_set(bench.where("item_id % 9 = 0"), "seq", 8, canonical=True)
    out = fl.negative_filter(sqs._pairs(spark, sf_dir), background, 8, 0.2, rescue)
    return out.select("read_id", F.round("n1", 9).alias("n1"), F.round("n2", 9).alias("n2"), "passed")


_PAIR = """p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand1, CASE WHEN o_orderkey % 3 = 0 THEN '+' ELSE '-' END AS strand2, o_custkey AS start1, o_custkey + 100 AS end1, o_custkey + o_orderkey % 700 - 200 AS start2, o_custkey + o_orderkey % 700 - 100 AS end2 FROM orders)"""


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, at = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(key, F.when(key % 2 == 0, "+").otherwise("-").alias("strand1"), F.when(key % 3 == 0, "+").otherwise("-").alias("strand2"), at.alias("start1"), (at + 100).alias("end1"), (at + key % 700 - 200).alias("start2"), (at + key % 700 - 100).alias("end2"))


@query(f"""WITH {_PAIR}, d AS (SELECT *, CASE WHEN strand1 = '+' THEN start2 - end1 ELSE start1 - end2 END AS distance FROM p) SELECT o_orderkey, distance FROM d WHERE strand1 <> strand2 AND abs(distance - 120) <= 150 AND distance > -100""")
def sane_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.sane_pairs(_aligned(spark, sf_dir), F.lit(120), F.lit(30)).select("o_orderkey", "distance")


@query(f"""WITH {_PAIR}, d AS (SELECT *, CASE WHEN strand1 = '+' THEN start2 - end1 ELSE start1 - end2 END AS distance, strand1 <> strand2 AS ok, 1 - (o_orderkey % 5) / 40.0 AS f1, 1 - (o_orderkey % 7) / 40.0 AS f2 FROM p), o AS (SELECT distance, row_number() OVER (ORDER BY distance) - 1 AS k, count(*) OVER () AS n FROM d WHERE ok)
SELECT count(*) AS n_pairs, count(CASE WHEN ok THEN 1 END) AS n_ordered, count(CASE WHEN ok AND abs(distance - 120) <= 150 THEN 1 END) AS n_likely, round(avg((f1 + f2) / 2), 9) AS mean_fraction, count(CASE WHEN f1 = 1 OR f2 = 1 THEN 1 END) AS n_one_perfect, CAST(sum(CAST(f1 = 1 AS INT) + CAST(f2 = 1 AS INT)) AS BIGINT) AS n_perfect,
(SELECT round(avg(distance), 6) FROM o) AS mean_distance, (SELECT max(distance) FROM o WHERE k = n // 2) AS median_distance FROM d""")
def alignment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    distance = F.when(F.col("strand1") == "+", F.col("start2") - F.col("end1")).otherwise(F.col("start1") - F.col("end2"))
    key = F.col("o_orderkey")
    rows = _aligned(spark, sf_dir).select((F.col("strand1") != F.col("strand2")).alias("strands_ok"), distance.alias("distance"), (1 - key % 5 / 40.0).alias("fraction1"), (1 - key % 7 / 40.0).alias("fraction2")).withColumn("distance_ok", F.abs(F.col("distance") - 120) <= 150)
    return ag.alignment_summary(rows).withColumns({"mean_fraction": F.round("mean_fraction", 9), "mean_distance": F.round("mean_distance", 6)})


@query("""WITH s AS (SELECT o_custkey AS kmer, count(DISTINCT o_orderstatus) AS n_levels, CAST(count(*) AS BIGINT) AS observed, avg(o_totalprice) / 400000 AS p FROM orders GROUP BY 1)
SELECT kmer, observed FROM s WHERE n_levels = 1 AND p >= 0.5 AND observed < 12 AND kmer % 7 <> 0""")
def useful_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    stats = o.groupBy(F.col("o_custkey").alias("kmer")).agg(F.countDistinct("o_orderstatus").alias("n_levels"), F.count("*").alias("observed"), (F.avg("o_totalprice") / 400000).alias("p_within"))
    return fl.useful_kmers(stats, o.where("o_custkey % 7 = 0").select(F.col("o_custkey").alias("kmer")).distinct(), 12).select("kmer", "observed")


@query("""WITH s AS (SELECT p_partkey, translate(replace(p_name, ' ', ''), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTNNNNNN') AS s FROM part)
SELECT p_partkey, regexp_matches(s, '^[ACGT]+$') AS valid, CASE WHEN regexp_matches(s, '[ACGT]{5}') THEN CAST(length(regexp_extract(s, '^(.*?)[ACGT]{5}', 1)) + 1 AS INT) ELSE 0 END AS first_valid FROM s""")
def kmer_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.translate(F.translate("p_name", " ", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTNNNNNN")
    return table(spark, sf_dir, "part").select("p_partkey", sq.is_valid_kmer(s).alias("valid"), sq.first_valid(s, 5).alias("first_valid"))


@query("""WITH c AS (SELECT CASE WHEN s_suppkey % 13 = 0 THEN 'TEST' ELSE 'c' END || o_orderkey AS contig_id, o_totalprice / 400000 AS i, o_custkey % 100 AS n, (o_orderkey % 10) / 10.0 AS u, (o_custkey % 10) / 10.0 AS e, o_custkey AS f FROM orders JOIN supplier ON s_suppkey = o_orderkey % 97)
SELECT contig_id, f AS first_pos, f + n + 30 AS last_pos FROM c WHERE i > 0.8 AND n > 50 AND u > 0.5 AND e <= 0.3 AND contig_id NOT LIKE 'TEST%'""")
def contig_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as contigs, some of them tests by their supplier."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "supplier"), F.col("s_suppkey") == F.col("o_orderkey") % 97)
    n, first = F.col("o_custkey") % 100, F.col("o_custkey")
    name = F.concat(F.when(F.col("s_suppkey") % 13 == 0, "TEST").otherwise("c"), F.col("o_orderkey").cast("string"))
    stats = o.select(name.alias("contig_id"), (F.col("o_totalprice") / 400000).alias("in_set"), n.alias("stretch_length"), (F.col("o_orderkey") % 10 / 10.0).alias("stretch_unique"), (F.col("o_custkey") % 10 / 10.0).alias("stretch_elsewhere"), first.alias("first_unique"), (first + n).alias("last_unique"))
    return fl.extractable_contigs(stats, 31)


@query("""WITH r AS (SELECT event_id, user_id AS read_id, event_type AS chrom, CAST(event_id % 50 AS INT) AS pos FROM events), f AS (SELECT read_id, min((chrom, pos)) AS place FROM r GROUP BY 1),
c AS (SELECT read_id, place, 4 / count(*) OVER (PARTITION BY place) AS rate FROM f), k AS (SELECT read_id FROM c WHERE place[2] = 0 OR rate >= 1 OR CAST('0x' || substr(md5(CAST(read_id AS VARCHAR)), 1, 8) AS BIGINT) % 1000000 <= rate * 1000000)
SELECT event_id, r.read_id FROM r JOIN k ON r.read_id = k.read_id""")
def capped_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of their users' reads."""
    r = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("read_id"), F.col("event_type").alias("chrom"), (F.col("event_id") % 50).cast("int").alias("pos"))
    return fl.capped_starts(r, "read_id", ["chrom", "pos"], 4).select("event_id", "read_id")


@query(f"""WITH s AS (SELECT CAST(item_id AS VARCHAR) AS chrom, {dna_sql("text")} AS seq FROM benchmark), c AS (SELECT chrom, i, substr(seq, CAST(i AS INT), 1) AS b FROM s, unnest(range(1, length(seq) + 1)) AS r(i)),
m AS (SELECT DISTINCT CAST(n.item_id AS VARCHAR) AS chrom, p_size * 7 - 6 AS a, p_size * 7 + p_partkey % 6 AS b FROM part JOIN benchmark n ON n.item_id = p_partkey % 90 WHERE p_size % 4 = 0)
SELECT c.chrom, string_agg(CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.chrom = c.chrom AND i BETWEEN m.a AND m.b) THEN 'N' ELSE c.b END, '' ORDER BY i) AS seq FROM c GROUP BY 1""")
def masked_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages as chromosomes, places by parts as genes; every second chromosome has none."""
    s = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("chrom"), dna(F.col("text")).alias("seq"))
    p = table(spark, sf_dir, "part").where("p_size % 4 = 0").select((F.col("p_partkey") % 90).cast("string").alias("chrom"), (F.col("p_size") * 7 - 6).alias("start"), (F.col("p_size") * 7 + F.col("p_partkey") % 6).alias("end"))
    return fl.masked(s, p.join(s.select("chrom"), "chrom", "left_semi"))


# --- scalars


@query("""WITH p AS (SELECT p_partkey, replace(p_name, ' ', '--') || CASE WHEN p_partkey % 3 = 0 THEN '--' ELSE '' END AS s FROM part)
SELECT p_partkey, CAST(len(string_split(s, '--')) AS INT) AS by_string, CAST(len(string_split(s, '-')) - CASE WHEN s LIKE '%-' THEN 1 ELSE 0 END AS INT) AS by_sign, CAST(length(s) AS INT) AS signs, string_split(s, '--')[-1] AS last FROM p""")
def string_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.replace("p_name", F.lit(" "), F.lit("--")), F.when(F.col("p_partkey") % 3 == 0, "--").otherwise(""))
    parts = sq.split_string(s, "--")
    return table(spark, sf_dir, "part").select("p_partkey", F.size(parts).alias("by_string"), F.size(sq.split_sign(s, "-")).alias("by_sign"), F.size(sq.split_string(s, "")).alias("signs"), F.get(parts, F.size(parts) - 1).alias("last"))


@query("""SELECT o_orderkey, CAST((o_orderkey >> 3) & 1 AS TINYINT) AS bit3, repeat('ab', CAST(o_orderkey % 4 AS INT)) AS repeated, translate('ACGTN', 'ACGTacgt', 'TGCAtgca') AS complement, CASE WHEN o_orderkey % 2 = 0 THEN '6' ELSE '7' END AS chrom FROM orders""")
def small_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits, repeated strings, complements, and names of chromosomes with and without chr."""
    key = F.col("o_orderkey")
    name = F.when(key % 2 == 0, F.when(key % 3 == 0, "chr6").otherwise("6")).otherwise(F.when(key % 3 == 0, "chr7").otherwise("7"))
    return table(spark, sf_dir, "orders").select("o_orderkey", sq.bit(key, F.lit(3)).alias("bit3"), F.expr("repeat('ab', cast(o_orderkey % 4 as int))").alias("repeated"), sq.complement(F.lit("ACGTN")).alias("complement"), sq.chromosome(name).alias("chrom"))


_COUNTED = "x AS (SELECT p_partkey AS k, CAST(3 + p_partkey % 5 AS INT) AS a, CAST(p_partkey % 3 AS INT) AS i, CAST(4 + p_size % 4 AS INT) AS b, CAST(p_size % 2 AS INT) AS d FROM part)"


@query(f"""WITH {_COUNTED} SELECT k AS read_id, repeat('A', a) || repeat('_', i) || repeat('A', b + d) AS g, repeat('C', a) || repeat('T', i) || repeat('G', b) || repeat('_', d) AS s,
array_to_string([unnest FROM unnest(list_concat(range(11, 11 + a), list_transform(range(0, i), lambda q: -1), range(11 + a, 11 + a + b + d)))], ',') AS levels FROM x""".replace("array_to_string([unnest FROM unnest(list_concat(range(11, 11 + a), list_transform(range(0, i), lambda q: -1), range(11 + a, 11 + a + b + d)))], ',')", "array_to_string(list_concat(list_concat(range(11, 11 + a), list_transform(range(0, i), lambda q: -1)), range(11 + a, 11 + a + b + d)), ',')"))
def expanded_cigars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads from the eleventh place of a reference of one base, with a clipped sign, insertions and deletions."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("read_id"), (3 + F.col("p_partkey") % 5).cast("int").alias("a"), (F.col("p_partkey") % 3).cast("int").alias("i"), (4 + F.col("p_size") % 4).cast("int").alias("b"), (F.col("p_size") % 2).cast("int").alias("d"))
    op = lambda n, sign: F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(sign))).otherwise("")
    records = p.select("read_id", F.lit("6").alias("chrom"), F.lit(11).alias("pos"), F.concat(F.lit("1S"), op("a", "M"), op("i", "I"), op("b", "M"), op("d", "D")).alias("cigar"), F.expr("concat('N', repeat('C', a), repeat('T', i), repeat('G', b))").alias("seq"))
    reference = spark.range(1).select(F.lit("6").alias("chrom"), F.repeat(F.lit("A"), F.lit(60)).alias("seq"))
    return variants.expanded_cigars(records, reference).select("read_id", "g", "s", F.array_join(F.transform("levels", lambda x: x.cast("string")), ",").alias("levels"))


# --- joins, sets and choices


@query("""WITH a AS (SELECT l_suppkey % 40 AS pos, substr('ACGT', CAST(l_partkey % 4 + 1 AS INT), 1) AS allele, count(*) AS n FROM lineitem GROUP BY 1, 2), p AS (SELECT DISTINCT s_suppkey % 30 AS pos, substr('ACGT', CAST(s_nationkey % 4 + 1 AS INT), 1) AS allele FROM supplier)
SELECT a.*, pos IN (SELECT pos FROM p) AS known, EXISTS (SELECT 1 FROM p WHERE p.pos = a.pos AND p.allele = a.allele) AS present FROM a""")
def panel_allele_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 40).alias("pos"), _sign("ACGT", F.col("l_partkey")).alias("allele")).agg(F.count("*").alias("n"))
    panel = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 30).alias("pos"), _sign("ACGT", F.col("s_nationkey")).alias("allele"))
    return jn.panel_alleles(a, panel, ["pos"])


@query("SELECT s_suppkey, s_name, coalesce(n_name, 'unknown') AS n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) n ON s_nationkey = n_nationkey")
def sample_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0").withColumnRenamed("n_nationkey", "key")
    return jn.labelled(table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "key"), n, "key", "n_name").select("s_suppkey", "s_name", "n_name")


@query(f"""WITH {sqs._BENCH}, {sqs._READS}, a AS (SELECT DISTINCT least(kmer, {revcomp_sql("kmer")}) AS kmer FROM ({kmers_sql("bench", "item_id", "seq", 9)}) x), b AS (SELECT DISTINCT least(kmer, {revcomp_sql("kmer")}) FROM ({kmers_sql("reads", "read_id", "seq", 9)}) x)
SELECT kmer, count(*) AS n_sets FROM (SELECT * FROM a UNION ALL SELECT * FROM b) u GROUP BY 1""")
def kmer_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = lambda df: df.select(F.explode(sq.kmers(F.col("seq"), 9)).alias("kmer"))
    return jn.kmer_union([raw(sqs._bench(spark, sf_dir)), raw(sqs._pairs(spark, sf_dir))])


@query("SELECT DISTINCT s AS kmer FROM (SELECT substr('ACGT_*', CAST(p_partkey % 6 + 1 AS INT), 1) || CASE WHEN p_size % 2 = 0 THEN substr('ACG*', CAST(p_size % 4 + 1 AS INT), 1) ELSE '' END AS s FROM part) x WHERE s <> '_' AND s NOT LIKE '%*%'")
def required_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.concat(_sign("ACGT_*", F.col("p_partkey")), F.when(F.col("p_size") % 2 == 0, _sign("ACG*", F.col("p_size"))).otherwise("")).alias("symbol"))
    return jn.required_kmers(p)


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 3, l_suppkey % 2 ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) x WHERE k = 1""")
def unique_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumns({"g": F.col("l_partkey") % 3, "s": F.col("l_suppkey") % 2})
    return jn.unique_alignments(rows, ["l_orderkey", "g", "s"], [F.col("l_quantity").desc(), "l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("""WITH d AS (SELECT *, CAST('0x' || substr(md5('7|' || p_partkey), 1, 8) AS BIGINT) % 1000000 AS dr FROM part) SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, dr, p_partkey) AS k FROM d) x WHERE k = 1""")
def random_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wn.random_best(table(spark, sf_dir, "part"), ["p_brand"], "p_size", "p_partkey", 7).select("p_brand", "p_partkey")


@query("SELECT p_brand, p_size, n, row_number() OVER (ORDER BY n DESC, p_brand, p_size) AS rank FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2) x")
def ranked_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by their counts, the most frequent first; the grid of brands and sizes is a fixed one."""
    n = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(W.orderBy(F.col("n").desc(), "p_brand", "p_size")).cast("long"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber * 3 AS first_pos, l_partkey % 50 AS first_level, l_suppkey % 6 AS n FROM lineitem) SELECT l_orderkey AS read_id, first_pos, first_level, n, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, first_level, first_pos) AS k FROM r) x WHERE k <= 3""")
def longest_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("read_id"), (F.col("l_linenumber") * 3).alias("first_pos"), (F.col("l_partkey") % 50).alias("first_level"), (F.col("l_suppkey") % 6).alias("n"))
    return align.best_chains(chains, 3)


# --- aggregates


@query("""WITH r AS (SELECT l_shipmode, l_quantity AS v, row_number() OVER (PARTITION BY l_shipmode ORDER BY l_quantity) - 1 AS k, count(*) OVER (PARTITION BY l_shipmode) AS n FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, l_quantity FROM lineitem) x)
SELECT l_shipmode AS kind, max(n) AS n, round(avg(v), 9) AS mean, max(CASE WHEN k = n // 2 THEN v END) AS median FROM r GROUP BY 1""")
def mean_and_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("kind", F.concat("l_returnflag", "l_linestatus"))
    return ag.mean_and_median(rows, ["kind"], "l_quantity").withColumn("mean", F.round("mean", 9))


@query("""WITH s AS (SELECT l_returnflag, l_quantity AS v, sum(l_linenumber / 4) AS w FROM lineitem GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS c, sum(w) OVER (PARTITION BY l_returnflag) AS t FROM s),
q AS (SELECT l_returnflag, min(CASE WHEN c >= 0.2 * t THEN v END) AS p20, min(CASE WHEN c >= 0.5 * t THEN v END) AS p50, min(CASE WHEN c >= 0.8 * t THEN v END) AS p80 FROM c GROUP BY 1) SELECT *, greatest(abs(p50 - p20), abs(p80 - p50)) AS sd FROM q""")
def insert_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.insert_size(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", F.col("l_linenumber") / 4)


@query("""WITH e AS (SELECT p_size AS level, p_partkey % (CASE WHEN p_size % 3 = 0 THEN 1 ELSE 2 END) AS edge_id, 'k' || p_partkey % 40 AS kmer, p_size % 2 + 1 AS copies FROM part), c AS (SELECT 'k' || o_custkey % 35 AS kmer, count(*) AS n FROM orders GROUP BY 1),
s AS (SELECT level FROM e GROUP BY 1 HAVING count(DISTINCT edge_id) = 1), u AS (SELECT e.*, coalesce(n, 0) AS n FROM e LEFT JOIN c ON e.kmer = c.kmer WHERE level IN (SELECT level FROM s) AND e.kmer <> 'k7')
SELECT round(0.5 * sum(n) / sum(copies), 9) AS coverage, CAST(sum(copies) AS BIGINT) AS n_kmers FROM u""")
def graph_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    name = lambda c: F.concat(F.lit("k"), c.cast("string"))
    e = table(spark, sf_dir, "part").select(size.alias("level"), (key % F.when(size % 3 == 0, 1).otherwise(2)).alias("edge_id"), name(key % 40).alias("kmer"), (size % 2 + 1).alias("copies"))
    counts = table(spark, sf_dir, "orders").groupBy(name(F.col("o_custkey") % 35).alias("kmer")).agg(F.count("*").alias("n"))
    repeats = spark.range(1).select(F.lit("k7").alias("kmer"))
    return ag.graph_coverage(e, counts, repeats, 1.0).withColumn("coverage", F.round("coverage", 9))


_SEGMENTS = f"""g AS (SELECT p_brand AS chrom, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INT) AS seg_ord, {_sign_sql("ACGT", "p_partkey")} || {_sign_sql("ACGTN", "p_size")} || '_' AS a1, CASE WHEN p_partkey % 3 = 0 THEN {_sign_sql("ACGT", "p_size")} || 'TT' END AS a2 FROM part)"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    order = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")) - 1
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("chrom"), order.alias("seg_ord"), F.concat(_sign("ACGT", key), _sign("ACGTN", size), F.lit("_")).alias("a1"), F.when(key % 3 == 0, F.concat(_sign("ACGT", size), F.lit("TT"))).alias("a2"))


@query(f"""WITH {_SEGMENTS}, h AS (SELECT chrom, 1 AS h, replace(string_agg(a1, '' ORDER BY seg_ord), '_', '') AS s FROM g GROUP BY 1 UNION ALL SELECT chrom, 2, replace(string_agg(coalesce(a2, a1), '' ORDER BY seg_ord), '_', '') FROM g GROUP BY 1),
k AS (SELECT chrom, least(kmer, {revcomp_sql("kmer")}) AS kmer, regexp_matches(kmer, '^[ACGT]+$') AS v FROM ({kmers_sql("h", "chrom, h", "s", 5)}) x), e AS (SELECT chrom, kmer, CAST(count(*) AS INT) AS c, bool_and(v) AS v FROM k GROUP BY 1, 2),
{sqs._BENCH}, n AS (SELECT least(kmer, {revcomp_sql("kmer")}) AS kmer, CAST(count(*) % 9 AS INT) AS n FROM ({kmers_sql("bench", "item_id", "seq", 5)}) x GROUP BY 1), j AS (SELECT e.*, coalesce(n, 0) AS n FROM e LEFT JOIN n ON e.kmer = n.kmer),
q AS (SELECT chrom, kmer, c, v, n, i, exp(n * ln(CASE WHEN i = 0 THEN 0.01 ELSE i * 2.5 END) - CASE WHEN i = 0 THEN 0.01 ELSE i * 2.5 END - lgamma(n + 1.0)) AS p FROM j, unnest(range(0, greatest(c, 2) + 3)) AS r(i)),
s AS (SELECT chrom, kmer, max(c) AS c, bool_and(v) AS v, max(n) AS n, CASE WHEN bool_and(v) THEN max(CASE WHEN i = c THEN p END) / sum(p) ELSE 0 END AS p FROM q GROUP BY 1, 2)
SELECT chrom, CAST(sum(c) AS BIGINT) AS total, count(*) AS different, CAST(sum(CASE WHEN v THEN 0 ELSE c END) AS BIGINT) AS invalid, CAST(sum(CASE WHEN n > 0 THEN c ELSE 0 END) AS BIGINT) AS present, round(avg(p), 8) AS optimality, round(sum(p * c) / sum(c), 8) AS weighted FROM s GROUP BY 1""")
def genome_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-mers of both haplotypes of genome strings against counts of the passages'."""
    counts = ag.kmer_counts(sqs._bench(spark, sf_dir), "seq", 5).withColumn("n", (F.col("n") % 9).cast("int"))
    return variants.evaluated(_segments(spark, sf_dir), counts, 5, 2.5).withColumns({"optimality": F.round("optimality", 8), "weighted": F.round("weighted", 8)})


# --- typing, variants, panels


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, substr('ACGT', CAST(l_partkey % 4 + 1 AS INT), 1) AS s, CASE WHEN l_suppkey % 4 = 0 THEN -1 ELSE 100 + l_linenumber END AS level, chr(CAST(65 + l_partkey % 20 AS INT)) AS q FROM lineitem),
r AS (SELECT *, sum(CASE WHEN level <> -1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT l_orderkey AS read_id, max(level) AS level, string_agg(s, '' ORDER BY i) AS genotype, string_agg(q, '' ORDER BY i) AS quality FROM r WHERE run > 0 GROUP BY l_orderkey, run""")
def exon_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as columns of their order's alignment; every fourth supplier's is an insertion."""
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("read_id"), "l_linenumber", "l_partkey", "l_suppkey", _sign("ACGT", F.col("l_partkey")).alias("s"), F.when(F.col("l_suppkey") % 4 == 0, -1).otherwise(100 + F.col("l_linenumber")).alias("level"), F.char(65 + F.col("l_partkey") % 20).alias("q"))
    one = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "s", "level", "q")))
    text = lambda name: F.array_join(F.transform("x", lambda v: v[name]), "")
    a = c.groupBy("read_id").agg(one.alias("x")).select("read_id", text("s").alias("g"), text("s").alias("s"), F.transform("x", lambda v: v["level"]).alias("levels"), text("q").alias("quality"))
    return ty.exon_positions(a)


@query("""WITH c AS (SELECT s_suppkey AS id, CAST(s_nationkey % 5 AS INT) AS locus, rpad(translate(s_name, '0123456789', 'ACGTACGTAC'), 24, '*') AS seq FROM supplier) SELECT a.id, a.locus, CAST(b.id AS VARCHAR) AS reference_id, CAST(sum(CASE WHEN substr(a.seq, CAST(i AS INT), 1) <> '*' AND substr(b.seq, CAST(i AS INT), 1) <> '*' AND substr(a.seq, CAST(i AS INT), 1) <> substr(b.seq, CAST(i AS INT), 1) THEN 1 ELSE 0 END) AS INT) AS distance
FROM c a JOIN c b ON a.locus = b.locus AND b.id < 20, unnest(range(1, 25)) AS r(i) GROUP BY 1, 2, 3""")
def similar_haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 5).cast("int").alias("locus"), F.rpad(F.translate("s_name", "0123456789", "ACGTACGTAC"), 24, "*").alias("seq"))
    reference = s.where("id < 20").select("locus", F.col("id").cast("string").alias("reference_id"), F.col("seq").alias("reference_seq"))
    return ty.similar_haplotypes(s, reference, ["locus"], "id")


_HAP = f"""c AS (SELECT CAST(p_size % 4 AS VARCHAR) AS chrom, p_partkey AS place, {_sign_sql("ACGT", "p_partkey")} AS ref, CASE WHEN p_partkey % 11 = 0 THEN '_' WHEN p_partkey % 7 = 0 THEN {_sign_sql("ACGT", "p_size")} ELSE {_sign_sql("ACGT", "p_partkey")} END AS h1, CASE WHEN p_partkey % 13 = 0 THEN {_sign_sql("ACGT", "p_size + 1")} ELSE {_sign_sql("ACGT", "p_partkey")} END AS h2 FROM part)"""


@query(f"""WITH {_HAP}, f AS (SELECT *, ref = h1 AND ref = h2 AND ref <> '_' AS clean, ref = '_' OR h1 = '_' OR h2 = '_' AS gap FROM c), l AS (SELECT *, clean AND coalesce(lead(gap) OVER w, false) AS anchor, lag(clean) OVER w AS bc FROM f WINDOW w AS (PARTITION BY chrom ORDER BY place)),
o AS (SELECT *, NOT clean OR anchor AS open, anchor OR (NOT clean AND coalesce(bc, true) AND NOT coalesce(lag(anchor) OVER (PARTITION BY chrom ORDER BY place), false)) AS starts FROM l), r AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY chrom ORDER BY place ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT chrom, min(place) AS pos, replace(string_agg(ref, '' ORDER BY place), '_', '') AS ref, replace(string_agg(h1, '' ORDER BY place), '_', '') AS a1, replace(string_agg(h2, '' ORDER BY place), '_', '') AS a2 FROM r WHERE open GROUP BY chrom, run HAVING ref <> a1 OR ref <> a2""".replace("HAVING ref <> a1 OR ref <> a2", "HAVING replace(string_agg(ref, '' ORDER BY place), '_', '') <> replace(string_agg(h1, '' ORDER BY place), '_', '') OR replace(string_agg(ref, '' ORDER BY place), '_', '') <> replace(string_agg(h2, '' ORDER BY place), '_', '')"))
def haplotype_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as columns of two haplotypes and the reference."""
    key, size = F.col("p_partkey"), F.col("p_size")
    ref = _sign("ACGT", key)
    h1 = F.when(key % 11 == 0, "_").when(key % 7 == 0, _sign("ACGT", size)).otherwise(ref)
    c = table(spark, sf_dir, "part").select((size % 4).cast("string").alias("chrom"), key.alias("at"), key.alias("pos"), ref.alias("ref"), h1.alias("h1"), F.when(key % 13 == 0, _sign("ACGT", size + 1)).otherwise(ref).alias("h2"))
    return variants.haplotypes_to_records(c)


@query("SELECT 'L' || p_size || '_' || p_partkey AS locus_id, CASE WHEN p_size < 20 THEN '?' ELSE substr(p_type, 1, 1) END AS allele FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)".replace("p_size < 20", "('L' || p_size) LIKE 'L1%'"))
def hidden_individual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One brand's parts as an individual whose loci that begin with L1 are hidden."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("haplotype_id"), F.concat(F.lit("L"), F.col("p_size").cast("string"), F.lit("_"), F.col("p_partkey").cast("string")).alias("locus_id"), F.substr("p_type", F.lit(1), F.lit(1)).alias("allele"))
    name = p.agg(F.min("haplotype_id")).first()[0]
    return simulate.individual(p, name, "L1").select("locus_id", "allele")


@query("""WITH o AS (SELECT o_orderkey, translate(CAST(o_orderkey * 7 % 100000 + 100000 AS VARCHAR), '0123456789', 'ACGT?ACGTA') AS h1, translate(CAST(o_custkey + 100000 AS VARCHAR), '0123456789', 'ACGTAC?TAC') AS h2, translate(CAST(o_custkey + 100000 AS VARCHAR), '0123456789', 'ACGTACGTAC') AS t1, translate(CAST(o_orderkey * 7 % 100000 + 100000 AS VARCHAR), '0123456789', 'ACTTAACGTA') AS t2 FROM orders),
c AS (SELECT o_orderkey, substr(h1, CAST(i AS INT), 1) AS a, substr(h2, CAST(i AS INT), 1) AS b, substr(t1, CAST(i AS INT), 1) AS x, substr(t2, CAST(i AS INT), 1) AS y FROM o, unnest(range(1, 7)) AS r(i)),
n AS (SELECT o_orderkey, CAST(sum(CAST(a <> '?' AND x <> '?' AND a <> x AS INT) + CAST(b <> '?' AND y <> '?' AND b <> y AS INT)) AS INT) AS w0, CAST(sum(CAST(a <> '?' AND x <> '?' AND a = x AS INT) + CAST(b <> '?' AND y <> '?' AND b = y AS INT)) AS INT) AS o0, CAST(sum(CAST(a <> '?' AND y <> '?' AND a <> y AS INT) + CAST(b <> '?' AND x <> '?' AND b <> x AS INT)) AS INT) AS w1, CAST(sum(CAST(a <> '?' AND y <> '?' AND a = y AS INT) + CAST(b <> '?' AND x <> '?' AND b = x AS INT)) AS INT) AS o1 FROM c GROUP BY 1)
SELECT o_orderkey, w1 < w0 OR (w1 = w0 AND o1 > o0) AS flipped, CASE WHEN w1 < w0 OR (w1 = w0 AND o1 > o0) THEN o1 ELSE o0 END AS ok, CASE WHEN w1 < w0 OR (w1 = w0 AND o1 > o0) THEN w1 ELSE w0 END AS wrong FROM n""")
def haplotype_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haplotypes against truth in the better phase."""
    key, text = F.col("o_orderkey"), lambda c, to: F.translate((c + 100000).cast("string"), "0123456789", to)
    o = table(spark, sf_dir, "orders").select(key.alias("individual_id"), F.lit("A").alias("locus"), text(key * 7 % 100000, "ACGT?ACGTA").alias("h1"), text(F.col("o_custkey"), "ACGTAC?TAC").alias("h2"), text(F.col("o_custkey"), "ACGTACGTAC").alias("t1"), text(key * 7 % 100000, "ACTTAACGTA").alias("t2"))
    out = validate.haplotype_report(o.drop("t1", "t2"), o.drop("h1", "h2"))
    return out.select(F.col("individual_id").alias("o_orderkey"), "flipped", "ok", "wrong")


# --- graphs of genome strings


@query(f"""WITH {_SEGMENTS}, o AS (SELECT chrom, a1, CASE WHEN a2 <> a1 THEN a2 END AS a2, coalesce(sum(length(a1)) OVER (PARTITION BY chrom ORDER BY seg_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM g), s AS (SELECT chrom, o, 0 AS h, a1 AS s FROM o UNION ALL SELECT chrom, o, 1, a2 FROM o WHERE a2 IS NOT NULL),
e AS (SELECT chrom, CAST(o + i AS INT) AS level, h, i, substr(s, CAST(i + 1 AS INT), 1) AS symbol FROM s, unnest(range(0, 3)) AS r(i))
SELECT chrom AS graph, level, CAST(level * 4 + h AS BIGINT) AS edge_id, CAST(CASE WHEN i = 0 THEN level * 4 ELSE level * 4 + h + 1 END AS BIGINT) AS from_id, CAST(CASE WHEN i = 2 THEN (level + 1) * 4 ELSE (level + 1) * 4 + h + 1 END AS BIGINT) AS to_id, 'L' || level AS locus_id, symbol, 1.0::DOUBLE AS count FROM e""")
def genome_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.segments_to_edges(_segments(spark, sf_dir).withColumnRenamed("chrom", "graph"))


def _paths(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two paths through each graph: along the first alleles, and along the second where there are some."""
    e = graph.segments_to_edges(_segments(spark, sf_dir).withColumnRenamed("chrom", "graph"))
    first = e.where("edge_id % 4 = 0").select("graph", F.lit(1).alias("hap"), "level", "edge_id")
    second = e.groupBy("graph", "level").agg(F.max("edge_id").alias("edge_id")).select("graph", F.lit(2).alias("hap"), "level", "edge_id")
    return first.unionByName(second), e


@query(f"""WITH {_SEGMENTS}, h AS (SELECT chrom, 1 AS hap, string_agg(a1, '' ORDER BY seg_ord) AS s FROM g GROUP BY 1 UNION ALL SELECT chrom, 2, string_agg(coalesce(a2, a1), '' ORDER BY seg_ord) FROM g GROUP BY 1)
SELECT chrom AS graph, CAST(hap AS INT) AS hap, s AS aligned, replace(s, '_', '') AS plain FROM h""")
def path_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.path_strings(*_paths(spark, sf_dir)).select("graph", "hap", "aligned", "plain")


@query(f"""WITH {_SEGMENTS}, h AS (SELECT chrom, string_agg(a1, '' ORDER BY seg_ord) AS x, string_agg(coalesce(a2, a1), '' ORDER BY seg_ord) AS y FROM g GROUP BY 1), c AS (SELECT chrom, i, substr(x, CAST(i AS INT), 1) AS a, substr(y, CAST(i AS INT), 1) AS b FROM h, unnest(range(1, length(x) + 1)) AS r(i)),
n AS (SELECT *, a = b AS same, CASE WHEN (a = b) = lag(a = b) OVER (PARTITION BY chrom ORDER BY i) THEN 0 ELSE 1 END AS new FROM c), r AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT chrom AS graph, CAST(run AS BIGINT) AS seg_ord, string_agg(a, '' ORDER BY i) AS a1, CASE WHEN NOT bool_and(same) THEN string_agg(b, '' ORDER BY i) END AS a2 FROM r GROUP BY chrom, run""")
def genome_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.genome_string(*_paths(spark, sf_dir))


@query(f"""WITH {_SEGMENTS}, e AS (SELECT p_partkey AS edge_id, {_sign_sql("ACGT_", "p_partkey")} AS symbol FROM part) SELECT edge_id, CASE WHEN CAST('0x' || substr(md5('1|x|' || edge_id), 1, 8) AS BIGINT) % 10000 < 1000 THEN '_' ELSE symbol END AS symbol FROM e""")
def random_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "part").select(F.lit("x").alias("graph"), F.col("p_partkey").alias("edge_id"), _sign("ACGT_", F.col("p_partkey")).alias("symbol"))
    return graph.with_gaps(e).select("edge_id", "symbol")


_LADDER = """e AS (SELECT CAST(p_size AS INT) AS level, p_partkey AS edge_id, CAST(p_size * 4 + p_partkey % 2 AS BIGINT) AS from_id, CAST((p_size + 1) * 4 + p_partkey % 3 % 2 AS BIGINT) AS to_id, substr('ACGT_', CAST(p_partkey % 5 + 1 AS INT), 1) AS symbol, CAST(p_partkey % 3 + 1 AS DOUBLE) AS cnt FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS k FROM part) x WHERE k <= 3)"""


def _ladder(spark: SparkSession, sf_dir: str, width: int = 3, to: Column | None = None) -> DataFrame:
    """Three edges at each of the sizes, a graph of a fixed width."""
    key, size = F.col("p_partkey"), F.col("p_size")
    p = wn.top_rows(table(spark, sf_dir, "part"), ["p_size"], ["p_partkey"], width)
    return p.select(F.lit("g").alias("graph"), size.cast("int").alias("level"), key.alias("edge_id"), (size * 4 + key % 2).cast("long").alias("from_id"), ((size + 1) * 4 + (key % 3 % 2 if to is None else to)).cast("long").alias("to_id"), F.concat(F.lit("L"), size.cast("string")).alias("locus_id"), _sign("ACGT_", key).alias("symbol"), (key % 3 + 1).cast("double").alias("count"))


@query(f"""WITH RECURSIVE {_LADDER}, s AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY from_id) AS p FROM e), f AS (SELECT level, edge_id AS first_edge, CAST(edge_id AS VARCHAR) AS path, symbol AS kmer, 1.0::DOUBLE AS p, to_id FROM s WHERE symbol <> '_'
UNION ALL SELECT f.level, first_edge, f.path || ',' || s.edge_id, kmer || CASE WHEN symbol = '_' THEN '' ELSE symbol END, f.p * s.p, s.to_id FROM f JOIN s ON s.from_id = f.to_id WHERE length(kmer) < 5)
SELECT level, first_edge, path, kmer, round(p, 9) AS p FROM f WHERE length(kmer) = 5""")
def kmer_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph.kmer_paths(_ladder(spark, sf_dir), 5)
    return out.select("level", "first_edge", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"), "kmer", F.round("p", 9).alias("p"))


@query(f"""WITH RECURSIVE {_LADDER}, f AS (SELECT level, CAST(edge_id AS VARCHAR) AS path, symbol AS kmer, to_id FROM e WHERE symbol <> '_' UNION ALL SELECT f.level, f.path || ',' || e.edge_id, kmer || CASE WHEN symbol = '_' THEN '' ELSE symbol END, e.to_id FROM f JOIN e ON e.from_id = f.to_id WHERE length(kmer) < 4),
k AS (SELECT * FROM f WHERE length(kmer) = 4), u AS (SELECT kmer, count(DISTINCT level) = 1 AS "unique" FROM k GROUP BY 1) SELECT k.kmer, level, path, "unique" FROM k JOIN u ON k.kmer = u.kmer""")
def graph_kmer_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.kmer_index(_ladder(spark, sf_dir), 4).select("kmer", "level", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"), "unique")


@query(f"""WITH RECURSIVE {_LADDER}, t AS (SELECT max(level) AS m FROM e), a AS (SELECT edge_id, from_id, level FROM e, t WHERE level = m UNION ALL SELECT e.edge_id, e.from_id, e.level FROM a JOIN e ON e.to_id = a.from_id) SELECT DISTINCT edge_id, level FROM a""".replace("UNION ALL", "UNION"))
def trimmed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.trimmed(_ladder(spark, sf_dir)).select("edge_id", "level")


#: Passages as graphs of one path, parted into bubbles of 3 to 123 levels; in every second bubble the other arm is all gaps.
_BUBBLES = """t AS (SELECT CAST(item_id AS VARCHAR) AS graph, 3 + item_id % 7 * 20 AS r, length(text) AS n, text FROM benchmark),
c AS (SELECT graph, r, n, i, unicode(substr(text, CAST(i + 1 AS INT), 1)) AS code, i // r AS region FROM t, unnest(range(0, n)) AS u(i)),
e AS (SELECT graph, CAST(i AS INT) AS level, i * 2 + lane AS edge_id, i * 2 + CASE WHEN i % r > 0 THEN lane ELSE 0 END AS from_id, (i + 1) * 2 + CASE WHEN i % r < r - 1 AND i < n - 1 THEN lane ELSE 0 END AS to_id,
  CASE WHEN lane = 1 AND region % 4 = 1 THEN '_' ELSE substr('ACGT', CAST((code + lane) % 4 + 1 AS INT), 1) END AS symbol, CASE WHEN lane = 0 THEN 1.0 + code % 3 ELSE 1.0 END AS cnt FROM c, unnest([0, 1]) AS v(lane) WHERE lane = 0 OR region % 2 = 1)"""


def _bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("graph"), (F.lit(3) + F.col("item_id") % 7 * 20).alias("_r"), F.length("text").alias("_n"), F.posexplode(F.split("text", "")).alias("_i", "_c"))
    i, r, n, code, lane = F.col("_i"), F.col("_r"), F.col("_n"), F.ascii("_c"), F.col("_lane")
    region = F.floor(i / r)
    lanes = rows.where(i < n).withColumn("_lane", F.explode(F.when(region % 2 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return lanes.select(
        "graph",
        i.alias("level"),
        (i * 2 + lane).cast("long").alias("edge_id"),
        (i * 2 + F.when(i % r > 0, lane).otherwise(0)).cast("long").alias("from_id"),
        ((i + 1) * 2 + F.when((i % r < r - 1) & (i < n - 1), lane).otherwise(0)).cast("long").alias("to_id"),
        F.concat(F.lit("L"), i.cast("string")).alias("locus_id"),
        F.when((lane == 1) & (region % 4 == 1), "_").otherwise(_sign("ACGT", code + lane)).alias("symbol"),
        F.when(lane == 0, 1.0 + code % 3).otherwise(1.0).alias("count"),
    )


@query(f"""WITH RECURSIVE {_BUBBLES}, s AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY graph, from_id) AS p FROM e), f AS (SELECT graph, level, edge_id AS first_edge, CAST(edge_id AS VARCHAR) AS path, symbol AS kmer, 1.0::DOUBLE AS p, to_id FROM s WHERE symbol <> '_'
UNION ALL SELECT f.graph, f.level, first_edge, f.path || ',' || s.edge_id, kmer || CASE WHEN symbol = '_' THEN '' ELSE symbol END, f.p * s.p, s.to_id FROM f JOIN s ON s.graph = f.graph AND s.from_id = f.to_id WHERE length(kmer) < 6)
SELECT graph, level, first_edge, path, kmer, round(p, 9) AS p FROM f WHERE length(kmer) = 6""")
def kmer_paths_over_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths over runs of up to 123 gaps, in graphs of whole passages."""
    out = graph.kmer_paths(_bubbles(spark, sf_dir), 6)
    return out.select("graph", "level", "first_edge", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"), "kmer", F.round("p", 9).alias("p"))


@query(f"""WITH RECURSIVE {_BUBBLES}, f AS (SELECT graph, level, edge_id::VARCHAR AS trail, symbol AS kmer, to_id FROM e WHERE symbol <> '_'
UNION ALL SELECT f.graph, f.level, CASE WHEN symbol = '_' THEN trail ELSE trail || ',' || e.edge_id END, kmer || CASE WHEN symbol = '_' THEN '' ELSE symbol END, e.to_id FROM f JOIN e ON e.graph = f.graph AND e.from_id = f.to_id WHERE length(kmer) < 8),
k AS (SELECT DISTINCT graph, level, kmer, regexp_extract(trail, '^(.*),[0-9]+$', 1) AS a, regexp_extract(trail, '^[0-9]+,(.*)$', 1) AS b FROM f WHERE length(kmer) = 8),
q AS (SELECT graph AS read_id, string_agg(symbol, '' ORDER BY level) AS seq FROM e WHERE edge_id % 2 = 0 GROUP BY graph),
s AS (SELECT row_number() OVER (ORDER BY read_id, graph, pos, a, b) AS seed, * FROM (SELECT read_id, pos, graph, level, a, b FROM (SELECT read_id, pos, substr(seq, CAST(pos + 1 AS INT), 8) AS kmer FROM q, unnest(range(0, length(seq) - 7)) AS u(pos)) x JOIN k USING (kmer)) y),
l AS (SELECT x.seed, y.seed AS next, count(*) OVER (PARTITION BY x.seed) AS outs, count(*) OVER (PARTITION BY y.seed) AS ins FROM s AS x JOIN s AS y ON x.read_id = y.read_id AND x.graph = y.graph AND y.pos = x.pos + 1 AND x.b = y.a),
u AS (SELECT seed, next FROM l WHERE outs = 1 AND ins = 1), w AS (SELECT seed AS head, seed FROM s ANTI JOIN u ON u.next = s.seed UNION ALL SELECT head, u.next FROM w JOIN u ON u.seed = w.seed)
SELECT read_id, graph, min(pos) AS first_pos, max(pos) AS last_pos, min(level) AS first_level, max(level) AS last_level, count(*) AS n FROM w JOIN s USING (seed) GROUP BY read_id, graph, head""")
def graph_seed_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of all passages' first ways in the branching graphs of all passages."""
    edges = _bubbles(spark, sf_dir)
    first = F.transform(F.sort_array(F.collect_list(F.struct("level", "symbol"))), lambda x: x["symbol"])
    reads = edges.where("edge_id % 2 = 0").groupBy(F.col("graph").alias("read_id")).agg(F.array_join(first, "").alias("seq"))
    return align.chains_in_graph(reads, graph.kmer_graph(edges, 8), 8)


@query(f"""WITH RECURSIVE {_BUBBLES}, i AS (SELECT graph, level + 1 AS level, to_id AS node, count(*) AS n, bool_or(symbol = '_') AS gap FROM e GROUP BY ALL), o AS (SELECT graph, level, from_id AS node, count(*) AS n, bool_or(symbol = '_') AS gap FROM e GROUP BY ALL),
d AS (SELECT graph, level, node, coalesce(i.n, 0) AS ins, coalesce(o.n, 0) AS outs, coalesce(o.gap, false) AS starts, coalesce(i.gap, false) AS gap_before FROM i FULL JOIN o USING (graph, level, node)),
cuts AS (SELECT DISTINCT graph, level FROM d WHERE ins <> 1 OR outs <> 1 UNION SELECT graph, level - 4 FROM d WHERE level > 4 AND starts AND NOT (ins = 1 AND outs = 1 AND gap_before)),
a AS (SELECT graph, edge_id AS first_edge, level AS first_level, from_id, cnt AS count, level, to_id, [symbol] AS s FROM e SEMI JOIN cuts USING (graph, level)
UNION ALL SELECT a.graph, first_edge, first_level, a.from_id, a.count, e.level, e.to_id, list_append(s, symbol) FROM a JOIN e ON e.graph = a.graph AND e.from_id = a.to_id AND e.level = a.level + 1 ANTI JOIN cuts ON cuts.graph = a.graph AND cuts.level = a.level + 1)
SELECT graph, first_edge, first_level, max(level) AS last_level, from_id, max_by(to_id, level) AS to_id, count, (SELECT string_agg(x || ':' || n, ',' ORDER BY x) FROM (SELECT x, count(*) AS n FROM unnest(max_by(s, level)) AS u(x) GROUP BY x) y) AS symbols FROM a GROUP BY graph, first_edge, first_level, from_id, count""")
def collapsed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bubbles whose arms become one edge each, with runs that also end four levels before a gap."""
    return graph.collapsed(_bubbles(spark, sf_dir), before_gap=4).drop("locus_id")


@query(f"""WITH RECURSIVE {_LADDER.replace("k <= 3", "k <= 9").replace("p_partkey % 3 % 2", "p_partkey // 3 % 2")}, u AS (SELECT *, CASE WHEN edge_id % 4 = 0 THEN '*' ELSE symbol END AS s FROM e), k AS (SELECT * FROM u WHERE s <> '*' OR from_id NOT IN (SELECT from_id FROM u WHERE s <> '*')), m AS (SELECT min(level) AS a, max(level) AS b FROM k),
f AS (SELECT edge_id, to_id FROM k, m WHERE level = a UNION SELECT k.edge_id, k.to_id FROM f JOIN k ON k.from_id = f.to_id), r AS (SELECT edge_id, from_id FROM k, m WHERE level = b UNION SELECT k.edge_id, k.from_id FROM r JOIN k ON k.to_id = r.from_id)
SELECT edge_id, CAST(level AS INT) AS level, s AS symbol FROM k WHERE edge_id IN (SELECT edge_id FROM f) AND edge_id IN (SELECT edge_id FROM r)""")
def known_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown signs go where their node has another way on."""
    e = _ladder(spark, sf_dir, 9, F.floor(F.col("p_partkey") / 3) % 2).withColumn("symbol", F.when(F.col("edge_id") % 4 == 0, "*").otherwise(F.col("symbol")))
    return graph.without_unknown(e).select("edge_id", "level", "symbol")


@query(f"""WITH {_LADDER}, s AS (SELECT min(level) + max(level) AS s FROM e) SELECT edge_id, CAST(s - level AS INT) AS level, to_id AS from_id, from_id AS to_id FROM e, s""")
def reversed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reversed_graph(_ladder(spark, sf_dir)).select("edge_id", "level", "from_id", "to_id")


@query(f"""WITH RECURSIVE {sqs._BENCH}, raw AS (SELECT kmer AS w, substr(seq, CAST(i + 9 AS INT), 1) AS nx, CASE WHEN i > 1 THEN substr(seq, CAST(i - 1 AS INT), 1) ELSE '' END AS pv FROM (SELECT seq, i, substr(seq, CAST(i AS INT), 9) AS kmer FROM bench, unnest(range(1, greatest(length(seq) - 8, 0) + 1)) AS r(i)) x),
k AS (SELECT least(w, {revcomp_sql("w")}) AS kmer, CASE WHEN w <= {revcomp_sql("w")} THEN nx ELSE translate(pv, 'ACGT', 'TGCA') END AS r, CASE WHEN w <= {revcomp_sql("w")} THEN pv ELSE translate(nx, 'ACGT', 'TGCA') END AS l FROM raw),
both_ AS (SELECT DISTINCT kmer, least(substr(kmer, 2) || r, {revcomp_sql("substr(kmer, 2) || r")}) AS other FROM k WHERE r <> '' UNION SELECT DISTINCT kmer, least(l || substr(kmer, 1, 8), {revcomp_sql("l || substr(kmer, 1, 8)")}) FROM k WHERE l <> ''),
s AS (SELECT DISTINCT kmer FROM k WHERE kmer < 'AAAC'), w(start, kmer, steps) AS (SELECT kmer, kmer, 0 FROM s UNION SELECT w.start, b.other, steps + 1 FROM w JOIN both_ b ON b.kmer = w.kmer WHERE steps < 3)
SELECT start, kmer, CAST(min(steps) AS INT) AS steps FROM w GROUP BY 1, 2""")
def within_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = graph.de_bruijn(sqs._bench(spark, sf_dir).select("seq"), 9)
    return graph.within_steps(t, t.where("kmer < 'AAAC'"), 3)


@query()
def random_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks of five steps along the passages' k-mers; draws in proportion to coverage."""
    t = graph.de_bruijn(sqs._bench(spark, sf_dir).select("seq"), 9)
    return graph.random_walks(t, t.where("kmer < 'AAAC'"), 5)


@query(f"""WITH p AS (SELECT CAST(p_size % 2 AS VARCHAR) AS segment, p_brand AS h, p_size AS lv, {_sign_sql("ACGT_", "min(p_partkey)")} AS a FROM part GROUP BY 1, 2, 3), n AS (SELECT *, string_agg(a, '') OVER (PARTITION BY segment, h ORDER BY lv ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS k FROM p WHERE a <> '_'),
j AS (SELECT p.segment, p.h, p.lv, CASE WHEN length(k) = 4 THEN k ELSE '_' END AS symbol FROM p LEFT JOIN n ON p.segment = n.segment AND p.h = n.h AND p.lv = n.lv) SELECT segment AS graph, CAST(lv AS INT) AS level, symbol, CAST(sum(c) AS DOUBLE) AS count FROM (SELECT segment, lv, symbol, count(*) AS c FROM j GROUP BY 1, 2, 3) x GROUP BY 1, 2, 3""")
def panel_kmer_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-mer edges straight from brands as haplotypes, counted by level and k-mer."""
    p = table(spark, sf_dir, "part").groupBy((F.col("p_size") % 2).cast("string").alias("segment"), F.col("p_brand").alias("haplotype_id"), F.col("p_size").cast("int").alias("level")).agg(_sign("ACGT_", F.min("p_partkey")).alias("allele"))
    e = graph.kmer_graph_of_panel(p.withColumn("locus_id", F.concat(F.lit("L"), F.col("level").cast("string"))), 4)
    return e.groupBy("graph", "level", "symbol").agg(F.sum("count").alias("count"))


@query(f"""WITH g AS (SELECT {dna_sql("text")} AS s FROM benchmark WHERE length({dna_sql("text")}) >= 90 ORDER BY item_id LIMIT 1), r AS (SELECT i, substr(s, CAST(i * 3 + 1 AS INT), 40) AS w FROM g, unnest(range(0, 16)) AS q(i))
SELECT CAST(i AS VARCHAR) AS read_id, 80.0::DOUBLE AS score, i % 2 = 1 AS reverse, w AS g, w AS s, CAST(i * 3 AS INT) AS first_level, CAST(i * 3 + 39 AS INT) AS last_level FROM r""")
def seeded_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one passage, every other one turned round, on the graph of the passage."""
    from strandlake.operators import seeding

    g = table(spark, sf_dir, "benchmark").select("item_id", dna(F.col("text")).alias("s")).where("length(s) >= 90").orderBy("item_id").limit(1)
    edges = g.select(F.posexplode(F.split("s", "")).alias("i", "symbol")).select(F.col("i").alias("level"), F.col("i").cast("long").alias("from_id"), (F.col("i") + 1).cast("long").alias("to_id"), "symbol", F.col("i").cast("long").alias("edge_id"))
    w = F.expr("substring(s, i * 3 + 1, 40)")
    reads = g.select("s", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i")).select(F.col("i").cast("string").alias("read_id"), F.when(F.col("i") % 2 == 1, sq.revcomp(w)).otherwise(w).alias("seq"))
    out = seeding.seeded_reads(reads, edges, 15)
    return out.select("read_id", "score", "reverse", "g", "s", F.array_min("levels").alias("first_level"), F.array_max("levels").alias("last_level"))


ORACLE_SQL["compared_methods"] = " UNION ALL ".join(f"SELECT '{m}' AS method, * FROM ({ORACLE_SQL['genome_evaluation'].replace('FROM part)', f'FROM part WHERE {w})')}) AS {m}" for m, w in (("all_parts", "true"), ("odd_parts", "p_partkey % 2 = 1")))


def compared_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genome strings of all parts, and of every other one, as two methods."""
    counts = ag.kmer_counts(sqs._bench(spark, sf_dir), "seq", 5).withColumn("n", (F.col("n") % 9).cast("int"))
    key, size = F.col("p_partkey"), F.col("p_size")
    order = F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")) - 1
    odd = table(spark, sf_dir, "part").where(key % 2 == 1).select(F.col("p_brand").alias("chrom"), order.alias("seg_ord"), F.concat(_sign("ACGT", key), _sign("ACGTN", size), F.lit("_")).alias("a1"), F.when(key % 3 == 0, F.concat(_sign("ACGT", size), F.lit("TT"))).alias("a2"))
    out = variants.compared_methods({"all_parts": _segments(spark, sf_dir), "odd_parts": odd}, counts, 5, 2.5)
    return out.withColumns({"optimality": F.round("optimality", 8), "weighted": F.round("weighted", 8)})


QUERIES["compared_methods"] = compared_methods


@query(f"""WITH {_LADDER}, w AS (SELECT * FROM e WHERE level BETWEEN 10 AND 20) SELECT 'g' AS graph, lpad(CAST(level AS VARCHAR), 12, '0') || ':' || lpad(CAST(edge_id AS VARCHAR), 20, '0') AS at, '  n' || from_id || ' -> n' || to_id || ' [label="' || symbol || ' ' || CAST(cnt AS BIGINT) || '"];' AS line FROM w
UNION ALL SELECT DISTINCT 'g', '', 'digraph "g" {{' FROM w UNION ALL SELECT DISTINCT 'g', '~', '}}' FROM w""".replace(" AS at,", ' AS "at",'))
def graph_drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.drawing(_ladder(spark, sf_dir), 10, 20)


@query(f"""WITH RECURSIVE {_BUBBLES}, w AS (SELECT graph, replace(string_agg(symbol, '' ORDER BY level), '_', '') AS s FROM e WHERE edge_id % 2 = 1 OR (graph, level) NOT IN (SELECT (graph, level) FROM e WHERE edge_id % 2 = 1) GROUP BY graph),
q AS (SELECT conv_id * 1000 + turn AS id, {dna_sql("text")} AS seq FROM conversations UNION ALL SELECT -2 * CAST(graph AS BIGINT) - 1, s FROM w UNION ALL SELECT -2 * CAST(graph AS BIGINT) - 2, reverse(s) FROM w),
f AS (SELECT id, seq, graph, to_id AS node, 1 AS n FROM q JOIN e ON symbol = substr(seq, 1, 1) UNION SELECT id, seq, f.graph, e.to_id, n + CAST(symbol <> '_' AS INT) FROM f JOIN e ON e.graph = f.graph AND e.from_id = node AND symbol IN ('_', substr(seq, n + 1, 1))),
h AS (SELECT DISTINCT id FROM f WHERE n = length(seq)) SELECT id, seq, seq IS NOT NULL AND (seq = '' OR id IN (SELECT id FROM h)) AS present FROM q""")
def sequences_in_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns, and each passage's other way over bubbles and gaps, there and back, in the graphs of all passages."""
    edges = _bubbles(spark, sf_dir)
    way = edges.groupBy("graph", "level").agg(F.max_by("symbol", "edge_id").alias("symbol")).groupBy("graph").agg(F.translate(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("level", "symbol"))), lambda x: x["symbol"]), ""), "_", "").alias("s"))
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), dna(F.col("text")).alias("seq"))
    number = -2 * F.col("graph").cast("long")
    both = way.select(F.explode(F.array(F.struct((number - 1).alias("id"), F.col("s").alias("seq")), F.struct((number - 2).alias("id"), F.reverse("s").alias("seq")))).alias("x")).select("x.*")
    return graph.sequences_present(turns.unionByName(both), edges)


@query(f"""WITH s AS (SELECT CAST(item_id AS VARCHAR) AS chrom, {dna_sql("text")} AS seq FROM benchmark) SELECT chrom, substr(seq, 1, 9) || 'TTT' || substr(seq, 12, 28) || substr(seq, 41) AS seq FROM s""")
def amended_haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with two calls each that fit, an insertion and a deletion, and one that does not."""
    s = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("chrom"), dna(F.col("text")).alias("seq"))
    call = lambda pos, ref, alt: F.struct(F.lit(pos).alias("pos"), ref.alias("ref"), alt.alias("alt"))
    calls = s.select("chrom", F.explode(F.array(call(10, F.substr("seq", F.lit(10), F.lit(2)), F.lit("TTT")), call(40, F.substr("seq", F.lit(40), F.lit(1)), F.lit("")), call(60, F.lit("NN"), F.lit("A")))).alias("c")).select("chrom", "c.*")
    return variants.amended(s, calls)


@query(f"""WITH c AS (SELECT chrom, CAST(i AS INT) AS i, substr(h, CAST(i AS INT), 1) AS b, i % 10 = 1 AND i // 50 % 2 = 0 AS open FROM (SELECT CAST(item_id AS VARCHAR) AS chrom, {dna_sql("text")} AS h FROM benchmark) s, unnest(range(1, length(h) + 1)) AS r(i)),
o AS (SELECT *, CASE WHEN open THEN translate(b, 'ACGT', 'CATG') ELSE b END AS other, i // 50 // 2 % 2 = 1 AS turned FROM c)
SELECT chrom, string_agg(CASE WHEN turned THEN other ELSE b END, '' ORDER BY i) AS h1, string_agg(CASE WHEN turned THEN b ELSE other END, '' ORDER BY i) AS h2, 1.0::DOUBLE AS support FROM o GROUP BY 1""")
def phased_haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole passages and copies of them that differ at every tenth base of every other fifty, the alleles in alternating order, put in phase by their own k-mers; each fifty is a part, and what is first there decides which haplotype is."""
    s = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("chrom"), dna(F.col("text")).alias("h"))
    at = F.col("at") + 1
    open_ = lambda i: (i % 10 == 1) & (F.floor(i / 50) % 2 == 0)
    turned = (F.floor(at / 50 / 2) % 2 == 1) != (F.floor(at % 50 / 10) % 2 == 1)
    bases = s.select("chrom", F.posexplode(F.split("h", "")).alias("at", "b")).where("b <> ''")
    other = F.translate("b", "ACGT", "CATG")
    segments = bases.select("chrom", F.col("at").alias("seg_ord"), F.when(open_(at) & turned, other).otherwise(F.col("b")).alias("a1"), F.when(open_(at), F.when(turned, F.col("b")).otherwise(other)).alias("a2"))
    copy = F.array_join(F.transform(F.split("h", ""), lambda x, i: F.when(open_(i + 1), F.translate(x, "ACGT", "CATG")).otherwise(x)), "")
    counts = s.select("chrom", F.explode(F.array(F.col("h"), copy)).alias("t")).select("chrom", F.explode(sq.kmers(F.col("t"), 12)).alias("kmer")).groupBy("chrom", "kmer").agg(F.count("*").alias("n"))
    return variants.phased(segments, counts, 12)


@query(f"""WITH s AS (SELECT item_id, {dna_sql("text")} AS seq FROM benchmark), g AS (SELECT CAST(item_id AS VARCHAR) || c AS graph, seq FROM s, unnest(['a', 'b']) AS u(c) WHERE c = 'a' OR item_id % 2 = 0),
m AS (SELECT item_id AS pair, 1 AS mate, substr(seq, 1, 40) AS q FROM s UNION ALL SELECT item_id, 2, {revcomp_sql("substr(seq, length(seq) - 39)")} FROM s), b AS (SELECT pair, mate, '+' AS strand, q FROM m UNION ALL SELECT pair, mate, '-', {revcomp_sql("q")} FROM m),
k AS (SELECT pair, mate, strand, i - 1 AS pos, substr(q, CAST(i AS INT), 15) AS kmer FROM b, unnest(range(1, greatest(length(q) - 14, 0) + 1)) AS r(i)), x AS (SELECT graph, i - 1 AS level, substr(seq, CAST(i AS INT), 15) AS kmer FROM g, unnest(range(1, greatest(length(seq) - 14, 0) + 1)) AS r(i)),
h AS (SELECT *, pos - row_number() OVER (PARTITION BY pair, mate, strand, graph, level - pos ORDER BY pos) AS run FROM k JOIN x USING (kmer)), c AS (SELECT pair, mate, strand, graph, level - pos AS d, run, min(pos) AS first_pos, min(level) AS pos, count(*) AS n FROM h GROUP BY ALL),
l AS (SELECT c.*, least(n + 14, 40) * ln(0.99) + (40 - least(n + 14, 40)) * ln(0.01 / 3) AS ll FROM c), t AS (SELECT * FROM (SELECT *, max(ll) OVER (PARTITION BY pair, mate) AS best FROM l) y WHERE ll >= best - 12),
a AS (SELECT *, row_number() OVER (PARTITION BY pair, mate ORDER BY ll DESC, strand, graph, pos, first_pos) - 1 AS aln FROM t),
p AS (SELECT x.pair, x.graph, CAST(x.aln AS INT) AS a1, CAST(y.aln AS INT) AS a2, x.ll + y.ll + ln(exp(-pow(least(abs(abs(y.pos - x.pos) - 200.0) / 60.0, 8.0), 2) / 2) / (60.0 * sqrt(2 * pi()))) AS score FROM a AS x JOIN a AS y ON x.pair = y.pair AND x.graph = y.graph AND x.mate = 1 AND y.mate = 2 AND x.strand <> y.strand),
e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY pair)) AS e FROM p) SELECT pair, graph, a1, a2, round(score, 6) AS score, round(e / sum(e) OVER (PARTITION BY pair), 8) AS mapq FROM e""")
def paired_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends of all passages as mates, against graphs of all passages, every other one twice: its places share the pair's confidence."""
    s = sqs._bench(spark, sf_dir)
    g = s.select(F.explode(F.when(F.col("item_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))).alias("c"), "item_id", "seq")
    index = g.select(F.concat(F.col("item_id").cast("string"), "c").alias("graph"), F.posexplode(sq.kmers(F.col("seq"), 15)).alias("level", "kmer"))
    n = F.length("seq")
    mates = s.select(F.col("item_id").alias("pair"), F.explode(F.array(F.struct(F.lit(1).alias("mate"), F.substr("seq", F.lit(1), F.lit(40)).alias("q")), F.struct(F.lit(2).alias("mate"), sq.revcomp(F.substr("seq", n - 39, F.lit(40))).alias("q")))).alias("m")).select("pair", "m.*")
    strands = mates.select("pair", "mate", F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("q").alias("seq")), F.struct(F.lit("-").alias("strand"), sq.revcomp(F.col("q")).alias("seq")))).alias("x")).select(F.struct("pair", "mate", "x.strand").alias("read_id"), "x.seq")
    chains = align.seed_chains(strands, index, 15)
    rows = chains.select("read_id.*", "graph", "first_pos", (F.col("first_pos") + F.col("n") - 1).alias("last_pos"), "first_level", (F.col("first_level") + F.col("n") - 1).alias("last_level"), "n")
    found = ty.chain_candidates(rows, mates.select("pair", "mate", F.length("q").alias("length")), 15)
    return ty.resolve_in_graphs(found, 200.0, 60.0).withColumns({"score": F.round("score", 6), "mapq": F.round("mapq", 8)})


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as haplotypes of two segments, sizes as levels; both are fixed lists of the tables."""
    p = table(spark, sf_dir, "part")
    cells = p.groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("k"))
    grid = p.select("p_brand").distinct().crossJoin(F.broadcast(p.select("p_size").distinct())).join(cells, ["p_brand", "p_size"], "left")
    level = F.floor(F.col("p_size") / 2).cast("int")
    return grid.select((F.col("p_size") % 2).cast("string").alias("segment"), F.col("p_brand").alias("haplotype_id"), F.concat(F.lit("L"), level.cast("string")).alias("locus_id"), level.alias("level"), _sign("ACG", F.coalesce("k", F.lit(0)) % 2 + F.col("p_size") % 2).alias("allele"))


@query()
def panel_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs of the brands that have all sizes; joining nodes is a sequence of decisions that SQL does not express."""
    return graph.graph_of_panel(_panel(spark, sf_dir), 3)


@query(f"""WITH RECURSIVE {_LADDER.replace("k <= 3", "k <= 9").replace("p_partkey % 3 % 2", "p_partkey // 3 % 2")}, k AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY level) AS n FROM e) x WHERE n < 5 OR edge_id % 40 IN (SELECT o_custkey % 40 FROM orders WHERE o_custkey % 40 NOT IN (3, 4, 17))),
a AS (SELECT edge_id, from_id FROM k WHERE level = (SELECT max(level) FROM k) UNION SELECT k.edge_id, k.from_id FROM a JOIN k ON k.to_id = a.from_id)
SELECT 'g' AS graph, level, edge_id, from_id, to_id, 'L' || level AS locus_id, symbol, cnt AS count FROM k WHERE edge_id IN (SELECT edge_id FROM a)""")
def pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ladder of nine edges a level less those whose k-mers the orders do not show; no level loses all its edges here, so none is put back."""
    e = _ladder(spark, sf_dir, 9, F.floor(F.col("p_partkey") / 3) % 2)
    name = lambda c: F.concat(F.lit("k"), c.cast("string"))
    seen = table(spark, sf_dir, "orders").select(name(F.col("o_custkey") % 40).alias("kmer")).where("kmer NOT IN ('k3', 'k4', 'k17')").distinct()
    return graph.pruned(e, e.select("graph", "edge_id", name(F.col("edge_id") % 40).alias("kmer")), seen, 5)


def _haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("hap_id"), F.repeat(dna(F.col("text")), F.lit(3)).alias("seq"))


@query()
def simulated_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read pairs from mutated passages, drawn from a seed and each haplotype's name."""
    return simulate.simulated_reads(simulate.perturbed(_haplotypes(spark, sf_dir), 0.01), 10)


@query()
def random_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.random_paths(graph.trimmed(_ladder(spark, sf_dir, 9, F.floor(F.col("p_partkey") / 3) % 2)), 5)


@query()
def error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error rate by expectation and maximisation on orders a customer as counts."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").cast("int").alias("n")).select("n")
    rate = hmm.error_rate(n, 20.0)
    return spark.range(1).select(F.lit(rate).alias("error_rate"))


@query()
def tied_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best paths through states that all score alike, and the others that are as good."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("sample"), F.explode(F.sequence(F.lit(0), F.col("n_nationkey") % 3)).alias("level"), F.lit(0.0).alias("ll"), F.lit(-1.0).alias("start"))
    states = n.withColumn("state", F.explode(F.array(F.lit("a"), F.lit("b"))))
    steps = spark.range(3).select(F.col("id").cast("int").alias("level"), F.explode(F.array(*[F.struct(F.lit(x).alias("from_state"), F.lit(y).alias("to_state"), F.lit(0.5).alias("p")) for x in "ab" for y in "ab"])).alias("t")).select("level", "t.*")
    return hmm.decode(states, steps, ties=10)
