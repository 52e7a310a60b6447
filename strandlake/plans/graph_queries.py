"""Queries of graphs, alignment, variants and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import align, graph, simulate, validate, variants
from strandlake.operators import typing as ty
from strandlake.plans.tables import dna, dna_sql, kmers_sql, revcomp_sql, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_EDGES = "e AS (SELECT p_mfgr AS graph, CAST(p_size AS INT) AS level, p_partkey AS edge_id, p_size * 10 + p_partkey % 3 AS from_id, (p_size + 1) * 10 + p_partkey % 4 % 3 AS to_id, 'L' || p_size AS locus_id, substr('ACGT_', CAST(p_partkey % 5 + 1 AS INT), 1) AS symbol, p_retailprice AS count FROM (SELECT *, substr(p_brand, length(p_brand), 1) AS p_mfgr FROM part) x)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as edges: the last sign of the brand as the graph, sizes as levels with three nodes each."""
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.expr("right(p_brand, 1)").alias("graph"),
        size.cast("int").alias("level"),
        key.alias("edge_id"),
        (size * 10 + key % 3).alias("from_id"),
        ((size + 1) * 10 + key % 4 % 3).alias("to_id"),
        F.concat(F.lit("L"), size.cast("string")).alias("locus_id"),
        F.substr(F.lit("ACGT_"), (key % 5 + 1).cast("int"), F.lit(1)).alias("symbol"),
        F.col("p_retailprice").alias("count"),
    )


@query(f"""WITH {_EDGES}, o AS (SELECT graph, from_id AS node, sum(count) AS s FROM e GROUP BY 1, 2), i AS (SELECT graph, to_id AS node, sum(count) AS s FROM e GROUP BY 1, 2)
SELECT coalesce(o.graph, i.graph) AS graph, coalesce(o.node, i.node) AS node, round(coalesce(o.s, 0), 4) AS outgoing, round(coalesce(i.s, 0), 4) AS incoming FROM o FULL JOIN i ON o.graph = i.graph AND o.node = i.node""")
def node_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.node_sums(_edges(spark, sf_dir)).withColumns({"outgoing": F.round("outgoing", 4), "incoming": F.round("incoming", 4)})


@query(f"""WITH {_EDGES}, s AS (SELECT graph, max(level) + 1 AS l, max(to_id) + 1 AS n, max(edge_id) + 1 AS k, max(level) AS last FROM e GROUP BY graph),
o AS (SELECT graph, last, coalesce(sum(l) OVER w, 0) AS ol, coalesce(sum(n) OVER w, 0) AS no, coalesce(sum(k) OVER w, 0) AS ok, n, lead(graph) OVER (ORDER BY graph) IS NULL AS final FROM s WINDOW w AS (ORDER BY graph ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT 'all' AS graph, CAST(level + ol AS INT) AS level, CAST(edge_id + ok AS BIGINT) AS edge_id, CAST(from_id + no AS BIGINT) AS from_id, CAST(CASE WHEN level = last AND NOT final THEN no + n ELSE to_id + no END AS BIGINT) AS to_id, locus_id, symbol, count FROM e JOIN o ON e.graph = o.graph""")
def concatenated_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.concatenated(_edges(spark, sf_dir))


@query(f"""WITH {_EDGES}, n AS (SELECT graph, from_id AS node, level AS lv FROM e UNION SELECT graph, to_id, level + 1 FROM e), p AS (SELECT graph, min(level) AS a, max(level) AS b FROM e GROUP BY graph),
x AS (SELECT n.graph, 'dead end' AS problem FROM n JOIN p ON n.graph = p.graph WHERE lv <= b AND NOT EXISTS (SELECT 1 FROM e WHERE e.graph = n.graph AND from_id = node)
UNION ALL SELECT n.graph, 'no way in' FROM n JOIN p ON n.graph = p.graph WHERE lv > a AND NOT EXISTS (SELECT 1 FROM e WHERE e.graph = n.graph AND to_id = node))
SELECT graph, problem, count(*) AS n FROM x GROUP BY 1, 2""")
def graph_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.problems(_edges(spark, sf_dir))


_READS = f"reads AS (SELECT item_id, {dna_sql('text')} AS seq FROM benchmark)"


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", dna(F.col("text")).alias("seq"))


@query(f"WITH {_READS} SELECT least(kmer, {revcomp_sql('kmer')}) AS kmer, count(*) AS coverage FROM ({kmers_sql('reads', 'item_id', 'seq', 11)}) x GROUP BY 1")
def de_bruijn_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.de_bruijn(_reads(spark, sf_dir), 11).select("kmer", "coverage")


@query()
def supernodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unbranched runs of the passages' k-mers; an iteration that SQL does not express."""
    return graph.supernodes(graph.de_bruijn(_reads(spark, sf_dir), 11))


@query(f"""WITH {_READS}, t AS (SELECT least(kmer, {revcomp_sql("kmer")}) AS kmer, count(*) AS coverage FROM ({kmers_sql("reads", "item_id", "seq", 9)}) x GROUP BY 1), c AS (SELECT conv_id * 1000 + turn AS seq_id, {dna_sql("text")} AS seq FROM conversations),
k AS (SELECT seq_id, least(kmer, {revcomp_sql("kmer")}) AS kmer FROM ({kmers_sql("c", "seq_id", "seq", 9)}) x)
SELECT seq_id, count(*) AS n, count(t.kmer) AS present, CAST(0 AS BIGINT) AS invalid, round(avg(coalesce(coverage, 0)), 9) AS mean_coverage FROM k LEFT JOIN t ON k.kmer = t.kmer GROUP BY seq_id""")
def sequence_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq_id"), dna(F.col("text")).alias("seq"))
    return graph.presence(c, graph.de_bruijn(_reads(spark, sf_dir), 9), 9).withColumn("mean_coverage", F.round("mean_coverage", 9))


@query()
def nw_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of suppliers against those of their nations; a dynamic program that SQL does not express."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return align.aligned_pairs(s.select("s_suppkey", F.col("s_name").alias("a"), F.col("n_name").alias("b")), "s_suppkey")


@query("""SELECT p_size AS level, count(*) AS induced, sum(CAST(p_partkey % 9 = 0 AS INT)) AS invalid, sum(CAST(p_retailprice > 1000 AS INT)) AS ok, sum(CAST(p_brand LIKE '%1' AS INT)) AS in_reference FROM part GROUP BY 1""")
def spatial_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("level"), (F.col("p_partkey") % 9 != 0).alias("valid"), (F.col("p_retailprice") > 1000).alias("present"), F.col("p_brand").endswith("1").alias("in_reference"))
    return variants.spatial_summary(p, ["level"])


@query("""WITH c AS (SELECT l_linenumber AS pos, substr('ACGT', CAST(l_partkey % 4 + 1 AS INT), 1) AS allele, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY pos) AS coverage FROM c)
SELECT pos, allele, n, CAST(coverage AS BIGINT) AS coverage FROM t WHERE coverage >= 30 AND n >= 0.2 * coverage AND allele NOT IN ('A', 'G')""")
def unaccounted_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("pos"), F.substr(F.lit("ACGT"), (F.col("l_partkey") % 4 + 1).cast("int"), F.lit(1)).alias("allele")).agg(F.count("*").alias("n"))
    called = c.select("pos").distinct().withColumn("allele", F.explode(F.array(F.lit("A"), F.lit("G"))))
    return ty.unaccounted(c, called, ["pos"])


@query("""WITH s AS (SELECT DISTINCT 'k' || p_size AS kmer FROM part WHERE p_size % 3 = 0) SELECT p_brand, round(avg(CASE WHEN s.kmer IS NOT NULL AND p_partkey % 10 <> 0 THEN 1.0 ELSE 0.0 END), 9) AS share
FROM part LEFT JOIN s ON s.kmer = 'k' || p_size GROUP BY p_brand""")
def called_kmers_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = F.concat(F.lit("k"), F.col("p_size").cast("string"))
    called = p.select("p_brand", F.when(F.col("p_partkey") % 10 == 0, F.concat(name, F.lit("*"))).otherwise(name).alias("kmer"))
    return ty.called_kmers_present(called, p.where("p_size % 3 = 0").select(name.alias("kmer")).distinct(), ["p_brand"]).withColumn("share", F.round("share", 9))


@query("""WITH c AS (SELECT o_orderkey, CAST(o_orderkey % 5 + 1 AS VARCHAR) AS a1, CAST(o_custkey % 5 + 1 AS VARCHAR) AS a2, substr(o_orderpriority, 1, 1) AS t1, CAST(o_orderkey % 3 + 1 AS VARCHAR) AS t2, o_orderstatus AS locus, o_totalprice / 600000 AS q FROM orders),
r AS (SELECT *, greatest(CAST(a1 = t1 AS INT) + CAST(a2 = t2 AS INT), CAST(a1 = t2 AS INT) + CAST(a2 = t1 AS INT)) AS ok FROM c)
SELECT locus, count(*) AS n, round(avg(CAST(q >= 0.3 AS INT)), 9) AS call_rate, round(sum(CASE WHEN q >= 0.3 THEN ok END) / sum(CASE WHEN q >= 0.3 THEN 2 END), 9) AS accuracy FROM r GROUP BY locus""")
def typing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    name = [key.cast("string").alias("individual_id"), F.col("o_orderstatus").alias("locus")]
    calls = o.select(*name, (key % 5 + 1).cast("string").alias("a1"), (F.col("o_custkey") % 5 + 1).cast("string").alias("a2"), (F.col("o_totalprice") / 600000).alias("q"))
    truth = o.select(*name, F.substr("o_orderpriority", F.lit(1), F.lit(1)).alias("t1"), (key % 3 + 1).cast("string").alias("t2"))
    by_locus, _ = validate.type_report(calls, truth, 0.3)
    return by_locus.withColumns({"call_rate": F.round("call_rate", 9), "accuracy": F.round("accuracy", 9)})


@query("""WITH m AS (SELECT repeat('ACGTTGCA', CAST(max(p_partkey) // 3 AS INT) + 2) AS seq FROM part), c AS (SELECT CAST(i AS VARCHAR) AS chrom, seq FROM m, unnest([1, 2, 3]) AS r(i)),
r AS (SELECT CAST(p_partkey % 3 + 1 AS VARCHAR) AS chrom, CAST(p_partkey // 3 * 8 + 3 AS INT) AS pos, CASE WHEN p_partkey % 2 = 0 THEN 'GT' ELSE 'G' END AS a1, CASE WHEN p_partkey % 5 = 0 THEN 'GTTA' ELSE 'GT' END AS a2 FROM part),
o AS (SELECT r.*, seq, coalesce(lag(pos + 2) OVER w, 1) AS f, lead(pos) OVER w AS nx, greatest(length(a1), length(a2)) AS n FROM r JOIN c ON r.chrom = c.chrom WINDOW w AS (PARTITION BY r.chrom ORDER BY pos)),
s AS (SELECT chrom, pos * 3 - 1 AS k, CAST(f AS BIGINT) AS pos, substr(seq, f, pos - f) AS a1, NULL AS a2 FROM o UNION ALL SELECT chrom, pos * 3, pos, rpad(a1, CAST(n AS INT), '_'), CASE WHEN a1 <> a2 THEN rpad(a2, CAST(n AS INT), '_') END FROM o
UNION ALL SELECT chrom, pos * 3 + 1, pos + 2, substr(seq, pos + 2), NULL FROM o WHERE nx IS NULL UNION ALL SELECT chrom, 0, 1, seq, NULL FROM c WHERE chrom NOT IN (SELECT chrom FROM r))
SELECT chrom, CAST(row_number() OVER (PARTITION BY chrom ORDER BY k) - 1 AS INT) AS seg_ord, pos, a1, a2 FROM s WHERE a1 <> ''""")
def variant_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genome strings of three made-up chromosomes with parts as their records."""
    p = table(spark, sf_dir, "part")
    size = p.agg(F.max("p_partkey").alias("m"))  # one row
    ref = size.select(F.explode(F.sequence(F.lit(1), F.lit(3)).cast("array<string>")).alias("chrom"), F.expr("repeat('ACGTTGCA', cast(m / 3 as int) + 2)").alias("seq"))
    key = F.col("p_partkey")
    rec = p.select((key % 3 + 1).cast("string").alias("chrom"), (F.floor(key / 3) * 8 + 3).cast("int").alias("pos"), F.lit("GT").alias("ref"), F.when(key % 2 == 0, "GT").otherwise("G").alias("a1"), F.when(key % 5 == 0, "GTTA").otherwise("GT").alias("a2"))
    return variants.records_to_segments(rec, ref)


@query("""WITH g AS (SELECT o_custkey, o_orderkey, o_orderstatus AS a1, substr(o_orderpriority, 1, 1) AS a2, CAST('0x' || substr(md5('1|' || o_custkey || '|' || o_orderkey), 1, 8) AS BIGINT) % 2 = 1 AS flip FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS individual_id, CAST(o_orderkey AS VARCHAR) AS locus_id, CASE WHEN flip THEN a2 ELSE a1 END AS h1, CASE WHEN flip THEN a1 ELSE a2 END AS h2 FROM g""")
def random_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("individual_id"), F.col("o_orderkey").cast("string").alias("locus_id"), F.col("o_orderstatus").alias("a1"), F.substr("o_orderpriority", F.lit(1), F.lit(1)).alias("a2"))
    return simulate.phased_at_random(g)
