"""Queries of typing, decoding and graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import filters as fl
from strandlake.operators import hmm
from strandlake.operators import typing as ty
from strandlake.operators.long_decode import decode_long
from strandlake.plans.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- typing: segments as loci, six clusters of ten positions, orders as reads


def _alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    loci = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("locus")).distinct()
    c, p = F.col("cluster"), F.col("pos")
    grid = spark.range(60).select((F.col("id") / 10).cast("int").alias("cluster"), (F.col("id") % 10).cast("int").alias("pos"))
    base = F.substr(F.lit("ACGT"), ((c * 7 + p * 3 + c * p % 5) % 4 + 1).cast("int"), F.lit(1))
    return loci.crossJoin(F.broadcast(grid)).select("locus", "cluster", "pos", base.alias("base"))


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    r = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return r.select(F.col("c_mktsegment").alias("locus"), F.col("l_orderkey").alias("read"), (F.col("l_linenumber") % 10).alias("pos"), F.substr(F.lit("ACGT"), (F.col("l_partkey") % 4 + 1).cast("int"), F.lit(1)).alias("genotype"), (1 - F.col("l_discount") - 0.002).alias("p"))


_TYPING = """al AS (SELECT c_mktsegment AS locus, CAST(c AS INT) AS cluster, CAST(p AS INT) AS pos, substr('ACGT', CAST((c * 7 + p * 3 + c * p % 5) % 4 + 1 AS INT), 1) AS base FROM (SELECT DISTINCT c_mktsegment FROM customer) x, unnest(range(0, 6)) AS r(c), unnest(range(0, 10)) AS q(p)),
ob AS (SELECT c_mktsegment AS locus, l_orderkey AS read, l_linenumber % 10 AS pos, substr('ACGT', CAST(l_partkey % 4 + 1 AS INT), 1) AS genotype, 1 - l_discount - 0.002 AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
ll AS (SELECT ob.locus, cluster, read, sum(ln(0.998) + CASE WHEN base = genotype THEN ln(least(p, 0.999)) ELSE ln((1 - least(p, 0.999)) / 3) END) AS ll, sum(CAST(base <> genotype AS INT)) AS mismatches FROM ob JOIN al ON ob.locus = al.locus AND ob.pos = al.pos GROUP BY 1, 2, 3),
pr AS (SELECT a.locus, a.cluster AS c1, b.cluster AS c2, sum(ln(0.5 * (exp(a.ll) + exp(b.ll)))) AS ll, sum((a.mismatches + b.mismatches) / 2) AS mean_mismatches, sum(least(a.mismatches, b.mismatches)) AS min_mismatches FROM ll a JOIN ll b ON a.locus = b.locus AND a.read = b.read AND a.cluster <= b.cluster GROUP BY 1, 2, 3),
mx AS (SELECT *, exp(ll - max(ll) OVER (PARTITION BY locus)) AS e FROM pr), sm AS (SELECT *, e / sum(e) OVER (PARTITION BY locus) AS p FROM mx)"""


@query(f"WITH {_TYPING} SELECT locus, cluster, read, round(ll, 6) AS ll, mismatches FROM ll")
def read_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ty.read_likelihoods(_observations(spark, sf_dir), _alleles(spark, sf_dir))
    return out.withColumn("ll", F.round("ll", 6))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ty.pair_likelihoods(ty.read_likelihoods(_observations(spark, sf_dir), _alleles(spark, sf_dir)))


@query(f"WITH {_TYPING} SELECT locus, c1, c2, round(ll, 3) AS ll, round(mean_mismatches, 3) AS mean_mismatches, min_mismatches, round(p, 6) AS p FROM sm")
def pair_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumns({"ll": F.round("ll", 3), "mean_mismatches": F.round("mean_mismatches", 3), "p": F.round("p", 6)})


@query(f"WITH {_TYPING}, m AS (SELECT locus, c1 AS cluster, p FROM sm UNION ALL SELECT locus, c2, p FROM sm WHERE c1 <> c2) SELECT locus, cluster, round(sum(p), 6) AS p FROM m GROUP BY 1, 2")
def allele_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ty.allele_marginals(_pairs(spark, sf_dir)).withColumn("p", F.round("p", 6))


@query(f"WITH {_TYPING}, r AS (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY ll DESC, mean_mismatches, c1, c2) AS k FROM sm) SELECT locus, CAST(k AS INT) AS rank, c1, c2, round(p, 6) AS p FROM r WHERE k <= 10")
def best_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ty.best_pairs(_pairs(spark, sf_dir), 10).select("locus", "rank", "c1", "c2", F.round("p", 6).alias("p"))


@query(f"""WITH {_TYPING}, m AS (SELECT locus, cluster, sum(p) AS p FROM (SELECT locus, c1 AS cluster, p FROM sm UNION ALL SELECT locus, c2, p FROM sm WHERE c1 <> c2) x GROUP BY 1, 2),
f AS (SELECT locus, cluster AS first, p AS q1 FROM (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY p DESC, cluster) AS k FROM m) x WHERE k = 1),
s AS (SELECT f.locus, first, q1, CASE WHEN c1 = first THEN c2 ELSE c1 END AS second, p, min_mismatches FROM sm JOIN f ON sm.locus = f.locus AND (c1 = first OR c2 = first))
SELECT locus, first, round(q1, 6) AS q1, second, round(p, 6) AS q2 FROM (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY p DESC, min_mismatches, second) AS k FROM s) x WHERE k = 1""")
def allele_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ty.first_and_second(_pairs(spark, sf_dir))
    return out.withColumns({"q1": F.round("q1", 6), "q2": F.round("q2", 6)})


# --- the whole chain on alleles of two exons, with gaps and insertions in the reads

_CHAIN = """lo(locus, ex) AS (VALUES ('A', 'exon_2'), ('A', 'exon_3'), ('DQB1', 'exon_2')),
al AS (SELECT locus, ex AS exon, locus || '*' || lpad(CAST(a AS VARCHAR), 2, '0') AS allele, locus || '_' || ex || '_' || p AS locus_id, CAST(p AS INT) AS exon_pos,
  CASE WHEN p = 7 AND a % 3 = 1 THEN '_' ELSE substr('ACGT', CAST((a // 2 * 7 + p * 3 + a // 2 * p % 5) % 4 + 1 AS INT), 1) END AS base FROM lo, unnest(range(0, 8)) AS r(a), unnest(range(0, 12)) AS q(p)),
lv AS (SELECT locus_id, CAST(row_number() OVER (ORDER BY locus_id) + 99 AS INT) AS level FROM (SELECT DISTINCT locus_id FROM al) x),
ce AS (SELECT al.locus, allele, CAST(substr(exon, 6) AS INT) - 2 AS exon_ord, exon_pos, CAST((CAST(substr(exon, 6) AS INT) - 2) * 12 + exon_pos AS INT) AS pos, level, base FROM al JOIN lv ON al.locus_id = lv.locus_id),
sq AS (SELECT locus, allele, string_agg(base, '' ORDER BY pos) AS seq FROM ce GROUP BY 1, 2), fi AS (SELECT locus, seq, min(allele) AS f FROM sq GROUP BY 1, 2),
cl AS (SELECT sq.locus, allele, CAST(dense_rank() OVER (PARTITION BY sq.locus ORDER BY f) - 1 AS INT) AS cluster FROM sq JOIN fi ON sq.locus = fi.locus AND sq.seq = fi.seq),
ob AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 'DQB1' ELSE 'A' END AS locus, l_orderkey AS read, CAST((l_orderkey // 3 + l_linenumber * 5) % (CASE WHEN l_orderkey % 3 = 0 THEN 12 ELSE 24 END) AS INT) AS pos,
  CASE l_partkey % 11 WHEN 0 THEN '_' WHEN 1 THEN 'AC' ELSE substr('ACGT', CAST(l_suppkey % 4 + 1 AS INT), 1) END AS genotype, 1 - l_discount - 0.002 AS p, 1 - l_tax * 5 AS mapq_position FROM lineitem),
ga AS (SELECT * FROM ob WHERE mapq_position >= 0.7), co AS (SELECT locus, pos, genotype, count(*) AS n FROM ga GROUP BY 1, 2, 3), tc AS (SELECT *, sum(n) OVER (PARTITION BY locus, pos) AS t FROM co),
us AS (SELECT ga.* FROM ga JOIN tc ON ga.locus = tc.locus AND ga.pos = tc.pos AND ga.genotype = tc.genotype WHERE t < 100 OR n >= 0.2 * t),
cb AS (SELECT DISTINCT cl.locus, cluster, pos, base FROM cl JOIN ce ON cl.locus = ce.locus AND cl.allele = ce.allele),
ll AS (SELECT us.locus, cluster, read, sum(CASE WHEN base = '_' THEN CASE WHEN genotype = '_' THEN 0 ELSE length(genotype) * (ln(0.001) + ln(0.25)) END
  ELSE CASE WHEN genotype = '_' THEN ln(0.001) ELSE ln(0.998) + CASE WHEN base = substr(genotype, 1, 1) THEN ln(least(p, 0.999)) ELSE ln((1 - least(p, 0.999)) / 3) END END + (length(genotype) - 1) * (ln(0.001) + ln(0.25)) END) AS ll,
  sum(CAST(genotype <> '_' AND base <> genotype AS INT)) AS mismatches FROM us JOIN cb ON us.locus = cb.locus AND us.pos = cb.pos GROUP BY 1, 2, 3),
pr AS (SELECT a.locus, a.cluster AS c1, b.cluster AS c2, sum(greatest(a.ll, b.ll) + ln((1 + exp(-abs(a.ll - b.ll))) / 2)) AS ll, sum(least(a.mismatches, b.mismatches)) AS min_mismatches FROM ll a JOIN ll b ON a.locus = b.locus AND a.read = b.read AND a.cluster <= b.cluster GROUP BY 1, 2, 3),
mx AS (SELECT *, exp(ll - max(ll) OVER (PARTITION BY locus)) AS e FROM pr), sm AS (SELECT *, e / sum(e) OVER (PARTITION BY locus) AS p FROM mx),
ma AS (SELECT locus, cluster, sum(p) AS p FROM (SELECT locus, c1 AS cluster, p FROM sm UNION ALL SELECT locus, c2, p FROM sm WHERE c1 <> c2) x GROUP BY 1, 2),
f1 AS (SELECT locus, cluster AS first, p AS q1 FROM (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY p DESC, cluster) AS k FROM ma) x WHERE k = 1),
s2 AS (SELECT f1.locus, first, q1, CASE WHEN c1 = first THEN c2 ELSE c1 END AS second, p, min_mismatches FROM sm JOIN f1 ON sm.locus = f1.locus AND (c1 = first OR c2 = first)),
ty AS (SELECT locus, first, q1, second, p AS q2 FROM (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY p DESC, min_mismatches, second) AS k FROM s2) x WHERE k = 1)"""


def _exon_cells(spark: SparkSession) -> DataFrame:
    """Exon files' cells of two loci: eight alleles, twelve places an exon."""
    grid = spark.createDataFrame([("A", "exon_2"), ("A", "exon_3"), ("DQB1", "exon_2")], "locus string, exon string").crossJoin(spark.range(96).select((F.col("id") / 12).cast("int").alias("a"), (F.col("id") % 12).cast("int").alias("exon_pos")))  # 288 rows
    half = F.floor(F.col("a") / 2)
    base = F.when((F.col("exon_pos") == 7) & (F.col("a") % 3 == 1), "_").otherwise(F.substr(F.lit("ACGT"), ((half * 7 + F.col("exon_pos") * 3 + half * F.col("exon_pos") % 5) % 4 + 1).cast("int"), F.lit(1)))
    name = F.concat("locus", F.lit("*"), F.lpad(F.col("a").cast("string"), 2, "0"))
    return grid.select("locus", "exon", name.alias("allele"), F.concat_ws("_", "locus", "exon", F.col("exon_pos").cast("string")).alias("locus_id"), "exon_pos", base.alias("base"))


def _levels(cells: DataFrame) -> DataFrame:
    from pyspark.sql import Window as W

    return cells.select("locus_id").distinct().withColumn("level", F.row_number().over(W.orderBy("locus_id")) + 99)  # a row for each place


def _chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    cells = _exon_cells(spark)
    placed = ty.exon_levels(cells, _levels(cells), ty.exon_table(spark))
    clusters = ty.allele_clusters(placed)
    bases = clusters.join(placed, ["locus", "allele"]).select("locus", "cluster", "pos", "base").distinct()
    key, second = F.col("l_orderkey"), F.col("l_orderkey") % 3 == 0
    genotype = F.when(F.col("l_partkey") % 11 == 0, "_").when(F.col("l_partkey") % 11 == 1, "AC").otherwise(F.substr(F.lit("ACGT"), (F.col("l_suppkey") % 4 + 1).cast("int"), F.lit(1)))
    ob = table(spark, sf_dir, "lineitem").select(
        F.when(second, "DQB1").otherwise("A").alias("locus"), key.alias("read"), ((F.floor(key / 3) + F.col("l_linenumber") * 5) % F.when(second, 12).otherwise(24)).cast("int").alias("pos"), genotype.alias("genotype"), (1 - F.col("l_discount") - 0.002).alias("p"), (1 - F.col("l_tax") * 5).alias("mapq_position")
    )
    return ob, placed, clusters, bases


@query(f"WITH {_CHAIN} SELECT * FROM ce")
def exon_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _exon_cells(spark)
    return ty.exon_levels(cells, _levels(cells), ty.exon_table(spark))


@query(f"WITH {_CHAIN} SELECT locus, pos, genotype, count(*) AS n, round(avg(mapq_position), 9) AS mean_quality FROM us GROUP BY 1, 2, 3")
def usable_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    use = ty.usable(_chain(spark, sf_dir)[0])
    return use.groupBy("locus", "pos", "genotype").agg(F.count("*").alias("n"), F.round(F.avg("mapq_position"), 9).alias("mean_quality"))


@query(f"WITH {_CHAIN} SELECT locus, first, round(q1, 6) AS q1, second, round(q2, 6) AS q2 FROM ty")
def typed_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ob, _, _, bases = _chain(spark, sf_dir)
    return ty.type_alleles(ob, bases).withColumns({"q1": F.round("q1", 6), "q2": F.round("q2", 6)})


@query(f"""WITH {_CHAIN}, ca AS (SELECT locus, 1 AS chromosome, first AS cluster, q1 AS q, q2 FROM ty UNION ALL SELECT locus, 2, second, q2, q2 FROM ty),
me AS (SELECT locus, cluster, string_agg(allele, ';' ORDER BY allele) AS allele, min(allele) AS one FROM cl GROUP BY 1, 2), na AS (SELECT ca.*, allele, one FROM ca JOIN me ON ca.locus = me.locus AND ca.cluster = me.cluster),
uc AS (SELECT locus, pos, genotype, count(*) AS n FROM us GROUP BY 1, 2, 3), pl AS (SELECT DISTINCT locus, pos FROM ce), cv AS (SELECT pl.locus, pl.pos, CAST(coalesce(sum(n), 0) AS BIGINT) AS cov FROM pl LEFT JOIN uc ON pl.locus = uc.locus AND pl.pos = uc.pos GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY locus ORDER BY cov) - 1 AS k, count(*) OVER (PARTITION BY locus) AS m FROM cv), dp AS (SELECT locus, avg(cov) AS avg_cov, max(CASE WHEN k = m // 10 THEN cov END) AS cov_decile1, min(cov) AS min_cov FROM rk GROUP BY 1),
bs AS (SELECT na.locus, chromosome, pos, exon_ord, exon_pos, base FROM na JOIN ce ON na.locus = ce.locus AND na.one = ce.allele),
se AS (SELECT uc.*, NOT EXISTS (SELECT 1 FROM bs WHERE bs.locus = uc.locus AND bs.pos = uc.pos AND bs.base = uc.genotype) AS wrong, sum(n) OVER (PARTITION BY locus, pos) AS t FROM uc),
er AS (SELECT locus, sum(CASE WHEN wrong THEN n ELSE 0 END) / sum(n) AS avg_col_error, sum(CASE WHEN wrong AND t >= 30 AND n >= 0.2 * t THEN 1 ELSE 0 END) AS n_unaccounted FROM se GROUP BY 1),
gr AS (SELECT allele, 'G' || CAST(CAST(substr(allele, length(allele) - 1) AS INT) // 3 AS VARCHAR) AS g FROM (SELECT DISTINCT allele FROM cl) x),
vo AS (SELECT ca.locus, ca.cluster, g, count(*) AS n FROM (SELECT DISTINCT locus, cluster FROM ca) ca JOIN cl ON ca.locus = cl.locus AND ca.cluster = cl.cluster JOIN gr ON cl.allele = gr.allele GROUP BY 1, 2, 3),
vw AS (SELECT locus, cluster, g, count(*) OVER (PARTITION BY locus, cluster) = 1 AS perfect, row_number() OVER (PARTITION BY locus, cluster ORDER BY n DESC, g) AS k FROM vo),
km AS (SELECT locus, chromosome, substr(replace(s, '_', ''), CAST(i AS INT), 4) AS w FROM (SELECT locus, chromosome, exon_ord, string_agg(base, '' ORDER BY exon_pos) AS s FROM bs GROUP BY 1, 2, 3) x, unnest(range(1, greatest(length(replace(s, '_', '')) - 3, 0) + 1)) AS r(i)),
kp AS (SELECT locus, chromosome, avg(CASE WHEN least(w, reverse(translate(w, 'ACGT', 'TGCA'))) < 'C' THEN 1.0 ELSE 0.0 END) AS prop FROM km GROUP BY 1, 2)
SELECT na.locus, na.chromosome, na.allele, round(q, 6) AS q1, round(q2, 6) AS q2, round(avg_cov, 9) AS avg_cov, cov_decile1, min_cov, round(prop, 9) AS prop_kmers, round(avg_col_error, 9) AS avg_col_error, CAST(n_unaccounted AS BIGINT) AS n_unaccounted, vw.g AS g_group, perfect
FROM na JOIN dp ON na.locus = dp.locus JOIN er ON na.locus = er.locus JOIN kp ON na.locus = kp.locus AND na.chromosome = kp.chromosome JOIN vw ON na.locus = vw.locus AND na.cluster = vw.cluster AND vw.k = 1""")
def best_guess_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result table of typing, all k-mers that begin with A taken as seen and alleles in groups of three."""
    from strandlake.operators import filters as fl

    ob, placed, clusters, bases = _chain(spark, sf_dir)
    typed = ty.type_alleles(ob, bases)
    number = F.substr("allele", F.length("allele") - 1, F.lit(2)).cast("int")
    groups = clusters.select("allele").distinct().withColumn("g_group", F.concat(F.lit("G"), F.floor(number / 3).cast("string")))
    every = spark.range(256).select(F.concat(*[F.substr(F.lit("ACGT"), (F.floor(F.col("id") / 4**i) % 4 + 1).cast("int"), F.lit(1)) for i in (3, 2, 1, 0)]).alias("kmer")).where("kmer < 'C'")
    out = ty.best_guess(ob, placed, typed, clusters, fl.kmer_set(every, "kmer", 4), groups, 4)
    return out.withColumns({c: F.round(c, 9 if c in ("avg_cov", "prop_kmers", "avg_col_error") else 6) for c in ("q1", "q2", "avg_cov", "prop_kmers", "avg_col_error")})


ORACLE_SQL["result_table"] = "SELECT * EXCLUDE (g_group, perfect) REPLACE (CAST(cov_decile1 AS BIGINT) AS cov_decile1) FROM (" + ORACLE_SQL["best_guess_table"] + ") AS whole"


def result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result table of typing written as the file that others read, and read again."""
    from strandlake.lineage import shared_dir
    from strandlake.sources import results

    path = f"{shared_dir(spark)}/best-guess-{uuid.uuid4().hex}"
    results.write_table(best_guess_table(spark, sf_dir), path, results.BEST_GUESS, ["locus", "chromosome"])
    schema = "locus string, chromosome int, allele string, q1 double, q2 double, avg_cov double, cov_decile1 long, min_cov long, prop_kmers double, avg_col_error double, n_unaccounted long"
    return results.read_table(spark, path, results.BEST_GUESS, schema)


QUERIES["result_table"] = result_table


@query(f"""WITH {_CHAIN}, o AS (SELECT ob.locus, exon_ord, exon_pos, read, genotype, chr(CAST(40 + read % 20 AS INT)) AS quality FROM ob JOIN (SELECT DISTINCT locus, pos, exon_ord, exon_pos FROM ce) c ON ob.locus = c.locus AND ob.pos = c.pos WHERE genotype <> '_'),
l AS (SELECT locus, exon_ord, exon_pos, count(*) AS n, string_agg(genotype || ' (' || ascii(quality) || ') [0.75 | ' || read || ']', ', ' ORDER BY read, genotype) AS genotypes FROM o GROUP BY 1, 2, 3)
SELECT c.locus, c.exon_ord, c.exon_pos, coalesce(n, 0) AS n, coalesce(genotypes, '') AS genotypes FROM (SELECT DISTINCT locus, exon_ord, exon_pos FROM ce) c LEFT JOIN l ON c.locus = l.locus AND c.exon_ord = l.exon_ord AND c.exon_pos = l.exon_pos""")
def pileup_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotypes at each place of the exons with their qualities and reads, uncovered places too."""
    from strandlake.sources import results

    ob, placed, _, _ = _chain(spark, sf_dir)
    places = placed.select("locus", "pos", "exon_ord", "exon_pos").distinct()
    rows = ob.where("genotype <> '_'").join(places, ["locus", "pos"]).withColumns({"quality": F.char(40 + F.col("read") % 20), "mapq_position": F.lit(0.75)})
    return results.pileup_rows(rows, places.drop("pos"))


@query("""WITH c AS (SELECT p_partkey, substr('ACGT_', CAST(p_partkey % 5 + 1 AS INT), 1) || CASE WHEN p_size % 4 = 0 THEN substr('ACGT_', CAST(p_size % 5 + 1 AS INT), 1) ELSE '' END AS a,
CASE WHEN p_partkey % 7 = 0 THEN '_' ELSE substr('ACGT', CAST(p_size % 4 + 1 AS INT), 1) || repeat('A', CAST(p_partkey % 3 AS INT)) END AS g, p_size / 51.0 AS p FROM part),
s AS (SELECT p_partkey, i, length(a) AS n, substr(a, CAST(i AS INT), 1) AS x, CASE WHEN i > length(g) THEN '_' WHEN i = length(a) THEN substr(g, CAST(i AS INT)) ELSE substr(g, CAST(i AS INT), 1) END AS g, CASE WHEN p <= 0 THEN 0.001 ELSE least(p, 0.999) END AS p FROM c, unnest(range(1, length(a) + 1)) AS r(i)),
l AS (SELECT p_partkey, CASE WHEN x = '_' THEN CASE WHEN g = '_' THEN 0 ELSE ln(0.001) + ln(0.25) - 1 - lgamma(CAST(length(g) AS DOUBLE)) END
ELSE CASE WHEN g[1] = '_' THEN ln(0.001) ELSE ln(0.998) + CASE WHEN x = g[1] THEN ln(p) ELSE ln((1 - p) / 3) END END + CASE WHEN length(g) > 1 THEN ln(0.001) + ln(0.25) - 1 - lgamma(length(g) - 1.0) ELSE 0 END END AS ll FROM s)
SELECT p_partkey, round(sum(ll), 8) AS ll FROM l GROUP BY 1""")
def position_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotypes of several signs at alleles of one or two."""
    from strandlake.functions import probability as pr

    key, size = F.col("p_partkey"), F.col("p_size")
    sign = lambda text, c, n: F.substr(F.lit(text), (c % n + 1).cast("int"), F.lit(1))
    a = F.concat(sign("ACGT_", key, 5), F.when(size % 4 == 0, sign("ACGT_", size, 5)).otherwise(""))
    g = F.when(key % 7 == 0, "_").otherwise(F.concat(sign("ACGT", size, 4), F.expr("repeat('A', cast(p_partkey % 3 as int))")))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(pr.position_log_likelihood(a, g, size / 51.0), 8).alias("ll"))


_CAND = "c AS (SELECT o_custkey AS pair, CAST(o_orderkey % 2 + 1 AS INT) AS mate, o_orderkey AS aln, -(o_totalprice / 100000) AS ll, o_orderkey % 900 AS pos FROM orders)"


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pair"), (key % 2 + 1).cast("int").alias("mate"), key.alias("aln"), (-(F.col("o_totalprice") / 100000)).alias("ll"), (key % 900).alias("pos"))


@query(f"""WITH {_CAND}, s AS (SELECT a.pair, a.aln AS a1, b.aln AS a2, a.ll + b.ll + ln(exp(-pow(least(abs(abs(b.pos - a.pos) - 200.0) / 60.0, 8.0), 2) / 2) / (60.0 * sqrt(2 * pi()))) AS score FROM c a JOIN c b ON a.pair = b.pair AND a.mate = 1 AND b.mate = 2),
e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY pair)) AS e FROM s) SELECT pair, a1, a2, round(score, 6) AS score, round(e / sum(e) OVER (PARTITION BY pair), 8) AS mapq, round(CASE WHEN pair % 3 = 0 THEN exp(score - greatest(m, -9.5)) / (sum(exp(score - greatest(m, -9.5))) OVER (PARTITION BY pair) + exp(-9.5 - greatest(m, -9.5))) ELSE e / sum(e) OVER (PARTITION BY pair) END, 8) AS mapq_genomic FROM (SELECT *, max(score) OVER (PARTITION BY pair) AS m FROM e) x""")
def pair_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third customer's orders have an alternative outside the graph."""
    outside = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("pair"), F.lit(-9.5).alias("score"))
    out = ty.resolve_pairs(_candidates(spark, sf_dir), 200.0, 60.0, outside)
    return out.withColumns({"score": F.round("score", 6), "mapq": F.round("mapq", 8), "mapq_genomic": F.round("mapq_genomic", 8)})


@query(f"""WITH {_CAND}, p AS (SELECT DISTINCT pair FROM c), k AS (SELECT pair FROM (SELECT pair, row_number() OVER (ORDER BY pair) AS n FROM p) x WHERE (n - 1) % 2 = 0), s AS (SELECT a.pair, a.ll + b.ll AS score, abs(b.pos - a.pos) AS d FROM c a JOIN c b ON a.pair = b.pair AND a.mate = 1 AND b.mate = 2 JOIN k ON a.pair = k.pair),
e AS (SELECT *, exp(score - max(score) OVER (PARTITION BY pair)) AS e FROM s), w AS (SELECT d, sum(w) AS w FROM (SELECT d, e / sum(e) OVER (PARTITION BY pair) AS w FROM e) x GROUP BY d), r AS (SELECT d, sum(w) OVER (ORDER BY d) AS c, sum(w) OVER () AS t FROM w),
q AS (SELECT min(CASE WHEN c >= 0.2 * t THEN d END) AS a, min(CASE WHEN c >= 0.5 * t THEN d END) AS b, min(CASE WHEN c >= 0.8 * t THEN d END) AS z FROM r) SELECT b AS mean, greatest(abs(b - a), abs(z - b)) AS sd FROM q""")
def estimated_insert_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ty.estimated_insert_size(_candidates(spark, sf_dir), 2)


@query("""WITH c AS (SELECT o_custkey AS pair, o_orderkey % 2 AS mate, o_orderstatus AS strand, o_orderkey % 5 AS base, o_orderkey % 7 AS level, substr(o_orderpriority, 1, 1) AS graph_char, o_orderkey, o_totalprice / 600000 AS mapq FROM orders)
SELECT o_orderkey, round(sum(mapq) OVER (PARTITION BY pair, mate, strand, base, level, graph_char), 9) AS mapq_position FROM c""")
def mapping_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    c = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("pair"), (key % 2).alias("mate"), F.col("o_orderstatus").alias("strand"), (key % 5).alias("base"), (key % 7).alias("level"), F.substr("o_orderpriority", F.lit(1), F.lit(1)).alias("graph_char"), (F.col("o_totalprice") / 600000).alias("mapq"))
    return ty.mapping_confidence(c).select("o_orderkey", F.round("mapq_position", 9).alias("mapq_position"))


# --- decoding: parts as edges between four hundred levels of nodes

_EDGES = "e AS (SELECT p_size + 50 * (p_partkey % 8) AS level, p_partkey AS edge_id, p_partkey % 4 AS from_id, (p_partkey + p_size) % 4 AS to_id, p_retailprice AS cnt FROM part)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select((F.col("p_size") + 50 * (key % 8)).alias("level"), key.alias("edge_id"), (key % 4).alias("from_id"), ((key + F.col("p_size")) % 4).alias("to_id"), F.col("p_retailprice").alias("count"))


def _share(p: Column) -> Column:
    """A number from 0 to 1 rounded to 12 digits, in doubles; ``round`` goes through decimals, which costs most of a pair."""
    return F.floor(p * 1e12 + 0.5) / 1e12


@query(f"WITH {_EDGES}, f AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY level, from_id) AS fraction FROM e) SELECT a.level, a.edge_id AS e1, b.edge_id AS e2, round(a.fraction * b.fraction, 12) AS p FROM f a JOIN f b ON a.level = b.level")
def diploid_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.diploid_states(_edges(spark, sf_dir)).withColumn("p", _share(F.col("p")))


@query(f"WITH {_EDGES}, f AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY level, from_id) AS fraction FROM e) SELECT a.level, a.edge_id AS edge, b.edge_id AS next_edge, round(b.fraction, 12) AS p FROM f a JOIN f b ON b.level = a.level + 1 AND b.from_id = a.to_id")
def edge_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.transitions(_edges(spark, sf_dir)).withColumn("p", _share(F.col("p")))


@query(f"""WITH {_EDGES}, k AS (SELECT level, edge_id, 'k' || (edge_id % 9) AS kmer, CAST(edge_id % 2 + 1 AS INT) AS copies FROM e), cn AS (SELECT 'k' || (o_orderkey % 7) AS kmer, CAST(count(*) % 23 AS INT) AS n FROM orders GROUP BY 1),
lk AS (SELECT DISTINCT level, kmer FROM k), ab AS (SELECT level, lk.kmer, coalesce(n, 0) AS n, greatest(coalesce(n, 0) * ln(0.1) - 0.1 - lgamma(coalesce(n, 0) + 1.0), ln(1e-200)) AS a FROM lk LEFT JOIN cn ON lk.kmer = cn.kmer),
b AS (SELECT level, sum(a) AS b FROM ab GROUP BY level), s AS (SELECT x.level, x.edge_id AS e1, y.edge_id AS e2 FROM e x JOIN e y ON x.level = y.level),
cp AS (SELECT s.level, e1, e2, kmer, sum(copies) AS c FROM (SELECT level, e1, e2, e1 AS edge_id FROM s UNION ALL SELECT level, e1, e2, e2 FROM s) s JOIN k ON s.level = k.level AND s.edge_id = k.edge_id GROUP BY 1, 2, 3, 4),
d AS (SELECT cp.level, e1, e2, sum(greatest(n * ln(c * 10.0) - c * 10.0 - lgamma(n + 1.0), ln(1e-200)) - a) AS d FROM cp JOIN ab ON cp.level = ab.level AND cp.kmer = ab.kmer GROUP BY 1, 2, 3)
SELECT s.level, s.e1, s.e2, round(b + coalesce(d, 0), 6) AS ll FROM s JOIN b ON s.level = b.level LEFT JOIN d ON s.level = d.level AND s.e1 = d.e1 AND s.e2 = d.e2""")
def emission_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    k = e.select("level", "edge_id", F.concat(F.lit("k"), (F.col("edge_id") % 9).cast("string")).alias("kmer"), (F.col("edge_id") % 2 + 1).cast("int").alias("copies"))
    counts = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("k"), (F.col("o_orderkey") % 7).cast("string")).alias("kmer")).agg((F.count("*") % 23).cast("int").alias("n"))
    return hmm.pair_emissions(e, k, counts, 10.0, 0.01, digits=6)


@query("""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS sample, day(ts) AS d, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS x FROM events GROUP BY 1, 2),
s AS (SELECT sample, CAST(dense_rank() OVER (PARTITION BY sample ORDER BY d) AS INT) AS level, -x * 4 AS c, (x - 1) * 2 AS r FROM e),
p AS (SELECT sample, level, -0.6931471805599453::DOUBLE + c AS sc, -0.6931471805599453::DOUBLE + r AS sr, 'c' AS pc, 'r' AS pr FROM s WHERE level = 1
UNION ALL SELECT s.sample, s.level, greatest(sc + ln(0.9), sr + ln(0.2)) + c, greatest(sc + ln(0.1), sr + ln(0.8)) + r, CASE WHEN sc + ln(0.9) >= sr + ln(0.2) THEN pc ELSE pr END || 'c', CASE WHEN sc + ln(0.1) >= sr + ln(0.8) THEN pc ELSE pr END || 'r' FROM p JOIN s ON s.sample = p.sample AND s.level = p.level + 1),
b AS (SELECT sample, CASE WHEN sc >= sr THEN pc ELSE pr END AS path, greatest(sc, sr) AS score, row_number() OVER (PARTITION BY sample ORDER BY level DESC) AS k FROM p)
SELECT sample, CAST(0 AS INT) AS draw, CAST(i AS INT) AS level, CASE substr(path, CAST(i AS INT), 1) WHEN 'c' THEN 'calm' ELSE 'rough' END AS state, round(score, 6) AS score FROM b, unnest(range(1, length(path) + 1)) AS q(i) WHERE k = 1""")
def viterbi_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best paths of users' daily moods, two hidden states, from the share of errors."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("sample"), F.dayofmonth("ts").alias("level")).agg(F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("x"))
    states = e.select("sample", "level", F.explode(F.array(F.struct(F.lit("calm").alias("state"), (-F.col("x") * 4).alias("ll")), F.struct(F.lit("rough").alias("state"), ((F.col("x") - 1) * 2).alias("ll")))).alias("s")).select("sample", "level", "s.state", "s.ll", F.lit(-0.6931471805599453).alias("start"))
    steps = spark.range(1, 32).select(F.col("id").cast("int").alias("level"), F.explode(F.array(*[F.struct(F.lit(a).alias("from_state"), F.lit(b).alias("to_state"), F.lit(p).alias("p")) for a, b, p in (("calm", "calm", 0.9), ("calm", "rough", 0.1), ("rough", "calm", 0.2), ("rough", "rough", 0.8))])).alias("t")).select("level", "t.*")
    return hmm.decode(_dense(states), steps).withColumn("score", F.round("score", 6))


@query("""WITH RECURSIVE s AS (SELECT CAST(p_partkey AS INT) AS level, -(p_size % 8) / 4.0::DOUBLE AS c, (p_size % 8 - 7) / 8.0::DOUBLE AS r FROM part),
p AS (SELECT level, c AS sc, r AS sr, 'c' AS pc, 'r' AS pr FROM s WHERE level = (SELECT min(level) FROM s)
UNION ALL SELECT s.level, greatest(sc - 0.5, sr - 1) + c, greatest(sc - 2, sr - 0.25) + r, CASE WHEN sc - 0.5 >= sr - 1 THEN pc ELSE pr END || 'c', CASE WHEN sc - 2 >= sr - 0.25 THEN pc ELSE pr END || 'r' FROM p JOIN s ON s.level = p.level + 1),
b AS (SELECT CASE WHEN sc >= sr THEN pc ELSE pr END AS path, greatest(sc, sr) AS score FROM p WHERE level = (SELECT max(level) FROM s))
SELECT 'all' AS sample, CAST(0 AS INT) AS draw, s.level, CASE substr(path, CAST(row_number() OVER (ORDER BY s.level) AS INT), 1) WHEN 'c' THEN 'calm' ELSE 'rough' END AS state, round(score, 6) AS score FROM b, s""")
def viterbi_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample whose levels are all parts, decoded by blocks of 256."""
    size = F.col("p_size") % 8
    seen = F.array(F.struct(F.lit("calm").alias("state"), (-size / 4).alias("ll")), F.struct(F.lit("rough").alias("state"), ((size - 7) / 8).alias("ll")))
    states = table(spark, sf_dir, "part").select(F.lit("all").alias("sample"), F.col("p_partkey").cast("int").alias("level"), F.explode(seen).alias("s")).select("sample", "level", "s.*", F.lit(0.0).alias("start"))
    ways = [("calm", "calm", -0.5), ("calm", "rough", -2.0), ("rough", "calm", -1.0), ("rough", "rough", -0.25)]
    moves = states.select("level").distinct().select("level", F.explode(F.array(*[F.struct(F.lit(a).alias("from_state"), F.lit(b).alias("to_state"), F.exp(F.lit(p)).alias("p")) for a, b, p in ways])).alias("t")).select("level", "t.*")
    return decode_long(states, moves, 256).withColumn("score", F.round("score", 6))


def _dense(states: DataFrame) -> DataFrame:
    """Levels renumbered without holes within a sample."""
    from pyspark.sql import Window as W

    return states.withColumn("level", F.dense_rank().over(W.partitionBy("sample").orderBy("level")))


@query("""WITH RECURSIVE o AS (SELECT CAST(o_custkey % 10 AS VARCHAR) AS chrom, CAST(o_orderkey % 20000 AS INT) AS pos, repeat('A', CAST(o_custkey % 9 + 1 AS INT)) AS ref, o_orderkey FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos, ref, o_orderkey) AS k FROM o),
g AS (SELECT chrom, k, pos + length(ref) - 1 AS stop, true AS keep FROM n WHERE k = 1 UNION ALL SELECT n.chrom, n.k, CASE WHEN pos > stop THEN pos + length(ref) - 1 ELSE stop END, pos > stop FROM g JOIN n ON n.chrom = g.chrom AND n.k = g.k + 1)
SELECT n.chrom, pos, ref, o_orderkey FROM n JOIN g ON n.chrom = g.chrom AND n.k = g.k WHERE keep""")
def greedy_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as variant records: those that overlap the last one kept go."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).cast("string").alias("chrom"), (F.col("o_orderkey") % 20000).cast("int").alias("pos"), F.expr("repeat('A', cast(o_custkey % 9 + 1 as int))").alias("ref"), "o_orderkey")
    return fl.greedy_windows(o)


@query()
def haplotype_beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beam over the positions of each segment's observed alleles."""
    o = _observations(spark, sf_dir).groupBy("locus", "pos", F.col("genotype").alias("allele")).agg(F.count("*").alias("n"), F.avg("p").alias("p"))
    return ty.haplotype_beam(o)
