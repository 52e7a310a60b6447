"""Queries of k-mers, filters of reads, and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import nomenclature as nm
from strandlake.functions import probability as pr
from strandlake.functions import sequences as sq
from strandlake.operators import aggregates as ag
from strandlake.operators import filters as fl
from strandlake.operators import joins as jn
from strandlake.plans.tables import dna, dna_sql, kmers_sql, revcomp_sql, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""
WITH k AS (SELECT DISTINCT kmer FROM ({kmers_sql("benchmark", "item_id", "text", 12)}) x),
d AS ({kmers_sql("documents", "doc_id", "text", 12)}),
s AS (SELECT doc_id, count(*) AS n_kmers, count(k.kmer) AS n_hits FROM d LEFT JOIN k ON d.kmer = k.kmer GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_kmers, 0) AS n_kmers, coalesce(n_hits, 0) AS n_hits, round(coalesce(n_hits / n_kmers, 0.0), 9) AS fraction, coalesce(n_hits / n_kmers, 0.0) >= 0.3 AS passed
FROM documents LEFT JOIN s ON documents.doc_id = s.doc_id""")
def kmer_containment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reads, benchmark passages as the k-mer set."""
    docs = fl.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    known = fl.kmer_set(table(spark, sf_dir, "benchmark"), "text", 12)
    out = fl.kmer_fractions(docs, ["doc_id"], "text", known, 12)
    return out.select("doc_id", "n_kmers", "n_hits", F.round("fraction", 9).alias("fraction"), (F.col("fraction") >= 0.3).alias("passed"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns 2n and 2n + 1 of a conversation as a pair of reads in bases."""
    c = table(spark, sf_dir, "conversations").where(F.col("text").isNotNull())
    c = fl.spread(c).select("conv_id", F.floor(F.col("turn") / 2).cast("long").alias("pair"), (F.pmod("turn", F.lit(2)) + 1).cast("int").alias("mate"), dna(F.col("text")).alias("seq"))
    return c.select((F.col("conv_id") * 1000 + F.col("pair")).alias("read_id"), "mate", "seq")


_READS = f"""reads AS (SELECT conv_id * 1000 + CAST(floor(turn / 2) AS BIGINT) AS read_id, CAST(turn % 2 + 1 AS INT) AS mate, {dna_sql("text")} AS seq FROM conversations WHERE text IS NOT NULL),
pairs AS (SELECT a.read_id, a.seq AS seq1, b.seq AS seq2 FROM reads a JOIN reads b ON a.read_id = b.read_id AND a.mate = 1 AND b.mate = 2)"""
_BENCH = f"bench AS (SELECT item_id, {dna_sql('text')} AS seq FROM benchmark)"


def _bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.spread(table(spark, sf_dir, "benchmark").select("item_id", "text")).select("item_id", dna(F.col("text")).alias("seq"))


@query(f"""
WITH {_READS}, {_BENCH},
known AS (SELECT DISTINCT kmer FROM ({kmers_sql("bench", "item_id", "seq", 8)}) x),
uniq AS (SELECT kmer FROM ({kmers_sql("bench", "item_id", "seq", 10)}) x GROUP BY kmer HAVING count(*) = 1),
sides AS (SELECT read_id, 'f1' AS side, seq1 AS seq FROM pairs UNION ALL SELECT read_id, 'f2', {revcomp_sql("seq2")} FROM pairs UNION ALL SELECT read_id, 'r1', {revcomp_sql("seq1")} FROM pairs UNION ALL SELECT read_id, 'r2', seq2 FROM pairs),
k AS ({kmers_sql("sides", "read_id, side", "seq", 8)}),
f AS (SELECT read_id, side, count(known.kmer) / count(*) AS f FROM k LEFT JOIN known ON k.kmer = known.kmer GROUP BY read_id, side),
w AS (SELECT p.read_id, coalesce(max(CASE WHEN side = 'f1' THEN f END), 0.0) AS f1, coalesce(max(CASE WHEN side = 'f2' THEN f END), 0.0) AS f2, coalesce(max(CASE WHEN side = 'r1' THEN f END), 0.0) AS r1, coalesce(max(CASE WHEN side = 'r2' THEN f END), 0.0) AS r2 FROM pairs p LEFT JOIN f ON p.read_id = f.read_id GROUP BY p.read_id)
SELECT read_id, round(f1, 9) AS f1, round(f2, 9) AS f2, round(r1, 9) AS r1, round(r2, 9) AS r2, (f1 >= 0.3 AND f2 >= 0.3) OR (r1 >= 0.3 AND r2 >= 0.3) AS passed FROM w""")
def positive_read_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _pairs(spark, sf_dir)
    pairs = jn.mate_pairs(reads, ["read_id"], "mate", ["seq"])
    known = fl.kmer_set(_bench(spark, sf_dir), "seq", 8)
    out = fl.positive_filter(pairs, known, 8, 0.3)
    return out.select("read_id", *[F.round(c, 9).alias(c) for c in ("f1", "f2", "r1", "r2")], "passed")


@query(f"""
WITH {_READS}, {_BENCH},
bg AS (SELECT DISTINCT least(kmer, {revcomp_sql("kmer")}) AS kmer FROM ({kmers_sql("bench", "item_id", "seq", 8)}) x),
k AS (SELECT read_id, mate, least(kmer, {revcomp_sql("kmer")}) AS kmer FROM ({kmers_sql("reads", "read_id, mate", "seq", 8)}) x),
f AS (SELECT read_id, mate, count(bg.kmer) / count(*) AS f FROM k LEFT JOIN bg ON k.kmer = bg.kmer GROUP BY read_id, mate),
w AS (SELECT r.read_id, coalesce(max(CASE WHEN r.mate = 1 THEN f END), 1.0) AS n1, coalesce(max(CASE WHEN r.mate = 2 THEN f END), 1.0) AS n2 FROM reads r LEFT JOIN f ON r.read_id = f.read_id AND r.mate = f.mate GROUP BY r.read_id)
SELECT read_id, round(n1, 9) AS n1, round(n2, 9) AS n2, n1 <= 0.45 OR n2 <= 0.45 AS passed FROM w""")
def negative_read_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    background = fl.kmer_set(_bench(spark, sf_dir), "seq", 8, canonical=True)
    out = fl.negative_filter(_pairs(spark, sf_dir), background, 8, 0.45)
    return out.select("read_id", F.round("n1", 9).alias("n1"), F.round("n2", 9).alias("n2"), "passed")


@query(f"""
WITH {_READS}, {_BENCH},
bk AS (SELECT least(kmer, {revcomp_sql("kmer")}) AS kmer FROM ({kmers_sql("bench", "item_id", "seq", 10)}) x),
rk AS (SELECT least(kmer, {revcomp_sql("kmer")}) AS kmer FROM ({kmers_sql("reads", "read_id", "seq", 10)}) x)
SELECT DISTINCT kmer FROM bk WHERE kmer NOT IN (SELECT kmer FROM rk)""")
def unique_kmers_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = lambda df: df.select(F.explode(sq.kmers(F.col("seq"), 10)).alias("kmer"))
    return jn.only_in(raw(_bench(spark, sf_dir)), raw(_pairs(spark, sf_dir)))


@query(f"WITH {_BENCH} SELECT least(kmer, {revcomp_sql('kmer')}) AS kmer, count(*) AS n FROM ({kmers_sql('bench', 'item_id', 'seq', 9)}) x GROUP BY 1")
def kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.kmer_counts(_bench(spark, sf_dir), "seq", 9)


@query(f"""
WITH {_BENCH}, s AS (SELECT DISTINCT kmer AS seq FROM ({kmers_sql("bench", "item_id", "seq", 31)}) x),
p AS (SELECT seq, sum(CAST(instr('ACGT', substr(seq, CAST(i AS INT), 1)) - 1 AS BIGINT) * CAST(pow(4, length(seq) - i) AS BIGINT)) AS packed FROM s, unnest(range(1, 32)) AS r(i) GROUP BY seq)
SELECT seq, {revcomp_sql("seq")} AS reverse_complement, least(seq, {revcomp_sql("seq")}) AS canonical, CAST(packed AS BIGINT) AS packed, seq AS unpacked, regexp_matches(seq, '^[ACGT]+$') AS valid, seq AS ungapped FROM p""")
def revcomp_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fl.kmer_set(_bench(spark, sf_dir), "seq", 31).select(F.col("kmer").alias("seq"))
    packed = sq.pack_kmer(F.col("seq"))
    gapped = F.concat(F.lit("_"), F.col("seq"), F.lit("-"))
    return s.select("seq", sq.revcomp(F.col("seq")).alias("reverse_complement"), sq.canonical(F.col("seq")).alias("canonical"), packed.alias("packed"), sq.unpack_kmer(packed, 31).alias("unpacked"), sq.is_valid_kmer(F.col("seq")).alias("valid"), sq.remove_gaps(gapped).alias("ungapped"))


@query("""
WITH p AS (SELECT p_partkey, replace(p_name, ' ', '_') AS s FROM part WHERE p_partkey <= 10000),
c AS (SELECT p_partkey, i, substr(s, CAST(i AS INT), 1) AS ch, s FROM p, unnest(range(1, length(s) + 1)) AS r(i)),
k AS (SELECT p_partkey, i, ch, substr(replace(substr(s, CAST(i AS INT)), '_', ''), 1, 4) AS kk FROM c)
SELECT p_partkey, i - 1 AS pos, CASE WHEN ch = '_' OR length(kk) < 4 THEN '' ELSE kk END AS kmer FROM k""")
def kmers_over_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.translate("p_name", " ", "_").alias("s"))
    return p.select("p_partkey", F.posexplode(sq.kmers_over_gaps(F.col("s"), 4))).select("p_partkey", F.col("pos").cast("long").alias("pos"), F.col("col").alias("kmer"))


ORACLE_SQL["kmers_over_gaps"] = ORACLE_SQL["kmers_over_gaps"].replace(" WHERE p_partkey <= 10000", "")


@query("""
WITH c AS (SELECT item_id, i, substr(text, CAST(i AS INT), 1) AS ch FROM benchmark, unnest(range(1, length(text) + 1)) AS r(i)),
p AS (SELECT item_id, i, 1 - pow(10, -(ascii(ch) - 33) / 10.0) AS p FROM c WHERE ascii(ch) BETWEEN 34 AND 126)
SELECT item_id, count(*) AS n, round(avg(p), 9) AS mean_p, round(min(p), 9) AS min_p, sum(least(255, CAST(round(-10 * log10(1 - p)) AS INT) + 33)) AS code_sum FROM p GROUP BY item_id""")
def phred_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", "")).alias("ch")).where(F.ascii("ch").between(34, 126))
    p = c.select("item_id", sq.phred_to_pcorrect(F.col("ch")).alias("p"))
    return p.groupBy("item_id").agg(F.count("*").alias("n"), F.round(F.avg("p"), 9).alias("mean_p"), F.round(F.min("p"), 9).alias("min_p"), F.sum(F.ascii(sq.pcorrect_to_phred(F.col("p")))).alias("code_sum"))


@query("""
WITH x AS (SELECT p_partkey, p_size AS n, -p_retailprice / 1000 AS a, -p_size / 7.0 AS b FROM part),
g AS (SELECT p_partkey, greatest(a, b) AS m FROM x)
SELECT x.p_partkey, round(ln(0.5 * (exp(a) + exp(b))), 8) AS log_mean, round(ln(exp(a) + exp(b) + exp(a + b)), 8) AS log_sum, round(n * ln(3.5) - 3.5 - lgamma(n + 1.0), 8) AS log_poisson,
round(exp(-pow(least(abs(p_retailprice - 1400) / 50.0, 8.0), 2) / 2) / (50 * sqrt(2 * pi())), 12) AS density FROM x JOIN g ON x.p_partkey = g.p_partkey JOIN part ON part.p_partkey = x.p_partkey""")
def log_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("n"), "p_retailprice", (-F.col("p_retailprice") / 1000).alias("a"), (-F.col("p_size") / 7.0).alias("b"))
    return p.select(
        "p_partkey",
        F.round(pr.logavg(F.col("a"), F.col("b")), 8).alias("log_mean"),
        F.round(pr.logsumexp(F.array("a", "b", F.col("a") + F.col("b"))), 8).alias("log_sum"),
        F.round(pr.log_poisson(F.col("n"), F.lit(3.5)), 8).alias("log_poisson"),
        F.round(pr.normal_density(F.col("p_retailprice"), F.lit(1400.0), F.lit(50.0)), 12).alias("density"),
    )


@query("""
WITH o AS (SELECT o_custkey AS observed, count(*) AS n FROM orders GROUP BY o_custkey), d AS (SELECT DISTINCT CAST(n AS INT) AS observed FROM o),
r AS (SELECT observed, CAST(c AS INT) AS copies, CASE WHEN c = 0 THEN 0.01 ELSE c * 4.5 END AS rate FROM d, unnest(range(0, 7)) AS x(c)),
p AS (SELECT observed, copies, exp(observed * ln(rate) - rate - lgamma(observed + 1.0)) AS p FROM r)
SELECT observed, copies, round(p / sum(p) OVER (PARTITION BY observed), 9) AS posterior FROM p""")
def copy_number_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as a count, copies at 4.5 each."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    out = pr.copy_number_posterior(n, "n", F.lit(4.5), 6)
    return out.select("observed", "copies", F.round("posterior", 9).alias("posterior"))


@query("""
WITH a AS (SELECT p_partkey, p_name, rpad(p_name, 64, '*') AS x, rpad(p_type, 64, '*') AS y FROM part),
c AS (SELECT p_partkey, substr(x, CAST(i AS INT), 1) AS u, substr(y, CAST(i AS INT), 1) AS v FROM a, unnest(range(1, 65)) AS r(i))
SELECT p_partkey, CAST(sum(CASE WHEN u <> '*' AND v <> '*' AND u <> v THEN 1 ELSE 0 END) AS INT) AS distance, round(sum(CASE WHEN u = v AND NOT (u = ' ' AND v = ' ') THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN u = ' ' AND v = ' ' THEN 0 ELSE 1 END), 0), 9) AS agreeing FROM c GROUP BY p_partkey""")
def string_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda c: F.rpad(F.col(c), 64, "*")
    p = table(spark, sf_dir, "part").select("p_partkey", side("p_name").alias("x"), side("p_type").alias("y"))
    return p.select("p_partkey", sq.hamming(F.col("x"), F.col("y")).alias("distance"), F.round(sq.fraction_ok(F.col("x"), F.col("y"), " "), 9).alias("agreeing"))


@query("""
WITH a AS (SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN '?' ELSE 'A*' || lpad(CAST(p_size AS VARCHAR), 2, '0') || ':' || lpad(CAST(p_partkey % 13 AS VARCHAR), 2, '0') || CASE WHEN p_size % 3 = 0 THEN ':01G' ELSE '' END END AS a, 'A*' || lpad(CAST(p_size AS VARCHAR), 2, '0') || ':' || lpad(CAST(p_partkey % 7 AS VARCHAR), 2, '0') AS b FROM part),
f AS (SELECT *, CASE WHEN a <> '?' THEN string_split(regexp_replace(regexp_replace(a, 'G$', ''), '^.*\\*', ''), ':') END AS fa, string_split(regexp_replace(b, '^.*\\*', ''), ':') AS fb FROM a)
SELECT p_partkey, array_to_string(list_slice(fa, 1, 1), ':') AS two, array_to_string(list_slice(fa, 1, 2), ':') AS four, CASE WHEN a = '?' THEN 0 ELSE CAST(2 * len(fa) AS INT) END AS information, a = '?' OR (fa[1] = fb[1] AND fa[2] = fb[2]) AS compatible FROM f""")
def allele_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    p = table(spark, sf_dir, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    a = F.when(size % 11 == 0, "?").otherwise(F.concat(F.lit("A*"), two(size), F.lit(":"), two(key % 13), F.when(size % 3 == 0, ":01G").otherwise("")))
    rows = p.select("p_partkey", a.alias("a"), F.concat(F.lit("A*"), two(size), F.lit(":"), two(key % 7)).alias("b"))
    return rows.select("p_partkey", nm.digits(F.col("a"), 2).alias("two"), nm.digits(F.col("a"), 4).alias("four"), nm.information(F.col("a")).alias("information"), nm.compatible(F.col("a"), F.col("b")).alias("compatible"))


_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


@query(f"""
WITH {_BENCH}, c AS (SELECT item_id, i, substr(seq, CAST(3 * i + 1 AS INT), 3) AS codon FROM bench, unnest(range(0, CAST(floor(length(seq) / 3) AS BIGINT))) AS r(i)),
a AS (SELECT item_id, i, substr('{_AMINO}', CAST((instr('TCAG', substr(codon, 1, 1)) - 1) * 16 + (instr('TCAG', substr(codon, 2, 1)) - 1) * 4 + instr('TCAG', substr(codon, 3, 1)) AS INT), 1) AS aa FROM c)
SELECT item_id, string_agg(aa, '' ORDER BY i) AS protein FROM a GROUP BY item_id""")
def codon_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bench(spark, sf_dir).where(F.length("seq") >= 3).select("item_id", sq.translate_codons(F.col("seq")).alias("protein"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, substr('ACGT_', CAST(l_partkey % 5 + 1 AS INT), 1) AS g, substr('ACGT_', CAST(l_suppkey % 5 + 1 AS INT), 1) AS s, 1 - l_discount - 0.0001 AS p FROM lineitem),
x AS (SELECT *, least(p, 0.999) AS q FROM l)
SELECT l_orderkey, count(*) AS n, round(sum(CASE WHEN g = '_' AND s = '_' THEN 0 WHEN g = '_' THEN ln(0.001) + ln(0.25) WHEN s = '_' THEN ln(0.001) WHEN g = s THEN ln(q) ELSE ln((1 - q) / 3) END), 6) AS log_likelihood FROM x GROUP BY l_orderkey""")
def alignment_log_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as columns of their order's alignment."""
    base = lambda c: F.substr(F.lit("ACGT_"), (F.col(c) % 5 + 1).cast("int"), F.lit(1))
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", pr.base_log_likelihood(base("l_partkey"), base("l_suppkey"), 1 - F.col("l_discount") - 0.0001).alias("ll"))
    return x.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("ll"), 6).alias("log_likelihood"))


@query("""
WITH a AS (SELECT o_custkey, o_orderkey, substr(o_orderpriority, 1, 1) AS x, substr(o_orderstatus, 1, 1) AS y, CAST(o_orderkey % 5 + 1 AS VARCHAR) AS u, substr('FOP', CAST(o_orderkey % 3 + 1 AS INT), 1) AS v FROM orders)
SELECT o_orderkey, greatest(CAST(x = u AS INT) + CAST(y = v AS INT), CAST(x = v AS INT) + CAST(y = u AS INT)) AS agreement FROM a""")
def diploid_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    first = lambda c: F.substr(F.col(c), F.lit(1), F.lit(1))
    key = F.col("o_orderkey")
    return o.select("o_orderkey", nm.pair_agreement(first("o_orderpriority"), first("o_orderstatus"), (key % 5 + 1).cast("string"), F.substr(F.lit("FOP"), (key % 3 + 1).cast("int"), F.lit(1))).alias("agreement"))


@query(f"""
WITH {_READS}, {_BENCH}, idx AS (SELECT DISTINCT kmer FROM ({kmers_sql("bench", "item_id", "seq", 9)}) x),
s AS (SELECT read_id * 10 + mate AS read_id, 'f' AS strand, seq FROM reads UNION ALL SELECT read_id * 10 + mate, 'r', {revcomp_sql("seq")} FROM reads),
h AS (SELECT read_id, strand, count(*) AS n FROM ({kmers_sql("s", "read_id, strand", "seq", 9)}) k WHERE kmer IN (SELECT kmer FROM idx) GROUP BY 1, 2),
w AS (SELECT s.read_id, coalesce(max(CASE WHEN h.strand = 'f' THEN n END), 0) AS forward, coalesce(max(CASE WHEN h.strand = 'r' THEN n END), 0) AS reverse FROM s LEFT JOIN h ON s.read_id = h.read_id GROUP BY s.read_id)
SELECT read_id, forward, reverse, CASE WHEN reverse > forward THEN 'reverse' ELSE 'forward' END AS strand FROM w""")
def strand_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = _pairs(spark, sf_dir).select((F.col("read_id") * 10 + F.col("mate")).alias("read_id"), "seq")
    return jn.seed_hits(reads, fl.kmer_set(_bench(spark, sf_dir), "seq", 9), 9)


@query("""
SELECT o_orderkey, o_orderdate IS NOT NULL AS dated FROM orders WHERE CAST(o_orderkey % 4096 AS INT) & 256 = 0 AND CAST(o_orderkey % 4096 AS INT) & 2048 = 0 AND CAST(o_orderkey % 4096 AS INT) & 4 = 0""")
def primary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("flag", (F.col("o_orderkey") % 4096).cast("int"))
    return fl.primary_records(o).select("o_orderkey", F.col("o_orderdate").isNotNull().alias("dated"))


@query(f"""
WITH {_READS}, {_BENCH}, bk AS (SELECT least(kmer, {revcomp_sql("kmer")}) AS kmer FROM ({kmers_sql("bench", "item_id", "seq", 10)}) x),
rk AS (SELECT least(kmer, {revcomp_sql("kmer")}) AS kmer, count(*) AS n FROM ({kmers_sql("reads", "read_id", "seq", 10)}) x GROUP BY 1),
g AS (SELECT kmer, count(*) AS n_graph FROM bk GROUP BY kmer)
SELECT g.kmer, n_graph, coalesce(n, 0) AS n_reference FROM g LEFT JOIN rk ON g.kmer = rk.kmer""")
def kmer_sharing(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = lambda df: df.select(F.explode(sq.kmers(F.col("seq"), 10)).alias("kmer"))
    return jn.shared_kmers(raw(_bench(spark, sf_dir)), raw(_pairs(spark, sf_dir)))


@query(f"""
WITH {_READS}, {_BENCH}, w AS (SELECT DISTINCT kmer FROM ({kmers_sql("bench", "item_id", "seq", 10)}) x),
c AS (SELECT least(kmer, {revcomp_sql("kmer")}) AS kmer, count(*) AS n FROM ({kmers_sql("reads", "read_id", "seq", 10)}) x GROUP BY 1)
SELECT w.kmer, coalesce(n, 0) AS n FROM w LEFT JOIN c ON least(w.kmer, {revcomp_sql("w.kmer")}) = c.kmer""")
def sample_kmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jn.sample_counts(fl.kmer_set(_bench(spark, sf_dir), "seq", 10), ag.kmer_counts(_pairs(spark, sf_dir), "seq", 10))


@query(f"""
WITH {_READS}, {_BENCH}, c AS (SELECT least(kmer, {revcomp_sql("kmer")}) AS kmer, count(*) AS n FROM ({kmers_sql("bench", "item_id", "seq", 7)}) x GROUP BY 1),
o AS (SELECT least(kmer, {revcomp_sql("kmer")}) AS kmer, count(*) AS n FROM ({kmers_sql("reads", "read_id", "seq", 7)}) x GROUP BY 1)
SELECT c.kmer, c.n - coalesce(o.n, 0) AS n FROM c LEFT JOIN o ON c.kmer = o.kmer""")
def count_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.corrected_counts(ag.kmer_counts(_bench(spark, sf_dir), "seq", 7), ag.kmer_counts(_pairs(spark, sf_dir), "seq", 7))


@query(f"""
WITH {_READS}, w AS (SELECT DISTINCT kmer FROM ({kmers_sql(f"(SELECT item_id, {dna_sql('text')} AS seq FROM benchmark)", "item_id", "seq", 8)}) x),
c AS (SELECT mate, kmer, count(*) AS n FROM ({kmers_sql("reads", "mate", "seq", 8)}) x GROUP BY 1, 2)
SELECT w.kmer, coalesce(sum(CASE WHEN mate = 1 THEN n END), 0) AS s1, coalesce(sum(CASE WHEN mate = 2 THEN n END), 0) AS s2 FROM w LEFT JOIN c ON w.kmer = c.kmer GROUP BY w.kmer""")
def kmer_counts_by_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _pairs(spark, sf_dir).select(F.concat(F.lit("s"), F.col("mate").cast("string")).alias("sample"), F.explode(sq.kmers(F.col("seq"), 8)).alias("kmer")).groupBy("sample", "kmer").agg(F.count("*").alias("n"))
    return jn.counts_by_sample(fl.kmer_set(_bench(spark, sf_dir), "seq", 8), counts, ["s1", "s2"])
