"""Quality rules: ordered threshold conjunctions learned by sequential covering.

Rules are grown one condition at a time by information gain on two thirds of
the labelled rows and pruned on the rest; rows that a rule covers are set aside
before the next. The list becomes one Spark conditional expression. Only
DataFrame functions run on the executors.
"""

from __future__ import annotations

import math
import operator
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.native import let, split_words, upto
from strandlake.llm.store import fewest_hashes

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_lines_share", "repeat_share", "capital_share", "shout_share")


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more, by sorting the windows' hashes with their places; ``words`` is a lambda's variable."""

    def flagged(pairs: Column) -> Column:
        n = F.size(pairs)
        hash_at = lambda k: F.get(pairs, k)["h"]
        same = F.filter(upto(n), lambda k: F.coalesce(hash_at(k) == hash_at(k - 1), F.lit(False)) | F.coalesce(hash_at(k) == hash_at(k + 1), F.lit(False)))
        places = F.flatten(F.transform(same, lambda k: let(F.get(pairs, k)["i"], lambda i: F.array(i, i + 1, i + 2))))
        return F.size(F.array_distinct(places))

    def repeated(w: Column) -> Column:
        hashes = F.transform(upto(F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        ordered = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered(h), flagged)))

    return repeated(words).cast("long")


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the statistics of each whole text, and the shares that rules are made of."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = split_words(F.col(text_col))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")
    found = docs.withColumns(
        {
            # the words of a text are made once
            "_words": let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), _repeat_words(w).alias("repeats"))),
            "_lines": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("different"))),
            "n_symbols": count(r"[#*$%&|<>]"),
            "_capitals": count("[A-Z]"),
            "_shouts": count("[!?]"),
        }
    )
    found = found.withColumns({"n_words": F.col("_words.n"), "word_chars": F.col("_words.chars"), "n_repeat_words": F.col("_words.repeats"), "n_dup_lines": F.col("_lines.n") - F.col("_lines.different")})
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return found.withColumns(
        {
            "mean_word": share("word_chars", "n_words"),
            "symbol_share": share("n_symbols", "n_words"),
            "dup_lines_share": share("n_dup_lines", "_lines.n"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "capital_share": share("_capitals", "word_chars"),
            "shout_share": share("_shouts", "n_words"),
        }
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return (operator.ge if self.above else operator.lt)(row[self.feature], self.threshold)

    def column(self) -> Column:
        return F.col(self.feature) >= F.lit(self.threshold) if self.above else F.col(self.feature) < F.lit(self.threshold)


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    """Information that a condition adds, times the rejected rows it leaves."""
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


def _best(rows: list[dict]) -> tuple[float, Condition | None]:
    p0 = sum(r["bad"] for r in rows)
    n0, best = len(rows) - p0, (0.0, None)
    for f in FEATURES:
        ordered = sorted(rows, key=lambda r: r[f])
        p = n = 0
        for k in range(len(ordered) - 1):
            p, n = p + ordered[k]["bad"], n + (not ordered[k]["bad"])
            a, b = ordered[k][f], ordered[k + 1][f]
            if a < b:
                for above, gain in ((False, _gain(p0, n0, p, n)), (True, _gain(p0, n0, p0 - p, n0 - n))):
                    if gain > best[0] + 1e-9:
                        best = (gain, Condition(f, above, (a + b) / 2))
    return best


def _covered(rule: list[Condition], rows: list[dict]) -> tuple[int, int]:
    hit = [r["bad"] for r in rows if all(c.holds(r) for c in rule)]
    return sum(hit), len(hit) - sum(hit)


def learn(rows: list[dict], precision: float = 0.97, most: int = 12, longest: int = 4) -> list[list[Condition]]:
    """Rules for rows marked ``bad``, in the order learned; each is at least ``precision`` right on the rows left when it was made."""
    left, rules, rng = list(rows), [], random.Random(11)
    while len(rules) < most and any(r["bad"] for r in left):
        rng.shuffle(left)
        grow, prune = [r for k, r in enumerate(left) if k % 3], [r for k, r in enumerate(left) if not k % 3]
        rule, some = [], grow
        while len(rule) < longest and any(not r["bad"] for r in some) and any(r["bad"] for r in some):
            gain, condition = _best(some)
            if condition is None:
                break
            rule.append(condition)
            some = [r for r in some if condition.holds(r)]
        value = lambda cut: (lambda p, n: (p - n) / (p + n) if p + n else -1.0)(*_covered(cut, prune))
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=value, default=[])
        p, n = _covered(rule, left) if rule else (0, 0)
        if p < 3 or p < precision * (p + n):
            break
        rules.append(rule)
        left = [r for r in left if not all(c.holds(r) for c in rule)]
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that holds, from 1; 0 for none."""
    out = None
    for k, rule in enumerate(rules, 1):
        both = rule[0].column()
        for c in rule[1:]:
            both &= c.column()
        out = F.when(both, F.lit(k)) if out is None else out.when(both, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, rows: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> list[list[Condition]]:
    """Rules learned from the statistics of at most ``rows`` labelled texts, those with the smallest hashes.

    Null labels and ids teach nothing, null texts count as empty; of several
    labels of one id the highest counts. No labels give no rules.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max("quality") == 0).alias("bad"))
    known = fewest_hashes(known, F.xxhash64("_id"), rows).orderBy("_hash", "_id").limit(rows).drop("_hash")
    some = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(known), F.col(id_col) == F.col("_id"))
    got = with_statistics(some).select(F.xxhash64("_id", "text").alias("_hash"), "_id", "bad", *FEATURES).orderBy("_hash", "_id").limit(rows).collect()
    return learn([r.asDict() for r in got])


def judge(docs: DataFrame, rules: list[list[Condition]], text_col: str = "text") -> DataFrame:
    """``docs`` with the statistics, base_failed, rule (the first that holds, or 0) and kept added.

    base_failed: fewer than 50 words, or more than half of them in repeated
    3-word windows. A null or empty text has no words and fails; repeated rows
    are each judged; clashing columns of these names are replaced; an empty
    table stays empty.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    made = ("base_failed", "rule", "kept")
    found = with_statistics(docs.select(*[c for c in docs.columns if c not in (*STATISTICS, *made)]), text_col)
    return found.withColumn("base_failed", failed).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)).drop("_words", "_lines", "_capitals", "_shouts")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = judge(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def statistics_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns alone, which SQL can express: the learned rules it cannot."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs, []).select("doc_id", *STATISTICS, "base_failed")


STATISTICS_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM d, unnest(range(1, greatest(len(w) - 1, 1))) AS r(i)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM x) y WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM m, unnest([0, 1, 2]) AS q(k) GROUP BY 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) y WHERE regexp_matches(line, '[^\x09-\x0D\x20]') GROUP BY 1),
s AS (SELECT d.doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
"""
