"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line, or, for notices that are wrapped, any run of twice as many
words as a template has. Template words are put in order of how few documents
hold them; a block that holds enough of a template must hold one of its rarest
words, early enough in both orders, so only such pairs meet. Their overlap is
then counted on the whole sets. Only DataFrame functions run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.native import let, split_words, upto

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices that are looked for, with their labels.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def template_words(text: str) -> list[str]:
    """Distinct lower-cased words of a template, as ``GAP`` splits them."""
    low = "".join(c.lower() if c.isascii() else c for c in text)
    return list(dict.fromkeys("".join(c if c.isalnum() or not c.isascii() else " " for c in low).split()))


def _reach(templates: tuple) -> int:
    """Words of the longest run that is held against a template, but one."""
    return max(2 * _length(t) for _, t in templates) - 1


def _length(text: str) -> int:
    """Words of a template, repeated ones too."""
    return len("".join(c if c.isalnum() or not c.isascii() else " " for c in text).split())


def _words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased. Other letters change as well, but none becomes one of a-z, as the Kelvin sign, the only one that would, is put aside first."""
    return split_words(_lower(text), GAP)


def _lower(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\ufffd")))


def _literals(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _prefix_index(spark: SparkSession, frequency: dict[str, int], templates: tuple, num: int, den: int) -> tuple[DataFrame, list[str]]:
    """A row for each word of each template's prefix, and all of the templates' words, rarest first."""
    every = sorted({w for _, t in templates for w in template_words(t)}, key=lambda w: (frequency.get(w, 0), w))
    rows = []
    for k, (name, text) in enumerate(templates):
        words = sorted(template_words(text), key=lambda w: (frequency.get(w, 0), w))
        least = math.ceil(num * len(words) / den)
        for i, w in enumerate(words[: len(words) - least + 1]):
            rows.append(F.struct(F.lit(w).alias("word"), F.lit(k).alias("template"), F.lit(name).alias("label"), F.lit(i).alias("at"), F.lit(len(words)).alias("size"), F.lit(least).alias("least"), F.lit(2 * _length(text)).alias("run"), _literals(words).alias("words")))
    return spark.range(1).select(F.explode(F.array(*rows)).alias("row")).select("row.*"), every


def _frequency(base: DataFrame, templates: tuple) -> dict[str, int]:
    """How many documents hold each of the templates' words."""
    vocabulary = sorted({w for _, t in templates for w in template_words(t)})
    held = F.array_intersect(_words(F.col("text")), _literals(vocabulary))
    return {r["word"]: r["n"] for r in base.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}


def _rare(templates: tuple, frequency: dict[str, int], num: int, den: int) -> list[str]:
    """The words of all templates' prefixes."""
    return sorted({w for _, t in templates for w in sorted(template_words(t), key=lambda w: (frequency.get(w, 0), w))[: len(template_words(t)) - math.ceil(num * len(template_words(t)) / den) + 1]})


def matching_runs(docs: DataFrame, templates: tuple = TEMPLATES, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", frequency: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, word, template, label, containment) where a run of words, over lines too, holds ``num / den`` of a template's distinct words.

    A run has twice as many words as the template, or is the whole of a shorter
    text. ``word`` is the place of a word of the template's prefix, from 0;
    containment is the highest of all runs with it. Of each place the words as
    far as any run reaches are taken, and every run in them is counted where
    they hold enough of the template.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    frequency = _frequency(base, templates) if frequency is None else frequency
    index, _ = _prefix_index(docs.sparkSession, frequency, templates, num, den)
    rare, reach = _literals(_rare(templates, frequency, num, den)), _reach(templates)

    def anchors(w: Column) -> Column:
        places = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(rare, x), i)), lambda i: i.isNotNull())
        return F.transform(places, lambda i: F.struct(i.cast("long").alias("place"), F.get(w, i).alias("word"), F.least(i, F.lit(reach)).alias("before"), F.slice(w, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)) + 1 + reach).alias("near")))

    held = base.where(F.arrays_overlap(_words(F.col("text")), rare))
    found = held.select("doc_id", F.explode(let(_words(F.col("text")), anchors)).alias("x")).select("doc_id", "x.*")
    # the words that a run of this template with the word in it can have, and the place of the word in them
    lo = F.greatest(F.col("before") - F.col("run") + 1, F.lit(0))
    pairs = found.join(F.broadcast(index), "word").withColumn("near", F.slice("near", lo + 1, F.col("before") - lo + F.col("run")))
    pairs = pairs.where(F.size(F.array_intersect("near", "words")) >= F.col("least"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("near") - F.col("run"), F.lit(0)))
    shared = F.array_max(F.transform(starts, lambda k: F.size(F.array_intersect(F.slice("near", k + 1, F.col("run")), F.col("words")))))
    return pairs.withColumn("shared", shared).where(F.col("shared") >= F.col("least")).select("doc_id", F.col("place").alias("word"), "template", "label", (F.col("shared") / F.col("size")).alias("containment"))


def matching_blocks(docs: DataFrame, templates: tuple = TEMPLATES, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", frequency: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, block, template, label, containment) for every line that holds ``num / den`` of a template's distinct words.

    Lines count from 0. Null and empty texts match nothing; repeated rows give
    repeated results; a null doc_id stays null; other columns are not read; an
    empty table gives no rows. The templates are a parameter of a few dozen
    rows, so their index is broadcast.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    frequency = _frequency(base, templates) if frequency is None else frequency
    index, ordered = _prefix_index(docs.sparkSession, frequency, templates, num, den)
    fewest = min(math.ceil(num * len(template_words(t)) / den) for _, t in templates)
    rare = _rare(templates, frequency, num, den)
    likely = base.where(F.arrays_overlap(_words(F.col("text")), _literals(rare)))
    blocks = likely.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "line"))
    # a block's words that are in some template, rarest first
    kept = blocks.select("doc_id", "block", F.array_intersect(_literals(ordered), _words(F.col("line"))).alias("held")).where(F.size("held") >= fewest)
    begun = kept.select("doc_id", "block", "held", F.posexplode(F.slice("held", 1, F.greatest(F.size("held") - fewest + 1, F.lit(1)))).alias("place", "word"))
    ahead = F.least(F.size("held") - F.col("place"), F.col("size") - F.col("at"))
    pairs = begun.join(F.broadcast(index), "word").where((F.size("held") >= F.col("least")) & (ahead >= F.col("least")))
    shared = F.size(F.array_intersect("held", "words"))
    # a pair may meet in several prefix words; only the first one in the block's order reports it
    first = F.get(F.array_intersect("held", F.slice("words", 1, F.col("size") - F.col("least") + 1)), 0) == F.col("word")
    return pairs.where(first & (shared >= F.col("least"))).select("doc_id", "block", "template", "label", (shared / F.col("size")).alias("containment"))


def _places(words: Column) -> Column:
    """(word, label) of every place where a phrase's words stand one after another."""

    def at(i: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, label in PHRASES.items():
            same = None
            for k, w in enumerate(phrase.split()):
                one = F.coalesce(F.get(words, i + k) == F.lit(w), F.lit(False))
                same = one if same is None else same & one
            out = F.when(same, F.lit(label)).otherwise(out)
        return F.struct(i.cast("long").alias("word"), out.alias("label"))

    return F.filter(F.transform(upto(F.size(words)), at), lambda p: p["label"].isNotNull())


def scan(docs: DataFrame, templates: tuple = TEMPLATES, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every whole text.

    Base: places of the phrases' words, one after another. ``labels`` adds those
    of the templates that a line or a run of words holds; score is the highest containment, and 1
    with a base place. What templates add is joined by a digest of id and text, so
    rows with a null or repeated doc_id get the labels of their own texts, and
    copies of a text under many ids do not meet in one key. A null or empty text has no words; other columns are
    not read; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.sha2(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(" "), F.col(text_col).cast("string")), 256).alias("_key"))
    pattern = "|".join(rf"{GAP}".join(p.split()) for p in PHRASES)
    likely = F.coalesce(_lower(F.col("text")).rlike(pattern), F.lit(False))
    none = F.array().cast("array<struct<word:bigint,label:string>>")
    words = let(_words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.when(likely, _places(w)).otherwise(none).alias("places")))
    base = docs.select("doc_id", "_key", words.alias("_w")).select("doc_id", "_key", F.col("_w.n").alias("n_words"), F.col("_w.places").alias("_places"))
    frequency = _frequency(docs, templates)
    either = [f(docs, templates, num, den, "_key", "text", frequency).select(F.col("doc_id").alias("_key"), "label", "containment") for f in (matching_blocks, matching_runs)]
    found = either[0].unionByName(either[1]).groupBy("_key").agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_score"))
    starts = F.transform("_places", lambda p: p["word"])
    own = F.array_distinct(F.transform("_places", lambda p: p["label"]))
    join = lambda a: F.array_join(F.array_sort(a), ",")
    return base.join(found, "_key", "left").select(
        "doc_id",
        "n_words",
        F.size("_places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        join(own).alias("base_labels"),
        join(F.array_union(own, F.coalesce("_more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("_places") > 0, F.lit(1.0)).otherwise(F.coalesce("_score", F.lit(0.0))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    """Every line against every template, with no filter."""
    rows = ", ".join(f"({k}, '{name}', {template_words(text)!r})" for k, (name, text) in enumerate(TEMPLATES))
    words = lambda c: f"list_filter(regexp_split_to_array(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    at = " OR ".join("(" + " AND ".join(f"coalesce(w[i + {k}] = '{x}', false)" for k, x in enumerate(p.split())) + ")" for p in PHRASES)
    label = "CASE " + " ".join(f"WHEN w[i] = '{p.split()[0]}' THEN '{name}'" for p, name in PHRASES.items()) + " END"
    return f"""
WITH t(k, label, words) AS (VALUES {rows}),
d AS (SELECT doc_id, {words("text")} AS w FROM documents),
p AS (SELECT doc_id, i - 1 AS word, {label} AS label FROM d, unnest(range(1, len(w) + 1)) AS r(i) WHERE {at}),
b AS (SELECT doc_id, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word, list_sort(list_distinct(list(label))) AS own FROM p GROUP BY doc_id),
l AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) AS x WHERE line <> ''),
lw AS (SELECT doc_id, list_distinct({words("line")}) AS w FROM l),
m AS (SELECT doc_id, label, len(list_intersect(w, words)) AS n, len(words) AS size FROM lw, t),
f AS (SELECT doc_id, list(label) AS more, max(n / size) AS score FROM m WHERE 100 * n >= 80 * size GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(own, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN f USING (doc_id)
"""


ORACLE_SQL = _oracle()
