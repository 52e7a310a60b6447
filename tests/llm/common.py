"""Rows with every odd case that the operators must take."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, part int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def words(text):
    return WORDS.findall(lower(text))


def shingles(text, width=5):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def prose(n, seed, vocabulary=400):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(vocabulary)]
    return " ".join(rng.choice(pool) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def edited(text, changes, seed):
    rng, w = random.Random(seed), text.split(" ")
    for i in rng.sample(range(len(w)), changes):
        w[i] = f"new{rng.randint(0, 10**6)}"
    return " ".join(w)


def odd_texts():
    base = prose(120, 1)
    return [
        None,
        "",
        " \t\n ",
        "one",
        "two words",
        "One  double\n\nspace \n end ",
        base,
        base,
        base.upper(),
        edited(base, 2, 2),
        edited(base, 40, 3),
        "ÉTÉ déjà vu — naïve space   line",
        "\U0001f600 emoji \U0001f600",
        "x" * 5000,
        prose(6000, 4),
        "<|endoftext|> plain",
    ]


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "src", None, 0.5, "clash", 7) for i, t in zip(ids, texts)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
