"""Expressions on texts that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body's lambdas use it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def split_words(text: Column, gap: str = WHITE) -> Column:
    """Words between runs of ``gap``; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


def upto(n: Column) -> Column:
    """0 to n - 1; empty where n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
