"""Small building blocks for expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body's lambdas use it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def upto(n: Column, first: int = 0) -> Column:
    """``first`` and the n - 1 numbers after it; empty where n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(first), n - 1 + first)).otherwise(F.array().cast("array<int>"))


def draw(*key: Column, most: int = 1_000_000) -> Column:
    """A number from 0 to ``most`` - 1 that depends on the key alone, as any engine that knows MD5 makes it."""
    text = F.concat_ws("|", *[k.cast("string") for k in key])
    return F.conv(F.substr(F.md5(text.cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("long") % most


def chars(s: Column) -> Column:
    """The characters of a string; an empty one has none."""
    return F.when(F.length(s) > 0, F.split(s, "")).when(s.isNotNull(), F.array().cast("array<string>"))
