"""Lines of a text, and values that an expression computes once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines_of(text: Column) -> Column:
    """Lines, ended as Python's splitlines() ends them, without the empty one behind a last line end; a null or empty text has none."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n|[\r\x0B\x0C\x1C-\x1E\u0085\u2028\u2029]", "\n")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(t, r"\n\z", ""), "\n"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value computed once a row however often it is used, and wherever the optimizer copies the whole to: a column of its own may be put back
    into each place that reads it, a lambda among them, and then be computed for each element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
