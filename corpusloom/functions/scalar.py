"""Small scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int) -> Column:
    """Halves go up, also below zero: floor(x + 1/2) on the scaled value."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def slug(col: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def summary(*parts: str | Column) -> Column:
    """The parts that are there, joined by blanks."""
    return F.concat_ws(" ", *parts)


def tier_of(length: str) -> Column:
    return F.when(F.col(length) >= 5, "parallel").when(F.col(length) >= 4, "allusion").otherwise("echo")


def first_words(col: str, n: int = 9) -> Column:
    return F.array_join(F.slice(F.split(F.trim(col), r"\s+"), 1, n), " ")


def range_ref(book: str, start: str, end: str) -> Column:
    """Compressed reference of an inclusive interval of spine keys book * 1e6 + chapter * 1e3 + verse."""
    ch = lambda c: F.expr(f"({c} % 1000000) div 1000")
    v = lambda c: F.col(c) % 1000
    one = F.concat(F.col(book), F.lit(" "), ch(start), F.lit(":"), v(start))
    tail = F.when(F.col(start) == F.col(end), "").when(ch(start) == ch(end), F.concat(F.lit("-"), v(end))).otherwise(F.concat(F.lit("-"), ch(end), F.lit(":"), v(end)))
    return F.concat(one, tail)
