"""Small Column helpers shared by the text functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A sub-expression named inside a lambda is evaluated again for every element, so
    anything reused there is bound to a lambda variable first.
    """
    return F.transform(F.array(value), body)[0]


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+\z", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+", "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def strip_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\n+|\n+\z", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"(?U)\S")


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def split_lines(c: Column) -> Column:
    """Lines of a text without their terminators; a trailing newline opens no further line."""
    body = F.regexp_replace(c, r"(?:\r\n|[\n\r\x{0B}\f\x{85}\x{2028}\x{2029}])\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(
        F.split(body, r"\r\n|[\n\r\x{0B}\f\x{85}\x{2028}\x{2029}]", -1)
    )


def raw_lines(c: Column) -> Column:
    """Newline-separated pieces; joining them with a newline gives the text back unchanged."""
    return F.split(c, "\n", -1)


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def newline_count(c: Column) -> Column:
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit("\n"), F.lit("")))


def tail_from(arr: Column, start0: Column) -> Column:
    """Elements of ``arr`` from the 0-based index on."""
    return F.slice(arr, start0 + 1, F.greatest(F.size(arr) - start0, F.lit(0)))


def head_to(arr: Column, end0: Column) -> Column:
    """Elements of ``arr`` before the 0-based index."""
    return F.slice(arr, F.lit(1), end0)
