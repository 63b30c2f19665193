"""Small text helpers shared by the parsers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space (the Unicode notion, which is wider than Java's \s).
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once per row.

    A column used in several places of one expression is otherwise evaluated in each of them, and one used inside a
    lambda over an array again for every element (the optimiser merges projections, so naming it does not help).
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim white space of every kind on both ends (``trim`` alone removes blanks only)."""
    return F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(strip(c), f"{SPACE}+", " ")


def words(c: Column) -> Column:
    """Words of a text as an array; an empty array for a blank text."""
    return F.filter(F.split(c, f"{SPACE}+"), lambda w: w != "")


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, NULL when nothing matches (``regexp_extract`` would return '')."""
    return F.get(F.regexp_extract_all(c, F.lit(pattern), group), F.lit(0))


def last_match(c: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), group), F.lit(-1))


def between(c: Column, opening: str, closing: str) -> Column:
    """Text between the first ``opening`` and the first ``closing`` after it, NULL when either is missing.

    Plain substring search: the same answer as a lazy regular expression, without a backtracking scan of long texts.
    """
    def inside(start: Column) -> Column:
        return let(
            F.position(F.lit(closing), c, start),
            lambda stop: F.when((start > len(opening)) & (stop > 0), F.substring(c, start, stop - start)),
        )

    return let(F.position(F.lit(opening), c) + len(opening), inside)


def cut(c: Column, length: int) -> Column:
    return F.substring(c, 1, length)


def cut_with_dots(c: Column, length: int) -> Column:
    return F.when(F.length(c) > length, F.concat(cut(c, length), F.lit("..."))).otherwise(c)
