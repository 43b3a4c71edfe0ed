"""String expressions with the whitespace and search rules the records need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space: what separates words and what strip() removes.
WHITE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def blanks(text: Column, old: str = "", new: str = "") -> Column:
    """Every white space character as a blank; ``old`` characters as ``new`` ones."""
    return F.translate(text, WHITE + old, " " * len(WHITE) + new)


def words(text: Column) -> Column:
    """Non-empty pieces between runs of white space."""
    return F.array_remove(F.split(blanks(text), " +"), "")


def first_words(text: Column, n: int) -> Column:
    """The first ``n`` words; splitting stops there."""
    # one piece more for a blank at the start, one for the rest of the text
    return F.slice(F.array_remove(F.split(blanks(text), " +", n + 2), ""), 1, n)


def collapse(text: Column, old: str = "", new: str = "") -> Column:
    """Single blanks between words, none at the ends; one pass also maps ``old`` to ``new``.

    Plain character mapping first: a pattern over all white space costs three
    times as much per row.
    """
    return F.trim(F.regexp_replace(blanks(text, old, new), "  +", " "))


def occurrences(text: Column, needle: str) -> Column:
    """Number of non-overlapping places where ``needle`` occurs."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(needle)))
    return (removed / F.lit(len(needle))).cast("int")


def contains_any(text: Column, needles: list[str]) -> Column:
    found = text.contains(needles[0])
    for needle in needles[1:]:
        found = found | text.contains(needle)
    return found


def find(text: Column, needle: Column) -> Column:
    """0-based position of ``needle``, -1 if absent."""
    return F.position(needle, text) - F.lit(1)


def unquote(text: Column) -> Column:
    """Remove one pair of enclosing double quotes."""
    return F.regexp_replace(text, '(?s)^"(.*)"$', "$1")


def one_of(text: Column, values: list[str]) -> Column:
    return F.array_contains(F.array(*[F.lit(v) for v in values]), text)
