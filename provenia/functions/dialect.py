"""Captures by patterns in Python's dialect, and the fence around long expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from provenia.functions.patterns import can_be_empty, capture_of, java


def captures(text: Column, pattern: str) -> Column:
    """The captures of all matches."""
    return F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(capture_of(pattern)[0]))


def unique_of(found: Column, pattern: str) -> Column:
    """unique_capture from the pattern's captures, which are a column: they are one and the same text if the least is the greatest."""
    one = F.when(F.array_min(found) == F.array_max(found), F.get(found, F.lit(0)))
    return one if capture_of(pattern)[1] else F.nullif(one, F.lit(""))


def unique_capture(text: Column, pattern: str) -> Column:
    """The capture of all matches if it is one and the same text, else NULL: none and two different ones both say nothing. An empty capture is a text; a group that took
    no part in the match is NULL."""
    group, may_be_empty = capture_of(pattern)
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(group)))
    # an element of an array, so that it is computed once and used twice
    one = F.get(F.get(F.filter(F.array(found), lambda x: F.size(x) == 1), F.lit(0)), F.lit(0))
    return one if may_be_empty else F.nullif(one, F.lit(""))


def first_capture(text: Column, pattern: str) -> Column:
    """The capture of the first match, NULL without one or where the group took no part."""
    group, may_be_empty = capture_of(pattern)
    one = F.regexp_extract(text, java(pattern), group)
    if not may_be_empty or not can_be_empty(pattern):  # then nothing but the lack of a match, or of the group in it, gives the empty text
        return F.nullif(one, F.lit(""))
    return F.when(F.regexp_like(text, F.lit(java(pattern))), one)


def fence(x: Column) -> Column:
    """x, computed once where it stands. The condition always holds, but Catalyst takes it for one that may differ each time, and so neither copies x into each of
    its uses nor pushes filters on it below: chains of long expressions would otherwise multiply into plans that take minutes to make."""
    return F.when(F.expr("monotonically_increasing_id() >= 0"), x)


def walled(columns: dict[str, Column]) -> dict[str, Column]:
    """The columns of one step, each behind a fence, the first behind one that is called by reflection and so isn't part of whole-stage code.

    The step is then compiled on its own, in small methods, and not in one with its neighbours: the JVM leaves methods of 8,000 bytes and more to its interpreter. A row is
    copied at each wall, so they stand only where the code between them would be too long.
    """
    wall = F.expr("reflect('java.lang.Integer', 'signum', 1) = '1'")
    return {c: F.when(wall, x) if k == 0 else fence(x) for k, (c, x) in enumerate(columns.items())}
