"""Repair of raw captures into canonical strings, and comparison of canonical values. What is ambiguous becomes NULL."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = r"\A[0-9]+\z"


def trimmed(v: Column) -> Column:
    return F.regexp_replace(v, r"(?U)\A\s+|\s+\z", "")


def _date(t: Column) -> Column:
    part = lambda at, n: F.substring(t, at, n)
    iso = F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2)).try_cast("date").cast("string")
    return F.when(F.regexp_like(t, F.lit(r"\A[0-9]{2}[/.-][0-9]{2}[/.-](?!0000)[0-9]{4}\z")), iso)


def _one_point(t: Column) -> Column:
    bare = F.replace(t, F.lit("."), F.lit(""))
    last = F.substring_index(t, ",", -1)
    whole = F.replace(F.substring(t, F.lit(1), F.length(t) - F.length(last) - 1), F.lit("."), F.lit(""))
    either = F.regexp_like(t, F.lit(r"\A[^.]*\.[0-9]{3}\z"))  # one dot, three digits after it
    plain = F.when(either, F.lit(None)).when(F.substring_index(t, ".", 2) != t, bare).otherwise(t)
    return F.when(F.contains(t, F.lit(",")), F.concat(whole, F.lit("."), last)).otherwise(plain)


def _number(x: Column) -> Column:
    # a zero before all, then those that aren't needed and a point at the end go ($10: group 1, then 0, as there is no group 10)
    number = F.regexp_replace(F.regexp_replace(x, r"\A\+?(-?)", "$10"), r"\A(-?)0+(?=[0-9])|\.\z", "$1")
    return F.when(F.regexp_like(x, F.lit(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\z")), number)


def _integer(t: Column) -> Column:
    return F.when(F.regexp_like(t, F.lit(r"\A-?[0-9]+\z")), F.regexp_replace(t, r"\A(?:-(?=0+\z)|(-?))0*(?=[0-9])", "$1"))


#: The steps of each repair. A step uses its input several times, so `operators.extraction` makes each a column of its own.
#: date: dd mm yyyy, each separator one of / . -, as ISO; an impossible date is NULL.
#: decimal: comma as decimal sign, dots between thousands. One dot and three digits after it could be either: NULL. The scale stays.
#: integer: every dot stands between thousands. string: each run of white space is one space; nothing left is NULL.
STEPS: dict[str, tuple[Callable[[Column], Column], ...]] = {
    "string": (lambda v: F.trim(F.regexp_replace(v, r"(?U)\s+", " ")), lambda t: F.nullif(t, F.lit(""))),
    "date": (trimmed, _date),
    "integer": (trimmed, lambda t: _integer(F.replace(t, F.lit("."), F.lit("")))),
    "decimal": (trimmed, _one_point, _number),
}


def repair(v: Column, kind: str) -> Column:
    for step in STEPS[kind]:
        v = step(v)
    return v


def as_decimal(v: Column) -> Column:
    return F.when(F.regexp_like(v, F.lit(r"\A[+-]?[0-9]*\.?[0-9]+\z|\A[+-]?[0-9]+\.\z")), v).try_cast("decimal(38,10)")


def as_date(v: Column) -> Column:
    return F.when(F.regexp_like(v, F.lit(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z")), v).try_cast("date")


def as_integer(v: Column) -> Column:
    return F.when(F.regexp_like(trimmed(v), F.lit(r"\A[+-]?[0-9]+\z")), trimmed(v)).try_cast("bigint")


def scale_of(v: Column) -> Column:
    return F.when(F.contains(v, F.lit(".")), F.length(F.substring_index(v, ".", -1))).otherwise(F.lit(0))


def decimal_text(x: Column, scale: Column) -> Column:
    """A decimal(38,10) as text with so many places, cut not rounded; more than ten count as ten."""
    s = x.cast("string")
    return F.when(scale == 0, F.substring_index(s, ".", 1)).otherwise(F.substring(s, F.lit(1), F.instr(s, ".") + scale))


def comparable(v: Column, kind: str) -> Column:
    """What a canonical value of this kind is compared by; NULL if it isn't one. Text ignores case and outer white space only."""
    return {"string": lambda: F.lower(trimmed(v)), "date": lambda: as_date(v).cast("string"), "integer": lambda: as_integer(v).cast("string"), "decimal": lambda: as_decimal(v).cast("string")}[kind]()


def same_value(actual: Column, expected: Column, kind: str) -> Column:
    """Equality with the truth: NULL equals NULL, as the truth's NULL means absent. Truth that isn't of its kind is an error; an answer that isn't is wrong."""
    truth, answer = comparable(expected, kind), comparable(actual, kind)
    bad = F.raise_error(F.concat(F.lit(f"truth is no {kind}: "), expected)).cast("boolean")
    return F.when(expected.isNull(), actual.isNull()).when(truth.isNull(), bad).otherwise(F.coalesce(truth == answer, F.lit(False)))


def agree(a: Column, b: Column, kind: str) -> Column:
    """Whether two sources say the same; values that aren't of the kind agree as raw text."""
    x, y = comparable(a, kind), comparable(b, kind)
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).when(x.isNull() | y.isNull(), a == b).otherwise(x == y)
