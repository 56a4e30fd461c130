"""A page's orientation from where its characters stand, without recognising any: text runs along lines, from their start to their end."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that a page must have for a vote; the share of votes that the winner needs; how far along the line, in character sizes, the next one may be.
LEAST, SHARE, REACH = 20, 0.6, 3.0


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x computed once, however often use names it: an element of an array, which a lambda has as a variable."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def votes(chars: Column) -> Column:
    """array of four counts, for 0, 90, 180 and 270 degrees, of steps between neighbours in native order: array<struct<x0, top, x1, bottom>>.

    The next character of a line stands to the right of an upright one, below it on a page turned by 90 degrees clockwise, to the left at 180, above at 270.
    A step counts if it is at most REACH character sizes long and goes mainly one way; steps to another line are longer or go back.
    """

    def mark(c: Column) -> Column:
        size = F.greatest(c["x1"] - c["x0"], c["bottom"] - c["top"])
        return F.struct(((c["x0"] + c["x1"]) / 2).alias("x"), ((c["top"] + c["bottom"]) / 2).alias("y"), size.alias("size"))

    def step(a: Column, b: Column) -> Column:
        return F.struct((b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"), (REACH * F.greatest(a["size"], b["size"])).alias("reach"))

    def way(s: Column) -> Column:
        dx, dy, reach = s["dx"], s["dy"], s["reach"]
        flat, steep = (F.abs(dx) > 2 * F.abs(dy)) & (F.abs(dx) <= reach), (F.abs(dy) > 2 * F.abs(dx)) & (F.abs(dy) <= reach)
        return F.when(flat & (dx > 0), 0).when(steep & (dy > 0), 1).when(flat, 2).when(steep, 3)

    def steps(marks: Column) -> Column:
        n = F.greatest(F.size(marks) - 1, F.lit(0))
        return F.transform(F.zip_with(F.slice(marks, F.lit(1), n), F.slice(marks, F.lit(2), n), step), way)

    count = lambda ways: F.transform(F.array(*map(F.lit, range(4))), lambda k: F.size(F.filter(ways, lambda w: w == k)))
    return once(once(F.transform(chars, mark), steps), count)


def page_orientation(chars: Column, least: int = LEAST, share: float = SHARE) -> Column:
    """0, 90, 180 or 270, how far the text is turned clockwise; NULL with fewer than `least` characters, without a way that has `share` of the votes, or on a tie."""
    told = lambda v: F.when(F.array_max(v) >= share * F.greatest(F.aggregate(v, F.lit(0), lambda a, x: a + x), F.lit(1)), F.when(F.size(F.filter(v, lambda x: x == F.array_max(v))) == 1, (F.array_position(v, F.array_max(v)) - 1) * 90))
    return once(chars, lambda c: F.when(F.coalesce(F.size(c), F.lit(0)) >= least, once(votes(c), told))).cast("int")


def with_orientation(pages: DataFrame, chars_col: str = "char_boxes") -> DataFrame:
    """pages with osd_rotation, which triage reads: what their character boxes say, else what was there."""
    found = page_orientation(F.col(chars_col))
    return pages.withColumn("osd_rotation", F.coalesce(found, F.col("osd_rotation")) if "osd_rotation" in pages.columns else found)
