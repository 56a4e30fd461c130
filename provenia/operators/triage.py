"""What each page is: text layer, density, image coverage, type, rotation; and the reading order of upside-down pages."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITAL, HYBRID, SCAN = "digitale", "ibrida", "scansione"
#: Coverage strictly below the first is digital, strictly above the second a scan.
DIGITAL_BELOW, SCAN_ABOVE = 0.15, 0.85
GRID = 64
LINE_GAP = 2.0


def _cells(low: Column, high: Column, size: Column) -> tuple[Column, Column]:
    """The first and the last of GRID cells along a side of this size whose centres lie in [low, high]; first > last where there are none.

    Division gives the cell to within one; its neighbours' centres decide, computed as everywhere else, so that closed borders are exact.
    """
    centre = lambda i: (i + 0.5) * size / GRID
    near = lambda x: F.greatest(F.least(x * GRID / size - 0.5, F.lit(GRID + 1.0)), F.lit(-2.0))
    first, last = F.ceil(near(low)).cast("int"), F.floor(near(high)).cast("int")
    first = F.when(centre(first - 1) >= low, first - 1).when(centre(first) >= low, first).otherwise(first + 1)
    last = F.when(centre(last + 1) <= high, last + 1).when(centre(last) <= high, last).otherwise(last - 1)
    return F.greatest(first, F.lit(0)), F.least(last, F.lit(GRID - 1))


def image_coverage(images: Column, width: Column, height: Column) -> Column:
    """The share of the cells of a 64 x 64 grid whose centre lies in an image box, borders included; 0 without images or area.

    A box covers a rectangle of cells: rows from one to another, and in each the same columns, one bit each of a 64-bit mask. A row's masks
    are joined by OR over the boxes that reach it.
    """
    ones = F.lit(-1).cast("long")

    def reach(b: Column) -> Column:
        left, right = _cells(b["x0"], b["x1"], width)
        top, bottom = _cells(b["top"], b["bottom"], height)
        mask = F.call_function("shiftleft", ones, left).bitwiseAND(F.call_function("shiftrightunsigned", ones, GRID - 1 - right))
        return F.struct(top.alias("top"), bottom.alias("bottom"), F.when(left <= right, mask).otherwise(F.lit(0).cast("long")).alias("mask"))

    def covered(boxes: Column) -> Column:
        row = lambda j: F.bit_count(F.aggregate(boxes, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.when((b["top"] <= j) & (j <= b["bottom"]), b["mask"]).otherwise(F.lit(0).cast("long")))))
        return F.aggregate(F.sequence(F.lit(0), F.lit(GRID - 1)), F.lit(0), lambda n, j: n + row(j))

    # the boxes are an element of an array here, so that a lambda has them once and not anew for each row
    total = F.get(F.transform(F.array(F.transform(images, reach)), covered), F.lit(0))
    return F.when((F.coalesce(F.size(images), F.lit(0)) > 0) & (width > 0) & (height > 0), total / float(GRID * GRID)).otherwise(F.lit(0.0))


def text_density(n_chars: Column, width: Column, height: Column) -> Column:
    return F.coalesce(F.try_divide(n_chars.cast("double"), width * height), F.lit(0.0))


def page_type(coverage: Column, digital_below: float = DIGITAL_BELOW, scan_above: float = SCAN_ABOVE) -> Column:
    return F.when(coverage < digital_below, DIGITAL).when(coverage > scan_above, SCAN).otherwise(HYBRID)


def page_rotation(rotation: Column, kind: Column, detected: Column) -> Column:
    """The page's own rotation if not 0; else for scans and hybrids what a detector found, NULL if nothing; else 0."""
    return F.when(rotation != 0, rotation).when(kind.isin(SCAN, HYBRID), detected).otherwise(F.lit(0))


def triage(pages: DataFrame, digital_below: float = DIGITAL_BELOW, scan_above: float = SCAN_ABOVE) -> DataFrame:
    """pages with has_text, density, coverage, page_type, page_rotation. Columns a source lacks count as no images, rotation 0, none detected."""
    have = set(pages.columns)
    images = F.col("images") if "images" in have else F.array().cast("array<struct<x0:double,top:double,x1:double,bottom:double>>")
    rotation = F.coalesce(F.col("rotation"), F.lit(0)) if "rotation" in have else F.lit(0)
    detected = F.col("osd_rotation") if "osd_rotation" in have else F.lit(None).cast("int")
    n = F.coalesce(F.col("n_chars"), F.lit(0)) if "n_chars" in have else F.length("text")
    out = pages.withColumn("has_text", n > 0).withColumn("density", text_density(n, F.col("width"), F.col("height"))).withColumn("coverage", image_coverage(images, F.col("width"), F.col("height")))
    out = out.withColumn("page_type", page_type(F.col("coverage"), digital_below, scan_above))
    return out.withColumn("page_rotation", page_rotation(rotation, F.col("page_type"), detected))


def straightened(chars: Column) -> Column:
    """The text of an upside-down page from its characters in native order, array<struct<text, top>>.

    A line ends where the next character is 2 points or more away in height; lines go by the height of their first character, equal ones in their order.
    """
    far = lambda i: F.abs(F.get(chars, i)["top"] - F.get(chars, i - 1)["top"]) >= LINE_GAP
    starts = F.filter(F.sequence(F.lit(0), F.size(chars) - 1), lambda i: (i == 0) | far(i))
    stop = lambda k: F.coalesce(F.get(starts, k + 1), F.size(chars))
    line = lambda at, k: F.struct(F.get(chars, at)["top"].alias("top"), k.alias("k"), F.array_join(F.transform(F.slice(chars, at + 1, stop(k) - at), lambda c: c["text"]), "").alias("text"))
    lines = F.array_sort(F.transform(starts, line))
    return F.when(F.coalesce(F.size(chars), F.lit(0)) > 0, F.array_join(F.transform(lines, lambda x: x["text"]), "\n")).otherwise(F.lit(""))


def normalised_text(pages: DataFrame) -> DataFrame:
    """pages whose text is in reading order: at 180 degrees rebuilt from chars, else as it is; NULL is empty."""
    text = F.coalesce("text", F.lit(""))
    if "chars" in pages.columns and "rotation" in pages.columns:
        text = F.when((F.pmod(F.coalesce("rotation", F.lit(0)), F.lit(360)) == 180) & F.col("chars").isNotNull(), straightened(F.col("chars"))).otherwise(text)
    return pages.withColumn("text", text)


def raster_size(width: Column, height: Column, dpi: int = 150) -> tuple[Column, Column]:
    """Pixels of a page rendered at this resolution."""
    return F.ceil(width * dpi / 72).cast("long"), F.ceil(height * dpi / 72).cast("long")
