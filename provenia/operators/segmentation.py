"""Files into document instances: a new instance begins where the key on the pages changes."""

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenia.functions.dialect import first_capture
from provenia.operators.triage import DIGITAL
from provenia.plans.schema import Segmentation

CERTAIN, PRESUMED, UNKNOWN = "certa", "presunta", "non_determinabile"
LETTERS = 26


def letters(n: Column) -> Column:
    """a, b, ... z, aa, ab, ...: the n-th from 0, up to five letters."""
    out, first, count = F.lit(None).cast("string"), 0, LETTERS
    for size in range(1, 6):
        rest = n - first
        word = F.concat(*[F.chr(F.lit(ord("a")) + F.floor(rest / LETTERS**k) % LETTERS) for k in reversed(range(size))])
        out = F.coalesce(out, F.when(n < first + count, word))
        first, count = first + count, count * LETTERS
    return out


def stem(file: Column) -> Column:
    """The file's name without its folder and its last ending."""
    name = F.regexp_replace(file, r"\A.*/", "")
    return F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")


def segments(rows: DataFrame, by: list[str], order: list[str], key: Column, name: str = "segment") -> DataFrame:
    """rows numbered by segment from 0: runs of equal keys in order; a missing key goes with the one before, at the start with the first. A key that
    comes back later begins a new segment."""
    w = Window.partitionBy(*by).orderBy(*order)
    before, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    # a row begins a segment if it has a key and the last key before it is another
    out = rows.withColumn("_key", key)
    out = out.withColumn("_new", F.coalesce((F.col("_key") != F.last("_key", ignorenulls=True).over(before)).cast("int"), F.lit(0)))
    return out.withColumn(name, F.sum("_new").over(so_far)).drop("_key", "_new")


def segment_pages(pages: DataFrame, config: Segmentation | None) -> DataFrame:
    """pages(file, page_no, text, page_type) with segment, seg_confidence and last_segment, the file's greatest segment.

    In this order: no config is one certain instance; fewer pages than twice the least, all digital, too, without reading text; any page that isn't
    digital makes one of unknown bounds; no key on any page makes a presumed one; else the keys cut the file, with certainty.
    """
    if config is None:
        return pages.withColumn("segment", F.lit(0).cast("long")).withColumn("seg_confidence", F.lit(CERTAIN)).withColumn("last_segment", F.lit(0).cast("long"))
    file = Window.partitionBy("file").orderBy("page_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # ordered as the segments' windows: one step
    out = segments(pages.withColumn("_own", first_capture(F.col("text"), config.pattern)), ["file"], ["page_no"], F.col("_own"))
    out = out.withColumn("_pages", F.count("*").over(file)).withColumn("_digital", F.min(F.col("page_type") == DIGITAL).over(file)).withColumn("_keys", F.count("_own").over(file)).withColumn("_last", F.max("segment").over(file))
    kind = F.when((F.col("_pages") < 2 * config.least_pages) & F.col("_digital"), CERTAIN).when(~F.col("_digital"), UNKNOWN).when(F.col("_keys") == 0, PRESUMED).otherwise("cut")
    cut = lambda c: F.when(F.col("_kind") == "cut", F.col(c)).otherwise(F.lit(0))
    out = out.withColumn("_kind", kind).withColumn("segment", cut("segment")).withColumn("last_segment", cut("_last"))
    return out.withColumn("seg_confidence", F.when(F.col("_kind") == "cut", CERTAIN).otherwise(F.col("_kind"))).drop("_own", "_pages", "_digital", "_keys", "_kind", "_last")


def instance_text(groups: GroupedData, *more: Column) -> DataFrame:
    """A row for each group of pages, with `pages` (number, type) in order and `text`, that of digital pages alone, joined by line ends in page order."""
    page = F.struct("page_no", "page_type", "text")
    out = groups.agg(*more, F.sort_array(F.collect_list(page)).alias("_pages"))
    text = F.array_join(F.transform(F.filter("_pages", lambda p: p["page_type"] == DIGITAL), lambda p: p["text"]), "\n")
    told = F.transform("_pages", lambda p: F.struct(p["page_no"].alias("indice"), p["page_type"].alias("tipo")))
    return out.withColumn("pages", told).withColumn("text", text).drop("_pages")


def instances(pages: DataFrame, config: Segmentation | None) -> DataFrame:
    """One row for each instance: file, instance_id, page_from, page_to, seg_confidence, pages (number, type), text.

    The text is that of digital pages alone, joined by line ends in page order; an instance without any has empty text and stays a row.
    Windows and groups go by file: one shuffle.
    """
    out = segment_pages(pages, config)
    out = instance_text(out.groupBy("file", "segment"), F.min("page_no").alias("page_from"), F.max("page_no").alias("page_to"), F.first("seg_confidence").alias("seg_confidence"), F.first("last_segment").alias("last_segment"))
    name = F.when(F.col("last_segment") == 0, stem(F.col("file"))).otherwise(F.concat(stem(F.col("file")), letters(F.col("segment"))))
    return out.select("file", name.alias("instance_id"), "segment", "page_from", F.greatest("page_to", F.lit(1)).alias("page_to"), "seg_confidence", "pages", "text")
