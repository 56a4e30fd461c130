"""Pages joined with ranges of pages that come from outside, as metadata or truth declare them: a binned interval join."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenia.operators.segmentation import instance_text

#: Pages in a bin. A range has a row for each bin that it touches, and a page meets the ranges of its own bin alone: longer bins make fewer rows of long
#: ranges, shorter ones fewer comparisons with ranges that only lie nearby.
BIN = 32
DECLARED = "dichiarata"


def within_file(ranges: DataFrame, pages: DataFrame) -> DataFrame:
    """ranges whose page_from and page_to lie within what their file has: a null bound is the file's own, and what lies beyond it is cut off.

    Ranges of files without pages, and those that begin after they end or after the file does, are gone. So a range never has more bins than its file.
    """
    bounds = pages.groupBy("file").agg(F.min("page_no").alias("_first"), F.max("page_no").alias("_last"))
    out = ranges.join(bounds, "file").withColumn("page_from", F.greatest("page_from", "_first")).withColumn("page_to", F.least("page_to", "_last"))
    return out.filter("page_from <= page_to").drop("_first", "_last")


def declared_pages(pages: DataFrame, ranges: DataFrame, bin_pages: int = BIN) -> DataFrame:
    """pages with doc_key, range_from and range_to: a row for each page in each range that holds it, bounds included.

    ranges: doc_key, file, page_from, page_to; they may overlap, and repeated ranges are ranges of their own. A null page_from or page_to is the file's
    first or last page. Pages in no range, and pages without a file or number, have no row. Other columns of ranges are not read.

    A range is cut into bins of pages and meets a page by (file, bin), an equi-join; the bounds are compared after it. A page lies in one bin, so each
    pair comes once. Work grows with pages and pairs: a range of very many pages is spread over its bins, and no file is one key.
    """
    told = within_file(ranges.select("doc_key", "file", "page_from", "page_to"), pages.select("file", "page_no"))
    bin_of = lambda c: F.floor(F.col(c) / bin_pages)
    cut = told.select("doc_key", "file", F.col("page_from").alias("range_from"), F.col("page_to").alias("range_to"), F.explode(F.sequence(bin_of("page_from"), bin_of("page_to"))).alias("_bin"))
    out = pages.withColumn("_bin", bin_of("page_no")).join(cut, ["file", "_bin"]).filter((F.col("range_from") <= F.col("page_no")) & (F.col("page_no") <= F.col("range_to")))
    return out.drop("_bin")


def declared_instances(pages: DataFrame, ranges: DataFrame, bin_pages: int = BIN) -> DataFrame:
    """The rows of `segmentation.instances`, one for each declared range that has pages, named by its doc_key; its confidence says that it was declared.

    segment numbers a file's ranges by their bounds and key. A range that is declared twice with one key is one instance. One exchange by (file, bin),
    one by range, and one by file for the numbers.
    """
    rows = declared_pages(pages, ranges.select("doc_key", "file", "page_from", "page_to").distinct(), bin_pages).withColumnsRenamed({"range_from": "page_from", "range_to": "page_to"})
    out = instance_text(rows.groupBy("file", "doc_key", "page_from", "page_to"))
    order = Window.partitionBy("file").orderBy("page_from", "page_to", "doc_key")
    out = out.withColumn("segment", (F.row_number().over(order) - 1).cast("long"))
    return out.select("file", F.col("doc_key").alias("instance_id"), "segment", "page_from", "page_to", F.lit(DECLARED).alias("seg_confidence"), "pages", "text")
