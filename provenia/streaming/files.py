"""Extraction on a stream of files: a row holds all pages of a file, so that no state is kept between rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.plans.compiler import contract, extract
from provenia.plans.schema import Schema


def results_of_batch(batch: DataFrame, schema: Schema) -> DataFrame:
    """Results of a batch of (file, pages array<struct<page_no, text, width, height, images, ...>>)."""
    pages = batch.select("file", F.inline("pages"))
    return contract(extract(pages, schema), schema)


def start(files: DataFrame, schema: Schema, path: str, checkpoint: str, trigger: dict | None = None, done: Callable[[int], None] | None = None):
    """A query that writes each batch's results below path, in a folder by batch, so that a batch that is tried again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        results_of_batch(batch, schema).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if done:
            done(number)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
