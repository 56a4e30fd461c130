"""Extraction on a stream of pages: state by file keeps what has come until the file is whole or its time is up."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from provenia.operators.stages import workers_find_package
from provenia.plans.compiler import contract, extract
from provenia.plans.schema import Schema

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Pages that leave at a time, and how long a file waits for its pages, in milliseconds.
BATCH, WAIT_MS = 1000, 3_600_000


class WholeFiles(StatefulProcessor):
    """Pages by file, kept as they come, one state entry for each page number: the first that comes with a number stays.

    As soon as a file has as many pages as it says, or `wait_ms` after its first page, its pages leave together and their state is cleared. That the
    file has left is remembered for `wait_ms` more, so that pages that come twice don't open it anew; then this goes, too. Pages of a file that
    come after its time was up and before that end are dropped, those later begin a new file.
    """

    def __init__(self, kept: StructType, wait_ms: int):
        self.kept, self.wait_ms = kept, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        number = StructType([StructField("page_no", IntegerType())])
        self.pages = handle.getMapState("pages", number, self.kept)
        self.total = handle.getValueState("total", StructType([StructField("total", IntegerType()), StructField("have", IntegerType())]))
        self.left = handle.getValueState("left", StructType([StructField("whole", BooleanType())]), self.wait_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        gone = self.left.exists()
        total, have = self.total.get() if self.total.exists() else (None, 0)
        new = have == 0
        for df in rows:
            if gone:
                continue
            for row in df[["page_no", "total_pages", *self.kept.names]].itertuples(index=False, name=None):
                number, told, page = row[0], row[1], row[2:]
                if not pd.isna(told):
                    total = max(int(told), total or 0)
                at = (None if pd.isna(number) else int(number),)
                if at[0] is not None and not self.pages.containsKey(at):
                    self.pages.updateValue(at, tuple(None if x is None or (isinstance(x, float) and pd.isna(x)) else x for x in page))
                    have += 1
        if gone or (have == 0 and total is None):
            return
        if total is not None and have >= total:
            yield from self.leave(key, True)
            return
        self.total.update((total, have))
        if new and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.leave(key, False)

    def leave(self, key: tuple, whole: bool) -> Iterator[pd.DataFrame]:
        part: list[tuple] = []
        columns = ["file", "page_no", *self.kept.names, "whole"]
        for number, page in self.pages.iterator():
            part.append((key[0], number[0], *page, whole))
            if len(part) == BATCH:
                yield pd.DataFrame(part, columns=columns)
                part = []
        if part:
            yield pd.DataFrame(part, columns=columns)
        self.pages.clear()
        self.total.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.left.update((whole,))

    def close(self) -> None:
        pass


def whole_files(pages: DataFrame, wait_ms: int = WAIT_MS) -> DataFrame:
    """pages(file, page_no, total_pages, ...), a stream in any order and with repeats, as files: file, page_no, the other columns, whole.

    All pages of a file come in one batch, whole=true when there are as many as total_pages says (NULL: not known from this page), false when the wait was over.
    Pages without a number or a file are dropped: they have no place. The other columns are flat. State lies in RocksDB, by page, so that a file needn't fit in memory.
    """
    spark = pages.sparkSession
    workers_find_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kept = StructType([f for f in pages.schema if f.name not in ("file", "page_no", "total_pages")])
    out = StructType([StructField("file", StringType()), StructField("page_no", IntegerType()), *[StructField(f.name, f.dataType) for f in kept], StructField("whole", BooleanType())])
    rows = pages.filter("file IS NOT NULL AND page_no IS NOT NULL").selectExpr("file", "cast(page_no as int) page_no", "cast(total_pages as int) total_pages", *[f"`{n}`" for n in kept.names])
    return rows.groupBy("file").transformWithStateInPandas(WholeFiles(kept, wait_ms), out, "Append", "ProcessingTime")


def start(pages: DataFrame, schema: Schema, path: str, checkpoint: str, wait_ms: int = WAIT_MS, trigger: dict | None = None):
    """A query that writes each batch's results (file, instance_id, whole, result) below path, in a folder by batch, so that a batch that is tried again replaces its own.

    A result's `whole` says whether all its file's pages were there. With the default trigger the query takes what is there and ends; files whose time was up leave with
    the next batch that has data. With an interval they leave at its next turn.
    """

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()  # what the state gave out is read twice below
        files = held.select("file", "whole").distinct()
        contract(extract(held.drop("whole"), schema), schema).join(files, "file").write.mode("overwrite").parquet(f"{path}/batch={number}")
        held.unpersist()

    trigger, conf = trigger or {"availableNow": True}, pages.sparkSession.conf
    # timers ask for batches without data for ever: a query that is to end with its data must not wait for them
    idle, before = "spark.sql.streaming.noDataMicroBatches.enabled", conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    conf.set(idle, str("availableNow" not in trigger).lower())
    try:
        return whole_files(pages, wait_ms).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    finally:
        conf.set(idle, before)
