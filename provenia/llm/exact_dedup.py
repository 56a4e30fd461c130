"""Exact deduplication over a persistent digest index that is bucketed and sorted by hash."""

import hashlib
import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenia.llm.common import SPACE, free_name, parallelism, remove, shared_dir, stage, unstage

#: Files of a bucket at which the index is written anew, one sorted file a bucket.
COMPACT_AT = 8


def normalised(text) -> F.Column:
    """Each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


class DigestIndex:
    """Digests seen so far, the row that stays for each, and the batch that brought it: a Parquet table under `path`, in `buckets` buckets by digest, each
    sorted by it.

    A batch meets the index in a sort-merge join that shuffles the batch alone, since the index lies in its buckets already.
    The same path opens the same index again, in another session too; buckets must then be the same. One writer at a time.
    Appends add a file to each bucket. From COMPACT_AT files on the table is written anew, to the next version's folder; a version counts
    once it is whole, so a job that dies meanwhile leaves the one before in use.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._open()

    def _open(self) -> None:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
        whole = [int(n[1:]) for n in names if re.fullmatch(r"v\d+", n) and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        self._at(max(whole, default=0))
        if not whole:
            remove(self.spark, self.folder)  # of a job that died before its first append was whole
        if not self.spark.catalog.tableExists(self.table):
            columns = "digest BINARY, keep_id BIGINT, batch STRING"
            self.spark.sql(f"CREATE TABLE {self.table} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.folder}'")

    def _at(self, version: int) -> None:
        self.version, self.folder = version, f"{self.path}/v{version}"
        self.table = "digest_index_" + hashlib.sha256(self.folder.encode()).hexdigest()[:32]

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def _write(self, rows: DataFrame) -> None:
        dealt = rows.select("digest", "keep_id", "batch").repartition(self.buckets, "digest")
        dealt.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.folder).saveAsTable(self.table)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The rows of groups(digest, ...) whose digest the index lacks: a sort-merge anti-join that moves groups alone."""
        return groups.hint("merge").join(self.read().select("digest"), "digest", "left_anti")

    def add(self, groups: DataFrame, batch: str) -> None:
        """Appends the digests of groups(digest, keep_id), unique by digest, that the index lacks, as of this batch; the same call again adds nothing."""
        self._write(self.unseen(groups).select("digest", "keep_id", F.lit(batch).alias("batch")))
        if len(self.read().inputFiles()) >= COMPACT_AT * self.buckets:
            self.rewrite()

    def rewrite(self, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """The rows of the index that keep leaves, as the next version; the old one goes when the new one is whole."""
        rows, old, table = self.read(), self.folder, self.table
        self._at(self.version + 1)
        remove(self.spark, self.folder)  # of a job that died here
        self._write(keep(rows))
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove(self.spark, old)

    def forget(self, batch: str) -> None:
        """Takes a batch back whose output was lost and that won't run again."""
        self.rewrite(lambda rows: rows.filter(F.col("batch") != batch))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        remove(self.spark, self.path)


def _batch(docs: DataFrame, index: DigestIndex, id_col: str, text_col: str, batch: str, row_col: str | None) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, digest, row) of a batch, and its groups (digest, keep_id, keep_row, group_size) as the index has them after it took the new ones in."""
    row = F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()
    rows = stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"), row.alias("row")), "digests")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    groups = rows.groupBy("digest").agg(first.alias("first"), F.count("*").alias("group_size"))
    groups = stage(groups.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("row"), "group_size"), "digest-groups")
    index.add(groups, batch)
    known = groups.drop("keep_id").hint("merge").join(index.read(), "digest")
    # what another batch brought has no row here
    known = known.select("digest", "keep_id", F.when(F.col("batch") == batch, F.col("row")).alias("keep_row"), "group_size")
    return rows, stage(known, "digest-known")


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None, row_col: str | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, row; the batch's new digests are appended to the index.

    Texts are equal when identical after each run of ASCII white space became one space. Of equal texts the row with the smallest id
    stays, a null id after all others; of rows with the same id and equal text the first, by row_col if it names a column of longs. Null text is
    empty text, and empty texts are equal. If the index holds the digest from another batch, no row of this one stays and keep_id is the other's.
    group_size counts the rows of this batch. Other columns of docs are not read. No rows give no rows.
    A batch that is run again under the same name, because its output was lost, keeps the rows that it kept before; without a name it is a
    new one. Only (row, id, digest) is shuffled, never a text. A digest of very many rows is summed before the shuffle. The batch's digests meet the index twice by
    sort-merge joins that leave the index where it lies: an anti-join finds the new ones, which are appended, and a join reads the row that stays for each.
    The join back to the rows reads both sides by an exchange, which adaptive execution splits where it is skewed.
    """
    rows, known = _batch(docs, index, id_col, text_col, batch or uuid.uuid4().hex, row_col)
    return _told(rows.join(known.hint("merge"), "digest"))


def _told(joined: DataFrame) -> DataFrame:
    return joined.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "row")


def by_id(docs: DataFrame, id_col: str = "doc_id", batches: int = 2) -> list[DataFrame]:
    """docs in so many batches of ascending ids, null ids in the last: each id lies in one batch, and what an earlier one keeps has the smaller id."""
    least, most = docs.agg(F.min(F.col(id_col).cast("long")), F.max(F.col(id_col).cast("long"))).first()
    if least is None:
        return [docs]
    edges = [least + (most - least) * k // batches for k in range(1, batches)]
    inside = lambda lo, hi: (F.col(id_col) > lo if lo is not None else F.lit(True)) & (F.col(id_col) <= hi)
    parts = [docs.filter(inside(lo, hi)) for lo, hi in zip([None, *edges], edges, strict=False)]
    return [*parts, docs.filter((F.col(id_col) > edges[-1]) | F.col(id_col).isNull())] if edges else [docs]


def exact_dedup_in_batches(parts: list[DataFrame], index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of exact_dedup for batches that come one after the other, with group_size over all of them: an earlier batch's row stays, so that with
    `by_id` the smallest id of all does."""
    made = [_batch(part, index, id_col, text_col, str(i), None) for i, part in enumerate(parts)]
    rows, known = (reduce(DataFrame.unionByName, [x[k].withColumn("part", F.lit(i)) for i, x in enumerate(made)]) for k in (0, 1))
    sizes = known.groupBy("digest").agg(F.sum("group_size").alias("group_size"))
    known = known.drop("group_size").join(sizes.hint("merge"), "digest")
    return _told(rows.join(known.hint("merge"), ["digest", "part"]))


def fresh_index(spark: SparkSession, name: str) -> DigestIndex:
    """An empty index in a folder of its own in the shared folder."""
    return DigestIndex(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", max(8, parallelism(spark)))


def drop_exact_copies(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The rows of docs that stay by exact_dedup, all their columns with them: of each text the row of the smallest id, nulls last; null text is empty text.

    Texts move only if some doc_id is null or not unique: then rows are told apart by a number that a table in the shared folder fixes,
    so that of rows with the same id and equal text one stays, and none of another text goes with it.
    """
    batch = batch or uuid.uuid4().hex
    flags = stage(exact_dedup(docs, index, batch=batch), "digest-flags")
    repeated = flags.groupBy("doc_id").count().filter((F.col("count") > 1) | F.col("doc_id").isNull())
    if repeated.isEmpty():
        return docs.join(flags.filter(~F.col("kept")).select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    row = free_name(docs, "digest_row")
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "digest-rows")
    # the same batch once more: what the index has of it counts as new
    lost = exact_dedup(rows, index, batch=batch, row_col=row).filter(~F.col("kept")).select(F.col("row").alias(row))
    return rows.join(lost, row, "left_anti").select(docs.columns)


__all__ = ["DigestIndex", "by_id", "drop_exact_copies", "exact_dedup", "exact_dedup_in_batches", "fresh_index", "normalised", "unstage"]
