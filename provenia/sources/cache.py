"""Replies that were paid for: a log by content key, by day of writing and in buckets, and a journal of those whose job isn't over yet."""

import hashlib
import json
import re
import time
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAYS, BUCKETS = 30, 16
COLUMNS = "key STRING, reply STRING, cost DOUBLE, written_at DOUBLE, day STRING"
HIT, EXPIRED, CORRUPT, MISSING = "hit", "expired", "corrupt", "missing"


def _day(seconds: float) -> str:
    return datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%d")


class ReplyLog:
    """Replies by key with a time to live of `days`: a Parquet table under `path`, partitioned by day of writing, each day in `buckets` buckets by key, sorted.

    Reading opens only the days that are young enough, and joins by key leave the log where it lies. Appends add files; compact() writes what is still
    valid anew, one entry a key, to the next version's folder, which counts once it is whole. The same path opens the same log again, in
    another session too; buckets must then be the same. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, days: float = DAYS, buckets: int = BUCKETS):
        self.spark, self.path, self.days, self.buckets = spark, path.rstrip("/"), days, buckets
        root = self._hadoop(self.path)
        names = [x.getPath().getName() for x in self._fs(root).listStatus(root)] if self._fs(root).exists(root) else []
        whole = [int(n[1:]) for n in names if re.fullmatch(r"v\d+", n) and self._fs(root).exists(self._hadoop(f"{self.path}/{n}/_SUCCESS"))]
        self._at(max(whole, default=0))

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _remove(self, path: str) -> None:
        self._fs(self._hadoop(path)).delete(self._hadoop(path), True)

    def _at(self, version: int) -> None:
        self.version, self.folder = version, f"{self.path}/v{version}"
        self.table = "reply_log_" + hashlib.sha256(self.folder.encode()).hexdigest()[:32]
        if not self.spark.catalog.tableExists(self.table):
            self.spark.sql(f"CREATE TABLE {self.table} ({COLUMNS}) USING parquet PARTITIONED BY (day) CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.folder}'")
            if self._fs(self._hadoop(self.folder)).exists(self._hadoop(self.folder)):
                self.spark.catalog.recoverPartitions(self.table)

    def _append(self, rows: DataFrame) -> None:
        dealt = rows.select("key", "reply", "cost", "written_at", "day").repartition(self.buckets, "key")
        dealt.write.mode("append").format("parquet").partitionBy("day").bucketBy(self.buckets, "key").sortBy("key").option("path", self.folder).saveAsTable(self.table)

    def write(self, replies: DataFrame, now: float | None = None) -> None:
        """Appends replies(key, reply) and, where it is there, cost."""
        now = time.time() if now is None else now
        cost = F.col("cost") if "cost" in replies.columns else F.lit(0.0)
        self._append(replies.select("key", "reply", cost.alias("cost"), F.lit(float(now)).alias("written_at"), F.lit(_day(now)).alias("day")))

    def _since(self, now: float | None) -> float:
        return (time.time() if now is None else now) - self.days * 86400

    def _fresh(self, now: float | None) -> Column:
        since = self._since(now)
        return (F.col("day") >= _day(since)) & (F.col("written_at") >= since)  # the first prunes folders, the second is exact

    def read(self, now: float | None = None) -> DataFrame:
        """(key, reply, written_at) of the latest entry of each key that is not too old and holds a JSON object."""
        rows = self.spark.table(self.table).filter(self._fresh(now) & valid(F.col("reply")))
        return rows.groupBy("key").agg(F.max(F.struct("written_at", "reply")).alias("x")).select("key", "x.reply", "x.written_at")

    def missing(self, calls: DataFrame, now: float | None = None) -> DataFrame:
        """The rows of calls(key, ...) without a reply: an anti-join that moves calls alone."""
        return calls.hint("merge").join(self.read(now).select("key"), "key", "left_anti")

    def status(self, calls: DataFrame, now: float | None = None) -> DataFrame:
        """calls(key, ...) with status: hit; of those without a reply corrupt if a young entry holds none, expired if all entries are too old, else missing."""
        rank = F.when(~self._fresh(now), 1).when(valid(F.col("reply")), 3).otherwise(2)
        best = self.spark.table(self.table).groupBy("key").agg(F.max(rank).alias("_rank"))
        told = F.when(F.col("_rank") == 3, HIT).when(F.col("_rank") == 2, CORRUPT).when(F.col("_rank") == 1, EXPIRED).otherwise(MISSING)
        return calls.hint("merge").join(best, "key", "left").withColumn("status", told).drop("_rank")

    def compact(self, now: float | None = None) -> None:
        """Writes the log anew: of each key the latest valid entry that is young enough."""
        old, table = self.folder, self.table
        rows = self.spark.table(table).filter(self._fresh(now) & valid(F.col("reply"))).groupBy("key").agg(F.max(F.struct("written_at", "reply", "cost", "day")).alias("x")).select("key", "x.*")
        self._remove(f"{self.path}/v{self.version + 1}")  # of a job that died here
        self._at(self.version + 1)
        self._append(rows)
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self._remove(old)

    def journal(self, part: str) -> str:
        """Where the tasks of a part of a job note each reply as they get it."""
        return f"{self.path}/journal/{part}"

    def forget(self, part: str) -> None:
        self._remove(self.journal(part))


def valid(reply: Column) -> Column:
    """Whether a reply is a JSON object."""
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(reply)), F.lit("OBJECT")), F.lit(False))


class Journal:
    """In a task: replies by key in a folder, one file each, that is there before the next call is made. The folder is on any file system that Arrow knows by its URI."""

    def __init__(self, uri: str):
        self.files, self.root = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
        self.files.create_dir(self.root, recursive=True)

    def _file(self, key: str) -> str:
        return f"{self.root}/{hashlib.sha256(key.encode()).hexdigest()}.json"

    def get(self, key: str) -> tuple[str, float] | None:
        """What another attempt at this task has paid for already; a file that was cut off counts as none."""
        if self.files.get_file_info(self._file(key)).type != fs.FileType.File:
            return None
        with self.files.open_input_file(self._file(key)) as f:
            try:
                told = json.loads(f.read().decode())
            except ValueError:
                return None
        return told["reply"], told["cost"]

    def put(self, key: str, reply: str, cost: float) -> None:
        part = self._file(key) + ".part"
        with self.files.open_output_stream(part) as f:
            f.write(json.dumps({"reply": reply, "cost": cost}).encode())
        self.files.move(part, self._file(key))
