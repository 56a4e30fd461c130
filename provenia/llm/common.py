"""What the operators of this subpackage share: reading, intermediate tables, places in an order."""

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space, as the contracts of these operators define it.
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session in local mode without it (tests) gets a temporary one; on a
    cluster its absence is an error, since a folder of one machine is no place for what all have to read."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="provenia-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it back: the lineage ends there, so a lost executor costs one task and nothing upstream."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def stage_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """Like stage, in buckets by key, so that what groups the table by key later reads it without an exchange."""
    spark, made = df.sparkSession, f"{name}-{uuid.uuid4().hex}"
    path, table = f"{shared_dir(spark)}/{made}", made.replace("-", "_")
    df.write.format("parquet").bucketBy(parallelism(spark), key).sortBy(key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    # the plan knows files and buckets by now; the catalog needn't. The files stay, since their place was given
    spark.sql(f"DROP TABLE {table}")
    out.stage_path = path
    return out


def unstage(*staged: DataFrame) -> None:
    """Deletes tables of stage() and stage_by() that no pending plan reads."""
    for df in staged:
        remove(df.sparkSession, df.stage_path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def workers_find_package(spark: SparkSession) -> None:
    """Python workers import this package from where the driver did; on a cluster it is installed there or sent with --py-files."""
    env, root = spark.sparkContext.environment, str(Path(__file__).parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df has it (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_position(df: DataFrame, order: list, name: str = "pos") -> DataFrame:
    """df (staged, narrow) with each row's place from 0 in the order given, without one task that sees all rows.

    Rows are dealt by range, numbered within each partition, and shifted by the counts of the partitions before; only those
    counts, one for each partition, meet in one place.
    """
    n = parallelism(df.sparkSession)
    part, inside, rows, first, before = (free_name(df, f"{name}_{x}") for x in ("part", "in", "rows", "first", "before"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = stage(dealt.withColumn(part, F.spark_partition_id()).withColumn(inside, F.monotonically_increasing_id()), "placed")
    firsts = dealt.groupBy(part).agg(F.count("*").alias(rows), F.min(inside).alias(first))
    so_far = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select(part, first, F.coalesce(F.sum(rows).over(so_far), F.lit(0)).alias(before))
    # at most one row for each shuffle partition: that bounds what is broadcast
    out = dealt.join(F.broadcast(firsts), part).withColumn(name, F.col(before) + F.col(inside) - F.col(first))
    return out.drop(part, inside, first, before)


def with_written_position(df: DataFrame, name: str = "position") -> DataFrame:
    """df, read from files that Spark wrote, with each row's place from 0 in the order in which it was written: part by part, row by row.

    Reading deals files out in another order; their names and the rows' numbers in them stay. One row for each file meets in one
    place and is broadcast.
    """
    made = [free_name(df, f"{name}_{x}") for x in ("part", "piece", "row", "first", "rows")]
    part, piece, row, first, rows = made
    path = F.col("_metadata.file_path")
    of = lambda k: F.regexp_extract(path, r"/part-(\d+)-[^/]*[-.]c(\d+)[^/]*$", k).cast("long")
    out = df.select("*", of(1).alias(part), of(2).alias(piece), F.col("_metadata.row_index").alias(row))
    before = Window.orderBy(part, piece).rowsBetween(Window.unboundedPreceding, -1)
    firsts = out.groupBy(part, piece).agg(F.count("*").alias(rows)).select(part, piece, F.coalesce(F.sum(rows).over(before), F.lit(0)).alias(first))
    return out.join(F.broadcast(firsts), [part, piece]).withColumn(name, F.col(first) + F.col(row)).select(*df.columns, name)


def literal(text: str) -> str:
    """A regular expression for the text itself, in Java's and RE2's dialect alike."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)
