"""Intermediate tables in the folder that driver and executors share."""

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A session in local mode without it (tests) gets a temporary folder; a cluster an error, since a folder of one machine is no place for it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="provenia-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def workers_find_package(spark: SparkSession) -> None:
    """Python workers import this package from where the driver did; on a cluster it is installed there or sent with --py-files."""
    env, root = spark.sparkContext.environment, str(Path(__file__).parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written to a table of its own, in a folder for each value of column `by`, and read back: computed once, and no lineage beyond it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    out = df.write
    if by:
        out = out.partitionBy(by)
    out.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)
