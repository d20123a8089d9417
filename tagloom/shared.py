"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset, a temporary folder in local mode and an error elsewhere."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write a table to the shared folder and read it back, so lost executors lose nothing.

    The table stays until the folder is cleared, as the result may be read at any time.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Copies of a small side that is too large to broadcast, so that a frequent key's rows go to as many tasks.
SALTS = 64


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """The table with the hint for its size: broadcast up to so many rows, else a merge join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def looked_up(rows: DataFrame, known: DataFrame, key: str, by: str, how: str = "left", most: int = 10_000) -> DataFrame:
    """Rows joined with a table of one row a key: broadcast while it is small, else with copies of it, which rows are dealt to by a column `by`, so that no task gets all rows of a frequent key."""
    known = written(known, "known")
    if known.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(known), key, how)
    copies = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return salted.join(copies.hint("merge"), [key, "_salt"], how).drop("_salt")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
