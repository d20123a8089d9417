"""A table in buckets of a key, changed by rewriting the buckets that a change touches.

Rows of version v lie in data/version=v/bucket=b.  A manifest (bucket, version), one row a
bucket, says where the current rows of each bucket are; it is written last, and the newest
complete one is the pointer.  A run that ends between the rows and the manifest leaves the old
table as it was; running it again writes the same version over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def newest(spark: SparkSession, folder: str) -> int:
    """The largest number of a complete table in a folder of numbered ones, or -1."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(p.getParent().getName()) for p in (s.getPath() for s in files.globStatus(path(f"{folder}/*/_SUCCESS")) or ())]
    return max(done, default=-1)


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _written(rows: DataFrame, root: str, version: int, key: str, buckets: int) -> None:
    """Rows by bucket, in one file a bucket however few they are."""
    placed = rows.withColumn("bucket", bucket(key, buckets)).repartition("bucket")
    placed.write.partitionBy("bucket").mode("overwrite").parquet(f"{root}/data/version={version}")


def _pointed(spark: SparkSession, root: str, manifest: dict[int, int], version: int) -> None:
    rows = spark.createDataFrame(sorted(manifest.items()), "bucket int, version int")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifests/{version}")


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict[int, int]:
    """Version of each bucket's rows, as of a version or now; a number a bucket, so at most as many as buckets."""
    at = newest(spark, f"{root}/manifests") if version is None else version
    return {r[0]: r[1] for r in spark.read.parquet(f"{root}/manifests/{at}").collect()} if at >= 0 else {}


def create(table: DataFrame, root: str, key: str, buckets: int = BUCKETS) -> None:
    """A first version, 0, of a table with one row a key."""
    spark = table.sparkSession
    _written(table, root, 0, key, buckets)
    held = [r[0] for r in table.select(bucket(key, buckets)).distinct().collect()]
    _pointed(spark, root, dict.fromkeys(held, 0), 0)


def read(spark: SparkSession, root: str, schema, only: set[int] | None = None, version: int | None = None) -> DataFrame:
    """The current rows, of some buckets or of all."""
    where = manifest(spark, root, version)
    paths = [f"{root}/data/version={v}/bucket={b}" for b, v in sorted(where.items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert(delta: DataFrame, root: str, schema, key: str, columns: list[str], version: int, buckets: int = BUCKETS) -> None:
    """Merge delta (key and columns, one row a key) as the next version: null leaves a field as it is, new keys are added.

    Only buckets with keys in delta are read and written.  Versions rise; one that is there
    already is written again, from the version before it.
    """
    spark = delta.sparkSession
    if delta.isEmpty():
        return
    before = min(newest(spark, f"{root}/manifests"), version - 1)
    touched = {r[0] for r in delta.select(bucket(key, buckets)).distinct().collect()}
    old = read(spark, root, schema, touched, before)
    new = delta.select(key, *(F.col(c).alias(f"new_{c}") for c in columns))
    merged = old.join(new.hint("merge"), key, "full_outer").select(*(F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns))
    _written(merged, root, version, key, buckets)
    _pointed(spark, root, manifest(spark, root, before) | dict.fromkeys(touched, version), version)
