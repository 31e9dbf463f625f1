"""Keyed tables that a stream's micro-batches replace rows in, as versions of buckets.

A table is a folder of epoch=E/bucket=B part files. A batch writes the buckets it touches, whole, under its own epoch; the state of a bucket is its latest
epoch. A batch that runs again reads what was there before its epoch and overwrites its own folder, so it may fail or be repeated at any point.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


def _versions(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    wide = StructType([*schema.fields]).add("epoch", "long").add("bucket", "integer")
    return spark.read.schema(wide).parquet(path)


def read(spark: SparkSession, path: str, schema: StructType, before: int | None = None, touched: DataFrame | None = None) -> DataFrame:
    """The rows as they are, or as they were before an epoch; touched (bucket): of these buckets only. Files of other versions are not opened."""
    all_ = _versions(spark, path, schema)
    if before is not None:
        all_ = all_.where(F.col("epoch") < before)
    latest = all_.groupBy("bucket").agg(F.max("epoch").alias("epoch"))
    if touched is not None:
        latest = latest.join(touched.select("bucket").distinct(), "bucket", "left_semi")
    return all_.join(latest, ["epoch", "bucket"], "left_semi").select(*schema.names)


def bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def upsert(rows: DataFrame, path: str, keys: list[str], epoch: int, merge: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> None:
    """Bring rows into the table.

    merge takes old and new rows together (with `_new`, false for what the table had) and returns one row per key with the columns of rows; it should
    be an aggregation, so that many new rows of a key are combined before they meet. keys may be null.
    """
    spark, schema = rows.sparkSession, rows.schema
    dealt = rows.withColumn("bucket", bucket(keys, buckets))
    old = read(spark, path, schema, epoch, dealt) if epoch else spark.createDataFrame([], schema)
    both = rows.withColumn("_new", F.lit(True)).unionByName(old.withColumn("_new", F.lit(False)))
    merged = merge(both).select(*schema.names).withColumn("bucket", bucket(keys, buckets))
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/epoch={epoch}")


def forget(spark: SparkSession, path: str, schema: StructType, epoch: int) -> int:
    """Delete versions that neither readers nor a repeat of this epoch can ask for; how many. One row per version reaches the driver."""
    held = _versions(spark, path, schema).where(F.col("epoch") < epoch).select("epoch", "bucket").distinct()
    old = [(r.epoch, r.bucket) for r in held.join(held.groupBy("bucket").agg(F.max("epoch").alias("_last")), "bucket").where("epoch < _last").collect()]
    for e, b in old:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch={e}/bucket={b}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(old)
