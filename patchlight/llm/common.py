"""What the operators of this folder share on the Spark side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patchlight.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """The rows in the shared checkpoint folder: read again, not made again, also after an executor is lost."""
    return cut_lineage(df)


def width(spark: SparkSession) -> int:
    """Parts that the session deals shuffled rows into; the cluster sizes it with the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their global number from 0 in the given order, without a task that sees them all.

    Spark sorts by ranges; the sorted rows are settled, so the number of a row is its place in its part plus the rows of earlier
    parts. Only one row per part meets in one task. Rows that tie in the whole order may swap numbers.
    """
    placed = settled(df.sort(*order)).withColumn("__at", F.monotonically_increasing_id())
    placed = placed.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    # One row per part of the sorted rows, two numbers each.
    return placed.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")
