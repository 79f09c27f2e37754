"""Reproducible shuffling and fixed-size batches.

An order over all rows needs no single task: rows are dealt to ranges of their hash, as many as their
number asks for, numbered within each, and the ranges' sizes give the offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.session import materialised

#: Rows of a range at most, on average; ranges are named by the first hex digits of the hash.
RANGE_ROWS = 100_000


def numbered(rows: DataFrame, key: str, seed: int = 0, epoch: int = 0) -> DataFrame:
    """rows with at: their place (from 0) in the order of a hash of seed, epoch and key."""
    hashed = rows.withColumn("__h", F.md5(F.concat_ws(":", F.lit(seed), F.lit(epoch), F.col(key).cast("string"))))
    digits = len(f"{rows.count() // RANGE_ROWS:x}")
    hashed = hashed.withColumn("__range", F.substring("__h", 1, digits))
    sizes = hashed.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    # 16 ranges for RANGE_ROWS rows at most
    total = sizes.select("__range", (F.sum("n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("__before"))
    place = F.row_number().over(W.partitionBy("__range").orderBy("__h", key)) - 1
    return hashed.join(F.broadcast(total), "__range").withColumn("at", (place + F.col("__before")).cast("long")).drop("__h", "__range", "__before")


def in_order(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with at: their place (from 0) in the order of keys, which should tell all rows apart.

    Rows are dealt to ranges of the keys, which are written so that they stay as they are, numbered
    within each, and the ranges' sizes give the offsets: no task sorts all rows.
    """
    dealt = materialised(rows.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "in-order")
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    # one row a partition
    total = sizes.select("__range", (F.sum("n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("__before"))
    place = F.row_number().over(W.partitionBy("__range").orderBy(*keys)) - 1
    return dealt.join(F.broadcast(total), "__range").withColumn("at", (place + F.col("__before")).cast("long")).drop("__range", "__before")


def batches(rows: DataFrame, key: str, size: int, seed: int = 0, epoch: int = 0, drop_last: bool = False, shuffle: bool = True) -> DataFrame:
    """rows with batch and slot, in hash order or, without shuffle, in order of key.

    drop_last leaves out a last batch that isn't full.
    """
    out = numbered(rows, key, seed, epoch) if shuffle else in_order(rows, key)
    out = out.withColumns({"batch": F.floor(F.col("at") / size).cast("long"), "slot": (F.col("at") % size).cast("int")})
    if not drop_last:
        return out.drop("at")
    n = F.lit(rows.count() // size)
    return out.where(F.col("batch") < n).drop("at")


def collated(rows: DataFrame, features: str, label: str) -> DataFrame:
    """(batch, x, y): one row a batch, its features and labels in slot order."""
    grouped = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("slot", features, label))).alias("r"))
    return grouped.select("batch", F.col("r").getField(features).alias("x"), F.col("r").getField(label).alias("y"))


def store(rows: DataFrame, path: str, per_folder: int = 1) -> None:
    """Write rows that have a batch so that a batch is read alone: clustered by batch, so many batches a folder.

    With one batch a folder a step reads just its rows; with more there are fewer files, and of a folder's rows
    those parts are skipped whose range of batches leaves the wanted one out.
    """
    grouped = rows.withColumn("folder", F.floor(F.col("batch") / per_folder).cast("long"))
    dealt = grouped.repartition("folder").sortWithinPartitions("folder", "batch", "slot")
    dealt.write.partitionBy("folder").parquet(path)


def stored(spark: SparkSession, path: str, batch: int | None = None, per_folder: int = 1) -> DataFrame:
    """The rows of one stored batch, or of all."""
    rows = spark.read.option("basePath", path).parquet(path)
    if batch is not None:
        rows = rows.where((F.col("folder") == batch // per_folder) & (F.col("batch") == batch))
    return rows.drop("folder")
