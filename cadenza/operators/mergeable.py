"""Aggregates that are kept as tables, and that later deliveries of rows are merged into.

What is kept is small and mergeable: of each coefficient its count, mean and sum of squared deviations; of each
pair of classes its count. A delivery's own rows are aggregated alone and merged into the kept table pair by
pair, so standardising and metrics follow new rows without the old ones. A merge writes a new version of
the table below its folder, with a marker last: one that fails leaves the version before as it was, and a
delivery that is tried again under its name counts once.

Defined results: null values count for nothing; a key of one delivery alone is kept as it is; an empty delivery
leaves the table's rows as they are; the folder's versions are kept until drop_versions().
"""

from __future__ import annotations

from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def moments(rows: DataFrame, keys: list[str], value: str = "c") -> DataFrame:
    """(keys, n, mean, m2): count, mean, and sum of squared deviations of the values of each key."""
    grouped = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("v"))
    return grouped.select(*keys, "n", "mean", (F.col("v") * F.col("n")).alias("m2"))


def merged_moments(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The moments of all rows, from those of disjoint parts; a key has a row for each part that has it."""

    def pair(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        share = b["n"] / n
        return F.struct(n.alias("n"), (a["mean"] + apart * share).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * share).alias("m2"))

    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    held = parts.groupBy(*keys).agg(F.aggregate(F.array_sort(F.collect_list(F.struct("n", "mean", "m2"))), none, pair).alias("m"))
    return held.select(*keys, "m.n", "m.mean", "m.m2")


def standardised(rows: DataFrame, kept: DataFrame, keys: list[str], value: str = "c", eps: float = 1e-6) -> DataFrame:
    """Values less their key's kept mean, over its kept population deviation plus eps."""
    about = kept.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("mean").alias("__mean"), F.sqrt(F.col("m2") / F.col("n")).alias("__sd"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return rows.join(about, same, "left").withColumn(value, (F.col(value) - F.col("__mean")) / (F.col("__sd") + eps)).select(*rows.columns)


def merged_counts(parts: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Counts of all rows, from those of disjoint parts."""
    return parts.groupBy(*keys).agg(F.sum(count).alias(count))


class Kept:
    """A table of mergeable aggregates in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], merge=merged_moments) -> None:
        self.spark, self.path, self.keys, self.merge = spark, path.rstrip("/"), keys, merge

    def versions(self) -> dict[int, str]:
        """Versions that count, with the names of their deliveries."""
        files, folder = self._files("done")
        names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
        return {int(k): unquote(name) for k, _, name in (n.partition("=") for n in names)}

    def _files(self, below: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def read(self) -> DataFrame | None:
        """The table as it is now; None before the first delivery."""
        done = self.versions()
        return self.spark.read.parquet(f"{self.path}/{max(done)}") if done else None

    def deliver(self, part: DataFrame, name: str) -> DataFrame:
        """The table with a delivery's aggregates merged in; without change if that name was delivered before."""
        done = self.versions()
        if name in done.values():
            return self.read()
        before, version = self.read(), max(done, default=-1) + 1
        whole = self.merge(part if before is None else before.unionByName(part), self.keys)
        whole.write.mode("overwrite").parquet(f"{self.path}/{version}")  # what a failed one left goes
        files, marker = self._files(f"done/{version}={quote(name, safe='')}")
        files.create(marker, False).close()
        return self.read()

    def drop_versions(self) -> None:
        """Delete all versions but the last; their markers stay."""
        done = self.versions()
        for version in sorted(done)[:-1]:
            files, folder = self._files(str(version))
            files.delete(folder, True)
