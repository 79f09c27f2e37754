"""Helpers that the corpus operators share: scratch tables, id tests, texts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words wherever a contract says `[\x20\x09-\x0D]+`.
SPACES = r"[\x20\x09-\x0D]+"

#: Bytes up to which a table is broadcast, counted with ROW_BYTES for each row besides its strings and lists.
BROADCAST_BYTES, ROW_BYTES = 64_000_000, 64
#: A key is hot from this share of all rows on, and from so many; so HOT_SHARE keys at most are.
HOT_SHARE, LEAST_HOT = 100_000, 512
#: Bytes of an Arrow batch; texts are long, and rows alone do not bound them.
BATCH_BYTES = 4_000_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only a local session may name none (tests, notebooks): then a local one is set. The session's
    Arrow batches are bounded in bytes, if it sets no bound itself.
    """
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = jsc.get() if jsc.isDefined() else None
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cadenza-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, path: str) -> DataFrame:
    """Write a table to the shared folder and read it: lineage ends here."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame) -> DataFrame:
    """Mark a table for broadcast if it has BROADCAST_BYTES at most, which is counted first.

    A larger one is left to a shuffle join, which gives the same rows.
    """
    size = F.lit(ROW_BYTES)
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            size += F.coalesce(F.octet_length(F.col(f.name)), F.lit(0))
        elif kind in ("array", "struct", "map"):
            # as text a list is at least as long as in memory, or nearly; twice that, to be safe
            size += 2 * F.octet_length(F.to_json(F.struct(F.col(f.name))))
    n = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= BROADCAST_BYTES else df


def with_unique(left: DataFrame, right: DataFrame, key: str, size: str, rows: int, spread: Column) -> DataFrame:
    """left with right's columns but key and size, null where right lacks the key.

    right has one row a key, and in `size` how many of left's `rows` rows have that key. The few hot keys
    are joined by broadcast, and their rows are dealt out by `spread` (of the key's type) in the join with
    the others, so no task gets all rows of a large group.
    """
    hot = F.col(size) > max(LEAST_HOT, rows // HOT_SHARE)
    names = [c for c in right.columns if c not in (key, size)]
    part = lambda t, p: t.select(F.col(key).alias(f"{p}{key}"), *(F.col(c).alias(f"{p}{c}") for c in names))
    out = left.join(F.broadcast(part(right.where(hot), "__h_")), F.col(key) == F.col(f"__h_{key}"), "left")
    # a spread key that is another row's by chance does no harm: hot columns go first
    dealt = F.when(F.col(f"__h_{key}").isNull(), F.col(key)).otherwise(spread)
    out = out.withColumn("__dealt", dealt).join(part(right.where(~hot), "__c_"), F.col("__dealt") == F.col(f"__c_{key}"), "left")
    pick = lambda c: F.when(F.col(f"__h_{key}").isNotNull(), F.col(f"__h_{c}")).otherwise(F.col(f"__c_{c}")).alias(c)
    return out.select(*left.columns, *map(pick, names))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; other letters stay. Plain ASCII takes the fast path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )


def fold(doc_id: Column, n: int = 5) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
