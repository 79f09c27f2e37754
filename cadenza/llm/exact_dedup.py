"""Exact deduplication with keyed streaming state.

Every row is reduced to a feed record: the digest of its normalised text, its id and a locator of
its content (file and row in it). The feed is consumed as a stream whose state, one entry for each
digest, lives in RocksDB, never expires and holds the stable id and locator of the row that stays, and
how many rows had the digest. The state answers which rows hit an entry; their bytes are compared with
the entry's content, which is read by its locator. Texts that share a digest but not their bytes are
told apart by these.

With a folder for the state, later calls are further deliveries: their rows meet the entries of all
earlier ones, and a row that stayed then stays. The folder also keeps the texts (locators point there),
and each delivery's result. A delivery counts once its marker is written, which comes last. What one that failed
has left is taken away by the next call, and the state, which may hold rows of it, is made anew from the
feeds of those that count; so a delivery may be tried again, or another one come first. One that has a name is
answered from its record if it is called again after it counted.

Defined results: a null text is an empty one; a null id sorts after all others; of rows that repeat
both id and text, one is kept; tables may be empty and may have any further columns.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote, unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import SPACES, remove, scratch, small, stage, with_unique

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Copies that are compared with one replica of the text that stays.
SALT_ROWS = 1024


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def text_key(text: Column) -> Column:
    """Tells rows apart that share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def bare_scan(docs: DataFrame) -> bool:
    """Whether each row of docs is one row of a file: columns and conditions over a scan, and nothing else."""
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.getClass().getSimpleName() == "LogicalRelation"


def located(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """(id, text, file, place) of every row.

    Rows of a bare scan have a file and a row in it; all others (joined, exploded, united, limited ones) are
    written to `path` first, where each has a place of its own.
    """
    place = ["_metadata.file_path", "_metadata.row_index"]
    own = None
    if bare_scan(docs) and "_metadata" not in docs.columns:
        try:
            own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *place)
        except AnalysisException:  # a source without row numbers
            own = None
    if own is None:
        own = stage(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), path).select("id", "text", *place)
    return own.withColumnsRenamed({"file_path": "file", "row_index": "place"})


def run_stream(spark: SparkSession, base: str, id_type: str, files_per_batch: int) -> DataFrame:
    """Consume what is new in the feed; (digest, first, n) of all entries of the state then.

    first: the digest's first row by (delivery, id, locator). There is no watermark, so no entry is
    ever dropped.
    """
    settings = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
        # else each state partition reserves megabytes of its executor's disk in advance
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        schema = f"digest string, delivery int, id {id_type}, text_key long, file string, place long"
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{base}/feed/*")
        entry = F.struct("delivery", F.isnull("id").alias("no_id"), "id", "file", "place")
        state = stream.groupBy("digest").agg(F.min(entry).alias("first"), F.count(F.lit(1)).alias("n"))
        # the answers are read from the state itself, once all of the feed is in
        sink = state.writeStream.outputMode("update").option("checkpointLocation", f"{base}/stream").format("noop")
        sink.trigger(availableNow=True).start().awaitTermination()
        entries = spark.read.format("statestore").load(f"{base}/stream")
        return stage(entries.select("key.digest", F.col("value.min").alias("first"), F.col("value.count").alias("n")), scratch(spark, "dedup-entries"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def same_place(a: str = "", b: str = "first.") -> Column:
    return (F.col(f"{a}file") == F.col(f"{b}file")) & (F.col(f"{a}place") == F.col(f"{b}place"))


def texts_at(content: DataFrame, places: DataFrame) -> DataFrame:
    """places with the normalised text at each; content: file, place, text."""
    content = content.select(F.col("file").alias("t_file"), F.col("place").alias("t_place"), "text")
    found = content.join(small(places), (F.col("t_file") == F.col("file")) & (F.col("t_place") == F.col("place")))
    return found.withColumn("text", normalised(F.col("text"))).drop("t_file", "t_place")


def collisions(content: DataFrame, rows: DataFrame, path: str) -> DataFrame:
    """Digests of hits whose bytes differ from those of their digest's first row; rows: this delivery's hits.

    Only texts of repeated digests move. A group is dealt over as many replicas of the text that
    stays as it has thousands of copies.
    """
    rest = rows.where(~same_place()).select("digest", "file", "place", "n", F.lit(False).alias("is_first"))
    first = rows.groupBy("digest").agg(F.first("first").alias("f"), F.first("n").alias("n")).select("digest", "f.file", "f.place", "n", F.lit(True).alias("is_first"))
    found = texts_at(content, stage(rest.unionByName(first), f"{path}/hits"))
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    kept = found.where("is_first").select("digest", F.col("text").alias("kept_text"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    others = found.where("not is_first").withColumn("salt", F.pmod(F.xxhash64("file", "place"), salts).cast("int"))
    return others.join(kept, ["digest", "salt"]).where("text <> kept_text").select("digest").distinct()


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int = 1000,
    state: str | None = None,
    delivery: str | None = None,
) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, digest, locator, text_key.

    digest must give a string; a weak one costs time alone, as hits are compared in full. state: a
    shared folder in which the state lives on; without it the state ends with the call. delivery: a name for
    these rows in that folder. group_size counts the rows of all deliveries so far. Calls on one folder
    must follow each other.
    """
    spark = docs.sparkSession
    path = scratch(spark, "dedup")
    base, id_type = state or path, docs.schema[id_col].dataType.simpleString()
    number = 0
    if state:
        done = deliveries(spark, base)
        if delivery is not None and delivery in done.values():
            return spark.read.parquet(f"{base}/result/{next(k for k, v in done.items() if v == delivery)}")
        number = len(done)
        clear(spark, base, number)
        docs = stage(docs.select(id_col, text_col), f"{base}/content/{number}")
    own = located(docs, id_col, text_col, f"{path}/content")
    feed = stage(
        own.select(
            digest(normalised(F.col("text"))).alias("digest"), F.lit(number).alias("delivery"), "id", text_key(F.col("text")).alias("text_key"), "file", "place"
        ),
        f"{base}/feed/{number}",
    )
    rows = feed.count()
    if rows:
        entries = run_stream(spark, base, id_type, files_per_batch)
    else:
        entries = spark.createDataFrame([], f"digest string, first struct<delivery:int,no_id:boolean,id:{id_type},file:string,place:bigint>, n bigint")
    if not state:
        remove(spark, f"{base}/stream")
    content = spark.read.parquet(f"{base}/content/*").select(F.col(text_col).alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")) if state else own
    hits = entries.where("n > 1").withColumn("size", F.col("n"))
    marked = stage(with_unique(feed, hits, "digest", "size", rows, F.concat_ws("#", "file", "place")), f"{path}/marked")
    bad = stage(collisions(content, marked.where("n is not null"), path), f"{path}/collisions")
    remove(spark, f"{path}/hits")
    out = marked
    if not bad.isEmpty():  # one digest of several texts: all deliveries' rows of it are told apart by their bytes
        every = spark.read.schema(feed.schema).parquet(f"{base}/feed/*").join(bad, "digest", "left_semi")
        every = stage(texts_at(content, every), f"{path}/texts")
        first = every.groupBy("digest", "text").agg(F.min(F.struct("delivery", F.isnull("id").alias("no_id"), "id", "file", "place")).alias("first"), F.count(F.lit(1)).alias("n"))
        again = every.where(F.col("delivery") == number).join(first, ["digest", "text"]).select(*marked.columns)
        out = marked.join(bad, "digest", "left_anti").select(*marked.columns).unionByName(again)
    kept = F.col("n").isNull() | ((F.col("delivery") == F.col("first.delivery")) & same_place())
    out = out.select(
        F.col("id").alias(id_col), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), kept.alias("kept"), "digest", F.struct("file", "place").alias("locator"), "text_key",
    )
    if state:
        out = stage(out, f"{base}/result/{number}")
        commit(spark, base, number, delivery)
        remove(spark, path)
    return out


def files_of(spark: SparkSession, folder: str):
    """The file system of a folder, and its path there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def deliveries(spark: SparkSession, base: str) -> dict[int, str | None]:
    """The deliveries that count in a state folder, with their names."""
    files, path = files_of(spark, f"{base}/done")
    found = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
    return {int(k): unquote(name) if eq else None for k, eq, name in (f.partition("=") for f in found)}


def clear(spark: SparkSession, base: str, number: int) -> None:
    """Take away what a failed delivery of that number has left; the state too, if rows of it may be in there."""
    files, feed = files_of(spark, f"{base}/feed/{number}")
    if files.exists(feed):
        remove(spark, f"{base}/stream")
    remove(spark, f"{base}/result/{number}", f"{base}/feed/{number}", f"{base}/content/{number}")


def commit(spark: SparkSession, base: str, number: int, name: str | None) -> None:
    """The marker that makes a delivery count: an empty file, made in one step."""
    files, path = files_of(spark, f"{base}/done/{number}" + ("" if name is None else f"={quote(name, safe='')}"))
    files.create(path, False).close()


def keep_first(docs: DataFrame, result: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with docs' own columns; of rows that repeat both id and text one stays."""
    rows = result.groupBy(F.col(id_col).alias("__k_id"), F.col("text_key").alias("__k_key")).agg(F.max("kept").alias("__stays"), F.count(F.lit(1)).alias("__n"))
    return stay(docs, rows, text_key(F.col(text_col)), id_col, scratch(docs.sparkSession, "dedup-rows"))


def stay(docs: DataFrame, rows: DataFrame, key: Column, id_col: str, path: str) -> DataFrame:
    """Rows of docs by (id, key): none where __stays is false, else one; rows: __k_id, __k_key, __stays and how many, __n."""
    columns = docs.columns
    rows = stage(rows, path)
    keys = ["__k_id", "__k_key"]
    docs = docs.withColumn("__key", key)
    same = docs[id_col].eqNullSafe(F.col("__k_id")) & (F.col("__key") == F.col("__k_key"))
    clean = docs.join(small(rows.where("not __stays").select(*keys)), same, "left_anti")
    again = rows.where("__stays and __n > 1").select(*keys)
    if again.isEmpty():
        return clean.select(*columns)
    again = small(again)
    once = clean.join(again, same, "left_semi").dropDuplicates([id_col, "__key"])
    return clean.join(again, same, "left_anti").unionByName(once).select(*columns)
