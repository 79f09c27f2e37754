"""Benchmark decontamination with a distributed positional inverted index.

The index stores (term, document, position) for every token of the training texts whose term a
test item uses, and one end posting a document, whose position is its length. Test phrases are
looked up from their rarest terms: postings shifted by a term's place in its item fall on the same
alignment (item, document, shift) wherever the item's words follow each other, so alignments that
two rare terms share are the candidates, and these are compared word by word.

Defined results: a null text has no words; an item without words matches nothing; an item of fewer
words than a window is one window; a null item_id still marks words but is not listed; rows that
repeat a document id are judged one by one; very long texts are read whole, their words being rows; tables may be
empty and have any further columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cadenza.llm.common import ascii_lower, remove, scratch, small, stage

#: Fixed pattern of the contract: letters, digits and all that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Term number of the posting that ends each document.
END = -1


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def items_of(tests: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, item_id, terms, width): one row for each different test item that has words."""
    items = tests.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("terms")).where(F.size("terms") > 0).distinct()
    return items.select(
        F.monotonically_increasing_id().alias("item"), "item_id", "terms", F.least(F.size("terms"), F.lit(window)).alias("width")
    )


def vocabulary(items: DataFrame) -> DataFrame:
    """(word, term): the different words of the items, numbered."""
    distinct = items.select(F.explode("terms").alias("word")).distinct()
    return distinct.select("word", F.monotonically_increasing_id().alias("term"))


def build_index(docs: DataFrame, vocab: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """Write and read the postings (doc_id, text_key, term, pos) of the vocabulary's terms.

    Rows are told apart by id and a hash of the text, so a repeated id does no harm.
    """
    ended = F.concat(words(F.col(text_col)), F.array(F.lit("")))
    tokens = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key"),
        F.posexplode(ended).alias("pos", "word"),
    )
    terms = stage(vocab.unionByName(docs.sparkSession.sql(f"SELECT '' AS word, CAST({END} AS BIGINT) AS term")), f"{path}/terms")
    postings = tokens.join(small(terms), "word").select("doc_id", "text_key", "term", "pos", (F.col("term") == END).alias("is_end"))
    postings.write.partitionBy("is_end").option("compression", "zstd").parquet(f"{path}/postings")
    schema = postings.schema
    return docs.sparkSession.read.schema(schema).parquet(f"{path}/postings")


def lengths(index: DataFrame) -> DataFrame:
    return index.where("is_end").select("doc_id", "text_key", F.col("pos").cast("long").alias("n_words"))


def anchors(items: DataFrame, vocab: DataFrame, counts: DataFrame, n: int = 2) -> DataFrame:
    """(item, place, term, need): of each window of an item its n rarest places, by training counts."""
    spread = items.select("item", "width", F.size("terms").alias("size"), F.posexplode("terms").alias("place", "word"))
    spread = spread.join(small(vocab), "word").join(small(counts), "term", "left").fillna(0, ["count"])
    starts = F.sequence(F.greatest(F.lit(0), F.col("place") - F.col("width") + 1), F.least(F.col("place"), F.col("size") - F.col("width")))
    rank = F.row_number().over(W.partitionBy("item", "start").orderBy("count", "place"))
    rarest = spread.withColumn("start", F.explode(starts)).withColumn("rank", rank).where(F.col("rank") <= n)
    return rarest.select("item", "place", "term", F.least(F.col("width"), F.lit(n)).alias("need")).distinct()


def exact_matches(docs: DataFrame, items: DataFrame, index: DataFrame, vocab: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """(doc_id, text_key, item, item_id, hits): positions inside occurrences of the item's windows."""
    postings = index.where("not is_end")
    counts = stage(postings.groupBy("term").count(), f"{path}/counts")
    rare = stage(anchors(items, vocab, counts), f"{path}/anchors")
    aligned = postings.join(small(rare), "term").select("doc_id", "text_key", "item", "need", "place", (F.col("pos") - F.col("place")).alias("shift"))
    aligned = aligned.groupBy("doc_id", "text_key", "item", "shift").agg(F.count_distinct("place").alias("found"), F.min("need").alias("need"))
    wanted = aligned.where("found >= need").groupBy("doc_id", "text_key", "item").agg(F.array_sort(F.collect_list("shift")).alias("shifts"))
    wanted = stage(wanted, f"{path}/wanted").withColumnsRenamed({"doc_id": "w_id", "text_key": "w_key"})
    by_doc = stage(wanted.groupBy("w_id", "w_key").agg(F.collect_list(F.struct("item", "shifts")).alias("wanted")), f"{path}/by_doc")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = texts.join(small(by_doc), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("w_key")))
    # the scan yields each candidate's words once; explode comes after them
    found = found.select("doc_id", F.col("w_key").alias("text_key"), words(F.col("text")).alias("doc"), "wanted")
    found = found.select("doc_id", "text_key", "doc", F.inline("wanted")).join(small(items), "item")
    n_doc, n_item, width = F.size("doc"), F.size("terms"), F.col("width")

    def starts(shift: Column) -> Column:
        """Places of the item from which a whole window lies in the document and equals it."""
        low, high = F.greatest(F.lit(0), -shift), F.least(n_item, n_doc - shift) - width
        inside = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.filter(inside, lambda p: F.slice("doc", p + shift + 1, width) == F.slice("terms", p + 1, width))

    covered = F.flatten(F.transform("shifts", lambda d: F.flatten(F.transform(starts(d), lambda p: F.sequence(p + d, p + d + width - 1)))))
    return found.select("doc_id", "text_key", "item", "item_id", F.array_distinct(covered).alias("hits")).where(F.size("hits") > 0)


def proximity_matches(docs: DataFrame, items: DataFrame, index: DataFrame, vocab: DataFrame, counts: DataFrame, slack: int, id_col: str, text_col: str, path: str) -> DataFrame:
    """(doc_id, text_key, item, item_id, places): places of an item's rarest word around which all its
    different words stand within as many words as the item has and `slack` more.

    Only places at which the item's second rarest word is near too are candidates; the documents' words
    decide. An item of one different word has exact matches alone.
    """
    terms = items.select("item", (F.size("terms") + slack).alias("limit"), F.explode(F.array_distinct("terms")).alias("word")).join(small(vocab), "word")
    terms = terms.join(small(counts), "term", "left").fillna(0, ["count"])
    terms = terms.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy("count", "term"))).where("rank <= 2").select("item", "limit", "term", "rank")
    found = index.where("not is_end").join(small(stage(terms, f"{path}/rarest")), "term").select("doc_id", "text_key", "item", "limit", "rank", "pos")
    # of one document and item: the nearest places of the second word, before and after
    here = W.partitionBy("doc_id", "text_key", "item").orderBy("pos")
    second = F.when(F.col("rank") == 2, F.col("pos"))
    found = found.withColumns({
        "before": F.last(second, ignorenulls=True).over(here.rowsBetween(W.unboundedPreceding, 0)),
        "after": F.first(second, ignorenulls=True).over(here.rowsBetween(0, W.unboundedFollowing)),
    })
    found = found.where("rank = 1 and (pos - before < limit or after - pos < limit)").groupBy("doc_id", "text_key", "item").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    by_doc = found.groupBy(F.col("doc_id").alias("w_id"), F.col("text_key").alias("w_key")).agg(F.collect_list(F.struct("item", "places")).alias("wanted"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("w_key"))
    near = texts.join(small(stage(by_doc, f"{path}/near")), same).select("doc_id", F.col("w_key").alias("text_key"), words(F.col("text")).alias("doc"), "wanted")
    near = near.select("doc_id", "text_key", "doc", F.inline("wanted")).join(small(items.withColumns({"terms": F.array_distinct("terms"), "limit": F.size("terms") + slack})), "item")

    def full(at: Column) -> Column:
        """Whether some stretch of the limit's words that holds the place holds all of the item's words."""
        starts = F.sequence(F.greatest(F.lit(0), at - F.col("limit") + 1), at)
        return F.exists(starts, lambda s: F.size(F.array_except("terms", F.slice("doc", s + 1, F.col("limit")))) == 0)

    return near.select("doc_id", "text_key", "item", "item_id", F.filter("places", full).alias("places")).where(F.size("places") > 0)


def decontaminate(
    docs: DataFrame, tests: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    slack: int | None = None,
) -> DataFrame:
    """One row a document: id, text_key, n_words, n_hit, n_items, item_ids (sorted strings).

    With slack also n_near: items of which all words stand within their own length and slack more words.
    The index holds the words of these test items alone and ends with the call.
    """
    path = scratch(docs.sparkSession, "decontaminate")
    items = stage(items_of(tests, item_col, item_text, window), f"{path}/items")
    vocab = stage(vocabulary(items), f"{path}/vocabulary")
    index = build_index(docs, vocab, id_col, text_col, path)
    found = exact_matches(docs, items, index, vocab, id_col, text_col, path)
    # a document has as many hits as words at most, and an item is listed once
    per_doc = found.groupBy("doc_id", "text_key").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("hits")))).cast("long").alias("n_hit"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"),
    )
    per_doc = stage(per_doc, f"{path}/found").withColumnsRenamed({"doc_id": "f_id", "text_key": "f_key"})
    ends = stage(lengths(index), f"{path}/lengths")
    if slack is not None:
        counts = docs.sparkSession.read.parquet(f"{path}/counts")
        near = proximity_matches(docs, items, index, vocab, counts, slack, id_col, text_col, path)
        near = stage(near.groupBy(F.col("doc_id").alias("n_id"), F.col("text_key").alias("n_key")).agg(F.count_distinct("item").alias("n_near")), f"{path}/n_near")
        ends = ends.join(near, F.col("doc_id").eqNullSafe(F.col("n_id")) & (F.col("text_key") == F.col("n_key")), "left").drop("n_id", "n_key")
    remove(docs.sparkSession, f"{path}/postings")
    out = ends.join(per_doc, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_key") == F.col("f_key")), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select(
        F.col("doc_id").alias(id_col), "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), *([F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")] if slack is not None else []),
    )


def keep_clean(docs: DataFrame, result: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without a hit, with docs' own columns."""
    bad = result.where("n_hit > 0").select(F.col(id_col).alias("__b_id"), F.col("text_key").alias("__b_key")).distinct()
    bad = small(stage(bad, scratch(docs.sparkSession, "contaminated")))
    same = docs[id_col].eqNullSafe(F.col("__b_id")) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col("__b_key"))
    return docs.join(bad, same, "left_anti")
