"""How text filters interact: what each removes at each step of every order of them.

Each document becomes a mask, one bit for each filter that it fails, made by native expressions on the
whole text; the bit of copies comes from the least doc_id of equal texts. All that any order of the
filters does follows from how many documents of a part have which mask. So the masks are counted once,
into 2^n cells for each part, and the orders are enumerated from the cells, without the documents.

Equal texts are grouped by their SHA-256, so whole texts are not shuffled. Rows are counted by
(text, id, part) first and by (text, part) then, both with partial sums in the tasks that read them, so a
text that makes up a third of the table is a few rows before it meets the others of its kind.

Defined results: a null text is an empty one, a null part is the part ''; a null id is no smaller and no
larger than any, so its row neither is a copy nor makes one; of rows that repeat a text under its least
id none is a copy; an id with several rows in labels has a label if one of them has it; very long texts
are read whole; tables may be empty (no documents: no rows) and may have any further columns.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm.common import SPACES, small


@dataclass(frozen=True)
class Filter:
    """A letter, and which documents fail: a condition on (text, words), or None for copies of a smaller id's text."""

    letter: str
    fails: Callable[[Column, Column], Column] | None


#: The filters of the query's contract.
FILTERS = (
    Filter("A", lambda text, words: F.size(words) < 100),
    Filter("B", lambda text, words: 100 * F.size(F.array_distinct(words)) < 80 * F.size(words)),
    Filter("C", lambda text, words: 100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.char_length(text)),
    Filter("D", lambda text, words: text.rlike("[#$%&*|]")),
    Filter("E", None),
)


def masked(docs: DataFrame, filters: tuple[Filter, ...], id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(doc_id, part, digest, mask): the bits of all filters but copies'."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    bits = [F.when(f.fails(F.col("text"), F.col("words")), 1 << k).otherwise(0) for k, f in enumerate(filters) if f.fails]
    return own.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits, F.lit(0)).alias("mask"))


def cells(docs: DataFrame, labels: DataFrame, filters: tuple[Filter, ...] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part that fail just the mask's filters."""
    rows = masked(docs, filters, id_col, text_col, part_col).groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("c"))
    has = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(c)
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg(has("quality"), has("toxic"))
    # a row without an id has no label; it is dealt by its text, so that such rows don't meet in one task
    key = rows.withColumn("key", F.coalesce(F.col("doc_id").cast("string"), F.hex("digest")))
    marks = small(marks.withColumn("l_id", F.col("l_id").cast("string")))
    rows = key.join(marks, (F.col("key") == F.col("l_id")) & F.col("doc_id").isNotNull(), "left")
    by = ["part", "digest", "mask", "good", "bad"]
    rows = rows.select("doc_id", "part", "digest", "mask", "c", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("bad"))
    known = F.col("doc_id").isNotNull()
    texts = rows.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(known, F.col("c")).otherwise(0)).alias("known"), F.min(F.when(known, F.struct("doc_id", "c"))).alias("first"))
    # a text has a row for each part and label here, not one for each document
    least = F.min("first.doc_id").over(W.partitionBy("digest"))
    texts = texts.withColumn("least", least)
    copies = F.col("known") - F.when(F.col("first.doc_id") == F.col("least"), F.col("first.c")).otherwise(0)
    bit = sum(1 << k for k, f in enumerate(filters) if f.fails is None)
    copies = copies if bit else F.lit(0).cast("long")
    both = F.array(F.struct(F.col("mask"), (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + bit).alias("mask"), F.col("copies").alias("n")))
    split = texts.withColumn("copies", copies).select("part", "good", "bad", F.inline(both))
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("bad")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, filters: tuple[Filter, ...] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step, with what the step's filter does there.

    filter_order, step, kept (after the step), removed (at it), redundant (failing its filter, removed
    before), unique_fails (failing its filter alone), good_lost and toxic_lost (removed with that label),
    shapley (its filter's removed, summed over all orders). At most 6 filters, as orders are a factorial.
    """
    if len(filters) > 6 or len({f.letter for f in filters}) < len(filters) or any(len(f.letter) != 1 for f in filters):
        raise ValueError("six filters at most, each with a letter of its own")
    if sum(f.fails is None for f in filters) > 1:
        raise ValueError("one filter of copies at most")
    n, masks = len(filters), range(1 << len(filters))
    letters = "".join(f.letter for f in filters)
    found = cells(docs, labels, filters, id_col, text_col, part_col)
    # at most 2^n cells for a part
    parts = found.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("cells"))
    orders = F.explode(F.lit(["".join(p) for p in itertools.permutations(letters)])).alias("filter_order")
    steps = parts.select("part", "cells", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    bit_of = F.create_map(*(F.lit(x) for k, c in enumerate(letters) for x in (c, 1 << k)))
    bit_at = lambda i: F.element_at(bit_of, F.substring("filter_order", i, F.lit(1)))
    before = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda a, i: a + F.when(i < F.col("step"), bit_at(i)).otherwise(0))
    steps = steps.withColumns({"bit": bit_at(F.col("step")), "before": before})

    def total(of: str, when: Callable[[Column], Column], times: Callable[[Column], Column] = lambda m: F.lit(1)) -> Column:
        cell = lambda m: F.coalesce(F.try_element_at("cells", m)[of], F.lit(0))
        return F.aggregate(F.lit(list(masks)), F.lit(0).cast("long"), lambda a, m: a + F.when(when(m), cell(m) * times(m)).otherwise(0)).alias(of)

    fails = lambda m: m.bitwiseAND(F.col("bit")) > 0
    gone = lambda m: m.bitwiseAND(F.col("before")) > 0
    removed = lambda m: fails(m) & ~gone(m)
    # a document that fails j filters is removed by each of them in one of j orders
    share = lambda m: (F.lit(math.factorial(n)) / F.bit_count(m)).cast("long")
    return steps.select(
        "part", "filter_order", "step", total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"), total("n", removed).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"), total("n", lambda m: m == F.col("bit")).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), total("n", fails, share).alias("shapley"),
    )
