r"""Chat formatting with token-budgeted windows.

A turn is written as `### role: text`, a line break and `</turn>`. Inside texts a control string
gets one more backslash in front than it had; reading takes it away again. Prefix sums of turn
tokens choose turn-aligned spans; each span becomes a window that starts with the system turn and
repeats a few turns of history, and only assistant texts that are new to the window are under its
loss mask.

Turns stay rows until their prefix sums are known: they are dealt by range of (conversation, turn), so
even one conversation of all rows is summed by many tasks, and each range adds what the ranges before
hold of its first conversation. Spans are then chosen in chunks of so many budgets (a parameter), which bounds
what one row holds; a chunk begins a span. Only the last turns of a chunk go to the next one too, as history.

A turn's tokens are a bound that no byte-level tokenizer exceeds which cuts texts at words as that of the
vocabulary does: a word that is one entry of the vocabulary is one token, and anything else has as many tokens
as bytes at most. It is taken of the turn as it is written, with its marks, and turns are cut apart at their
ends, so the tokens of a window of several turns are within the budget. Without a vocabulary each byte counts.
Or else tokens are counted by a column of the caller's.

Defined results: a null text or role is empty; turns are ordered by number, then role and text
(nulls first), so repeated turn numbers are all kept; a turn larger than what the system turn leaves of
the budget stands alone in its span, without history; a null conv_id is one conversation; tables may be
empty and have further columns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm.common import remove, scratch, stage

# Fixed strings of the template.
HEAD, END = "### ", "</turn>"
FOOT = f"\n{END}\n"
CONTROL = "(### |</turn>)"
#: Tokens that a turn's marks count for, where the caller counts those of its text.
MARK_TOKENS = 4
#: How a byte-level tokenizer cuts a text before it looks up its vocabulary (runs of spaces: into more parts here). Fixed value.
PIECES = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
#: Entries of the vocabulary that are known as words, the most frequent ones first.
KNOWN = 16_384


def escape(text: Column) -> Column:
    """One more backslash before each control string."""
    return F.regexp_replace(text, r"(?<!\\)(\\*+)" + CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)\\(\\*+)" + CONTROL, "$1$2")


def known_words(vocabulary: str, most: int = KNOWN) -> list[str]:
    """The first words (of A-Z and a-z, with a space before or not) of a tokenizer's file that it makes one token of."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    found = sorted((k, w.replace("\u0120", " ")) for w, k in tokenizer.get_vocab(with_added_tokens=False).items() if re.fullmatch("\u0120?[A-Za-z]+", w))
    words = [w for _, w in found[:most]]
    return [w for w, e in zip(words, tokenizer.encode_batch(words, add_special_tokens=False), strict=True) if len(e.ids) == 1]


def with_tokens(turns: DataFrame, text: Column, known: list[str], out: str) -> DataFrame:
    """turns with out, a bound of a text's tokens, within the JVM; see above."""
    if not known:
        return turns.withColumn(out, F.octet_length(text).cast("long"))
    turns = turns.withColumn("__pieces", F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)))
    listed = ", ".join(f"'{w}'" for w in known)  # a hashed set in the plan
    return turns.withColumn(out, F.expr(f"aggregate(__pieces, 0L, (n, p) -> n + CASE WHEN p IN ({listed}) THEN 1 ELSE octet_length(p) END)")).drop("__pieces")


def placed_turns(turns: DataFrame, count: Column | None, known: list[str], path: str) -> DataFrame:
    """(conv_id, place, before, role, head, body, tokens): place and tokens before each turn in its conversation."""
    order = ["turn", "role", "text"]
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), *([] if count is None else [(count + MARK_TOKENS).cast("long").alias("tokens")]))
    # ranges are found from the rows as they come; what is made of them is made after that, once
    dealt = rows.repartitionByRange("conv_id", *order)
    dealt = dealt.withColumns({"head": F.concat(F.lit(HEAD), F.url_encode("role"), F.lit(": ")), "body": escape(F.col("text"))})
    if count is None:
        dealt = with_tokens(dealt, F.concat("head", "body", F.lit(FOOT)), known, "tokens")
    dealt = stage(dealt.withColumn("part", F.spark_partition_id()), f"{path}/turns")
    sums = dealt.groupBy("part", "conv_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("turns"))
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(F.col("part").alias("o_part"), F.col("conv_id").alias("o_id"), F.sum("tokens").over(earlier).alias("off"), F.sum("turns").over(earlier).alias("off_turns"))
    # a range begins inside one conversation at most: one row a range
    offsets = F.broadcast(offsets.where("off is not null"))
    here = W.partitionBy("part", "conv_id").orderBy(*order)
    own = dealt.withColumns({"upto": F.sum("tokens").over(here.rowsBetween(W.unboundedPreceding, 0)), "nth": F.row_number().over(here) - 1})
    own = own.join(offsets, (F.col("part") == F.col("o_part")) & F.col("conv_id").eqNullSafe(F.col("o_id")), "left")
    off = lambda c: F.coalesce(c, F.lit(0))
    return own.select(
        "conv_id", (F.col("nth") + off("off_turns")).alias("place"), (F.col("upto") - F.col("tokens") + off("off")).alias("before"),
        "role", "head", "body", "tokens",
    )


def chunks_of(placed: DataFrame, size: int, history_tokens: int) -> DataFrame:
    """(conv_id, turns, first, system): a chunk's turns in order, where its own begin, and the conversation's system turn."""
    at = (F.col("before") / size).cast("long")
    # the turns that a chunk's first ones may repeat
    reach = ((F.col("before") + history_tokens) / size).cast("long")
    rows = placed.select("*", at.alias("home"), F.explode(F.when(reach > at, F.array(at, at + 1)).otherwise(F.array(at))).alias("chunk"))
    turn = F.struct("place", "before", "tokens", (F.col("home") == F.col("chunk")).alias("own"), "role", "head", "body")
    grouped = rows.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    grouped = grouped.withColumn("first", F.size(F.filter("turns", lambda t: ~t["own"]))).where(F.col("first") < F.size("turns"))
    system = placed.where((F.col("place") == 0) & (F.col("role") == "system")).select(F.col("conv_id").alias("s_id"), F.struct("role", "head", "body", "tokens").alias("system"))
    return grouped.join(system, F.col("conv_id").eqNullSafe(F.col("s_id")), "left").drop("s_id")


def with_spans(chunks: DataFrame, budget: int, history: int, history_tokens: int) -> DataFrame:
    """chunks with spans: each from and to (indices in turns, to excluded) of new turns, and back (first repeated turn)."""
    turns = lambda i: F.col("turns")[i]
    end = lambda i: turns(i)["before"] + turns(i)["tokens"]
    chunks = chunks.withColumn("left", F.lit(budget).cast("long") - F.coalesce("system.tokens", F.lit(0)))
    room = F.col("left") - history_tokens
    # a turn opens a span if, with it, the tokens since the span's first turn would pass the room
    opened = F.aggregate(
        F.sequence(F.col("first"), F.size("turns") - 1),
        F.struct(F.array(F.col("first")).alias("cuts"), turns(F.col("first"))["before"].alias("since")),
        lambda a, i: F.when((i > F.col("first")) & (end(i) - a["since"] > room), F.struct(F.concat(a["cuts"], F.array(i)).alias("cuts"), turns(i)["before"].alias("since"))).otherwise(a),
    )
    chunks = chunks.withColumn("cuts", opened["cuts"])
    spans = F.transform("cuts", lambda c, k: F.struct(c.alias("from"), F.coalesce(F.get("cuts", k + 1), F.size("turns")).alias("to")))
    # the system turn is there already
    lowest = F.when(F.col("system").isNotNull() & (turns(0)["place"] == 0), 1).otherwise(0)

    def back(s: Column) -> Column:
        """The first turn before the span from which history fits its own budget and the window's."""
        fits = lambda i: (turns(s["from"])["before"] - turns(i)["before"] <= history_tokens) & (end(s["to"] - 1) - turns(i)["before"] <= F.col("left"))
        low = F.least(F.greatest(F.col("lowest"), s["from"] - history), s["from"])
        return F.coalesce(F.get(F.filter(F.sequence(low, s["from"]), lambda i: (i < s["from"]) & fits(i)), F.lit(0)), s["from"])

    chunks = chunks.withColumns({"spans": spans, "lowest": lowest})
    return chunks.withColumn("spans", F.transform("spans", lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to"), back(s).alias("back"))))


def format_chat(
    turns: DataFrame, budget: int = 1024, history: int = 2, history_tokens: int = 256, count: Column | None = None, vocabulary: str | None = None, chunk: int = 16
) -> DataFrame:
    """One row a window: conv_id, window, text, n_repeated, loss (start and length, in characters of text).

    window: the place of its first new turn in the conversation; n_repeated: the turns at the front that
    are not new (system turn and history); count: a column of turns, their tokens; vocabulary: the file of the
    tokenizer whose tokens are bounded; chunk: budgets in which spans are chosen together, each of which begins a span.
    """
    path = scratch(turns.sparkSession, "chat")
    known = known_words(vocabulary) if vocabulary and count is None else []
    placed = stage(placed_turns(turns, count, known, path), f"{path}/placed")
    remove(turns.sparkSession, f"{path}/turns")
    chunks = with_spans(chunks_of(placed, chunk * budget, history_tokens), budget, history, history_tokens)
    part = lambda t: F.struct(t["role"].alias("role"), t["head"].alias("head"), t["body"].alias("body"))
    none = F.transform(F.slice("turns", 1, 0), part)

    def window(s: Column) -> Column:
        place = F.col("turns")[s["from"]]["place"]
        repeats = F.col("system").isNotNull() & (place > 0)
        shown = F.concat(F.when(repeats, F.array(part(F.col("system")))).otherwise(none), F.transform(F.slice("turns", s["back"] + 1, s["to"] - s["back"]), part))
        return F.struct(place.alias("window"), shown.alias("shown"), (repeats.cast("int") + s["from"] - s["back"]).alias("n_repeated"))

    out = chunks.select("conv_id", F.inline(F.transform("spans", window)))
    text = F.array_join(F.transform("shown", lambda t: F.concat(t["head"], t["body"], F.lit(FOOT))), "")
    size = lambda t: F.char_length(t["head"]) + F.char_length(t["body"]) + len(FOOT)
    ends = F.aggregate("shown", F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + size(t))))
    out = out.withColumn("text", text).withColumn("ends", ends)
    new = F.filter(F.sequence(F.lit(0), F.size("shown") - 1), lambda i: (i >= F.col("n_repeated")) & (F.col("shown")[i]["role"] == "assistant"))
    loss = F.transform(
        new, lambda i: F.struct((F.col("ends")[i] + F.char_length(F.col("shown")[i]["head"])).alias("start"), F.char_length(F.col("shown")[i]["body"]).alias("length"))
    )
    return out.select("conv_id", "window", "text", "n_repeated", loss.alias("loss"))


def read_turns(text: Column) -> Column:
    """The turns (role, text) that a window's text holds."""
    parts = F.split(text, rf"(?<=\n){END}\n")
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda p: F.struct(
            F.url_decode(F.regexp_extract(p, rf"(?s)^{HEAD}([^ ]*): ", 1)).alias("role"),
            unescape(F.regexp_extract(p, rf"(?s)^{HEAD}[^ ]*: (.*)\n$", 1)).alias("text"),
        ),
    )


def read_loss(text: Column, loss: Column) -> Column:
    """The texts under a window's loss mask."""
    return F.transform(loss, lambda s: unescape(F.substring(text, s["start"] + 1, s["length"])))


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts, formatted_chars) of each conversation, whole, from its windows alone."""
    read = windows.select(
        "conv_id", "window", F.char_length("text").cast("long").alias("chars"), read_loss(F.col("text"), F.col("loss")).alias("loss"),
        F.slice(read_turns(F.col("text")), F.col("n_repeated") + 1, F.lit(2**31 - 1)).alias("turns"),
    )
    grouped = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return grouped.select("conv_id", F.flatten("w.turns").alias("turns"), F.flatten("w.loss").alias("loss_texts"), "formatted_chars")
