"""URL filters: rules, and a classifier over words that host names are split into.

A rule fits its host and all subdomains, if the path starts with the rule's; the longest rule that
fits decides. Other urls are judged by multinomial naive Bayes over host and path tokens, learned
from the urls that a rule decided. Host names are concatenated words, so they are first segmented:
the Viterbi split that is likeliest under unigram counts of words of the corpus.

No table is held whole anywhere: each host name looks up its own substrings in the word counts by a
join, and each distinct host and path shape its own tokens in the token counts.

Digits count by how many stand together, not by which: 777 and 123 are one token, so urls that differ
in figures alone are judged alike.

Defined results: a null url, or one without "://", has an empty host and path and no tokens; such
urls are judged by the class priors, ties are allowed; if the rules decided urls of one class only,
that verdict holds for all others, and without any all urls are allowed; rows that repeat are judged each
for itself; names and paths of any length are read whole; tables may be empty and may have further columns, which stay unless named like a result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import ascii_lower, scratch, small, stage

#: Additive smoothing of the token counts.
SMOOTHING = 1.0
#: Letters in a row, in a host name or a text.
LETTERS = r"\p{L}+"


@dataclass(frozen=True)
class Rule:
    """A host and the start of a path, as in `net/es/`; verdict is allow or block."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls; for lists of some hundred rules."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = r.fits(host, path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def word_counts(html: DataFrame, col: str = "html") -> DataFrame:
    """(word, n): words in all texts, without markup, scripts and styles."""
    plain = F.regexp_replace(F.col(col), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&#?\w+;", " ")
    words = html.select(F.explode(F.regexp_extract_all(F.lower(plain), F.lit(LETTERS), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


#: What each letter of an unseen word costs, in natural logarithms.
LETTER = 2.5


def viterbi(name: str, known: dict[str, float], unseen: float) -> list[str]:
    """The likeliest split of a name; known: log probabilities of words; unseen: of an unseen word of no letters.

    An unseen word is likelier than its letters apart, and less likely the longer it is. Its best place to
    begin is the same for all ends, but for those after it, so time grows with the letters times the lengths
    of known words.
    """
    lengths = sorted({len(w) for w in known}, reverse=True)
    best, back, lead, begins = [0.0], [0], -math.inf, 0
    for j in range(1, len(name) + 1):
        if best[j - 1] + LETTER * (j - 1) > lead:
            lead, begins = best[j - 1] + LETTER * (j - 1), j - 1
        top, at = lead + unseen - LETTER * j, begins
        for size in lengths:
            p = known.get(name[j - size : j]) if size <= j else None
            if p is not None and best[j - size] + p > top:
                top, at = best[j - size] + p, j - size
        best.append(top)
        back.append(at)
    words, j = [], len(name)
    while j:
        words.append(name[back[j] : j])
        j = back[j]
    return words[::-1]


def split_names(name: pd.Series, pieces: pd.Series, total: pd.Series) -> pd.Series:
    def one(n: str, own: Iterable, t: float) -> list[str]:
        return viterbi(n, {p["piece"]: math.log(p["n"] / t) for p in own}, -math.log(t + 1))

    return pd.Series([one(*x) for x in zip(name, pieces, total, strict=True)])


def segment(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) of each distinct name; counts: (word, n)."""
    names = names.select("name").where("name <> ''").distinct()
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sort_array(F.collect_set(F.char_length("word"))).alias("lengths")).first()
    # only stretches as long as some word are looked up; lengths are few, whatever the words
    total, lengths = float(sums["n"]) or 1.0, F.lit([int(k) for k in sums["lengths"]] or [1])
    size = F.char_length("name")
    parts = names.select("name", F.explode(F.sequence(F.lit(1), size)).alias("at"))
    parts = parts.select("name", "at", F.explode(F.filter(lengths, lambda k: k <= F.char_length("name") - F.col("at") + 1)).alias("width"))
    parts = parts.select("name", F.expr("substring(name, at, width)").alias("piece")).distinct()
    found = parts.join(small(counts.withColumnRenamed("word", "piece")), "piece").groupBy("name")
    # a name has no more pieces than letters times lengths of words
    found = found.agg(F.collect_list(F.struct("piece", "n")).alias("pieces"))
    none = F.array().cast("array<struct<piece:string,n:bigint>>")
    rows = names.join(found, "name", "left").select("name", F.coalesce("pieces", none).alias("pieces"))
    split = F.pandas_udf(split_names, "array<string>")
    return rows.select("name", split("name", "pieces", F.lit(total)).alias("words"))


def names_of(host: Column) -> Column:
    """The stretches of letters in a host name."""
    return F.regexp_extract_all(host, F.lit(LETTERS), F.lit(0))


def figures_of(host: Column) -> Column:
    """The stretches of digits in a host name, each digit as 0, as in a path's shape."""
    return F.transform(F.regexp_extract_all(host, F.lit("[0-9]+"), F.lit(0)), lambda d: F.repeat(F.lit("0"), F.char_length(d)))


def shape_of(path: Column) -> Column:
    """A path in lower case whose digits are all 0, so that numbered paths are one shape."""
    return F.regexp_replace(F.lower(path), r"[0-9]", "0")


def path_tokens(shape: Column) -> Column:
    """Path tokens are marked, to be told from host words."""
    return F.transform(F.regexp_extract_all(shape, F.lit(r"[\p{L}0]+"), F.lit(0)), lambda t: F.concat(F.lit("/"), t))


def token_tables(urls: DataFrame, counts: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(host, token, times) and (shape, token, times) of all distinct hosts and shapes."""
    hosts = stage(urls.select("host").distinct(), f"{path}/hosts")
    names = hosts.select("host", F.explode(names_of(F.col("host"))).alias("name"))
    split = stage(segment(names, counts), f"{path}/names")
    # parts that all hosts share (www, com) are joined last with a table of distinct names
    per_host = names.groupBy("host", "name").agg(F.count(F.lit(1)).alias("times")).join(small(split), "name")
    per_host = per_host.select("host", F.explode("words").alias("token"), "times")
    figures = hosts.select("host", F.explode(figures_of(F.col("host"))).alias("token"), F.lit(1).cast("long").alias("times"))
    per_host = per_host.unionByName(figures).groupBy("host", "token").agg(F.sum("times").alias("times"))
    per_shape = urls.select("shape").distinct().select("shape", F.explode(path_tokens(F.col("shape"))).alias("token"))
    per_shape = per_shape.groupBy("shape", "token").agg(F.count(F.lit(1)).alias("times"))
    return stage(per_host, f"{path}/host-tokens"), stage(per_shape, f"{path}/shape-tokens")


def learn(urls: DataFrame, per_host: DataFrame, per_shape: DataFrame, path: str) -> tuple[DataFrame, float]:
    """(token, weight) and the prior: weights add up to the log odds of block against allow."""
    ruled = urls.where("verdict is not null")
    by = lambda key: ruled.groupBy(key).agg(F.sum(F.when(F.col("verdict") == "block", F.col("n")).otherwise(0)).alias("block"), F.sum(F.when(F.col("verdict") == "allow", F.col("n")).otherwise(0)).alias("allow"))
    both = per_host.join(small(by("host")), "host").select("token", "times", "block", "allow")
    both = both.unionByName(per_shape.join(small(by("shape")), "shape").select("token", "times", "block", "allow"))
    tokens = both.groupBy("token").agg(F.sum(F.col("times") * F.col("block")).alias("block"), F.sum(F.col("times") * F.col("allow")).alias("allow"))
    tokens = stage(tokens, f"{path}/tokens")
    total = tokens.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("block", "allow")), F.count(F.lit(1)).alias("v")).first()
    n = {r["verdict"]: r["n"] for r in ruled.groupBy("verdict").agg(F.sum("n").alias("n")).collect()}
    if not n.get("block") or not n.get("allow"):
        prior = math.inf if n.get("block") else -math.inf
        return tokens.select("token", F.lit(0.0).alias("weight")), prior
    share = lambda c: F.log((F.col(c) + SMOOTHING) / (total[c] + SMOOTHING * total["v"]))
    return tokens.select("token", (share("block") - share("allow")).alias("weight")), math.log(n["block"] / n["allow"])


def judge_urls(pages: DataFrame, rules: Sequence[Rule], counts: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule (null if none fits), log_odds (of block; null if a rule fits) and verdict.

    counts: (word, n), the unigram counts that host names are split by.
    """
    spark = pages.sparkSession
    path = scratch(spark, "urls")
    counts = stage(counts.select("word", "n"), f"{path}/counts")
    host, where = host_of(F.col(url_col)), path_of(F.col(url_col))
    parsed = pages.withColumns({"host": host, "path": where})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": rule, "__verdict": verdict, "__shape": shape_of(F.col("path"))})
    urls = parsed.select("host", F.col("__shape").alias("shape"), F.col("__verdict").alias("verdict"))
    urls = stage(urls.groupBy("host", "shape", "verdict").agg(F.count(F.lit(1)).alias("n")), f"{path}/urls")
    per_host, per_shape = token_tables(urls, counts, path)
    weights, prior = learn(urls, per_host, per_shape, path)
    weights = small(stage(weights, f"{path}/weights"))
    odds = lambda table, key: stage(
        table.join(weights, "token").groupBy(key).agg(F.sum(F.col("times") * F.col("weight")).alias("odds")), f"{path}/{key}-odds"
    )
    by_host = odds(per_host, "host").withColumnsRenamed({"host": "__h", "odds": "__host_odds"})
    by_shape = odds(per_shape, "shape").withColumnsRenamed({"shape": "__s", "odds": "__shape_odds"})
    out = parsed.join(small(by_host), F.col("host") == F.col("__h"), "left").join(small(by_shape), F.col("__shape") == F.col("__s"), "left")
    sums = F.coalesce("__host_odds", F.lit(0.0)) + F.coalesce("__shape_odds", F.lit(0.0)) + F.lit(prior)
    out = out.withColumn("log_odds", F.when(F.col("rule").isNull(), sums))
    out = out.withColumn("verdict", F.coalesce("__verdict", F.when(F.col("log_odds") > 0, F.lit("block")).otherwise(F.lit("allow"))))
    return out.drop("__verdict", "__shape", "__h", "__s", "__host_odds", "__shape_odds")
