"""Title overlap, tag overlap, and the token-sort ratio with its exact native prefilter."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.functions.text import collapse, strip, title_words


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the smaller set; 0 if a set is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def title_overlap(a: Column, b: Column) -> Column:
    """1 if one lower-case title contains the other, else the overlap of their words."""
    la, lb = F.lower(a), F.lower(b)
    return F.when(la.contains(lb) | lb.contains(la), 1.0).otherwise(overlap(title_words(a), title_words(b)))


def tag_overlap(a: Column, b: Column) -> Column:
    low = lambda c: F.array_distinct(F.transform(c, F.lower))
    return overlap(low(a), low(b))


def sorted_tokens(c: Column) -> Column:
    """A title's words in order, joined by spaces; case counts."""
    return F.array_join(F.array_sort(F.split(collapse(c), " ")), " ")


def may_reach(a: Column, b: Column, ratio: float) -> Column:
    """False only if the ratio of two sorted titles is below `ratio`: by their lengths and a bounded edit distance."""
    n, m = F.char_length(a), F.char_length(b)
    most = F.floor((1 - ratio / 100) * (n + m) + 1e-9).cast("int")
    return (F.abs(n - m) <= most) & (F.call_function("levenshtein", a, b, most) >= 0)


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of a."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        hit = s & where.get(c, 0)
        s = (s + hit | s - hit) & full
    return len(a) - s.bit_count()


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """200 * LCS / (both lengths) of two texts; 100 for two empty ones."""
    return pd.Series([None if x is None or y is None else 100.0 if not x and not y else 200.0 * _lcs(x, y) / (len(x) + len(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio_buckets(length: Column, least: float) -> Column:
    """The length class of a text; texts whose ratio can reach `least` lie in the same class or a neighbouring one."""
    return F.floor(F.log(length + 1.0) / F.log(F.lit((200 - least) / least))).cast("int")


def title_keys(titles: DataFrame, least: float, on: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Of distinct titles (*on, t): (*on, t, key) for each as the one that is looked for, and as the one that is found.

    A title is found under its words and all its pieces of up to three characters. It is looked for under the rarest of
    its own pieces of three (all of it, if shorter), which a title that contains it has, and under the rarest
    n - ceil(least * n) + 1 of its n words, one of which any title has that shares `least` of them. How rare a key is
    comes from a count over all titles, so common words and beginnings are no keys unless a title has no others.
    """
    low, words = F.lower("t"), title_words(F.col("t"))
    pieces = lambda n: F.when(F.char_length(low) >= n, F.transform(F.sequence(F.lit(1), F.char_length(low) - (n - 1)), lambda i: F.concat(F.lit(f"{n}:"), F.substring(low, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))
    named = F.transform(words, lambda w: F.concat(F.lit("w:"), w))
    hay = titles.select(*on, "t", F.explode(F.array_distinct(F.concat(named, pieces(1), pieces(2), pieces(3)))).alias("key"))
    own = F.when(F.char_length(low) >= 3, pieces(3)).when(F.char_length(low) == 2, pieces(2)).otherwise(pieces(1))
    asked = titles.select(*on, "t", F.size(words).alias("n"), F.explode(F.array_distinct(F.concat(named, own))).alias("key"))
    rare = asked.join(hay.groupBy(*on, "key").agg(F.count(F.lit(1)).alias("k")), [*on, "key"])
    by = rare.groupBy(*on, "t", "n").agg(F.array_sort(F.collect_list(F.struct("k", "key"))).alias("keys"))
    is_word = lambda x: x["key"].startswith("w:")
    head = F.slice(F.filter("keys", is_word), F.lit(1), F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1)
    picked = F.concat(F.slice(F.filter("keys", lambda x: ~is_word(x)), 1, 1), F.when(F.col("n") > 0, head).otherwise(F.slice("keys", 1, 0)))
    return by.select(*on, "t", F.explode(F.transform(picked, lambda x: x["key"])).alias("key")), hay


def title_pairs(left: DataFrame, right: DataFrame, least: float, on: list[str] = ()) -> DataFrame:
    """(*on, a, b, score): distinct titles of both sides, with equal `on` columns, whose overlap is `least` or more, by
    equal keys (title_keys) rather than all pairs.

    Blank titles are left out: callers do not compare them.
    """
    sides = [df.select(*on, F.col("title").alias("t")).filter(strip(F.col("t")) != "").distinct() for df in (left, right)]
    every = sides[0].withColumn("_a", F.lit(True)).withColumn("_b", F.lit(False)).unionByName(sides[1].withColumn("_a", F.lit(False)).withColumn("_b", F.lit(True)))
    every = every.groupBy(*on, "t").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    needles, hay = title_keys(every, least, on)
    met = needles.join(hay.withColumnRenamed("t", "other"), [*on, "key"]).select(*on, "t", "other").distinct()
    which = lambda side, name: every.filter(side).select(*on, F.col("t").alias(name))
    pairs = met.select(*on, F.col("t").alias("a"), F.col("other").alias("b")).unionByName(met.select(*on, F.col("other").alias("a"), F.col("t").alias("b"))).distinct()
    pairs = pairs.join(which("_a", "a"), [*on, "a"], "left_semi").join(which("_b", "b"), [*on, "b"], "left_semi")
    return pairs.withColumn("score", title_overlap(F.col("a"), F.col("b"))).filter(F.col("score") >= least)
