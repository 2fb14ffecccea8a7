"""Joins of texts with patterns that they hold, through postings of trigrams instead of a product.

A text that matches a pattern holds every run of literal characters of it, so it holds each trigram of these runs.  Each pattern looks up
only its trigram (of runs of LONG characters and more, its gram of that length) that the fewest texts of its group hold, by an equi-join with the postings, and what comes back is tested with
the pattern itself.  Patterns without three literal characters in a row are tested against their whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Length of the grams by which longer runs are looked up: a text is listed by these too, so that numbers and names meet few others.
LONG = 6


def trigrams(text: Column, n: int = 3) -> Column:
    """Distinct runs of three characters, or of ``n``."""
    every = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(F.when(F.length(text) >= n, every).otherwise(F.array().cast("array<string>")))


def postings(texts: DataFrame, key: str, text: str, fold: bool = False) -> DataFrame:
    """key, gram, text of distinct texts; ``fold`` puts grams in lower case."""
    rows = texts.select(key, text).where(F.col(text).isNotNull()).distinct()
    return rows.select(key, F.explode(F.concat(*(trigrams(F.lower(text) if fold else F.col(text), n) for n in (3, LONG)))).alias("gram"), text)


def pairs(patterns: DataFrame, texts: DataFrame, key: str, pattern: str, text: str, test: str, fold: bool = False, like: bool = True) -> DataFrame:
    """key, pattern, text: distinct pairs of one group for which the SQL condition ``test`` holds.

    The pattern is one of LIKE (``like``: % and _ stand for others, a backslash before them not), else literal text that the test asks for.
    """
    asked = patterns.select(key, pattern).where(F.col(pattern).isNotNull()).distinct()
    literal = F.lower(pattern) if fold else F.col(pattern)
    runs = F.split(literal, r"[%_\\]") if like else F.array(literal)
    grams = F.array_distinct(F.flatten(F.transform(runs, lambda x: F.when(F.length(x) >= LONG, trigrams(x, LONG)).otherwise(trigrams(x)))))
    known = postings(texts, key, text, fold)
    sizes = known.groupBy(key, "gram").agg(F.count(F.lit(1)).alias("n"))
    wanted = asked.select(key, pattern, F.explode(grams).alias("gram")).join(sizes.hint("merge"), [key, "gram"], "left")
    rarest = wanted.groupBy(key, pattern).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best")).where("best.n > 0").select(key, pattern, F.col("best.gram").alias("gram"))
    found = rarest.join(known.hint("merge"), [key, "gram"]).where(test).select(key, pattern, text)
    short = asked.where(F.size(grams) == 0).join(texts.select(key, text).where(F.col(text).isNotNull()).distinct().hint("merge"), key).where(test)
    return found.unionByName(short.select(key, pattern, text))


def like_pairs(patterns: DataFrame, texts: DataFrame, key: str, pattern: str = "pattern", text: str = "path", fold: bool = False) -> DataFrame:
    """``pairs`` of LIKE, or with ``fold`` of ILIKE."""
    return pairs(patterns, texts, key, pattern, text, f"`{text}` {'ILIKE' if fold else 'LIKE'} `{pattern}`", fold)
