"""Overlap joins of intervals of lines by dyadic bins, without comparing all intervals of one file.

Two intervals overlap iff one's first line lies in the other.  An interval is the disjoint union of at most two dyadic bins of each size, a
line lies in one bin of each size; so a line and an interval that holds it meet in exactly one bin, and an equi-join on bins finds each pair once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetables.sources import tables

#: Sizes of bins: 2**0 to 2**(LEVELS - 1) lines; line numbers are below 2**(LEVELS - 1).
LEVELS = 32
_BINS = "array<struct<level:int,bin:long>>"


def bins_of_line(line: Column, levels: int = LEVELS) -> Column:
    """The bin of each size that holds a line; of the ``levels`` smallest sizes."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: F.struct(k.alias("level"), F.floor(line / F.pow(F.lit(2.0), k)).cast("long").alias("bin")))


def cover(lo: Column, hi: Column) -> Column:
    """The fewest bins whose disjoint union is the interval; none where it is empty."""

    def one(level: Column, at: Column, take: Column) -> Column:
        return F.when(take, F.array(F.struct(level.alias("level"), at.alias("bin")))).otherwise(F.array().cast(_BINS))

    def step(s: Column, level: Column) -> Column:
        a, b = s["a"], s["b"]
        left = (a <= b) & (a % 2 == 1)
        right = (a <= b) & (b % 2 == 0) & ~(left & (a == b))
        found = F.concat(s["found"], one(level, a, left), one(level, b, right))
        a, b = F.when(left, a + 1).otherwise(a), F.when(right, b - 1).otherwise(b)
        return F.struct(F.when(a <= b, F.shiftright(a, 1)).otherwise(F.lit(1).cast("long")).alias("a"), F.when(a <= b, F.shiftright(b, 1)).otherwise(F.lit(0).cast("long")).alias("b"), found.alias("found"))

    start = F.struct(lo.cast("long").alias("a"), hi.cast("long").alias("b"), F.array().cast(_BINS).alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), start, step)["found"]


def overlapping(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of rows of equal keys whose lines overlap, once each: all columns of both sides, the keys once.

    left has columns lo and hi, right start_line and end_line, from 0 on and inclusive; empty intervals overlap nothing, nulls neither.
    The other columns of the two sides have names of their own.  Both are written once; a line is looked up only in bins as large as the longest
    interval of the other side can fill.
    """
    left, right = tables.stored(left.where("lo <= hi"), "left"), tables.stored(right.where("start_line <= end_line"), "right")

    def levels(longest: int | None) -> int:
        return max(1, min(LEVELS, (longest or 1).bit_length()))

    of_left = levels(left.agg(F.max(F.col("hi").cast("long") - F.col("lo") + 1)).first()[0])
    of_right = levels(right.agg(F.max(F.col("end_line").cast("long") - F.col("start_line"))).first()[0])

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.select("*", F.inline("bins")).drop("bins").join(b.select("*", F.inline("bins")).drop("bins").hint("merge"), [*keys, "level", "bin"])

    begins_in_left = met(left.withColumn("bins", cover(F.col("lo"), F.col("hi"))), right.withColumn("bins", bins_of_line(F.col("start_line"), of_left)))
    begins_in_right = met(left.withColumn("bins", bins_of_line(F.col("lo"), of_right)), right.withColumn("bins", cover(F.col("start_line") + 1, F.col("end_line"))))
    columns = [*keys, *(c for c in [*left.columns, *right.columns] if c not in keys)]
    return begins_in_left.select(*columns).unionByName(begins_in_right.select(*columns))
