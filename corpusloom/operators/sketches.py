"""Quantiles of whole numbers from sketches that can be put together.

A sketch is a histogram whose bins grow with the values: numbers below 2**(BITS + 1) have a bin each, above that each power of
two has 2**BITS of them.  So a bin is narrower than its least value by a factor of 2**BITS at least, whatever the data,
and so is the error of a quantile that is told by its bin.  Sketches of parts add up to the sketch of the whole, in any order;
only bins are shuffled, some thousand for a key at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a power of two, as a power of two: a quantile is wrong by less than 1 in 128.
BITS = 6


def width(value: Column) -> Column:
    """The power of two of a value's bin."""
    return F.greatest(F.length(F.bin(value)) - F.lit(BITS + 1), F.lit(0))


def low(value: Column) -> Column:
    """The least value of the bin that a value that isn't negative falls into."""
    shift = width(value)
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketch(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, low, n): bins with their number of values. Null and negative values are left out."""
    found = df.where(F.col(value) >= 0).select(*keys, low(F.col(value).cast("long")).alias("low"))
    return found.groupBy(*keys, "low").agg(F.count(F.lit(1)).alias("n"))


def together(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The sketch of all that two sketches hold."""
    return a.unionByName(b).groupBy(*keys, "low").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], **fractions: float) -> DataFrame:
    """(keys, n, a column for each fraction): the middle of the bin that holds the value of that rank, ceil(fraction * n)."""
    upto = Window.partitionBy(*keys).orderBy("low")
    ranked = sketches.select("*", F.sum("n").over(upto).alias("__upto"), F.sum("n").over(Window.partitionBy(*keys)).alias("__all"))
    middle = F.col("low") + (F.call_function("shiftleft", F.lit(1).cast("long"), width(F.col("low"))) - 1) / 2
    of = lambda q: F.min(F.when(F.col("__upto") >= F.ceil(F.lit(q) * F.col("__all")), middle))
    return ranked.groupBy(*keys).agg(F.max("__all").alias("n"), *(of(q).alias(name) for name, q in fractions.items()))
