"""Registrable domains by a full list of public suffixes, from a file that the user gives.

The file has the public suffix list's format: a rule a line, from the first white space on a remark, ``//`` for lines
of remarks, ``*.x`` for any label below x, ``!y.x`` for an exception to that, and marks around the private rules.
Rules are joined to hosts by their labels from the right: a host has one key for each number of labels.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BEGIN, END = "===BEGIN PRIVATE DOMAINS===", "===END PRIVATE DOMAINS==="
#: Rules that are broadcast; a longer list is joined by shuffle.
SMALL = 100_000


@F.pandas_udf(T.StringType())
def punycode(names: pd.Series) -> pd.Series:
    """Names as hosts are written in mail; what can't be written so stays."""

    def one(name: str) -> str:
        try:
            return name.encode("idna").decode()
        except UnicodeError:
            return name

    return names.map(one)


def rules(spark: SparkSession, path: str, private: bool = True) -> DataFrame:
    """(key, exact, wild, exception) of a list: which rules there are for the labels of ``key``. A path that isn't there raises."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    marks = lines.agg(F.min(F.when(F.contains("line", F.lit(BEGIN)), F.col("at"))).alias("begin"), F.max(F.when(F.contains("line", F.lit(END)), F.col("at"))).alias("end")).first()
    rule = F.lower(F.regexp_extract("line", r"^\s*(\S*)", 1))
    kept = lines.where((rule != "") & ~rule.startswith("//"))
    if not private and marks["begin"] is not None:
        kept = kept.where((F.col("at") < marks["begin"]) | (F.col("at") > (marks["end"] if marks["end"] is not None else 1 << 30)))
    kind = F.when(rule.startswith("!"), "exception").when(rule.startswith("*."), "wild").otherwise("exact")
    found = kept.select(kind.alias("kind"), F.regexp_replace(rule, r"^(!|\*\.)|\.$", "").alias("key")).where("key <> '' and key <> '*'")
    found = found.unionByName(found.where(F.col("key").rlike(r"[^\x00-\x7F]")).select("kind", punycode("key").alias("key")))
    return found.groupBy("key").agg(*(F.bool_or(F.col("kind") == k).alias(k) for k in ("exact", "wild", "exception")))


def labels(host: Column) -> Column:
    return F.split(F.lower(host), r"\.")


def tail(parts: Column, n: Column) -> Column:
    return F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")


def folds(host: Column) -> Column:
    """Whether a host has labels to fold: it is no address in numbers, has a dot and no empty label."""
    whole = F.lower(host)
    return F.contains(whole, F.lit(".")) & ~whole.rlike(r"^\d+(\.\d+)*$") & ~whole.rlike(r"^\.|\.\.|\.$")


def registrable(hosts: DataFrame, listed: DataFrame, host: str = "host") -> DataFrame:
    """(host, registrable) of each distinct host: its public suffix and one label more, by the rule that prevails: an exception,
    else the longest, else one label.  A host that is a suffix itself or doesn't fold stays as it is, in lower case; a null one is
    null."""
    names = hosts.select(F.col(host).alias("host")).distinct()
    parts = labels(F.col("host"))
    sizes = F.sequence(F.lit(1), F.size(parts))
    keys = names.where(folds(F.col("host"))).select("host", F.size(parts).alias("n"), F.explode(sizes).alias("k"), parts.alias("parts"))
    keys = keys.select("host", "n", "k", tail(F.col("parts"), F.col("k")).alias("key"))
    few = listed.count() <= SMALL
    hits = keys.join(F.broadcast(listed) if few else listed, "key")
    longest = F.greatest(F.max(F.when(F.col("exact"), F.col("k"))), F.max(F.when(F.col("wild") & (F.col("k") < F.col("n")), F.col("k") + 1)))
    best = hits.groupBy("host").agg(F.coalesce(F.max(F.when(F.col("exception"), F.col("k") - 1)), longest, F.lit(1)).alias("suffix"))
    suffix = F.coalesce("suffix", F.lit(1))
    found = F.when(folds(F.col("host")) & (F.size(parts) > suffix), tail(parts, suffix + 1)).otherwise(F.lower("host"))
    return names.join(best, "host", "left").select("host", found.alias("registrable"))
