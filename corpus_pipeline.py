"""A corpus pipeline of five stages over ``documents``.

Each stage takes what its predecessor kept, as Parquet, and returns documents; the last one returns the
tokenised documents.  Languages, sources and further columns pass through.  Rows of a stage keep
their multiplicity: the mix repeats documents, and those count as separate ones from there on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import balanced, classifier, common, near_copies, pieces, suffix_array


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return classifier.accepted(docs, classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingles of five words are similar by 0.8 or more."""
    return near_copies.one_of_each(docs)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that a repeated string of 200 bytes covers."""
    return suffix_array.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to the sources' target weights takes it."""
    return balanced.take(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the pieces of each document."""
    return pieces.digests(docs)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeated_strings),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", tokenise),
]

#: SQL can't express the classifier and the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written as Parquet and read again.

    What a stage has read is removed once its own rows are written; an empty table gives an empty one."""
    docs, last = common.documents(spark, sf_dir), None
    for _, stage in STAGES:
        path = common.fresh_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            common.remove(spark, last)
        last = path
    return docs
