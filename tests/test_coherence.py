"""Texts written in several charsets are read as what they were."""

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import coherence

PLANTED = ("utf-8", "cp1252", "mac_roman", "cp437", "cp850")


@pytest.fixture(scope="module")
def texts(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")


def test_planted_charsets_are_recovered(spark, texts):
    held_out = texts.where("doc_id % 4 = 3")
    model = coherence.train(texts.where("doc_id % 4 <> 3"))
    assert 0 < len(model.known) <= coherence.PAIRS
    rows = []
    for r in held_out.collect():
        for name in PLANTED:
            try:
                rows.append((r["doc_id"], name, r["text"], bytearray(r["text"].encode(name))))
            except UnicodeEncodeError:
                continue
    df = spark.createDataFrame(rows, "doc_id long, charset string, want string, data binary")
    got = coherence.decoded(df, model).groupBy("charset").agg(F.avg((F.col("text") == F.col("want")).cast("int")).alias("share"), F.count(F.lit(1)).alias("n")).collect()
    assert {r["charset"] for r in got} == set(PLANTED) and all(r["share"] >= 0.99 and r["n"] > 50 for r in got), got


def test_readings_that_are_close_go_to_the_chain():
    model = coherence.Model({})
    assert model.told(b"plain") == "utf-8" and model.told("é".encode("cp1252")) is None
    assert model.decoded("café".encode("cp1252")) == "café" and model.decoded("café".encode()) == "café"


def test_nulls_and_ascii(spark):
    model = coherence.train(spark.createDataFrame([(None,), ("",), ("größe " * 50,)], "text string"))
    df = spark.createDataFrame([(1, None), (2, bytearray(b"")), (3, bytearray(b"abc")), (4, bytearray("größe".encode("mac_roman")))], "id long, data binary")
    assert sorted((r["id"], r["text"]) for r in coherence.decoded(df, model).collect()) == [(1, None), (2, ""), (3, "abc"), (4, "größe")]
