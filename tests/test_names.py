"""Public suffixes from a list, names within one edit, quantile sketches, persons by join."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import suffixes
from corpusloom.operators import access, graph, sketches

LIST = """// remarks
com
uk
co.uk   more words of the line
*.ck
!www.ck
jp
*.kawasaki.jp
!city.kawasaki.jp
рф

// ===BEGIN PRIVATE DOMAINS===
github.io
*.compute.example.com
// ===END PRIVATE DOMAINS===
net
"""
HOSTS = {
    "example.com": "example.com", "a.b.Example.com": "example.com", "com": "com", "x.co.uk": "x.co.uk", "a.x.co.uk": "x.co.uk", "co.uk": "co.uk", "uk": "uk", "x.uk": "x.uk",
    "a.b.ck": "a.b.ck", "z.a.b.ck": "a.b.ck", "b.ck": "b.ck", "www.ck": "www.ck", "z.www.ck": "www.ck", "ck": "ck", "a.kawasaki.jp": "a.kawasaki.jp", "b.a.kawasaki.jp": "b.a.kawasaki.jp", "c.b.a.kawasaki.jp": "b.a.kawasaki.jp",
    "city.kawasaki.jp": "city.kawasaki.jp", "x.city.kawasaki.jp": "city.kawasaki.jp", "me.github.io": "me.github.io", "a.me.github.io": "me.github.io", "github.io": "github.io", "a.b.c.compute.example.com": "b.c.compute.example.com",
    "x.y.unknown": "y.unknown", "unknown": "unknown", "10.0.0.1": "10.0.0.1", ".com": ".com", "a..com": "a..com", "a.com.": "a.com.", "a.xn--p1ai": "a.xn--p1ai", "b.a.xn--p1ai": "a.xn--p1ai", "a.рф": "a.рф", None: None, "q.net": "q.net",
}


@pytest.fixture
def listed(spark, tmp_path):
    path = tmp_path / "list.dat"
    path.write_text(LIST)
    return str(path)


@pytest.mark.parametrize("few", [True, False])
def test_suffixes_of_a_list(spark, listed, monkeypatch, few):
    if not few:
        monkeypatch.setattr(suffixes, "SMALL", 0)
    hosts = spark.createDataFrame([(h,) for h in HOSTS] * 2, "host string")
    got = suffixes.registrable(hosts, suffixes.rules(spark, listed))
    assert {r["host"]: r["registrable"] for r in got.collect()} == HOSTS and got.count() == len(HOSTS)


def test_private_rules_can_be_left_out(spark, listed):
    hosts = spark.createDataFrame([("a.me.github.io",), ("a.b.c.compute.example.com",), ("q.net",)], "host string")
    got = suffixes.registrable(hosts, suffixes.rules(spark, listed, private=False))
    assert {r["host"]: r["registrable"] for r in got.collect()} == {"a.me.github.io": "github.io", "a.b.c.compute.example.com": "example.com", "q.net": "q.net"}


def test_a_list_that_is_not_there_raises(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        suffixes.rules(spark, str(tmp_path / "none.dat"))


def test_companies_by_a_list(spark, listed):
    rows = [("o", 1, "an@own.co.uk", "x@v.a.compute.example.com"), ("o", 2, "an@own.co.uk", "y@w.b.compute.example.com"), ("o", 3, "an@own.co.uk", "z@sub.own.co.uk")]
    df = spark.createDataFrame([(o, "c", str(s), s, None, m, a, None, False, []) for o, s, m, a in rows], "org_id string, connection_id string, dedup_key string, seq long, received_at timestamp, mailbox string, from_address string, from_name string, is_automated_origin boolean, recipients array<struct<kind string, address string, name string>>")
    seen = graph.sightings(df)
    found = graph.resolve(seen, suffixes.rules(spark, listed))
    assert {(r["name"], r["is_internal"]) for r in found["company"].collect()} == {("v.a.compute.example.com", False), ("w.b.compute.example.com", False), ("own.co.uk", True)}
    assert {r["name"] for r in graph.resolve(seen)["company"].collect()} == {"example.com", "own.co.uk"}
    assert {(r["is_internal"]) for r in found["person"].collect()} == {True, False}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_names_within_one_edit(spark):
    r = random.Random(2)
    names = sorted({"".join(r.choice("abc") for _ in range(r.randint(0, 5))) for _ in range(150)} | {"example.com", "xxample.com", "exmple.com", "eexample.com"})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = sorted(map(tuple, graph.near_names(df.union(df), df).collect()))
    assert got == sorted((a, b) for a in names for b in names if distance(a, b) <= 1)


def test_sketches(spark):
    r = random.Random(4)
    values = [(k, int(10 ** r.uniform(0, 12)) if k == "wide" else r.randrange(40)) for k in ("wide", "narrow") for _ in range(3000)] + [("one", 5), ("wide", None), ("wide", -3), ("none", None)]
    df = spark.createDataFrame(values, "k string, v long")
    whole = sketches.sketch(df, ["k"], "v")
    got = {x["k"]: x for x in sketches.quantiles(whole, ["k"], p1=0.01, p50=0.5, p99=0.99, top=1.0).collect()}
    assert set(got) == {"wide", "narrow", "one"} and got["wide"]["n"] == 3000
    for k in got:
        own = sorted(v for key, v in values if key == k and v is not None and v >= 0)
        for name, q in (("p1", 0.01), ("p50", 0.5), ("p99", 0.99), ("top", 1.0)):
            exact = own[math.ceil(q * len(own)) - 1]
            assert abs(got[k][name] - exact) <= exact / 2**sketches.BITS, (k, name)
    assert got["one"]["p50"] == 5.0
    parts = df.randomSplit([0.3, 0.7], 1)
    both = sketches.together(*(sketches.sketch(p, ["k"], "v") for p in parts), ["k"])
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, whole.collect()))


def test_sketches_are_near_the_exact_percentiles(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    exact = {r["source"]: r for r in docs.groupBy("source").agg(F.percentile("n_chars", F.lit(0.5)).alias("p50"), F.percentile("n_chars", F.lit(0.99)).alias("p99")).collect()}
    got = sketches.quantiles(sketches.sketch(docs, ["source"], "n_chars"), ["source"], p50=0.5, p99=0.99)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3
    for r in got.collect():
        for name in ("p50", "p99"):
            assert abs(r[name] - exact[r["source"]][name]) <= 0.05 * exact[r["source"]][name] + 2


def test_persons_of_users(spark):
    rows = [("o", "auth", True, "u1", 1), ("o", "auth", True, "u1", 1), ("o", "auth", True, "u2", 1), ("o", "auth", True, "u2", 2), ("o", "auth", False, "u3", 3), ("o", "mail", True, "u4", 4), ("p", "auth", True, "u5", 5)]
    df = spark.createDataFrame(rows, "org_id string, source_type string, verified boolean, external_id string, person_id long")
    assert list(map(tuple, access.persons_of(df, "o").collect())) == [("u1", 1)]
    assert access.person_of(df, "o", "u1").first()[0] == 1 and access.person_of(df, "o", "u2").count() == 0 == access.person_of(df, "o", None).count()
