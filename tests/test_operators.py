"""Access, sync and graph on small tables."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import access, graph, sync, tables
from corpusloom.plans import adapters, catalogue


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_visibility(spark):
    m = spark.createDataFrame([("o", 1, "org"), ("o", 2, "restricted"), ("o", 3, "restricted"), ("p", 4, "org")], "org_id string, id long, visibility_scope string")
    g = spark.createDataFrame([("o", 7, "email_message", 2, None), ("o", 7, "email_message", 3, datetime.datetime(2024, 1, 1)), ("p", 7, "email_message", 3, None), ("o", 7, "email_message", 2, None)], "org_id string, person_id long, object_type string, object_id long, revoked_at timestamp")
    see = lambda person, org="o": [r[0] for r in rows(access.visible(access.scoped(m, org), g, person), "id")]
    assert see(7) == [1, 2] and see(8) == [1] and see(None) == [1] and see(7, "p") == [4] and see(7, None) == []
    child = m.withColumnRenamed("id", "email_id").withColumn("id", F.lit(0))
    assert [r[0] for r in rows(access.visible(access.scoped(child, "o"), g, 7, "email_id"), "email_id")] == [1, 2]


def test_grants(spark):
    m = spark.createDataFrame([("o", "m", "A@x", "u")], "org_id string, id string, from_address string, owner_user_id string")
    r = spark.createDataFrame([("o", "m", "to", "<b@x>"), ("o", "m", "cc", "a@x"), ("o", "m", "reply_to", "c@x"), ("o", "m", "to", "d@x"), ("o", "m", "to", "e@x")], "org_id string, email_id string, kind string, address string")
    ids = spark.createDataFrame([("o", "email", "a@x", "pa", True), ("o", "email", "b@x", "pb", True), ("o", "email", "c@x", "pc", True), ("o", "email", "d@x", "pd", False), ("o", "auth", "u", "pb", True)], "org_id string, source_type string, external_id string, person_id string, verified boolean")
    derived = access.derive(m, r, ids)
    assert rows(derived, "person_id", "provenance") == [("pa", "sender"), ("pb", "owner")]
    have = spark.createDataFrame([("o", "m", "pa", None), ("o", "m", "px", None), ("o", "m", "pb", datetime.datetime(2024, 1, 1))], "org_id string, object_id string, person_id string, revoked_at timestamp")
    assert rows(access.reconcile(derived, have), "person_id", "action") == [("pb", "insert"), ("px", "tombstone")]


def test_decisions(spark):
    cases = itertools.product([None, False, True], [None, "deny", "allow"], [None, False, True])
    df = spark.createDataFrame(list(cases), "e boolean, o string, w boolean")
    allowed, _ = access.decide(F.col("e"), F.col("o"), F.col("w"))
    for r in df.select("*", allowed.alias("a")).collect():
        assert r["a"] == bool(r["e"] and (r["o"] == "allow" or (r["o"] is None and r["w"])))
    one = spark.range(1)
    assert one.select(access.low_coverage(F.lit(1), F.lit(2)), access.low_coverage(F.lit(0), F.lit(0)), access.low_coverage(F.lit(1), F.lit(3))).first() == (False, False, True)
    stamp = lambda x: F.lit(x).cast("timestamp")
    assert one.select(access.is_revoked(stamp(None), stamp(None), stamp(None)), access.is_revoked(stamp("2024-01-01"), stamp(None), stamp(None)), access.is_revoked(stamp("2024-01-01"), stamp("2024-01-01"), stamp(None))).first() == (True, False, True)


def test_projection(spark):
    df = spark.createDataFrame([([("to", "a"), ("bcc", "b")], {"Subject": ["s"], "List-Id": ["x"]})], "recipients array<struct<kind:string,address:string>>, headers map<string,array<string>>")
    r = access.for_non_owner(df).first()
    assert [x["kind"] for x in r["recipients"]] == ["to"] and r["headers"] == {"Subject": ["s"]}


def test_promotion(spark):
    m = spark.createDataFrame([("o", "m", "restricted"), ("o", "n", "restricted")], "org_id string, id string, visibility_scope string")
    r = spark.createDataFrame([("o", "m", "restricted"), ("o", "n", "restricted")], "org_id string, email_id string, visibility_scope string")
    p = spark.createDataFrame([], "org_id string, object_type string, object_id string, from_scope string, to_scope string, promoted_at timestamp")
    out = access.promote({"email_message": m, "email_recipient": r, "visibility_promotion": p}, "o", "m", F.current_timestamp())
    assert rows(out["email_message"], "id", "visibility_scope") == [("m", "org"), ("n", "restricted")] == rows(out["email_recipient"], "email_id", "visibility_scope")
    assert out["visibility_promotion"].count() == 1


def test_cursor(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 3, False), ("a", 4, True), ("b", 7, False), ("c", 1, True)], "folder string, uid long, done boolean")
    assert rows(sync.settled_prefix(df, ["folder"]), "folder", "last_seen") == [("a", 2), ("b", 0), ("c", 1)]
    folders = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1)], "folder string, uidvalidity long")
    cursors = spark.createDataFrame([("a", 1, 5, []), ("b", 1, 9, [])], "folder string, uidvalidity long, last_seen_uid long, failed_uids array<long>")
    assert rows(sync.start_uid(folders, cursors), "folder", "start") == [("a", 6), ("b", 1), ("c", 1)]
    listing = spark.createDataFrame([("a", 5), ("a", 6), ("b", 1)], "folder string, uid long")
    assert sync.pending(listing, folders, cursors).count() == 2


def test_byte_batches_equal_the_source_planner(spark):
    from corpusloom.sources.mailbox import batches

    random.seed(3)
    data = [("f", i, random.choice([None, 0, 1, 30, 60, 150])) for i in range(200)]
    got = sync.byte_batches(spark.createDataFrame(data, "folder string, uid long, size long"), ["folder"], 100)
    found: dict = {}
    for _, uid, _, batch in rows(got):
        found.setdefault(batch, []).append(uid)
    assert [sorted(v) for _, v in sorted(found.items())] == batches([(u, s) for _, u, s in data], 100)


def messages(spark, order):
    stamp = lambda d: datetime.datetime(2024, 1, d)
    data = [
        (1, "k1", stamp(5), "me@acme.org", "bob@shop.example", "'Bob'", False, [("to", "me@acme.org", None), ("reply_to", "route@shop.example", None)]),
        (2, "k2", stamp(2), "me@acme.org", "BOB@shop.example", "Bobby", False, [("to", "ann@eu.acme.org", "Ann"), ("cc", "info@shop.example", "Info")]),
        (3, "k2", stamp(1), "me@acme.org", "bob@shop.example", "Copy", False, []),
        (4, "k3", stamp(9), "me@acme.org", "noreply@news.example", "News", True, [("to", "joe@gmail.com", "Joe")]),
        (5, "k4", stamp(3), "me@acme.org", "x@xn--evil.org", None, False, []),
    ]
    random.Random(order).shuffle(data)
    schema = "seq long, dedup_key string, received_at timestamp, mailbox string, from_address string, from_name string, is_automated_origin boolean, recipients array<struct<kind:string,address:string,name:string>>"
    return spark.createDataFrame(data, schema).select(F.lit("o").alias("org_id"), F.lit("c").alias("connection_id"), "*").repartition(1 + order)


def test_resolver(spark):
    results = []
    for order in range(2):
        t = graph.resolve(graph.sightings(messages(spark, order)))
        results.append({k: rows(v) for k, v in t.items()})
    assert results[0] == results[1]
    t = graph.resolve(graph.sightings(messages(spark, 0)))
    people = {r["email"]: r for r in t["person"].join(t["person_email"].withColumnRenamed("person_id", "id"), ["id", "org_id"]).collect()}
    assert set(people) == {"bob@shop.example", "me@acme.org", "ann@eu.acme.org", "joe@gmail.com", "x@xn--evil.org"}
    bob = people["bob@shop.example"]
    assert (bob["display_name"], bob["is_internal"], bob["first_seen_at"].day, bob["last_seen_at"].day) == ("Bob", False, 2, 5)
    assert people["ann@eu.acme.org"]["is_internal"] and not people["joe@gmail.com"]["is_internal"]
    assert rows(t["company"], "name", "is_internal") == [("acme.org", True), ("news.example", False), ("shop.example", False)]
    assert {r[0] for r in rows(t["person_alias"], "alias")} == {"Bob", "Bobby", "Ann", "Joe"}
    assert rows(t["company_domain"], "domain") == [("acme.org",), ("eu.acme.org",), ("news.example",), ("shop.example",)]


def test_writes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "k long, v string")
    assert rows(tables.insert_missing(t, new, ["k"])) == [(3, "d")]
    assert rows(tables.upsert(t, new.dropDuplicates(), ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(tables.optional_filter(t, k=None, v="b")) == [(2, "b")]
    assert tables.every_nth(spark.range(10), [F.col("id")], 3).count() == 4
    held = {"a": spark.createDataFrame([("o", "1"), ("p", "1")], "org_id string, id string"), "b": spark.createDataFrame([("o", "1"), ("p", "1")], "org_id string, parent string")}
    out = tables.delete_cascade(held, "a", F.col("org_id") == "o", {"b": "parent"})
    assert rows(out["a"]) == [("p", "1")] == rows(out["b"])


def folds(rows, budget):
    """Batches of (folder, uid, size) by a fold in order."""
    out, state = [], {}
    for folder, uid, size in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        cost = budget if size is None else size
        batch, total = state.get(folder, (0, 0))
        batch, total = (batch, total + cost) if total + cost <= budget or total == 0 else (batch + 1, cost)
        state[folder] = batch, total
        out.append((folder, uid, size, batch))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 3, 40, None])
def test_batches_of_folders_in_blocks(spark, parts):
    r = random.Random(7)
    size = lambda: r.choice([None, 0, 0, 1, 5, 30, 100, 101, 250, r.randrange(60)])
    rows = [(r.choice([1, 1, 1, 1, 2, None]), uid, size()) for uid in range(900)]
    rows += [(7, uid, 0) for uid in range(60)] + [(8, uid, 1) for uid in range(90)] + [(9, 1, 500)]
    df = spark.createDataFrame(rows, "folder long, uid long, size long").repartition(5)
    got = sync.byte_batches(df, ["folder"], 100, parts=parts)
    assert sorted(map(tuple, got.collect()), key=repr) == folds(rows, 100)


def test_a_large_folder_is_many_tasks(spark):
    df = spark.range(20_000).select(F.lit(1).alias("folder"), F.col("id").alias("uid"), (F.col("id") % 50).alias("size"))
    rows = [(1, i, i % 50) for i in range(20_000)]
    got = sync.byte_batches(df, ["folder"], 100, parts=16)
    assert sorted(map(tuple, got.collect()), key=repr) == folds(rows, 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small as they are, they would be put together
    try:
        in_task = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert in_task < 20_000 / 2


def test_ranges_go_on_over_the_edges_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(sync, "BLOCK_BITS", 2, raising=False)
    held = {"a": [-9, -8, -7, -1, 0, 1, 3, 4, 7, 8, *range(12, 29), 31, 33, 1 << 40], "b": [4], "c": [3, 5], None: [7, 8, 9], "d": [*range(-6, 40)], "e": [None, 0, 1 << 62, (1 << 63) - 1]}
    want = []
    for folder, uids in held.items():
        for uid in uids:
            if uid is None:
                want.append([folder, None, None, 1])
            elif want and want[-1][0] == folder and want[-1][2] == uid - 1:
                want[-1][2:] = [uid, want[-1][3] + 1]
            else:
                want.append([folder, uid, uid, 1])
    df = spark.createDataFrame([(f, u) for f, uids in held.items() for u in uids for _ in range(2)], "folder string, uid long")
    for parts in (None, 1, 5):
        got = sync.uid_ranges(df, ["folder"], **({"parts": parts} if parts else {}))
        assert got.columns == ["folder", "first", "last", "n"] and sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want), key=repr)


def test_ranges_of_one_folder_are_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sync, "BLOCK_BITS", 6, raising=False)
    monkeypatch.setattr(adapters, "GROUPED_ROWS", 1000, raising=False)
    spark.range(10_000).selectExpr("50L as l_suppkey", "2 * id as l_orderkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = catalogue.QUERIES["uid_ranges"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in found) == 10_000 and len(found) >= 10 and max(r["count"] for r in found) < 2000
