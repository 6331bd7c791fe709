"""Conditional writes on connections, runs, consents and tokens."""

import datetime

from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.operators import access, lifecycle, tables

NOW = datetime.datetime(2024, 1, 1, 12)
BEFORE = lambda s: NOW - datetime.timedelta(seconds=s)
CONNECTION = "id string, org_id string, owner_user_id string, sync_run_id string, sync_status string, heartbeat_at timestamp, disabled_at timestamp, synced long, total long, created_at timestamp"


def now():
    return F.lit(NOW)


def connections(spark):
    rows = [("free", None, None), ("held", "r0", BEFORE(10)), ("stale", "r1", BEFORE(301)), ("edge", "r2", BEFORE(300)), ("silent", "r3", None)]
    rows = [(i, "o", None, run, "running" if run else "idle", at, None, 5, 9, NOW) for i, run, at in rows] + [("off", "o", "u", None, "idle", None, NOW, 5, 9, NOW)]
    return spark.createDataFrame(rows, CONNECTION)


def test_claims(spark):
    c = connections(spark)
    wanted = spark.createDataFrame([(i, r) for i in ("free", "held", "stale", "edge", "silent", "off", "gone") for r in ("x", "y")] + [(None, "x"), ("free", None), ("held", "r0")], "id string, run_id string")
    after = lifecycle.claim(c, wanted, now())
    assert after.columns == c.columns and after.count() == 6
    assert {r["id"]: r["sync_run_id"] for r in after.collect()} == {"free": "x", "held": "r0", "stale": "x", "edge": "r2", "silent": "x", "off": None}
    assert {(r["synced"], r["total"], r["heartbeat_at"]) for r in after.where("sync_run_id = 'x'").collect()} == {(0, None, NOW)}
    assert after.where("id = 'held'").first()["heartbeat_at"] == BEFORE(10)
    told = {(r["id"], r["run_id"]) for r in lifecycle.won(after, wanted).where("won").collect()}
    assert told == {("free", "x"), ("stale", "x"), ("silent", "x"), ("held", "r0")}
    assert lifecycle.claim(c.limit(0), wanted, now()).count() == 0 == lifecycle.won(after, wanted.limit(0)).count()


def test_fences(spark):
    c = connections(spark)
    updates = spark.createDataFrame([("held", "r0", 7, None), ("stale", "other", 7, NOW), ("free", "x", 7, NOW)], "id string, run_id string, synced long, heartbeat_at timestamp")
    after = {r["id"]: (r["synced"], r["heartbeat_at"]) for r in lifecycle.fenced(c, updates).collect()}
    assert after["held"] == (7, BEFORE(10)) and after["stale"] == (5, BEFORE(301)) and after["free"] == (5, None)
    done = lifecycle.finish(c, "r0", "succeeded").where("id = 'held'").first()
    assert (done["sync_run_id"], done["sync_status"], done["heartbeat_at"]) == (None, "succeeded", None)
    off = lifecycle.switched(lifecycle.switched(c, "free", False, now()), "free", False, F.lit(BEFORE(1)))
    assert off.where("id = 'free'").first()["disabled_at"] == NOW and lifecycle.switched(off, "off", True, now()).where("id = 'off'").first()["disabled_at"] is None
    assert [r["id"] for r in lifecycle.owned_connections(c, "u").collect()] == ["off"] and lifecycle.owned_connections(c, None).count() == 0 and lifecycle.shared_connections(c).count() == 5


def test_runs_and_consents(spark):
    runs = spark.createDataFrame([("1", "c", "running", BEFORE(9), None), ("2", "c", "succeeded", BEFORE(9), NOW), ("3", "d", "running", BEFORE(9), None)], "id string, connection_id string, status string, started_at timestamp, finished_at timestamp")
    opened = lifecycle.open_runs(runs, spark.createDataFrame([("4", "c", NOW)], "id string, connection_id string, started_at timestamp"))
    assert {(r["id"], r["status"], r["finished_at"]) for r in opened.collect()} == {("1", "abandoned", NOW), ("2", "succeeded", NOW), ("3", "running", None), ("4", "running", None)}
    ended = lifecycle.finalize_runs(opened, spark.createDataFrame([(i, "failed", NOW) for i in "124"], "id string, outcome string, at timestamp"))
    assert {r["id"]: r["status"] for r in ended.collect()} == {"1": "abandoned", "2": "succeeded", "3": "running", "4": "failed"}
    consents = spark.createDataFrame([(1, "u", BEFORE(9), None), (2, "u", BEFORE(9), None), (3, "u", NOW, NOW), (4, "v", NOW, NOW)], "id long, user_id string, granted_at timestamp, withdrawn_at timestamp")
    assert [r["id"] for r in lifecycle.active_consent(consents, ["user_id"]).collect()] == [2]
    assert lifecycle.withdraw(consents, F.col("user_id") == "u", F.lit(BEFORE(1))).where("withdrawn_at is null").count() == 0


def test_tokens(spark):
    tokens = spark.createDataFrame([("a", None), ("b", NOW)], "token_hash string, revoked_at timestamp")
    uses = spark.createDataFrame([("a", 2, NOW), ("a", 1, NOW), ("a", 3, BEFORE(-5)), ("b", 4, NOW), ("c", 5, NOW)], "token_hash string, use_id long, at timestamp")
    assert [r["use_id"] for r in lifecycle.consume(tokens, uses).where("accepted").collect()] == [1]
    cutoffs = spark.createDataFrame([(1, BEFORE(59)), (2, BEFORE(60)), (3, None)], "id long, cutoff timestamp")
    assert [r["id"] for r in lifecycle.unexpired(cutoffs, now(), 60).collect()] == [1]


def test_promotion_by_its_owner_alone(spark):
    t = {
        "email_message": spark.createDataFrame([("o", "m", "c", "restricted"), ("o", "n", "d", "restricted")], "org_id string, id string, connection_id string, visibility_scope string"),
        "email_recipient": spark.createDataFrame([("o", "m", "restricted")], "org_id string, email_id string, visibility_scope string"),
        "connector_connection": spark.createDataFrame([("o", "c", "u"), ("o", "d", None)], "org_id string, id string, owner_user_id string"),
        "visibility_promotion": spark.createDataFrame([], "org_id string, object_type string, object_id string, from_scope string, to_scope string, promoted_at timestamp"),
        "audit_log": spark.createDataFrame([], schemas.AUDIT_LOG),
    }
    for user, message, done in (("u", "m", 1), ("u", "n", 0), ("v", "m", 0), ("u", "none", 0)):
        after = access.promote_as(t, "o", user, message, now())
        assert [after[n].count() for n in ("visibility_promotion", "audit_log")] == [done, done]
        assert after["email_message"].where("visibility_scope = 'org'").count() == done == after["email_recipient"].where("visibility_scope = 'org'").count()
    who = spark.createDataFrame([("o", "p", "auth", "u", True), ("o", "q", "auth", "w", True), ("o", "r", "auth", "w", True), ("o", "s", "auth", "x", False)], "org_id string, person_id string, source_type string, external_id string, verified boolean")
    assert [[r["person_id"] for r in access.person_of(who, "o", u).collect()] for u in ("u", "w", "x", None)] == [["p"], [], [], []]


def test_every_nth_and_updates(spark):
    df = spark.range(0, 1003, 1, 7).select((F.col("id") * 37 % 1003).alias("k"))
    for n, limit in ((1, None), (7, None), (7, 40), (2000, None)):
        want = list(range(0, 1003, n))[:limit]
        assert sorted(r["k"] for r in tables.every_nth(df, [F.col("k")], n, limit).collect()) == want
    assert tables.every_nth(df.limit(0), [F.col("k")], 3).count() == 0
    held = spark.createDataFrame([(1, None), (2, "b"), (None, None)], "k long, v string")
    new = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (None, "n")], "k long, v string")
    assert sorted(tables.update_from(held, new, ["k"]).collect(), key=str) == sorted([(1, "x"), (2, "b"), (None, "n")], key=str)
    assert {r["v"] for r in tables.update_from(held, new, ["k"], False).collect()} == {"x", "y", "n"}
    assert sorted((r["k"], r["created"]) for r in tables.get_or_create(held.where("k is not null"), new.where("k is not null").union(new), ["k"]).where("k is not null").collect()) == [(1, False), (2, False), (3, True)]
