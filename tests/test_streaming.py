"""Mailbox streams into tables, and the limiter."""

import time

from pyspark.sql import functions as F

from corpusloom.sources import mailbox
from corpusloom.streaming import ingest, limiter

from .test_sources import mail


def put(root, folder, uid, data):
    (root / folder).mkdir(parents=True, exist_ok=True)
    (root / folder / f"{uid}.eml").write_bytes(data)


def test_mailbox_stream_is_resumable_and_idempotent(spark, tmp_path):
    box, root, marks = tmp_path / "box", str(tmp_path / "store"), str(tmp_path / "marks")
    put(box, "INBOX", 1, mail("one", ident="<1@x>"))
    put(box, "INBOX", 2, mail("two", ident="<2@x>", files=(("a.bin", b"1"),)))
    put(box, "Sent", 1, mail("one", ident="<1@x>", bcc="z@x"))  # a copy of the first
    put(box, "Trash", 1, mail("no", ident="<3@x>"))
    mailbox.register(spark)
    assert spark.read.format("mailbox").option("root", str(box)).load().count() == 3

    def run():
        stream = spark.readStream.format("mailbox").option("root", str(box)).option("maxbytes", "600").load()
        raw = stream.select(F.lit("o").alias("org_id"), F.lit("c").alias("connection_id"), F.lit("an@x").alias("mailbox"), "folder", "uidvalidity", "uid", (F.col("uid") * 10 + F.when(F.col("folder") == "Sent", 1).otherwise(0)).alias("seq"), "raw", F.coalesce("internal_date", F.lit("2024-01-01").cast("timestamp")).alias("internal_date"))
        q = ingest.start(spark, raw, root, marks).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    run()
    t = ingest.store(spark, root)
    assert sorted(r[0] for r in t["email_message"].read().select("message_id").collect()) == ["1@x", "2@x"]
    put(box, "INBOX", 3, mail("three", ident="<4@x>"))
    put(box, "INBOX", 4, mail("two", ident="<2@x>", files=(("a.bin", b"1"),)))
    run()
    assert sorted(r[0] for r in t["email_message"].read().select("message_id").collect()) == ["1@x", "2@x", "4@x"]
    assert t["email_attachment"].read().count() == 1
    again = spark.createDataFrame([("o", "c", "an@x", "INBOX", 1, 9, 90, bytearray(mail("one", ident="<1@x>")), None)], ingest.schemas.RAW_MESSAGE)
    assert ingest.ingest_batch(t, again) == {"seen": 1, "stored": 0, "skipped": 1, "failed": 0}


def test_cursor_stands_before_the_first_failure(spark, tmp_path, monkeypatch):
    from corpusloom.sources import messages

    t = ingest.store(spark, str(tmp_path / "store"))

    def batch(folder, generation, uids):
        rows = [("o", "c", "an@x", folder, generation, u, u, bytearray(mail(f"text {u}", ident=f"<{u}@x>") if u not in bad else b"broken"), None) for u in uids]
        return ingest.ingest_batch(t, spark.createDataFrame(rows, ingest.schemas.RAW_MESSAGE))

    def at(folder="INBOX"):
        r = t["sync_cursor"].read().where(F.col("folder") == folder).first()
        return r["uidvalidity"], r["last_seen_uid"], r["failed_uids"]

    real = messages.parse
    # what can't be parsed, as the parser would say
    failing = lambda raw, *more: F.when(raw == F.lit(b"broken"), real(raw, *more).withField("parse_status", F.lit("failed"))).otherwise(real(raw, *more))
    monkeypatch.setattr(messages, "parse", failing)
    bad = {4, 6}
    batch("INBOX", 1, [1, 2, 3])
    assert at() == (1, 3, [])
    assert batch("INBOX", 1, [4, 5, 6, 7])["failed"] == 2 and at() == (1, 3, [4, 6])
    assert batch("INBOX", 1, [4, 5, 6, 7, 8])["stored"] == 1 and at() == (1, 3, [4, 6])
    batch("Sent", 9, [1])
    assert at("Sent") == (9, 1, []) and at() == (1, 3, [4, 6])
    monkeypatch.setattr(messages, "parse", real)
    assert ingest.settle(t)["failed"] == 0 and at() == (1, 6, []) and t["sync_failure"].read().count() == 0
    bad = set()
    batch("INBOX", 1, [9])
    batch("INBOX", 2, [1, 2])
    assert at() == (2, 2, [])


def test_audit_log(spark, tmp_path):
    from corpusloom.sources import audit, snapshots

    log = audit.AuditLog(snapshots.Table(spark, str(tmp_path / "log"), ingest.schemas.AUDIT_LOG))
    row = lambda a, **more: spark.createDataFrame([(a, "u")], "action string, actor_id string").withColumns({k: F.lit(v) for k, v in more.items()})
    with log.unit() as record:
        record(row("one"))
        record(row("two", org_id="o"))
        assert log.table.read().count() == 0
    log.record_independently(row("one"))  # once more
    assert sorted(r["action"] for r in log.table.read().collect()) == ["one", "two"]
    try:
        with log.unit() as record:
            record(row("lost"))
            log.record_independently(row("denied"))
            raise KeyError
    except KeyError:
        pass
    assert sorted(r["action"] for r in log.table.read().collect()) == ["denied", "one", "two"]


def test_functions_of_sql(spark):
    from corpusloom import schemas
    from corpusloom.functions import registry

    registry.register(spark)
    assert spark.sql("SELECT html_to_text('<p>a</p>') AS x, redact_secrets('none').count AS n, decode_chain(CAST('é' AS BINARY), 'utf-8') AS d").first() == ("a", 0, "é")
    grid = {"format": "xlsx", "truncated": False, "sheets": [{"name": "S", "dims": None, "cells": [{"ref": "B12", "t": "n", "v": "2.5", "nf": None}, {"ref": "C12", "t": "s", "v": "x", "nf": None}]}]}
    spark.createDataFrame([(1, grid), (2, None)], schemas.struct(id=schemas.L, grid=schemas.GRID)).createOrReplaceTempView("grids")
    rows = spark.sql("SELECT id, c.col, c.row, c.number FROM grids, LATERAL grid_cells(grids.grid) c").collect()
    assert sorted(map(tuple, rows), key=str) == [(1, "B", 12, 2.5), (1, "C", 12, None)]
    assert spark.sql("SELECT parse_message(CAST('Subject: s\n\nx' AS BINARY), 'a@x', CAST(NULL AS TIMESTAMP)).subject AS s").first()["s"] == "s"


class Server:
    """Answers of a mail server."""

    def __init__(self):
        self.box, self.asked = {"INBOX": (7, {1: b"first", 3: b"third"}), 'A "b"': (1, {2: b"x"}), "Zero": (0, {})}, []

    def list(self):
        return "OK", [b'(\\HasNoChildren) "/" INBOX', (b'(\\X) "/" {5}', b'A "b"'), b'(\\Noselect) "/" top', b'(\\Junk) "/" Werbung', b'() "." "Trash"', b'() NIL Zero', b"nonsense", None]

    def select(self, name, readonly):
        assert readonly
        self.now = self.box.get(name.decode("latin-1")[1:-1].replace('\\"', '"'))
        return ("OK" if self.now else "NO"), [b"1"]

    def response(self, what):
        return what, [str(self.now[0]).encode()]

    def uid(self, verb, *more):
        if verb == "SEARCH":
            return "OK", [" ".join(map(str, self.now[1])).encode()]
        self.asked.append(more)
        uids = [u for part in more[0].split(",") for a, _, b in [part.partition(":")] for u in range(int(a), int(b or a) + 1) if u in self.now[1]]
        if "SIZE" in more[1]:
            return "OK", [f"1 (RFC822.SIZE {len(self.now[1][u])} UID {u})".encode() for u in uids]
        return "OK", [x for u in uids for x in ((f'1 (UID {u} INTERNALDATE "17-Jul-2024 02:44:25 -0700" BODY[] {{9}}'.encode(), self.now[1][u]), b")")]


def test_mailbox_on_a_server():
    import datetime

    t = mailbox.ImapTransport({}, lambda _: Server())
    assert [(n, g) for n, g, _ in t.folders()] == [("INBOX", 7), ('A "b"', 1)]
    least = lambda n: mailbox.Wanted(least=n)
    assert t.uids("INBOX", least(2)) == [3] and t.uids("INBOX", least(9)) == [] == t.uids("none", least(1))
    assert t.sizes("INBOX", [1, 3, 5]) == {1: 5, 3: 5}
    stamp = datetime.datetime(2024, 7, 17, 9, 44, 25, tzinfo=datetime.UTC)
    assert list(t.fetch("INBOX", [1, 2, 3])) == [(1, b"first", stamp), (3, b"third", stamp)] and t.client.asked[-1][0] == "1:3"
    assert list(t.fetch('A "b"', [2])) == [(2, b"x", stamp)] and mailbox.received_at(b'INTERNALDATE "no date"') is None


def test_generation_reset():
    reader = mailbox.StreamReader({})
    assert reader._after({"a": [1, 5]}, "a", 1) == 6 and reader._after({"a": [1, 5]}, "a", 2) == 1 and reader._after({}, "a", 1) == 1


def test_lockout():
    state, out = ([], 0.0), []
    for at in (0, 1, 2, 3, 4, 5, 6, 70, 71):
        state, ok, wait = limiter.decide(state, float(at), 5, 60.0, 60.0, 900.0)
        out.append((ok, wait))
    assert [o[0] for o in out] == [True] * 5 + [False, False, True, True]
    assert out[5][1] == 60.0 and out[6][1] == 59.0


def test_limiter_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("k", float(i)) for i in range(7)] + [("j", 1.0)], "key string, ts double").coalesce(1).write.parquet(str(src))
    out = limiter.limited(spark.readStream.schema("key string, ts double").parquet(str(src)))
    q = out.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        # with timeouts, empty batches go on for ever: the rows tell when the input is through
        until = time.time() + 60
        while time.time() < until and spark.table("limited").count() < 8:
            time.sleep(0.5)
    finally:
        q.stop()
    got = {(r["key"], r["ts"]): r["allowed"] for r in spark.table("limited").collect()}
    assert [got["k", float(i)] for i in range(7)] == [True] * 5 + [False] * 2 and got["j", 1.0]


def states(query):
    """Rows of state after the last batch, None if there was none yet."""
    progress = query.lastProgress
    return progress["stateOperators"][0]["numRowsTotal"] if progress and progress["stateOperators"] else None


def waited(condition, seconds=90):
    until = time.time() + seconds
    while time.time() < until and not condition():
        time.sleep(0.3)
    return condition()


def test_state_of_the_limiter_goes_after_its_time(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(k, float(i)) for k in "abc" for i in range(3)], "key string, ts double").coalesce(1).write.parquet(str(src))
    out = limiter.limited(spark.readStream.schema("key string, ts double").parquet(str(src)), ttl=4.0)
    q = out.writeStream.format("memory").queryName("going").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        assert waited(lambda: spark.table("going").count() == 9)
        assert waited(lambda: states(q) == 0)
    finally:
        q.stop()
    assert {r["allowed"] for r in spark.table("going").collect()} == {True}


def test_cutoffs_run_out(spark, tmp_path):
    from corpusloom.operators import lifecycle

    src, now, ttl = tmp_path / "in", time.time(), 30.0
    rows = [("a", now), ("a", now - 3), ("b", now - 29), ("b", now - 20), ("c", now - 31), ("d", now - 15)]
    spark.createDataFrame(rows, "subject string, cutoff double").coalesce(1).write.parquet(str(src))
    out = limiter.cutoffs(spark.readStream.schema("subject string, cutoff double").parquet(str(src)), ttl)
    q = out.writeStream.format("memory").queryName("cut").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    held = spark.createDataFrame(rows, "subject string, cutoff double").withColumn("cutoff", F.timestamp_micros((F.col("cutoff") * 1_000_000).cast("long")))
    live = lambda at: {r["subject"] for r in lifecycle.unexpired(held, F.timestamp_micros(F.lit(int(at * 1_000_000))), int(ttl)).collect()}
    ended = lambda: {r["subject"] for r in spark.table("cut").where("not live").collect()}
    try:
        assert waited(lambda: spark.table("cut").count() > 0)
        shown = {r["subject"]: r["cutoff"] for r in spark.table("cut").where("live").collect()}
        assert shown == {k: v for k, v in {"a": now, "b": now - 20, "d": now - 15}.items() if k in shown} and "a" in shown and "c" not in shown
        assert waited(lambda: ended() == set(shown) and states(q) == 0)
        assert live(time.time()) == set()
    finally:
        q.stop()
    ends = [(r["subject"], r["cutoff"]) for r in spark.table("cut").where("not live").collect()]
    assert sorted(ends) == sorted(shown.items())
