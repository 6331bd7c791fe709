"""Filters that reach the mailbox, transactions over tables, the landing sink, and runs that lose their connection."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.sources import landing, mailbox, snapshots
from corpusloom.streaming import ingest

from .test_sources import mail
from .test_streaming import Server, put


@pytest.fixture
def box(spark, tmp_path):
    for folder, uids in (("INBOX", range(1, 21)), ("Sent", range(1, 11)), ("Sent.old", range(5, 8))):
        for uid in uids:
            put(tmp_path / "box", folder, uid, mail(f"{folder} {uid}", ident=f"<{folder}-{uid}@x>"))
    (tmp_path / "box" / "Sent" / ".uidvalidity").write_text("9")
    mailbox.register(spark)
    return spark.read.format("mailbox").option("root", str(tmp_path / "box"))


@pytest.mark.parametrize(
    ("where", "n"),
    [
        ("true", 33), ("folder = 'INBOX'", 20), ("folder IN ('Sent', 'Sent.old')", 13), ("folder LIKE 'Sent%'", 13), ("folder LIKE 'Sent.%'", 3), ("uidvalidity = 9", 10), ("uid > 18", 2), ("uid >= 5 AND uid < 8", 9),
        ("folder = 'INBOX' AND uid IN (1, 3, 99)", 2), ("uid > 5 AND uid < 3", 0), ("folder = 'none'", 0), ("folder = 'INBOX' AND folder = 'Sent'", 0), ("uid <= 2 OR folder = 'Sent'", 12), ("internal_date > '2024-01-01'", 0), ("uid % 2 = 0 AND folder <=> 'INBOX'", 10), ("folder <> 'INBOX'", 13),
    ],
)
def test_filtered_rows_are_right(box, where, n):
    assert box.load().where(where).count() == n


def test_filters_are_in_the_plan(spark, box):
    df = box.load().where("folder = 'INBOX' AND uid >= 18 AND length(raw) > 3")
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "EqualTo(folder,INBOX), GreaterThanOrEqual(uid,18)]" in plan
    assert plan.split("Condition : ")[1].split("\n")[0] == "(isnotnull(raw#{0}) AND (length(raw#{0}) > 3))".format(plan.split("isnotnull(raw#")[1].split(")")[0])


class Counting(mailbox.MaildirTransport):
    """Notes what was asked of it, in a file that all workers share."""

    def __init__(self, options):
        super().__init__(options)
        self.notes = options["notes"]

    def _note(self, what, *more):
        with open(self.notes, "a") as f:
            f.write(f"{what} {' '.join(map(str, more))}\n")

    def uids(self, folder, wanted=mailbox.ALL):
        self._note("list", folder)
        return super().uids(folder, wanted)

    def sizes(self, folder, uids):
        self._note("size", *uids)
        return super().sizes(folder, uids)

    def fetch(self, folder, uids):
        self._note("fetch", *uids)
        return super().fetch(folder, uids)


def test_what_filters_exclude_is_never_asked_for(tmp_path, box):
    notes = tmp_path / "notes"
    options = {"root": str(tmp_path / "box"), "notes": str(notes)}
    reader = mailbox.BatchReader(options)
    reader.transport = lambda: Counting(options)
    left = [mailbox.EqualTo(("raw",), b"x"), mailbox.GreaterThan(("internal_date",), datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC))]
    assert reader.pushFilters([mailbox.EqualTo(("folder",), "Sent"), left[0], mailbox.In(("uid",), (2, 4, 77)), left[1], mailbox.IsNotNull(("uid",))]) == left
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [(r[0], r[1], r[2]) for r in rows] == [("Sent", 9, 2), ("Sent", 9, 4)]
    assert notes.read_text().split("\n") == ["list Sent", "size 2 4", "fetch 2 4", ""]


def test_dates_go_to_the_server():
    server = Server()
    asked, plain = [], server.uid
    server.uid = lambda verb, *more: asked.append((verb, *more)) or plain(verb, *more)
    transport = mailbox.ImapTransport({}, lambda _: server)
    wanted = mailbox.Wanted()
    day = datetime.datetime(2024, 3, 1, 12, tzinfo=datetime.UTC)
    assert not wanted.take(mailbox.GreaterThanOrEqual(("internal_date",), day)) and not wanted.take(mailbox.LessThan(("internal_date",), day))
    assert wanted.take(mailbox.LessThanOrEqual(("uid",), 2)) and wanted.take(mailbox.EqualTo(("folder",), "INBOX"))
    assert [f[0] for f in transport.folders(wanted)] == ["INBOX"]
    assert transport.uids("INBOX", wanted) == [1]
    assert asked == [("SEARCH", "UID", "1:2", "SINCE", "29-Feb-2024", "BEFORE", "3-Mar-2024")]


NUMBERS = schemas.struct(a=schemas.L)


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], NUMBERS)


def values(view):
    return sorted(r["a"] for r in view.read().collect())


def test_transactions(spark, tmp_path):
    db = snapshots.Database(spark, str(tmp_path / "db"), {"x": NUMBERS, "y": NUMBERS, "z": NUMBERS})
    with db.transaction() as t:
        t["x"].append(numbers(spark, 1))
        t["y"].replace(numbers(spark, 10))
        assert values(t["x"]) == [1] and values(db["x"]) == []
    held = db["x"].read()
    with pytest.raises(KeyError), db.transaction() as t:
        t["x"].append(numbers(spark, 2))
        t["y"].replace(numbers(spark))
        raise KeyError
    assert (values(db["x"]), values(db["y"])) == ([1], [10])
    # two at once: appends to what neither has read go together
    one, two = snapshots.Transaction(db), snapshots.Transaction(db)
    one["x"].append(numbers(spark, 3))
    two["x"].append(numbers(spark, 4))
    two["z"].append(numbers(spark, 5))
    assert (one.commit(), two.commit()) == (2, 3)
    assert (values(db["x"]), values(db["z"]), held.count()) == ([1, 3, 4], [5], 1)
    # what was read has changed
    one, two = snapshots.Transaction(db), snapshots.Transaction(db)
    assert values(one["x"]) == [1, 3, 4]
    one["y"].append(numbers(spark, 11))
    two["x"].append(numbers(spark, 6))
    two.commit()
    with pytest.raises(snapshots.Conflict):
        one.commit()
    assert values(db["y"]) == [10]
    # a version whose writer stopped within it never was
    (tmp_path / "db" / "_versions" / "5").write_text('{"x": ["x/da')
    assert values(db["x"]) == [1, 3, 4, 6]
    db["x"].append(numbers(spark, 7))
    assert values(db["x"]) == [1, 3, 4, 6, 7]


RAW = "org_id string, connection_id string, folder string, uidvalidity long, uid long, text string"


def test_landing(spark, tmp_path):
    landing.register(spark)
    src, path = tmp_path / "in", str(tmp_path / "landing")
    src.mkdir()

    def add(*rows):
        spark.createDataFrame([("o", "c", *r) for r in rows], RAW).repartition(3).write.mode("append").parquet(str(src))

    def run(stop=None):
        stream = spark.readStream.schema(RAW).parquet(str(src))
        rows = stream if stop is None else stream.withColumn("text", F.when(F.col("uid") == stop, F.raise_error(F.lit("killed"))).otherwise(F.col("text")))
        q = rows.writeStream.format("landing").option("path", path).option("checkpointLocation", str(tmp_path / "marks")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    there = lambda: sorted((r["folder"], r["uid"]) for r in landing.landed(spark, path, RAW).collect())
    at = lambda: sorted((r["folder"], r["uidvalidity"], r["last_seen_uid"]) for r in landing.cursors(spark, path).collect())
    assert there() == at() == []
    add(("INBOX", 1, 1, "a"), ("INBOX", 1, 2, "b"), ("Sent", 4, 1, "c"))
    run()
    assert there() == [("INBOX", 1), ("INBOX", 2), ("Sent", 1)] and at() == [("INBOX", 1, 2), ("Sent", 4, 1)]
    add(("INBOX", 1, 3, "d"), ("Sent", 4, 2, "e"))
    with pytest.raises(Exception, match="killed"):
        run(stop=3)
    assert len(there()) == 3 and at() == [("INBOX", 1, 2), ("Sent", 4, 1)]
    run()
    assert len(there()) == 5 and at() == [("INBOX", 1, 3), ("Sent", 4, 2)]
    add(("INBOX", 2, 1, "f"))
    run()
    assert at() == [("INBOX", 2, 1), ("Sent", 4, 2)]
    last = max(landing.batches(path))
    assert [(r["folder"], r["uid"]) for r in landing.landed(spark, path, RAW, last - 1).collect()] == [("INBOX", 1)]
    # a batch that comes again under its number changes nothing and leaves no file
    writer, files = landing.LandingWriter(path), len(list((tmp_path / "landing" / "data").iterdir()))
    again = writer.write(iter(spark.createDataFrame([("o", "c", "INBOX", 2, 9, "x")], RAW).toArrow().to_batches()))
    writer.commit([again, None], last)
    assert at() == [("INBOX", 2, 1), ("Sent", 4, 2)] and len(list((tmp_path / "landing" / "data").iterdir())) == files


def test_landing_needs_its_columns(spark, tmp_path):
    landing.register(spark)
    spark.range(3).select(F.col("id").alias("uid")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("uid long").parquet(str(tmp_path / "in"))
    q = stream.writeStream.format("landing").option("path", str(tmp_path / "x")).option("checkpointLocation", str(tmp_path / "m"))
    with pytest.raises(Exception, match="connection_id"):
        s = q.start()
        s.processAllAvailable()


def raw(spark, *uids):
    rows = [("o", "c", "an@x", "INBOX", 1, u, u, bytearray(mail(f"text {u}", ident=f"<{u}@x>")), None) for u in uids]
    return spark.createDataFrame(rows, schemas.RAW_MESSAGE)


def connections(spark, run=None, disabled=None, beat=None):
    return spark.createDataFrame([("c", "o", run, "running" if run else "idle", beat, disabled, 0, None, None)], ingest.CONNECTION)


def idents(tables):
    return sorted(r[0] for r in tables["email_message"].read().select("message_id").collect())


def test_a_killed_batch_leaves_nothing(spark, tmp_path, monkeypatch):
    tables = ingest.store(spark, str(tmp_path / "store"))
    ingest.ingest_batch(tables, raw(spark, 1))
    monkeypatch.setattr(ingest, "advanced", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ingest.ingest_batch(tables, raw(spark, 2))
    assert idents(tables) == ["1@x"] and tables["email_recipient"].read().select("email_id").distinct().count() <= 1
    assert tables["sync_cursor"].read().first()["last_seen_uid"] == 1


def test_a_superseded_run_writes_nothing_more(spark, tmp_path):
    tables = ingest.store(spark, str(tmp_path / "store"))
    tables["connection"].replace(connections(spark))
    now = lambda t: F.lit(t).cast("timestamp")
    ask = lambda run: spark.createDataFrame([("c", run)], "id string, run_id string")
    assert ingest.claim(tables, ask("one"), now("2024-01-01 10:00:00")) == ["one"]
    assert ingest.ingest_batch(tables, raw(spark, 1), ("c", "one"))["stored"] == 1
    beat = tables["connection"].read().first()
    assert beat["synced"] == 1 and beat["heartbeat_at"] > datetime.datetime(2024, 6, 1)
    assert ingest.claim(tables, ask("two")) == []  # the first one was heard of just now
    tables["connection"].replace(connections(spark, "one", beat=datetime.datetime(2024, 1, 1)))
    assert ingest.claim(tables, ask("two")) == ["two"]
    with pytest.raises(ingest.Superseded):
        ingest.ingest_batch(tables, raw(spark, 2), ("c", "one"))
    assert ingest.ingest_batch(tables, raw(spark, 2, 3), ("c", "two"))["stored"] == 2
    tables["connection"].replace(connections(spark, "two", datetime.datetime(2024, 1, 1)))
    with pytest.raises(ingest.Superseded):
        ingest.ingest_batch(tables, raw(spark, 4), ("c", "two"))
    assert idents(tables) == ["1@x", "2@x", "3@x"]


def test_a_claim_within_a_batch_wins(spark, tmp_path, monkeypatch):
    """The other run claims after the fence was read and before the batch is published."""
    tables = ingest.store(spark, str(tmp_path / "store"))
    tables["connection"].replace(connections(spark, "one"))
    plain, done = ingest._taken_in, []

    def slow(unit, rows):
        found = plain(unit, rows)
        if not done:
            done.append(tables["connection"].replace(connections(spark, "two")))
        return found

    monkeypatch.setattr(ingest, "_taken_in", slow)
    with pytest.raises(ingest.Superseded):
        ingest.ingest_batch(tables, raw(spark, 1), ("c", "one"))
    assert idents(tables) == [] and tables["connection"].read().first()["sync_run_id"] == "two"


def test_two_streams_over_one_connection(spark, tmp_path):
    box, root = tmp_path / "box", str(tmp_path / "store")
    mailbox.register(spark)
    tables = ingest.store(spark, root)
    tables["connection"].replace(connections(spark, "one"))

    def stream(run):
        rows = spark.readStream.format("mailbox").option("root", str(box)).load()
        rows = rows.select(F.lit("o").alias("org_id"), F.lit("c").alias("connection_id"), F.lit("an@x").alias("mailbox"), "folder", "uidvalidity", "uid", F.col("uid").alias("seq"), "raw", F.coalesce("internal_date", F.lit("2024-01-01").cast("timestamp")).alias("internal_date"))
        return ingest.start(spark, rows, root, str(tmp_path / "marks"), ("c", run)).start()

    put(box, "INBOX", 1, mail("one", ident="<1@x>"))
    first = stream("one")
    first.processAllAvailable()
    assert idents(tables) == ["1@x"]
    tables["connection"].replace(connections(spark, "two"))
    put(box, "INBOX", 2, mail("two", ident="<2@x>"))
    until = time.time() + 60
    while first.isActive and time.time() < until:
        time.sleep(0.3)
    assert not first.isActive and ingest.superseded(first) and idents(tables) == ["1@x"]
    second = stream("two")
    try:
        second.processAllAvailable()
    finally:
        second.stop()
    assert idents(tables) == ["1@x", "2@x"] and not ingest.superseded(second)
