"""Streaming ingest of messages into the corpus's tables, exactly once in effect.

Each micro-batch is parsed, reduced to the first copy of each content identity, cleared of what the tables
hold already, and appended.  All of it, rows, failures and cursors, is one version of the tables (see
``snapshots``): a batch that is killed leaves nothing, one that runs again finds its rows there.
A run that syncs a connection holds it by its name in the table of connections.  Each batch reads that within its own transaction
and leaves its heartbeat there; once another run holds the connection, or nobody may, the batch is
refused and the query ends: no row of it appears after the other one's claim.
Nothing has a watermark: mail that comes late only widens what aggregates say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import lifecycle
from ..operators.tables import first_by, insert_missing, upsert
from ..sources import documents, messages
from ..sources.snapshots import Conflict, Database, Transaction

CURSOR = schemas.struct(org_id=schemas.S, connection_id=schemas.S, **{f.name: f.dataType for f in schemas.FOLDER_CURSOR.fields})
FOLDER = ["org_id", "connection_id", "folder"]
#: Failed identifiers that a cursor names; all of them are in ``sync_failure``.
NAMED = 100
#: A connection as ``lifecycle.claim`` takes it.
CONNECTION = schemas.struct(**dict.fromkeys(("id", "org_id", "sync_run_id", "sync_status"), schemas.S), heartbeat_at=schemas.D, disabled_at=schemas.D, synced=schemas.L, total=schemas.L, created_at=schemas.D)
#: Times a batch is tried whose tables others have changed meanwhile.
TRIES = 5


class Superseded(Exception):
    """The connection is no longer this run's: another one holds it, or it was disabled or let go."""


def advanced(cursors: DataFrame, seen: DataFrame, failures: DataFrame) -> DataFrame:
    """The next snapshot of the cursors after messages were ``seen``: a folder's cursor stands before its first failure,
    which so is asked for again, and else at the last message; a new generation begins anew."""
    top = seen.groupBy(*FOLDER).agg(F.max(F.struct("uidvalidity", "uid")).alias("top")).select(*FOLDER, F.col("top.uidvalidity").alias("uidvalidity"), F.col("top.uid").alias("top"))
    before = cursors.select(*FOLDER, F.col("uidvalidity").alias("__was"), F.greatest("last_seen_uid", F.coalesce(F.array_max("failed_uids"), F.lit(0))).alias("__reached"), "last_seen_uid")
    open_ = failures.groupBy(*FOLDER, "uidvalidity").agg(F.min("uid").alias("__first"), F.slice(F.sort_array(F.collect_set("uid")), 1, NAMED).alias("failed_uids"))
    joined = top.join(before, FOLDER, "left").join(open_, [*FOLDER, "uidvalidity"], "left")
    reached = F.greatest("top", F.when(F.col("__was") == F.col("uidvalidity"), F.col("__reached")))
    moved = joined.select(*FOLDER, "uidvalidity", F.least(reached, F.col("__first") - 1).alias("last_seen_uid"), F.coalesce("failed_uids", F.array().cast("array<long>")).alias("failed_uids"))
    return upsert(cursors, moved, FOLDER)


def store(spark: SparkSession, root: str) -> Database:
    kinds = {"email_message": schemas.EMAIL_MESSAGE, "email_recipient": schemas.EMAIL_RECIPIENT, "email_attachment": schemas.EMAIL_ATTACHMENT, "sync_failure": schemas.RAW_MESSAGE, "sync_cursor": CURSOR, "connection": CONNECTION}
    return Database(spark, root, kinds)


def parsed(raw: DataFrame) -> DataFrame:
    return raw.select("org_id", "connection_id", "seq", "mailbox", F.length("raw").alias("raw_size"), "raw", "folder", "uidvalidity", "uid", "internal_date", messages.parse(F.col("raw"), F.col("mailbox"), F.col("internal_date")).alias("m"))


def tried(database: Database, work):
    """What ``work`` does in a transaction, again where another writer was faster."""
    for left in reversed(range(TRIES)):
        try:
            with database.transaction() as unit:
                return work(unit)
        except Conflict:
            if not left:
                raise


def claim(database: Database, requests: DataFrame, at=None, stale_seconds: int = 300) -> list[str]:
    """Connections for the runs that ask for them (id, run_id), as ``lifecycle.claim``; the runs that won."""
    at = F.current_timestamp() if at is None else at

    def work(unit: Transaction):
        held = lifecycle.claim(unit["connection"].read(), requests, at, stale_seconds)
        unit["connection"].replace(held)
        return [r["run_id"] for r in lifecycle.won(unit["connection"].read(), requests).where("won").select("run_id").distinct().collect()]

    return tried(database, work)


def held(unit: Transaction, connection: str, run: str) -> None:
    """Superseded unless the run holds the connection; the transaction then ends only if that is still so."""
    found = unit["connection"].read().where((F.col("id") == connection) & (F.col("sync_run_id") == run) & F.col("disabled_at").isNull())
    if found.isEmpty():
        raise Superseded(connection, run)


def ingest_batch(tables: Database, raw: DataFrame, fence: tuple[str, str] | None = None) -> dict[str, int]:
    """Takes in rows of ``schemas.RAW_MESSAGE``; returns how many were seen, stored, skipped and failed.

    ``fence``: connection and run; Superseded if the one isn't the other's."""

    def work(unit: Transaction):
        if fence:
            held(unit, *fence)
        found = _taken_in(unit, raw)
        if fence:
            update = unit.database.spark.createDataFrame([(*fence, found["stored"])], "id string, run_id string, more long")
            update = update.join(unit["connection"].read().select("id", F.coalesce("synced", F.lit(0)).alias("was")), "id").select("id", "run_id", F.current_timestamp().alias("heartbeat_at"), (F.col("was") + F.col("more")).alias("synced"))
            unit["connection"].replace(lifecycle.fenced(unit["connection"].read(), update))
        return found

    return tried(tables, work)


def _taken_in(tables: Transaction, raw: DataFrame) -> dict[str, int]:
    rows = parsed(raw).persist()
    good = rows.where("m.parse_status <> 'failed'").withColumn("dedup_key", F.col("m.dedup_key"))
    key = ["org_id", "connection_id", "dedup_key"]
    fresh = insert_missing(tables["email_message"].read(), first_by(good, key, F.col("seq")), key).persist()
    try:
        out = messages.to_rows(fresh)
        parts = documents.extracted(out["email_attachment"])
        e = "extraction"
        stored = parts.select("*", F.col(f"{e}.text").alias("extracted_text"), F.col(f"{e}.status").alias("extraction_status"), F.col(f"{e}.extractor").alias("extractor_name"), F.col(f"{e}.version").alias("extractor_version"), F.col(f"{e}.detail").alias("extraction_detail"), F.col(f"{e}.grid").alias("extracted_data"))
        counts = rows.agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("m.parse_status") == "failed").alias("failed")).first()
        n = fresh.count()
        if counts["failed"]:
            failed = rows.where("m.parse_status = 'failed'").select(*(f.name for f in schemas.RAW_MESSAGE.fields))
            keys = ["org_id", "connection_id", "folder", "uidvalidity", "uid"]
            tables["sync_failure"].append(insert_missing(tables["sync_failure"].read(), failed, keys))
        if n:
            for name, frame in (("email_recipient", out["email_recipient"].withColumn("person_id", F.lit(None).cast("string"))), ("email_attachment", stored), ("email_message", out["email_message"].withColumn("from_person_id", F.lit(None).cast("string")))):
                held = tables[name].read().select("org_id", "id")
                tables[name].append(frame.join(held, ["org_id", "id"], "left_anti"))
        if counts["seen"]:
            cursors = tables["sync_cursor"]
            cursors.replace(advanced(cursors.read(), rows.select(*FOLDER, "uidvalidity", "uid"), tables["sync_failure"].read()))
        return {"seen": counts["seen"], "stored": n, "skipped": counts["seen"] - counts["failed"] - n, "failed": counts["failed"]}
    finally:
        fresh.unpersist()
        rows.unpersist()


def settle(tables: Database) -> dict[str, int]:
    """Takes in what failed before, once it can be parsed; the cursors then move on past it."""

    def work(unit: Transaction):
        failed = unit["sync_failure"].read()
        if failed.isEmpty():
            return {"seen": 0, "stored": 0, "skipped": 0, "failed": 0}
        unit["sync_failure"].replace(parsed(failed).where("m.parse_status = 'failed'").select(*schemas.RAW_MESSAGE.fieldNames()))
        return _taken_in(unit, failed)

    return tried(tables, work)


def start(spark: SparkSession, raw_stream: DataFrame, root: str, checkpoint: str, fence: tuple[str, str] | None = None):
    """Starts the query. With a ``fence``, connection and run, it ends once the run no longer holds the connection; what
    it hasn't written its successor reads again."""
    tables = store(spark, root)
    return raw_stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: ingest_batch(tables, batch, fence) and None)


def superseded(query) -> bool:
    """Whether a query has ended because its run lost the connection."""
    error = query.exception()
    return error is not None and Superseded.__name__ in str(error)
