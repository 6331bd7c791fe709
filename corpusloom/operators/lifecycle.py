"""Connections, their runs, consents and tokens: conditional writes as rewritten snapshots.

A condition and its write are one expression over one snapshot.  That two writers don't both win is
the table's business: one writer to a snapshot table, and ``won`` tells each caller what became of its request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import first_by, rewrite


def shared_connections(connections: DataFrame) -> DataFrame:
    """Connections of the whole tenant: without an owner."""
    return connections.where("owner_user_id is null").orderBy("created_at", "id")


def owned_connections(connections: DataFrame, owner: str | None) -> DataFrame:
    """One user's own connections; none for no user."""
    return connections.where(F.lit(False) if owner is None else F.col("owner_user_id") == owner).orderBy("created_at", "id")


def claim(connections: DataFrame, requests: DataFrame, at: Column, stale_seconds: int = 300) -> DataFrame:
    """The next snapshot after ``requests`` (id, run_id): a connection goes to the first run that asks for it, if it is
    enabled and no run holds it or the one that does hasn't been heard of for so long."""
    first = first_by(requests.where("id is not null and run_id is not null"), ["id"], F.col("run_id")).select("id", F.col("run_id").alias("__run"))
    free = F.col("sync_run_id").isNull() | F.col("heartbeat_at").isNull() | (F.col("heartbeat_at") < at - F.make_dt_interval(secs=F.lit(float(stale_seconds))))
    wins = F.col("__run").isNotNull() & F.col("disabled_at").isNull() & free
    taken = rewrite(connections.join(first, "id", "left"), wins, sync_run_id=F.col("__run"), sync_status=F.lit("running"), heartbeat_at=at, synced=F.lit(0).cast("long"), total=F.lit(None).cast("long"))
    return taken.select(*connections.columns)


def won(connections: DataFrame, requests: DataFrame) -> DataFrame:
    """(id, run_id, won) of each request, by the snapshot after the claim."""
    held = connections.select("id", "sync_run_id")
    return requests.join(held, "id", "left").select("id", "run_id", F.coalesce(F.col("sync_run_id") == F.col("run_id"), F.lit(False)).alias("won"))


def fenced(connections: DataFrame, updates: DataFrame) -> DataFrame:
    """The next snapshot after ``updates`` (id, run_id and columns to set): those of a run that no longer holds its
    connection change nothing, null values neither."""
    values = [c for c in updates.columns if c not in ("id", "run_id")]
    new = updates.select("id", F.col("run_id").alias("__run"), *(F.col(c).alias(f"__{c}") for c in values))
    joined = connections.join(new, "id", "left")
    mine = F.coalesce(F.col("sync_run_id") == F.col("__run"), F.lit(False))
    return joined.select(*(F.when(mine, F.coalesce(F.col(f"__{c}"), F.col(c))).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in connections.columns))


def finish(connections: DataFrame, run: str, status: str) -> DataFrame:
    """The next snapshot: the run lets go of its connection, if it still holds it."""
    mine = F.col("sync_run_id") == run
    return rewrite(connections, mine, sync_status=F.lit(status), heartbeat_at=F.lit(None).cast("timestamp"), sync_run_id=F.lit(None).cast("string"))


def switched(connections: DataFrame, ident: str, enabled: bool, at: Column) -> DataFrame:
    """The next snapshot with a connection enabled or disabled; a second switch keeps the first one's time."""
    value = F.lit(None).cast("timestamp") if enabled else F.coalesce("disabled_at", at)
    return rewrite(connections, F.col("id") == ident, disabled_at=value)


def checked(connections: DataFrame, ident: str, ok: bool, at: Column) -> DataFrame:
    """The next snapshot with the outcome of a health check."""
    return rewrite(connections, F.col("id") == ident, health=F.lit("ok" if ok else "failed"), checked_at=at)


def metadata(connections: DataFrame) -> DataFrame:
    """What governance may see of connections: no names of accounts, parameters or secrets."""
    return connections.select("id", "org_id", "connector_type", "owner_user_id", "sync_status", F.col("disabled_at").isNull().alias("is_enabled"), "created_at")


def policy(connectors: DataFrame, policies: DataFrame) -> DataFrame:
    """(connector_type, org_wide_enabled) of every type; one without a policy isn't enabled for all."""
    return connectors.select("connector_type").distinct().join(policies.select("connector_type", "org_wide_enabled"), "connector_type", "left").select("connector_type", F.coalesce("org_wide_enabled", F.lit(False)).alias("org_wide_enabled"))


def open_runs(runs: DataFrame, started: DataFrame) -> DataFrame:
    """The next ledger with ``started`` (id, connection_id, started_at) as running; what ran on their connections
    before is abandoned."""
    opened = started.select("id", "connection_id", F.lit("running").alias("status"), "started_at", F.lit(None).cast("timestamp").alias("finished_at"))
    again = started.groupBy("connection_id").agg(F.min("started_at").alias("__at"))
    old = rewrite(runs.join(again, "connection_id", "left"), (F.col("status") == "running") & F.col("__at").isNotNull(), finished_at=F.col("__at"), status=F.lit("abandoned"))
    return old.select(*opened.columns).unionByName(opened)


def finalize_runs(runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The next ledger after ``outcomes`` (id, outcome, at): only runs that are running change."""
    joined = runs.join(outcomes, "id", "left")
    ends = (F.col("status") == "running") & F.col("outcome").isNotNull()
    return rewrite(joined, ends, finished_at=F.col("at"), status=F.col("outcome")).select(*runs.columns)


def active_consent(consents: DataFrame, keys: list[str]) -> DataFrame:
    """The newest consent of each key that wasn't withdrawn."""
    return first_by(consents.where("withdrawn_at is null"), keys, F.col("granted_at").desc(), F.col("id").desc())


def withdraw(consents: DataFrame, where: Column, at: Column) -> DataFrame:
    """The next snapshot with all active consents that meet the condition withdrawn."""
    return rewrite(consents, where & F.col("withdrawn_at").isNull(), withdrawn_at=at)


def consume(tokens: DataFrame, uses: DataFrame) -> DataFrame:
    """(token_hash, use_id, accepted) of each use: the first one of a live token is accepted, any later one is not."""
    live = tokens.where("revoked_at is null").select("token_hash", F.lit(True).alias("__live"))
    first = uses.groupBy("token_hash").agg(F.min(F.struct("at", "use_id")).alias("__first"))
    joined = uses.join(first, "token_hash").join(live, "token_hash", "left")
    # a use that was sent twice has one answer
    return joined.select("token_hash", "use_id", F.coalesce(F.col("__live") & (F.struct("at", "use_id") == F.col("__first")), F.lit(False)).alias("accepted"))


def unexpired(cutoffs: DataFrame, at: Column, ttl_seconds: int) -> DataFrame:
    """Cutoffs that still matter: tokens from before an older one have run out by themselves."""
    return cutoffs.where(F.col("cutoff") > at - F.make_dt_interval(secs=F.lit(float(ttl_seconds))))


def seats(orgs: DataFrame) -> DataFrame:
    """One row: seats in all, organisations that are active and suspended."""
    return orgs.agg(F.coalesce(F.sum("seats"), F.lit(0)).alias("seats"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "suspended").alias("suspended"), F.count(F.lit(1)).alias("orgs"))
