"""Who sees what: tenant and person scopes, grants and their derivation, connector decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import normalize_email
from ..functions.texts import SHARED_HEADERS, retained_headers


def scoped(df: DataFrame, org: str | None) -> DataFrame:
    """Rows of a tenant; none if the tenant isn't set."""
    return df.where(F.lit(False) if org is None else F.col("org_id") == org)


def live(grants: DataFrame) -> DataFrame:
    return grants.where("revoked_at is null")


def visible(objects: DataFrame, grants: DataFrame, person, key: str = "id", object_type: str = "email_message") -> DataFrame:
    """Rows with scope org, and those that a live grant opens to the person. Children pass their parent's key.

    One person's grants of one type are distinct objects, so the join adds no rows."""
    own = live(grants).where((F.col("person_id") == F.lit(person)) & (F.col("object_type") == object_type)).select(F.col("org_id").alias("__org"), F.col("object_id").alias("__object"), F.lit(True).alias("__open")).distinct()
    joined = objects.join(own, (objects["org_id"] == own["__org"]) & (objects[key] == own["__object"]), "left")
    return joined.where((F.col("visibility_scope") == "org") | F.col("__open")).select(*(objects[c] for c in objects.columns))


def holders(grants: DataFrame, org, object_type: str, object_id) -> DataFrame:
    return live(grants).where((F.col("org_id") == org) & (F.col("object_type") == object_type) & (F.col("object_id") == object_id)).select("person_id").distinct()


RANK = ("recipient", "sender", "owner")


def derive(messages: DataFrame, recipients: DataFrame, identities: DataFrame) -> DataFrame:
    """(org_id, object_id, person_id, provenance): everyone with a verified identity whose address takes part,
    and the owner of the connection; of several roles the highest: owner, sender, recipient."""
    taking = recipients.where("kind in ('to', 'cc', 'bcc')").select("org_id", F.col("email_id").alias("object_id"), normalize_email(F.col("address")).alias("external_id"), F.lit(0).alias("rank"))
    sending = messages.select("org_id", F.col("id").alias("object_id"), normalize_email(F.col("from_address")).alias("external_id"), F.lit(1).alias("rank"))
    # an address's role in a message is sender if it sends, whatever else it is there
    roles = taking.unionByName(sending).where("external_id <> ''").groupBy("org_id", "object_id", "external_id").agg(F.max("rank").alias("rank"))
    verified = identities.where("verified")
    by_mail = roles.join(verified.where("source_type = 'email'").select("org_id", "external_id", "person_id"), ["org_id", "external_id"])
    owning = messages.where("owner_user_id is not null").select("org_id", F.col("id").alias("object_id"), F.col("owner_user_id").alias("external_id"), F.lit(2).alias("rank"))
    by_owner = owning.join(verified.where("source_type = 'auth'").select("org_id", "external_id", "person_id"), ["org_id", "external_id"])
    return by_rank(by_mail.unionByName(by_owner))


def by_rank(roles: DataFrame) -> DataFrame:
    found = roles.groupBy("org_id", "object_id", "person_id").agg(F.max("rank").alias("rank"))
    return found.select("org_id", "object_id", "person_id", F.element_at(F.array(*map(F.lit, RANK)), F.col("rank") + 1).alias("provenance"))


def reconcile(derived: DataFrame, grants: DataFrame) -> DataFrame:
    """(org_id, object_id, person_id, action): insert what is missing, tombstone what can't be derived any more."""
    key = ["org_id", "object_id", "person_id"]
    want, have = derived.select(*key).distinct(), live(grants).select(*key).distinct()
    return want.join(have, key, "left_anti").withColumn("action", F.lit("insert")).unionByName(have.join(want, key, "left_anti").withColumn("action", F.lit("tombstone")))


def low_coverage(seen: Column, candidates: Column) -> Column:
    """Less than half of the candidates was visible; without candidates it isn't low."""
    return F.when(candidates > 0, seen / candidates < 0.5).otherwise(False)


def decide(entitled: Column, override: Column, org_wide: Column) -> tuple[Column, Column]:
    """(allowed, reason): the tenant's entitlement, then the user's override, then the tenant's policy."""
    reason = F.when(~F.coalesce(entitled, F.lit(False)), "not_entitled").when(override == "deny", "denied_by_override").when(override == "allow", "allowed_by_override").when(F.coalesce(org_wide, F.lit(False)), "org_wide").otherwise("org_disabled")
    return reason.isin("allowed_by_override", "org_wide"), reason


def is_active(status: Column, expires_at: Column, as_of: Column) -> Column:
    return (status == "approved") & F.coalesce(expires_at > as_of, F.lit(False))


def is_revoked(issued_at: Column, subject_cutoff: Column, org_cutoff: Column) -> Column:
    """A token without issue time, or not younger than a cutoff of its subject or tenant."""
    return issued_at.isNull() | F.coalesce(issued_at <= subject_cutoff, F.lit(False)) | F.coalesce(issued_at <= org_cutoff, F.lit(False))


def for_non_owner(messages: DataFrame) -> DataFrame:
    """A copy for readers that don't own it: no blind recipients, a subset of the headers."""
    return messages.withColumns({"recipients": F.filter("recipients", lambda r: r["kind"] != "bcc"), "headers": retained_headers(F.col("headers"), SHARED_HEADERS)})


def promote(tables: dict[str, DataFrame], org: str, message: str, at: Column) -> dict[str, DataFrame]:
    """Widens a message and its children to the tenant, and records it; the origin stays what it was."""
    hit = (F.col("org_id") == org) & (F.col("visibility_scope") != "org")
    wide = lambda t, key: t.withColumn("visibility_scope", F.when(hit & (F.col(key) == message), "org").otherwise(F.col("visibility_scope")))
    changed = tables["email_message"].where(hit & (F.col("id") == message))
    record = changed.select("org_id", F.lit("email_message").alias("object_type"), F.col("id").alias("object_id"), F.col("visibility_scope").alias("from_scope"), F.lit("org").alias("to_scope"), at.alias("promoted_at"))
    return tables | {"email_message": wide(tables["email_message"], "id"), "email_recipient": wide(tables["email_recipient"], "email_id"), "visibility_promotion": tables["visibility_promotion"].unionByName(record)}


def last_admin(users: DataFrame) -> DataFrame:
    """(org_id, user_id) of active admins without another active one beside them."""
    admins = users.where("role = 'company_admin' and is_active")
    alone = admins.groupBy("org_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("user_id")).where("n = 1")
    return alone.select("org_id", "user_id")


def persons_of(identities: DataFrame, org: str | None) -> DataFrame:
    """(user, person_id) of the users that a verified identity makes one person: none for a user of no or more than one."""
    own = scoped(identities, org).where((F.col("source_type") == "auth") & F.col("verified"))
    found = own.groupBy(F.col("external_id").alias("user")).agg(F.count_distinct("person_id").alias("n"), F.min("person_id").alias("person_id"))
    return found.where("n = 1").select("user", "person_id")


def person_of(identities: DataFrame, org: str | None, user: str | None) -> DataFrame:
    """(person_id) that a user is known to be; where there is none only what the tenant shares is visible."""
    return persons_of(identities, org).where(F.lit(False) if user is None else F.col("user") == user).select("person_id")


def promote_as(tables: dict[str, DataFrame], org: str, user: str, message: str, at: Column) -> dict[str, DataFrame]:
    """``promote``, for the owner of the message's connection alone, with a row in the audit log; for any other
    user all tables stay as they are."""
    owned = tables["connector_connection"].where((F.col("org_id") == org) & (F.col("owner_user_id") == user)).select(F.col("id").alias("connection_id"))
    mine = tables["email_message"].where((F.col("org_id") == org) & (F.col("id") == message) & (F.col("visibility_scope") != "org")).join(owned, "connection_id", "left_semi")
    event = mine.select(F.sha2(F.concat_ws("\0", F.lit("promotion"), "org_id", "id"), 256).alias("id"), at.alias("occurred_at"), F.lit("user").alias("actor_type"), F.lit(user).alias("actor_id"), F.lit("content.promoted").alias("action"), "org_id", F.lit("email_message").alias("entity_type"), F.col("id").alias("entity_id"), F.create_map(F.lit("from"), F.col("visibility_scope"), F.lit("to"), F.lit("org")).alias("details"))
    if mine.isEmpty():
        return tables
    return promote(tables, org, message, at) | {"audit_log": tables["audit_log"].unionByName(event)}
