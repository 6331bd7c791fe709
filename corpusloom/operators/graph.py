"""The graph of people and companies, resolved as sets.

The order of arrival decides some values (whose name came first, whose mailbox made a person internal); it
is an explicit sequence number, so results don't depend on how rows are dealt to tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import addresses as A
from ..functions import suffixes
from .tables import first_by


def ident(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def first_copies(messages: DataFrame) -> DataFrame:
    """One message of each content identity: the first that came."""
    return first_by(messages, ["org_id", "connection_id", "dedup_key"], F.col("seq"))


def sightings(messages: DataFrame) -> DataFrame:
    """(org_id, seq, at, address, name, mailbox, person): senders and recipients of first copies.

    ``messages`` are parsed, with recipients inside.  ``person`` is false for what can't make a person:
    senders that are machines by origin, and routing addresses."""
    first = first_copies(messages)
    base = ["org_id", "seq", F.col("received_at").alias("at"), "mailbox"]
    senders = first.select(*base, F.lit(0).alias("place"), F.col("from_address").alias("address"), F.col("from_name").alias("name"), (~F.coalesce("is_automated_origin", F.lit(False))).alias("person"))
    others = first.select(*base, F.posexplode("recipients").alias("place", "r")).select("org_id", "seq", "at", "mailbox", (F.col("place") + 1).alias("place"), F.col("r.address").alias("address"), F.col("r.name").alias("name"), (~F.col("r.kind").isin("reply_to", "sender")).alias("person"))
    all_ = senders.unionByName(others).withColumn("email", A.normalize_email(F.col("address")))
    return all_.where(F.coalesce(A.local_part(F.col("email")) != "", F.lit(False)) & A.domain(F.col("email")).isNotNull())


def folded_hosts(seen: DataFrame, listed: DataFrame | None) -> DataFrame:
    """``seen`` with ``folded`` and ``own``: what the address's and the mailbox's host fold to, by the engine's few
    suffixes or by a list (see ``suffixes.rules``)."""
    host, own = A.domain(F.col("email")), A.domain(A.normalize_email(F.col("mailbox")))
    if listed is None:
        return seen.select("*", A.registrable(host).alias("folded"), A.registrable(own).alias("own"))
    rows = seen.select("*", host.alias("__host"), own.alias("__own"))
    known = suffixes.registrable(rows.select(F.col("__host").alias("host")).unionByName(rows.select(F.col("__own").alias("host"))), listed)
    for column, name in (("__host", "folded"), ("__own", "own")):
        rows = rows.join(known.select(F.col("host").alias(column), F.col("registrable").alias(name)), column, "left")
    return rows.drop("__host", "__own")


def near_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """(name, near): each of ``names`` (name) and those of ``known`` (name) within one substitution, insertion or deletion.

    Two names that near are equal, one is the other without a letter, or both are equal without the one that differs:
    so they share a name with at most one letter left out, which is what they are joined by."""
    without = F.expr("transform(sequence(1, greatest(length(name), 1)), i -> concat(substring(name, 1, i - 1), substring(name, i + 1)))")
    keys = lambda df, alias: df.distinct().select(F.col("name").alias(alias), F.explode(F.array_union(F.array("name"), without)).alias("key"))
    pairs = keys(names.select("name"), "name").join(keys(known.select("name"), "near"), "key").select("name", "near").distinct()
    return pairs.where(A.within_one_edit(F.col("name"), F.col("near")))


def resolve(seen: DataFrame, listed: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables person, person_email, person_alias, company, company_domain and person_company of sightings.

    ``listed``: rules of a list of public suffixes, by which hosts fold to companies."""
    seen = folded_hosts(seen, listed)
    host, folded = A.domain(F.col("email")), F.col("folded")
    company = F.when(~(A.is_generic(host) | A.is_generic(folded) | A.is_suspicious_idn(host)), folded)
    rows = seen.select("*", host.alias("host"), company.alias("company"), A.clean_name(F.col("name")).alias("clean"), A.is_internal(F.col("email"), F.col("mailbox"), folded, F.col("own")).alias("internal"), F.struct("seq", "place").alias("order"))
    hosts = rows.where("company is not null")
    companies = hosts.groupBy("org_id", "company").agg(F.bool_or(F.coalesce(F.col("own") == F.col("company"), F.lit(False))).alias("is_internal"))
    people = rows.where("person").where(~A.is_role(F.col("email")))
    key = ["org_id", "email"]
    # aggregates alone, so order of arrival within tasks doesn't matter and partial results combine
    person = people.groupBy(*key).agg(F.min_by("clean", F.when(F.col("clean").isNotNull(), F.col("order"))).alias("display_name"), F.min_by("internal", "order").alias("is_internal"))
    # whoever is known already is seen in any role
    window = rows.groupBy(*key).agg(F.min("at").alias("first_seen_at"), F.max("at").alias("last_seen_at"))
    known = person.select(*key)
    person = person.join(window, key)
    person_id, company_id = ident(F.lit("person"), F.col("org_id"), F.col("email")), ident(F.lit("company"), F.col("org_id"), F.col("company"))
    alias = rows.where("clean is not null").join(known, key, "left_semi").select("org_id", person_id.alias("person_id"), F.col("clean").alias("alias")).distinct()
    return {
        "person": person.select(person_id.alias("id"), "org_id", "display_name", "is_internal", "first_seen_at", "last_seen_at"),
        "person_email": person.select("org_id", person_id.alias("person_id"), "email"),
        "person_alias": alias,
        "company": companies.select(company_id.alias("id"), "org_id", F.col("company").alias("name"), "is_internal"),
        "company_domain": hosts.select("org_id", company_id.alias("company_id"), F.col("host").alias("domain")).distinct(),
        "person_company": hosts.join(known, key, "left_semi").select("org_id", person_id.alias("person_id"), company_id.alias("company_id")).distinct(),
    }
