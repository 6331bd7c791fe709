"""The catalogue of data-quality measures over the stored tables of one tenant.

``MEASURES`` has a function for each identifier: tables (as ``tenant`` returns them) -> one row of counts, or
the largest groups.  Caveats are those of the catalogue: some measures count what is legitimate, and
their semantics are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import addresses as A
from ..functions import texts as X
from ..operators.access import scoped

Tables = dict[str, DataFrame]
MEASURES: dict[str, Callable[[Tables], DataFrame]] = {}

# fixed values: providers whose near misses count as typing errors
TYPO_TARGETS = "gmail.com googlemail.com outlook.com hotmail.com yahoo.com icloud.com gmx.de gmx.net web.de t-online.de aol.com proton.me".split()
RFC2047 = r"(?i)=\?[^?]+\?[bq]\?"
LARGE = 50_000


def measure(name: str):
    def add(f):
        MEASURES[name] = f
        return f

    return add


def tenant(tables: Tables, org: str) -> Tables:
    return {name: scoped(df, org) for name, df in tables.items()}


def total(x: Column, name: str) -> Column:
    return F.count_if(F.coalesce(x, F.lit(False))).alias(name)


def n(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def blank(x: Column) -> Column:
    return x.isNull() | (A.strip(x) == "")


def edges(t: Tables) -> DataFrame:
    """(person_id, email_id) of senders and recipients."""
    a = t["email_message"].select(F.col("from_person_id").alias("person_id"), F.col("id").alias("email_id"))
    return a.unionByName(t["email_recipient"].select("person_id", "email_id")).where("person_id is not null")


def hosts(t: Tables) -> DataFrame:
    """Distinct hosts of companies."""
    return t["company_domain"].select("domain").distinct()


def one_row(*parts: DataFrame) -> DataFrame:
    """Joins of single rows, side by side."""
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


@measure("K01")
def unlinked_people(t):
    host = A.domain(A.normalize_email(F.col("email")))
    own = t["person_email"].groupBy("person_id").agg(F.bool_and(F.coalesce(~A.is_generic(host), F.lit(False))).alias("all"))
    return own.where("all").join(t["person_company"].select("person_id").distinct(), "person_id", "left_anti").agg(n("people"))


@measure("K02")
def recipients_without_person(t):
    a = A.normalize_email(F.col("address"))
    garbage = F.coalesce(A.local_part(a) == "", F.lit(True)) | A.domain(a).isNull()
    bucket = F.when(garbage, "garbage").when(A.is_role(a), "role").otherwise("unexplained")
    return t["email_recipient"].where("person_id is null").groupBy(bucket.alias("bucket")).agg(n("rows"))


@measure("K03")
def degrees(t):
    person = edges(t).groupBy("person_id").agg(F.countDistinct("email_id").alias("d")).agg(total(F.col("d") == 1, "people_once"), n("people_referenced"))
    company = t["person_company"].groupBy("company_id").agg(F.countDistinct("person_id").alias("d")).agg(total(F.col("d") == 1, "companies_once"), n("companies_linked"))
    return one_row(person, company, t["person"].agg(n("people")))


@measure("K04")
def blank_names(t):
    return t["person"].agg(total(blank(F.col("display_name")), "blank"), n("people"))


@measure("A01")
def links_own_their_address(t):
    held = t["person_email"].select("person_id", F.col("email").alias("key")).distinct()
    sent = t["email_message"].where("from_person_id is not null").select(F.col("from_person_id").alias("person_id"), F.coalesce(A.normalize_email(F.col("from_address")), F.lit("")).alias("key"))
    got = t["email_recipient"].where("person_id is not null").select("person_id", F.coalesce(A.normalize_email(F.col("address")), F.lit("")).alias("key"))
    return one_row(*(x.join(held, ["person_id", "key"], "left_anti").agg(n(name)) for x, name in ((sent, "senders"), (got, "recipients"))))


@measure("A02")
def truncated_keys(t):
    m = t["email_message"].agg(total(F.length("from_address") == X.ADDRESS_MAX, "addresses"), total(F.length("message_id") == X.MESSAGE_ID_MAX, "message_ids"))
    return one_row(m, t["person_email"].agg(total(F.length("email") == X.ADDRESS_MAX, "keys")))


@measure("A03")
def keys_not_normal(t):
    return t["person_email"].agg(total(F.col("email") != A.normalize_email(F.col("email")), "keys"), n("rows"))


@measure("A04")
def orphans_both_ways(t):
    person, mail = t["person"].select(F.col("id").alias("person_id")), t["person_email"].select("person_id")
    return one_row(person.join(mail, "person_id", "left_anti").agg(n("people")), mail.join(person, "person_id", "left_anti").agg(n("addresses")))


@measure("B01")
def dot_plus_groups(t):
    email = A.normalize_email(F.col("email"))
    rows = t["person_email"].select("person_id", A.domain(email).alias("host"), A.local_part(email).alias("local")).where(A.is_generic(F.col("host")) & (F.col("local") != ""))
    return rows.groupBy(A.mailbox_root(F.col("local")).alias("base"), "host").agg(F.countDistinct("person_id").alias("people")).where("people > 1")


@measure("B02")
def shared_names(t):
    return t["person"].where(~blank(F.col("display_name"))).groupBy("display_name").agg(n("people")).where("people > 1").orderBy(F.desc("people"), "display_name").limit(8)


@measure("B03")
def split_domains(t):
    labels = F.substring_index("domain", ".", -2).alias("registrable")
    return t["company_domain"].groupBy(labels).agg(F.countDistinct("domain").alias("domains")).where("domains > 1")


@measure("B04")
def punycode(t):
    return hosts(t).agg(total(A.is_punycode(F.col("domain")), "punycode"), total(F.col("domain").rlike(r"[^\x00-\x7F]"), "unicode"))


@measure("B05")
def redundant_messages(t):
    per = t["email_message"].where("message_id is not null").groupBy("message_id").agg(F.count(F.lit(1)).alias("c"))
    return per.agg(n("total"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("redundant"))


@measure("B06")
def duplicate_edges(t):
    return t["email_recipient"].groupBy("email_id", "kind", F.lower("address")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(n("groups"))


@measure("C01")
def automated_people(t):
    m = t["email_message"].where("is_automated")
    return m.agg(total(F.col("from_person_id").isNotNull(), "with_person"), n("automated"), F.countDistinct("from_person_id").alias("people"))


@measure("C02")
def routing_only(t):
    r, m = t["email_recipient"].where("person_id is not null"), t["email_message"].where("from_person_id is not null")
    only = r.where("kind in ('reply_to', 'sender')").select("person_id").subtract(r.where("kind in ('to', 'cc', 'bcc')").select("person_id")).subtract(m.select("from_person_id"))
    return only.agg(n("people"))


@measure("C03")
def typing_errors(t):
    near = F.lit(False)
    for target in TYPO_TARGETS:
        near = near | A.within_one_edit(F.col("domain"), F.lit(target))
    return hosts(t).where(~A.is_malformed(F.col("domain")) & near)


@measure("C04")
def malformed_domains(t):
    d = F.col("domain")
    return hosts(t).where(~F.contains(d, F.lit(".")) | d.startswith("[") | F.contains(d, F.lit("_")) | d.endswith(".") | F.contains(d, F.lit(" ")))


def missing(t: Tables, roles: bool) -> DataFrame:
    a = t["email_message"].select(F.col("from_address").alias("a")).unionByName(t["email_recipient"].select(F.col("address").alias("a")))
    email = A.normalize_email(F.col("a"))
    rows = a.select(email.alias("email"), A.domain(email).alias("domain")).where(F.col("domain").isNotNull() & ~A.is_generic(F.col("domain")))
    rows = rows.where(A.is_role(F.col("email"))) if roles else rows
    return rows.groupBy("domain").agg(n("mails")).join(hosts(t), "domain", "left_anti").orderBy(F.desc("mails"), "domain").limit(8)


MEASURES["D01"] = lambda t: missing(t, True)
MEASURES["D03"] = lambda t: missing(t, False)


@measure("D02")
def tenants_at_providers(t):
    host = A.domain(A.normalize_email(F.col("username")))
    return t["connector_connection"].agg(total(A.is_generic(host), "generic"), n("connections"))


@measure("D04")
def mailbox_takes_no_part(t):
    box = t["connector_connection"].select(F.col("id").alias("connection_id"), A.normalize_email(F.col("username")).alias("box"))
    part = t["email_message"].select(F.col("id").alias("email_id"), A.normalize_email(F.col("from_address")).alias("box")).unionByName(t["email_recipient"].select("email_id", A.normalize_email(F.col("address")).alias("box"))).distinct()
    inbound = t["email_message"].where("direction = 'inbound'").select(F.col("id").alias("email_id"), "connection_id").join(box, "connection_id")
    return inbound.join(part, ["email_id", "box"], "left_anti").agg(n("messages"))


@measure("E01")
def internal_drift(t):
    """By exact hosts, so colleagues at sub-domains show."""
    box = t["connector_connection"].select(A.domain(A.normalize_email(F.col("username"))).alias("host")).where(~A.is_generic(F.col("host"))).distinct().withColumn("own", F.lit(True))
    mail = t["person_email"].select("person_id", A.domain(A.normalize_email(F.col("email"))).alias("host")).join(box, "host", "left")
    own = mail.groupBy(F.col("person_id").alias("id")).agg(F.bool_or(F.coalesce("own", F.lit(False))).alias("own"))
    any_box = box.agg((F.count(F.lit(1)) > 0).alias("any"))
    rows = t["person"].join(own, "id").crossJoin(any_box).where("any")  # one row on the right
    return rows.agg(total(F.col("own") & ~F.col("is_internal"), "not_flagged"), total(~F.col("own") & F.col("is_internal"), "flagged"))


@measure("E02")
def inbound_internal(t):
    inside = t["person"].where("is_internal").select(F.col("id").alias("from_person_id"))
    return t["email_message"].where("direction = 'inbound'").join(inside, "from_person_id").agg(n("messages"))


@measure("E02_mix")
def directions(t):
    return t["email_message"].groupBy("direction").agg(n("messages"))


@measure("E03")
def automation_missed(t):
    listed = F.lit(False)
    for name in ("List-Unsubscribe", "List-Id", "List-unsubscribe"):
        listed = listed | F.map_contains_key("headers", F.lit(name))
    return t["email_message"].where("not is_automated").agg(total(listed, "messages"))


@measure("E04")
def reply_flags(t):
    looks = F.coalesce(F.col("subject").rlike(X.REPLY_PREFIX), F.lit(False))
    answers = F.col("in_reply_to").isNotNull()
    return t["email_message"].agg(total(F.col("is_reply") & ~answers & ~looks, "false_yes"), total(~F.col("is_reply") & (answers | looks), "false_no"))


@measure("F01")
def dirty_names(t):
    d = F.col("display_name")
    names = t["person"].where(~blank(d)).select("display_name").distinct()
    return names.agg(total(d.rlike(RFC2047), "encoded"), total(d.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), "control"), total(F.contains(d, F.lit("@")) & ~F.contains(A.strip(d), F.lit(" ")), "addresses"))


@measure("F02")
def broken_bodies(t):
    b = F.col("body_text")
    return t["email_message"].agg(total(X.has_mojibake(b), "mojibake"), total(F.contains(b, F.lit("�")), "replaced"))


@measure("F03")
def large_without_words(t):
    return t["email_message"].where(f"word_count < 5 and size_bytes > {LARGE}").agg(n("messages"))


@measure("F04")
def failed_parses(t):
    return t["email_message"].where("parse_status = 'failed'").agg(n("messages"), total(F.col("size_bytes") > LARGE, "large"))


@measure("F05")
def word_counts(t):
    return t["email_message"].agg(total(F.col("word_count") != X.word_count(F.col("body_text")), "wrong"), n("messages"))


def dates(t: Tables, as_of: Column) -> DataFrame:
    s, r, slack = F.col("sent_at"), F.col("received_at"), F.expr("INTERVAL 2 DAYS")
    return t["email_message"].agg(total(s < F.lit("1990-01-01").cast("timestamp"), "early"), total(s > as_of + slack, "future"), total(s > r + slack, "skewed"), total(s.isNull() & r.isNull(), "missing"))


MEASURES["F06"] = lambda t: dates(t, F.current_timestamp())


@measure("F07")
def dirty_subjects(t):
    return t["email_message"].agg(total(F.col("subject").rlike(r"[\x01-\x08\x0E-\x1F]"), "control"), total(F.col("subject").rlike(RFC2047), "encoded"))


@measure("G01")
def reused_ids(t):
    per = t["email_message"].where("message_id is not null").groupBy("message_id").agg(n("rows"), F.countDistinct("from_address").alias("senders"), F.countDistinct("subject").alias("subjects"), F.countDistinct("dedup_key").alias("contents"))
    return per.where("contents > 1 and (senders > 1 or subjects > 1)").orderBy(F.desc("rows"), "message_id").limit(10)


def dangling(refs: DataFrame, t: Tables, name: str) -> DataFrame:
    """Joined rows count, so a parent that is stored twice counts twice."""
    known = t["email_message"].where("message_id is not null").select(F.col("message_id").alias("ref"), F.lit(True).alias("found"))
    return refs.join(known, "ref", "left").agg(n(f"{name}_total"), total(F.col("found").isNull(), f"{name}_dangling"))


@measure("G02")
def dangling_references(t):
    m = t["email_message"]
    return one_row(dangling(m.select(F.explode("references").alias("ref")), t, "references"), dangling(m.where("in_reply_to is not null").select(F.col("in_reply_to").alias("ref")), t, "parents"))


@measure("G03")
def ambiguous_parents(t):
    twice = t["email_message"].groupBy(F.col("message_id").alias("in_reply_to")).count().where("count > 1 and in_reply_to is not null")
    return t["email_message"].join(twice, "in_reply_to", "left_semi").agg(n("messages"))


@measure("H01")
def text_by_type(t):
    return t["email_attachment"].groupBy("content_type").agg(n("rows"), total(F.col("extracted_text").isNull(), "without_text"), F.sum("size_bytes").alias("bytes")).orderBy(F.desc("rows"), "content_type").limit(15)


@measure("H02")
def broken_attachments(t):
    x = F.col("extracted_text")
    return t["email_attachment"].agg(total(X.has_mojibake(x) | F.contains(x, F.lit("�")), "rows"))


@measure("H03")
def attachment_names(t):
    return t["email_attachment"].agg(total(F.col("filename").rlike(RFC2047), "encoded"), total(F.col("size_bytes") == 0, "empty"))


@measure("I01")
def provenance(t):
    return one_row(t["company_domain"].agg(total(F.col("source").isNull(), "domains_without"), n("domains")), t["person_email"].agg(total(F.col("source").isNotNull(), "addresses_with"), n("addresses")))


@measure("I02")
def aliases(t):
    return t["person_alias"].agg(n("rows"))


@measure("I03")
def languages(t):
    return t["email_message"].agg(total(F.col("language").isNotNull(), "rows"))


@measure("I04")
def header_bloat(t):
    size = F.length(F.to_json("headers"))
    sensitive = F.lit(False)
    for name in ("DKIM-Signature", "Authentication-Results", "Received"):
        sensitive = sensitive | F.map_contains_key("headers", F.lit(name))
    return t["email_message"].agg(F.avg(size).cast("int").alias("mean"), F.max(size).alias("most"), total(sensitive, "sensitive"))


@measure("J01")
def people_without_reference(t):
    """People less those that are referenced, as counts."""
    return one_row(t["person"].agg(n("people")), edges(t).agg(F.countDistinct("person_id").alias("referenced"))).select((F.col("people") - F.col("referenced")).alias("people"))


@measure("J02")
def companies_without_person(t):
    return t["company"].join(t["person_company"].select(F.col("company_id").alias("id")), "id", "left_anti").agg(n("companies"))


@measure("J03")
def orphan_rows(t):
    company, person, link = t["company"].select(F.col("id").alias("company_id")), t["person"].select(F.col("id").alias("person_id")), t["person_company"]
    return one_row(company.join(t["company_domain"], "company_id", "left_anti").agg(n("companies")), link.join(company, "company_id", "left_anti").agg(n("links_to_company")), link.join(person, "person_id", "left_anti").agg(n("links_to_person")))


@measure("R1")
def header_spellings(t):
    keys = t["email_message"].select(F.explode(F.map_keys("headers")).alias("k")).distinct()
    return keys.groupBy(F.lower("k").alias("header")).agg(F.array_join(F.array_sort(F.collect_set("k")), ",").alias("spellings"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")


@measure("R2")
def secrets_in_headers(t):
    from ..functions.redact import count_tokens

    return t["email_message"].agg(total(count_tokens(F.to_json("headers")) > 0, "messages"))


@measure("R3")
def split_copies(t):
    """Groups of one id, sender, subject and time with several contents, and what tells them apart."""
    r = t["email_recipient"].where("kind in ('to', 'cc')").groupBy(F.col("email_id").alias("id")).agg(F.md5(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "kind", F.lower("address")))), "|")).alias("audience"))
    a = t["email_attachment"].groupBy(F.col("email_id").alias("id")).agg(F.md5(F.array_join(F.array_sort(F.collect_list("content_hash")), "|")).alias("files"))
    rows = t["email_message"].where("message_id is not null").join(r, "id", "left").join(a, "id", "left")
    per = rows.groupBy("message_id", "from_address", "subject", "sent_at").agg(F.countDistinct("dedup_key").alias("contents"), F.countDistinct(F.md5("body_text")).alias("bodies"), F.countDistinct(F.coalesce("audience", F.lit(""))).alias("audiences"), F.countDistinct(F.coalesce("files", F.lit(""))).alias("files"))
    return per.where("contents > 1").agg(n("groups"), total(F.col("bodies") > 1, "by_body"), total(F.col("audiences") > 1, "by_audience"), total(F.col("files") > 1, "by_files"))


@measure("R4")
def residual_duplicates(t):
    per = t["email_message"].where("message_id is not null").groupBy("message_id", F.md5("body_text"), "from_address", "subject", "sent_at").agg(F.count(F.lit(1)).alias("c"))
    return per.where("c > 1").agg(n("groups"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("rows"))


@measure("R5")
def honest_nulls(t):
    from ..schemas import EXTRACTED_WITH_TEXT

    has = F.col("extraction_status").isin(*EXTRACTED_WITH_TEXT)
    return t["email_attachment"].agg(total(has & F.col("extracted_text").isNull(), "text_missing"), total(~has & F.col("extracted_text").isNotNull(), "text_unexpected"))


def who_works_at(t: Tables, company: str) -> DataFrame:
    found = t["company"].where(F.col("name") == company).select(F.col("id").alias("company_id")).join(t["person_company"], "company_id").select(F.col("person_id").alias("id"))
    mail = t["person_email"].select(F.col("person_id").alias("id"), "email")
    return t["person"].join(found, "id").join(mail, "id", "left").select("id", "display_name", "email")


def activity(t: Tables, email: str) -> DataFrame:
    who = t["person_email"].where(F.col("email") == email).select("person_id")
    sent = t["email_message"].select(F.col("from_person_id").alias("person_id"), "id").join(who, "person_id", "left_semi").agg(n("sent"), F.min("id").alias("example"))
    return one_row(sent, t["email_recipient"].join(who, "person_id", "left_semi").agg(n("received")))


def topic(t: Tables, word: str, since: Column, until: Column) -> DataFrame:
    body = F.col("subject").ilike(f"%{word}%") | F.col("body_text").ilike(f"%{word}%")
    return t["email_message"].where(body & F.col("received_at").between(since, until)).select("id", "subject", "received_at").orderBy(F.desc_nulls_last("received_at"), F.desc("id"))


def top_counterparties(t: Tables, k: int = 10) -> DataFrame:
    outside = t["company"].where("not is_internal").select(F.col("id").alias("company_id"), "name")
    return t["person_company"].join(outside, "company_id").groupBy("name").agg(F.countDistinct("person_id").alias("people")).orderBy(F.desc("people"), "name").limit(k)


def compliance_export(t: Tables, most: int = 1000) -> DataFrame:
    """The organisation with its newest audit rows, at most so many: one row."""
    newest = t["audit_log"].orderBy(F.desc("occurred_at"), F.desc("id")).limit(most).agg(F.sort_array(F.collect_list(F.struct("occurred_at", "id", "action", "actor_id")), asc=False).alias("audit"))
    return t["organizations"].crossJoin(newest)
