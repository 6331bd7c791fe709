"""Rules on names, headers, payloads and access as queries over the provided tables, each with SQL of its own.

The tables have no mail, so each query makes the odd cases of its rule from a row's number, the same way in both languages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import addresses as A
from ..functions import redact as R
from ..functions import texts as X
from ..operators import access, graph, sync
from ..sources import audit
from .adapters import spread, table

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def key() -> Column:
    return F.col("c_custkey")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def picked(n: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def listed(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


FOLDERS = ["INBOX/Trash", "Archive.Spam", "Sent", " junk ", "Trashcan", "a/Deleted Items/b", "Drafts.2024", "INBOX"]


@query(
    f"""SELECT c_custkey, len(list_filter(regexp_split_to_array(list_extract({listed(FOLDERS)}, c_custkey % 8 + 1), '[./]'), lambda x: lower(trim(x)) IN ('trash', 'deleted', 'deleted items', 'deleted messages', 'junk', 'spam', 'drafts'))) > 0 OR c_custkey % 7 = 0 AS blocked FROM customer"""
)
def blocked_folders(spark, sf):
    flags = F.when(key() % 7 == 0, F.array(F.lit("\\Seen"), F.lit("\\JUNK"))).otherwise(F.array(F.lit("\\HasChildren")))
    return table(spark, sf, "customer").select("c_custkey", X.is_blocked_folder(picked(key(), FOLDERS), flags).alias("blocked"))


@query("SELECT event_type AS folder, CAST(count(*) AS BIGINT) AS pending FROM events WHERE event_id >= CASE WHEN event_type = 'click' OR event_type LIKE 's%' THEN 1 ELSE 501 END GROUP BY event_type")
def pending_counts(spark, sf):
    """Messages after each folder's cursor: a folder of a new generation, and one without a cursor, from the beginning."""
    events = table(spark, sf, "events")
    folders = events.select(F.col("event_type").alias("folder")).distinct().withColumn("uidvalidity", F.length("folder").cast("long"))
    cursors = folders.where("folder not like 's%'").select("folder", F.when(F.col("folder") == "click", 99).otherwise(F.col("uidvalidity")).alias("uidvalidity"), F.lit(500).cast("long").alias("last_seen_uid"))
    found = sync.pending(events.select(F.col("event_type").alias("folder"), F.col("event_id").alias("uid")), folders, cursors)
    return found.groupBy("folder").agg(F.count(F.lit(1)).alias("pending"))


HEADS = ["504b0304", "d0cf11e0a1b11ae1", "789f3e22", "0a255044462d312e37", "00", ""]


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 6 THEN 'empty' ELSE list_extract(['zip', 'ole', 'tnef', 'pdf', 'unknown', 'unknown'], doc_id % 7 % 6 + 1) END AS kind FROM documents")
def payload_kinds(spark, sf):
    n = F.col("doc_id")
    body = F.encode(F.regexp_replace(F.coalesce("text", F.lit("")), "%PDF-", ""), "UTF-8")
    payload = F.when(n % 7 == 6, F.lit("").cast("binary")).otherwise(F.concat(F.unhex(picked(n % 7, HEADS)), F.lit("-").cast("binary"), body))
    return table(spark, sf, "documents").select("doc_id", X.payload_kind(payload).alias("kind"))


HOSTS = ["gmail.com", "xn--abc.de", "straße.de", "example.org", "GMX.de", "a.xn--b.com", "nodot", "bad_host.com", "ends.", "a b.com", "[10.0.0.1]"]


@query(
    f"""SELECT c_custkey, lower(h) IN ('gmail.com', 'gmx.de') AS generic, h LIKE 'xn--%' OR h LIKE '%.xn--%' AS punycode, h LIKE 'xn--%' OR h LIKE '%.xn--%' OR strlen(h) <> length(h) AS suspicious,
  NOT contains(h, '.') OR contains(h, '[') OR contains(h, '_') OR contains(h, ' ') OR h LIKE '%.' AS malformed FROM (SELECT c_custkey, list_extract({listed(HOSTS)}, c_custkey % 11 + 1) AS h FROM customer)"""
)
def host_flags(spark, sf):
    h = picked(key(), HOSTS)
    return table(spark, sf, "customer").select("c_custkey", A.is_generic(h).alias("generic"), A.is_punycode(h).alias("punycode"), A.is_suspicious_idn(h).alias("suspicious"), A.is_malformed(h).alias("malformed"))


@query(
    """SELECT c_custkey, c_custkey % 6 IN (0, 1) AS origin, c_custkey % 6 IN (0, 1, 3) OR c_custkey % 5 = 0 OR c_custkey % 7 = 0 AS automated FROM customer"""
)
def automated_flags(spark, sf):
    """Machine senders, Auto-Submitted other than no, bulk precedence, list headers in any spelling."""
    sender = F.when(key() % 6 == 0, "mail-noreply@x.org").otherwise("anna.reply@x.org")
    entry = lambda when, name, value: F.when(when, F.struct(F.lit(name).alias("key"), F.array(F.lit(value)).alias("value")))
    made = [entry(key() % 6 == 1, "auto-submitted", " Auto-Replied ; x=y"), entry(key() % 6 == 2, "Auto-Submitted", "No"), entry(key() % 6 == 3, "PRECEDENCE", " Bulk"), entry(key() % 6 == 4, "Precedence", "first-class"), entry(key() % 5 == 0, "list-id", "<l>"), entry(key() % 7 == 0, "List-Unsubscribe", "<u>")]
    headers = F.map_from_entries(F.array_compact(F.array(*made)))
    return table(spark, sf, "customer").select("c_custkey", X.is_automated_origin(sender, headers).alias("origin"), X.is_automated(sender, headers).alias("automated"))


@query(
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey || '@x.org' WHEN 1 THEN 'bare' || c_custkey WHEN 2 THEN NULL ELSE 'a@b' END AS message_id,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'r' || c_custkey || '@x,second' END AS reference_ids, left(c_name, 12) AS cut FROM customer"""
)
def message_ids(spark, sf):
    """Identifiers out of their brackets, lists of references, fields without NUL and cut to a length."""
    k = key().cast("string")
    raw = F.when(key() % 4 == 0, F.concat(F.lit(" x <"), k, F.lit(" @x.org> <z>"))).when(key() % 4 == 1, F.concat(F.lit(" bare "), k, F.lit(">"))).when(key() % 4 == 2, " <> ").otherwise("<a@\tb>")
    refs = F.when(key() % 3 == 0, F.when(key() % 2 == 0, "no brackets")).otherwise(F.concat(F.lit("<r"), k, F.lit(" @x> , <> < > <second>")))
    cut = X.sanitize(F.concat(F.left("c_name", F.lit(3)), F.lit("\0"), F.substring("c_name", 4, 100)), 12)
    return table(spark, sf, "customer").select("c_custkey", X.clean_message_id(raw).alias("message_id"), F.array_join(X.split_references(refs), ",").alias("reference_ids"), cut.alias("cut"))


@query("SELECT n_nationkey, n_name || ' |  | a b' || CASE WHEN n_nationkey % 2 = 0 THEN chr(10) || 'x | ' || n_nationkey ELSE '' END AS shown FROM nation")
def table_rows(spark, sf):
    """Cells by bars: nulls empty, line ends as spaces, blank rows left out."""
    text = lambda *cells: F.array(*(c if isinstance(c, Column) else F.lit(c).cast("string") for c in cells))
    second = F.when(F.col("n_nationkey") % 2 == 0, text("x", F.col("n_nationkey").cast("string"))).otherwise(text(None, "\n"))
    rows = F.array(text(F.col("n_name"), None, "a\r\nb"), text(" ", None), second)
    return table(spark, sf, "nation").select("n_nationkey", X.serialize_table(rows).alias("shown"))


@query(
    """SELECT c_custkey, regexp_full_match(s, '[a-z0-9][a-z0-9-]*') AS slug, regexp_full_match(h, '[0-9a-f]{64}') AS hashed
FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lower(replace(c_name, '#', '-')) WHEN 1 THEN c_name WHEN 2 THEN '-' || c_custkey ELSE '' || c_custkey END AS s, CASE c_custkey % 3 WHEN 0 THEN sha256(c_name) WHEN 1 THEN upper(sha256(c_name)) ELSE left(sha256(c_name), 63) END AS h FROM customer)"""
)
def slugs(spark, sf):
    slug = F.when(key() % 4 == 0, F.lower(F.replace("c_name", F.lit("#"), F.lit("-")))).when(key() % 4 == 1, F.col("c_name")).when(key() % 4 == 2, F.concat(F.lit("-"), key().cast("string"))).otherwise(key().cast("string"))
    digest = F.sha2("c_name", 256)
    hashed = F.when(key() % 3 == 0, digest).when(key() % 3 == 1, F.upper(digest)).otherwise(F.left(digest, F.lit(63)))
    return table(spark, sf, "customer").select("c_custkey", X.is_slug(slug).alias("slug"), X.is_sha256(hashed).alias("hashed"))


def _headers() -> Column:
    return F.create_map(F.lit("subject"), F.array("c_name"), F.lit("X-Secret"), F.array(F.lit("s")), F.lit("SUBJECT"), F.array(F.lit("b"), F.col("c_mktsegment")), F.lit("list-id"), F.array(F.lit("l")))


@query("SELECT c_custkey, 'List-Id,Subject' AS names, c_name || '|b|' || c_mktsegment AS subject, 'Subject' AS shared, CASE WHEN c_custkey % 2 = 0 THEN 'to,cc' ELSE 'to' END AS kinds FROM customer")
def kept_headers(spark, sf):
    """Headers in their usual spelling, with the values of all spellings, and what readers of another's copy see of it."""
    names = lambda m: F.array_join(F.array_sort(F.map_keys(m)), ",")
    kept = X.retained_headers(_headers())
    address = lambda kind: F.struct(F.lit(kind).alias("kind"), F.lit("a@x").alias("address"))
    recipients = F.when(key() % 2 == 0, F.array(address("to"), address("bcc"), address("cc"))).otherwise(F.array(address("bcc"), address("to")))
    rows = table(spark, sf, "customer").select("c_custkey", names(kept).alias("names"), F.array_join(F.element_at(kept, "Subject"), "|").alias("subject"), recipients.alias("recipients"), _headers().alias("headers"))
    seen = access.for_non_owner(rows)
    return seen.select("c_custkey", "names", "subject", names(F.col("headers")).alias("shared"), F.array_join(F.transform("recipients", lambda r: r["kind"]), ",").alias("kinds"))


@query(
    """SELECT o_orderkey AS object_id, c AS person_id, list_extract(['recipient', 'sender', 'owner'], max(r) + 1) AS provenance FROM (
  SELECT o_orderkey, o_custkey AS c, 1 AS r FROM orders UNION ALL SELECT o_orderkey, o_custkey + 1, 0 FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, o_custkey + 2, 2 FROM orders WHERE o_orderkey % 3 = 0)
WHERE c % 5 <> 0 AND c IN (SELECT c_custkey FROM customer) GROUP BY o_orderkey, c"""
)
def derived_grants(spark, sf):
    """Who a message's grants go to: verified identities alone, of several roles the highest; blank and reply-to rows give none."""
    orders = table(spark, sf, "orders")
    address = lambda n: F.concat(F.lit(" <P"), n.cast("string"), F.lit("@x> "))
    messages = orders.select(F.lit("o").alias("org_id"), F.col("o_orderkey").alias("id"), address(F.col("o_custkey")).alias("from_address"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("u"), (F.col("o_custkey") + 2).cast("string"))).alias("owner_user_id"))
    kind = picked(F.col("o_orderkey"), ["reply_to", "to", "cc", "bcc"])
    recipients = orders.select(F.lit("o").alias("org_id"), F.col("o_orderkey").alias("email_id"), kind.alias("kind"), address(F.col("o_custkey") + 1).alias("address"))
    people = table(spark, sf, "customer").select(F.lit("o").alias("org_id"), key().alias("person_id"), (key() % 5 != 0).alias("verified"))
    identities = people.select("*", F.lit("email").alias("source_type"), F.concat(F.lit("p"), F.col("person_id").cast("string"), F.lit("@x")).alias("external_id")).unionByName(people.select("*", F.lit("auth").alias("source_type"), F.concat(F.lit("u"), F.col("person_id").cast("string")).alias("external_id")))
    return access.derive(messages, recipients, identities).select("object_id", "person_id", "provenance")


@query("SELECT user_id, event_type, min(event_id) AS first FROM events WHERE event_id % 3 > 0 GROUP BY ALL")
def first_copies(spark, sf):
    """The first message of each content identity, of those that have one."""
    events = table(spark, sf, "events").where("event_id % 3 > 0")
    rows = events.select(F.col("user_id").alias("org_id"), F.lit("c").alias("connection_id"), F.col("event_type").alias("dedup_key"), F.col("event_id").alias("seq"))
    return graph.first_copies(rows).select(F.col("org_id").alias("user_id"), F.col("dedup_key").alias("event_type"), F.col("seq").alias("first"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'secrets_redacted=' || c_custkey ELSE 'note secrets_redacted=' || c_custkey END AS detail FROM customer")
def secret_markers(spark, sf):
    count = F.when(key() % 3 == 0, 0).otherwise(key())
    detail = F.when(key() % 3 == 2, "note")
    return table(spark, sf, "customer").select("c_custkey", R.with_marker(detail, count).alias("detail"))


@query("SELECT action, CAST(count(*) AS BIGINT) AS rows FROM (SELECT DISTINCT event_type AS action, user_id FROM events) GROUP BY action")
def audit_rows(spark, sf):
    """Rows of the audit log: one that is written twice is known by its identifier."""
    rows = table(spark, sf, "events").select(F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("actor_id"))
    found = audit.events(rows)
    return found.groupBy("action").agg(F.count_distinct("id").alias("rows"))


@query(
    """SELECT conv_id, turn, CASE WHEN len(words) = 0 THEN 'empty' ELSE 'extracted' END AS status, CASE WHEN len(words) > 0 THEN sha256(array_to_string(words, chr(10))) END AS text_sha256
FROM (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x20\\x7F:=]+') AS words FROM conversations)"""
)
def rtf_text(spark, sf):
    """Conversations as rich text, a word a line, letters beyond ASCII by their numbers."""
    from ..sources.documents import _extract

    escaped = lambda c: F.when(F.ascii(c) > 127, F.concat(F.lit("\\u"), F.ascii(c).cast("string"), F.lit("?"))).when(c.isin("\\", "{", "}"), F.concat(F.lit("\\"), c)).otherwise(c)
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^\\x00-\\x20\\x7F:=]+"), F.lit(0))
    lines = F.transform(words, lambda w: F.array_join(F.transform(F.split(w, ""), escaped), ""))
    rich = F.concat(F.lit("{\\rtf1\\ansi "), F.array_join(lines, "\\par "), F.lit("}"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", _extract(F.lit("rtf"), rich.cast("binary")).alias("x"))
    return rows.select("conv_id", "turn", "x.status", F.sha2("x.text", 256).alias("text_sha256"))


TYPES = ["text/plain", "TEXT/HTML", "application/pdf", "application/rtf", "image/png", "application/zip", "application/ms-tnef", "application/x-odd", "application/json", "application/vnd.ms-excel.sheet.macroEnabled.12"]


@query(
    f"""SELECT doc_id, CASE WHEN size = 0 THEN 'empty' WHEN size > 52428800 THEN 'skipped_oversize' ELSE list_extract(['text', 'html', 'pdf', 'rtf', 'skipped_nondocument', 'skipped_nondocument', 'tnef', 'unsupported_format', 'text', 'xlsx'], doc_id % {len(TYPES)} + 1) END AS way
FROM (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 0 WHEN doc_id % 17 = 0 THEN 52428801 ELSE n_chars + 1 END AS size FROM documents)"""
)
def attachment_routes(spark, sf):
    from ..sources.documents import route

    n = F.col("doc_id")
    size = F.when(n % 13 == 0, 0).when(n % 17 == 0, 52428801).otherwise(F.col("n_chars") + 1)
    return table(spark, sf, "documents").select("doc_id", route(picked(n, TYPES), size).alias("way"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'to:a' || c_custkey || '@x.org,to:b@x.org,cc:a' || c_custkey || '@x.org' ELSE 'to:a' || c_custkey || '@x.org,to:b@x.org' END AS recipients,
  CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-03-10 09:30:00' END AS sent_at, c_custkey % 5 = 0 AS is_automated, c_custkey % 7 = 0 AS is_reply, 'inbound' AS direction FROM customer"""
)
def parsed_headers(spark, sf):
    """Messages with repeated and oddly written recipients: the first of each kind and address counts."""
    from ..sources.messages import parse

    k = key().cast("string")
    line = lambda when, text: F.when(when, text + "\r\n").otherwise("")
    raw = F.concat(
        F.lit("From: Ann <ann@x.org>\r\nTo: N <a"), k, F.lit("@x.org>, b@x.org, A"), k, F.lit("@X.ORG, \"B, c\" <B@x.org>\r\n"), F.when(key() % 2 == 0, F.concat(F.lit("Cc: <a"), k, F.lit("@x.org>, A"), k, F.lit("@x.org\r\n"))).otherwise(""),
        line(key() % 3 == 0, "Date: Sun, 10 Mar 2024 10:30:00 +0100"), line(key() % 5 == 0, "Precedence: bulk"), line(key() % 7 == 0, "Subject: AW: [x]"), F.lit("Message-ID: <"), k, F.lit("@x.org>\r\n\r\nbody "), k,
    )
    rows = spread(table(spark, sf, "customer"), "c_custkey").select("c_custkey", parse(raw.cast("binary"), F.lit("own@x.org"), F.lit(None).cast("timestamp")).alias("m"))
    recipients = F.array_join(F.transform("m.recipients", lambda r: F.concat(r["kind"], F.lit(":"), r["address"])), ",")
    return rows.select("c_custkey", recipients.alias("recipients"), "m.sent_at", "m.is_automated", "m.is_reply", "m.direction")


_PLAIN = "regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x20\\x7F:=]+')"


def words() -> Column:
    return F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^\\x00-\\x20\\x7F:=]+"), F.lit(0))


def _office(ways, rows):
    """Files of words: a paragraph each, a cell each in a row of its own, or the body of a mail container."""
    import io
    import struct
    import zipfile
    from xml.sax.saxutils import escape

    import pandas as pd

    from ..sources import tnef

    def zipped(**members: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in members.items():
                z.writestr(name.replace("__", "/").replace("--", "."), text)
        return out.getvalue()

    def one(way: str, found) -> bytes:
        if way == "docx":
            body = "".join(f"<w:p><w:r><w:t>{escape(w)}</w:t></w:r></w:p>" for w in found)
            return zipped(**{"word__document--xml": f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>'})
        if way == "xlsx":
            cells = "".join(f'<row r="{i}"><c r="A{i}" t="inlineStr"><is><t>{escape(w)}</t></is></c></row>' for i, w in enumerate(found, 1))
            return zipped(**{"xl__workbook--xml": '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="i"/></sheets></workbook>', "xl___rels__workbook--xml--rels": '<x><Relationship Id="i" Target="s.xml"/></x>', "xl__s--xml": f"<worksheet><sheetData>{cells}</sheetData></worksheet>"})
        body = "\r\n".join(found).encode("utf-16-le") + b"\0\0"
        props = struct.pack("<IHHII", 1, 0x1F, 0x1000, 1, len(body)) + body + bytes(-len(body) % 4)
        return struct.pack("<IHBII", tnef.SIGNATURE, 1, 1, tnef.MESSAGE_PROPS, len(props)) + props + b"\0\0"

    return pd.Series([one(w, r) for w, r in zip(ways, rows, strict=True)], dtype=object)


@query(
    f"""SELECT conv_id, turn, way, CASE WHEN len(words) = 0 THEN 'empty' ELSE 'extracted' END AS status, CASE WHEN len(words) > 0 THEN sha256(CASE WHEN way = 'xlsx' THEN '[sheet: S]' || chr(10) || array_to_string(words[1:200], chr(10)) || CASE WHEN len(words) > 200 THEN chr(10) || '[+more rows]' ELSE '' END ELSE array_to_string(words, chr(10)) END) END AS text_sha256
FROM (SELECT conv_id, turn, list_extract(['docx', 'xlsx', 'tnef'], (conv_id + turn) % 3 + 1) AS way, {_PLAIN} AS words FROM conversations)"""
)
def office_text(spark, sf):
    """Conversations as documents, sheets and mail containers, and read again; a sheet's text shows 200 of its rows."""
    from ..sources.documents import _extract

    build = F.pandas_udf(_office, "binary")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", picked(F.col("conv_id") + F.col("turn"), ["docx", "xlsx", "tnef"]).alias("way"), words().alias("words"))
    read = rows.select("conv_id", "turn", "way", _extract("way", build("way", "words")).alias("x"))
    return read.select("conv_id", "turn", "way", "x.status", F.sha2("x.text", 256).alias("text_sha256"))


@query(f"SELECT conv_id, turn, sha256(array_to_string({_PLAIN}, ' ')) AS text_sha256 FROM conversations")
def html_words(spark, sf):
    """Conversations as pages, a word in each of several elements, with references for marks: all words come back in order."""
    from ..sources.markup import html_to_text

    escaped = lambda w: F.replace(F.replace(F.replace(w, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&#62;"))
    shown = F.transform(words(), lambda w, i: F.when(i % 3 == 0, F.concat(F.lit("<p>"), escaped(w), F.lit("</p>"))).when(i % 3 == 1, F.concat(F.lit("<div><b>"), escaped(w), F.lit("</b></div>"))).otherwise(F.concat(F.lit("<ul><li>"), escaped(w), F.lit("</ul>"))))
    page = F.concat(F.lit("<html><head><title>no</title><style>p{}</style></head><body><script>no()</script>"), F.array_join(shown, "<!-- no -->"), F.lit("</body></html>"))
    text = table(spark, sf, "conversations").select("conv_id", "turn", html_to_text(page).alias("text"))
    return text.select("conv_id", "turn", F.sha2(F.array_join(F.filter(F.split(F.regexp_replace("text", r"(?m)^\s*[-*•]\s+", ""), r"\s+"), lambda w: w != ""), " "), 256).alias("text_sha256"))
