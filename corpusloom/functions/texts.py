"""Rules on headers, bodies and names of files as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .addresses import is_machine, strip

# fixed values: limits of stored fields
ADDRESS_MAX, HEADER_MAX, MESSAGE_ID_MAX, NAME_MAX = 320, 998, 998, 255
# fixed values: a subject that answers another one
REPLY_PREFIX = r"(?i)^\s*(re|aw|antw|sv|vs)\s*(\[\d+\])?\s*:"
# fixed values: precedences of bulk mail
BULK = ("bulk", "list", "junk", "auto_reply")
# fixed values: headers that are kept, in their usual spelling
RETAINED_HEADERS = (
    "Message-ID In-Reply-To References Date Subject From To Cc Reply-To Sender Return-Path Auto-Submitted Precedence "
    "List-Id List-Unsubscribe List-Post List-Archive Content-Type Content-Language Importance Priority X-Priority X-Auto-Response-Suppress"
).split()
# fixed values: headers that a reader who doesn't own the copy may see
SHARED_HEADERS = "Message-ID In-Reply-To References Date Subject From To Cc Reply-To Sender".split()
# fixed values: folders whose mail isn't taken in
BLOCKED_FOLDERS = ("trash", "deleted", "deleted items", "deleted messages", "junk", "spam", "drafts")
# fixed values: flags of such folders
BLOCKED_FLAGS = ("\\trash", "\\junk", "\\drafts")

MOJIBAKE = "Ã[\u0080-¿]|â€|Â[\u00a0-¿]"


def is_reply(in_reply_to: Column, subject: Column) -> Column:
    return F.coalesce(F.nullif(strip(in_reply_to), F.lit("")).isNotNull(), F.lit(False)) | F.coalesce(subject.rlike(REPLY_PREFIX), F.lit(False))


def header(headers: Column, name: str) -> Column:
    """First value of a header map (name -> values), whatever its case."""
    return F.get(F.get(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower()), F.lit(0))["value"], F.lit(0))


def is_automated_origin(sender: Column, headers: Column) -> Column:
    """A machine by its address, or Auto-Submitted other than no."""
    submitted = F.lower(strip(F.split_part(header(headers, "Auto-Submitted"), F.lit(";"), F.lit(1))))
    return is_machine(sender) | F.coalesce((submitted != "") & (submitted != "no"), F.lit(False))


def is_automated(sender: Column, headers: Column) -> Column:
    """Also mail that its precedence or list headers mark as bulk."""
    bulk = F.coalesce(F.lower(strip(header(headers, "Precedence"))).isin(*BULK), F.lit(False))
    return is_automated_origin(sender, headers) | bulk | header(headers, "List-Id").isNotNull() | header(headers, "List-Unsubscribe").isNotNull()


def sanitize(x: Column, limit: int) -> Column:
    """Without NUL, cut to a length."""
    return F.substring(F.replace(x, F.lit("\0"), F.lit("")), 1, limit)


def clean_message_id(x: Column) -> Column:
    """The first <...>, or the text, without brackets and inner white space; null if empty."""
    found = F.regexp_extract(x, "<([^<>]*)>", 1)
    return F.nullif(F.regexp_replace(F.when(found != "", found).otherwise(x), r"(?U)[\s<>]+", ""), F.lit(""))


def split_references(x: Column) -> Column:
    ids = F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit("<([^<>]+)>"), F.lit(1)), lambda i: F.regexp_replace(i, r"(?U)\s+", ""))
    return F.filter(ids, lambda i: i != "")


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(x, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def sanitize_body(x: Column) -> Column:
    """Line ends as \\n, no control characters but tab and line end, trimmed."""
    return strip(F.regexp_replace(F.regexp_replace(x, r"\r\n?", "\n"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""))


def serialize_row(cells: Column) -> Column:
    """Cells joined by ' | ', null as empty, line ends as spaces; a blank row is empty."""
    joined = F.array_join(F.transform(cells, lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " ")), " | ")
    return F.when(F.regexp_replace(joined, r"[\s|]", "") == "", "").otherwise(joined)


def serialize_table(rows: Column) -> Column:
    return F.array_join(F.filter(F.transform(rows, serialize_row), lambda r: r != ""), "\n")


def is_blocked_folder(name: Column, flags: Column | None = None) -> Column:
    """A trash, junk or drafts folder by a flag or by a whole segment of its path."""
    named = F.exists(F.split(name, "[./]"), lambda s: F.lower(strip(s)).isin(*BLOCKED_FOLDERS))
    if flags is None:
        return named
    return named | F.exists(flags, lambda f: F.lower(f).isin(*BLOCKED_FLAGS))


def retained_headers(headers: Column, kept: list[str] = RETAINED_HEADERS) -> Column:
    """The kept headers in their usual spelling; values of spellings of one name come together."""
    spelling = F.create_map(*[F.lit(x) for name in kept for x in (name.lower(), name)])
    entries = F.filter(F.map_entries(headers), lambda e: F.map_contains_key(spelling, F.lower(e["key"])))
    names = F.array_distinct(F.transform(entries, lambda e: F.element_at(spelling, F.lower(e["key"]))))
    values = lambda name: F.flatten(F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == F.lower(name)), lambda e: e["value"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, values(n))))


def has_mojibake(x: Column) -> Column:
    return x.rlike(MOJIBAKE)


def is_slug(x: Column) -> Column:
    return x.rlike(r"^[a-z0-9][a-z0-9-]*$")


def is_sha256(x: Column) -> Column:
    return x.rlike(r"^[0-9a-f]{64}$")


def entropy(x: Column) -> Column:
    """Shannon entropy of the characters, in bits each; 0 for an empty text."""
    chars = F.filter(F.split(x, ""), lambda c: c != "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda d: d == c)) / n
    return F.when(n > 0, -F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda t, c: t + share(c) * F.log2(share(c)))).otherwise(0.0)


def payload_kind(x: Column) -> Column:
    """zip, ole, tnef, pdf, empty or unknown by the first bytes; text is told by ``sources.messages``."""
    head = F.hex(F.substring(x, 1, 8))
    return F.when(F.length(x) == 0, "empty").when(head.startswith("504B0304"), "zip").when(head.startswith("D0CF11E0A1B11AE1"), "ole").when(head.startswith("789F3E22"), "tnef").when(F.hex(F.substring(x, 1, 1024)).contains("255044462D"), "pdf").otherwise("unknown")


def dedup_key(message_id: Column, sender: Column, subject: Column, instant: Column, recipients: Column, body: Column, html_digest: Column, attachments: Column, raw: Column) -> Column:
    """Content identity of a message; of its raw bytes without a usable id or with headers alone.

    Fields are joined by NUL in fixed places; ``recipients`` are kind:address of To and Cc,
    ``attachments`` the attachments' identities, both sorted here."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    known = F.concat_ws("\0", F.array_join(F.array_sort(attachments), "\0"))
    fields = F.concat(message_id, *(F.concat(F.lit("\0"), empty(c)) for c in (sender, subject, instant, F.array_join(F.array_sort(recipients), "|"), body, html_digest)), F.when(F.size(attachments) > 0, F.concat(F.lit("\0"), known)).otherwise(""))
    usable = message_id.isNotNull() & ~F.contains(message_id, F.lit("\0")) & (F.length(message_id) <= MESSAGE_ID_MAX)
    content = (empty(body) != "") | (empty(html_digest) != "") | (F.size(attachments) > 0)
    return F.concat(F.lit("sha256:"), F.when(F.coalesce(usable & content, F.lit(False)), F.sha2(fields.cast("binary"), 256)).otherwise(F.sha2(raw, 256)))
