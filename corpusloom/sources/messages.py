"""The RFC 822 parser: bytes of a message to one nested record. It never raises."""

from __future__ import annotations

import email
import email.policy
import email.utils
import functools
import hashlib
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from email.message import EmailMessage

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import addresses, texts
from ..functions.redact import redact
from . import tnef
from .charsets import decode
from .markup import flatten

CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff]")
REPLY = re.compile(texts.REPLY_PREFIX)
RETAINED = {name.lower(): name for name in texts.RETAINED_HEADERS}


def clean(text: str) -> str:
    return CONTROL.sub("", text.replace("\r\n", "\n").replace("\r", "\n")).strip()


def limited(text: str | None, size: int) -> str | None:
    if text is None:
        return None
    return CONTROL.sub("", str(text))[:size]


#: Header values up to so many characters are remembered in a Python worker, so many of them: mail repeats its correspondents.
KNOWN_SIZE, KNOWN = 512, 4096
_atom = "[A-Za-z0-9_+-]+"
_address = rf"{_atom}(?:\.{_atom})*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*"
_plain_mailbox = re.compile(rf'({_atom}(?: {_atom})* |"{_atom}(?:,? {_atom})*" |)<({_address})>|({_address})')
_separator = re.compile(", ?")
AUDIENCE = ("from", "to", "cc", "bcc", "reply-to", "sender")


def plain_pairs(value: str) -> list[tuple[str, str]] | None:
    """(name, address) of a list of addresses without comments, groups, escapes, encoded words or folds, as the library reads it
    too; None of any other."""
    found, at = [], 0
    while m := _plain_mailbox.match(value, at):
        found.append(((m[1] or "").strip(' "'), m[2] or m[3]))
        if m.end() == len(value):
            return found
        comma = _separator.match(value, m.end())
        if comma is None:
            return None
        at = comma.end()
    return None


def _unfolded(name: str, value: str) -> str:
    """The value of a header as the library shows it."""
    found = plain_pairs(value) if name.lower() in AUDIENCE else None
    if found is None:
        return str(email.policy.default.header_fetch_parse(name, value))
    shown = [(f'"{n}"' if "," in n else n, a) for n, a in found]
    return ", ".join(f"{n} <{a}>" if n else a for n, a in shown)


_known_unfolded = functools.lru_cache(KNOWN)(_unfolded)


def unfolded(name: str, value: str) -> str:
    return (_known_unfolded if len(value) <= KNOWN_SIZE else _unfolded)(name, value)


def raw_values(message: EmailMessage, name: str) -> list[tuple[str, str]]:
    return [(k, v) for k, v in message.raw_items() if k.lower() == name.lower()]


def header(message: EmailMessage, name: str) -> str | None:
    found = raw_values(message, name)
    if not found:
        return None
    try:
        return unfolded(*found[0])
    except Exception:  # the library's header parsers fail in many ways on broken headers
        return str(found[0][1])


def instant(value: str | None) -> datetime | None:
    """UTC; dates without a zone are taken as UTC."""
    try:
        found = email.utils.parsedate_to_datetime(value) if value else None
    except (TypeError, ValueError, IndexError):
        return None
    if found is None:
        return None
    found = found.replace(tzinfo=UTC) if found.tzinfo is None else found.astimezone(UTC)
    return found if 1 <= found.year <= 9999 else None


def pairs(message: EmailMessage, name: str) -> list[tuple[str, str]]:
    found = raw_values(message, name)
    try:
        values = [unfolded(k, v) for k, v in found]
    except Exception:  # as in header()
        values = [str(v) for _, v in found]
    plain = [plain_pairs(v) for v in values]
    if None not in plain:
        return [p for one in plain for p in one]
    return [(n, a) for n, a in email.utils.getaddresses(values) if a]


def part_text(part: EmailMessage) -> str:
    payload = part.get_payload(decode=True) or b""
    return decode(payload, part.get_content_charset())


def tokens_of(address: str, delimiters: str) -> list[str]:
    return [t for t in re.split(delimiters, address.rpartition("@")[0].lower() or address.lower()) if t]


def is_machine(address: str | None) -> bool:
    found = tokens_of(address or "", r"[-_.+]")
    joined = f" {' '.join(found)} "
    return any(t in addresses.MACHINE_TOKENS for t in found) or any(f" {p} " in joined for p in addresses.AUTOMATION_PHRASES)


def message_id(value: str | None) -> str | None:
    if not value:
        return None
    found = re.search(r"<([^<>]*)>", value)
    return re.sub(r"[\s<>]+", "", found[1] if found and found[1] else value) or None


def attachments(message: EmailMessage) -> list[dict]:
    parts = list(message.iter_attachments()) if message.is_multipart() else []
    if not message.is_multipart() and message.get_content_maintype() != "text":
        parts = [message]  # the message is the document
    found = []
    for part in parts:
        if part.get_content_type() == "message/rfc822":
            inner = part.get_payload()
            payload = inner[0].as_bytes() if isinstance(inner, list) and inner else b""
        else:
            payload = part.get_payload(decode=True) or b""
        found.append(
            {
                "filename": limited(part.get_filename(), texts.NAME_MAX),
                "content_type": part.get_content_type().lower(),
                "size_bytes": len(payload),
                "content_hash": hashlib.sha256(payload).hexdigest(),
                "is_inline": part.get_content_disposition() == "inline",
                "content_id": message_id(header(part, "Content-ID")),
                "payload": payload,
            }
        )
    return found


def identity(part: dict) -> str:
    """What an attachment is known by: its content's hash; of a mail container the digest of its interior, since servers
    write the same one anew for each copy."""
    if part["content_type"] in tnef.TYPES or (part["filename"] or "").lower() == "winmail.dat":
        try:
            return "tnef:" + tnef.interior(part["payload"])
        except ValueError:
            pass
    return part["content_hash"]


def dedup_key(message: EmailMessage, ident: str | None, body: str, html: str, parts: list[dict], raw: bytes) -> str:
    """The content identity that ``functions.texts.dedup_key`` defines, of a message's own fields."""
    if ident is None or "\0" in ident or len(ident) > texts.MESSAGE_ID_MAX or not (body or html or parts):
        return "sha256:" + hashlib.sha256(raw).hexdigest()
    stamp = header(message, "Date") or ""
    at = instant(stamp)
    audience = sorted(f"{kind}:{a.strip().lower()}" for kind in ("to", "cc") for _, a in pairs(message, kind))
    digest = lambda text: hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()
    known = sorted(f"{digest(p['filename'] or '')}:{identity(p)}" for p in parts)
    named = [CONTROL.sub("", header(message, n) or "")[: texts.HEADER_MAX] for n in ("From", "Subject")]
    fields = [ident, *named, at.isoformat() if at else stamp, "|".join(audience), body, digest(html.replace("\r\n", "\n").replace("\r", "\n")) if html else "", *known]
    return "sha256:" + hashlib.sha256("\0".join(fields).encode("utf-8", "backslashreplace")).hexdigest()


def record(raw: bytes, mailbox: str | None = None, internal_date: datetime | None = None) -> dict:
    """Fields of ``schemas.PARSED``; a message that can't be parsed gives a stub with status failed."""
    try:
        return _record(raw, mailbox, internal_date)
    except Exception:  # one message must not stop a batch
        stub = dict.fromkeys(schemas.PARSED.fieldNames())
        empty = {"references": [], "recipients": [], "attachments": [], "headers": {}, "body_text": "", "word_count": 0, "secrets_redacted": 0}
        flags = dict.fromkeys(("is_automated", "is_automated_origin", "is_reply", "has_attachments"), False)
        return stub | empty | flags | {"dedup_key": "sha256:" + hashlib.sha256(raw).hexdigest(), "received_at": internal_date, "parse_status": "failed"}


def _record(raw: bytes, mailbox: str | None, internal_date: datetime | None) -> dict:
    message = email.message_from_bytes(raw, policy=email.policy.default)
    ident = message_id(header(message, "Message-ID"))
    html_part = message.get_body(preferencelist=("html",))
    plain_part = message.get_body(preferencelist=("plain",))
    html = part_text(html_part) if html_part is not None else ""
    body = clean(part_text(plain_part)) if plain_part is not None else ""
    if not body and html:
        body = clean(flatten(html))
    parts = attachments(message)
    key = dedup_key(message, ident, body, html, parts, raw)
    body, secrets = redact(body)
    kept: dict[str, list[str]] = {}
    for name, _ in message.raw_items():
        if name.lower() in RETAINED and RETAINED[name.lower()] not in kept:
            kept[RETAINED[name.lower()]] = [limited(str(v), 1 << 16) for k, v in message.raw_items() if k.lower() == name.lower()]
    recipients, seen = [], set()
    for kind, name in (("to", "To"), ("cc", "Cc"), ("bcc", "Bcc"), ("reply_to", "Reply-To"), ("sender", "Sender")):
        for shown, address in pairs(message, name):
            address = limited(address.strip(), texts.ADDRESS_MAX)
            if address and (kind, address.lower()) not in seen:
                seen.add((kind, address.lower()))
                recipients.append({"kind": kind, "address": address, "name": limited(shown, texts.NAME_MAX) or None})
    senders = pairs(message, "From")
    sender = limited(senders[0][1].strip(), texts.ADDRESS_MAX) if senders else None
    subject = limited(header(message, "Subject"), texts.HEADER_MAX)
    answered = message_id(header(message, "In-Reply-To"))
    received = header(message, "Received")
    sent = instant(header(message, "Date"))
    submitted = (header(message, "Auto-Submitted") or "").split(";")[0].strip().lower()
    origin = is_machine(sender) or (submitted not in ("", "no"))
    bulk = (header(message, "Precedence") or "").strip().lower() in texts.BULK or header(message, "List-Id") is not None or header(message, "List-Unsubscribe") is not None
    own, other = (mailbox or "").strip().lower(), (sender or "").strip().lower()
    return {
        "dedup_key": key,
        "message_id": limited(ident, texts.MESSAGE_ID_MAX),
        "in_reply_to": limited(answered, texts.MESSAGE_ID_MAX),
        "references": [re.sub(r"\s+", "", r) for r in re.findall(r"<([^<>]+)>", header(message, "References") or "")],
        "from_name": limited(senders[0][0], texts.NAME_MAX) or None if senders else None,
        "from_address": sender,
        "subject": subject,
        "sent_at": sent,
        "received_at": internal_date or (instant(received.rpartition(";")[2].strip()) if received and ";" in received else None) or sent,
        "body_text": body,
        "recipients": recipients,
        "attachments": parts,
        "direction": ("outbound" if own == other else "inbound") if own and other else None,
        "is_automated": origin or bulk,
        "is_automated_origin": origin,
        "is_reply": bool(answered) or bool(REPLY.search(subject or "")),
        "has_attachments": any(not p["is_inline"] for p in parts),
        "word_count": len(body.split()),
        "language": None,
        "headers": kept,
        "parse_status": "parsed",
        "secrets_redacted": secrets,
    }


@F.pandas_udf(schemas.PARSED)
def _parse(raw: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for data, mailbox, at in raw:
        stamps = [None if pd.isna(t) else t.to_pydatetime().replace(tzinfo=UTC) for t in at]
        rows = [record(d or b"", m, t) for d, m, t in zip(data, mailbox, stamps, strict=True)]
        yield pd.DataFrame(rows, columns=schemas.PARSED.fieldNames())


def parse(raw: Column, mailbox: Column, internal_date: Column) -> Column:
    """The nested record of each message."""
    return _parse(raw, mailbox, internal_date)


@F.pandas_udf(T.StringType())
def _looks_like_text(data: pd.Series) -> pd.Series:
    def kind(d):
        head = (d or b"")[:4096]
        return "text" if head and b"\0" not in head and sum(c < 32 and c not in b"\t\n\r\f" for c in head) * 50 < len(head) else "unknown"

    return pd.Series([kind(d) for d in data], dtype=object)


def payload_kind(data: Column) -> Column:
    """zip, ole, tnef, pdf, text, empty or unknown; only what no signature tells goes through Python."""
    known = texts.payload_kind(data)
    return F.when(known != "unknown", known).otherwise(_looks_like_text(F.substring(data, 1, 4096)))


def to_rows(parsed: DataFrame) -> dict[str, DataFrame]:
    """Three tables of parsed messages (org_id, connection_id, seq, raw_size, m): messages are born restricted."""
    ident = F.sha2(F.concat_ws("\0", F.lit("message"), "org_id", "connection_id", "m.dedup_key"), 256)
    rows = parsed.withColumn("__id", ident)
    scope = {"visibility_scope": F.lit("restricted"), "origin_scope": F.lit("restricted"), "container_id": F.col("connection_id")}
    own = [c for c in schemas.EMAIL_MESSAGE.fieldNames() if c in schemas.PARSED.fieldNames()]
    message = rows.select(F.col("__id").alias("id"), "org_id", "connection_id", *(F.col(f"m.{c}") for c in own), F.col("raw_size").cast("int").alias("size_bytes"), *(v.alias(k) for k, v in scope.items()), "seq")
    recipient = rows.select("org_id", "connection_id", F.col("__id").alias("email_id"), F.posexplode("m.recipients").alias("place", "r"))
    recipient = recipient.select(F.sha2(F.concat_ws("\0", F.lit("recipient"), "email_id", "place"), 256).alias("id"), "org_id", "email_id", "r.kind", "r.name", "r.address", *(v.alias(k) for k, v in scope.items()))
    part = rows.select("org_id", F.col("__id").alias("email_id"), F.posexplode("m.attachments").alias("place", "a"))
    part = part.select(F.sha2(F.concat_ws("\0", F.lit("attachment"), "email_id", "place"), 256).alias("id"), "org_id", "email_id", "a.*")
    return {"email_message": message, "email_recipient": recipient, "email_attachment": part}
