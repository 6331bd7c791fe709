"""Schemas of the message corpus: explicit types, never inferred.

Enumerations are strings with a known set of values; identifiers are strings derived from content, so
replays give equal rows.  Every child table carries its parent's tenant.
"""

from pyspark.sql import types as T

S, L, B, I, D = T.StringType(), T.LongType(), T.BooleanType(), T.IntegerType(), T.TimestampType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TENANT = {"id": S, "org_id": S}
SCOPED = {"visibility_scope": S, "origin_scope": S, "container_id": S}

RAW_MESSAGE = struct(org_id=S, connection_id=S, mailbox=S, folder=S, uidvalidity=L, uid=L, seq=L, raw=T.BinaryType(), internal_date=D)

RECIPIENT = struct(kind=S, address=S, name=S)
ATTACHMENT = struct(filename=S, content_type=S, size_bytes=L, content_hash=S, is_inline=B, content_id=S, payload=T.BinaryType())
PARSED = struct(
    dedup_key=S,
    message_id=S,
    in_reply_to=S,
    references=T.ArrayType(S),
    from_name=S,
    from_address=S,
    subject=S,
    sent_at=D,
    received_at=D,
    body_text=S,
    recipients=T.ArrayType(RECIPIENT),
    attachments=T.ArrayType(ATTACHMENT),
    direction=S,
    is_automated=B,
    is_automated_origin=B,
    is_reply=B,
    has_attachments=B,
    word_count=I,
    language=S,
    headers=T.MapType(S, T.ArrayType(S)),
    parse_status=S,
    secrets_redacted=I,
)

CELL = struct(ref=S, t=S, v=S, nf=S)
SHEET = struct(name=S, dims=struct(rows=I, cols=I), cells=T.ArrayType(CELL))
GRID = struct(format=S, truncated=B, sheets=T.ArrayType(SHEET))
EXTRACTION = struct(text=S, status=S, detail=S, extractor=S, version=S, grid=GRID)

EMAIL_MESSAGE = struct(
    **TENANT, connection_id=S, dedup_key=S, message_id=S, in_reply_to=S, references=T.ArrayType(S), from_name=S, from_address=S, from_person_id=S, subject=S, sent_at=D, received_at=D, body_text=S,
    direction=S, is_automated=B, is_reply=B, has_attachments=B, word_count=I, language=S, headers=T.MapType(S, T.ArrayType(S)), size_bytes=I, parse_status=S, **SCOPED, seq=L,
)
EMAIL_RECIPIENT = struct(**TENANT, email_id=S, kind=S, name=S, address=S, person_id=S, **SCOPED)
EMAIL_ATTACHMENT = struct(**TENANT, email_id=S, filename=S, content_type=S, size_bytes=L, content_hash=S, is_inline=B, content_id=S, extracted_text=S, extraction_status=S, extractor_name=S, extractor_version=S, extraction_detail=S, extracted_data=GRID)
PERSON = struct(**TENANT, display_name=S, is_internal=B, first_seen_at=D, last_seen_at=D)
PERSON_EMAIL = struct(org_id=S, person_id=S, email=S, source=S)
PERSON_ALIAS = struct(org_id=S, person_id=S, alias=S, source=S)
COMPANY = struct(**TENANT, name=S, is_internal=B)
COMPANY_DOMAIN = struct(org_id=S, company_id=S, domain=S, source=S)
PERSON_COMPANY = struct(org_id=S, person_id=S, company_id=S)
ACL_GRANT = struct(org_id=S, person_id=S, object_type=S, object_id=S, connection_id=S, provenance=S, granted_at=D, revoked_at=D)
SOURCE_IDENTITY = struct(org_id=S, person_id=S, source_type=S, external_id=S, verified=B, verified_at=D, verified_by_user_id=S)
AUDIT_LOG = struct(id=S, occurred_at=D, actor_type=S, actor_id=S, action=S, org_id=S, entity_type=S, entity_id=S, details=T.MapType(S, S))
FOLDER_CURSOR = struct(folder=S, uidvalidity=L, last_seen_uid=L, failed_uids=T.ArrayType(L))

# fixed values: sets that the corpus's rows are checked against
EXTRACTED_WITH_TEXT = ("extracted", "truncated", "extracted_partial_scanned")
RECIPIENT_KINDS = ("to", "cc", "bcc", "reply_to", "sender")
