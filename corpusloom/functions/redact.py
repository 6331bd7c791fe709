"""Masking of secrets: typed placeholders for what is certainly a credential, nothing else touched.

Tokens whose shape tells their kind are replaced by native expressions.  Values that count only by their
entropy need a decision for each match: an Arrow function makes those.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE_MIN, ENTROPY_MIN = 12, 3.0
# fixed values: shapes of tokens
TOKENS = {
    "aws_access_key": r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASCA)[0-9A-Z]{16}\b",
    "openai_key": r"\bsk-(?:proj-|ant-|svcacct-)?[A-Za-z0-9_-]{20,}\b",
    "google_api_key": r"\bAIza[0-9A-Za-z_-]{35}\b",
    "github_token": r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{20,}\b|\bgithub_pat_[A-Za-z0-9_]{20,}\b",
    "slack_token": r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    "stripe_key": r"\b(?:sk|rk)_live_[A-Za-z0-9]{20,}\b",
    "jwt_token": r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*",
}
# fixed values: names of keys whose values count by their entropy
KEY_NAMES = (
    "password passwd pwd secret secret_key apikey api_key api-key accesskey access_key access-key authtoken auth_token auth-token "
    "accesstoken access_token access-token clientsecret client_secret client-secret privatekey private_key private-key token"
).split()
#: The longer ones first, so that a name is taken as a whole.
NAMES = sorted(KEY_NAMES, key=len, reverse=True)
#: Characters that end an assigned value, and a part of a server's address.
ENDS, PARTS = "\"';,}", ":/@"
SCHEME_MAX, USER_MAX = 32, 256

_shapes = [(f"[REDACTED:{kind}]", re.compile(shape)) for kind, shape in TOKENS.items()]
_rule = re.compile("-----(BEGIN|END) ([A-Z0-9 ]*)-----")
_name = re.compile("(?<![A-Za-z0-9])(?:" + "|".join(NAMES) + ")", re.IGNORECASE)
_value, _part, _gap = re.compile(rf"[^\s{ENDS}]*"), re.compile(rf"[^\s{PARTS}]*"), re.compile(r"\s*")
#: Pieces of text of which every match of a token's shape holds one.
PIECES = {
    "aws_access_key": "AKIA ASIA AGPA AIDA AROA AIPA ANPA ANVA ASCA", "openai_key": "sk-", "google_api_key": "AIza", "github_token": "ghp_ gho_ ghu_ ghs_ ghr_ github_pat_",
    "slack_token": "xox", "stripe_key": "_live_", "jwt_token": "eyJ",
}
#: In Java's form what follows a key's name, and a name before it; white space is only ever narrower here than above.
_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]*"
FOLLOWS = rf"[:=]{_SPACE}[\"']?[^\s{ENDS}]{{{VALUE_MIN}}}"
ASSIGNED = "(?iu:" + "|".join(NAMES) + rf")[\"']?{_SPACE}{FOLLOWS}"
ADDRESS = rf"://[^\s:/@]{{1,{USER_MAX}}}:[^\s:/@]{{{VALUE_MIN}}}"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def key_blocks(text: str):
    """Begin and end of each block of a private key: from a heading to the next footing, with no heading in between."""
    begin = None
    for m in _rule.finditer(text):
        if m[2] != "PRIVATE KEY" and not m[2].endswith(" PRIVATE KEY"):
            continue
        if m[1] == "BEGIN":
            begin = m.start()
        elif begin is not None:
            yield begin, m.end()
            begin = None


def assigned(text: str):
    """Begin and end of the value after each name of a key and a colon or equals sign; quotes around either stay outside."""
    done = 0
    for m in _name.finditer(text):
        at = m.end()
        if m.start() < done:  # within the value before
            continue
        at += text[at : at + 1] in ("'", '"')
        at = _gap.match(text, at).end()
        if text[at : at + 1] not in (":", "="):
            continue
        at = _gap.match(text, at + 1).end()
        at += text[at : at + 1] in ("'", '"')
        end = _value.match(text, at).end()
        if end - at >= VALUE_MIN:
            yield at, end
            done = end


def passwords(text: str):
    """Begin and end of the password in each address scheme://user:password@host."""
    done, at = 0, text.find("://")
    while at >= 0:
        begin = at
        while begin > max(done, at - SCHEME_MAX) and text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "+.-"):
            begin -= 1
        user = _part.match(text, at + 3).end()
        if any(c.isalpha() for c in text[begin:at]) and 0 < user - at - 3 <= USER_MAX and text[user : user + 1] == ":":
            end = _part.match(text, user + 1).end()
            host = re.compile(r"[^\s/@]*").match(text, end + 1).end() if text[end : end + 1] == "@" else 0
            if end - user - 1 >= VALUE_MIN and host > end + 1:
                yield user + 1, end
                done = host
        at = text.find("://", at + 3)


def masked(text: str, places, mark: str, gated: bool) -> tuple[str, int]:
    """The text with a mark in these places; ``gated``: only for values of high entropy that aren't masked yet."""
    out, at, count = [], 0, 0
    for begin, end in places:
        value = text[begin:end]
        if not gated or not value.startswith("[REDACTED:") and entropy(value) >= ENTROPY_MIN:
            out += [text[at:begin], mark]
            at, count = end, count + 1
    return "".join([*out, text[at:]]), count


def redact(text: str) -> tuple[str, int]:
    """The masked text and the number of secrets, of texts of any length. A masked text stays as it is."""
    if not text:
        return text, 0
    text, count = masked(text, key_blocks(text), "[REDACTED:private_key]", False) if " KEY-----" in text else (text, 0)
    for mark, shape in _shapes:
        text, n = shape.subn(mark, text)
        count += n
    for places, mark in ((assigned, "[REDACTED:credential]"), (passwords, "[REDACTED:connection_password]")):
        text, n = masked(text, places(text), mark, True)
        count += n
    return text, count


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("count", T.IntegerType())]))
def redact_secrets(texts: pd.Series) -> pd.DataFrame:
    rows = [(None, 0) if t is None else redact(t) for t in texts]
    return pd.DataFrame(rows, columns=["text", "count"])


def candidate(x: Column) -> Column:
    """Whether a detector could match: by looks for short texts first, which cost little, and by patterns where one is there."""
    found = x.contains(" KEY-----") | x.contains("://") & x.rlike(ADDRESS) | x.rlike(FOLLOWS) & x.rlike(ASSIGNED)
    for kind, pieces in PIECES.items():
        held = functools.reduce(lambda a, b: a | b, (x.contains(p) for p in pieces.split()))
        found = found | held & x.rlike(TOKENS[kind])
    return found


def redacted(x: Column) -> Column:
    """``redact_secrets``, with only the texts that a detector could match handed to Python."""
    found = redact_secrets(F.when(candidate(x), x))
    return F.struct(F.coalesce(found["text"], x).alias("text"), F.coalesce(found["count"], F.lit(0)).alias("count"))


def redact_tokens(x: Column) -> Column:
    """The token shapes alone, natively; ``(?U)`` gives word edges their Unicode meaning."""
    for kind, shape in TOKENS.items():
        x = F.regexp_replace(x, "(?U)" + shape, rf"[REDACTED:{kind}]")
    return x


def count_tokens(x: Column) -> Column:
    """Native count of token shapes, each after the replacement of those before it: marks that weren't there before."""
    mark = F.lit(rf"\[REDACTED:(?:{'|'.join(TOKENS)})\]")
    return F.coalesce(F.regexp_count(redact_tokens(x), mark) - F.regexp_count(x, mark), F.lit(0))


def with_marker(detail: Column, count: Column) -> Column:
    return F.when(count > 0, F.concat_ws(" ", detail, F.concat(F.lit("secrets_redacted="), count))).otherwise(detail)
