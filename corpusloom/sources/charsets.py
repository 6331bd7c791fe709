"""Decoding of bytes whose charset is declared wrongly or not at all."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Non-ASCII bytes that a text must have for its script to be told.
SIGNAL = 16
ASCII = bytes(range(128))


def told_by_script(data: bytes) -> str | None:
    """The charset among UTF-8, cp1252 and cp1251 whose text hangs together, if there is enough to tell.

    Letters with accents stand between ASCII letters, Cyrillic ones next to each other: where most
    non-ASCII bytes have such a neighbour, they are Cyrillic."""
    high = len(data.translate(None, ASCII))
    if high < SIGNAL:
        return None
    try:
        data.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        pass
    paired = sum(len(run) for run in bytes(b if b > 127 else 32 for b in data).split() if len(run) > 1)
    order = ("cp1251", "cp1252") if 2 * paired > high else ("cp1252", "cp1251")
    for name in order:
        try:
            data.decode(name)
            return name
        except UnicodeDecodeError:
            continue
    return None


def decode(data: bytes, declared: str | None = None) -> str:
    """Strictly as declared (UTF-8 if nothing is), by script, as cp1252, as cp1251, else with replacements."""
    declared = declared or "utf-8"
    for name in (declared, told_by_script, "cp1252", "cp1251"):
        try:
            name = name(data) if callable(name) else name
            if name:
                return data.decode(name)
        except (LookupError, UnicodeDecodeError, ValueError):
            continue
    try:
        return data.decode(declared, errors="replace")
    except (LookupError, ValueError):
        return data.decode("utf-8", errors="replace")


def _as_single_bytes(text: str) -> bytes | None:
    for name in ("cp1252", "latin-1"):
        try:
            return text.encode(name)
        except UnicodeEncodeError:
            continue
    return None


def repair(text: str) -> str:
    """Text that was decoded by a wrong single-byte charset, as a whole or else line by line."""
    data = _as_single_bytes(text)
    if data is not None:
        return decode(data)
    lines = ((line, _as_single_bytes(line)) for line in text.split("\n"))
    return "\n".join(line if data is None else decode(data) for line, data in lines)


@F.pandas_udf(T.StringType())
def decode_chain(data: pd.Series, declared: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else decode(d, c) for d, c in zip(data, declared, strict=True)], dtype=object)


@F.pandas_udf(T.StringType())
def repair_text(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else repair(t) for t in texts], dtype=object)
