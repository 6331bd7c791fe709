"""Containers that some mail programs wrap a message's body and files in, by their published format."""

from __future__ import annotations

import hashlib
import struct

from .charsets import decode
from .markup import flatten
from .richtext import flatten_rtf

# fixed values: signatures and names of attributes and properties of the format
SIGNATURE = 0x223E9F78
BODY, MESSAGE_PROPS, FILE_BEGINS, FILE_DATA, FILE_TITLE, FILE_PROPS = 0x0002800C, 0x00069003, 0x00069002, 0x0006800F, 0x00018010, 0x00069005
PLAIN, COMPRESSED_RTF, HTML, FILE_BYTES, SHORT_NAME, LONG_NAME = 0x1000, 0x1009, 0x1013, 0x3701, 0x3704, 0x3707
WIDTHS = {0x02: 4, 0x03: 4, 0x04: 4, 0x05: 8, 0x06: 8, 0x07: 8, 0x0A: 4, 0x0B: 4, 0x14: 8, 0x40: 8, 0x48: 16}
VARIABLE = (0x0D, 0x1E, 0x1F, 0x102)
# fixed values: what the dictionary of compressed rich text begins with
PRESET = (
    b"{\\rtf1\\ansi\\mac\\deff0\\deftab720{\\fonttbl;}{\\f0\\fnil \\froman \\fswiss \\fmodern \\fscript \\fdecor MS Sans SerifSymbolArialTimes New RomanCourier"
    b"{\\colortbl\\red0\\green0\\blue0\r\n\\par \\pard\\plain\\f0\\fs20\\b\\i\\u\\tab\\tx"
)
# fixed values: bounds
FILES_MAX, RTF_MAX, SOURCE_MAX, NAME_MAX = 64, 8 << 20, 16 << 20, 80


def decompressed(data: bytes) -> bytes:
    """Compressed rich text: literals and references into a ring of the last 4096 bytes."""
    packed, size, kind, _ = struct.unpack_from("<II4sI", data)
    if kind == b"MELA":
        return data[16 : 16 + size]
    if kind != b"LZFu":
        raise ValueError("unknown compression")
    ring, at, out, place = bytearray(PRESET.ljust(4096, b" ")), len(PRESET), bytearray(), 16
    stop = min(len(data), packed + 4)
    while place < stop:
        flags, place = data[place], place + 1
        for bit in range(8):
            if place >= stop:
                break
            if flags >> bit & 1:
                pair, place = int.from_bytes(data[place : place + 2], "big"), place + 2
                source, length = pair >> 4, (pair & 15) + 2
                if source == at:
                    return bytes(out)
                for k in range(length):
                    byte = ring[(source + k) & 4095]
                    ring[at] = byte
                    at = (at + 1) & 4095
                    out.append(byte)
            else:
                out.append(data[place])
                ring[at] = data[place]
                at, place = (at + 1) & 4095, place + 1
    return bytes(out)


def attributes(payload: bytes):
    """(attribute, data) of a container; a broken one ends where it breaks, one without the signature raises."""
    if len(payload) < 6 or struct.unpack_from("<I", payload)[0] != SIGNATURE:
        raise ValueError("no signature")
    at = 6
    while at + 9 <= len(payload):
        name, size = struct.unpack_from("<II", payload, at + 1)
        if at + 9 + size > len(payload):
            return
        yield name, payload[at + 9 : at + 9 + size]
        at += 9 + size + 2


def properties(data: bytes) -> dict[int, tuple[int, bytes]]:
    """identifier -> (type, first value) of a property list."""
    found: dict[int, tuple[int, bytes]] = {}
    (count,) = struct.unpack_from("<I", data)
    at = 4
    for _ in range(count):
        kind, ident = struct.unpack_from("<HH", data, at)
        at += 4
        if ident >= 0x8000:  # named
            at += 16
            (by_name,) = struct.unpack_from("<I", data, at)
            (size,) = struct.unpack_from("<I", data, at + 4)
            at += 8 + (-(-size // 4) * 4 if by_name else 0)
        many, kind = kind & 0x1000, kind & 0x0FFF
        values = 1
        if many or kind in VARIABLE:
            (values,) = struct.unpack_from("<I", data, at)
            at += 4
        for k in range(values):
            size = WIDTHS.get(kind)
            step = size
            if kind in VARIABLE:
                (size,) = struct.unpack_from("<I", data, at)
                at += 4
                step = -(-size // 4) * 4
            elif size is None:
                raise ValueError("unknown property type")
            if at + size > len(data):
                raise ValueError("property beyond its list")
            if k == 0:
                found[ident] = kind, data[at : at + size]
            at += step
    return found


def string(value: tuple[int, bytes] | None) -> str:
    if value is None:
        return ""
    kind, data = value
    return (data.decode("utf-16-le", "replace") if kind == 0x1F else decode(data)).rstrip("\0")


def safe_name(name: str) -> str:
    """A name that can't be taken for a mark of its own."""
    return "".join(c for c in name if c not in "[]\u2028\u2029" and ord(c) >= 32 and not 127 <= ord(c) < 160)[:NAME_MAX].strip() or "unnamed"


def body_of(props: dict[int, tuple[int, bytes]], plain: bytes) -> tuple[str, str]:
    """The body's text and what it was taken from: rich text, then HTML, then plain."""

    def rich() -> str:
        data = props[COMPRESSED_RTF][1]
        return flatten_rtf(decompressed(data).decode("latin-1")) if len(data) <= RTF_MAX else ""

    def html() -> str:
        kind, data = props[HTML]
        return flatten(string((kind, data)) if kind == 0x1F else decode(data)) if len(data) <= SOURCE_MAX else ""

    for kind, read in (("rtf", rich), ("html", html), ("plain", lambda: string(props.get(PLAIN)) or decode(plain).rstrip("\0"))):
        try:
            text = read().strip()
        except (KeyError, ValueError, IndexError, struct.error):  # the next layer
            continue
        if text:
            return text, kind
    return "", "none"


# fixed values: content types, and identifiers of properties that tell when and by what a container was written, not what is in it
TYPES = ("application/ms-tnef", "application/vnd.ms-tnef")
VOLATILE = frozenset((0x0E06, 0x0E08, 0x0E0F, 0x0E20, 0x0E21, 0x0FF8, 0x0FF9, 0x3007, 0x3008, 0x300B, 0x370B))
#: Containers within containers that are looked into.
DEPTH_MAX = 8


def digest_of(*parts: bytes) -> bytes:
    """A digest of parts, each by its length, so that no two lists of parts are one."""
    found = hashlib.sha256()
    for part in parts:
        found.update(len(part).to_bytes(8, "big") + part)
    return found.digest()


def interior(payload: bytes, depth: int = 0) -> str:
    """A digest of what is in a container: its body, its properties and its files, each in no order, and of files that are
    containers themselves their interior.  Numbers of attributes, the container's key and stamps of the writing aren't in it.
    Raises ValueError for what is no container."""
    plain, props, files = b"", [], []
    for name, data in attributes(payload):
        if name == BODY:
            plain = data.rstrip(b"\0")
        elif name == MESSAGE_PROPS:
            props.append(_properties_digest(data))
        elif name == FILE_BEGINS:
            files.append({"title": b"", "data": b"", "props": b""})
        elif files and name == FILE_TITLE:
            files[-1]["title"] = data.rstrip(b"\0")
        elif files and name == FILE_DATA:
            files[-1]["data"] = _data_digest(data, depth)
        elif files and name == FILE_PROPS:
            files[-1]["props"] = _properties_digest(data)
    inner = sorted(digest_of(b"file", f["title"], f["data"], f["props"]) for f in files)
    return digest_of(b"container", plain, *sorted(props), *inner).hex()


def _data_digest(data: bytes, depth: int) -> bytes:
    if depth < DEPTH_MAX and len(data) >= 6 and data[:4] == struct.pack("<I", SIGNATURE):
        return digest_of(b"inner", interior(data, depth + 1).encode())
    return digest_of(b"data", data)


def _properties_digest(data: bytes) -> bytes:
    try:
        found = properties(data)
    except (ValueError, struct.error):  # a broken list counts as it is
        return digest_of(b"broken", data)
    return digest_of(b"properties", *sorted(digest_of(k.to_bytes(2, "big"), kind.to_bytes(2, "big"), value) for k, (kind, value) in found.items() if k not in VOLATILE))


def contents(payload: bytes) -> tuple[str, str, list[tuple[str, bytes]]]:
    """Body, its kind, and the embedded files as (name, bytes)."""
    props, plain, files = {}, b"", []
    for name, data in attributes(payload):
        try:
            if name == BODY:
                plain = data
            elif name == MESSAGE_PROPS:
                props = properties(data)
            elif name == FILE_BEGINS:
                files.append(["", b""])
            elif name == FILE_TITLE and files:
                files[-1][0] = files[-1][0] or decode(data).rstrip("\0")
            elif name == FILE_DATA and files:
                files[-1][1] = data
            elif name == FILE_PROPS and files:
                own = properties(data)
                files[-1][0] = string(own.get(LONG_NAME)) or files[-1][0] or string(own.get(SHORT_NAME))
        except (ValueError, struct.error):  # a broken list of properties
            continue
    body, kind = body_of(props, plain)
    return body, kind, [(safe_name(n), d) for n, d in files]
