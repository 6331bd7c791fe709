"""Rich text and mail containers, built byte by byte."""

import struct

import pytest

from corpusloom.sources import documents, richtext, tnef


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator x;}\pard Hello \b bold\b0\par next}", "Hello bold\nnext"),
        (r"{\rtf1\ansicpg1251 \'cf\'f0\'e8 \u1076?\uc0\u1077 z}", "При деz"),
        (r"{\rtf1 a\tab b\{c\}\\d{\pict 0102}\~e}", "a\tb{c}\\d e"),
        (r"{\rtf1\trowd a\cell b\cell\row}", "a | b |"),
        (r"{\rtf1\uc2\u8364 ??x{\uc1\u8364 ?y}\u8364 ??z}", "€x€y€z"),
        (r"{\rtf1 \'zz open", "zz open"),
        ("", ""),
        ("no markup", "no markup"),
    ],
)
def test_rich_text(source, text):
    assert richtext.flatten_rtf(source) == text


def literal(data):
    """Compressed rich text without any reference."""
    body = b"".join(b"\0" + data[i : i + 8] for i in range(0, len(data), 8))
    return struct.pack("<II4sI", len(body) + 12, len(data), b"LZFu", 0) + body


def test_compressed_rich_text():
    assert tnef.decompressed(literal(b"{\\rtf1 some text of several words}")) == b"{\\rtf1 some text of several words}"
    assert tnef.decompressed(struct.pack("<II4sI", 17, 5, b"MELA", 0) + b"plain") == b"plain"
    # a reference that runs into what it writes, and one into the preset
    whole = tnef.decompressed(struct.pack("<II4sI", 12 + 9, 20, b"LZFu", 0) + b"\x06" + b"a" + struct.pack(">H", 207 << 4 | 4) + struct.pack(">H", 0 << 4 | 3) + b"\0"[:0])
    assert whole == b"aaaaaaa{\\rtf"
    with pytest.raises(ValueError):
        tnef.decompressed(struct.pack("<II4sI", 0, 0, b"none", 0))


def attribute(name, data):
    return b"\1" + struct.pack("<II", name, len(data)) + data + b"\0\0"


def listed(**props):
    """Properties by hexadecimal identifier; str as Unicode, bytes as binary, int as a number."""
    out = struct.pack("<I", len(props))
    for name, value in props.items():
        kind, data = (0x1F, value.encode("utf-16-le") + b"\0\0") if isinstance(value, str) else (0x03, struct.pack("<i", value)) if isinstance(value, int) else (0x102, value)
        out += struct.pack("<HH", kind, int(name[1:], 16))
        out += data if kind == 3 else struct.pack("<II", 1, len(data)) + data + b"\0" * (-len(data) % 4)
    return out


def container(props, files=(), body=b""):
    out = struct.pack("<IH", tnef.SIGNATURE, 1)
    out += attribute(tnef.BODY, body) if body else b""
    out += attribute(tnef.MESSAGE_PROPS, props)
    for title, data, own in files:
        out += attribute(tnef.FILE_BEGINS, b"\0" * 14) + attribute(tnef.FILE_TITLE, title + b"\0") + attribute(tnef.FILE_DATA, data) + attribute(tnef.FILE_PROPS, own)
    return out


def test_container():
    rich = literal(b"{\\rtf1 The body\\par of it}")
    files = [(b"A~1.TXT", b"file text", listed(x3707="a [long] name.txt")), (b"b.bin", b"\0\1\2", listed(x0001=5)), (b"c.htm", b" <html><p>page</p>", listed()), (b"d.txt", b"  ", listed())]
    x = documents.extract("tnef", container(listed(x0E07=1, x1009=rich, x1000="plain"), files))
    assert x["status"] == "extracted" and x["extractor"] == "corpusloom-tnef"
    assert x["text"] == "The body\nof it\n\n[embedded: a long name.txt]\nfile text\n\n[embedded: b.bin] [unsupported_format]\n\n[embedded: c.htm]\npage\n\n[embedded: d.txt] [empty]"
    # each layer stands in for the one before it
    assert documents.extract("tnef", container(listed(x1009=b"broken", x1013=b"<b>html</b>", x1000="plain")))["text"] == "html"
    assert documents.extract("tnef", container(listed(x1000="plain")))["text"] == "plain" == documents.extract("tnef", container(listed(), body=b"plain\0"))["text"]
    assert documents.extract("tnef", container(listed(), [(b"b.bin", b"\0", listed())]))["status"] == "empty"
    assert documents.extract("tnef", b"no container")["status"] == "corrupt"
    many = documents.extract("tnef", container(listed(x1000="b"), [(b"n", b"t", listed())] * 70))["text"]
    assert many.count("[embedded: n]") == 64 and many.endswith("[+6 more embedded files skipped]")
    cut = container(listed(x1000="plain"), files)
    for k in range(0, len(cut), 7):  # never raises
        assert documents.extract("tnef", cut[:k])["status"] in ("corrupt", "empty", "extracted")


def test_routes(spark):
    kinds = ["text/rtf", "application/RTF", "application/ms-tnef", "application/vnd.ms-tnef", "application/pdf"]
    df = spark.createDataFrame([(k, 5) for k in kinds], "t string, n long")
    assert [r[0] for r in df.select(documents.route(df["t"], df["n"])).collect()] == ["rtf", "rtf", "tnef", "tnef", "pdf"]
    assert documents.extract("rtf", rb"{\rtf1 x\par y}")["text"] == "x\ny" and documents.extract("rtf", rb"{\rtf1 }")["status"] == "empty"


def keyed(payload, **more):
    from email.message import EmailMessage

    from corpusloom.sources import messages

    m = EmailMessage()
    m["From"], m["To"], m["Subject"], m["Message-ID"], m["Date"] = "a@x", "b@x", "s", "<1@x>", "Mon, 01 Jan 2024 10:00:00 +0000"
    m.set_content("text")
    m.add_attachment(payload, maintype="application", subtype=more.get("subtype", "ms-tnef"), filename=more.get("filename", "winmail.dat"))
    return messages.record(m.as_bytes())["dedup_key"]


def test_containers_of_one_interior_are_one():
    props, one, two = {"x1000": "body", "x0037": "subject", "x0E07": 1}, (b"a.txt", b"first", listed(x3707="a long.txt")), (b"b.txt", b"second", listed())
    base = container(listed(**props), [one, two])
    other = struct.pack("<IH", tnef.SIGNATURE, 777) + base[6:]  # another key
    turned = container(listed(**dict(reversed(props.items()))), [two, one])
    stamped = container(listed(**props, x0E06=5, x3008=9), [one, two])
    assert {tnef.interior(x) for x in (base, other, turned, stamped)} == {tnef.interior(base)}
    assert {keyed(x) for x in (base, other, turned, stamped)} == {keyed(base)} and keyed(base, subtype="octet-stream") == keyed(other, subtype="octet-stream")
    changed = [
        container(listed(**{**props, "x1000": "another"}), [one, two]), container(listed(**props), [one]), container(listed(**props), [one, one, two]), container(listed(**props), [one, (b"b.txt", b"Second", listed())]),
        container(listed(**props), [one, (b"c.txt", b"second", listed())]), container(listed(**props), [one, two], body=b"plain"), container(listed(**props), [(b"a.txt", b"second", listed(x3707="a long.txt")), (b"b.txt", b"first", listed())]),
    ]
    assert len({keyed(x) for x in [base, *changed]}) == len(changed) + 1
    # a container within: its interior counts, at any depth
    nested = lambda inner: container(listed(x1000="outer"), [(b"in.dat", container(listed(x1000="mid"), [(b"deep.dat", inner, listed())]), listed())])
    assert keyed(nested(base)) == keyed(nested(turned)) != keyed(nested(changed[0]))
    # what is no container is known by its bytes
    assert keyed(b"none") == keyed(b"none") != keyed(b"other") and keyed(base, filename="x.bin", subtype="octet-stream") != keyed(other, filename="x.bin", subtype="octet-stream")
