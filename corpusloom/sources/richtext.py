"""Rich text to plain text: control words go, paragraphs and tables stay apart."""

from __future__ import annotations

import re

TOKEN = re.compile(r"\\([a-zA-Z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\(.)|([{}])|[\r\n]+|([^\\{}\r\n]+)", re.DOTALL)
#: Groups whose text isn't part of the document.
APART = frozenset("fonttbl colortbl stylesheet listtable listoverridetable info pict object themedata colorschememapping datastore latentstyles generator header headerl headerr headerf footer footerl footerr footerf fldinst filetbl rsidtbl".split())
SHOWN = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "row": "\n", "tab": "\t", "cell": " | ", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "emspace": " ", "enspace": " "}


def flatten_rtf(source: str) -> str:
    """The text of an RTF source; escaped bytes are read in its declared code page, what can't be read is replaced."""
    page, out = "cp1252", []
    pending = bytearray()
    hidden, width, skip = False, 1, 0
    stack: list[tuple[bool, int]] = []

    def put(text: str) -> None:
        if pending:
            out.append(pending.decode(page, "replace"))
            pending.clear()
        out.append(text)

    for m in TOKEN.finditer(source):
        word, number, byte, sign, brace, text = m.groups()
        if brace == "{":
            stack.append((hidden, width))
        elif brace:
            hidden, width = stack.pop() if stack else (False, 1)
            skip = 0
        elif skip and (byte or text or sign):  # what stands in for a Unicode character
            if text and len(text) > skip:
                if not hidden:
                    put(text[skip:])
                skip = 0
            else:
                skip -= len(text) if text else 1
        elif word:
            if word in APART:
                hidden = True
            elif word == "ansicpg" and number:
                try:
                    b"".decode(f"cp{number}")
                    page = f"cp{number}"
                except LookupError:
                    pass
            elif word == "uc" and number:
                width = max(0, int(number))
            elif word == "u" and number:
                if not hidden:
                    code = int(number) % 65536
                    put(chr(code) if not 0xD800 <= code < 0xE000 else "\ufffd")
                skip = width
            elif word in SHOWN and not hidden:
                put(SHOWN[word])
        elif sign:
            if sign == "*":
                hidden = True
            elif not hidden:
                put({"~": "\u00a0", "_": "-", "-": "", "\n": "\n", "\r": "\n"}.get(sign, sign if sign in "\\{}" else ""))
        elif byte and not hidden:
            pending.append(int(byte, 16))
        elif text and not hidden:
            put(text)
    put("")
    return "".join(out).strip()
