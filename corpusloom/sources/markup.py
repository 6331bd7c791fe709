"""Flattening of HTML to text: no wrapping, no images, link texts stay, scripts and styles go."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
CELLS = frozenset(("td", "th"))
#: Raw text that is never shown.
HIDDEN = frozenset(("script", "style"))
#: What a head may hold: another tag ends it, since its own end may be left out.
IN_HEAD = frozenset("head title meta link base script style noscript template object".split())


class _Flattener(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = self.kept = 0
        self.head = False

    def handle_starttag(self, tag, attrs):
        self.head = tag == "head" or (self.head and tag in IN_HEAD)
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in BLOCKS:
            self.parts.append("\n- " if tag == "li" else "\n")
        elif tag in CELLS:
            self.parts.append(" ")
        if tag == "pre":
            self.kept += 1

    def handle_endtag(self, tag):
        if tag == "head":
            self.head = False
        elif tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCKS and tag != "br":
            self.parts.append("\n")
        if tag == "pre":
            self.kept = max(0, self.kept - 1)

    def handle_data(self, data):
        if not (self.hidden or self.head):
            self.parts.append(data if self.kept else re.sub(r"\s+", " ", data))


def flatten(markup: str) -> str:
    parser = _Flattener()
    try:
        parser.feed(markup)
        parser.close()
    except (AssertionError, ValueError, RecursionError):  # broken declarations: what came before stays
        pass
    lines = (re.sub(r"[ \t]+", " ", line).strip() for line in "".join(parser.parts).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


@F.pandas_udf(T.StringType())
def html_to_text(markup: pd.Series) -> pd.Series:
    return pd.Series([None if m is None else flatten(m) for m in markup], dtype=object)
