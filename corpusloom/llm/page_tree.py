"""Pages as trees of blocks, and union-free regular expressions over such trees.

A page's tokens are tags of blocks and texts; inline markup belongs to the text it stands in.  An expression is a list of
items: a text slot, an element with a list of its own, or a group of items in a row; each may be optional, repeated or both.
Two lists are aligned by their keys: what only one of them has becomes optional, equal neighbours become one repeated
item.  A page's own tree is folded by the same rules, so that pages of one template have few shapes.
"""

from __future__ import annotations

import functools
import html
import json
import re
from collections.abc import Callable
from difflib import SequenceMatcher

#: Items of the longest group that is looked for as a repeated one.
PERIOD = 4
#: Elements below this depth open no level of their own; their texts stay.
DEPTH = 96
OPTIONAL, REPEATED = 1, 2

# Fixed values of HTML: elements by how they behave.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
#: What a start tag ends if it is still open, up to one of the elements that hold such parts.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot"), ("table",)), "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",)), "body": (("head",), ()),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)((?:[^<>\"']++|\"[^\"]{0,8192}\"|'[^']{0,8192}')*+(?=>)|[^<>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_raw_end = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}


class Item:
    """An item of an expression: ``key`` tells what it may be aligned with; ``items`` of an element or group, ``held`` of a slot."""

    __slots__ = ("key", "q", "items", "held")

    def __init__(self, key: str, q: int = 0, items: list | None = None, held=None):
        self.key, self.q, self.items, self.held = key, q, items, held


SLOT = "#"


@functools.lru_cache(4096)
def signature(name: str, attributes: str) -> str:
    """An element's key: its name, and classes, identifier and role with numbers left out; ``!`` if it isn't shown."""
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    words = sorted({re.sub(r"\d+", "", w).lower() for k in ("class", "id", "role") for w in found.get(k, "").split()} - {""})
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I)
    return ".".join([name, *words]) + ("!" if hidden else "")


def parsed(page: str) -> tuple[list[Item], list[tuple[str, int]]]:
    """The tree of a page, its slots holding the numbers of texts, and these: (text, characters of it in links)."""
    root = Item("")
    root.items = []
    stack, names, texts = [root], [""], []
    pieces, linked, link, deep = [], 0, 0, 0

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                stack[-1].items.append(Item(SLOT, 0, None, [len(texts)]))
                texts.append((text, min(linked, len(text))))
            pieces.clear()
            linked = 0

    def add(text):
        nonlocal linked
        if text:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            linked += len(text) if link else 0

    def close(at):
        del stack[at:], names[at:]

    at = 0
    while found := TAG.search(page, at):
        add(page[at : found.start()])
        at = found.end()
        if not (name := found[2]):
            continue
        name, ending = name.lower(), found[1]
        if name in INLINE:
            if name == "a":
                link = 0 if ending else 1
            continue
        if name == "br":
            pieces.append(" ")
            continue
        flush()
        if ending:
            if deep and name not in names:
                deep -= 1
            elif name not in ("body", "html") and name in names:
                close(len(names) - 1 - names[::-1].index(name))
            continue
        if name in RAW:
            end = _raw_end[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID or name in ("html", "body") and name in names:
            continue
        if names[-1] == "p" or names[-1] in HEADINGS and name in HEADINGS:
            close(len(names) - 1)
        if name in ENDS:
            ended, holders = ENDS[name]
            for k in range(len(names) - 1, 0, -1):
                if names[k] in holders:
                    break
                if names[k] in ended:
                    close(k)
        if len(stack) > DEPTH:
            deep += 1
            continue
        node = Item(signature(name, found[3]), 0, [])
        stack[-1].items.append(node)
        if not found[3].endswith("/") or name not in ("svg", "path"):
            stack.append(node)
            names.append(name)
    add(page[at:])
    flush()
    return root.items, texts


Join = Callable[[object, object], object]


def merge(a: Item, b: Item, join: Join) -> None:
    """Makes ``a`` stand for ``b`` too; both have one key."""
    a.q |= b.q
    if a.items is None:
        a.held = join(a.held, b.held)
    else:
        a.items = aligned(a.items, b.items, join)


def repeat(a: Item, b: Item, join: Join) -> None:
    """Makes ``a`` stand for itself and ``b`` after it."""
    q = REPEATED | a.q & b.q & OPTIONAL
    merge(a, b, join)
    a.q = q


def folded(items: list[Item], join: Join) -> list[Item]:
    """Equal neighbours as one repeated item, then equal groups of neighbours as a repeated group."""
    out: list[Item] = []
    for x in items:
        if out and out[-1].key == x.key:
            repeat(out[-1], x, join)
        else:
            out.append(x)
    for k in range(2, PERIOD + 1):
        at = 0
        while at + 2 * k <= len(out):
            keys = [x.key for x in out[at : at + k]]
            stop = at + k
            while [x.key for x in out[stop : stop + k]] == keys:
                stop += k
            if stop > at + k:
                group = grouped(out[at : at + k])
                for again in range(at + k, stop, k):
                    repeat(group, grouped(out[again : again + k]), join)
                out[at:stop] = [group]
            at += 1
    return out


def grouped(items: list[Item]) -> Item:
    return Item("(" + " ".join(x.key for x in items) + ")", 0, items)


def with_groups(items: list[Item], like: list[Item]) -> list[Item]:
    """``items``, with those in a row that make one of the groups of ``like`` put together."""
    for group in like:
        if group.key.startswith("("):
            keys, at = [x.key for x in group.items], 0
            while at + len(keys) <= len(items):
                if [x.key for x in items[at : at + len(keys)]] == keys:
                    items = [*items[:at], grouped(items[at : at + len(keys)]), *items[at + len(keys) :]]
                at += 1
    return items


def optional(items: list[Item]) -> list[Item]:
    for x in items:
        x.q |= OPTIONAL
    return items


def aligned(a: list[Item], b: list[Item], join: Join) -> list[Item]:
    """One list that stands for both: equal keys are merged in order, all else becomes optional."""
    left, right = [x.key for x in a], [x.key for x in b]
    if left == right:
        for x, y in zip(a, b, strict=True):
            merge(x, y, join)
        return a
    a, b = with_groups(a, b), with_groups(b, a)
    out: list[Item] = []
    for what, i, j, k, m in SequenceMatcher(None, [x.key for x in a], [x.key for x in b], False).get_opcodes():
        if what == "equal":
            for x, y in zip(a[i:j], b[k:m], strict=True):
                merge(x, y, join)
            out += a[i:j]
        else:
            out += optional(a[i:j]) + optional(b[k:m])
    return folded(out, join)


def fold_all(items: list[Item], join: Join) -> list[Item]:
    """A page's tree, folded from its leaves on."""
    for x in items:
        if x.items:
            x.items = fold_all(x.items, join)
    return folded(items, join)


def slots(items: list[Item]):
    """The text slots in order."""
    for x in items:
        if x.items is None:
            yield x
        else:
            yield from slots(x.items)


def plain(items: list[Item], held: bool) -> list:
    return [[x.key, x.q, x.held if held else None] if x.items is None else [x.key, x.q, plain(x.items, held)] for x in items]


def written(items: list[Item], held: bool = True) -> str:
    """An expression as text, with what its slots hold or without."""
    return json.dumps(plain(items, held), separators=(",", ":"), ensure_ascii=False)


def _item(x: list) -> Item:
    return Item(x[0], x[1], None, x[2]) if x[0] == SLOT else Item(x[0], x[1], [_item(y) for y in x[2]])


def read(text: str) -> list[Item]:
    return [_item(x) for x in json.loads(text)]


def expression(items: list[Item]) -> str:
    """An expression for people: ``div.ad(#)``, ``?`` optional, ``+`` repeated, ``*`` both."""
    marks = ("", "?", "+", "*")
    return " ".join((SLOT if x.items is None else ("" if x.key.startswith("(") else x.key) + f"({expression(x.items)})") + marks[x.q] for x in items)
