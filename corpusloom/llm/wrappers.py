"""Main texts of web pages by wrappers: union-free regular expressions inferred for each host.

1. A page is parsed and folded into its shape (see ``page_tree``), with a hash of what each text slot holds.  Pages of one
   host and shape are one row from there on, whatever their number; their slots' least and greatest hashes, characters
   and characters in links are summed up by Spark.
2. A host's shapes are aligned one after the other, in groups of bounded size by a hash, and the groups' expressions
   again in groups, until one wrapper stands for all of the host's pages.
3. The wrapper's slots are judged once for the host: by the elements they stand in, by whether the host's pages all
   hold the same there, and by the share of links.
4. Each shape is aligned with its host's wrapper, which tells what its slots are; that goes to the pages by host and shape.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_terms, common, page_tree

BATCH_BYTES = 1 << 20
#: Shapes that are aligned in one task's turn, on average.
FAN = 64
#: Shapes that a task holds before it hands them on.
HELD = 4096
#: Pages that must hold the same text for it to be the template's, at least so many and such a share of the host's.
SAME, SHARE = 3, 0.2
#: Share of characters in links from which a loose slot is a list of links.
LINKS = 0.5
#: Up to so many shapes their slots are broadcast; above, they are joined by shuffle with this many copies of each.
SMALL, SALTS = 20_000, 32

# Names by which pages tell what isn't the article, and what is.
OUT_TAGS = frozenset("nav footer aside button select dialog menu head svg template audio video object canvas map math datalist".split())
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored banner promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets related recommended share sharing social footer copyright masthead topbar toolbar comment comments "
    "disqus reply replies respond login search pagination pager legal disclaimer complementary contentinfo dialog form".split()
)
MAIN_TAGS = frozenset("article main".split())
MAIN_WORDS = frozenset("article main content post entry story".split())
PROSE = page_tree.HEADINGS | frozenset("p pre blockquote article main".split())


def folded(page: str) -> tuple[list, list, list]:
    """A page's folded tree, the slot of each of its texts, and the texts."""
    items, texts = page_tree.parsed(page)
    items = page_tree.fold_all(items, lambda a, b: a + b)
    of = [0] * len(texts)
    for i, slot in enumerate(page_tree.slots(items)):
        for text in slot.held:
            of[text] = i
    return items, of, texts


def key_of(shape: str) -> bytes:
    return hashlib.blake2b(shape.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def hosts(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, html) with null pages as empty ones; pages of an unclear address have the host ''."""
    pages = common.bounded(pages)
    host = F.lower(F.coalesce(F.regexp_extract(pages["url"], r"^[^:/?#]+://([^/?#]*)", 1), F.lit("")))
    return pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), host.alias("host"), F.coalesce(pages["html"], F.lit("")).alias("html"))


def shapes(pages: DataFrame) -> DataFrame:
    """(host, key, shape, n, slots) of the shapes of each host: number of pages, and of each slot the pages, least and
    greatest hash of what a page holds there, characters, and characters in links."""
    names = ("at", "n", "lo", "hi", "chars", "links")
    schema = pa.schema([("host", pa.string()), ("key", pa.binary()), ("shape", pa.string())] + [(c, pa.int64()) for c in names])

    def rows(held):
        for (host, key), (shape, n, found) in held.items():
            yield host, key, shape, -1, n, 0, 0, 0, 0
            for i, x in enumerate(found):
                yield host, key, None, i, *x

    def run(batches):
        held: dict[tuple, list] = {}
        for batch in common.byte_batches(batches, BATCH_BYTES, "html"):
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                items, of, texts = folded(page)
                shape = page_tree.written(items, False)
                sums = [[xxhash.xxh64(), 0, 0] for _ in page_tree.slots(items)]
                for slot, (text, links) in zip(of, texts, strict=True):
                    x = sums[slot]
                    x[0].update(text.encode("utf-8", "surrogatepass") + b"\n")
                    x[1] += len(text)
                    x[2] += links
                own = [(h.intdigest() >> 1, chars, links) for h, chars, links in sums]
                known = held.setdefault((host, key_of(shape)), [shape, 0, [[0, h, h, 0, 0] for h, _, _ in own]])
                known[1] += 1
                for x, (h, chars, links) in zip(known[2], own, strict=True):
                    x[:] = x[0] + 1, min(x[1], h), max(x[2], h), x[3] + chars, x[4] + links
            if len(held) > HELD:
                yield common.record(schema, *map(list, zip(*rows(held), strict=True)))
                held = {}
        if held:
            yield common.record(schema, *map(list, zip(*rows(held), strict=True)))

    found = pages.select("host", "html").mapInArrow(run, "host string, key binary, shape string, at long, n long, lo long, hi long, chars long, links long")
    per = found.groupBy("host", "key", "at").agg(F.max("shape").alias("shape"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    slots = F.collect_list(F.when(F.col("at") >= 0, F.struct(*names)))
    return per.groupBy("host", "key").agg(F.max("shape").alias("shape"), F.max(F.when(F.col("at") < 0, F.col("n"))).alias("n"), F.sort_array(slots).alias("slots"))


def both(a: list, b: list) -> list:
    """What a slot is known to hold: pages, least and greatest hash, characters, characters in links."""
    return [a[0] + b[0], min(a[1], b[1]), max(a[2], b[2]), a[3] + b[3], a[4] + b[4]]


def with_evidence(shape: str, slots) -> list:
    items = page_tree.read(shape)
    for slot, x in zip(page_tree.slots(items), slots, strict=True):
        slot.held = [x["n"], x["lo"], x["hi"], x["chars"], x["links"]]
    return items


def inferred(found: DataFrame, fan: int = FAN) -> DataFrame:
    """(host, wrapper, n): the expression that stands for all shapes of a host, and its pages. ``found`` as of ``shapes``."""

    def first(batches):
        for frame in batches:
            made = [page_tree.written(with_evidence(s, x)) for s, x in zip(frame["shape"], frame["slots"], strict=True)]
            yield pd.DataFrame({"host": frame["host"], "key": frame["key"], "wrapper": made, "n": frame["n"]})

    def align(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key")
        items = page_tree.read(frame["wrapper"].iloc[0])
        for other in frame["wrapper"].iloc[1:]:
            items = page_tree.aligned(items, page_tree.read(other), both)
        made = page_tree.written(items)
        return pd.DataFrame({"host": frame["host"].iloc[:1], "key": [key_of(made)], "wrapper": [made], "n": [int(frame["n"].sum())]})

    kinds = "host string, key binary, wrapper string, n long"
    now = common.cut(found.mapInPandas(first, kinds))
    while True:
        sizes = now.groupBy("host").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
        largest = sizes.agg(F.max("many")).first()[0]
        if largest is None:
            return now.select("host", "wrapper", "n")
        turn = F.pmod(F.xxhash64("key"), F.ceil(F.col("many") / fan)).cast("int")
        several = now.join(byte_terms.small(sizes, SMALL), "host").withColumn("turn", turn)
        merged = several.groupBy("host", "turn").applyInPandas(lambda f: align(f), kinds)
        now = common.cut(merged.unionByName(now.join(byte_terms.small(sizes.select("host"), SMALL), "host", "left_anti")))


def judged(items: list, pages: int) -> None:
    """Puts into each slot of a wrapper what it is: 2 the article's, 1 the text's where there is no article, 0 neither."""
    found = []

    def walk(items, out, soft, main, name):
        for x in items:
            if x.items is None:
                found.append((x, out or soft, main, name))
            elif x.key.startswith("("):
                walk(x.items, out, soft, main, name)
            else:
                tag, *words = x.key.rstrip("!").split(".")
                words = {w for word in words for w in re.split(r"[^a-z]+", word)}
                plain = tag in ("html", "body")
                # a header isn't the article, but may stand in it
                article = tag in MAIN_TAGS or bool(words & MAIN_WORDS) and not (plain or tag == "form" or "header" in words)
                gone = out or x.key.endswith("!") or tag in OUT_TAGS or bool(words & OUT_WORDS) and not plain and tag != "main" or main and tag == "form"
                within = main or article and not gone
                # a whole page may stand in a form or a header: an article in there is one all the same
                loose = (soft or tag in ("form", "header") or "header" in words) and not within
                walk(x.items, gone, loose, within, tag)

    walk(items, False, False, False, "")
    same = lambda held: held[1] == held[2] and held[0] >= SAME and held[0] >= SHARE * pages
    varied = {main: any(not same(x.held) for x, out, m, _ in found if not out and m == main) for main in (False, True)}
    for x, out, main, name in found:
        template = varied[main] and same(x.held)
        if main:
            x.held = 0 if out or template and name not in PROSE else 2
        else:
            x.held = 0 if out or template or x.held[4] >= LINKS * x.held[3] else 1


def told(found: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, key, slots): for each shape of a host which of its slots are the main text."""

    def look(batches):
        for frame in batches:
            yield pd.DataFrame({"host": frame["host"], "key": frame["key"], "slots": [chosen(s, w, n) for s, w, n in zip(frame["shape"], frame["wrapper"], frame["n"], strict=True)]})

    rows = found.select("host", "key", "shape").join(wrappers, "host")
    return rows.select("host", "key", "shape", "wrapper", "n").mapInPandas(look, "host string, key binary, slots array<boolean>")


def chosen(shape: str, wrapper: str, pages: int) -> list[bool]:
    """Which slots of a shape are the main text, by the wrapper that stands for it."""
    whole, own = page_tree.read(wrapper), page_tree.read(shape)
    judged(whole, pages)
    for slot in page_tree.slots(whole):
        slot.held = [slot.held, []]
    known = list(page_tree.slots(own))
    for i, slot in enumerate(known):
        slot.held = [-1, [i]]

    # of slots that become one, the wrapper's say counts; its own slots keep the greater one
    page_tree_slots = page_tree.slots(page_tree.aligned(whole, own, lambda a, b: [max(a[0], b[0]), a[1] + b[1]]))
    roles = [0] * len(known)
    for slot in page_tree_slots:
        for i in slot.held[1]:
            roles[i] = slot.held[0]
    most = max(roles, default=0)
    return [r > 0 and r == most for r in roles]


def blocks(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, key, of, texts): of each page its shape, and its texts with their slots, in page order."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("key", pa.binary()), ("of", pa.list_(pa.int32())), ("texts", pa.list_(pa.string()))])

    def run(batches):
        for batch in common.byte_batches(batches, BATCH_BYTES, "html"):
            keys, slots, texts = [], [], []
            for page in batch.column(3).to_pylist():
                items, of, found = folded(page)
                keys.append(key_of(page_tree.written(items, False)))
                slots.append(of)
                texts.append([t.encode("utf-8", "replace").decode() for t, _ in found])
            yield common.record(schema, batch.column(0), batch.column(1).cast(pa.string()), batch.column(2).cast(pa.string()), keys, pa.array(slots, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.string())))

    return pages.select("page_id", "url", "host", "html").mapInArrow(run, "page_id long, url string, host string, key binary, of array<int>, texts array<string>")


def wrappers(pages: DataFrame, fan: int = FAN) -> DataFrame:
    """(host, wrapper, n): of each host the expression that stands for its pages, and their number."""
    return inferred(common.cut(shapes(hosts(pages))), fan)


def main_texts(pages: DataFrame, fan: int = FAN) -> DataFrame:
    """(page_id, url, text, n_chars) of every page: the blocks of its main text, joined by a newline.

    Null and empty pages and those without a main text have ''.  Pages of null or unclear addresses make one host.
    Repeated rows and identifiers are pages each; nulls stay.  An empty table gives an empty one, other columns aren't looked at.
    A page that is cut off, or whose tags aren't closed, is read as far as it goes."""
    pages = hosts(pages)
    found = common.cut(shapes(pages))
    slots = common.cut(told(found, inferred(found, fan)))
    rows = blocks(pages)
    if slots.count() <= SMALL:
        joined = rows.join(F.broadcast(slots), ["host", "key"])
    else:
        salted = slots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "key", "salt"])
    kept = F.filter(F.arrays_zip("of", "texts"), lambda x: F.get(F.col("slots"), x["of"]))
    text = F.array_join(F.transform(kept, lambda x: x["texts"]), "\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op11_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
