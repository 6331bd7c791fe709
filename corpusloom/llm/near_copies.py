"""Near copies by the exact Jaccard similarity of their word shingles; candidates by SimHash and by bands.

At a similarity of 0.8 two fingerprints of 64 bits differ at about ten bits, and no key of a fingerprint
reaches that far.  So candidates are what SimHash links within its few bits, and besides what shares one of
24 bands of six least values of the shingles' set: a pair at 0.8 shares none with a chance of 0.0007.
A key says which texts to look at together: a link counts after the sets have been compared.

1. Of each key all texts are held against one head.  A text goes to the heads it has, few of them different.
   That joins a group of copies, however large, for the price of its size.
2. Then only keys are left whose texts are in several groups.  There the texts of different groups are compared, all with
   all; large groups fill blocks of their own, which are never paired with each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
WIDTH = 6
#: Texts that a task holds against a head, or in a block.
BLOCK = 512
#: Keys that a task remembers the head of.
KEYS = 500_000

_draw = np.random.default_rng(simhash.SEED)
FACTORS = _draw.integers(0, 1 << 64, BANDS * WIDTH, np.uint64) | np.uint64(1)
OFFSETS = _draw.integers(0, 1 << 64, BANDS * WIDTH, np.uint64)


def bands(found: np.ndarray) -> list[int]:
    """Keys of a set of hashes; none for an empty one."""
    if not len(found):
        return []
    least = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 1 << 10):
        least = np.minimum(least, (FACTORS[:, None] * found[None, at : at + (1 << 10)] + OFFSETS[:, None]).min(1))
    return [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, WIDTH))]


def sketches(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, version, content, fp, keys) of every row: ``version`` is the text's hash, ``content`` that of the set of its shingles."""
    schema = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("content", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for batch in common.byte_batches(batches, simhash.BATCH_BYTES):
            content, prints, keys = [], [], []
            for text in common.as_bytes(batch.column(2)):
                hashes = simhash.shingles(text, words)
                fp, found = simhash.majority(hashes), np.unique(hashes)
                content.append(xxhash.xxh64_intdigest(found.tobytes()))
                prints.append(fp)
                # equal fingerprints are one more key
                keys.append(np.array([*bands(found), xxhash.xxh64_intdigest(fp.to_bytes(8, "little"), BANDS)], np.uint64).view(np.int64))
            content, prints = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (content, prints))
            yield common.record(schema, batch.column(0), batch.column(1), content, prints, pa.array(keys, pa.list_(pa.int64())))

    docs = common.id_and_text(docs)
    return docs.select("doc_id", F.xxhash64("text").alias("version"), "text").mapInArrow(run, "doc_id long, version long, content long, fp long, keys array<long>")


def shared_keys(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect the contents with a key in common, fewer than there are keys.

    A task links what it holds of a key to the first one and hands on that one alone, so a key that many
    contents share has a row of each task at the meeting."""
    links = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    schema = pa.schema([("key", pa.int64()), *links])

    def heads(batches):
        first: dict[int, int] = {}
        for batch in batches:
            new, linked = [], {}
            for content, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for key in keys:
                    if (head := first.setdefault(key, content)) != content:
                        linked[content, head] = None
                    else:
                        new.append((key, content))
            a, b = [x for x, _ in linked], [x for _, x in linked]
            yield common.record(schema, [k for k, _ in new] + [None] * len(a), [c for _, c in new] + a, [None] * len(new) + b)
            if len(first) > KEYS:
                first = {}

    def meet(batches):
        held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            key, a = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True))
            starts = np.concatenate([[True], key[1:] != key[:-1]])
            first = a[np.maximum.accumulate(np.where(starts, np.arange(len(key)), 0))]
            yield common.record(links, pa.array(a[a != first]), pa.array(first[a != first]))
            held = key[-1:], first[-1:]

    found = common.cut(distinct.select("content", "keys").mapInArrow(heads, "key long, a long, b long"))
    met = found.where("key is not null").select("key", "a").repartition("key").sortWithinPartitions("key", "a").mapInArrow(meet, simhash.LINKS)
    return found.where("key is null").select("a", "b").unionByName(met)


def near_prints(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of contents whose fingerprints SimHash links: pairs (a, b) along its links, and (content, key) with a key for all that
    the links connect."""
    found = common.cut(simhash.links(distinct.select("fp").distinct()).distinct())
    of = distinct.groupBy("fp").agg(F.min("content").alias("content"))
    end = lambda c: of.select(F.col("fp").alias(c), F.col("content").alias(f"{c}_content"))
    pairs = found.join(end("a"), "a").join(end("b"), "b").select(F.col("a_content").alias("a"), F.col("b_content").alias("b"))
    node = members(found).select(F.col("content").alias("fp"), F.xxhash64(F.lit("fingerprint"), "root").alias("key"))
    return pairs, distinct.select("fp", "content").join(node, "fp").select("content", "key")


def jaccard(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets are as similar as that."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if len(small) < similarity * len(large) - 1e-6:
        return False
    at = np.searchsorted(large, small)
    both = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
    return both / (len(a) + len(b) - both) >= similarity


def beside_heads(pairs: DataFrame, texts: DataFrame, words: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Those of the pairs (a, b) that are similar; ``texts``: (content, text). A head of many pairs is sent to several tasks."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        head = own = None
        for batch in batches:
            out = []
            for b, part, member, content, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = np.unique(simhash.shingles(text, words))
                if not member:
                    head, own = (b, part), found
                elif head == (b, part) and jaccard(own, found, similarity):
                    out.append((content, b))
            if out:
                yield common.record(schema, *map(list, zip(*out, strict=True)))

    sizes = common.cut(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")))
    member = pairs.join(sizes, "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("member"), F.col("a").alias("content"))
    head = sizes.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member"), F.col("b").alias("content"))
    rows = member.unionByName(head).join(texts, "content").select("b", "part", "member", "content", F.col("text").cast("binary").alias("text"))
    return rows.repartition("b", "part").sortWithinPartitions("b", "part", "member").mapInArrow(run, simhash.LINKS)


def similar(a: list, b: list | None, similarity: float):
    """Links of contents that connect what links of at least this similarity do, fewer than there are contents.

    Members are (content, group, sorted set), of which those of one group are connected already.  ``b`` None: among
    ``a``; else between ``a`` and ``b``."""
    members = a + (b or [])
    sizes = np.array([len(s) for *_, s in members])
    values, places = np.unique(np.concatenate([s for *_, s in members]), return_inverse=True)
    parts = np.split(places, np.cumsum(sizes)[:-1])
    label, marked = np.unique([g for _, g, _ in members], return_inverse=True)[1], np.zeros(len(values), bool)
    for x in range(len(a)):
        start = x + 1 if b is None else len(a)
        size = sizes[start:]
        near = np.minimum(size, sizes[x]) >= similarity * np.maximum(size, sizes[x]) - 1e-6
        left = start + np.flatnonzero(near & (label[start:] != label[x]))
        if not len(left):
            continue
        marked[parts[x]] = True
        for y in left.tolist():
            if label[y] != label[x]:
                both = int(np.count_nonzero(marked[parts[y]]))
                if both / (int(sizes[x]) + int(sizes[y]) - both) >= similarity:
                    label[label == label[y]] = label[x]
                    yield members[x][0], members[y][0]
        marked[parts[x]] = False


def dealt(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, i, j, own, content, group): ``rows`` of (key, content, group) dealt to blocks, and each block to the pairs of
    blocks, i and j, that are looked at."""
    sizes = common.cut(rows.groupBy("key", "group").agg(F.count(F.lit(1)).alias("n")))
    large = sizes.where(F.col("n") > block // 2).select("key", "group", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    small = sizes.where(F.col("n") <= block // 2).groupBy("key").agg(F.ceil(F.sum("n") / block).cast("int").alias("rest"))
    placed = rows.join(large, ["key", "group"], "left").join(small, "key", "left")
    alone = F.col("parts").isNotNull()
    part = F.when(alone, F.xxhash64("group", F.pmod(F.xxhash64("content"), F.col("parts")))).otherwise(F.pmod(F.xxhash64("group"), F.coalesce("rest", F.lit(1))))
    placed = common.cut(placed.select("key", "content", "group", part.alias("part"), F.when(alone, F.col("group")).alias("pure")))
    parts = placed.select("key", "part", "pure").distinct()
    other = parts.select("key", F.col("part").alias("other"), F.col("pure").alias("other_pure"))
    pairs = parts.join(other, "key").where((F.col("part") <= F.col("other")) & ~F.coalesce(F.col("pure") == F.col("other_pure"), F.lit(False)))
    sides = pairs.select("key", F.col("part").alias("i"), F.col("other").alias("j"), F.explode(F.array_distinct(F.array("part", "other"))).alias("part"))
    return placed.drop("pure").join(sides, ["key", "part"]).select("key", "i", "j", F.col("part").alias("own"), "content", "group")


def across(rows: DataFrame, texts: DataFrame, words: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of contents of different groups that share a key: ``rows``: (key, content, group), of keys with several
    groups.  Groups of over half a block have blocks of their own, whose texts are only held against other groups'."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        held: dict = {}
        now = None
        for batch in batches:
            for key, i, j, own, content, group, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, i, j) != now:
                    yield from pair(now, held)
                    now, held = (key, i, j), {}
                of = held.setdefault(own, {})
                if content not in of:
                    of[content] = (content, group, np.unique(simhash.shingles(text, words)))
        yield from pair(now, held)

    def pair(now, held):
        if now:
            a, b = (list(held.get(x, {}).values()) for x in now[1:])
            if a and b:
                x = np.array(list(similar(a, None if now[1] == now[2] else b, similarity)), np.int64).reshape(-1, 2)
                yield common.record(schema, pa.array(np.ascontiguousarray(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1])))

    shown = dealt(rows, block).join(texts, "content").select("key", "i", "j", "own", "content", "group", F.col("text").cast("binary").alias("text"))
    return shown.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, simhash.LINKS)


def members(links: DataFrame) -> DataFrame:
    """(content, root) of every node of the links, roots included."""
    stars = simhash.components(links)
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "content")


def texts_of(docs: DataFrame, distinct: DataFrame, pairs: DataFrame) -> DataFrame:
    """(content, text) of the contents in pairs, one each, however often its row is repeated."""
    wanted = pairs.select(F.col("a").alias("content")).unionByName(pairs.select(F.col("b").alias("content"))).distinct()
    places = distinct.join(wanted, "content").select("content", F.col("doc_id").alias("own_id"), F.col("version").alias("own_version"))
    rows = common.id_and_text(docs).withColumn("version", F.xxhash64("text"))
    found = rows.join(places, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("version") == F.col("own_version")))
    return found.select("content", "text").dropDuplicates(["content"])


def one_of_each(docs: DataFrame, words: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group that links of texts connect whose sets of shingles have a Jaccard
    similarity of at least this: the row of the smallest doc_id (a null one comes last), and of the smallest
    text hash among equal identifiers.  Texts without words, null ones included, are copies of each other.  Of rows with
    equal identifier and text that with the least hash of its columns stays.  An empty table gives an empty one;
    further columns, whatever their names, stay as they are."""
    prints = common.cut(sketches(docs, words))
    best = prints.groupBy("content").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "version", "fp", "keys")).alias("best"))
    distinct = common.cut(best.select("content", "best.*"))
    along, by_print = near_prints(distinct)
    pairs = common.cut(shared_keys(distinct).unionByName(along).where("a <> b").distinct())
    with common.Scratch(docs.sparkSession) as scratch:
        texts = scratch.keep(texts_of(docs, distinct, pairs))
        near = common.cut(beside_heads(pairs, texts, words, similarity), True)
        grouped = distinct.select("content", "keys").join(common.cut(members(near)), "content", "left").select("content", "keys", F.coalesce("root", "content").alias("group"))
        rows = grouped.select(F.explode("keys").alias("key"), "content", "group").unionByName(by_print.join(grouped.select("content", "group"), "content").select("key", "content", "group"))
        several = rows.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("key")
        rows = common.cut(rows.join(several, "key"))
        near = near if rows.isEmpty() else common.cut(near.unionByName(across(rows, texts, words, similarity)), True)
    near = common.cut(members(near))
    named = distinct.select("content", "last", "doc_id", "version").join(near, "content", "left")
    return simhash.first_rows(docs, prints, named.select(F.coalesce("root", "content").alias("root"), "last", "doc_id", "version"))
