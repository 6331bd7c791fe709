"""SimHash fingerprints and near-duplicate components by pigeonring filtering.

The 64 bits are eight segments on a ring.  If two fingerprints differ at t = 3 bits or fewer, then from
some segment on, every chain of l consecutive segments differs at l * t / 8 bits or fewer: none in the
first two, at most one in the first five, and so on.  So they agree on those two and on two of the next
three, which gives 24 keys of 32 bits to look for candidates by, and the chain's further budgets prune
candidates before the full Hamming check.  Work is done on distinct fingerprints, a bucket hands on a
spanning forest of its links rather than all pairs, and buckets above a bound are cut into blocks
whose pairs are spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SEED = 42
SHINGLE = 3
DISTANCE = 3
SEGMENTS = 8
BITS = 64 // SEGMENTS
BATCH_BYTES = 1 << 19
#: Larger buckets are cut into blocks of this size.
BUCKET = 4096


def shingles(text: bytes, words: int = SHINGLE) -> np.ndarray:
    """Hashes of lower-cased (A-Z) words' shingles, repeats included; all words are one where there are fewer."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) < words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip([0, *(e + 1 for e in ends)], ends[words - 1 :], strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    """Of lower-cased (A-Z) words and their shingles, repeats included; 0 without words."""
    return majority(shingles(text, words))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, version, fp) of every row; ``version`` is the text's hash, ``fp`` the fingerprint as signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in common.byte_batches(batches, BATCH_BYTES):
            fp = np.array([fingerprint(t) for t in common.as_bytes(batch.column(2))], np.uint64).view(np.int64)
            yield common.record(schema, batch.column(0), batch.column(1), pa.array(fp))

    docs = common.id_and_text(docs)
    return docs.select("doc_id", F.xxhash64("text").alias("version"), "text").mapInArrow(run, "doc_id long, version long, fp long")


def ring_mask(first: int, count: int) -> int:
    """Mask of ``count`` consecutive segments from ``first`` on."""
    return sum(((1 << BITS) - 1) << BITS * ((first + i) % SEGMENTS) for i in range(count))


def budgets(distance: int = DISTANCE) -> list[int]:
    """Most bits that a chain of 1, 2, ... segments may differ at."""
    return [length * distance // SEGMENTS for length in range(1, SEGMENTS + 1)]


def keys() -> list[tuple[int, int]]:
    """(first segment of the chain, mask of the segments that agree) of each candidate key."""
    chain = budgets()
    same = sum(b == 0 for b in chain)
    loose = sum(b <= 1 for b in chain) - same
    found = []
    for first in range(SEGMENTS):
        for free in range(loose):
            found.append((first, ring_mask(first, same) | sum(ring_mask((first + same + i) % SEGMENTS, 1) for i in range(loose) if i != free)))
    return found


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def viable(differing: np.ndarray, first: int) -> np.ndarray:
    """Which of the xors keep every budget of the chain from ``first`` on; the last is the whole distance."""
    left = np.arange(len(differing))
    for length, most in enumerate(budgets(), 1):
        left = left[np.bitwise_count(differing[left] & np.uint64(ring_mask(first, length))) <= most]
    return left


def forest(a: np.ndarray, b: np.ndarray | None, first: int):
    """Links that connect what links within 3 bits do, fewer than there are fingerprints.

    ``b`` None: among ``a``; else between ``a`` and ``b``."""
    parent: dict[int, int] = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    other = a if b is None else b
    for at in range(0, len(a), 256):
        block = a[at : at + 256]
        i, j = np.divmod(viable((block[:, None] ^ other[None, :]).ravel(), first), len(other))
        for x, y in zip(block[i].tolist(), other[j].tolist(), strict=True):
            if x != y and (p := root(x)) != (q := root(y)):
                parent[p] = q
                yield x, y


LINKS = "a long, b long"


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) of distinct fingerprints ``fp`` within three bits, enough to connect all that are connected."""
    spec = keys()
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    rows = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(signed(mask))) for _, mask in spec))).alias("k", "value"))
    hot = common.cut(rows.groupBy("k", "value").count().where(F.col("count") > bucket).select("k", "value", F.ceil(F.col("count") / bucket).cast("int").alias("blocks")))

    def emit(pairs):
        x = np.array(list(pairs), np.uint64).view(np.int64)
        if len(x):
            yield common.record(schema, pa.array(np.ascontiguousarray(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1])))

    def buckets(batches):
        held = None
        for batch in batches:
            k, value, fp = (batch.column(i).to_numpy().astype(np.int64) for i in range(3))
            if held is not None:
                k, value, fp = (np.concatenate(x) for x in zip(held, (k, value, fp), strict=True))
            cuts = np.flatnonzero((k[1:] != k[:-1]) | (value[1:] != value[:-1])) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            held = k[last:], value[last:], fp[last:]
            yield from some(k, fp, np.concatenate([[0], cuts])[: len(cuts) + 1])
        if held is not None and len(held[0]) > 1:
            yield from emit(forest(held[2].view(np.uint64), None, spec[int(held[0][0])][0]))

    def some(k, fp, bounds):
        """Of all whole buckets: [bounds[i], bounds[i+1])."""
        begin, stop = bounds[:-1], bounds[1:]
        out = []
        for x, y in zip(begin[stop - begin > 1].tolist(), stop[stop - begin > 1].tolist(), strict=True):
            out += forest(fp[x:y].view(np.uint64), None, spec[int(k[x])][0])
        yield from emit(out)

    def blocks(batches):
        """Each row of a task's pair of blocks comes here with its block; both blocks are at most a few buckets large."""
        held: dict = {}
        now = None
        for batch in batches:
            for k, value, i, j, block, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, value, i, j) != now:
                    yield from pair(now, held)
                    now, held = (k, value, i, j), {}
                held.setdefault(block, []).append(fp)
        yield from pair(now, held)

    def pair(now, held):
        if now:
            a, b = (np.array(held.get(x, []), np.int64).view(np.uint64) for x in now[2:])
            yield from emit(forest(a, None if now[2] == now[3] else b, spec[now[0]][0]))

    if hot.isEmpty():
        cold, large = rows, None
    else:
        joined = rows.join(hot, ["k", "value"], "left")
        cold = joined.where("blocks is null").select("fp", "k", "value")
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        large = joined.where("blocks is not null").select("k", "value", "fp", own.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        large = large.select("k", "value", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp")
        large = large.repartition("k", "value", "i", "j").sortWithinPartitions("k", "value", "i", "j").mapInArrow(blocks, LINKS)
    found = cold.select("k", "value", "fp").repartition("k", "value").sortWithinPartitions("k", "value").mapInArrow(buckets, LINKS)
    return found if large is None else found.unionByName(large)


def components(found: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b), by alternating large and small stars.

    Each round is a few shuffles of at most as many rows as there are links; rounds grow with the
    logarithm of the longest chain.  Nothing is collected but a count and a checksum."""
    edges = common.cut(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    seen = None
    while (now := edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != seen:
        seen = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = common.cut(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = common.cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = common.cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def component_of(prints: DataFrame) -> DataFrame:
    """(fp, component, root) of each distinct fingerprint of ``prints`` (doc_id, fp): the smallest doc_id
    in reach, and a fingerprint that stands for the component."""
    distinct = common.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    stars = components(links(distinct))
    members = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "fp")
    members = common.cut(members.join(distinct, "fp"))
    least = common.cut(members.groupBy("root").agg(F.min("least").alias("component")))
    linked = common.cut(members.join(least, "root").select("fp", "component", "root"))
    return common.cut(distinct.join(linked, "fp", "left").select("fp", F.least("component", "least").alias("component"), F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    ``fingerprint`` has 16 hex digits, ``component_id`` is the smallest doc_id that links of 3 or fewer
    bits reach.  Texts without words, null ones included, have fingerprint 0 and are linked like any
    other.  A null doc_id is never the smallest; a component of nothing else has a null id.  Repeated rows
    give repeated rows, an empty table gives an empty one, other columns are not looked at."""
    prints = common.cut(fingerprints(docs).select("doc_id", "fp"))
    return prints.join(component_of(prints), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (a null one comes last),
    and of the smallest text hash among equal identifiers."""
    prints = common.cut(fingerprints(docs), True)
    named = prints.join(component_of(prints.select("doc_id", "fp")), "fp").select("root", F.col("doc_id").isNull().alias("last"), "doc_id", "version")
    return first_rows(docs, prints, named)


def first_rows(docs: DataFrame, prints: DataFrame, named: DataFrame) -> DataFrame:
    """The row of ``docs`` with the least (last, doc_id, version) of each ``root`` of ``named``; ``prints`` has (doc_id, version)
    of every row.  Of several such rows, that with the least hash of all its columns; of equal ones, one."""
    ident, version, rows, whole, own = common.free(docs, "id", "version", "rows", "whole", "own")
    keepers = named.groupBy("root").agg(F.min(F.struct("last", "doc_id", "version")).alias("keep"))
    keepers = keepers.select(F.col("keep.doc_id").alias("doc_id"), F.col("keep.version").alias("version"))
    copies = prints.groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("rows")).select(F.col("doc_id").alias("own_id"), F.col("version").alias("own_version"), "rows")
    keepers = keepers.join(copies, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("version") == F.col("own_version")))
    keepers = common.cut(keepers.select(F.col("doc_id").alias(ident), F.col("version").alias(version), F.col("rows").alias(rows)))
    id_now, version_now = docs["doc_id"].cast("long"), F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    kept = docs.join(keepers, id_now.eqNullSafe(keepers[ident]) & (version_now == keepers[version]))
    single = kept.where(F.col(rows) == 1).select(*docs.columns)
    hashed = [F.to_json(c) if isinstance(docs.schema[c].dataType, T.MapType) else F.col(c) for c in docs.columns]
    several = kept.where(F.col(rows) > 1).select(ident, version, F.xxhash64(*hashed).alias(own), F.struct(*docs.columns).alias(whole))
    one = several.groupBy(ident, version).agg(F.min_by(whole, own).alias(whole))
    return single.unionByName(one.select(*(F.col(whole)[c].alias(c) for c in docs.columns)))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
