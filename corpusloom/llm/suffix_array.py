"""Suffix arrays by linear grouping, and the removal of repeated byte strings with them.

``suffix_array`` sorts in two phases.  The first puts suffixes into groups by their Lyndon prefix:
groups are taken from the highest down; each member points to the nearest suffix on its left in a
lower group (a previous-smaller pointer), and pointed-to suffixes move up into new groups next to
their old one, by how often they are pointed to.  The second walks the array from its start and, along
the pointers of the suffix before each entry, puts suffixes into the next free place of their group.
Nothing is renamed and there is no recursion.

On a corpus, suffixes that share 200 bytes share the anchor of those bytes, so each anchor's runs are a
text of their own: the distinct contents, lined up at the anchor.  Columns where the same contents
agree with each other merge into one symbol, which leaves a few symbols of each content; the suffix
array and its common prefixes over them give the longest repeat from every place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, repeats

LENGTH = 200
#: Bytes of an anchor. Windows of 200 bytes hold 141 of them, a run is 71 windows long on average.
GRAM = 60
#: Anchors with more runs than this don't go to one task as a whole: their pieces and windows are counted instead.
LARGEST = 512


def suffix_array(text: list[int]) -> tuple[list[int], list[int]]:
    """Suffix array and its inverse, of a sequence of integers whose last one is the smallest and occurs once."""
    n = len(text)
    members: list[list[int]] = []
    above: list[int] = []  # next higher group
    below: list[int] = []
    group = [0] * n
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    for c in sorted(by_symbol):
        g = len(members)
        members.append(by_symbol[c])
        below.append(g - 1)
        above.append(g + 1)
        for i in by_symbol[c]:
            group[i] = g
    above[-1] = -1

    # groups by Lyndon prefix, highest first
    left = list(range(-1, n - 1))  # ways towards the nearest suffix of a lower group, shortened as they are used
    smaller = [-1] * n  # that suffix, as the group of a suffix found it
    done = bytearray(n)
    top = len(members) - 1
    while top >= 0:
        own = [i for i in members[top] if group[i] == top]
        members[top] = own
        for i in own:
            done[i] = 1
        pointed: dict[int, int] = {}
        for i in own:
            p = left[i]
            if p >= 0 and done[p]:
                while p >= 0 and done[p]:
                    p = left[p]
                at = left[i]
                while at != p:  # shorten the way for later ones
                    left[at], at = p, left[at]
                left[i] = p
            smaller[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        moves: dict[int, dict[int, list[int]]] = {}
        for p, times in pointed.items():
            moves.setdefault(group[p], {}).setdefault(times, []).append(p)
        for old, by_times in moves.items():
            under = old
            for times in sorted(by_times):
                g = len(members)
                members.append(by_times[times])
                for p in by_times[times]:
                    group[p] = g
                over = above[under]
                above.append(over)
                below.append(under)
                above[under] = g
                below[over] = g
                under = g
        top = below[top]

    # free places of the groups, lowest first
    first = 0
    while below[first] != -1:
        first = below[first]
    free = [0] * len(members)
    at, g = 0, first
    while g != -1:
        free[g] = at
        at += len(members[g])
        g = above[g]

    order = [-1] * n
    rank = [-1] * n
    order[0], rank[n - 1] = n - 1, 0
    free[group[n - 1]] = 1
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and rank[j] < 0:
            g = group[j]
            place = free[g]
            free[g] = place + 1
            order[place] = j
            rank[j] = place
            j = smaller[j]
    return order, rank


def common_prefixes(text: list[int], order: list[int], rank: list[int]) -> list[int]:
    """Length of the common prefix of each suffix of ``order`` with the one before it."""
    n = len(text)
    out = [0] * n
    size = 0
    for i in range(n):
        if rank[i]:
            j = order[rank[i] - 1]
            while i + size < n and j + size < n and text[i + size] == text[j + size]:
                size += 1
            out[rank[i]] = size
            if size:
                size -= 1
        else:
            size = 0
    return out


def repeats_of_class(contents: list[np.ndarray], rel: list[int], length: int) -> list[list[list[int]]]:
    """For each of an anchor's distinct contents, stretches [first, end) of windows that other ones hold as well.

    ``rel`` is the anchor's place in each content."""
    m, place = len(contents), max(rel)
    if m == 1:
        return [[]]
    width = max(place - r + len(c) for c, r in zip(contents, rel, strict=True))
    grid = np.repeat(np.arange(256, 256 + m, dtype=np.int32)[:, None], width, 1)  # outside of the contents all differ
    for i, (c, r) in enumerate(zip(contents, rel, strict=True)):
        grid[i, place - r : place - r + len(c)] = c
    if m == 2:
        alone = np.repeat((grid[0] != grid[1])[None], 2, 0)
        label = alone * np.array([[0], [1]])
    else:
        by = np.argsort(grid, axis=0, kind="stable")
        values = np.take_along_axis(grid, by, 0)
        fresh = np.ones(values.shape, bool)
        fresh[1:] = values[1:] != values[:-1]
        ends = np.ones(values.shape, bool)
        ends[:-1] = fresh[1:]
        lead = np.maximum.accumulate(np.where(fresh, np.arange(m)[:, None], 0), axis=0)
        label = np.empty(grid.shape, np.int64)
        np.put_along_axis(label, by, np.take_along_axis(by, lead, 0), 0)
        alone = np.empty(grid.shape, bool)
        np.put_along_axis(alone, by, fresh & ends, 0)
    cuts = np.flatnonzero((label[:, 1:] != label[:, :-1]).any(0)) + 1
    cuts = np.concatenate([[0], cuts, [width]])
    label, alone = label[:, cuts[:-1]], alone[:, cuts[:-1]]
    middle = int(np.searchsorted(cuts, place, side="right")) - 1
    text: list[int] = []
    where: list[tuple[int, int]] = []
    for i in range(m):
        if alone[i, middle]:
            continue
        off = np.flatnonzero(alone[i])
        k = int(np.searchsorted(off, middle))
        low = int(off[k - 1]) + 1 if k else 0
        high = int(off[k]) if k < len(off) else len(cuts) - 1
        if cuts[high] - cuts[low] < length:
            continue
        text += [b * m + int(label[i, b]) for b in range(low, high)]
        where += [(i, b) for b in range(low, high)]
        text.append(-2 - i)
        where.append((i, -1))
    found: list[list[list[int]]] = [[] for _ in range(m)]
    if text:
        text.append(-2 - m)
        ranks = {c: k for k, c in enumerate(sorted(set(text)))}
        text = [ranks[c] for c in text]
        order, rank = suffix_array(text)
        prefix = [*common_prefixes(text, order, rank), 0]
        for k, (i, b) in enumerate(where):
            if b >= 0 and (size := max(prefix[rank[k]], prefix[rank[k] + 1])):
                begin, end = int(cuts[b]) - place + rel[i], int(cuts[b + size]) - place + rel[i] - length + 1
                if end > begin:
                    if found[i] and begin <= found[i][-1][1]:
                        found[i][-1][1] = max(found[i][-1][1], end)
                    else:
                        found[i].append([begin, end])
    return found


RESOLVED = "anchor long, content long, stretches array<array<long>>"


def resolve(snippets: DataFrame, unit: repeats.Unit) -> DataFrame:
    """Anchors with up to LARGEST runs by suffix arrays, one anchor's in one task; the others, whose
    runs may be a large part of the corpus, by counting pieces and windows, spread over all tasks."""
    schema = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("stretches", pa.list_(pa.list_(pa.int64())))])

    def classes(batches):
        held: list[dict] = []

        def flush():
            _, _, rel = zip(*(repeats.unpacked(x["spot"]) for x in held), strict=True)
            found = repeats_of_class([np.frombuffer(x["symbols"], np.uint8) for x in held], rel, unit.span)
            return [(x["anchor"], x["content"], s) for x, s in zip(held, found, strict=True) if s and x["copies"] == 1]

        out = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["anchor"] != row["anchor"]:
                    out += flush()
                    held = []
                held.append(row)
            if len(out) > 4096:
                yield common.record(schema, *map(list, zip(*out, strict=True)))
                out = []
        if held:
            out += flush()
        if out:
            yield common.record(schema, *map(list, zip(*out, strict=True)))

    few = snippets.where(F.col("n") <= LARGEST).select("anchor", "content", "copies", "spot", "symbols")
    few = few.repartition("anchor").sortWithinPartitions("anchor", "content").mapInArrow(classes, RESOLVED)
    return few.unionByName(repeats.resolve_by_pieces(snippets.where(F.col("n") > LARGEST), unit))


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with all their columns, the text without the bytes that a repeated string covers, as UTF-8.

    Removal can cut a character in two; what is left of one is removed as well.  A null text stays null, an
    empty one empty.  Repeated rows repeat each other.  An empty table gives an empty one.
    ``n_chars``, where it is a column, is the new text's."""
    keyed = repeats.keyed(docs)
    row, version, stretches = common.free(docs, "row", "version", "stretches")
    found = repeats.marks(keyed, repeats.Bytes(gram, length), resolve).select(F.col("row").alias(row), F.col("version").alias(version), F.col("stretches").alias(stretches))
    text = F.coalesce(docs["text"], F.lit(""))
    joined = docs.join(found, (F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))) == found[row]) & (F.xxhash64(text) == found[version]), "left")
    joined = joined.select(*docs.columns, stretches)
    place, count = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in common.byte_batches(batches, repeats.BATCH_BYTES):
            texts = common.as_bytes(batch.column(place))
            for i, stretches in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if stretches:
                    gone = repeats.covered(stretches, len(texts[i]))
                    texts[i] = np.frombuffer(texts[i], np.uint8)[~gone].tobytes().decode(errors="ignore").encode()
            columns = batch.columns[:-1]
            columns[place] = pa.array([None if t is None else t.decode() for t in texts], batch.schema.field(place).type)
            if count is not None:
                columns[count] = pa.array([None if t is None else len(t.decode()) for t in texts], pa.int64()).cast(batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([batch.schema.field(i) for i in range(len(columns))]))

    return joined.mapInArrow(run, docs.schema)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, text, stretches) of every row: ``stretches`` are [first byte, end byte) of repeated strings,
    overlapping ones included; null where there are none or the text is null or short."""
    keyed = repeats.keyed(docs)
    return repeats.with_marks(keyed, repeats.marks(keyed, repeats.Bytes(gram, length), resolve))


def digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) after the removal of every byte that a repeated
    string of ``length`` bytes covers.

    A null or empty text has no bytes.  Repeated rows repeat each other, so both lose their bytes.  A null
    doc_id stays null, an empty table gives an empty one, other columns are not looked at."""

    def run(batches):
        for batch in common.byte_batches(batches, repeats.BATCH_BYTES):
            out = []
            for text, stretches in zip(common.as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                kept, spans = text, 0
                if stretches:
                    gone = repeats.covered(stretches, len(text))
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            yield common.record(SCHEMA, batch.column(0), *map(list, zip(*out, strict=True)))

    return repeated_spans(docs, length, gram).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir))
