"""Finding every window of a corpus that also starts somewhere else, exactly and without hot groups.

1. Each text is cut into runs of windows (see ``anchors``).  One aggregation by anchor, combined
   before the shuffle, tells anchors that occur once (nothing there repeats), anchors all of whose
   runs have one content (everything there repeats) and *branching* ones.
2. Runs of the second kind need nothing else.  Of the third, one source of each distinct content is
   looked up by its coordinates, and a resolver tells which of its windows repeat.
3. The marks return to all runs of that content, and to the texts.

A row is known by doc_id and the hash of its text, so repeated identifiers and null ones are fine:
equal rows have equal marks, and each counts as a place of its own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import anchors, common

BATCH_BYTES = 1 << 18
#: Sequences longer than this are cut into overlapping parts. A cut only makes more runs.
PART = 1 << 18


class Bytes:
    """Symbols are bytes."""

    def __init__(self, gram: int, span: int):
        self.gram, self.span = gram, span

    codes_of = np.array([xxhash.xxh64_intdigest(bytes([b]), seed=7) for b in range(256)], np.uint64)

    def symbols(self, text: bytes) -> np.ndarray:
        return np.frombuffer(text, np.uint8)

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        return self.codes_of[symbols]


class Words:
    """Symbols are words, known by their 64-bit hash."""

    def __init__(self, gram: int, span: int):
        self.gram, self.span = gram, span

    def symbols(self, text: bytes) -> np.ndarray:
        words = text.split()
        known = {w: xxhash.xxh64_intdigest(w, seed=7) for w in set(words)}
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        return symbols


Unit = Bytes | Words


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, row, version, text): ``row`` is doc_id with a value for null, ``version`` the text's hash."""
    docs = common.id_and_text(docs)
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("row"), F.xxhash64("text").alias("version"), "text")


def parts(unit: Unit, texts: list[bytes]):
    """Groups of sequences of at most PART symbols or so: (owner, offset, symbols) of each."""
    group, size = [], 0
    for owner, text in enumerate(texts):
        symbols = unit.symbols(text)
        for at in range(0, max(1, len(symbols) - unit.span + 1), PART):
            part = symbols[at : at + PART + unit.span - 1]
            if len(part) < unit.span:
                continue
            if group and size + len(part) > PART:
                yield group
                group, size = [], 0
            group.append((owner, at, part))
            size += len(part)
    if group:
        yield group


def runs_of(unit: Unit, texts: list[bytes]):
    """Owner, start, windows, anchor's place in the first window, anchor, content of all runs, by groups."""
    for group in parts(unit, texts):
        lengths = np.array([len(p) for _, _, p in group])
        begin, n, rel, anchor, content = anchors.runs(unit.codes(np.concatenate([p for _, _, p in group])), lengths, unit.gram, unit.span)
        which = np.searchsorted(np.cumsum(lengths), begin, side="right")
        owner = np.array([o for o, _, _ in group])[which]
        start = begin - (np.cumsum(lengths) - lengths)[which] + np.array([a for _, a, _ in group])[which]
        yield owner, start, n, rel, anchor.view(np.int64), content.view(np.int64)


#: A run's start, number of windows and the anchor's place in one long: 40, 12 and 12 bits.
def packed(start, n, rel):
    return start << 24 | n << 12 | rel


def unpacked(spot):
    return spot >> 24, spot >> 12 & 4095, spot & 4095


def large(df: DataFrame) -> DataFrame:
    return common.cut(df, True)


def shared_anchors(keyed_docs: DataFrame, unit: Unit, keep: Callable[[DataFrame], DataFrame] = large) -> DataFrame:
    """(anchor, n, branching, twice) of the anchors of several runs: n of them, ``branching`` if their contents
    differ, ``twice``: 44 bits of a content that occurs twice, where one showed."""

    def pairs(batches):
        schema = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("draw", pa.int64())])
        for batch in common.byte_batches(batches, BATCH_BYTES):
            row = batch.column(0).to_numpy().view(np.uint64)
            for owner, start, _, _, anchor, content in runs_of(unit, common.as_bytes(batch.column(1))):
                chance = anchors.mixed(row[owner] ^ anchors.mixed(start.astype(np.uint64)))
                draw = (chance >> np.uint64(46)) << np.uint64(45) | (content.view(np.uint64) >> np.uint64(20)) << np.uint64(1) | chance & np.uint64(1)
                yield common.record(schema, pa.array(anchor), pa.array(content), pa.array(draw.view(np.int64)))

    # ``draw``: chance, 44 bits of the content, and a bit that parts the runs in two.  If the runs that are drawn
    # from both parts have one content, it occurs twice, and its runs need no more looking at: a passage
    # that a large part of the corpus holds is told here, without a join.
    side = F.col("draw").bitwiseAND(1)
    drawn = lambda c: F.shiftright(c, 1).bitwiseAND((1 << 44) - 1)
    found = (
        keyed_docs.select("row", "text")
        .mapInArrow(pairs, "anchor long, content long, draw long")
        .groupBy("anchor")
        .agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("least"), F.max("content").alias("most"), F.min(F.when(side == 0, F.col("draw"))).alias("even"), F.min(F.when(side == 1, F.col("draw"))).alias("odd"))
        .where("n > 1")
        .select("anchor", "n", (F.col("least") != F.col("most")).alias("branching"), F.when(drawn(F.col("even")) == drawn(F.col("odd")), drawn(F.col("even"))).alias("twice"))
    )
    return keep(found)


def occurrences_of(keyed_docs: DataFrame, unit: Unit, shared: DataFrame, keep: Callable[[DataFrame], DataFrame] = large) -> DataFrame:
    """(row, version, spot, anchor, content) of the runs of shared anchors, with the anchors' columns."""

    def full(batches):
        schema = pa.schema([(c, pa.int64()) for c in ("row", "version", "spot", "anchor", "content")])
        for batch in common.byte_batches(batches, BATCH_BYTES):
            row, version = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for owner, start, n, rel, anchor, content in runs_of(unit, common.as_bytes(batch.column(2))):
                yield common.record(schema, *map(pa.array, (row[owner], version[owner], packed(start, n, rel), anchor, content)))

    runs = keyed_docs.select("row", "version", "text").mapInArrow(full, "row long, version long, spot long, anchor long, content long")
    return keep(runs.join(shared, "anchor"))


def wanted_by_source(contents: DataFrame, *columns: str) -> DataFrame:
    """(row, version, wanted): of each row that is the source of contents, what is asked for."""
    rows = contents.select("anchor", "content", *columns, "source.*")
    return rows.groupBy("row", "version").agg(F.collect_list(F.struct("anchor", "content", *columns, "spot")).alias("wanted"))


def marks(keyed_docs: DataFrame, unit: Unit, resolve: Callable[[DataFrame, Unit], DataFrame]) -> DataFrame:
    """(row, version, stretches): for each row with repeats, stretches of repeated windows as
    [first symbol, end symbol] pairs, which may overlap.

    ``resolve`` gets the distinct contents of branching anchors (anchor, n, content, copies, spot, and the
    run's symbols as binary; n: the anchor's runs in all) and returns (anchor, content, stretches of
    window numbers in the run) of those that occur once: of the others all windows repeat."""
    span = unit.span
    occurrences = occurrences_of(keyed_docs, unit, shared_anchors(keyed_docs, unit))
    branching = occurrences.where("branching")
    contents = common.cut(branching.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "version", "spot")).alias("source"), F.max("n").alias("n")), True)
    sources = wanted_by_source(contents, "n", "copies")
    snippets = common.cut(looked_up(keyed_docs, sources).mapInArrow(_snippets(unit), SNIPPETS), True)
    resolved = common.cut(resolve(snippets, unit), True)

    start, n, _ = unpacked_columns("spot")
    stretch = F.array(F.array(start, start + n + F.lit(span - 1))).alias("stretches")
    occurrences = surely_told(occurrences)
    branching, told = occurrences.where("branching"), F.col("told")
    left = branching.where(~told)
    copied = left.join(contents.where("copies > 1").select("anchor", "content"), ["anchor", "content"], "left_semi")
    whole = occurrences.where(~F.col("branching") | told).unionByName(copied.select(*occurrences.columns)).select("row", "version", stretch)
    some = left.select("row", "version", "anchor", "content", start.alias("start")).join(resolved.withColumnRenamed("stretches", "windows"), ["anchor", "content"])
    some = some.select("row", "version", F.transform("windows", lambda x: F.array(F.col("start") + x[0], F.col("start") + x[1] + F.lit(span - 1))).alias("stretches"))
    return whole.unionByName(some).groupBy("row", "version").agg(F.flatten(F.collect_set("stretches")).alias("stretches"))


def surely_told(occurrences: DataFrame) -> DataFrame:
    """``occurrences`` with ``told``: a branching anchor's run has the content that is known to occur twice.

    44 bits of it are known. Where runs of one anchor agree in these and not in the whole hash, which hardly ever is, they
    aren't told by them."""
    told = F.col("branching") & F.coalesce(F.shiftrightunsigned("content", 20) == F.col("twice"), F.lit(False))
    found = occurrences.withColumn("told", told)
    unsure = common.cut(found.where("told").groupBy("anchor").agg(F.min("content").alias("lo"), F.max("content").alias("hi")).where("lo <> hi").select("anchor"))
    many = unsure.count()
    if not many:
        return found
    unsure = unsure.withColumn("unsure", F.lit(True))
    found = found.join(F.broadcast(unsure) if many < 100_000 else unsure, "anchor", "left")
    return found.withColumn("told", F.col("told") & F.col("unsure").isNull()).drop("unsure")


def unpacked_columns(name: str) -> tuple[Column, Column, Column]:
    spot = F.col(name)
    return F.shiftright(spot, 24), F.shiftright(spot, 12).bitwiseAND(4095), spot.bitwiseAND(4095)


def resolve_by_windows(rows: DataFrame) -> DataFrame:
    """(anchor, content, stretches) of contents that occur once, from windows (anchor, place, hash, content,
    window, copies) of all: a window repeats if its copies, over all contents of its anchor with it at
    the same place, are two or more."""
    key = ["anchor", "place", "hash"]
    twice = common.cut(rows.groupBy(*key).agg(F.sum("copies").alias("copies")).where("copies > 1").select(*key))
    kept = rows.where("copies = 1").select(*key, "content", "window").join(twice, key).groupBy("anchor", "content").agg(F.sort_array(F.collect_list("window")).alias("w"))
    return kept.select("anchor", "content", F.transform("w", lambda x: F.array(x, x + F.lit(1).cast("long"))).alias("stretches"))


def looked_up(keyed_docs: DataFrame, sources: DataFrame) -> DataFrame:
    """(text, wanted) of the rows that are sources, each once however often the row is repeated: whoever asks for
    coordinates wants one answer."""
    found = keyed_docs.select("row", "version", "text").join(sources, ["row", "version"])
    return found.groupBy("row", "version").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted")).select("text", "wanted")


SNIPPETS = "anchor long, n long, content long, copies long, spot long, symbols binary"


def _snippets(unit: Unit):
    schema = pa.schema([(c, pa.int64()) for c in ("anchor", "n", "content", "copies", "spot")] + [("symbols", pa.binary())])

    def run(batches):
        for batch in common.byte_batches(batches, BATCH_BYTES):
            rows = []
            for text, wanted in zip(common.as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                symbols = unit.symbols(text)
                for w in wanted:
                    start, n, _ = unpacked(w["spot"])
                    rows.append((w["anchor"], w["n"], w["content"], w["copies"], w["spot"], symbols[start : start + n + unit.span - 1].tobytes()))
            if rows:
                yield common.record(schema, *map(list, zip(*rows, strict=True)))

    return run


WINDOWS = "anchor long, place long, hash long, content long, window long, copies long"


def windows(snippets: DataFrame, unit: Unit) -> DataFrame:
    """A row for each window of each snippet; ``place`` is that of the anchor in the window."""
    schema = pa.schema([(c, pa.int64()) for c in ("anchor", "place", "hash", "content", "window", "copies")])
    kind = unit.symbols(b"").dtype

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                anchor, content, copies, spot = (part.column(i).to_numpy() for i in (0, 1, 2, 3))
                symbols = part.column(4).to_pylist()
                _, n, rel = unpacked(spot)
                codes = unit.codes(np.frombuffer(b"".join(symbols), kind))
                hashes = anchors.window_hashes(codes, unit.span).view(np.int64)
                first = np.cumsum(n + unit.span - 1) - (n + unit.span - 1)
                which = np.repeat(np.arange(len(n)), n)
                at = np.arange(n.sum()) - (np.cumsum(n) - n)[which]
                yield common.record(schema, *map(pa.array, (anchor[which], rel[which] - at, hashes[first[which] + at], content[which], at, copies[which])))

    return snippets.select("anchor", "content", "copies", "spot", "symbols").mapInArrow(run, WINDOWS)


#: Windows of a piece.
PIECE = 9


def pieces(snippets: DataFrame, unit: Unit, symbols: bool) -> DataFrame:
    """Snippets in pieces of a few windows each: (anchor, content, at, n, copies, piece, core), or with ``symbols`` the
    pieces as snippets of their own.  ``piece`` is the hash of all symbols of its windows, ``core`` that of
    the symbols that all windows of a whole piece share, both with the place."""
    names = ("anchor", "content", "at") + (("n", "copies", "spot", "symbols") if symbols else ("n", "copies", "piece", "core"))
    schema = pa.schema([(c, pa.binary() if c == "symbols" else pa.int64()) for c in names])
    kind = unit.symbols(b"").dtype

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                anchor, content, copies, spot = (part.column(i).to_numpy() for i in (0, 1, 2, 3))
                data = part.column(4).to_pylist()
                _, n, rel = unpacked(spot)
                # bounds between pieces are at multiples of PIECE from the anchor, in all contents
                many = rel // PIECE - (rel - n + 1) // PIECE + 1
                which = np.repeat(np.arange(len(n)), many)
                slot = rel[which] // PIECE - (np.arange(many.sum()) - (np.cumsum(many) - many)[which])
                place = np.minimum(rel[which], slot * PIECE + PIECE - 1)
                at = rel[which] - place
                size = place - np.maximum((rel - n + 1)[which], slot * PIECE) + 1
                if symbols:
                    wide = kind.itemsize
                    cut = [data[w][a * wide : (a + s + unit.span - 1) * wide] for w, a, s in zip(which.tolist(), at.tolist(), size.tolist(), strict=True)]
                    yield common.record(schema, pa.array(anchor[which]), pa.array(content[which]), pa.array(at), pa.array(size), pa.array(copies[which]), pa.array(packed(0, size, place)), cut)
                else:
                    rolling = anchors.Rolling(unit.codes(np.frombuffer(b"".join(data), kind)), anchors.BASES[2])
                    begin = (np.cumsum(n + unit.span - 1) - (n + unit.span - 1))[which]
                    first, middle = begin + at, begin + rel[which] - slot * PIECE
                    piece = anchors.mixed(rolling.of(first, first + size + unit.span - 1) ^ anchors.mixed((place << 12 | size).astype(np.uint64))).view(np.int64)
                    core = anchors.mixed(rolling.of(middle, middle + unit.span - PIECE + 1) ^ anchors.mixed(slot.astype(np.uint64))).view(np.int64)
                    yield common.record(schema, *map(pa.array, (anchor[which], content[which], at, size, copies[which], piece, core)))

    return snippets.select("anchor", "content", "copies", "spot", "symbols").mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'symbols' else 'long'}" for c in names))


def resolve_by_pieces(snippets: DataFrame, unit: Unit) -> DataFrame:
    """As ``resolve_by_windows``, for anchors with many contents most of whose windows stand nowhere else.

    Equal pieces become one first.  A piece that occurs twice repeats as a whole; one whose core occurs
    in no other piece has no window elsewhere; only what is left is looked at by windows."""
    rows = pieces(snippets, unit, False)
    distinct = common.cut(rows.groupBy("anchor", "piece").agg(F.sum("copies").alias("copies"), F.min(F.struct("content", "at")).alias("source"), F.min("core").alias("core")))
    several = common.cut(distinct.groupBy("anchor", "core").count().where("count > 1").select("anchor", "core"))
    open_ = distinct.join(several, ["anchor", "core"]).select("anchor", "piece", F.col("copies").alias("all"), "source.content", "source.at")
    shown = pieces(snippets, unit, True).join(open_, ["anchor", "content", "at"]).select("anchor", "n", F.col("piece").alias("content"), F.col("all").alias("copies"), "spot", "symbols")
    some = resolve_by_windows(windows(common.cut(shown), unit)).withColumnRenamed("content", "piece")
    whole = distinct.where("copies > 1").select("anchor", "piece", F.lit(None).cast("array<array<long>>").alias("stretches"))
    marked = common.cut(whole.unionByName(some.join(whole.select("anchor", "piece"), ["anchor", "piece"], "left_anti")))
    found = rows.where("copies = 1").join(marked, ["anchor", "piece"]).select("anchor", "content", F.when(F.col("stretches").isNull(), F.array(F.array(F.col("at"), F.col("at") + F.col("n")))).otherwise(F.transform("stretches", lambda x: F.array(F.col("at") + x[0], F.col("at") + x[1]))).alias("s"))
    return found.groupBy("anchor", "content").agg(F.sort_array(F.flatten(F.collect_list("s"))).alias("stretches"))


def covered(stretches, size: int) -> np.ndarray:
    """Mask of the symbols that the stretches cover."""
    delta = np.zeros(size + 1, np.int32)
    if len(stretches):
        pairs = np.asarray(stretches, np.int64)
        np.add.at(delta, pairs[:, 0], 1)
        np.add.at(delta, pairs[:, 1], -1)
    return np.cumsum(delta[:-1]) > 0


def with_marks(keyed_docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text, stretches) of every row; null stretches where nothing repeats."""
    return keyed_docs.join(found, ["row", "version"], "left").select("doc_id", "text", "stretches")
