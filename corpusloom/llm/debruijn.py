"""Substring dedup over words by a compacted De Bruijn graph.

The graph's edges are word k-mers, k = 35, its nodes their first and last 34 words.

1. Edges are dealt by their minimiser (see ``anchors``): runs of edges with one minimiser are what is
   shuffled.  Minimisers that occur once hold no repeated edge and go.
2. Each distinct run has a source, the first place it stands at.  There its words are read by coordinates, and
   give the edges: one by one where a minimiser's runs differ, the run as one stretch of edges where not.
   Edges that occur twice or more stay, with their multiplicity.
3. Nodes with one edge in and one out join their edges; paths of those compact by pointer doubling, a few
   joins for paths of any length.  The paths are the repeated passages.
4. The paths' stretches return to all runs that hold them, with a check of the source's words by which every
   place is verified when its text is read again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import anchors, common, repeats

WINDOW = 35
#: Words of an anchor. Windows of 35 words hold 24 of them, a run is 12.5 windows long on average.
GRAM = 12


def check_of(words: list[bytes]) -> int:
    """64 bits of a run's words that have nothing to do with the hashes it was found by."""
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "big", signed=True)


#: Anchors with more runs than this have their edges dealt one by one, others as a whole.
HOT = 4096
RUNS = "anchor long, content long, places long, branching boolean, copies long, n long, nodes array<long>, check long"


def runs_of(keyed_docs: DataFrame, contents: DataFrame, unit: repeats.Words) -> DataFrame:
    """Of distinct runs (anchor, content, places, branching, copies, source), read at their sources: rows of RUNS.  ``nodes``:
    of a branching anchor's run, its nodes in order; else the first and the last one, with ``n`` edges between them."""
    schema = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("places", pa.int64()), ("branching", pa.bool_()), ("copies", pa.int64()), ("n", pa.int64()), ("nodes", pa.list_(pa.int64())), ("check", pa.int64())])

    def run(batches):
        for batch in common.byte_batches(batches, repeats.BATCH_BYTES):
            out = []
            for text, wanted in zip(common.as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                words = text.split()
                nodes = anchors.window_hashes(unit.codes(unit.symbols(text)), unit.span - 1).view(np.int64)
                for w in wanted:
                    start, n, _ = repeats.unpacked(w["spot"])
                    own = nodes[start : start + n + 1] if w["branching"] else nodes[[start, start + n]]
                    out.append((w["anchor"], w["content"], w["places"], w["branching"], w["copies"], n, own, check_of(words[start : start + n + unit.span - 1])))
            if out:
                yield common.record(schema, *map(list, zip(*out, strict=True)))

    sources = repeats.wanted_by_source(contents, "places", "branching", "copies")
    return repeats.looked_up(keyed_docs, sources).mapInArrow(run, RUNS)


def edges_of(runs: DataFrame) -> DataFrame:
    """(anchor, content, copies, at, n, head, tail): the edges of runs, one by one or as one stretch of ``n``, from the
    ``at``-th on.  An edge is its nodes: the first and the last 34 of its 35 words are all of them."""
    at = F.transform("nodes", lambda x, i: F.struct(i.cast("long").alias("at"), x.alias("head"), F.get(F.col("nodes"), i + 1).alias("tail")))
    rows = runs.select("anchor", "content", "copies", F.when(F.col("branching"), F.lit(1)).otherwise(F.col("n")).cast("long").alias("n"), F.explode(F.slice(at, F.lit(1), F.size("nodes") - 1)).alias("e"))
    return rows.select("anchor", "content", "copies", "e.at", "n", "e.head", "e.tail")


def repeated_edges(runs: DataFrame, hot: int = HOT) -> DataFrame:
    """(id, anchor, content, at, n, head, tail, times): the edges of runs, or stretches of edges, that occur twice or
    more in all.  An edge's runs have one anchor, so dealt by anchor they are counted where they are."""
    many = F.col("places") > hot
    by_anchor = edges_of(runs.where(F.col("branching") & ~many).repartition("anchor"))
    by_edge = edges_of(runs.where(F.col("branching") & many)).repartition("anchor", "head", "tail")
    times = F.sum("copies").over(Window.partitionBy("anchor", "head", "tail"))
    straight = edges_of(runs.where("not branching")).withColumn("times", F.col("copies"))
    rows = straight.unionByName(by_anchor.withColumn("times", times)).unionByName(by_edge.withColumn("times", times)).where("times > 1")
    return rows.select(F.xxhash64("anchor", "n", "head", "tail").alias("id"), "anchor", "content", "at", "n", "head", "tail", "times")


def compacted(edges: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(id, path, before) of each edge of a graph (id, n, head, tail): the first edge of its nonbranching path, and
    the number of k-mers of the path before it.

    An edge points to the one before it where their common node has one edge in and one out; each round
    replaces every pointer by that of the edge it points to, so that what it leaps over doubles, until all
    point to first edges, which have none.  On a closed cycle no edge is the first: when the number of pointers
    that still move stays the same, only cycles are left, and their edges stay paths of their own."""
    ins, outs = (edges.groupBy(F.col(c).alias("node")).agg(F.count(F.lit(1)).alias(f"{c}s"), F.min("id").alias(f"{c}_id"), F.min("n").alias(f"{c}_n")) for c in ("tail", "head"))
    single = ins.where("tails = 1").join(outs.where("heads = 1"), "node").where("tail_id <> head_id")
    pointers = scratch.keep(single.select(F.col("head_id").alias("id"), F.col("tail_id").alias("path"), F.col("tail_n").alias("before")))
    moving, rounds = None, 0
    while True:
        rounds += 1
        aim = pointers.select(F.col("id").alias("__id"), F.col("path").alias("__path"), F.col("before").alias("__before"))
        leaps = pointers.join(aim, F.col("path") == F.col("__id"), "left")
        leaps = leaps.select("id", F.coalesce("__path", "path").alias("path"), (F.col("before") + F.coalesce("__before", F.lit(0))).alias("before"), F.col("__id").isNotNull().alias("moved"))
        now = scratch.keep(leaps, rounds % 4 == 0)
        scratch.drop_last(1)
        left = now.where("moved").count()
        pointers = now.select("id", "path", "before")
        if left in (0, moving):
            break
        moving = left
    held = now.where("not moved").select("id", "path", "before")
    return edges.select("id").join(held, "id", "left").select("id", F.coalesce("path", "id").alias("path"), F.coalesce("before", F.lit(0)).alias("before"))


class Graph:
    """The compacted graph of a corpus's repeated k-mers, in tables of ``scratch``."""

    def __init__(self, keyed_docs: DataFrame, unit: repeats.Words, scratch: common.Scratch):
        self.unit, self.scratch, keep = unit, scratch, scratch.keep
        self.occurrences = repeats.occurrences_of(keyed_docs, unit, repeats.shared_anchors(keyed_docs, unit, keep).select("anchor", F.col("n").alias("places"), "branching"), keep)
        found = self.occurrences.groupBy("anchor", "content").agg(F.max("places").alias("places"), F.max("branching").alias("branching"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "version", "spot")).alias("source"))
        self.contents = keep(found)
        self.runs = keep(runs_of(keyed_docs, self.contents, unit))
        self.ways = keep(repeated_edges(self.runs))
        edges = keep(self.ways.select("id", "n", "head", "tail", F.col("times").alias("copies")).distinct(), False)
        #: The graph's edges with their path and the k-mers of the path before them.
        self.edges = keep(edges.join(compacted(edges, scratch), "id"))

    def placed(self) -> DataFrame:
        """(anchor, content, path, a, b, before): the stretches [a, b) of windows that runs and paths have in common, and the
        k-mers of the path before them."""
        rows = self.ways.select("id", "anchor", "content", "at", "n").join(self.edges.select("id", "path", "before"), "id")
        # edges of one path that follow each other make one stretch; a run is shorter than a gap would be
        along = rows.groupBy("anchor", "content", "path", (F.col("before") - F.col("at")).alias("shift"))
        return along.agg(F.min("at").alias("a"), F.max(F.col("at") + F.col("n")).alias("b")).select("anchor", "content", "path", "a", "b", (F.col("shift") + F.col("a")).alias("before"))

    def passages(self) -> DataFrame:
        """(path, words, copies, row, version, first): the nonbranching paths as repeated passages: their words, the least
        number of times that a k-mer of theirs occurs, and a place of their first word."""
        ends = self.edges.groupBy("path").agg((F.sum("n") + self.unit.span - 1).alias("words"), F.min("copies").alias("copies"))
        start, _, _ = repeats.unpacked_columns("source.spot")
        heads = self.placed().where("before = 0").join(self.contents, ["anchor", "content"])
        places = heads.groupBy("path").agg(F.min(F.struct("source.row", "source.version", (start + F.col("a")).alias("first"))).alias("at"))
        return ends.join(places, "path").select("path", "words", "copies", "at.*")

    def hits(self) -> DataFrame:
        """(row, version, hits): for each row with repeats its runs that hold stretches of paths: the first word, number of
        words, check of these and stretches of repeated windows in the run, as begin << 12 | end."""
        windows = self.placed().groupBy("anchor", "content").agg(F.collect_list(F.shiftleft("a", 12) + F.col("b")).alias("windows"))
        windows = self.scratch.keep(windows.join(self.runs.select("anchor", "content", "check"), ["anchor", "content"]))
        start, n, _ = repeats.unpacked_columns("spot")
        rows = self.occurrences.join(windows, ["anchor", "content"]).select("row", "version", F.struct(start.alias("first"), (n + F.lit(self.unit.span - 1)).alias("words"), "check", "windows").alias("hit"))
        # repeated rows have the same runs: a set keeps one of each
        return rows.groupBy("row", "version").agg(F.collect_set("hit").alias("hits"))


def removed(words: list[bytes], hits: pa.StructArray, window: int) -> np.ndarray:
    """Mask of the words that repeated windows cover; each hit's words are held against those of its source."""
    first = hits.field("first").to_numpy()
    for at, size, check in zip(first.tolist(), hits.field("words").to_pylist(), hits.field("check").to_pylist(), strict=True):
        if check_of(words[at : at + size]) != check:
            raise ValueError("two different passages have the same hashes")
    windows = hits.field("windows")
    at = np.repeat(first, windows.value_lengths().to_numpy())
    packed = windows.flatten().to_numpy()
    return repeats.covered(np.stack([at + (packed >> 12), at + (packed & 4095) + window - 1], 1), len(words))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(path, words, copies, doc_id, first): the repeated passages of ``docs`` (see ``Graph.passages``) with the document
    and place of their first word.  Null and short texts have none, an empty table gives an empty one."""
    with common.Scratch(docs.sparkSession) as scratch:
        found = Graph(repeats.keyed(docs), repeats.Words(gram, window), scratch).passages()
        return common.cut(found.select("path", "words", "copies", F.nullif("row", F.lit(-(1 << 63))).alias("doc_id"), "first"))


def digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) after the removal of every word that a repeated window covers.

    A null or empty text has no words.  Repeated rows repeat each other, so both lose their windows.
    A null doc_id stays null, an empty table gives an empty one, other columns are not looked at."""

    def run(batches):
        for batch in common.byte_batches(batches, repeats.BATCH_BYTES):
            out, hits = [], batch.column(2)
            for i, text in enumerate(common.as_bytes(batch.column(1))):
                kept = words = text.split()
                if hits[i].is_valid:
                    gone = removed(words, hits[i].values, window)
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield common.record(SCHEMA, batch.column(0), *map(list, zip(*out, strict=True)))

    keyed = repeats.keyed(docs)
    with common.Scratch(docs.sparkSession) as scratch:
        hits, _ = common.table(Graph(keyed, repeats.Words(gram, window), scratch).hits(), "hits")
    marked = keyed.join(hits, ["row", "version"], "left").select("doc_id", "text", "hits")
    return marked.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op5_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir))
