"""Ranked lexical search over a forward index in blocks, with the blocks' maxima.

1. A block is a range of the table's documents, of bounded number and bytes.  Its forward index holds the block's terms, and
   of each document which of them it has and how often.  Blocks are a table, written once.
2. The maximum of a term in a block is the most that the term adds to a score there; its weight apart.  For a query
   a block's bound is the sum of its terms' maxima by their weights: no document there scores more.
3. Blocks are sorted by each query's bound and scored from the forward index, first the best few, then ever more in
   each round.  A block is done without a look once its bound is below the score of the k-th best document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import byte_terms, common

TOP = 10
#: Documents of a block at most, and bytes of their texts unless it is a single one.
DOCUMENTS = 512
BYTES = 1 << 21
#: Blocks of a query in the first round, and how many times more in each further one.
FIRST = 4
GROWTH = 16
#: Queries that a task scores at once.
PACK = 64
#: Up to so many rows a table of terms or of chosen blocks is broadcast; above, it is joined by shuffle.
SMALL = 200_000
#: Copies of a query's terms where they are joined by shuffle: a term that every block holds is spread over as many tasks.
SALTS = 32
#: Stands for a null identifier.
NONE = -(1 << 63)
BLOCKS = "block long, documents long, terms long, words binary, ids binary, lengths binary, ends binary, ords binary, tfs binary"


def indexed(number: int, ids: list, texts: list[bytes]) -> tuple | None:
    """A row of BLOCKS, without the documents that have no term; None if none has."""
    buffer, doc, begin, end = byte_terms.slices(texts, byte_terms.LETTERS_AND_DIGITS)
    terms, term = byte_terms.grouped(buffer, begin, end)
    if not terms:
        return None
    cells, tf = byte_terms.counted(doc * len(terms) + term)
    doc_of, ords = np.divmod(cells, len(terms))
    held, first = np.unique(doc_of, return_index=True)
    lengths = np.add.reduceat(tf, first)
    ids = np.array([NONE if x is None else x for x in ids], np.int64)[held]
    ends = np.append(first[1:], len(ords))
    return number, len(held), int(tf.sum()), b"\n".join(terms), ids.tobytes(), lengths.astype(np.int64).tobytes(), ends.astype(np.int64).tobytes(), ords.astype(np.int32).tobytes(), tf.astype(np.int32).tobytes()


def blocks(docs: DataFrame, documents: int = DOCUMENTS, size: int = BYTES) -> DataFrame:
    """The forward index of all documents: rows of BLOCKS."""
    schema = pa.schema([("block", pa.int64()), ("documents", pa.int64()), ("terms", pa.int64())] + [(c, pa.binary()) for c in ("words", "ids", "lengths", "ends", "ords", "tfs")])

    def run(batches):
        number, ids, texts, total = TaskContext.get().partitionId() << 32, [], [], 0

        def done():
            row = indexed(number, ids, texts) if texts else None
            return common.record(schema, *([x] for x in row)) if row else None

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), common.as_bytes(batch.column(1)), strict=True):
                if texts and (len(texts) == documents or total + len(text) > size):
                    if found := done():
                        yield found
                    number, ids, texts, total = number + 1, [], [], 0
                ids.append(i)
                texts.append(text)
                total += len(text)
        if found := done():
            yield found

    return common.id_and_text(docs).mapInArrow(run, BLOCKS)


def normalisers(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of each document; whole numbers of any size in between."""
    return np.array([100 - 90 + 90 * x * n // total for x in lengths.tolist()], np.int64)


def impacts(row: dict, n: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's entries: document's number, term's number and what the term adds to the document's score, its weight apart."""
    read = lambda name, kind=np.int64: np.frombuffer(row[name], kind)
    ends = read("ends")
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    tf = read("tfs", np.int32).astype(np.int64)
    return doc, read("ords", np.int32), 1_000_000_000 * tf // (1000 * tf + 8 * normalisers(read("lengths"), n, total)[doc])


def maxima(index: DataFrame, n: int, total: int) -> DataFrame:
    """(term, block, df, most): of each block's terms the documents that hold it and its maximum."""
    schema = pa.schema([("term", pa.string()), ("block", pa.int64()), ("df", pa.int64()), ("most", pa.int64())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                terms = row["words"].split(b"\n")
                _, ords, impact = impacts(row, n, total)
                most = np.zeros(len(terms), np.int64)
                np.maximum.at(most, ords, impact)
                yield common.record(schema, byte_terms.strings(terms), pa.array(np.full(len(terms), row["block"])), pa.array(np.bincount(ords, minlength=len(terms))), pa.array(most))

    return index.select("block", "words", "lengths", "ends", "ords", "tfs").mapInArrow(run, "term string, block long, df long, most long")


def query_terms(queries: DataFrame) -> DataFrame:
    """(item, term): the distinct terms of each query (item_id, text)."""
    schema = pa.schema([("item", pa.int64()), ("term", pa.string())])

    def run(batches):
        for batch in common.byte_batches(batches, byte_terms.BATCH_BYTES):
            buffer, doc, begin, end = byte_terms.slices(common.as_bytes(batch.column(1)), byte_terms.LETTERS_AND_DIGITS)
            terms, term = byte_terms.grouped(buffer, begin, end)
            if terms:
                of, word = np.divmod(np.unique(doc * len(terms) + term), len(terms))
                yield common.record(schema, batch.column(0).take(pa.array(of)), byte_terms.strings(terms).take(pa.array(word)))

    queries = common.bounded(queries)
    rows = queries.select(F.coalesce(queries["item_id"].cast("long"), F.lit(NONE)).alias("item"), F.coalesce(queries["text"], F.lit("")).alias("text"))
    return rows.mapInArrow(run, "item long, term string").distinct()


def with_terms(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``found`` by the terms of ``wanted``: the smaller side is broadcast after a count, else salted."""
    if wanted.count() <= SMALL:
        return found.join(F.broadcast(wanted), "term")
    salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return found.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"]).drop("salt")


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k best (item, doc, score) of each item, by rank."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def scored(index: DataFrame, chosen: DataFrame, packs: DataFrame, n: int, total: int, k: int) -> DataFrame:
    """(item, doc, score): the k best documents of each chosen (block, item) that score above 0."""
    schema = pa.schema([("item", pa.int64()), ("doc", pa.int64()), ("score", pa.int64())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from look(row)

    def look(row):
        place = {t: i for i, t in enumerate(row["words"].split(b"\n"))}
        doc, ords, impact = impacts(row, n, total)
        ids = np.frombuffer(row["ids"], np.int64)
        wanted = set(row["items"])
        items = [(q["item"], [(place[t], x["w"]) for x in q["terms"] if (t := x["term"].encode()) in place]) for q in row["queries"] if q["item"] in wanted]
        some = np.zeros(len(place), bool)
        some[[o for _, terms in items for o, _ in terms]] = True
        kept = some[ords]
        doc, ords, impact = doc[kept], ords[kept], impact[kept]
        weights = np.zeros(len(place), np.int64)
        if not len(doc):
            return
        which, first = np.unique(doc, return_index=True)
        out = []
        for item, terms in items:
            o, w = np.array(terms, np.int64).reshape(-1, 2).T
            weights[o] = w
            score = np.add.reduceat(weights[ords] * impact, first)
            weights[o] = 0
            above = np.flatnonzero(score > 0)
            order = above[np.lexsort((ids[which[above]], -score[above]))[:k]]
            out.append((np.full(len(order), item), ids[which[order]], score[order]))
        if out:
            yield common.record(schema, *(pa.array(np.concatenate(c)) for c in zip(*out, strict=True)))

    wanted = chosen.groupBy("block", "pack").agg(F.collect_list("item").alias("items"))
    wanted = byte_terms.small(common.cut(wanted), SMALL)
    rows = index.join(wanted, "block").join(byte_terms.small(packs, SMALL // PACK), "pack")
    return rows.select("words", "ids", "lengths", "ends", "ords", "tfs", "items", "queries").mapInArrow(run, "item long, doc long, score long")


def pack_of(item: Column, packs: int) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(packs)).cast("int")


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, documents: int = DOCUMENTS, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each query (item_id, text) with a score above 0.

    Null and empty texts have no terms: such documents count nowhere, such queries find nothing.  Rows of ``queries`` with
    one identifier are one query with the terms of all, null identifiers included.  Documents of equal identifier are
    each ranked; a null one comes first among equal scores.  Empty tables give an empty one.  Other columns,
    whatever their names, are not looked at."""
    spark = docs.sparkSession
    with common.Scratch(spark) as scratch:
        index = scratch.keep(blocks(docs, documents))
        n, total = index.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
        asked = scratch.keep(query_terms(queries), False)
        vocabulary = asked.select("term").distinct()
        most = scratch.keep(with_terms(maxima(index, n, total), vocabulary))
        weight = F.floor(F.lit(1000) * F.log(F.lit(2 * n + 2) / (2 * F.col("df") + 1)))
        weights = most.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight.cast("long").alias("w"))
        weighed = scratch.keep(asked.join(weights, "term"), False)
        items = weighed.select("item").distinct().count()
        if not items:
            return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        many = -(-items // PACK)
        packs = weighed.groupBy("item").agg(F.collect_list(F.struct("term", "w")).alias("terms"))
        packs = scratch.keep(packs.groupBy(pack_of(F.col("item"), many).alias("pack")).agg(F.collect_list(F.struct("item", "terms")).alias("queries")), False)
        bounds = with_terms(most, weighed).groupBy("item", "block").agg(F.sum(F.col("w") * F.col("most")).alias("bound")).where("bound > 0")
        order = Window.partitionBy("item").orderBy(F.desc("bound"), F.asc("block"))
        bounds = scratch.keep(bounds.withColumn("place", F.row_number().over(order)).withColumn("pack", pack_of(F.col("item"), many)))

        found, low, high = None, 0, first
        while True:
            ahead = bounds.where(F.col("place") > low)
            if found is not None:
                least = found.where(F.col("rank") == k).select("item", F.col("score").alias("least"))
                # a document that scores as much as the k-th best may come before it
                ahead = ahead.join(byte_terms.small(least, SMALL), "item", "left").where("least is null or bound >= least")
                if ahead.isEmpty():
                    break
            now = scored(index, ahead.where(F.col("place") <= high).select("block", "pack", "item"), packs, n, total, k)
            found = common.cut(best(now if found is None else now.unionByName(found.drop("rank")), k))
            low, high = high, high * growth
        return found.select(F.nullif("item", F.lit(NONE)).alias("item_id"), F.col("rank").cast("int").alias("rank"), F.nullif("doc", F.lit(NONE)).alias("doc_id"), "score")


def sql(k: int = TOP) -> str:
    """The same in DuckDB SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    terms = f"unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
t AS MATERIALIZED (SELECT row, term, count(*) AS tf FROM (SELECT row, {terms} AS term FROM d) GROUP BY ALL),
lengths AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY ALL),
whole AS (SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS l FROM lengths),
m AS (SELECT lengths.row, 100 - 90 + 90 * lengths.n * whole.n // l AS m FROM lengths, whole),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {terms} AS term FROM benchmark)),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(whole.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, whole GROUP BY term),
s AS (SELECT item_id, row, sum(w * (1000000000 * tf // (1000 * tf + 8 * m))) AS score FROM q JOIN w USING (term) JOIN t USING (term) JOIN m USING (row) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s JOIN d USING (row) WHERE score > 0) WHERE rank <= {k}
"""


def op13_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
