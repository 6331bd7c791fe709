"""Mixing sources to target weights by cube-method balanced sampling.

Each source's documents get the inclusion probability target / size of the source.  Whole parts are
whole copies; what is left, a fraction common to the source's documents, is sampled so that the
sample's number of documents and of tokens stay balanced: a flight moves the vector of fractional
probabilities along the null space of the two constraints, three documents at a time, until each has
reached 0 or 1 but for two at most.  A source is flown in blocks; what the blocks leave is flown
again, level by level, until a landing problem of at most 14 documents is left, which is solved by
trying all outcomes.  Moves are drawn from hashes of the documents, so reruns agree.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
#: A source's target is at most this many times its size.
CAP = 3
SEED = 17
#: Documents of a block.
BLOCK = 4096
#: Documents, of all sizes, that a source's last flight leaves to the landing, besides two at most.
LANDING = 12


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size): shares of the total by repeating weights in the order
    of code points, null last.  Targets stop at ``cap`` times the size and the excess is shared by weight
    among the rest until none is above: in the order of cap by weight, sources are full as long as the
    level that the rest would get is above their cap.

    The windows run over one row for each source."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    rows = total.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("double"))
    rows = rows.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(F.lit(0))
    rest = F.sum("source_size").over(all_) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rest_weight = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", rest / rest_weight)
    rows = rows.withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    # the first source that isn't full sets the level of all after it
    rows = rows.withColumn("level", F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), "level"))).over(all_)["level"])
    target = F.when(F.col("full"), F.col("most")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("most")))
    return rows.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def drawn(keys: tuple[int, int, int], salt: int) -> float:
    """In [0, 1), from the keys of the three documents that are to move."""
    return (xxhash.xxh64_intdigest(struct.pack("<3q", *keys), salt) >> 11) / (1 << 53)


def flight(rows: list[list], salt: int) -> tuple[list[list], list[list]]:
    """Moves probabilities until at most two are undecided. rows: [key, size, probability], changed in place.

    Returns the decided and the undecided ones.  Sums of probability and of probability times size
    stay, but for rounding."""
    eps = 1e-9
    decided, live = [], []
    for row in rows:
        live.append(row)
        while len(live) == 3:
            (ka, za, pa_), (kb, zb, pb), (kc, zc, pc) = live
            ua, ub, uc = zc - zb, za - zc, zb - za  # orthogonal to (1, 1, 1) and to the sizes
            if not (ua or ub or uc):
                ua, ub, uc = 1, -1, 0
            up = down = float("inf")
            for p, u in ((pa_, ua), (pb, ub), (pc, uc)):
                if u > 0:
                    up, down = min(up, (1 - p) / u), min(down, p / u)
                elif u < 0:
                    up, down = min(up, p / -u), min(down, (1 - p) / -u)
            step = up if drawn((ka, kb, kc), salt) * (up + down) < down else -down
            kept = []
            for r, u in zip(live, (ua, ub, uc), strict=True):
                p = r[2] = r[2] + step * u
                if p < eps or p > 1 - eps:
                    r[2] = float(p > 0.5)
                    decided.append(r)
                else:
                    kept.append(r)
            live = kept
    return decided, live


def land(rows: list[list]) -> list[list]:
    """Decides the last rows, few enough to try all outcomes: the one nearest to the expected sum of sizes,
    then to the expected number."""
    if rows:
        outcomes = (np.arange(1 << len(rows))[:, None] >> np.arange(len(rows))) & 1
        sizes, p = np.array([r[1] for r in rows], np.float64), np.array([r[2] for r in rows])
        best = np.lexsort((np.abs(outcomes.sum(1) - p.sum()), np.abs(outcomes @ sizes - sizes @ p)))[0]
        for r, x in zip(rows, outcomes[best], strict=True):
            r[2] = float(x)
    return rows


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(doc_id, version, source, size, source_size, target, copies) of every row of ``docs`` (doc_id, text, source).

    ``size`` is the number of words (a null text: 0), ``copies`` how often the mix takes the row: at most
    ``cap`` times.  ``version`` is the text's hash; rows with equal doc_id and text are taken alike.  A
    null source is a source of its own, the last; with an empty table there is nothing to mix."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), docs["source"].cast("string").alias("source"), F.regexp_count(text, F.lit(common.WORD_REGEX)).cast("long").alias("size"))
    rows = common.cut(rows)
    aims = common.cut(targets(rows, weights, cap))
    # units of the sampling: rows that are equal share one decision
    key = F.xxhash64(F.coalesce("doc_id", F.lit(-(1 << 63))), "version", F.lit(seed))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.join(aims.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    near = F.round(ratio)
    whole = F.when(F.abs(ratio - near) < 1e-9, near).otherwise(F.floor(ratio))
    rows = rows.withColumn("key", key).withColumn("whole", whole.cast("long")).withColumn("part", F.greatest(ratio - whole, F.lit(0.0)))
    units = rows.where("part > 0").groupBy("source", "key").agg(F.sum("size").alias("size"), F.min("part").alias("p"))
    chosen = sample(units, seed, block)
    if chosen is None:
        return rows.select("doc_id", "version", "source", "size", "source_size", "target", F.col("whole").alias("copies"))
    extra = chosen.select(F.col("source").alias("__source"), F.col("key").alias("__key"))
    out = rows.join(extra, F.col("source").eqNullSafe(F.col("__source")) & (F.col("key") == F.col("__key")), "left")
    copies = F.col("whole") + F.when(F.col("__key").isNotNull() & (F.col("part") > 0), 1).otherwise(0)
    return out.select("doc_id", "version", "source", "size", "source_size", "target", copies.alias("copies"))


FLOWN = "source string, key long, size long, p double, block long"


def sample(units: DataFrame, seed: int, block: int) -> DataFrame | None:
    """(source, key) of the units (source, key, size, p) that balanced sampling takes. None: there is none."""
    units = common.cut(units)
    most = units.groupBy("source").count().agg(F.max("count")).first()[0]
    if not most:
        return None
    blocks = max(1, -(-most // block))
    live = units.withColumn("block", F.pmod(F.xxhash64("key", F.lit(seed + 1)), F.lit(blocks)))
    taken = None
    while True:
        last = blocks == 1
        flown = common.cut(fly(live, seed + blocks, last))
        ones = flown.where("p = 1").select("source", "key")
        taken = ones if taken is None else taken.unionByName(ones)
        if last:
            return common.cut(taken)
        # blocks left two each at most: so many go together that a block is about full again
        blocks = -(-2 * blocks // block)
        live = flown.where("p > 0 and p < 1").withColumn("block", F.pmod("block", F.lit(blocks)))


def fly(live: DataFrame, salt: int, landing: bool) -> DataFrame:
    schema = pa.schema([("source", pa.string()), ("key", pa.int64()), ("size", pa.int64()), ("p", pa.float64()), ("block", pa.int64())])

    def run(batches):
        held: list[list] = []
        now = object()

        def flush():
            spared = held[:: max(1, len(held) // LANDING)][-LANDING:] if landing else []
            apart = {id(r) for r in spared}
            decided, left = flight([r for r in held if id(r) not in apart], salt)
            done = decided + (land(left + spared) if landing else left)
            if done:
                yield common.record(schema, [now[0]] * len(done), [r[0] for r in done], [r[1] for r in done], [r[2] for r in done], [now[1]] * len(done))

        started = False
        for batch in batches:
            for source, key, size, p, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if started and now != (source, block):
                    yield from flush()
                    held = []
                started, now = True, (source, block)
                held.append([key, size, p])
        if started:
            yield from flush()

    # large documents are decided first and against neighbours in size, so what is left to land is small
    order = ["source", "block", F.col("size").desc(), "key"]
    return live.select("source", "key", "size", "p", "block").repartition("source", "block").sortWithinPartitions(*order).mapInArrow(run, FLOWN)


def take(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row of ``docs`` with all its columns, as often as it is taken.

    Null texts and empty ones have no words and are taken like any other row; rows that are equal in doc_id,
    text and source are taken alike.  A null source is a source of its own.  An empty table gives an empty one."""
    ident, version, origin, copies, copy = common.free(docs, "id", "version", "origin", "copies", "copy")
    mixed = mix(docs, **how).groupBy("doc_id", "version", "source").agg(F.max("copies").alias("copies")).where("copies > 0")
    mixed = common.cut(mixed.select(F.col("doc_id").alias(ident), F.col("version").alias(version), F.col("source").alias(origin), F.col("copies").cast("int").alias(copies)))
    same = docs["doc_id"].cast("long").eqNullSafe(mixed[ident]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == mixed[version])
    same = same & docs["source"].cast("string").eqNullSafe(mixed[origin])
    return docs.join(mixed, same).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)).drop(copy)


def op3_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(common.documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
