"""Incremental sync: what to fetch, in which batches, and how far a folder's cursor may move."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed


def start_uid(folders: DataFrame, cursors: DataFrame) -> DataFrame:
    """(folder, uidvalidity, start): after the last seen one, or 1 for a new folder or a new generation."""
    known = cursors.select("folder", F.col("uidvalidity").alias("__generation"), "last_seen_uid")
    start = F.when(F.col("__generation") == F.col("uidvalidity"), F.col("last_seen_uid") + 1).otherwise(1)
    return folders.join(known, "folder", "left").select("folder", "uidvalidity", F.coalesce(start, F.lit(1)).cast("long").alias("start"))


def pending(listing: DataFrame, folders: DataFrame, cursors: DataFrame) -> DataFrame:
    """Listed messages (folder, uid) from the start on; servers may list one below it."""
    return listing.join(start_uid(folders, cursors), "folder").where("uid >= start").drop("start")


#: Identifiers of a block are those with the same bits above these.
BLOCK_BITS = 16


def uid_ranges(uids: DataFrame, keys: list[str], uid: str = "uid", parts: int | None = None) -> DataFrame:
    """Runs of consecutive identifiers as (keys, first, last, n).

    Runs are found in blocks of identifiers, in ``parts`` tasks, so a folder of any length is as many as it has blocks. Only those
    that begin or end at a block's edge, two a block at most, are then held against each other along their folder."""
    whole = (1 << BLOCK_BITS) - 1
    rows = uids.select(*keys, uid).withColumn("__block", F.shiftright(F.col(uid).cast("long"), BLOCK_BITS))
    rows = rows.repartition(*([parts] if parts else []), *keys, "__block").distinct()
    runs = rows.withColumn("__run", F.col(uid) - F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(uid)))
    found = [F.min(uid).alias("first"), F.max(uid).alias("last"), F.count(F.lit(1)).alias("n")]
    runs = runs.groupBy(*keys, "__block", "__run").agg(*found).drop("__block", "__run")
    edge = (F.col("first").cast("long").bitwiseAND(whole) == 0) | (F.col("last").cast("long").bitwiseAND(whole) == whole)
    edge = F.coalesce(edge, F.lit(False))
    along = Window.partitionBy(*keys).orderBy("first")
    follows = F.lag("last").over(along) + 1 == F.col("first")
    edges = runs.where(edge).withColumn("__new", F.when(follows, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(along))
    joined = edges.groupBy(*keys, "__run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("__run")
    return runs.where(~edge).unionByName(joined)


def settled_prefix(settled: DataFrame, keys: list[str], uid: str = "uid", done: str = "done", floor: str | None = None) -> DataFrame:
    """(keys, last_seen): the last of the leading run of requested identifiers that are done; the first that
    isn't ends it, and what comes after counts for nothing."""
    upto = Window.partitionBy(*keys).orderBy(uid).rowsBetween(Window.unboundedPreceding, 0)
    seen = settled.withColumn("__open", F.sum(F.when(F.col(done), 0).otherwise(1)).over(upto))
    last = F.max(F.when(F.col("__open") == 0, F.col(uid)))
    low = F.max(floor) if floor else F.lit(0)
    return seen.groupBy(*keys).agg(F.greatest(F.coalesce(last, F.lit(0)), F.coalesce(low, F.lit(0))).cast("long").alias("last_seen"))


def unreturned(requested: DataFrame, returned: DataFrame, keys: list[str]) -> DataFrame:
    """Requested but without an outcome: a gap, like a failure."""
    return requested.join(returned.select(*keys).distinct(), keys, "left_anti")


def byte_batches(messages: DataFrame, keys: list[str], budget: int, uid: str = "uid", size: str = "size", parts: int | None = None) -> DataFrame:
    """(keys, uid, size, batch): greedy batches in the order of ``uid``, closed before the one that would pass the
    budget, with one message at least; an unknown size counts as the whole budget.

    Which batch a message is in depends on all before it in its folder.  So a folder is cut into blocks, and each block says
    what becomes of a batch that is open when it comes: where it ends, for every total it may have by then, and what the
    block's last batch is after that.  These answers are few, and put together along a folder they give each block its open
    batch; then all blocks number their messages.  A folder of any length is as many tasks as it has blocks."""
    cost = F.coalesce(F.col(size), F.lit(budget)).cast("long")
    rows = messages.select(*keys, F.col(uid).cast("long").alias(uid), F.col(size).cast("long").alias(size))
    order = [*keys, uid, cost, size]
    rows = rows.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    # the blocks are read twice and have to be the same
    blocks = checkpointed(rows.select("*", cost.alias("__cost"), F.spark_partition_id().alias("__block"), F.monotonically_increasing_id().alias("__at")))
    own = [F.coalesce(F.to_json(F.struct(k)), F.lit("{}")) for k in keys]
    blocks = blocks.withColumn("__folder", F.concat_ws("\0", *own))
    found = blocks.select("__folder", "__block", "__cost").mapInArrow(_answers(budget), "folder string, block int, whole long, ends array<struct<upto: long, last: long, batches: long>>")
    opened = found.groupBy("folder").applyInArrow(_opened(budget), "folder string, block int, total long, batch long")
    opened = opened.select(F.col("folder").alias("__folder"), F.col("block").alias("__block"), "total", "batch")
    whole = blocks.join(opened, ["__folder", "__block"]).repartition("__folder", "__block").sortWithinPartitions("__folder", "__block", "__at")
    schema = T.StructType([*(blocks.schema[c] for c in (*keys, uid, size)), T.StructField("batch", T.LongType())])

    def number(batches):
        now, batch, total = None, 0, 0
        for part in batches:
            numbers = []
            for folder, block, held, first, begun in zip(*(part.column(c).to_pylist() for c in ("__folder", "__block", "__cost", "total", "batch")), strict=True):
                if (folder, block) != now:
                    now, total, batch = (folder, block), first, begun
                if total + held <= budget or total == 0:
                    total += held
                else:
                    batch, total = batch + 1, held
                numbers.append(batch)
            shown = [part.column(c) for c in (*keys, uid, size)]
            yield pa.RecordBatch.from_arrays([*shown, pa.array(numbers, pa.int64())], names=[*keys, uid, size, "batch"])

    return whole.mapInArrow(number, schema)


def answers(costs: np.ndarray, budget: int) -> list[tuple[int, int, int]]:
    """Of a block's costs, for each message at which a batch that is open before the block may end: the sum of costs before it
    and its own, the total of the block's last batch if a new one begins there, and the number of batches from there on."""
    n, upto = len(costs), np.cumsum(costs)
    before = upto - costs
    some = np.append(np.flatnonzero(costs), n)
    first = some[np.searchsorted(some, np.arange(n))]  # the first message from there on that isn't empty
    following = np.maximum(np.searchsorted(upto, before + budget, side="right"), first + 1)
    last, batches = np.arange(n), np.ones(n, np.int64)
    for i in np.flatnonzero(following < n)[::-1].tolist():
        last[i], batches[i] = last[following[i]], batches[following[i]] + 1
    # an empty batch that is open ends there at the latest; at an empty message one ends only if it was too large before
    end, large = min(int(following[0]), n - 1), int(first[0]) + 1
    return [(int(upto[i]), int(upto[-1] - before[last[i]]), int(batches[i])) for i in range(end + 1) if costs[i] or i in (0, large)]


def _answers(budget: int):
    schema = pa.schema([("folder", pa.string()), ("block", pa.int32()), ("whole", pa.int64()), ("ends", pa.list_(pa.struct([("upto", pa.int64()), ("last", pa.int64()), ("batches", pa.int64())])))])

    def run(batches):
        now, held = None, []

        def done():
            costs = np.concatenate(held)
            ends = [{"upto": u, "last": x, "batches": b} for u, x, b in answers(costs, budget)]
            return pa.RecordBatch.from_pylist([{"folder": now[0], "block": now[1], "whole": int(costs.sum()), "ends": ends}], schema)

        for part in batches:
            folders, costs = part.column(0).to_pylist(), part.column(2).to_numpy()
            cuts = [i for i in range(len(folders)) if i == 0 or folders[i] != folders[i - 1]] + [len(folders)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                key = (folders[a], part.column(1)[a].as_py())
                if now not in (None, key):
                    yield done()
                    held = []
                now = key
                held.append(costs[a:b])
        if held:
            yield done()

    return run


def _opened(budget: int):
    """The open batch at the beginning of each block of a folder: its total so far and its number."""

    def run(table: pa.Table) -> pa.Table:
        total = batch = 0
        out = []
        for row in table.sort_by("block").to_pylist():
            out.append({"folder": row["folder"], "block": row["block"], "total": total, "batch": batch})
            before = 0
            for end in row["ends"]:
                if total + end["upto"] > budget and total + before:
                    total, batch = end["last"], batch + end["batches"]
                    break
                before = end["upto"]
            else:
                total += row["whole"]
        return pa.Table.from_pylist(out, pa.schema([("folder", pa.string()), ("block", pa.int32()), ("total", pa.int64()), ("batch", pa.int64())]))

    return run


def tally(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    count = lambda what: F.count_if(F.col("outcome") == what).alias(what)
    return outcomes.groupBy(*keys).agg(F.count(F.lit(1)).alias("seen"), count("stored"), count("skipped"), count("failed"))


def in_window(events: DataFrame, keys: list[str], seconds: int, at: str = "ts") -> DataFrame:
    """With ``recent``: events of the key in the last so many seconds, this one and equal times included."""
    span = Window.partitionBy(*keys).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("recent", F.count(F.lit(1)).over(span))


def lockout(overflow, base: float = 60.0, most: float = 900.0):
    """Seconds of a lockout that doubles with each event beyond the limit."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), overflow), F.lit(most))
