"""Shared pieces of the training-data operators: inputs, lineage cuts, byte-balanced batches."""

from __future__ import annotations

import gc
import os
import time
import uuid

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (makes pa.compute available)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded, checkpointed, shared_folder

#: A word of the operator contracts: a run of bytes other than space, \t, \n, \v, \f and \r.
WORD_REGEX = "[^\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Seconds between looks for files that are of no more use: short steps leave little.
EVERY = 2.0
_looked = 0.0


def release(spark: SparkSession, large: bool) -> None:
    """Runs the driver's collectors, so that Spark removes the shuffle files of steps that nothing points to any more
    now rather than at some later time: after a ``large`` step, and if the last look was some time ago."""
    global _looked
    if large or time.monotonic() - _looked > EVERY:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _looked = time.monotonic()


def cut(df: DataFrame, large: bool = False) -> DataFrame:
    """Reliable checkpoint: computed once, kept in the shared folder, survives lost executors. ``large``: what led to it
    was shuffled in the size of the corpus."""
    kept = checkpointed(df)
    release(df.sparkSession, large)
    return kept


def remove(spark: SparkSession, path: str) -> None:
    """Takes away a folder of intermediate rows, whatever store it is in."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def id_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null texts as empty ones; other columns, whatever their names, stay out."""
    docs = bounded(docs)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def table(df: DataFrame, kind: str) -> tuple[DataFrame, str]:
    """The rows as a table in the shared folder, read back from there, and its path; columns take less room than a checkpoint's rows."""
    path = fresh_path(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


class Scratch:
    """Tables in the shared folder that are removed when the work they were for is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            remove(self.spark, path)

    def keep(self, df: DataFrame, large: bool = True) -> DataFrame:
        """Computed once, as a table. ``large`` as for ``cut``."""
        kept, path = table(df, "scratch")
        self.paths.append(path)
        del df
        release(self.spark, large)
        return kept

    def drop_last(self, n: int) -> None:
        """Removes the table before the last ``n``, which no longer is read."""
        remove(self.spark, self.paths.pop(-1 - n))


def free(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``docs`` has, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        found.append(name)
    return found


def byte_batches(batches, limit: int, column: str = "text"):
    """Cuts Arrow batches into runs of rows whose texts hold at most ``limit`` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        sizes = pa.compute.fill_null(pa.compute.binary_length(text), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)


def as_bytes(column) -> list[bytes]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema, strict=True)], schema=schema)


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file; ``CORPUSLOOM_TOKENIZERS`` (a folder) overrides the installed ones."""
    folder = os.environ.get("CORPUSLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


class TwoGenerations:
    """A bounded memo: at most ``2 * limit`` entries, the ones in use move to the young generation."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def fill(self, rows: list[list], longest: int, compute) -> dict:
        """A dict that holds every key of ``rows`` of at most ``longest`` symbols: ``compute`` gets the list of
        the unknown ones and returns their values."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young = self.young
        missing = [k for k in set().union(*rows).difference(young) if len(k) <= longest]
        if missing:
            old, unknown = self.old, []
            for k in missing:
                if k in old:
                    young[k] = old[k]
                else:
                    unknown.append(k)
            if unknown:
                young.update(zip(unknown, compute(unknown), strict=True))
        return young
