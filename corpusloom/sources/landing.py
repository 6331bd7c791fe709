"""A sink for streams of messages whose rows and cursors appear together.

``writeStream.format("landing")`` with an option ``path``.  Tasks write files that nothing names yet; when all are
done, one small file for the batch names them, and the cursors of all folders after it.  A batch that fails takes
its files away, one that is killed leaves files that nobody reads, one that comes again under its number is
known and dropped.  Files go through pyarrow's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage

FOLDER = ("org_id", "connection_id", "folder")


@dataclass
class Landed(WriterCommitMessage):
    """A task's files, and of each folder in them the generation and the last identifier."""

    files: list[str] = field(default_factory=list)
    tops: list[tuple] = field(default_factory=list)


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def tops_of(table: pa.Table) -> list[tuple]:
    """(org_id, connection_id, folder, generation, last identifier) of each folder's latest generation."""
    if not table.num_rows:
        return []
    grouped = table.group_by([*FOLDER, "uidvalidity"]).aggregate([("uid", "max")]).select([*FOLDER, "uidvalidity", "uid_max"])
    return latest(zip(*(c.to_pylist() for c in grouped.columns), strict=True))


def latest(rows) -> list[tuple]:
    """Of (*folder, generation, identifier) the greatest of each folder."""
    found: dict[tuple, tuple] = {}
    for *name, generation, uid in rows:
        found[tuple(name)] = max(found.get(tuple(name), (generation, uid)), (generation, uid))
    return [(*name, *top) for name, top in sorted(found.items(), key=repr)]


class LandingWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Landed:
        fs, root = opened(self.path)
        name, writer, tops = f"data/{uuid.uuid4().hex}.parquet", None, []
        for batch in iterator:
            if not batch.num_rows:
                continue
            if writer is None:
                fs.create_dir(f"{root}/data", recursive=True)
                writer = pq.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=fs, compression="zstd")
            writer.write_batch(batch)
            tops = latest([*tops, *tops_of(pa.Table.from_batches([batch]).select([*FOLDER, "uidvalidity", "uid"]))])
        if writer is None:
            return Landed()
        writer.close()
        return Landed([name], tops)

    def commit(self, messages: list[Landed | None], batchId: int) -> None:  # noqa: N803
        fs, root = opened(self.path)
        known = sorted(batches(self.path))
        if batchId in known:
            return self.abort(messages, batchId)
        before = described(self.path, known[-1])["cursors"] if known else []
        cursors = latest([*map(tuple, before), *(t for m in messages if m for t in m.tops)])
        draft, place = f"{root}/_batches/.{uuid.uuid4().hex}", f"{root}/_batches/{batchId:012d}.json"
        fs.create_dir(f"{root}/_batches", recursive=True)
        with fs.open_output_stream(draft) as out:
            out.write(json.dumps({"files": [f for m in messages if m for f in m.files], "cursors": cursors}).encode())
        fs.move(draft, place)
        return None

    def abort(self, messages: list[Landed | None], batchId: int) -> None:  # noqa: N803
        fs, root = opened(self.path)
        for name in (f for m in messages if m for f in m.files):
            fs.delete_file(f"{root}/{name}")


class Landing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landing"

    def streamWriter(self, schema, overwrite: bool) -> LandingWriter:  # noqa: N802
        missing = {*FOLDER, "uidvalidity", "uid"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"a stream that lands needs {sorted(missing)}")
        return LandingWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Landing)


def batches(path: str) -> list[int]:
    """Numbers of the batches that are there."""
    fs, root = opened(path.rstrip("/"))
    found = fs.get_file_info(pafs.FileSelector(f"{root}/_batches", allow_not_found=True))
    return [int(x.base_name[:-5]) for x in found if x.base_name.endswith(".json")]


def described(path: str, batch: int) -> dict:
    fs, root = opened(path.rstrip("/"))
    with fs.open_input_stream(f"{root}/_batches/{batch:012d}.json") as file:
        return json.loads(file.read())


def landed(spark: SparkSession, path: str, schema, after: int = -1) -> DataFrame:
    """The rows of all batches after this one."""
    files = [f"{path.rstrip('/')}/{f}" for b in sorted(batches(path)) if b > after for f in described(path, b)["files"]]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def cursors(spark: SparkSession, path: str) -> DataFrame:
    """(org_id, connection_id, folder, uidvalidity, last_seen_uid) after the last batch."""
    known = sorted(batches(path))
    rows = [tuple(x) for x in described(path, known[-1])["cursors"]] if known else []
    return spark.createDataFrame(rows, "org_id string, connection_id string, folder string, uidvalidity long, last_seen_uid long")
