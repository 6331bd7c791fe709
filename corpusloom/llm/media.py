"""Media columns: documents as progressive JPEG payloads, decoded to RGB tensors and features."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, jpeg

UNIT = 576
BATCH_BYTES = 1 << 19


def padded(text: bytes) -> bytes:
    """The text with bytes 255 appended up to a positive multiple of 576."""
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def feature(tensor: np.ndarray) -> str:
    """Shape, mean and spread of the channels, from exact integer sums."""
    flat = tensor.reshape(-1, 3)
    n = len(flat)
    total = flat.sum(0, dtype=np.int64)
    square = np.einsum("ij,ij->j", flat, flat, dtype=np.int64, casting="unsafe")
    spread = [max(0, n * int(q) - int(s) ** 2) * 100 // (n * n) for s, q in zip(total, square, strict=True)]
    return f"{tensor.shape[0]}x{tensor.shape[1]};mean={','.join(str(int(s) * 100 // n) for s in total)};var={','.join(map(str, spread))}"


MEDIA = "doc_id long, n_bytes long, media binary"


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text, padded, as a JPEG.  A null or empty text is a payload of
    padding alone.  Repeated rows and null identifiers stay, an empty table gives an empty one."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        for batch in common.byte_batches(batches, BATCH_BYTES):
            texts = common.as_bytes(batch.column(1))
            yield common.record(schema, batch.column(0), [len(t) for t in texts], [jpeg.encode(padded(t)) for t in texts])

    return common.id_and_text(docs).mapInArrow(run, MEDIA)


def tensors(media: DataFrame) -> DataFrame:
    """(doc_id, height, width, rgb) from a column ``media`` of progressive JPEGs, those of other origin
    included: the full-resolution tensor in row order.  A null or unreadable image has nulls."""
    schema = pa.schema([("doc_id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())])

    def one(data):
        try:
            tensor = jpeg.rgb(jpeg.decode(data))
        except (TypeError, ValueError, IndexError, KeyError, StopIteration, AttributeError, jpeg.struct.error):
            return None, None, None
        return *tensor.shape[:2], tensor.tobytes()

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                yield common.record(schema, part.column(0), *map(list, zip(*map(one, part.column(1).to_pylist()), strict=True)))

    return media.select(media["doc_id"].cast("long").alias("doc_id"), "media").mapInArrow(run, "doc_id long, height int, width int, rgb binary")


def store(rows: DataFrame, path: str) -> DataFrame:
    """The rows, media or tensors, written to Parquet under ``path`` and read back from there."""
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


DIGEST = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def digests(media: DataFrame) -> DataFrame:
    """Of every row of stored ``media`` (doc_id, n_bytes, media; see ``to_media``): digests of the payload that the
    JPEG's coefficients hold and of the JPEG, and the feature of its tensor.

    Equal texts have equal values, repeated rows and null identifiers stay, an empty table gives an empty one."""

    def one(data: bytes):
        image = jpeg.decode(data)
        payload = jpeg.payload(image)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(jpeg.rgb(image))

    def run(batches):
        for batch in common.byte_batches(batches, BATCH_BYTES, "media"):
            yield common.record(DIGEST, batch.column(0), batch.column(1), *map(list, zip(*map(one, batch.column(2).to_pylist()), strict=True)))

    return common.bounded(media).select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(store(to_media(common.documents(spark, sf_dir)), common.fresh_path(spark, "media")))
