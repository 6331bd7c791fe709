"""Sorted-string-table shards of token ids.

Layout of a file: data blocks, index block, Bloom filter, footer.

* Key: 0x00 for a null identifier, else 0x01 and the identifier as big-endian 64 bits with the sign bit
  flipped, so byte order is null first, then ascending.
* Data block: entries (shared, unshared, value size as varints, key suffix, value), every 16th with
  nothing shared; then the places of those restarts and their number (u32); compressed by zstd, then
  a crc32 of the stored bytes.
* Index block: last key, offset and size of each data block.  Bloom filter: k probes by double hashing.
* Footer of fixed size: places of index and filter, numbers of entries and ids, width of an id, magic.

A reader finds a key by the Bloom filter, binary search in the index, binary search over the block's
restarts and a scan of at most 16 entries.
"""

from __future__ import annotations

import array
import bisect
import functools
import os
import re
import struct
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAGIC = b"CLOOMSS1"
FOOTER = struct.Struct("<QQQQIIQQI8s")
BLOCK_BYTES = 32 << 10
RESTART = 16
BLOOM_BITS, BLOOM_PROBES = 10, 7
BATCH_BYTES = 1 << 20
#: Documents of a shard on average; shards are the unit of writing, reading and recovery.
DOCUMENTS_PER_SHARD = 8192
#: Shards that a task writes at most, or so, once there are more than tasks.
SHARDS_PER_PART = 16
#: Tasks that read, in numbers of shuffle partitions, at most.
READERS = 16
MEMO = 700_000
WORD = 64
#: Words whose lower case and composed form are beyond doubt: Latin letters but for one that has two in lower case.
SIMPLE = re.compile("[a-zA-Z\u00c0-\u012f\u0131-\u024f ]*")
#: After letters these begin a pre-token of their own (an apostrophe may not, and < may begin a special string).
PUNCTUATION = b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def put_varint(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_PROBES)]


class Writer:
    """Takes (key, value) in ascending key order; equal keys may follow each other."""

    def __init__(self, file, width: int):
        self.file, self.width = file, width
        self.zstd = zstandard.ZstdCompressor(level=1)
        self.at = self.entries = self.ids = 0
        self.index = bytearray()
        self.keys: list[bytes] = []
        self.last: bytes | None = None
        self._open()

    def _open(self) -> None:
        self.block, self.restarts, self.in_block = bytearray(), [], 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.last is not None and key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.in_block % RESTART:
            shared = len(os.path.commonprefix([key, self.last]))
        else:
            self.restarts.append(len(self.block))
        for n in (shared, len(key) - shared, len(value)):
            put_varint(self.block, n)
        self.block += key[shared:]
        self.block += value
        self.last = key
        self.in_block += 1
        self.entries += 1
        self.ids += len(value) // self.width
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.in_block:
            body = bytes(self.block) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            stored = self.zstd.compress(body)
            stored += struct.pack("<I", zlib.crc32(stored))
            self.file.write(stored)
            put_varint(self.index, len(self.last))
            self.index += self.last + struct.pack("<QQ", self.at, len(stored))
            self.at += len(stored)
            self._open()

    def close(self) -> None:
        self._flush()
        bits = max(64, BLOOM_BITS * self.entries)
        bloom = np.zeros(bits, np.uint8)
        for key in self.keys:
            bloom[probes(key, bits)] = 1
        bloom = np.packbits(bloom).tobytes()
        self.file.write(bytes(self.index))
        self.file.write(bloom)
        self.file.write(FOOTER.pack(self.at, len(self.index), self.at + len(self.index), len(bloom), bits, BLOOM_PROBES, self.entries, self.ids, self.width, MAGIC))


class Table:
    """Reader of one file by any object with ``seek`` and ``read``."""

    def __init__(self, file, size: int):
        self.file = file
        *places, self.entries, self.ids, self.width, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a table of token ids")
        index_at, index_size, bloom_at, bloom_size, self.bits, _ = places
        self.bloom = self._read(bloom_at, bloom_size)
        self.last_keys, self.blocks = [], []
        data, at = self._read(index_at, index_size), 0
        while at < len(data):
            n, at = get_varint(data, at)
            self.last_keys.append(data[at : at + n])
            self.blocks.append(struct.unpack_from("<QQ", data, at + n))
            at += n + 16

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _block(self, i: int) -> tuple[bytes, tuple[int, ...], int]:
        stored = self._read(*self.blocks[i])
        if zlib.crc32(stored[:-4]) != struct.unpack("<I", stored[-4:])[0]:
            raise ValueError("damaged block")
        body = zstandard.ZstdDecompressor().decompress(stored[:-4])
        (n,) = struct.unpack_from("<I", body, len(body) - 4)
        return body, struct.unpack_from(f"<{n}I", body, len(body) - 4 - 4 * n), len(body) - 4 - 4 * n

    @staticmethod
    def _entries(body: bytes, at: int, end: int):
        key = b""
        while at < end:
            shared, at = get_varint(body, at)
            own, at = get_varint(body, at)
            size, at = get_varint(body, at)
            key = key[:shared] + body[at : at + own]
            at += own
            yield key, body[at : at + size]
            at += size

    def __iter__(self):
        for i in range(len(self.blocks)):
            body, _, end = self._block(i)
            yield from self._entries(body, 0, end)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The id arrays of every entry of this identifier; none if there is no such entry."""
        key, found = key_of(doc_id), []
        if not all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in probes(key, self.bits)):
            return found
        for i in range(bisect.bisect_left(self.last_keys, key), len(self.blocks)):
            body, restarts, end = self._block(i)
            firsts = [next(self._entries(body, r, end))[0] for r in restarts] if len(restarts) < 4 else _Firsts(self, body, restarts, end)
            start = max(0, bisect.bisect_left(firsts, key) - 1)
            for k, value in self._entries(body, restarts[start], end):
                if k > key:
                    return found
                if k == key:
                    found.append(np.frombuffer(value, f"<u{self.width}"))
        return found


class _Firsts:
    """The keys at a block's restarts, read when asked for."""

    def __init__(self, table, body, restarts, end):
        self.table, self.body, self.restarts, self.end = table, body, restarts, end

    def __len__(self):
        return len(self.restarts)

    def __getitem__(self, i):
        return next(self.table._entries(self.body, self.restarts[i], self.end))[0]


def opened(path: str):
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    return Table(fs.open_input_file(name), fs.get_file_info(name).size)


def letters(word: str) -> bool:
    """Letters only, also when normalised: then the word is one pre-token."""
    return word.isalpha() and unicodedata.normalize("NFC", word).lower().isalpha()


class Known(dict):
    """A bounded memo of words' ids that answers at once: an unknown word gets an empty bytearray, which
    ``settle`` fills in place once its ids are known, so rows of answers need no second look."""

    def __init__(self, limit: int, longest: int):
        super().__init__()
        self.limit, self.longest, self.old, self.unknown = limit, longest, {}, {}

    def turn(self) -> None:
        """Between batches: what wasn't asked for since the memo last filled up goes."""
        self.unknown = {}
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()

    def __missing__(self, word: bytes):
        ids = self.old.get(word)
        if ids is None:
            ids = self.unknown.get(word)
            if ids is None:
                ids = self.unknown[word] = bytearray()
            if len(word) > self.longest:
                return ids  # every time anew
        self[word] = ids
        return ids

    def settle(self, word: bytes, ids: bytes) -> None:
        self.unknown[word] += ids
        if len(word) <= self.longest:
            self[word] = ids


class Encoder:
    """Ids of texts as little-endian bytes of a fixed width, an end id after each text.

    The tokenizer drops white space and no pre-token, normalised sequence or special string crosses
    it, so a text's ids are those of its words, which a bounded memo holds.
    """

    def __init__(self, name: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(common.tokenizer_path(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.end = end_id.to_bytes(self.width, "little")
        self.code = "H" if self.width == 2 else "I"
        self.by_word = "word_bpe" in name
        self.ends_word = np.zeros(1 << 8 * self.width if self.width == 2 else self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends_word[i] = token.endswith("</w>")
        #: The same model for words in lower case: without the normaliser and the patterns, which do nothing there.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known = Known(MEMO, WORD)

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        return [array.array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Words of letters are encoded many at a time, with spaces between: the token that ends a word tells
        them apart.  Punctuation after the letters is a pre-token of its own.  Other words go one by one."""
        plain, mixed = [], []
        for word in words:
            (plain if word.isalpha() else mixed).append(word)
        cut = {}
        for word in mixed:
            core = word.rstrip(PUNCTUATION)
            if not (core.isalpha() or letters(core.decode())):
                core = b""
            cut[word] = core, word[len(core) :]
        plain += {core for core, _ in cut.values()}.difference(plain, (b"",))
        found = {b"": b""}
        for at in range(0, len(plain), 1000):
            part = plain[at : at + 1000]
            text = b" ".join(part).decode()
            simple = SIMPLE.fullmatch(text) is not None
            ids = np.array((self.bare if simple else self.tokenizer).encode_batch_fast([text.lower() if simple else text], add_special_tokens=False)[0].ids, f"<u{self.width}")
            stops = np.flatnonzero(self.ends_word[ids]) + 1
            if len(stops) == len(part):
                data, stops = ids.tobytes(), (stops * self.width).tolist()
                found.update(zip(part, [data[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))
            else:
                found.update(zip(part, self._ids(part), strict=True))
        rests = list({rest for _, rest in cut.values()}.difference((b"",)))
        ends = dict(zip(rests, self._ids(rests), strict=True)) | {b"": b""}
        return [found[w] if w not in cut else found[cut[w][0]] + ends[cut[w][1]] for w in words]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return [ids + self.end for ids in self._ids(texts)]
        self.known.turn()
        look = self.known.__getitem__
        rows = [list(map(look, text.split())) for text in texts]
        for word, ids in zip(self.known.unknown, self._words(list(self.known.unknown)), strict=True):
            self.known.settle(word, ids)
        return [b"".join(row) + self.end for row in rows]


@functools.lru_cache(maxsize=2)
def encoder(name: str, end_id: int) -> Encoder:
    return Encoder(name, end_id)


MANIFEST = "part int, place int, path string, n_docs long, n_ids long"


def write(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, documents_per_shard: int = DOCUMENTS_PER_SHARD) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) and writes shards under ``path``, a folder that every executor reaches.

    Returns the manifest, a row a shard: part, place (their order is that of the keys), path, n_docs, n_ids
    and start (ids of all shards before).  A null text is an empty one and has the end id alone; a null
    doc_id sorts first; rows with equal doc_id are ordered by the hash of their text; an empty table
    has no shard.  Texts are dealt by ranges of (doc_id, hash, place in the input), so any spread of
    identifiers, repeated and null ones included, gives even parts; a part writes a shard for each
    ``documents_per_shard`` of its documents.  The driver holds no list of shards or bounds.
    """
    docs = common.id_and_text(docs)
    spark = docs.sparkSession
    shards = -(-docs.count() // documents_per_shard)
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), shards), shards // SHARDS_PER_PART)
    width = encoder(tokenizer, end_id).width
    schema = pa.schema([("part", pa.int32()), ("place", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def store(batches):
        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(folder)
        own, part = encoder(tokenizer, end_id), TaskContext.get().partitionId()
        writer, done = None, []

        def finish():
            writer.close()
            writer.file.close()
            # another attempt of this task writes the same bytes; the last one to be renamed stays
            name = f"{part:06d}-{len(done):06d}.sst"
            fs.move(draft, f"{folder}/{name}")
            done.append((part, len(done), f"{path.rstrip('/')}/{name}", writer.entries, writer.ids))

        for batch in common.byte_batches(batches, BATCH_BYTES):
            for doc_id, value in zip(batch.column(0).to_pylist(), own(common.as_bytes(batch.column(1))), strict=True):
                if writer and writer.entries == documents_per_shard:
                    finish()
                    writer = None
                if not writer:
                    draft = f"{folder}/.{part:06d}-{uuid.uuid4().hex}"
                    writer = Writer(fs.open_output_stream(draft), width)
                writer.add(key_of(doc_id), value)
        if writer:
            finish()
        if done:
            yield common.record(schema, *map(list, zip(*done, strict=True)))

    order = [F.col("doc_id").asc_nulls_first(), F.col("version").asc()]
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("version"), F.monotonically_increasing_id().alias("row"))
    dealt = keyed.repartitionByRange(parts, *order, "row").sortWithinPartitions(*order).select("doc_id", "text")
    manifest = common.cut(dealt.mapInArrow(store, MANIFEST), True)
    # a row a part comes together here
    totals = manifest.groupBy("part").agg(F.sum("n_ids").alias("all")).withColumn("before", F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("all"))
    upto = F.sum("n_ids").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    starts = manifest.withColumn("upto", upto).join(totals.select("part", "before"), "part")
    return starts.select(*manifest.columns, (F.col("before") + F.col("upto") - F.col("n_ids")).alias("start"))


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every entry of the manifest's shards (path, start).

    ``start`` is the number of ids of all entries before; the crc32 is that of the ids as
    little-endian unsigned 32-bit integers."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                table, start, rows = opened(shard["path"]), shard["start"], []
                for key, value in table:
                    ids = np.frombuffer(value, f"<u{table.width}")
                    rows.append((id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 4096:
                        yield common.record(schema, *map(list, zip(*rows, strict=True)))
                        rows = []
                if rows:
                    yield common.record(schema, *map(list, zip(*rows, strict=True)))

    # dealt by number: shards are large, their rows of the manifest are not
    tasks = max(1, min(manifest.count(), READERS * int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return manifest.select("path", "start").repartition(tasks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(common.documents(spark, sf_dir), common.fresh_path(spark, "sst")))
