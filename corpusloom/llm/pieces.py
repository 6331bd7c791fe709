"""SentencePiece encoding and decoding with offsets into the source text.

The model file is read here for its normaliser: the compiled character map is a double-array trie
over byte strings, and at each place the *longest* prefix that the trie holds is replaced by its
mapped form.  ``Normalizer`` records, for every byte of the normalised text, the source bytes it
stems from.  Pieces, in order, tile the normalised text, so each is projected to a source span.

Where the map is empty, texts are encoded unit by unit: a unit is a run of spaces and the word after it.
No piece of a model that splits at white space holds a space after another character, so merges
never cross units and a bounded memo of units gives the library's ids of the whole text.  Texts or models
for which that doesn't hold go through the library whole.  Alignment is that of the whole text always.
"""

from __future__ import annotations

import array
import functools
import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BATCH_BYTES = 1 << 20
MEMO = 100_000
#: Units longer than this many characters are encoded each time.
UNIT = 48
SPACE = "▁"
UNITS = re.compile(r" +[^ ]+| +$")


def proto_fields(data: bytes):
    """(number, value) of a protocol-buffer message: ints for varints, bytes for the other wire types."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """The compiled map: size of the trie in bytes, the trie's 32-bit units, then zero-ended strings."""

    def __init__(self, compiled: bytes):
        self.units: tuple[int, ...] = ()
        self.strings = b""
        if compiled:
            (size,) = struct.unpack_from("<I", compiled)
            self.units = struct.unpack_from(f"<{size // 4}I", compiled, 4)
            self.strings = compiled[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest prefix of ``data[at:]`` that the map holds, and its mapped form."""
        if not self.units:
            return None
        units, found = self.units, None
        node = self._child(units[0], 0)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node = self._child(unit, node)
            if unit >> 8 & 1:
                place = units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.strings[place : self.strings.index(b"\0", place)])
        return found

    @staticmethod
    def _child(unit: int, node: int) -> int:
        return node ^ (unit >> 10) << ((unit & 0x200) >> 6)


class Normalizer:
    def __init__(self, spec: bytes):
        fields = dict(proto_fields(spec))
        self.map = CharacterMap(fields.get(2, b""))
        self.dummy_prefix = bool(fields.get(3, 1))
        self.trims = bool(fields.get(4, 1))
        self.escapes = bool(fields.get(5, 1))

    def __call__(self, source: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Normalised bytes, and for each of them the first and the end byte of what it stems from."""
        space = SPACE.encode() if self.escapes else b" "
        if not self.map.units and not self.trims:
            return self._plain(source, space)
        out, begin, end = bytearray(), [], []

        def put(piece: bytes, a: int, b: int) -> None:
            out.extend(piece)
            same = len(piece) == b - a and piece == source[a:b]  # then byte for byte
            begin.extend(range(a, b) if same else [a] * len(piece))
            end.extend(range(a + 1, b + 1) if same else [b] * len(piece))

        at, blank = 0, self.trims
        while at < len(source):
            if mapped := self.map.longest(source, at):
                size, form = mapped
            else:
                size = 1
                while at + size < len(source) and source[at + size] & 0xC0 == 0x80:
                    size += 1
                form = source[at : at + size]
            if not out and form and not (blank and form == b" ") and self.dummy_prefix:
                put(space, at, at)
            for part in re.findall(rb" |[^ ]+", form):
                if part != b" ":
                    put(part, at, at + size)
                elif not (self.trims and blank):
                    put(space, at, at + size)
                blank = part == b" "
            at += size
        if self.trims:
            while out.endswith(space) and len(out) > len(space) * self.dummy_prefix:
                del out[-len(space) :], begin[-len(space) :], end[-len(space) :]
        return bytes(out), np.array(begin, np.int32), np.array(end, np.int32)

    def _plain(self, source: bytes, space: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Without a map no prefix is replaced: every byte stands for itself, but for spaces."""
        at = np.repeat(np.arange(len(source), dtype=np.int32), np.where(np.frombuffer(source, np.uint8) == 32, len(space), 1))
        prefix = space if self.dummy_prefix and source else b""
        none = np.zeros(len(prefix), np.int32)
        return prefix + source.replace(b" ", space), np.concatenate([none, at]), np.concatenate([none, at + 1])


class Codec:
    def __init__(self, name: str):
        import sentencepiece

        path = common.tokenizer_path(name)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            data = file.read()
        self.normalizer = Normalizer(next(v for k, v in proto_fields(data) if k == 3))
        pieces = [dict(proto_fields(v)) for k, v in proto_fields(data) if k == 1]
        self.eos = self.model.eos_id()
        texts = [p[1].decode() for p in pieces]
        kinds = [p.get(3, 1) for p in pieces]
        #: Bytes of normalised text that a piece stands for; 0 for an unknown piece: a whole character.
        self.sizes = np.array([1 if k == 6 else 0 if k == 2 else len(t.encode()) for t, k in zip(texts, kinds, strict=True)], np.int32)
        self.by_unit = not (self.normalizer.map.units or self.normalizer.trims or not self.normalizer.dummy_prefix or 4 in kinds or any(SPACE in t.lstrip(SPACE) for t in texts))
        self.lone_space = self.model.piece_to_id(SPACE)
        self.memo = common.TwoGenerations(MEMO)

    # one text

    def spans(self, source: bytes, ids) -> tuple[np.ndarray, np.ndarray]:
        """Source span of each piece (without the end id)."""
        normal, begin, end = self.normalizer(source)
        sizes = self.sizes[np.asarray(ids, np.int64)]
        if (sizes == 0).any():
            at = 0
            for i in range(len(sizes)):
                if sizes[i] == 0:  # runs of unknown characters become one piece
                    rest = normal[at:]
                    n = 1
                    while n < len(rest) and (rest[n] & 0xC0 == 0x80 or (i + 1 == len(sizes) and n < len(rest))):
                        n += 1
                    sizes[i] = n
                at += sizes[i]
        stop = np.cumsum(sizes)
        if not len(stop):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        if stop[-1] != len(normal):
            raise ValueError("pieces don't tile the normalised text")
        return begin[stop - sizes], end[stop - 1]

    # many texts

    def units(self, texts: list[str]) -> list[list[str] | None]:
        """Keys of each text's units: the unit without its first space. None: encode the text whole."""
        out: list[list[str] | None] = []
        for text in texts:
            if not self.by_unit or SPACE in text:
                out.append(None)
            elif not text:
                out.append([])
            else:
                keys = text.split(" ")
                out.append([u[1:] for u in UNITS.findall(" " + text)] if "" in keys else keys)
        return out

    def rate(self, keys: list[str]) -> list[tuple[bytes, bytes, bytes]]:
        """Of each unit: ids, decimal ids, decoded text."""
        out = []
        rows = self.model.encode(keys, num_threads=1)
        decoded = self.model.decode(rows, num_threads=1)
        for key, ids, text in zip(keys, rows, decoded, strict=True):
            if not key:  # a space alone
                ids, text = [self.lone_space], ""
            out.append((array.array("i", ids).tobytes(), (" ".join(map(str, ids)) + " ").encode(), (" " + text).encode()))
        return out

    def digests(self, texts: list[str]) -> list[tuple[int, str, str, int]]:
        """Of each text: ids with the end id, sha256 of the decimal ids, of the decoded text, crc32 of the spans."""
        units = self.units(texts)
        memo = self.memo.fill([keys for keys in units if keys], UNIT, self.rate)
        out = []
        tail = str(self.eos).encode()
        for text, keys in zip(texts, units, strict=True):
            if keys is None:
                ids = np.array(self.model.encode(text), np.int32)
                said, decoded = (" ".join(map(str, ids.tolist())) + " " * bool(len(ids))).encode(), self.model.decode([*ids.tolist(), self.eos]).encode()
            else:
                long = [k for k in keys if len(k) > UNIT]
                rest = dict(zip(long, self.rate(long), strict=True)) if long else {}
                rows = [memo[k] if len(k) <= UNIT else rest[k] for k in keys]
                ids = np.frombuffer(b"".join([r[0] for r in rows]), np.int32)
                said = b"".join([r[1] for r in rows])
                decoded = b"".join([r[2] for r in rows])[1:]
            n = len(ids)
            begin, end = self.spans(text.encode(), ids)
            spans = np.stack([begin, end], 1).astype("<i4").tobytes() if n else b""
            out.append((n + 1, hashlib.sha256(said + tail).hexdigest(), hashlib.sha256(decoded).hexdigest(), zlib.crc32(spans)))
        return out


@functools.lru_cache(maxsize=2)
def codec(name: str) -> Codec:
    return Codec(name)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("spans_crc32", pa.int64())])


def digests(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32) of every row of ``docs``.

    Ids are the library's, with the end id only.  A null or empty text has the end id alone.
    Repeated rows give repeated rows, a null doc_id stays null, an empty table gives an empty one,
    other columns are not looked at.
    """

    def run(batches):
        of = codec(model).digests
        for batch in common.byte_batches(batches, BATCH_BYTES):
            yield common.record(SCHEMA, batch.column(0), *zip(*of(batch.column(1).to_pylist()), strict=True))

    return common.id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long")


ENCODED = "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string"


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """The pieces themselves: ids (end id last), the source byte span of each (the end id's is empty,
    at the end of the text) and the decoded text.  Nulls and repeats as in ``digests``."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches):
        own = codec(model)
        for batch in common.byte_batches(batches, BATCH_BYTES):
            rows = []
            for text in batch.column(1).to_pylist():
                source = text.encode()
                ids = own.model.encode(text)
                begin, end = own.spans(source, ids)
                rows.append(([*ids, own.eos], [*begin.tolist(), len(source)], [*end.tolist(), len(source)], own.model.decode([*ids, own.eos])))
            yield common.record(schema, batch.column(0), *map(list, zip(*rows, strict=True)))

    return common.id_and_text(docs).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, text) of rows of ids; null ids give a null text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        own = codec(model)
        for batch in batches:
            yield common.record(schema, batch.column(0), [None if ids is None else own.model.decode(ids) for ids in batch.column(1).to_pylist()])

    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir))
