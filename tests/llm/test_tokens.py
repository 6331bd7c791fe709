"""Token counts, pieces and tables of ids against the libraries on whole texts."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import common, pieces, sstable, token_counts

from .fixtures import SCHEMA, collected, corpus, frame, texts


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(common.tokenizer_path(name))


def test_counts(spark):
    t = library("byte_bpe_50k.json")
    want = [(i, len(x), len(t.encode(x.decode(), add_special_tokens=False).ids)) for i, x in texts()]
    assert collected(token_counts.count_tokens(frame(spark))) == sorted(((*w, w[2] > 512) for w in want), key=repr)


def test_counts_by_other_files(spark):
    m = pieces.codec("piece_bpe_32k.model").model
    got = collected(token_counts.count_tokens(frame(spark), "piece_bpe_32k.model"), "doc_id", "n_tokens")
    assert got == sorted(((i, len(m.encode(x.decode()))) for i, x in texts()), key=repr)


def test_long_texts_are_cut_at_safe_places():
    text = ("word  and\n more 'll  <|endoftext|> x " * 3000) + " "
    counter = token_counts.Counter("byte_bpe_50k.json")
    cut = counter._safe_pieces(text)
    assert "".join(cut) == text and len(cut) > 5
    assert counter.count([text]) == counter.whole([text])


def test_pieces(spark):
    m = pieces.codec("piece_bpe_32k.model").model
    want = []
    for i, x in texts():
        ids = m.encode(x.decode(), add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(m.decode(ids).encode()).hexdigest()))
    assert collected(pieces.digests(frame(spark)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_spans_cover_the_source(spark):
    m = pieces.codec("piece_bpe_32k.model").model
    by_text = {}
    for r in corpus():
        by_text.setdefault(r[0], []).append((r[1] or "").encode())
    encoded = pieces.encode(frame(spark))
    for r in encoded.collect():
        end = r["ends"][-1]
        source = next(t for t in by_text[r["doc_id"]] if len(t) == end and m.encode(t.decode(), add_eos=True) == r["ids"])
        assert b"".join(source[a:b] for a, b in zip(r["begins"], r["ends"], strict=True)) == source
    assert collected(pieces.decode(encoded)) == sorted(((r["doc_id"], r["decoded"]) for r in encoded.collect()), key=repr)


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nmt_nfkc_cf", "identity"])
def test_normaliser_equals_the_library(rule):
    import sentencepiece

    own = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = next(v for k, v in pieces.proto_fields(own.serialized_model_proto()) if k == 3)
    mine = pieces.Normalizer(spec)
    for text in ("ﬁ  Ｈｅｌｌｏ　ｗｏｒｌｄ ①½ ", "á é  ㍿ ​zz", "Straße ÄÖ ﷺ  ", "  x  ", "", "á", "カ゛ ｶﾞ", "  q\n\tr"):
        normal, begin, end = mine(text.encode())
        assert normal.decode() == own.normalize(text)
        assert len(begin) == len(end) == len(normal) and (begin <= end).all() and (np.diff(begin) >= 0).all()


def test_alignment_without_a_map_is_byte_by_byte():
    own = pieces.codec("piece_bpe_32k.model")
    for _, text in texts() + [(0, "é  日本 x ▁".encode()), (0, b" "), (0, b"a"), (0, b"")]:
        normal, begin, end = own.normalizer(text)
        assert normal.decode() == own.model.normalize(text.decode())
        assert len(normal) == len(begin) == len(end)
        at = 0
        for k in range(len(text)):  # the dummy prefix stems from no byte, a space's three bytes from one
            if k == 0:
                assert begin[:3].tolist() == end[:3].tolist() == [0, 0, 0]
                at = 3
            wide = 3 if text[k] == 32 else 1
            assert begin[at : at + wide].tolist() == [k] * wide and end[at : at + wide].tolist() == [k + 1] * wide
            at += wide
        assert at == len(normal)


def test_tables_round_trip(spark, tmp_path):
    t = library("word_bpe_49k.json")
    rows = [(i, [*t.encode(x.decode(), add_special_tokens=False).ids, 1], struct.unpack(">q", xxhash.xxh64(x, 42).digest())[0]) for i, x in texts()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    manifest = sstable.write(frame(spark), f"file://{tmp_path}/t", documents_per_shard=7)
    files = manifest.orderBy("part", "place").collect()
    assert len(files) > 8 and {m["place"] for m in files} > {0} and max(m["n_docs"] for m in files) <= 7
    assert [m["start"] for m in files] == [sum(x["n_ids"] for x in files[:k]) for k in range(len(files))]
    want, start = [], 0
    for i, ids, _ in sorted(rows, key=key):
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert collected(sstable.read(manifest)) == sorted(want, key=repr)
    held = {}
    for i, ids, _ in sorted(rows, key=key):
        held.setdefault(i, []).append(ids)
    tables = [sstable.opened(m["path"]) for m in files]
    for i in [*held, 10**9, -77]:
        assert [x.tolist() for t in tables for x in t.get(i)] == held.get(i, [])


def test_table_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 300)
    path = tmp_path / "x.sst"
    with open(path, "wb") as f:
        w = sstable.Writer(f, 2)
        for i in range(0, 4000, 2):
            w.add(sstable.key_of(i), struct.pack("<HH", i % 65536, 1))
        with pytest.raises(ValueError):
            w.add(sstable.key_of(5), b"")
        w.close()
    t = sstable.opened(f"file://{path}")
    assert len(t.blocks) > 20 and [sstable.id_of(k) for k, _ in t] == list(range(0, 4000, 2))
    assert all(t.get(i)[0].tolist() == [i, 1] for i in range(0, 4000, 2)) and not any(t.get(i) for i in range(1, 4000, 2))
    assert sstable.id_of(sstable.key_of(None)) is None and sstable.key_of(-1) < sstable.key_of(0)


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert token_counts.count_tokens(empty).count() == pieces.digests(empty).count() == 0
    manifest = sstable.write(empty, f"file://{tmp_path}/e")
    assert manifest.count() == 0 == sstable.read(manifest).count()


def test_repeated_identifiers_go_to_several_shards(spark, tmp_path):
    rows = [(None if k % 3 else 5, f"text {k % 90}", "en", "s", 0, "r", k, 0.5, "s", k, "x") for k in range(300)]
    manifest = sstable.write(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/r", documents_per_shard=10)
    sizes = [m["n_docs"] for m in manifest.groupBy("part").agg(F.sum("n_docs").alias("n_docs")).collect()]
    assert len(sizes) == 8 and max(sizes) < 120  # 200 have no identifier
    out = sstable.read(manifest).collect()
    assert len(out) == 300 and sorted(r["start"] for r in out) == sorted(sum(x["n_tokens"] for x in sorted(out, key=lambda r: r["start"])[:k]) for k in range(300))
