"""JPEG payloads and decoding, quality rules against their SQL, the classifier on held-out rows."""

import hashlib
import os
import zlib

import numpy as np
import pytest

from corpusloom.llm import classifier, jpeg, media, quality_rules

from .. import oracle
from .fixtures import SCHEMA, collected, corpus, frame, texts


def test_zigzag():
    assert jpeg.ZIGZAG[:12].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25] and jpeg.ZIGZAG[-2:].tolist() == [62, 63]


@pytest.mark.parametrize("n", [1, 2, 7, 40, 700])
def test_payload_round_trip(n):
    payload = os.urandom(576 * n)
    image = jpeg.decode(jpeg.encode(payload))
    assert jpeg.payload(image) == payload
    assert jpeg.rgb(image).shape == (image.height, image.width, 3)


def test_scans_bit_by_bit_equal_whole_scans(monkeypatch):
    data = jpeg.encode(os.urandom(576 * 3))
    fast = jpeg.decode(data)
    monkeypatch.setattr(jpeg, "_whole", lambda *a: False)
    slow = jpeg.decode(data)
    assert all((a.coefficients == b.coefficients).all() for a, b in zip(fast.components, slow.components, strict=True))


class Coder:
    """A plain progressive coder of sparse coefficients with runs, end-of-band runs and refinement."""

    LENGTH = 8  # every symbol that is used has a code of eight bits

    def __init__(self):
        self.bits, self.symbols = [], {}

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def code(self, symbol):
        self.put(self.symbols.setdefault(symbol, len(self.symbols)), self.LENGTH)

    def value(self, v):
        size = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << size) - 1, size)

    def table(self, kind):
        return jpeg.table(kind, 0, [(8, s) for s in self.symbols])


def sparse_jpeg(blocks, across, down, low):
    """One component; DC, then the band 1-63 to ``low`` bits, then refinements down to 0."""
    shift = lambda v, n: int(abs(v) >> n) * (1 if v > 0 else -1)
    out = [b"\xff\xd8", jpeg.segment(0xDB, b"\0" + b"\1" * 64), jpeg.segment(0xC2, bytes([8, 0, 8 * down, 0, 8 * across, 1, 1, 0x11, 0]))]
    c, before = Coder(), 0
    for b in blocks:
        d = int(b[0]) - before
        before = int(b[0])
        c.code(abs(d).bit_length())
        if d:
            c.value(d)
    out += [c.table(0), jpeg.scan(1, 0, 0, 0, 0, 0), jpeg.stuffed(np.array(c.bits, np.uint8))]
    c, run = Coder(), 0

    def end_run():
        nonlocal run
        if run:
            n = run.bit_length() - 1
            c.code(n << 4)
            c.put(run - (1 << n), n)
            run = 0

    for b in blocks:
        zeros = 0
        for k in range(1, 64):
            v = shift(b[k], low)
            if not v:
                zeros += 1
                continue
            end_run()
            while zeros > 15:
                c.code(0xF0)
                zeros -= 16
            c.code(zeros << 4 | abs(v).bit_length())
            c.value(v)
            zeros = 0
        run += bool(zeros)
    end_run()
    out += [c.table(1), jpeg.scan(1, 0, 1, 63, 0, low), jpeg.stuffed(np.array(c.bits, np.uint8))]
    for bit in range(low - 1, -1, -1):
        c = Coder()
        for b in blocks:
            fixes, zeros = [], 0
            last = max((k for k in range(1, 64) if abs(shift(b[k], bit)) == 1), default=0)
            for k in range(1, 64):
                v = shift(b[k], bit)
                if abs(v) > 1:
                    fixes.append(abs(v) & 1)
                elif v == 0 or k > last:
                    zeros += 1
                    if zeros == 16 and k < last:
                        c.code(0xF0)
                        [c.put(f, 1) for f in fixes]
                        fixes, zeros = [], 0
                else:
                    c.code(zeros << 4 | 1)
                    c.put(int(v > 0), 1)
                    [c.put(f, 1) for f in fixes]
                    fixes, zeros = [], 0
            if last < 63:
                c.code(0)
                [c.put(f, 1) for f in fixes]
        out += [c.table(1), jpeg.scan(1, 0, 1, 63, bit + 1, bit), jpeg.stuffed(np.array(c.bits, np.uint8))]
    return b"".join([*out, b"\xff\xd9"])


@pytest.mark.parametrize("low", [0, 1, 2])
def test_sparse_coefficients(low):
    r = np.random.default_rng(low)
    blocks = np.zeros((12, 64), np.int64)
    for b in blocks[:10]:
        k = r.integers(0, 64, int(r.integers(0, 20)))
        b[k] = r.integers(-60, 61, len(k))
        b[0] = r.integers(-200, 200)
    found = jpeg.decode(sparse_jpeg(blocks, 4, 3, low))
    assert (found.components[0].coefficients == blocks).all()
    assert jpeg.rgb(found).shape == (24, 32, 3)


def test_inverse_transform():
    c = jpeg.Component(1, 1, 1, 0, 1, 1, 1, 1, np.zeros((1, 64), np.int16))
    r = np.random.default_rng(4)
    c.coefficients[0, :10] = r.integers(-90, 90, 10)
    block = np.zeros(64)
    block[jpeg.ZIGZAG] = c.coefficients[0]
    basis = np.array([[(0.5**0.5 if u == 0 else 1) / 2 * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])
    want = np.clip(basis @ block.reshape(8, 8) @ basis.T + 128, 0, 255)
    assert np.abs(jpeg.samples(c, np.ones(64, np.int64)) - want).max() <= 1


def test_media_query(spark, tmp_path):
    stored = media.store(media.to_media(frame(spark)), str(tmp_path / "media"))
    got = media.digests(stored).collect()
    want = sorted(((i, len(t), hashlib.sha256(p := media.padded(t)).hexdigest(), len(p), zlib.crc32(p[-32:])) for i, t in texts()), key=repr)
    assert sorted(((r["doc_id"], r["n_bytes"], r["payload_sha256"], r["payload_bytes"], r["tail_crc32"]) for r in got), key=repr) == want
    assert len({(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in got}) == len({r["payload_sha256"] for r in got})
    shapes = media.store(media.tensors(stored), str(tmp_path / "tensors")).collect()
    assert all(len(r["rgb"]) == r["height"] * r["width"] * 3 for r in shapes) and len(shapes) == len(got)
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"no")), (3, bytearray(b"\xff\xd8\xff"))], "doc_id long, media binary")
    assert [r["rgb"] for r in media.tensors(bad).collect()] == [None] * 3
    empty = media.to_media(spark.createDataFrame([], SCHEMA))
    assert media.digests(media.store(empty, str(tmp_path / "none"))).count() == 0


def test_rules_equal_their_sql(spark, duck, sf_dir):
    for rows in (None, []):
        df = frame(spark, rows) if rows is None else spark.createDataFrame([], SCHEMA)
        import duckdb

        con = duckdb.connect()
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
        if rows is None:
            con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [r[:4] for r in corpus()])
        out = quality_rules.judged(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken")
        assert oracle.differs(out, con, quality_rules.sql()) is None
    assert oracle.differs(quality_rules.op2_quality_rules(spark, sf_dir), duck, quality_rules.sql()) is None


def test_sketches_merge(spark):
    df = frame(spark)
    whole = quality_rules.sketches(quality_rules.measured(df))
    parts = [quality_rules.sketches(quality_rules.measured(df.where(f"coalesce(version, 0) % 2 = {k}"))) for k in (0, 1)]
    assert collected(quality_rules.merged(*parts), "lang", "source", "rule", "bucket", "n") == collected(whole, "lang", "source", "rule", "bucket", "n")


def test_fences_follow_their_group(spark):
    """Groups of one corpus have fences of their own, and a shift of one group's words moves its fence alone."""
    import random

    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(450)]

    def rows(longer):
        out = []
        for k in range(480):
            source, size = f"s{k % 3}", r.randint(60, 200)
            extra = longer if source == "s1" else 0
            words, ends = vocabulary[: 150 * (1 + k % 3)], ("",) * (2 + k % 3) + (",", ".")
            out.append((k, " ".join(r.choice(words) + "x" * extra + r.choice(ends) for _ in range(size)), "en", source, 0, "r", 0, 0.5, "s", 0, "x"))
        out.append((1000, " ".join("#$" * r.randint(1, 4) for _ in range(120)), "en", "s0", 0, "r", 0, 0.5, "s", 0, "x"))
        out.append((1001, " ".join(r.choice(("aa", "bb", "cc", "dd", "ee")) for _ in range(150)), "en", "s2", 0, "r", 0, 0.5, "s", 0, "x"))
        return out

    found = []
    for longer in (0, 6):
        r.seed(7)
        df = spark.createDataFrame(rows(longer), SCHEMA)
        limits = {x["source"]: x.asDict() for x in quality_rules.fences(quality_rules.sketches(quality_rules.measured(df))).collect()}
        broken = {x["doc_id"]: x["broken"] for x in quality_rules.judged(df).collect() if x["broken"]}
        assert broken.keys() == {1000, 1001} and "marks" in broken[1000] and "sameness" in broken[1001]
        for i in range(len(quality_rules.RULES)):
            assert len({x[f"high_{i}"] for x in limits.values()}) > 1
        found.append(limits)
    name = "high_1"  # length
    assert found[1]["s1"][name] > found[0]["s1"][name] + 3000
    # the others move with the language's quartiles only
    moved = {s: found[1][s][name] - found[0][s][name] for s in found[0]}
    assert 3 * max(moved["s0"], moved["s2"]) < moved["s1"]


def test_repeated_words():
    for words in ([], list("abcdefgh"), list("abcdefghabcdefgh"), ["a"] * 20, list("abcdefghi" + "x" + "abcdefghi")):
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        marked = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 8)}
        assert quality_rules.repeated_words([w.encode() for w in words]) == len(marked)


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = classifier.op10_classifier(spark, sf).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 50 and sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held) > 0.95


def test_classifier_cases(spark):
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(60)] + [(None, 1, 0), (3, None, 0), (3, 1, 0), (4, 2, 0)], "doc_id long, quality int, toxic int")
    df = frame(spark)
    model = classifier.train(df, labels)
    out = classifier.score(df, model).collect()
    assert len(out) == len(corpus()) and all(0 <= r["score"] <= 1 for r in out)
    assert not any(r["held_out"] for r in out if r["doc_id"] is None)
    blank = classifier.train(df, labels.limit(0))
    assert {r["score"] for r in classifier.score(df, blank).collect()} == {0.5}
    assert classifier.accepted(df, model).columns == df.columns
    assert classifier.score(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_additive_model_learns_an_interaction():
    r = np.random.default_rng(3)
    x = np.zeros((4000, len(classifier.FEATURES)))
    x[:, :3] = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = classifier.fit(x[:3000], y[:3000])
    assert ((model.scores(x[3000:]) > 0.5) == y[3000:]).mean() > 0.93 and (1, 0) in model.pairs
