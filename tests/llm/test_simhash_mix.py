"""Fingerprints and components against all pairs; the mix by its balance; the pipeline's stages."""

import random
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from corpusloom.llm import balanced, common, near_copies, simhash, suffix_array

from .fixtures import SCHEMA, collected, corpus, frame, texts
from .test_repeats import covered


def plain(text):
    w = text.lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components(prints):
    """Component of each fingerprint: a representative, by all pairs."""
    distinct = sorted(set(prints))
    parent = {x: x for x in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    return {x: root(x) for x in distinct}


def test_query(spark):
    rows = [(i, plain(t)) for i, t in texts()]
    of = components([p for _, p in rows])
    least = {}
    for i, p in rows:
        if i is not None:
            least[of[p]] = min(i, least.get(of[p], i))
    want = sorted(((i, f"{p:016x}", least.get(of[p])) for i, p in rows), key=repr)
    assert collected(simhash.near_duplicates(frame(spark))) == want
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("bucket", [4096, 8])
def test_links_connect_what_all_pairs_connect(spark, bucket):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(40)]
    values = set(base)
    for b in base[:12]:
        for _ in range(60):
            b ^= sum(1 << k for k in r.sample(range(64), r.randint(1, 3)))
            values.add(b)
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    found = simhash.links(df, bucket)
    unsigned = lambda x: x & (1 << 64) - 1
    pairs = [(unsigned(r["a"]), unsigned(r["b"])) for r in found.collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    of = components(values)
    stars = {unsigned(r["node"]): unsigned(r["root"]) for r in simhash.components(found).collect()}
    groups, want = {}, {}
    for v in values:
        groups.setdefault(stars.get(v, v), set()).add(v)
        want.setdefault(of[v], set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_every_close_pair_has_a_key():
    r = random.Random(2)
    spec = simhash.keys()
    assert len(spec) == 24 and all(m.bit_count() == 32 for _, m in spec)
    for _ in range(3000):
        z = sum(1 << k for k in r.sample(range(64), r.randint(0, 3)))
        assert any(not z & m and len(simhash.viable(np.array([z], np.uint64), first)) for first, m in spec)
        far = sum(1 << k for k in r.sample(range(64), 4))
        assert not any(len(simhash.viable(np.array([far], np.uint64), first)) for first, _ in spec)


def test_one_of_each(spark):
    rows = corpus()
    prints = [plain((r[1] or "").encode()) for r in rows]
    of = components(prints)
    out = simhash.one_of_each(frame(spark))
    got = out.collect()
    assert out.columns == frame(spark).columns and len(got) == len(set(of.values()))
    ids = {}
    for r, p in zip(rows, prints, strict=True):
        ids.setdefault(of[p], []).append(r[0])
    want = sorted(min((i for i in v if i is not None), default=None) or 0 for v in ids.values())
    assert sorted(r["doc_id"] or 0 for r in got) == want


def targets(sizes, weights=(5, 2, 1)):
    """Shares with the excess of full sources shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    left, full, total = set(order), {}, sum(sizes.values())
    while left:
        rest = total - sum(full.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 3 * sizes[s]}
        if not over:
            return full | share
        full |= {s: 3.0 * sizes[s] for s in over}
        left -= over
    return full


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{k}": r.choice([0, 1, 10, 1000, 50]) for k in range(r.randint(1, 9))} | {None: 7, "Z": 3, "é": 40}
    got = {x["source"]: x["target"] for x in balanced.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    assert got == pytest.approx(targets(sizes))


def test_mix(spark):
    df = frame(spark)
    out = balanced.mix(df, block=8).collect()
    again = balanced.mix(frame(spark), block=8).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again)) and len(out) == len(corpus())
    by = {}
    for r in out:
        assert 0 <= r["copies"] <= 3 and r["size"] == len(((next(t for i, t in texts() if i == r["doc_id"]) if r["doc_id"] in range(60) and r["doc_id"] != 7 else b"x " * r["size"])).split())
        by.setdefault(r["source"], []).append(r)
    want = targets({s: sum(r["size"] for r in rows) for s, rows in by.items()})
    for s, rows in by.items():
        assert rows[0]["target"] == pytest.approx(want[s])
        assert sum(r["size"] * r["copies"] for r in rows) == pytest.approx(want[s], rel=0.1, abs=40)
    assert balanced.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    taken = balanced.take(df)
    assert taken.columns == df.columns and taken.count() == sum(r["copies"] for r in balanced.mix(df).collect())


def test_flight_keeps_the_balance():
    r = random.Random(4)
    rows = [[k, r.randint(0, 500), r.random()] for k in range(300)]
    size, number = sum(x[1] * x[2] for x in rows), sum(x[2] for x in rows)
    decided, left = balanced.flight(rows, 1)
    assert len(left) <= 2 and all(x[2] in (0.0, 1.0) for x in decided)
    assert sum(x[1] * x[2] for x in decided + left) == pytest.approx(size) and sum(x[2] for x in decided + left) == pytest.approx(number)


def test_inclusion_follows_the_probabilities():
    hits = np.zeros(30)
    for salt in range(400):
        rows = [[k, 10 + k % 5, 0.3] for k in range(30)]
        decided, left = balanced.flight(rows, salt)
        for x in decided + balanced.land(left):
            hits[x[0]] += x[2]
    assert np.abs(hits / 400 - 0.3).mean() < 0.06


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).drop("row", "version", "anchor", "stretches", "n", "score").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(r[0], 1, 0) for r in rows if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["text"] or "").encode() for r in kept.collect()]
        stage(spark, kept, str(tmp_path)).write.parquet(str(tmp_path / f"s{k}"))
        after = spark.read.parquet(str(tmp_path / f"s{k}"))
        if k < 4:
            assert after.columns == docs.columns
        if k == 0:
            assert after.count() == kept.count()  # all labels are good
        if k == 1:
            prints = [plain((r["text"] or "").encode()) for r in kept.collect()]
            assert after.count() == len(set(components(prints).values()))
        if k == 2:
            want = [bytes(c for c, g in zip(t, m, strict=True) if not g).decode(errors="ignore") for t, m in zip(before, covered(before, 200), strict=True)]
            assert sorted(r["text"] or "" for r in after.collect()) == sorted(want)
        if k == 3:
            assert after.exceptAll(kept.select("*").withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).drop("n")).count() == 0
        if k == 4:
            library = SentencePieceProcessor(model_file=common.tokenizer_path("piece_bpe_32k.model"))
            ids = [[*library.encode(t.decode()), library.eos_id()] for t in before]
            assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in after.collect()) == sorted((len(i), sha256(" ".join(map(str, i)).encode()).hexdigest(), sha256(library.decode(i).encode()).hexdigest()) for i in ids)
        kept = after
    assert sorted(map(repr, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(repr, kept.collect()))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_names_and_rows_that_differ_in_other_columns(spark):
    """Helper columns never meet those of the documents, and the row that stays is the same however rows are dealt."""
    schema = "doc_id long, text string, source string, id long, Version string, rows int, whole string, own int, copies int, copy int, origin string, row int, stretches string"
    long = "some words that repeat here and there " * 12
    rows = [(1, long, s, 9, "v", 1, "w", 2, 3, 4, "o", 5, s) for s in ("b", "a", None, "c")] + [(2, "quite another text", "b", 1, "v", 1, "w", 2, 3, 4, "o", 5, "x"), (None, None, None, None, None, None, None, None, None, None, None, None, None)]
    found = set()
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, schema).repartition(3)
        kept = near_copies.one_of_each(docs)
        assert kept.columns == docs.columns and kept.count() == 3
        found.add(tuple(sorted(map(repr, kept.collect()))))
        assert {repr(r) for r in kept.collect()} <= {repr(r) for r in docs.collect()}
        assert simhash.one_of_each(docs).count() == 3
        cut = suffix_array.without_repeats(docs)
        assert cut.columns == docs.columns and sorted(str(r["text"]) for r in cut.collect())[:2] == ["", ""]
        taken = balanced.take(docs)
        assert taken.columns == docs.columns and {repr(r) for r in taken.collect()} <= {repr(r) for r in docs.collect()}
    assert len(found) == 1
