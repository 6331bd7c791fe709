"""Removal of repeated words and bytes against counting every window; the suffix array against sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.llm import common, debruijn, repeats, suffix_array

from .fixtures import SCHEMA, collected, corpus, frame, texts


def covered(sequences, span):
    counts = Counter(s[i : i + span] for s in sequences for i in range(len(s) - span + 1))
    for s in sequences:
        mask = bytearray(len(s))
        for i in range(len(s) - span + 1):
            if counts[s[i : i + span]] > 1:
                mask[i : i + span] = b"\1" * span
        yield mask


def by_bytes(rows, span):
    data = [t for _, t in rows]
    for (i, t), m in zip(rows, covered(data, span), strict=True):
        kept = bytes(c for c, g in zip(t, m, strict=True) if not g)
        yield i, len(t), sum(m), sum(m[k] and (k == 0 or not m[k - 1]) for k in range(len(m))), hashlib.sha256(kept).hexdigest()


def by_words(rows, span):
    data = [tuple(t.split()) for _, t in rows]
    for (i, _), w, m in zip(rows, data, covered(data, span), strict=True):
        yield i, len(w), sum(m), hashlib.sha256(b" ".join(c for c, g in zip(w, m, strict=True) if not g)).hexdigest()


@pytest.mark.parametrize("largest", [512, 2])
def test_bytes(spark, monkeypatch, largest):
    monkeypatch.setattr(suffix_array, "LARGEST", largest)
    assert collected(suffix_array.digests(frame(spark))) == sorted(by_bytes(texts(), 200), key=repr)


def test_part_of_a_hash_is_no_proof(spark):
    """Contents that agree in the bits that are drawn, and not in all, are looked at."""
    near = lambda low: (77 << 20) | low
    rows = [(1, near(1), True, 77), (1, near(2), True, 77), (1, 5, True, 77), (2, near(1), True, 77), (2, near(1), True, 77), (2, 9, True, 77), (3, near(1), False, None)]
    found = repeats.surely_told(spark.createDataFrame(rows, "anchor long, content long, branching boolean, twice long"))
    assert collected(found.where("told"), "anchor", "content") == [(2, near(1))] * 2
    assert found.count() == len(rows)


def test_short_strings_and_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PART", 500)
    assert collected(suffix_array.digests(frame(spark), 40, 12)) == sorted(by_bytes(texts(), 40), key=repr)


def test_words(spark):
    assert collected(debruijn.digests(frame(spark))) == sorted(by_words(texts(), 35), key=repr)
    assert collected(debruijn.digests(frame(spark), 9, 4)) == sorted(by_words(texts(), 9), key=repr)


def paths_of(texts, k):
    """Nonbranching paths of the repeated k-mers of word lists, as (words, least copies)."""
    edges = {e: c for e, c in Counter(tuple(t[i : i + k]) for t in texts for i in range(len(t) - k + 1)).items() if c > 1}
    ins, outs = Counter(e[1:] for e in edges), Counter(e[:-1] for e in edges)
    before = {}
    for e in edges:
        for f in edges:
            if e[1:] == f[:-1] and e != f and ins[e[1:]] == outs[e[1:]] == 1:
                before[f] = e
    least = {}
    for e in edges:
        at, steps = e, 0
        while at in before and steps <= len(edges):
            at, steps = before[at], steps + 1
        least.setdefault(e if steps > len(edges) else at, []).append(edges[e])
    return sorted((len(c) + k - 1, min(c)) for c in least.values())


@pytest.mark.parametrize(("case", "hot"), [("passages", 4096), ("branching", 4096), ("branching", 2), ("cycle", 4096), ("hot", 4096), ("hot", 20)])
def test_paths(spark, monkeypatch, case, hot):
    monkeypatch.setattr(debruijn.repeated_edges, "__defaults__", (hot,))
    r = random.Random(4)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    p, q = words(60), words(40)
    if case == "passages":
        texts = [words(20) + p + words(20), p[:50] + words(9), words(7) + p[5:], words(80), q + p, q + words(3)]
    elif case == "branching":
        texts = [p[:30] + q[:20], p[:30] + q[:20], p[:30] + q[20:], p[:30] + q[20:], words(5) + p[10:40], p + q]
    elif case == "cycle":
        texts = [words(4) + p[:5] * 12, p[1:5] + p[:5] * 3, ["x"] * 50, ["y", "z"] * 30]
    else:
        texts = [words(r.randrange(9)) + p + words(r.randrange(9)) for _ in range(300)] + [words(30) + p[:40] + q for _ in range(40)]
    rows = [(i, " ".join(t), "en", "s", 0, "r", i, 0.5, "s", 0, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = debruijn.passages(df, 9, 4).collect()
    want = paths_of(texts, 9)
    if case == "cycle":  # how many stretches a closed cycle comes in is open
        assert sum(x["words"] - 8 for x in found) == sum(w - 8 for w, _ in want)
    else:
        assert sorted((x["words"], x["copies"]) for x in found) == want
    for x in found:  # their first k-mers stand where they say
        start = tuple(texts[x["doc_id"]][x["first"] : x["first"] + 9])
        assert sum(tuple(t[i : i + 9]) == start for t in texts for i in range(len(t) - 8)) > 1
    assert collected(debruijn.digests(df, 9, 4)) == sorted(by_words([(i, t.encode()) for i, t, *_ in rows], 9), key=repr)


def test_words_are_held_against_their_source():
    words = [b"a", b"b", b"c", b"d"]
    hit = {"first": 1, "words": 3, "check": debruijn.check_of(words[1:]), "windows": [0 << 12 | 1, 1 << 12 | 2]}
    hits = pa.array([hit])
    assert debruijn.removed(words, hits, 2).tolist() == [False, True, True, True]
    with pytest.raises(ValueError):
        debruijn.removed([b"a", b"b", b"x", b"d"], hits, 2)


@pytest.mark.parametrize("doc_id", [3, None])
def test_thousands_of_equal_rows(spark, doc_id):
    r = random.Random(9)
    text = " ".join(f"w{r.randrange(10**6)}" for _ in range(600))
    rows = [(doc_id, text, "en", "s", 0, "r", 0, 0.5, "s", 0, "x")] * 2000 + [(1, text[: len(text) // 2], "en", "s", 0, "r", 0, 0.5, "s", 0, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    with common.Scratch(spark) as scratch:
        graph = debruijn.Graph(repeats.keyed(df), repeats.Words(debruijn.GRAM, debruijn.WINDOW), scratch)
        runs = graph.contents.count()
        assert graph.runs.count() == runs
        assert graph.contents.agg({"copies": "max"}).first()[0] >= 2000
        assert max(len(x["hits"]) for x in graph.hits().collect()) <= runs
    got = debruijn.digests(df).groupBy("doc_id", "n_words", "n_removed").count().collect()
    half = len((text[: len(text) // 2]).split())
    cut = 0 if text[len(text) // 2 - 1] == " " or text[len(text) // 2] == " " else 1
    assert sorted(map(tuple, got), key=repr) == sorted([(doc_id, 600, 600, 2000), (1, half, half - cut, 1)], key=repr)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_array.digests(empty).count() == 0 == debruijn.digests(empty).count()


def test_documents_without_repeats(spark):
    df = frame(spark)
    out = suffix_array.without_repeats(df)
    assert out.columns == df.columns
    got = {(r["version"], r["text"], r["n_chars"]) for r in out.collect()}
    kept = [bytes(c for c, g in zip(t, m, strict=True) if not g) for (_, t), m in zip(texts(), covered([t for _, t in texts()], 200), strict=True)]
    want = {(r[6], None if r[1] is None else k.decode(errors="ignore"), None if r[1] is None else len(k.decode(errors="ignore"))) for r, k in zip(corpus(), kept, strict=True)}
    assert got == want


def test_suffix_array():
    r = random.Random(2)
    for _ in range(800):
        text = [r.randint(1, r.choice((1, 2, 5))) for _ in range(r.randint(0, 40))] + [0]
        order, rank = suffix_array.suffix_array(text)
        assert order == sorted(range(len(text)), key=lambda i, t=text: t[i:])
        assert [order[k] for k in rank] == list(range(len(text)))
        prefix = suffix_array.common_prefixes(text, order, rank)
        for k in range(1, len(text)):
            a, b = text[order[k - 1] :], text[order[k] :]
            assert prefix[k] == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))


def test_anchors_depend_on_windows_alone():
    from corpusloom.llm import anchors

    r = np.random.default_rng(1)
    shared = r.integers(0, 4, 300, dtype=np.uint8)
    codes = repeats.Bytes.codes_of
    found = []
    for _ in range(2):
        text = np.concatenate([r.integers(0, 4, int(r.integers(50, 400)), dtype=np.uint8), shared, r.integers(0, 4, 100, dtype=np.uint8)])
        begin, n, rel, anchor, _ = anchors.runs(codes[text], np.array([len(text)]), 20, 60)
        assert n.sum() == len(text) - 59 and (n <= 41).all() and (rel >= n - 1).all()
        at = len(text) - 400
        spots = {int(b + i - at): (int(a), int(p - i)) for b, k, p, a in zip(begin, n, rel, anchor, strict=True) for i in range(k)}
        found.append([spots[i] for i in range(240)])
    assert found[0] == found[1]
