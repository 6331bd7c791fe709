"""Terms against regular expressions; divergences and ranked search against plain loops and the registered SQL."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import block_max, byte_terms, divergence

from .. import oracle
from .fixtures import SCHEMA, collected, corpus, frame

QUERIES = "item_id long, text string, lang string, doc_id long, term int, block string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def letters(text):
    return re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text))


def letters_and_digits(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower(text))


def cut(texts, members):
    buffer, doc, begin, end = byte_terms.slices([t.encode() for t in texts], members)
    terms, group = byte_terms.grouped(buffer, begin, end)
    return [(d, terms[g].decode()) for d, g in zip(doc.tolist(), group.tolist(), strict=True)]


def test_terms_are_those_of_the_pattern():
    r = random.Random(1)
    texts = ["".join(r.choice("abYZ @[`{/09:;\n\t\x00\x7féß日😀 ") for _ in range(r.randint(0, 60))) for _ in range(300)] + ["", "", "A", "\x80\xff"]
    for pattern, members in ((letters, byte_terms.LETTERS), (letters_and_digits, byte_terms.LETTERS_AND_DIGITS)):
        assert cut(texts, members) == [(i, t) for i, text in enumerate(texts) for t in pattern(text)]
    assert cut([], byte_terms.LETTERS) == cut([""], byte_terms.LETTERS) == []


def test_colliding_hashes_never_join_terms():
    weak = lambda terms, seed: np.array([(len(t) + t[-1]) * seed % 3 if seed < 4 else hash(t) % 2**63 for t in terms], np.uint64)
    r = random.Random(2)
    text = " ".join("".join(r.choice("ab") for _ in range(r.randint(1, 4))) for _ in range(400))
    buffer, _, begin, end = byte_terms.slices([text.encode()], byte_terms.LETTERS)
    terms, group = byte_terms.grouped(buffer, begin, end, 0, weak)
    assert len(set(terms)) == len(terms)
    assert [terms[g].decode() for g in group.tolist()] == text.split()


def audited(rows, documents=3, ranks=200):
    groups, df, out = defaultdict(Counter), defaultdict(Counter), []
    for r in rows:
        found = letters(r[1])
        groups[r[2] or "", r[3] or ""].update(found)
        df[r[2] or ""].update(set(found))
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in df[lang].items() if n >= documents)
        own = {s: {t: c[t] for t in kept} for (g, s), c in groups.items() if g == lang}
        p = lambda n, total: 1 + 1_000_000_000 * (n + 1) // (total + len(kept))  # noqa: B023, E731
        prob = {s: {t: p(n, sum(c.values())) for t, n in c.items()} for s, c in own.items()}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        all_of = {t: p(n, sum(whole.values())) for t, n in whole.items()}
        f = lambda x, y: (x - y) ** 2 // y
        for s in own:
            pairs = [(-sum(f(prob[s][t], prob[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(-f(prob[s][t], all_of[t]), t) for t in kept if own[s][t] and prob[s][t] > all_of[t]]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:ranks])):
                out += [(lang, s, part, item, -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "tile"), [(200_000, 256), (40, 1)])
def test_divergence(spark, block, tile):
    rows = corpus()
    rows += [(900 + i, None if i % 2 else " ,.- 12", "xx", s, 1, "r", 1, 0.5, "s", 1, "x") for i, s in enumerate(("p", "q", "r"))]  # no terms at all
    rows += [(950, "alone " * 4, "yy", "only", 1, "r", 1, 0.5, "s", 1, "x")] * 3
    rows += [(960, None, "en", "silent", 1, "r", 1, 0.5, "s", 1, "x")]
    assert collected(divergence.audit(frame(spark, rows), block=block, tile=tile)) == audited(rows)


def test_few_ranks_and_empty_table(spark):
    assert collected(divergence.audit(frame(spark), 2, 3)) == audited(corpus(), 2, 3)
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_probabilities_are_exact():
    r = random.Random(3)
    n = [r.randrange(10 ** r.randint(1, 13)) for _ in range(500)]
    total = [x + r.randrange(1, 10 ** r.randint(1, 13)) for x in n]
    assert divergence.probabilities(np.array(n), np.array(total)).tolist() == [1 + 10**9 * a // b for a, b in zip(n, total, strict=True)]


def test_shares_of_spark_are_exact(spark):
    rows = [(7, 9), (123_456_789_012, 999_999_999_999), (10**13, 10**13 + 1), (1, 3)]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", byte_terms.share(F.col("a"), F.col("b"))).collect()
    assert {(r[0], r[1]): r[2] for r in got} == {(a, b): 10**9 * a // b for a, b in rows}


def ranked(rows, queries, k=10):
    docs = [(r[0], Counter(letters_and_digits(r[1]))) for r in rows]
    lengths = [sum(c.values()) for _, c in docs]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = Counter(t for _, c in docs for t in c)
    wanted = defaultdict(set)
    for item, text in queries:
        wanted[item].update(letters_and_digits(text))
    out = []
    for item, terms in wanted.items():
        found = []
        for (i, c), size in zip(docs, lengths, strict=True):
            if size:
                m = 10 + 90 * size * n // total
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
                found += [(-score, -math.inf if i is None else i, i)] if score else []
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(found, key=lambda x: x[:2])[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def asked():
    rows, r = corpus(), random.Random(6)
    words = [w for x in rows if x[1] for w in x[1].split()]
    found = [(i, " ".join(r.sample(words, r.randint(1, 12)))) for i in range(90)]
    found += [(200, rows[0][1]), (201, None), (202, ""), (203, "never seen anywhere"), (204, "one ONE two 12"), (205, "a a a a"), (None, "no identifier"), (None, "words"), (7, "second row of the seventh"), (7, rows[1][1]), (-1, "É 日本 x")]
    return found


@pytest.mark.parametrize(("documents", "first", "growth", "small"), [(512, 4, 16, 200_000), (3, 1, 2, 200_000), (5, 2, 3, 0)])
def test_search(spark, monkeypatch, asked, documents, first, growth, small):
    monkeypatch.setattr(block_max, "SMALL", small)
    queries = spark.createDataFrame([(i, t, "l", 1, 2, "b") for i, t in asked], QUERIES).repartition(3)
    got = block_max.search(frame(spark), queries, documents=documents, first=first, growth=growth)
    assert collected(got) == ranked(corpus(), asked)


def test_search_of_nothing(spark, asked):
    queries, none = spark.createDataFrame([(1, "a", "l", 1, 2, "b")], QUERIES), spark.createDataFrame([], QUERIES)
    assert block_max.search(spark.createDataFrame([], SCHEMA), queries).count() == 0
    assert block_max.search(frame(spark), none).count() == 0
    assert block_max.search(frame(spark), queries, 1).count() == 1


def test_blocks_below_the_threshold_are_not_scored(spark, monkeypatch):
    """One block holds all of a query's terms; the others a single common one, so none of theirs can be among the best."""
    rows = [(i, "common " * 3 + f"w{i}" if i >= 20 else "common rare thing here", "en", "s", 1, "r", 1, 0.5, "s", 1, "x") for i in range(400)]
    looked, plain = [], block_max.scored
    monkeypatch.setattr(block_max, "scored", lambda index, chosen, *rest: looked.append(chosen.count()) or plain(index, chosen, *rest))
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    found = block_max.search(docs, spark.createDataFrame([(1, "common rare thing", "l", 1, 2, "b")], QUERIES), documents=20, first=1)
    assert collected(found) == ranked(rows, [(1, "common rare thing")])
    assert looked == [1]


@pytest.mark.parametrize("module", [divergence, block_max])
def test_sql(spark, module, sf_dir):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    query = divergence.op12_divergence if module is divergence else block_max.op13_block_max
    assert oracle.differs(query(spark, sf_dir), con, module.sql()) is None
