"""Near copies against the Jaccard similarity of all pairs."""

import random

from corpusloom.llm import near_copies, simhash

from .fixtures import SCHEMA, corpus, frame


def grams(text, words=5):
    w = (text or "").lower().encode().split()
    return frozenset(b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)) or frozenset([b" ".join(w)])


def edited(seed=3, groups=12):
    """Texts with several words changed: rows (id, text)."""
    r = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randint(120, 400))]
        rows.append((1000 + 10 * g, " ".join(base)))
        for k in range(1, 6):
            copy = list(base)
            for at in r.sample(range(len(base)), max(1, len(base) * k // 150)):
                copy[at] = f"x{r.randrange(3000)}"
            rows.append((1000 + 10 * g + k, " ".join(copy)))
    return rows


def expected(rows):
    """doc_id (0 for none) of the row that stays of each component."""
    sets = sorted({grams(t) for _, t in rows}, key=sorted)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) / len(a | b) >= 0.8:
                parent[root(i)] = root(j)
    place, found = {s: root(i) for i, s in enumerate(sets)}, {}
    for i, t in rows:
        found.setdefault(place[grams(t)], []).append(i)
    return sorted(min((i for i in v if i is not None), default=0) for v in found.values())


def all_rows():
    return corpus() + [(i, t, "en", "s1", len(t), "r", 0, 0.5, "s", 0, "x") for i, t in edited()]


def test_all_pairs_at_the_similarity_are_found_and_no_others(spark):
    rows = all_rows()
    out = near_copies.one_of_each(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == expected([r[:2] for r in rows])


def test_the_stage_drops_copies_beyond_the_bits_of_a_fingerprint(spark):
    import corpus_pipeline

    texts = edited()
    pairs = [(texts[g][1], texts[g + k][1]) for g in range(0, len(texts), 6) for k in range(1, 6)]
    far = [(a, b) for a, b in pairs if len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.8 and (simhash.fingerprint(a.encode(), 5) ^ simhash.fingerprint(b.encode(), 5)).bit_count() > 3]
    assert len(far) >= 5
    for k, (a, b) in enumerate(far[:2]):
        rows = [(i, t, "en", "s1", len(t), "r", 0, 0.5, "s", 0, "x") for i, t in enumerate((a, b, "quite another text of some more words " * (k + 1)))]
        assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()) == [0, 2]


def joined(names, links):
    """The sets of names that links connect."""
    parent = {x: x for x in names}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    return {frozenset(y for y in parent if root(y) == root(x)) for x in parent}


def test_groups_are_compared_across_and_in_any_blocks(spark):
    """Of texts with one key, some in groups already: what groups and links connect is what all pairs connect."""
    rows = edited(groups=4)
    texts = spark.createDataFrame(rows, "content long, text string")
    close = [(a, b) for a, s in rows for b, t in rows if a < b and len(grams(s) & grams(t)) / len(grams(s) | grams(t)) >= 0.8]
    want = joined([i for i, _ in rows], close)
    for known in ([], [(a, b) for a, b in close if b < 1013]):
        groups = {x: min(g) for g in joined([i for i, _ in rows], known) for x in g}
        keyed = spark.createDataFrame([(key, i, groups[i]) for key in (5, 6) for i, _ in rows], "key long, content long, group long")
        for block in (1000, 7, 2):
            links = [(r["a"], r["b"]) for r in near_copies.across(keyed, texts, block=block).collect()]
            assert joined(groups, [*groups.items(), *links]) == want


def test_a_large_group_is_not_paired_with_itself(spark):
    """Its texts go to as many blocks as there are of other groups, and not to each other's."""
    rows = spark.createDataFrame([(1, i, 0 if i < 1000 else i) for i in [*range(1000), 2000, 2001]], "key long, content long, group long")
    found = near_copies.dealt(rows, 50).groupBy("group").count().collect()
    assert {r["group"]: r["count"] for r in found} == {0: 1000, 2000: 20 + 1, 2001: 20 + 1}


def test_pairs_beside_heads(spark):
    rows = edited(groups=3)
    of = dict(rows)
    pairs = [(b, a) for a, _ in rows for b, _ in rows if a < b and a % 10 == 0]
    df, texts = spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(rows, "content long, text string")
    want = sorted((a, b) for a, b in pairs if len(grams(of[a]) & grams(of[b])) / len(grams(of[a]) | grams(of[b])) >= 0.8)
    for block in (512, 2):
        assert sorted(map(tuple, near_copies.beside_heads(df, texts, block=block).collect())) == want


def test_bands_meet_at_the_similarity():
    r = random.Random(1)
    hits = 0
    for _ in range(300):
        draw = lambda n: [r.randrange(1 << 63) for _ in range(n)]
        both = draw(80)
        a, b = (near_copies.np.array(both + draw(10), near_copies.np.uint64) for _ in range(2))
        hits += bool(set(near_copies.bands(a)) & set(near_copies.bands(b)))
    assert hits >= 297
