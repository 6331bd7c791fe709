"""How far the sources of a language stand from each other, and from the language, in their terms.

1. Tasks cut texts into terms (see ``byte_terms``) and count them by language, source and term; the counts
   are summed by Spark.  Of a language the terms stay that enough of its documents hold.
2. Kept terms are dealt to blocks of bounded size.  A block is a sparse matrix, a row a source (compressed rows:
   entries by source, with an array of where each source begins); sums over a source's entries are ``reduceat``.
   Terms that neither source of a pair has in a block aren't entries: they all differ by the same and are only counted.
3. Sources are dealt to tiles and a task looks at a block and a pair of tiles, so that neither a language with a
   large vocabulary nor one of many sources is one task's.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import byte_terms, common

#: Documents of a language that must hold a term.
DOCUMENTS = 3
#: Ranks of the terms of a source.
TERMS = 200
#: Probabilities are in parts of this.
ONE = 1_000_000_000
#: Entries of a block and sources of a tile, on average.
BLOCK = 200_000
TILE = 256
#: Rows up to which a table of groups or languages is broadcast; above, it is joined by shuffle.
SMALL = 100_000
COUNTED = "lang string, source string, term string, n long, df long"


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df) by task: of each term its occurrences and documents; a null term for the group itself."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])

    def run(batches):
        seen: dict[tuple, int] = {}
        for batch in common.byte_batches(batches, byte_terms.BATCH_BYTES):
            names = list(zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True))
            new = dict.fromkeys(n for n in names if n not in seen)
            yield common.record(schema, [n[0] for n in new], [n[1] for n in new], [None] * len(new), [0] * len(new), [0] * len(new))
            for n in new:
                seen[n] = len(seen)
            groups = {n: i for i, n in enumerate(dict.fromkeys(names))}
            buffer, doc, begin, end = byte_terms.slices(common.as_bytes(batch.column(2)), byte_terms.LETTERS)
            terms, term = byte_terms.grouped(buffer, begin, end)
            if not terms:
                continue
            group = np.array([groups[n] for n in names])
            # one sort by group, term and document gives both counts
            pairs, n = byte_terms.counted((group[doc] * len(terms) + term) * len(names) + doc)
            cells, df = byte_terms.counted(pairs // len(names))
            first = np.cumsum(df) - df
            of, word = np.divmod(cells, len(terms))
            lang, source = (pa.array([g[i] for g in groups], pa.string()).take(pa.array(of)) for i in (0, 1))
            yield common.record(schema, lang, source, byte_terms.strings(terms).take(pa.array(word)), pa.array(np.add.reduceat(n, first)), pa.array(df))

    docs = common.bounded(docs)
    cells = docs.select(*(F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return cells.mapInArrow(run, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def probabilities(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(ONE * n / total), by two steps that stay within 64 bits."""
    high = n * 100_000
    return 1 + high // total * 10_000 + high % total * 10_000 // total


def sums(source: np.ndarray, term: np.ndarray, p: np.ndarray, rest: np.ndarray, of: np.ndarray, to: np.ndarray):
    """For each source of ``to`` and all of ``of``: the sum of distances over the terms that one of the two has, and the number of these.

    Entries (source, term, p) are sorted by source, terms are numbered from 0; ``rest`` is each source's p of a term it lacks."""
    size = int(term.max()) + 1 if len(term) else 0
    begins = np.searchsorted(source, np.arange(len(rest) + 1))
    held = np.diff(begins)
    some = np.flatnonzero(held)  # reduceat has no empty stretches
    for h in to.tolist():
        own = slice(begins[h], begins[h + 1])
        there, q = np.zeros(size, bool), np.full(size, rest[h])
        there[term[own]], q[term[own]] = True, p[own]
        total, common_terms = np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int64)
        if len(term):
            both = there[term]
            # terms of g, and those of h that g lacks: all of h's less the common ones
            rows = distance(p, q[term]) - np.where(both, distance(rest[source], q[term]), 0)
            total[some] = np.add.reduceat(rows, begins[some])
            common_terms[some] = np.add.reduceat(both.astype(np.int64), begins[some])
        total = total[of]
        if held[h]:
            total = total + distance(rest[of][:, None], p[own][None, :]).sum(1)
        yield h, total, held[of] + held[h] - common_terms[of]


def _pairs(i: int, j: int, entries: pd.DataFrame, sources: pd.DataFrame) -> dict[str, np.ndarray]:
    """Partial sums of a block and a pair of tiles, in columns."""
    sources = sources.drop_duplicates("source").sort_values("source")
    names = sources["source"].to_numpy(object)
    total = sources["total"].to_numpy(np.int64) + sources["v"].to_numpy(np.int64)
    rest = probabilities(np.ones(len(names), np.int64), total)
    tile = sources["tile"].to_numpy()
    source = entries["source"].map({n: k for k, n in enumerate(names)}).to_numpy(np.int64)
    order = np.argsort(source, kind="stable")
    source, term = source[order], pd.factorize(entries["term"])[0][order]
    p = probabilities(entries["n"].to_numpy(np.int64)[order] + 1, total[source])
    of, to = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
    found = [(np.full(len(of), h), value, terms, distance(rest[of], rest[h])) for h, value, terms in sums(source, term, p, rest, of, to)]
    item, value, terms, apart = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
    return {"source": np.tile(names[of], len(found)), "item": names[item], "value": value, "terms": terms, "apart": apart}


def pairs(kept: DataFrame, groups: DataFrame, langs: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, item, value) for any two sources of a language.  ``kept``: (lang, source, term, n);
    ``groups``: (lang, source, total); ``langs``: (lang, v)."""
    sizes = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    blocks = kept.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    plan = sizes.join(blocks, "lang", "left").join(langs.select("lang", "v"), "lang", "left").na.fill({"blocks": 1, "v": 0})
    plan = byte_terms.small(common.cut(plan), SMALL)
    own = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
    # in the first place of a pair of tiles, and in the second unless that is the same place again
    others = F.sequence(F.lit(0), F.col("tiles") - 1)
    places = F.array_distinct(F.flatten(F.transform(others, lambda o: F.array(F.struct(F.col("tile").alias("i"), o.alias("j")), F.struct(o.alias("i"), F.col("tile").alias("j"))))))
    of = lambda df: df.join(plan, "lang").where("v > 0").withColumn("tile", own).withColumn("place", F.explode(places))
    cells = of(kept).select("lang", "place.i", "place.j", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "n")
    names = of(groups).select("lang", "place.i", "place.j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "total", "v", "tile")
    key = ["lang", "i", "j", "block"]

    def look(key, entries, sources):
        rows = _pairs(key[1], key[2], entries, sources)
        n = len(rows["item"])
        return pd.DataFrame({"lang": np.full(n, key[0], object), **rows, "v": np.full(n, sources["v"].iloc[0] if len(sources) else 0)}).astype({c: object for c in ("lang", "source", "item")})

    partial = cells.groupBy(*key).cogroup(names.groupBy(*key)).applyInPandas(look, "lang string, source string, item string, value long, terms long, apart long, v long")
    full = partial.where("source <> item").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"), F.max("apart").alias("apart"), F.max("v").alias("v"))
    found = full.select("lang", "source", "item", (F.col("value") + (F.col("v") - F.col("terms")) * F.col("apart")).alias("value"))
    # languages without a kept term
    empty = groups.join(plan, "lang").where("v = 0").select("lang", "source")
    return found.unionByName(empty.join(empty.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value")))


def ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, documents: int = DOCUMENTS, terms: int = TERMS, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` holds the divergence of each source of a language from each
    other one, part ``term`` the terms that set a source apart from its language.

    Null and empty languages and sources are '', null texts have no terms.  A source without terms is a source of nothing
    but unseen terms; in a language without kept terms all divergences are 0 and no terms stand.  Repeated rows
    count as often as they stand there.  Equal values go by the item's bytes.  An empty table gives an empty one, other
    columns are not looked at."""
    with common.Scratch(docs.sparkSession) as scratch:
        found = scratch.keep(counts(docs))
        langs = found.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("df").alias("df")).where(F.col("df") >= documents).select("lang", "term", "all")
        kept = scratch.keep(found.where("term is not null").select("lang", "source", "term", "n").join(langs, ["lang", "term"]))
        totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = common.cut(found.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").na.fill({"total": 0}))
        sizes = groups.groupBy("lang").agg(F.sum("total").alias("in_all"))
        vocabulary = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
        sizes = common.cut(sizes.join(vocabulary, "lang", "left").na.fill({"v": 0}))

        known = byte_terms.small(groups.join(sizes, "lang"), SMALL)
        p = F.lit(1) + byte_terms.share(F.col("n") + 1, F.col("total") + F.col("v"))
        q = F.lit(1) + byte_terms.share(F.col("all") + 1, F.col("in_all") + F.col("v"))
        apart = kept.join(known, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
        value = byte_terms.divided((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
        top = ranked(apart.select("lang", "source", "item", value.alias("value")), "term").where(F.col("rank") <= terms)
        among = pairs(kept.select("lang", "source", "term", "n"), groups, sizes, block, tile)
        return common.cut(ranked(among, "pair").unionByName(top))


def sql() -> str:
    """The same in DuckDB SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS df FROM (SELECT row, lang, source, unnest(terms) AS term FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(df) >= {DOCUMENTS}),
l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY ALL),
g AS (SELECT s.lang, s.source, coalesce(sum(o.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN (SELECT c.* FROM c JOIN k USING (lang, term)) o ON s.lang = o.lang AND s.source = o.source GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + ({ONE} * (coalesce(c.n, 0) + 1)) // (g.n + l.v) AS BIGINT) AS p, CAST(1 + ({ONE} * (k.total + 1)) // (l.n + l.v) AS BIGINT) AS q
  FROM g JOIN l ON g.lang = l.lang JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
e AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term WHERE a.source <> b.source GROUP BY ALL),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(e.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN e ON e.lang = a.lang AND e.source = a.source AND e.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
WHERE part = 'pair' OR rank <= {TERMS}
"""


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.documents(spark, sf_dir))
