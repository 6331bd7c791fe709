"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

A sketch is a log-linear histogram: a value's bucket is its leading eight bits and their place, so
buckets are exact below 256 and within 1/128 above, counts of buckets add up in any order, and a
sketch has some hundred buckets however many values went in.  The quartiles of a group's sketch are drawn
towards those of its language's as if it had PRIOR more documents, and a rule's fence stands REACH
quartile ranges beyond them.  No cutoff and no width is fixed: where quartiles coincide, the range is the
width of their bucket.  Documents are then joined with the fences of their group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BATCH_BYTES = 1 << 19
SPAN = 8
#: (name, whole value in Spark SQL, in DuckDB SQL, has a lower fence): marks and characters per thousand words, and
#: how much of the words' variety is lacking, in thousandths.
RULES = (
    ("marks", "(1000 * n_marks) div greatest(n_words, 1)", "(1000 * n_marks) // greatest(n_words, 1)", False),
    ("length", "(1000 * word_chars) div greatest(n_words, 1)", "(1000 * word_chars) // greatest(n_words, 1)", True),
    ("sameness", "sameness", "sameness", False),
)
#: Fences stand this many quartile ranges from the quartiles.
REACH = 5
#: Documents that the language's quartiles count as in the quartiles of a group.
PRIOR = 10
#: Leading bits of a value that its bucket keeps.
KEPT_BITS = 8
HALF = 1 << KEPT_BITS - 1
#: Up to so many groups the table of fences is broadcast; above, it is joined by shuffle.
BROADCAST_GROUPS = 100_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Neither letter, digit nor white space, of ASCII.
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(128) if not chr(c).isalnum() and c not in b" \t\n\v\f\r"]] = True
#: Bytes that begin a code point of a word: neither white space nor a continuation.
_LETTER = np.ones(256, bool)
_LETTER[list(b" \t\n\v\f\r")] = False
_LETTER[0x80:0xC0] = False


def repeated_words(words: list[bytes], span: int = SPAN) -> int:
    """Words inside windows of ``span`` words that the text has twice or more, the first ones included."""
    n = len(words) - span + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    windows = np.lib.stride_tricks.sliding_window_view(codes, span)
    salts = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(span)], np.uint64)
    hashes = np.zeros(n, np.uint64)
    for i in range(span):
        hashes += (codes[i : i + n].astype(np.uint64) + np.uint64(1)) * salts[i]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return 0
    left, right = order[:-1][same], order[1:][same]
    twice = np.zeros(n, bool)
    equal = (windows[left] == windows[right]).all(1)
    if equal.all():
        twice[left] = twice[right] = True
    else:  # different windows of one hash: count them as they are
        _, inverse, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
        twice = counts[inverse.ravel()] > 1
    delta = np.zeros(len(words) + 1, np.int64)
    delta[:n] += twice
    delta[span : span + n] -= twice
    return int((np.cumsum(delta[:-1]) > 0).sum())


def sameness(n_words: int, n_distinct: int) -> int:
    """1 - log(distinct words) / log(words) in thousandths: 0 if no word comes twice, 1000 if all are one."""
    return math.floor(1000 * (1 - math.log(n_distinct) / math.log(n_words)) + 0.5) if n_words > 1 else 0


def measures(text: bytes) -> tuple[int, ...]:
    """The measures of NAMES."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), int(counts[_LETTER].sum()), int(counts[_SYMBOL].sum()), len(lines) - len(set(lines)), repeated_words(words), int(counts[_MARK].sum()), sameness(len(words), len(set(words)))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "sameness")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, measures) of every row; a null text has none of anything."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string())] + [(n, pa.int64()) for n in NAMES])

    def run(batches):
        for batch in common.byte_batches(batches, BATCH_BYTES):
            yield common.record(schema, *batch.columns[:3], *map(list, zip(*map(measures, common.as_bytes(batch.column(3))), strict=True)))

    docs = common.bounded(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in NAMES))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def bucket(x: Column) -> Column:
    """Bucket of a whole number >= 0."""
    shift = shift_of(x)
    return shift.cast("long") * HALF + F.call_function("shiftright", x, shift)


def shift_of(x: Column) -> Column:
    """Bits that the bucket of a whole number loses; it is two to this power wide."""
    return F.greatest(F.length(F.bin(x)) - KEPT_BITS, F.lit(0))


def bucket_top(b: Column) -> Column:
    """Largest value of a bucket."""
    shift = F.greatest(F.floor(b / HALF) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", b - shift.cast("long") * HALF + 1, shift) - 1


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n): the sketches of all groups and rules, combined before the shuffle.

    Documents that fail the base rules don't count."""
    values = F.array(*(F.struct(F.lit(i).alias("rule"), bucket(F.expr(value)).alias("bucket")) for i, (_, value, _, _) in enumerate(RULES)))
    return rows.where(~base_failed()).select("lang", "source", F.explode(values).alias("v")).groupBy("lang", "source", "v.rule", "v.bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(*many: DataFrame) -> DataFrame:
    """One sketch of several corpora's sketches."""
    whole = many[0]
    for other in many[1:]:
        whole = whole.unionByName(other)
    return whole.groupBy("lang", "source", "rule", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, *group: str) -> DataFrame:
    """(group, n, q1, q3): number of values and quartiles of each sketch."""
    whole = Window.partitionBy(*group)
    upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(whole)).withColumn("top", bucket_top(F.col("bucket")))
    first = lambda quarters: F.min(F.when(4 * F.col("upto") >= quarters * F.col("all"), F.col("top")))
    return ranked.groupBy(*group).agg(F.max("all").alias("n"), first(1).alias("q1"), first(3).alias("q3"))


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, low_1, high_0, ...): the fences of each group, from its quartiles and its language's."""
    parent = quartiles(sketch.groupBy("lang", "rule", "bucket").agg(F.sum("n").alias("n")), "lang", "rule").select(F.col("lang").alias("p_lang"), F.col("rule").alias("p_rule"), F.col("q1").alias("p1"), F.col("q3").alias("p3"))
    own = quartiles(sketch, "lang", "source", "rule")
    both = own.join(parent, F.col("lang").eqNullSafe(F.col("p_lang")) & (F.col("rule") == F.col("p_rule")))
    both = both.select("lang", "source", "rule", *(F.expr(f"(n * q{k} + {PRIOR} * p{k}) div (n + {PRIOR})").alias(f"q{k}") for k in (1, 3)))
    reach = REACH * F.greatest(F.col("q3") - F.col("q1"), F.call_function("shiftleft", F.lit(1).cast("long"), shift_of(F.col("q3"))))
    wide = []
    for i, (_, _, _, lower) in enumerate(RULES):
        this = F.col("rule") == i
        if lower:
            wide.append(F.max(F.when(this, F.col("q1") - reach)).alias(f"low_{i}"))
        wide.append(F.max(F.when(this, F.col("q3") + reach)).alias(f"high_{i}"))
    return both.groupBy("lang", "source").agg(*wide)


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, measures, base_failed, kept, broken) of every row of ``docs`` (doc_id, text, lang, source).

    ``kept`` is false for rows that fail the base rules or stand outside of a fence of their language and
    source; ``broken`` names those fences.  Null languages and sources are groups of their own.  A null
    or empty text has no words and fails the base rules.  Repeated rows and null identifiers stay, an
    empty table gives an empty one, further columns are not looked at."""
    rows = common.cut(measured(docs))
    limits = common.cut(fences(sketches(rows))).withColumnRenamed("lang", "__lang").withColumnRenamed("source", "__source")
    small = limits.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    joined = rows.join(F.broadcast(limits) if small else limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    broken = []
    for i, (name, value, _, lower) in enumerate(RULES):
        v = F.expr(value)
        out = v > F.col(f"high_{i}")
        if lower:
            out = out | (v < F.col(f"low_{i}"))
        broken.append(F.when(out, F.lit(name)))
    kept = ~base_failed() & (F.length("broken") == 0)
    return joined.withColumn("broken", F.concat_ws(",", *broken)).select("doc_id", *NAMES, base_failed().alias("base_failed"), kept.alias("kept"), "broken")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(common.documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken")


_SHIFT = f"greatest(length(bin({{0}})) - {KEPT_BITS}, 0)"
_BUCKET = f"{HALF} * {_SHIFT} + ({{0}} >> {_SHIFT})"
_FROM_TOP = f"greatest(bucket // {HALF} - 1, 0)"
_TOP = f"((bucket - {HALF} * {_FROM_TOP} + 1) << CAST({_FROM_TOP} AS INTEGER)) - 1"


def sql() -> str:
    """The same in DuckDB SQL."""
    parts = " UNION ALL ".join(f"SELECT lang, source, {i} AS rule, {_BUCKET.format(f'v{i}')} AS bucket FROM good" for i in range(len(RULES)))
    out = []
    for i, (name, _, _, lower) in enumerate(RULES):
        low = f" OR v{i} < f{i}.q1 - f{i}.reach" if lower else ""
        out.append(f"CASE WHEN v{i} > f{i}.q3 + f{i}.reach{low} THEN '{name}' END")
    joins = " ".join(f"LEFT JOIN fences f{i} ON f{i}.rule = {i} AND f{i}.lang IS NOT DISTINCT FROM m.lang AND f{i}.source IS NOT DISTINCT FROM m.source" for i in range(len(RULES)))
    sketch = lambda name, *group: f"""{name}_ranked AS (SELECT *, {_TOP} AS top, sum(n) OVER (PARTITION BY {', '.join(group)} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {', '.join(group)}) AS total FROM {name}),
{name}_quartiles AS (SELECT {', '.join(group)}, max(total) AS n, min(top) FILTER (WHERE 4 * upto >= total) AS q1, min(top) FILTER (WHERE 4 * upto >= 3 * total) AS q3 FROM {name}_ranked GROUP BY {', '.join(group)})"""  # noqa: E731
    return f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, lang, source FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM docs),
tokens AS (SELECT row, unnest(words) AS w, generate_subscripts(words, 1) AS p FROM split),
windows AS (SELECT row, p, count(*) OVER nxt AS n, string_agg(w, ' ') OVER nxt AS text FROM tokens WINDOW nxt AS (PARTITION BY row ORDER BY p ROWS BETWEEN CURRENT ROW AND {SPAN - 1} FOLLOWING)),
twice AS (SELECT row, p FROM (SELECT row, p, count(*) OVER (PARTITION BY row, text) AS c FROM windows WHERE n = {SPAN}) WHERE c > 1),
repeated AS (SELECT row, count(DISTINCT p + i) AS n FROM twice, range({SPAN}) r(i) GROUP BY row),
m AS (SELECT s.row, doc_id, lang, source, len(words) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, length(text) - length(regexp_replace(text, '[\\x00-\\x08\\x0E-\\x1F!-/:-@\\[-`{{-\\x7F]', '', 'g')) AS n_marks,
  CASE WHEN len(words) > 1 THEN CAST(floor(1000 * (1 - ln(len(list_distinct(words))) / ln(len(words))) + 0.5) AS BIGINT) ELSE 0 END AS sameness FROM split s LEFT JOIN repeated r ON r.row = s.row),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {', '.join(f'{r[2]} AS v{i}' for i, r in enumerate(RULES))} FROM m),
good AS (SELECT * FROM v WHERE NOT base_failed),
own AS (SELECT lang, source, rule, bucket, count(*) AS n FROM ({parts}) GROUP BY ALL),
parent AS (SELECT lang, rule, bucket, sum(n) AS n FROM own GROUP BY ALL),
{sketch('own', 'lang', 'source', 'rule')},
{sketch('parent', 'lang', 'rule')},
shrunk AS (SELECT o.lang, o.source, o.rule, CAST((o.n * o.q1 + {PRIOR} * p.q1) // (o.n + {PRIOR}) AS BIGINT) AS q1, CAST((o.n * o.q3 + {PRIOR} * p.q3) // (o.n + {PRIOR}) AS BIGINT) AS q3
  FROM own_quartiles o JOIN parent_quartiles p ON o.rule = p.rule AND o.lang IS NOT DISTINCT FROM p.lang),
fences AS (SELECT *, {REACH} * greatest(q3 - q1, 1 << {_SHIFT.format('q3')}) AS reach FROM shrunk)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, NOT base_failed AND broken = '' AS kept, broken
FROM (SELECT m.*, concat_ws(',', {', '.join(out)}) AS broken FROM v m {joins})
"""
