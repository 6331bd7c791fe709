"""A quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins.  Boosting goes round the features: at each turn a shallow tree (one or two
splits over the feature's bins) is fitted to the gradient and added, shrunk, to the feature's lookup
table.  Then pairs of features that explain most of what is left get tables over two-way bins, boosted
the same way by trees of one split a feature.  A score is the sigmoid of a sum of table entries, for
all rows of a batch at once.

Training takes a bounded sample of labelled rows; features of it are gathered on the driver, the model
is a few thousand numbers, and scoring is one pass over the documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .quality_rules import repeated_words

BATCH_BYTES = 1 << 19
#: Most labelled rows that are used in training, those of the smallest hash of doc_id.
SAMPLE = 20_000
BINS = 32
ROUNDS = 120
PAIRS = 8
PAIR_BINS = 8
PAIR_ROUNDS = 40
RATE = 0.15
THRESHOLD = 0.7

FEATURES = ("log_words", "word_length", "symbols", "pipes", "capitals", "capital_words", "exclamations", "digits", "punctuation", "non_ascii", "distinct_words", "adjacent_repeats", "top_word", "repeated_words", "duplicate_lines", "line_words", "short_words")


def features(text: bytes) -> tuple[float, ...]:
    """Of a whole text, each a ratio but for the first; all 0 without words."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    blank = int(counts[[32, 9, 10, 11, 12, 13]].sum())
    chars = int(counts.sum() - counts[0x80:0xC0].sum()) - blank
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    capital = int(counts[65:91].sum())
    symbols = int(counts[list(b"#*$%&<>@^~{}[]\\=+_")].sum())
    pipes, bangs, digits = int(counts[124]), int(counts[33]), int(counts[48:58].sum())
    return (
        float(np.log1p(n)),
        chars / n,
        symbols / n,
        pipes / n,
        capital / max(1, chars),
        sum(map(bytes.isupper, words)) / n,
        bangs / n,
        digits / n,
        int(counts[list(b".,;:?'\"()-")].sum()) / n,
        int(counts[0xC0:].sum()) / max(1, chars),
        len(tally) / n,
        sum(map(eq, words, words[1:])) / n,
        max(tally.values()) / n,
        repeated_words(words) / n,
        (len(lines) - len(set(lines))) / len(lines),
        len(lines) / n,
        sum(len(w) <= 3 for w in tally) / len(tally),
    )


@dataclass
class Model:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)  # upper edges of all bins but the last
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # bin -> bin of a pair's table
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(self.edges)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        bins = self.bins(x) if self.edges else []
        for b, t in zip(bins, self.tables, strict=True):
            total += t[b]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _best_split(gradient: np.ndarray, hessian: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins in two; place 0 if none gains."""
    if len(gradient) < 2:
        return 0.0, 0
    g, h = np.cumsum(gradient)[:-1], np.cumsum(hessian)[:-1]
    all_g, all_h = gradient.sum(), hessian.sum()
    gain = g * g / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
    at = int(np.argmax(gain))
    return (float(gain[at]), at + 1) if gain[at] > 1e-12 else (0.0, 0)


def shallow_tree(gradient: np.ndarray, hessian: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Step of each bin: the bins in up to ``leaves`` neighbouring groups, split where it gains most."""
    groups = [(0, len(gradient))]
    while len(groups) < leaves:
        gain, at, k = max((*_best_split(gradient[a:b], hessian[a:b]), k) for k, (a, b) in enumerate(groups))
        if not at:
            break
        a, b = groups[k]
        groups[k : k + 1] = [(a, a + at), (a + at, b)]
    out = np.empty(len(gradient))
    for a, b in groups:
        out[a:b] = gradient[a:b].sum() / (hessian[a:b].sum() + 1)
    return out


def pair_tree(gradient: np.ndarray, hessian: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best tree that splits one feature, then each half by the other."""
    best = (-1.0, np.zeros_like(gradient))
    for axis in (0, 1):
        g, h = (gradient, hessian) if axis == 0 else (gradient.T, hessian.T)
        for cut in range(1, len(g)):
            gain, steps = 0.0, np.zeros_like(g)
            for a, b in ((0, cut), (cut, len(g))):
                gs, hs = g[a:b].sum(0), h[a:b].sum(0)
                _, at = _best_split(gs, hs)
                for c, d in ((0, at), (at, len(gs))) if at else ((0, len(gs)),):
                    value = gs[c:d].sum() / (hs[c:d].sum() + 1)
                    gain += gs[c:d].sum() * value
                    steps[a:b, c:d] = value
            if gain > best[0]:
                best = gain, steps if axis == 0 else steps.T.copy()
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of features ``x`` and labels ``y`` (0 or 1); without rows every score is one half."""
    model = Model()
    if not len(y):
        return model
    rate = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(rate / (1 - rate)))
    for column in x.T:
        model.edges.append(np.unique(np.quantile(column, np.arange(1, BINS) / BINS, method="lower")))
    bins = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    total = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for b, t, size in zip(bins, model.tables, sizes, strict=True):
            g, h = slopes()
            step = RATE * shallow_tree(np.bincount(b, g, size), np.bincount(b, h, size))
            t += step
            total += step[b]
    model.coarse = [np.minimum(np.arange(s) * PAIR_BINS // s, PAIR_BINS - 1) for s in sizes]
    small = [c[b] for c, b in zip(model.coarse, bins, strict=True)]

    def table(i: int, j: int, weights: np.ndarray) -> np.ndarray:
        return np.bincount(small[i] * PAIR_BINS + small[j], weights, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)

    g, h = slopes()
    gains = sorted(((pair_tree(table(i, j, g), table(i, j, h))[0], -i, -j) for i in range(len(sizes)) for j in range(i)), reverse=True)
    model.pairs = [(-i, -j) for _, i, j in gains[:PAIRS]]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            step = RATE * pair_tree(table(i, j, g), table(i, j, h))[1]
            t += step
            total += step[small[i], small[j]]
    return model


def held_out(doc_id) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of ``labels`` (doc_id, quality) that are not held out.  Rows with a null are left out; equal
    identifiers with different labels each count.  The sample of labels has a fixed bound, so it is
    broadcast to find its documents."""
    chosen = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    chosen = chosen.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    schema = pa.schema([("quality", pa.int32()), ("x", pa.list_(pa.float64()))])

    def run(batches):
        for batch in common.byte_batches(batches, BATCH_BYTES):
            yield common.record(schema, batch.column(0), [list(features(t)) for t in common.as_bytes(batch.column(1))])

    rows = common.id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("quality", "text", "doc_id")
    rows = rows.select("quality", "text").mapInArrow(run, "quality int, x array<double>").orderBy(F.xxhash64("x"), "x", "quality").limit(sample).collect()
    return fit(np.array([r["x"] for r in rows], np.float64).reshape(len(rows), len(FEATURES)), np.array([r["quality"] for r in rows], np.float64))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    Texts without words, null ones included, have the features 0 and the score that this gives.  Repeated
    rows have equal scores, a null doc_id stays null and isn't held out, an empty table gives an
    empty one; identifier, language, source and further columns are not looked at."""

    def run(batches):
        for batch in common.byte_batches(batches, BATCH_BYTES):
            scores = model.scores(np.array([features(t) for t in common.as_bytes(batch.column(2))]))
            yield common.record(SCHEMA, batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)))

    rows = common.id_and_text(docs)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches the threshold.

    Null and empty texts have the score of a text without words; repeated rows stay or go together; an empty table
    gives an empty one."""
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                scores = model.scores(np.array([features(t or b"") for t in common.as_bytes(batch.column(place))]))
                yield batch.filter(pa.array(scores >= threshold))

    return common.bounded(docs).mapInArrow(run, docs.schema)


def op10_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
