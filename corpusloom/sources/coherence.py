"""Which charset a text was written in, by how its letters stand together.

A model is learnt from a table's own clean texts: how often each pair of neighbouring characters stands there, of which one
at least isn't ASCII; ASCII letters count as one, so do digits and the rest.  Bytes are decoded by each charset that can,
and the reading whose pairs are likeliest wins, if it does so by a margin; else the chain of ``charsets.decode`` decides.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from ..session import bounded
from .charsets import decode

#: Readings that are tried.
CHARSETS = ("utf-8", "cp1252", "cp1250", "cp1251", "koi8-r", "mac_roman", "cp437", "cp850")
#: Pairs of a model at most: the commonest ones. This bounds what goes to each task.
PAIRS = 20_000
#: By how much, in natural logarithms over all its pairs, the best reading must beat the next one that differs.
MARGIN = 3.0
LETTER, DIGIT, OTHER = 97, 48, 32


def pairs_of(text: str) -> np.ndarray:
    """Pairs of neighbouring characters with one at least beyond ASCII, as first << 21 | second."""
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    high = codes > 127
    if not high.any():
        return np.zeros(0, np.int64)
    lowered = codes | 32
    plain = np.where((lowered >= 97) & (lowered <= 122), LETTER, np.where((codes >= 48) & (codes <= 57), DIGIT, OTHER))
    folded = np.where(high, codes, plain)
    some = high[:-1] | high[1:]
    return folded[:-1][some] << 21 | folded[1:][some]


def pair_counts(df: DataFrame, column: str) -> DataFrame:
    """(pair, n) of all texts of a column; null texts have none."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            found = [pairs_of(t) for t in batch.column(0).to_pylist() if t]
            if found:
                pair, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], schema=schema)

    return bounded(df.select(column)).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


class Model:
    """Logarithms of the pairs' shares; pairs that aren't known count as half a time."""

    def __init__(self, counts: dict[int, int]):
        total = sum(counts.values()) + 1
        self.known = {pair: math.log(n / total) for pair, n in counts.items()}
        self.unknown = math.log(0.5 / total)

    def likelihood(self, text: str) -> float:
        """Mean logarithm of a text's pairs; 0 for one of ASCII alone."""
        found, n = np.unique(pairs_of(text), return_counts=True)
        if not len(found):
            return 0.0
        get, unknown = self.known.get, self.unknown
        return sum(get(p, unknown) * k for p, k in zip(found.tolist(), n.tolist(), strict=True)) / int(n.sum())

    def told(self, data: bytes) -> str | None:
        """The charset of the likeliest reading; None if there is none by the margin."""
        best: list[tuple[float, str, str]] = []
        for name in CHARSETS:
            try:
                text = data.decode(name)
            except UnicodeDecodeError:
                continue
            if all(text != other for *_, other in best):
                best.append((self.likelihood(text), name, text))
        best.sort(key=lambda x: -x[0])
        # readings that differ in few characters differ little in the mean: what counts is the whole
        if not best or len(best) > 1 and (best[0][0] - best[1][0]) * len(pairs_of(best[0][2])) < MARGIN:
            return None
        return best[0][1]

    def decoded(self, data: bytes, declared: str | None = None) -> str:
        name = self.told(data)
        return data.decode(name) if name else decode(data, declared)


@F.pandas_udf(BinaryType())
def written(texts: pd.Series, charsets: pd.Series) -> pd.Series:
    """The bytes of texts in these charsets; in UTF-8 where a charset lacks a character."""

    def one(text: str | None, name: str) -> bytes | None:
        if text is None:
            return None
        try:
            return text.encode(name)
        except UnicodeEncodeError:
            return text.encode("utf-8", "surrogatepass")

    return pd.Series([one(t, c) for t, c in zip(texts, charsets, strict=True)], dtype=object)


def train(df: DataFrame, column: str = "text", pairs: int = PAIRS) -> Model:
    """A model of the texts of a table: all are counted, the commonest pairs are kept."""
    rows = pair_counts(df, column).orderBy(F.desc("n"), F.asc("pair")).limit(pairs).collect()
    return Model({r["pair"]: r["n"] for r in rows})


def decoded(df: DataFrame, model: Model, data: str = "data", text: str = "text") -> DataFrame:
    """``df`` with ``text``: the bytes of ``data``, read by the model. Null bytes give a null text."""
    columns = [c for c in df.columns if c != text]
    place = columns.index(data)

    def run(batches):
        for batch in batches:
            found = [None if d is None else model.decoded(d).encode("utf-8", "replace").decode() for d in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, text])

    kept = bounded(df.select(*columns))
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(text, StringType())]))
