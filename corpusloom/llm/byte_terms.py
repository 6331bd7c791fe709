"""Terms of texts on the level of bytes.

The texts of a batch stand in one buffer, parted by a byte that no term holds.  A table of 256 entries tells which
bytes belong to terms; where that changes a term begins or ends.  Slices of the buffer are grouped by their
XXH64, and every slice is held against its group's first one byte by byte: those that differ are
grouped again under another seed, so that no collision ever joins two terms.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that are cut at once.
BATCH_BYTES = 1 << 20

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LOWERED = bytes.maketrans(_UPPER, _UPPER.lower())


def table(*ranges: tuple[int, int]) -> np.ndarray:
    """Membership of each byte: those of the ranges, ends included, and all from 128 on."""
    found = np.zeros(256, bool)
    found[128:] = True
    for low, high in ranges:
        found[low : high + 1] = True
    return found


LETTERS = table((0x41, 0x5A), (0x61, 0x7A))
LETTERS_AND_DIGITS = table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))


def slices(texts: list[bytes], members: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The buffer with A-Z lower-cased and blanks between terms, and of each term its text's number, its begin and its end."""
    lowered = np.frombuffer(_LOWERED, np.uint8)
    buffer = b"\n".join(texts).translate(np.where(members, lowered, 32).astype(np.uint8).tobytes())
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = members[np.frombuffer(buffer, np.uint8)]  # lower case stays within the members
    edges = np.flatnonzero(np.diff(inside))
    begin, end = edges[::2], edges[1::2]
    starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return buffer, np.searchsorted(starts, begin, side="right") - 1, begin, end


def hashes(terms: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, terms, repeat(seed)), np.uint64, len(terms))


def unequal(data: np.ndarray, begin: np.ndarray, size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which slices of these begins and sizes (one byte at least) differ from those of equal size that begin at ``other``."""
    first = np.cumsum(size) - size
    along = np.arange(int(size.sum()))
    differs = data[along + np.repeat(begin - first, size)] != data[along + np.repeat(other - first, size)]
    return np.logical_or.reduceat(differs, first) if len(size) else np.zeros(0, bool)


def grouped(buffer: bytes, begin: np.ndarray, end: np.ndarray, seed: int = 0, hashed=hashes) -> tuple[list[bytes], np.ndarray]:
    """The distinct slices, and of each slice the number of its own among them. ``buffer`` has blanks between the terms."""
    return _grouped(buffer, buffer.split(), begin, end, seed, hashed)


def _grouped(buffer, slices, begin, end, seed, hashed):
    if not len(begin):
        return [], np.zeros(0, np.int64)
    size, data = end - begin, np.frombuffer(buffer, np.uint8)
    _, first, group = np.unique(hashed(slices, seed), return_index=True, return_inverse=True)
    of = first[group]
    wrong = size != size[of]
    right = np.flatnonzero(~wrong)
    wrong[right] = unequal(data, begin[right], size[right], begin[of[right]])
    terms = [slices[i] for i in first.tolist()]
    if wrong.any():
        more, again = _grouped(buffer, [slices[i] for i in np.flatnonzero(wrong).tolist()], begin[wrong], end[wrong], seed + 1, hashed)
        group[wrong] = again + len(terms)
        terms += more
    return terms, group


def counted(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and how often each stands there."""
    return np.unique(pairs, return_counts=True)


def strings(terms: list[bytes]) -> pa.Array:
    """Terms as an Arrow column: maximal runs of such bytes of valid UTF-8 are valid themselves."""
    return pa.array(terms, pa.binary()).cast(pa.string())


def share(of: Column, total: Column) -> Column:
    """1000000000 * of div total in longs, without overflow up to 9e13 of each."""
    high = of * F.lit(100000)
    return _div(high, total) * F.lit(10000) + _div((high % total) * F.lit(10000), total)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def divided(a: Column, b: Column) -> Column:
    """Integer division of longs that aren't negative."""
    return _div(a, b)


def small(df: DataFrame, limit: int) -> DataFrame:
    """``df``, whose rows are counted, marked for broadcast if there are no more than ``limit``."""
    return F.broadcast(df) if df.count() <= limit else df
