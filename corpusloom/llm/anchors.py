"""Content-defined anchors over sequences of 64-bit symbol codes.

Every window of ``span`` symbols picks its smallest k-gram, by hash and then leftmost, as its anchor.
The choice depends on the window alone, so equal windows have equal anchors at equal places wherever
they stand.  Consecutive windows with the same anchor form a *run*; a run's content is its symbols.
So windows can be equal only if the anchors of their runs are, and all windows of two runs of equal
content are equal in pairs.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
MASK = (1 << 64) - 1
#: Bases of the rolling hashes of k-grams, of contents and of windows (odd).
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Low bits of a sampling value hold the place, so the smaller place wins among equal hashes.
PLACE = 31


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 12)
        have = np.ones(size, U)
        done = 1
        while done < size:
            step = min(done, size - done)
            have[done : done + step] = have[:step] * U(pow(base, done, 1 << 64))
            done += step
        _powers[base] = have
    return have[:n]


class Rolling:
    """Hashes of any stretches of one sequence, equal for equal stretches."""

    def __init__(self, codes: np.ndarray, base: int):
        n = len(codes)
        self.sums = np.empty(n + 1, U)
        self.sums[0] = 0
        np.cumsum(codes * powers(base, n), out=self.sums[1:])
        self.inverse = powers(pow(base, -1, 1 << 64), n + 1)

    def all_of(self, size: int) -> np.ndarray:
        return mixed((self.sums[size:] - self.sums[: len(self.sums) - size]) * self.inverse[: len(self.sums) - size])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.inverse[start])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    if size < width:
        values = np.minimum(values[: len(values) - (width - size)], values[width - size :])
    return values


def runs(codes: np.ndarray, lengths: np.ndarray, gram: int, span: int):
    """Runs of the sequences that lie one after another in ``codes``.

    Returns place of the first window in ``codes``, number of windows, place of the anchor in the
    first window, hash of the anchor, hash of the content."""
    empty = np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    fits = lengths >= span
    if not fits.any():
        return empty, empty, empty, empty.astype(U), empty.astype(U)
    first, last = (ends - lengths)[fits], ends[fits] - span + 1
    grams = Rolling(codes, BASES[0]).all_of(gram)
    low = U((1 << PLACE) - 1)
    chosen = sliding_min((grams & ~low) | np.arange(len(grams), dtype=U), span - gram + 1)
    starts = np.zeros(len(chosen) + 1, bool)
    starts[1:-1] = chosen[1:] != chosen[:-1]
    starts[first] = starts[last] = True
    inside = np.zeros(len(chosen) + 1, np.int8)
    inside[first] = 1
    inside[last] -= 1
    bounds = np.flatnonzero(starts)
    begin = bounds[:-1]
    stop = bounds[1:]
    real = np.cumsum(inside)[begin] > 0
    begin, stop = begin[real], stop[real]
    anchor = (chosen[begin] & low).astype(np.int64)
    return begin, stop - begin, anchor - begin, grams[anchor], Rolling(codes, BASES[1]).of(begin, stop + span - 1)


def window_hashes(codes: np.ndarray, span: int) -> np.ndarray:
    return Rolling(codes, BASES[2]).all_of(span)
