"""Byte-gram bucket identifiers and content-chosen anchors over whole texts.

A bucket identifier of a position is a 64-bit name of the q bytes that begin
there.  Names of length 2q come from the names of length q at a position and at
the later offset position + q, so each refinement reuses the one before it.
"""

from __future__ import annotations

import numpy as np

#: Bytes of the strings that count as repeats, and of the first buckets.
WINDOW, GRAM = 100, 32
#: A window holds so many grams; the least of them anchors it.
SPAN = WINDOW - GRAM + 1
#: Window starts that are handled at a time, so that all arrays stay in cache.
BLOCK = 1 << 15
_POS = np.uint64((1 << 17) - 1)


class Ladder:
    """Identifiers of 1, 2, 4, ... bytes, from tables drawn from a seed."""

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.table = draw.integers(0, 2**64, 256, dtype=np.uint64)
        self.factors = (draw.integers(0, 2**62, 8, dtype=np.uint64) << np.uint64(2)) | np.uint64(3)

    def climb(self, data: np.ndarray, upto: int) -> np.ndarray:
        """Identifiers of `upto` bytes (a power of two) at each position."""
        ids, step, level = self.table[data], 1, 0
        while step < upto:
            more = ids[:-step] * self.factors[level]
            more += ids[step:]
            ids, step, level = more, step * 2, level + 1
        return ids

    def windows(self, data: np.ndarray) -> np.ndarray:
        """Identifiers of WINDOW bytes: two of 64 bytes that overlap."""
        ids = self.climb(data, 64)
        out = ids[: -(WINDOW - 64)] * self.factors[7]
        out += ids[WINDOW - 64 :]
        return mixed(out)


FIRST, SECOND = Ladder(20_001), Ladder(20_002)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit values, in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def window_runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window start of each text that holds a window."""
    whole = ends - starts >= WINDOW
    return starts[whole], ends[whole] - WINDOW


def _valid(lo: int, hi: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which window starts of [lo, hi) stay inside one text."""
    a, b = np.searchsorted(last, lo), np.searchsorted(first, hi)
    edge = np.zeros(hi - lo + 1, np.int8)
    edge[np.maximum(first[a:b] - lo, 0)] += 1
    edge[np.minimum(last[a:b] + 1 - lo, hi - lo)] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8).view(bool)


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Yield (position, run, bucket, name) arrays: runs of windows with one anchor.

    `data` holds the texts' bytes one after another; text i is
    data[starts[i]:ends[i]].  bucket is the anchor gram's identifier, name the
    whole run's, which is the same for two runs if their bytes are.
    """
    first, last = window_runs(starts, ends)
    if not len(first):
        return
    stop = int(last[-1]) + 1
    for lo in range(int(first[0]), stop, BLOCK):
        hi = min(lo + BLOCK, stop)
        ok = _valid(lo, hi, first, last)
        if not ok.any():
            continue
        part = data[lo : hi + WINDOW - 1]
        grams = mixed(FIRST.climb(part, GRAM))
        low = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while width * 2 <= SPAN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: hi - lo], low[SPAN - width : SPAN - width + hi - lo])
        anchor = (low & _POS).astype(np.int32)
        new = np.empty(hi - lo, bool)
        new[0] = True
        np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
        new[1:] |= ~ok[:-1]
        at = np.flatnonzero(new & ok)
        end_of = new.copy()
        end_of[1:] |= ok[1:] != ok[:-1]
        bounds = np.append(np.flatnonzero(end_of), hi - lo)
        to = bounds[np.searchsorted(bounds, at, side="right")] - 1
        run = to - at + 1
        ids = SECOND.windows(part)
        name = mixed(ids[at] * np.uint64(0xD6E8FEB86659FD93) + ids[to] * np.uint64(0xA0761D6478BD642F) + run.astype(np.uint64))
        yield at + lo, run, grams[anchor[at]], name
