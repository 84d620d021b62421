"""Hashed word shingles of blocks of texts, in numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.  A shingle is a run of ``size`` words; a
text of fewer words has its whole sequence as one shingle, and a text without words has none.  Words and
shingles are 64-bit hashes, so two different ones are taken as equal with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, np.uint64(base))
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the number of the first word of each text (with the total at the end)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    bounds = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])
    space = _IS_SPACE[data]
    word = ~space
    before = np.concatenate([[True], space[:-1]])
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(space & ~before)
    out = np.empty(len(starts), np.uint64)
    step = 1 << 20  # words are hashed in stretches, so the table of powers stays small
    at = 0
    while at < len(starts):
        lo = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, lo + step, "right")))
        hi = ends[to - 1]
        up, down = _powers_of(int(hi - lo) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[data[lo:hi]].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], dtype=np.uint64)])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out, np.searchsorted(starts, bounds)


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, first = word_hashes([t.encode("utf-8", "replace") for t in texts])
    rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        rolled = mix(rolled + words[k : k + len(rolled)]) if len(rolled) else rolled
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            own = np.sort(rolled[a : b - size + 1])
            keep = np.ones(len(own), bool)
            keep[1:] = own[1:] != own[:-1]
            out.append(own[keep])
        elif b > a:
            h = np.full(1, ((b - a) * 0xD6E8FEB86659FD93) & (2**64 - 1), np.uint64)
            for w in words[a:b]:
                h = mix(h + w)
            out.append(h)
        else:
            out.append(words[:0])
    return out
